"""The verbs of the command line, step by step."""

from __future__ import annotations

import json

from test_live_rounds import GOOD, _judge

from vellum import cli


def test_a_host_goes_from_verb_to_verb(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    spark.createDataFrame([(1, "We raise 3 million. It works well.", "润色", None), (2, "One. Two.", "审稿", None)], "doc_id long, text string, request string, file_path string").coalesce(1).write.parquet(at("docs"))
    spark.createDataFrame([(3, "x", "", "main.py")], "doc_id long, text string, request string, file_path string").write.parquet(at("code"))
    assert cli.main(["prepare", at("docs"), at("prep")]) == 0 and cli.main(["prepare", at("code"), at("prep3")]) == 2
    (tmp_path / "prompts").mkdir()
    (tmp_path / "prompts/diagnose.md").write_text("DIAGNOSE")
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules/a.json").write_text(json.dumps({"id": "R-1", "lang": "en", "title": "T"}))
    assert cli.main(["prompt", "diagnose", at("prep"), at("d"), "--prompts", at("prompts"), "--rules", at("rules")]) == 0
    asked = {r.doc_id: r.prompt for r in spark.read.parquet(at("d")).collect()}
    assert set(asked) == {1, 2} and asked[1].startswith("DIAGNOSE") and "### R-1 T" in asked[1]
    rows = [(1, "diagnose", 1, "none"), (1, "rewrite", 1, "no sections"), (1, "rewrite", 2, GOOD), (1, "judge", 2, _judge("通过"))]
    spark.createDataFrame(rows, "doc_id long, step string, round int, raw string").coalesce(1).write.parquet(at("outs"))
    assert cli.main(["apply", at("prep"), at("outs"), at("v1")]) == 1
    assert cli.main(["prompt", "rewrite", at("prep"), at("r2"), "--outputs", at("outs"), "--verified", at("v1")]) == 0
    assert [r.doc_id for r in spark.read.parquet(at("r2")).collect()] == [1] and '"id":"*"' in spark.read.parquet(at("r2")).first().prompt
    assert cli.main(["apply", at("prep"), at("outs"), at("v2"), "--round", "2"]) == 0
    assert cli.main(["prompt", "judge", at("prep"), at("j"), "--verified", at("v2")]) == 0 and "改文：It works nicely." in spark.read.parquet(at("j")).first().prompt
    spark.read.parquet(at("v1")).unionByName(spark.read.parquet(at("v2"))).write.parquet(at("v"))
    assert cli.main(["finish", at("prep"), at("v"), at("outs"), at("done")]) == 0
    got = {r.doc_id: (r.status, r.rounds, r.output_text) for r in spark.read.parquet(at("done")).collect()}
    assert got == {1: ("pass", 2, "We raise 3 million. It works nicely."), 2: ("reviewed", 1, "")}
    assert cli.main(["write-back", at("done"), at("back")]) == 0 and [r.doc_id for r in spark.read.parquet(at("back")).collect()] == [1]
    (tmp_path / "cases").mkdir()
    (tmp_path / "cases/1.json").write_text(json.dumps({"id": 1, "mode": "rewrite", "body": "a", "must_preserve": ["a"]}))
    spark.createDataFrame([(1, "b")], "case_id int, output string").write.parquet(at("eo"))
    assert cli.main(["results", at("cases"), at("eo"), at("er")]) == 1 and json.loads((tmp_path / "er/1.json").read_text())["failed"] == ["must_preserve:a"]
