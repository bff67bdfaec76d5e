"""Folders of records: round trips, commits, rules, cards and results."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from vellum.operators import report
from vellum.plans import runner
from vellum.sources import records, tables


def test_prepared_documents_come_back(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"We raise {i} million `x`.\n\n第二句。", "润色", None) for i in range(7)] + [(7, None, None, "a.md")], "doc_id long, text string, request string, file_path string").coalesce(2)
    made = runner.prepared(docs)
    tables.write_prepared(made, str(tmp_path / "p"))
    assert sorted(x.name for x in (tmp_path / "p").iterdir()) == sorted(f"{i}.json" for i in range(8))
    assert "第二句" in (tmp_path / "p/1.json").read_text(encoding="utf-8")
    back = tables.read_prepared(spark, str(tmp_path / "p"), made.schema)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, made.collect()))


def test_reads_lists_odd_values_and_groups_of_files(spark, tmp_path):
    records.register(spark)
    (tmp_path / "sub").mkdir()
    (tmp_path / "_x").mkdir()
    (tmp_path / "a.json").write_text('[{"id": 1, "s": 5, "n": {"k": "v", "z": 1}, "l": [1, "x", null]}, 7, {"id": "2"}]')
    (tmp_path / "sub/b.json").write_text('{"id": 3.5, "s": {"q": [1]}, "n": [], "l": "no", "extra": 1}')
    (tmp_path / "empty.json").write_text(" ")
    (tmp_path / "_x/c.json").write_text('{"id": 9}')
    schema = "id int, s string, n struct<k:string,m:int>, l array<string>, _path string"
    for size in (1, 10**9):
        d = spark.read.format("records").schema(schema).option("groupBytes", size).load(str(tmp_path))
        assert d.rdd.getNumPartitions() == (3 if size == 1 else 1)
        got = sorted(((r.id, r.s, r.n and tuple(r.n), r.l, r["_path"].rsplit("/", 1)[1]) for r in d.collect()), key=repr)
        assert got == sorted([(1, "5", ("v", None), ["1", "x", None], "a.json"), (2, None, None, None, "a.json"), (None, '{"q": [1]}', None, None, "b.json")], key=repr)
    assert spark.read.format("records").schema("id int").load(str(tmp_path / "_x" / "none")).count() == 0


def test_a_failed_job_leaves_nothing_and_overwrite_replaces(spark, tmp_path):
    records.register(spark)
    at = str(tmp_path / "o")
    df = spark.range(4).withColumn("t", F.lit("é"))
    df.write.format("records").option("name", "id").mode("append").save(at)
    bad = spark.range(10, 14).repartition(2).withColumn("t", F.when(F.col("id") == 13, F.raise_error(F.lit("gone"))).otherwise("x"))
    with pytest.raises(Exception, match="gone"):
        bad.write.format("records").option("name", "id").mode("append").save(at)
    assert sorted(x.name for x in (tmp_path / "o").iterdir()) == ["0.json", "1.json", "2.json", "3.json"]
    spark.range(2, 5).withColumn("t", F.lit("new/one")).write.format("records").option("name", "t").mode("overwrite").save(at)
    assert [x.name for x in (tmp_path / "o").iterdir()] == ["new%2Fone.json"]
    with pytest.raises(Exception, match="name"):
        df.write.format("records").mode("append").save(at)


def test_rules_and_cards(spark, tmp_path):
    a = {"id": "R-1", "lang": "en", "title": "T", "criterion": " c ", "fix": "f", "pass_when": "p", "severity": 2, "examples": [{"good": "g"}, {"bad": "b", "why": "w"}], "detector": {"kind": "regex", "regex": "x+"}, "genre_strength": {"mail": "high"}}
    (tmp_path / "a.json").write_text(json.dumps(a | {"title": "old"}))
    (tmp_path / "b.json").write_text(json.dumps(a))
    (tmp_path / "c.json").write_text(json.dumps([{"id": "R-0", "lang": "both", "known_misses": "k"}, {"id": "R-2", "lang": "zh"}, {"no": 1}]))
    rules = tables.read_rules(spark, str(tmp_path))
    one = rules.filter("id = 'R-1'").first()
    assert one.title == "T" and one.severity == 2 and one.detector.regex == "x+" and one.genre_strength == {"mail": "high"}
    cards = tables.rule_cards(rules)
    want = "### R-1 T\n\n**判据。** c\n\n**修法。** f\n\n**通过条件。** p\n\n- 正例：g\n- 反例：b 违反点：w"
    assert cards.filter("id = 'R-1'").first().card == want
    both = {r.lang: r.cards for r in tables.cards_for(cards, ["en", "zh"]).collect()}
    assert both["en"].endswith(want + "\n") and both["en"].startswith("### R-0") and "### R-2" in both["zh"] and "R-1" not in both["zh"]
    assert tables.cards_for(cards, ["en"], ["R-2", "R-0"]).first().cards.startswith("### R-2")


def test_results_and_exit_code(spark, tmp_path):
    cases = spark.createDataFrame([(1, "boilerplate", "a"), (2, "boilerplate", "b"), (3, None, "c")], "case_id int, class string, body string")
    out = spark.createDataFrame([(1, "a"), (2, "")], "case_id int, output string")
    checks = report.eval_checks(cases.filter("case_id < 3"), out, {})
    errors = spark.createDataFrame([(3, "the model is gone")], "case_id int, error string")
    results = tables.eval_results(cases, checks, errors)
    assert tables.write_results(results, str(tmp_path / "r")) == 1
    got = {p.stem: json.loads(p.read_text()) for p in (tmp_path / "r").iterdir()}
    assert [got[i]["status"] for i in "123"] == ["pass", "fail", "error"] and got["2"]["failed"] == ["delivered"] and got["3"]["error"] == "the model is gone"
    assert tables.write_results(results.filter("case_id = 1"), str(tmp_path / "r")) == 0 and [p.name for p in (tmp_path / "r").iterdir()] == ["1.json"]


def test_a_task_that_outlives_its_failed_job_leaves_nothing(spark, tmp_path):
    from pyspark.sql import Row

    writer = records._Writer({"path": str(tmp_path), "name": "id"}, False)
    rows = iter([Row(id=1), Row(id=2)])

    def late():
        yield next(rows)
        writer.abort([])
        yield next(rows)

    with pytest.raises(FileNotFoundError):
        writer.write(late())
    with pytest.raises(FileNotFoundError):
        writer.write(iter([Row(id=3)]))
    assert list(tmp_path.iterdir()) == []
