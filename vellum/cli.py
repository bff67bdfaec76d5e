"""python -m vellum.cli VERB ...: the verbs of the library over tables and files.

A host that calls a model itself goes prepare, prompt diagnose, prompt rewrite, apply, prompt judge,
finish, write-back; outputs are a table doc_id, step, round, raw.  `live` does all of it with a
model named as module:factory.  Exit codes: prepare 2 where a document is stopped, apply 1
where one fails, results 1 where a case doesn't pass.
"""

from __future__ import annotations

import argparse
import importlib
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import compose, report, segment
from vellum.plans import runner
from vellum.sources import tables


def _templates(folder: str | None) -> dict[str, str]:
    """Templates by step, from FOLDER/step.md; an absent one is empty."""
    read = lambda n: p.read_text(encoding="utf-8") if folder and (p := Path(folder) / f"{n}.md").exists() else ""
    return {n: read(n) for n in ("diagnose", "rewrite", "judge")}


def _examples(folder: str | None) -> dict[str, str]:
    """Examples by scope, from FOLDER/examples/rewrite-scope.md; an absent one is left out."""
    files = {"structural": "structural", "bounded": "bounded", "in-place": "inplace"}
    found = {s: Path(folder or "") / "examples" / f"rewrite-{n}.md" for s, n in files.items()}
    return {s: p.read_text(encoding="utf-8") for s, p in found.items() if folder and p.exists()}


def _cards(spark: SparkSession, folder: str | None) -> DataFrame | None:
    return tables.cards_for(tables.rule_cards(tables.read_rules(spark, folder)), ["zh", "en"]) if folder else None


def _parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="vellum")
    sub = ap.add_subparsers(dest="verb", required=True)

    def verb(name: str, about: str, *places: str, **options: dict) -> None:
        p = sub.add_parser(name, help=about)
        for x in places:
            p.add_argument(x)
        for x, how in options.items():
            p.add_argument(f"--{x}", **how)

    text = {"prompts": {}, "rules": {}}
    verb("prepare", "triage, gates, spans, sentences and items of a documents table", "documents", "out", json={"action": "store_true"})
    verb("prompt", "prompts of a step", "step", "prepared", "out", outputs={}, verified={}, **text)
    verb("apply", "rewrite outputs of a round, verified", "prepared", "outputs", "out", round={"type": int, "default": 1})
    verb("finish", "results and reports from verified rounds and judgements", "prepared", "verified", "outputs", "out")
    verb("run", "rewrite rounds replayed from an outputs table", "documents", "outputs", "out")
    verb("live", "rewrite rounds with a model, module:factory", "documents", "model", "folder", "out", waves={"type": int, "default": 8}, **text)
    verb("write-back", "texts of finished results", "results", "out")
    verb("cards", "rule cards from a folder of rules", "rules", "out")
    verb("results", "eval results of cases and their outputs", "cases", "outputs", "out")
    return ap


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("vellum").getOrCreate()
    read = spark.read.parquet
    save = lambda df: df.write.mode("overwrite").parquet(a.out)
    if a.verb == "prepare":
        d = runner.prepared(read(a.documents))
        if a.json:
            tables.write_prepared(d, a.out)
            return 0 if d.filter("stop_reason IS NOT NULL").isEmpty() else 2
        save(d)
        return 0 if read(a.out).filter("stop_reason IS NOT NULL").isEmpty() else 2
    if a.verb == "prompt":
        save(_prompts(spark, a))
    elif a.verb == "apply":
        o = read(a.outputs)
        rewrites = o.filter((F.col("step") == "rewrite") & (F.col("round") == a.round))
        save(runner.verified(read(a.prepared), runner.verdicts(o), rewrites))
        return 0 if read(a.out).filter("status = 'fail'").isEmpty() else 1
    elif a.verb == "finish":
        o = read(a.outputs)
        save(runner.settled(read(a.prepared), read(a.verified), runner.verdicts(o), o.filter("step = 'judge'")))
    elif a.verb == "run":
        save(runner.run(read(a.documents), read(a.outputs)))
    elif a.verb == "live":
        module, _, name = a.model.partition(":")
        factory = getattr(importlib.import_module(module), name)
        save(runner.Loop(read(a.documents), factory, a.folder, _templates(a.prompts), cards=_cards(spark, a.rules), examples=_examples(a.prompts), waves=a.waves).run())
    elif a.verb == "write-back":
        tables.write_back(read(a.results), a.out)
    elif a.verb == "cards":
        save(tables.rule_cards(tables.read_rules(spark, a.rules)))
    elif a.verb == "results":
        cases = tables.read_cases(spark, a.cases)
        return tables.write_results(tables.eval_results(cases, report.eval_checks(cases, read(a.outputs))), a.out)
    return 0


def _prompts(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    prep = spark.read.parquet(a.prepared).filter("stop_reason IS NULL")
    templates = _templates(a.prompts)
    if a.step == "diagnose":
        cards = _cards(spark, a.rules)
        numbered = prep.select("doc_id", segment.numbered_text(F.col("sentences")).alias("numbered"))
        return compose.diagnose_prompt(prep, numbered, cards if cards is not None else spark.createDataFrame([], "lang string, cards string"), templates["diagnose"])
    if a.step == "judge":
        v = spark.read.parquet(a.verified).filter("status <> 'fail'")
        blocks = v.select("doc_id", F.explode_outer("blocks").alias("b")).filter("b IS NOT NULL").select("doc_id", "b.*")
        return compose.judge_prompt(v.filter(F.size("blocks") > 0), blocks, templates["judge"])
    verdicts = runner.verdicts(spark.read.parquet(a.outputs))
    before = spark.read.parquet(a.verified).filter("status = 'fail'") if a.verified else None
    front = prep.filter("mode <> 'review'")
    if before is not None:
        front = front.join(before.select("doc_id"), "doc_id", "left_semi")
    return runner.rewrite_prompts(front, verdicts, before, "failures", templates["rewrite"], _examples(a.prompts))


if __name__ == "__main__":
    sys.exit(main())
