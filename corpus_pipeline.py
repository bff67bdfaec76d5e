"""Corpus pipeline: quality rules, near-dedup, repeated strings, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of docs.  A stage's result is meant to be written before the next stage runs: a
stage deletes the scratch tables of the stage before it.

A document whose text becomes empty stays as a row; null texts fail the quality rules.
Empty tables pass through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import common, decontamination, packing, quality_rules, simhash_dedup, suffix_dedup

#: Repeated strings from this length on go: 50 words of four letters and a space.
PASSAGE_BYTES = 250
#: Scratch tables of the stage that ran last when stages are called one by one.
_last: list[common.Scratch] = []


def _scratch(spark: SparkSession) -> common.Scratch:
    """A stage's own scratch tables; those of the stage before it, whose result is written, go."""
    while _last:
        _last.pop().release()
    _last.append(common.Scratch(spark))
    return _last[-1]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base limits and the robust outlier test keep."""
    common.ship(spark)
    _last.clear()  # another run's last stage may still be unread
    with _scratch(spark):
        return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies."""
    with _scratch(spark):
        return simhash_dedup.one_of_each_group(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that occur twice in the corpus."""
    with _scratch(spark):
        return suffix_dedup.remove(docs, length=PASSAGE_BYTES)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    with _scratch(spark):
        return decontamination.clean(docs, common.read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of 2048."""
    with _scratch(spark):
        return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeated_strings),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Fingerprints, suffix arrays and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again.

    A stage's table goes once the next one is written; the last one's input stays, as its
    result reads it.
    """
    docs, before = common.read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        path = f"{common.shared_dir(spark)}/vellum-stage-{name}-{uuid.uuid4().hex}"
        made.write.mode("overwrite").parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            common.delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
