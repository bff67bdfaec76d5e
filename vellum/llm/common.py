"""Shared helpers of the llm operators: table reading, scratch tables, text rules."""

from __future__ import annotations

import atexit
import contextvars
import os
import re
import sys
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: ASCII white space that separates words: space, tab, LF, VT, FF, CR.
WORD_SEP = r"[\x20\x09-\x0D]+"
#: Bytes of an Arrow batch of texts that a Python worker takes at once (one row at least).
BATCH_BYTES = 8_000_000
#: A-Z are lowered, every other character is left alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_dir: str | None = None


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from the driver's checkout as well, and take
    texts in batches of BATCH_BYTES at most, unless the session sets its own bound."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound) == "67108864b":  # Spark's default
        spark.conf.set(bound, str(BATCH_BYTES))
    if ROOT not in sys.path:
        sys.path.insert(0, ROOT)
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  Only a local master, whose one process has one disk,
    may do without a named one."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="vellum-")
        atexit.register(lambda d=_own_dir[7:]: __import__("shutil").rmtree(d, ignore_errors=True))
    return _own_dir


class Scratch:
    """Collects the scratch tables made inside its `with` block; release() deletes them.

    Tables made outside of any block stay, as a lazy result may still read them.
    """

    _now: contextvars.ContextVar[Scratch | None] = contextvars.ContextVar("scratch", default=None)

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        self._token = self._now.set(self)
        return self

    def __exit__(self, *_) -> None:
        self._now.reset(self._token)

    def release(self) -> None:
        """Delete the tables.  Only once nothing reads them any more."""
        while self.paths:
            delete(self.spark, self.paths.pop())


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/vellum-{label}-{uuid.uuid4().hex}"
    if (now := Scratch._now.get()) is not None:
        now.paths.append(path)
    return path


def stage(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage: write to the shared folder once, read back with the same schema."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most rows of a few numbers each that small() broadcasts.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, broadcast only if it was counted to be small; else Spark joins by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SEP), "")


def partitions(df: DataFrame, least: int = 1) -> int:
    """Partitions for an exchange that AQE doesn't size: the session's own setting."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
