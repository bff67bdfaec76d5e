"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Source chunks are counted; the matrix of chunk-to-shard counts is drawn exactly (each row
a multivariate hypergeometric draw from the room that is left); rows are permuted within
their chunk and dealt to shards by the matrix; after the exchange each shard is permuted
again, in buckets of a random key, so that no task holds a whole shard.
DataFrame operations only; the driver sees counts of chunks, never rows.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vellum.llm import common

SHARDS = 40
#: Rows of a chunk, and of a bucket within a shard, that one sort should hold.
CHUNK_ROWS = 100_000
#: Bounds of the number of chunks: the matrix has chunks x shards counts.
LEAST_CHUNKS, MOST_CHUNKS = 16, 8192
SEED = 20_24


def draw(rng: random.Random, good: int, bad: int, n: int) -> int:
    """An exact hypergeometric draw: inversion outwards from the mode."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma
    choose = lambda a, b: lg(a + 1) - lg(b + 1) - lg(a - b + 1)
    p = math.exp(choose(good, mode) + choose(bad, n - mode) - choose(good + bad, n))
    u = rng.random()
    left, right, pl, pr = mode, mode, p, p
    u -= p
    while u > 0 and (left > low or right < high):
        if right < high:
            pr *= (good - right) * (n - right) / ((right + 1) * (bad - n + right + 1))
            right += 1
            u -= pr
            if u <= 0:
                return right
        if left > low:
            pl *= left * (bad - n + left) / ((good - left + 1) * (n - left + 1))
            left -= 1
            u -= pl
            if u <= 0:
                return left
    return mode


def matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Row by row the counts that each chunk sends to each shard; columns differ by one at most."""
    rng, total = random.Random(seed), sum(counts)
    room = [total // shards + (j < total % shards) for j in range(shards)]
    out = []
    for n in counts:
        row, left, rest = [], n, sum(room)
        for j in range(shards):
            k = draw(rng, room[j], rest - room[j], left)
            rest -= room[j]
            left -= k
            row.append(k)
        room = [a - b for a, b in zip(room, row, strict=True)]
        out.append(row)
    return out


def _key(seed: int, cols: list[Column]) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def shard(df: DataFrame, identity: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (gapless from 0 in its shard) to every row.

    identity names the columns that tell rows apart; rows equal in all of them are
    interchangeable and only their order among themselves is left open.  Nulls are values
    like any other.  An empty table gives no rows.  Input columns named shard or slot are
    replaced.
    """
    spark = df.sparkSession
    carried = [c for c in df.columns if c not in ("shard", "slot")]
    who = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in identity]
    keys = {"__c": _key(seed, who), "__a": _key(seed + 1, who), "__b": _key(seed + 2, who)}
    # the rows' own columns go under numbered names, so that none clashes
    base = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)], *[k.alias(n) for n, k in keys.items()])
    total = df.count()
    chunks = min(MOST_CHUNKS, max(LEAST_CHUNKS, -(-total // CHUNK_ROWS)))
    base = base.withColumn("__c", F.pmod("__c", F.lit(chunks)).cast("int"))
    # at most MOST_CHUNKS counts
    found = {r["__c"]: r["count"] for r in base.groupBy("__c").count().collect()}
    counts = [found.get(c, 0) for c in range(chunks)]
    ends = []
    for c, row in enumerate(matrix(counts, shards, seed)):
        at, edge = 0, []
        for k in row:
            at += k
            edge.append(at)
        ends.append((c, edge))
    plan = F.broadcast(spark.createDataFrame(ends, T.StructType([T.StructField("__c", T.IntegerType()), T.StructField("__ends", T.ArrayType(T.LongType()))])))  # MOST_CHUNKS x shards longs at most

    # first permutation: the rank within the chunk, and by it the shard
    first = base.withColumn("__r", F.row_number().over(Window.partitionBy("__c").orderBy("__a", "__b")) - 1)
    sent = first.join(plan, "__c").withColumn("shard", F.size(F.filter("__ends", lambda e: e <= F.col("__r"))).cast("int")).drop("__ends", "__r", "__a", "__c")
    # second permutation: by a random key, in buckets of its leading bits
    buckets = max(1, -(-total // (shards * CHUNK_ROWS)))
    sent = sent.withColumn("__k", F.pmod(F.xxhash64(F.lit(seed + 3), F.col("__b"), F.col("shard")), 1 << 40)).withColumn("__q", F.floor(F.col("__k") * buckets / (1 << 40)).cast("int"))
    rank = F.row_number().over(Window.partitionBy("shard", "__q").orderBy("__k", "__b")) - 1
    if buckets == 1:
        done = sent.withColumn("slot", rank.cast("long"))
    else:
        # shards x buckets counts: one for each CHUNK_ROWS rows
        sizes = sent.groupBy("shard", "__q").agg(F.count("*").alias("__n"))
        before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy("shard").orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
        done = sent.withColumn("__i", rank).join(before, ["shard", "__q"]).withColumn("slot", (F.col("__before") + F.col("__i")).cast("long"))
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)], "shard", "slot")


def sharded_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """key, size, text_crc32, law ('rows'), shard, slot, grown_shard (null): see shard()."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    narrow = docs.select(F.col(f"`{key}`").alias(key), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    out = shard(narrow, [key, "size", "text_crc32"], shards)
    return out.select(key, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
