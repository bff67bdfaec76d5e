"""Links between texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

The complement of operator 2 in the pipeline: such texts mostly lie 4 to 11 fingerprint bits
apart, where no grid over 64 bits stays selective, so candidates come from min-wise samples
of the shingles instead.  Every candidate is verified exactly on whole shingle sets.

Equal texts collapse first.  A text has BANDS keys of ROWS minima each; a pair of similarity
0.8 shares no key once in 2,900.  Rounds of centres link most members of a key cheaply: a
centre that changes from round to round is compared with one member of each other component.
What is then left in a key, all pairs of members in different components, is compared
exactly, dealt out as pairs of bounded blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
#: Rounds of centres, before the rest is compared; a round without a new link ends them.
ROUNDS = 3
#: Members that one task compares with a copy of the centre's text, or with another block.
BLOCK = 512
#: Shingles of a block: few members where texts are long.
BLOCK_SHINGLES = 4_000_000
_ODD = np.random.default_rng(7).integers(1 << 62, size=(BANDS * ROWS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(8).integers(1 << 62, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; one of all words where they are fewer."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(shingle, len(h))
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = (out ^ h[i : i + n]) * _MIX[i]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The BANDS keys of a shingle set."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(shingles), 1 << 14):  # stays in the processor's cache
        part = shingles[i : i + (1 << 14)]
        for k, (a, b) in enumerate(_ODD):
            least[k] = min(least[k], ((part ^ b) * a).min())
    keys = np.arange(BANDS, dtype=np.uint64)
    for i, column in enumerate(least.reshape(BANDS, ROWS).T):
        keys = (keys ^ column) * _MIX[i]
        keys ^= keys >> np.uint64(31)
    return keys


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Jaccard similarity of two sorted sets at least the threshold."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    common_n = len(np.intersect1d(a, b, assume_unique=True))
    return common_n >= similarity * (len(a) + len(b) - common_n)


def _sketches(base: DataFrame, shingle: int) -> DataFrame:
    """(key, copy, size, bands): copy is a hash of the whole text, size its number of shingles;
    texts without words have no row."""

    def run(batches):
        import xxhash

        for b in batches:
            keys, copies, sizes, bands = [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                s = shingle_set(text, shingle)
                if len(s):
                    keys.append(key)
                    copies.append(xxhash.xxh3_128_digest(text.encode("utf-8")))
                    sizes.append(len(s))
                    bands.append(band_keys(s).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(copies, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["key", "copy", "size", "bands"])

    return base.mapInArrow(run, "key long, copy binary, size long, bands array<long>")


def _verified(base: DataFrame, pairs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar; a's members are dealt out in blocks."""
    count = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    sized = pairs.join(count, "a").withColumn("block", F.pmod(F.xxhash64("b"), "blocks"))
    few = pairs.count() <= common.BROADCAST_ROWS  # then texts stay where they are
    count, sized = (F.broadcast(count), F.broadcast(sized)) if few else (count, sized)
    centre = base.join(count, base.key == count.a).select("a", F.explode_outer(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("b"), "text")
    member = base.join(sized, base.key == sized.b).select("a", "block", "b", "text")
    dealt = centre.unionByName(member).repartition(common.partitions(base), "a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())

    def run(batches):
        held, at = {}, None
        for batch in batches:
            out = []
            for a, block, b, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                if at != (a, block):
                    held, at = {}, (a, block)
                s = shingle_set(text.as_py(), shingle)
                if b is None:
                    held[s.tobytes()] = s
                elif any(similar(h, s, similarity) for h in held.values()):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def similar_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, labels: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (i, j) that join all labels of which a member in left is similar to one in right."""
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    cut = np.cumsum(size) - size
    if len(right) < len(left):
        left, right = right, left
    across = np.concatenate([ids[cut[j] : cut[j] + size[j]] for j in right])
    starts = np.cumsum(size[right]) - size[right]
    held = np.zeros(int(ids.max()) + 1, bool)
    labels, out = labels.copy(), []
    for i in left:
        apart = (labels[right] != labels[i]) & (np.minimum(size[right], size[i]) >= similarity * np.maximum(size[right], size[i]))
        if not apart.any():
            continue
        own = ids[cut[i] : cut[i] + size[i]]
        held[own] = True
        both = np.add.reduceat(held[across], starts, dtype=np.int64)
        held[own] = False
        near = right[apart & (both >= similarity * (size[right] + size[i] - both))]
        if len(near):
            other, first = np.unique(labels[near], return_index=True)
            out += [(int(i), int(j)) for j in near[first]]
            labels[np.isin(labels, other)] = labels[i]
    return out


def _rest(base: DataFrame, at: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The links (a, b) among all members of a bucket that lie in different components.

    at: bucket, key, size, root.  Two members alone have met in the first round of centres.
    Large buckets that share members become one group, and buckets of equal members one.  A
    group's largest component meets the other members only, not itself.
    """
    from vellum.llm.simhash_dedup import components

    spark = base.sparkSession
    facts = at.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("key").alias("least"), F.sum(F.xxhash64("key").cast("decimal(20,0)")).alias("mark"))
    facts = common.stage(facts.filter("n > 2 and r0 <> r1"), "rest")
    many = facts.filter(F.col("n") > BLOCK)
    small = at.join(facts.filter(F.col("n") <= BLOCK).groupBy("n", "mark").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "bucket")
    if many.take(1):
        joined = common.stage(components(at.join(many.select("bucket", "least"), "bucket").select(F.col("least").alias("a"), F.col("key").alias("b"))), "components")
        grouped = small.select("bucket", "key", "n").join(joined.select("node", F.col("root").alias("g")), F.col("key") == F.col("node"))
        inside = grouped.groupBy("bucket", "n").agg(F.count("*").alias("m"), F.min("g").alias("g0"), F.max("g").alias("g1")).filter("m = n and g0 = g1").select("bucket")
        small = small.join(inside, "bucket", "left_anti")
        large = at.select("key", "size", "root").dropDuplicates(["key"]).join(joined.select(F.col("node").alias("key"), F.col("root").alias("group")), "key").withColumn("large", F.lit(True))
    else:
        large = spark.createDataFrame([], "key long, size long, root long, group long, large boolean")
    member = small.select("key", "size", "root", F.col("bucket").alias("group"), F.lit(False).alias("large")).unionByName(large.select("key", "size", "root", "group", "large"))
    member = common.stage(member, "members")
    per_root = member.groupBy("group", "large", "root").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    blocks = lambda n, s: F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    of = per_root.groupBy("group", "large").agg(F.max(F.struct("n", "s", "root")).alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    of = of.filter(F.col("n") > F.col("main.n")).select("group", "large", F.col("main.root").alias("main"), blocks(F.col("main.n"), F.col("main.s")).alias("main_blocks"), blocks(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("other_blocks"))
    j = member.join(of, ["group", "large"])
    is_main = F.col("root") == F.col("main")
    h = F.xxhash64("key", F.lit("block"))
    j = j.withColumn("own", F.when(is_main, F.col("other_blocks") + F.pmod(h, "main_blocks").cast("int")).otherwise(F.pmod(h, "other_blocks").cast("int")))
    meets = F.sequence(F.lit(0), F.when(is_main, F.col("other_blocks") - 1).otherwise(F.col("other_blocks") + F.col("main_blocks") - 1))
    j = j.select("group", "large", "key", "root", "own", F.explode_outer(meets).alias("o")).select("group", "large", "key", "root", "own", F.least("own", "o").alias("x"), F.greatest("own", "o").alias("y"))
    j = common.stage(j, "dealt")
    dealt = base.withColumnRenamed("key", "k").join(common.small(j), F.col("k") == F.col("key")).select("group", "large", "x", "y", "key", "root", "own", "text")
    dealt = dealt.repartition(common.partitions(base), "group", "large", "x", "y").sortWithinPartitions("group", "large", "x", "y")

    def solve(at, rows):
        sets = [r[3] for r in rows]
        own = np.array([r[2] for r in rows])
        left, right = np.flatnonzero(own == at[2]), np.flatnonzero(own == at[3])
        if not len(left) or not len(right):
            return []
        found = similar_pairs(sets, left, right, np.array([r[1] for r in rows], np.int64), similarity)
        return [(rows[i][0], rows[j][0]) for i, j in found]

    def run(batches):
        now, rows = None, []
        for batch in batches:
            out = []
            for *here, key, root, own, text in zip(*(c.to_pylist() for c in batch.columns[:7]), batch.column(7), strict=True):
                if here != now:
                    out += solve(now, rows) if rows else []
                    now, rows = here, []
                s = shingle_set(text.as_py(), shingle)
                if len(s):
                    rows.append((key, root, own, s))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
        if rows:
            out = solve(now, rows)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return common.stage(dealt.mapInArrow(run, "a long, b long"), "verified")


def links(docs: DataFrame, known: DataFrame | None = None, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(a, b): pairs of keys that connect all texts found similar, and all equal texts.

    known holds (key, component_id) of links found before; pairs they connect are not
    compared again.  Rows of one key are one document, linked by any of its texts; null keys and
    texts without words have no links.  An empty table gives no links.
    """
    from vellum.llm.simhash_dedup import components

    common.ship(docs.sparkSession)
    base = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")).filter("key is not null")
    sketches = common.stage(_sketches(base, shingle), "sketches")
    copies = sketches.groupBy("copy").agg(F.min("key").alias("key"))
    equal = sketches.join(copies.withColumnRenamed("key", "a"), "copy").filter("key <> a").select("a", F.col("key").alias("b"))
    distinct = sketches.join(copies.select("key"), "key", "left_semi")
    bucket = distinct.select("key", "size", F.explode_outer("bands").alias("bucket"))
    shared = bucket.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    bucket = common.stage(bucket.join(shared.hint("shuffle_hash"), "bucket"), "buckets")
    found = common.stage(equal, "links")
    if known is not None:
        found = found.unionByName(known.select(F.col("component_id").alias("a"), F.col("key").alias("b")).filter("a <> b"))
    tested = None

    def placed():
        comp = common.stage(components(found), "components")
        return bucket.join(comp, bucket.key == comp.node, "left").select("bucket", "key", "size", F.coalesce("root", "key").alias("root"))

    for turn in range(ROUNDS):
        at = placed()
        order = F.xxhash64("key", F.lit(turn)) if turn else F.col("key")
        one = at.groupBy("bucket", "root").agg(F.min_by("key", order).alias("key"))
        centre = one.groupBy("bucket").agg(F.min_by("key", order).alias("a"), F.count("*").alias("n")).filter("n > 1").select("bucket", "a")
        pairs = one.join(centre, "bucket").filter("key <> a").select(F.least("a", "key").alias("x"), F.greatest("a", "key").alias("y"), "a", F.col("key").alias("b")).dropDuplicates(["x", "y"])
        if tested is not None:
            pairs = pairs.join(tested, ["x", "y"], "left_anti")
        pairs = common.stage(pairs, "pairs")
        new = common.stage(_verified(base, pairs.select("a", "b"), similarity, shingle), "verified")
        if not new.take(1):
            return found.unionByName(_rest(base, at, similarity, shingle))
        found = found.unionByName(new)
        tested = pairs.select("x", "y") if tested is None else tested.unionByName(pairs.select("x", "y"))
    return found.unionByName(_rest(base, placed(), similarity, shingle))
