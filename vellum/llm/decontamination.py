"""Benchmark decontamination: SimHash of item-sized windows, multi-index blocks, exact check.

1. A window of an item's length that is similar enough to it holds at least `threshold` of
   the item's shingles.  Shingles of the benchmark, joined with the lengths of the items that
   hold them, select document positions; windows of a length with fewer positions of that
   length are left out without loss.
2. Each remaining window, one item long (shorter at a text's end), gets a SimHash from the
   counts of its shingles.
3. Fingerprints are cut into BLOCKS blocks.  Two fingerprints within RADIUS bits agree in
   one block up to RADIUS // BLOCKS bits; the items' side lists all such block values, so
   the equi-join on blocks returns every pair within RADIUS.
4. The weighted Jaccard similarity (weights: counts of shingles) decides.

Shingles are compared by their 64-bit hashes.  DataFrame and SQL operations only.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm import common

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: A window of similarity 0.8 lies 10 bits away on average, and beyond 19 about once in 2,000.
BLOCKS, RADIUS = 4, 19
#: Window starts of a text that share one slice of its shingles.
STARTS = 64
#: Most rows of (key, hash) or (shingle) that are broadcast, 16 to 24 bytes each; beyond it
#: the same join is made by shuffle.
BROADCAST_ROWS = 200_000


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast only if it was counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _shingles(df: DataFrame, text: str, k: int) -> DataFrame:
    """Adds __n (words) and __h (hashes of the k-word shingles; of the whole if shorter)."""
    df = df.withColumn("__w", common.words_of(F.lower(F.coalesce(F.col(text), F.lit(""))))).withColumn("__n", F.size("__w"))
    at = F.when(F.col("__n") >= k, F.sequence(F.lit(0), F.col("__n") - k)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(at, lambda i: F.xxhash64(*[F.get("__w", i + j) for j in range(k)]))
    whole = F.when((F.col("__n") > 0) & (F.col("__n") < k), F.array(F.xxhash64(F.col("__w")))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("__h", F.concat(windows, whole)).drop("__w")


def _fingerprints(windows: DataFrame, by: list[str], hashes: str, longest: int) -> DataFrame:
    """One row for each `by`: fp, the majority bits over the shingles of the array."""
    lane = 8 if longest < 256 else 16 if longest < 32_000 else 32
    each = 64 // lane

    def spread(first: int, bits: int) -> Column:
        """The bits from `first` on, each at the foot of a lane of its own."""
        if bits > 4:  # more would overlap in the product
            return spread(first, 4).bitwiseOR(F.shiftleft(spread(first + 4, bits - 4), 4 * lane))
        product = F.shiftright("__x", first).bitwiseAND(F.lit((1 << bits) - 1)) * F.lit(sum(1 << ((lane - 1) * i) for i in range(bits)))
        return product.bitwiseAND(F.lit(sum(1 << (lane * i) for i in range(bits))).cast("long"))

    rows = windows.select(*by, F.explode_outer(hashes).alias("__x"))
    sums = [F.sum(spread(each * j, each)).alias(f"__s{j}") for j in range(64 // each)]
    got = rows.groupBy(*by).agg(F.count("*").alias("__c"), *sums)
    halves = []
    for b in range(64):
        j, i = divmod(b, each)
        count = F.shiftright(f"__s{j}", lane * i).bitwiseAND(F.lit((1 << lane) - 1))
        bit = F.when(count * 2 > F.col("__c"), F.lit(1)).otherwise(F.lit(0)).cast("long")
        halves.append(F.shiftleft(bit, b))
    fp = halves[0]
    for x in halves[1:]:
        fp = fp.bitwiseOR(x)
    return got.select(*by, fp.alias("fp"))


def _block(fp: Column, b: int) -> Column:
    width = 64 // BLOCKS
    return F.shiftright(fp, width * b).bitwiseAND(F.lit((1 << width) - 1))


def _item_blocks(items: DataFrame, radius: int) -> DataFrame:
    """Each item's block values and all values within radius // BLOCKS bits of them."""
    width = 64 // BLOCKS
    flips = [sum(1 << i for i in c) for r in range(radius // BLOCKS + 1) for c in itertools.combinations(range(width), r)]
    spark = items.sparkSession
    masks = F.broadcast(spark.createDataFrame([(b, m) for b in range(BLOCKS) for m in flips], "__b int, __m int"))  # a fixed table
    blocks = F.explode_outer(F.array(*[F.struct(F.lit(b).alias("b"), _block(F.col("fp"), b).alias("v")) for b in range(BLOCKS)])).alias("__k")
    cut = items.select("item", "fp", "__n", blocks).select("item", "fp", "__n", F.col("__k.b").alias("__b"), F.col("__k.v").alias("__v"))
    return cut.join(masks, "__b").select("item", F.col("__n").alias("__len"), F.col("fp").alias("item_fp"), "__b", F.col("__v").bitwiseXOR(F.col("__m").cast("long")).alias("__v"))


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """key, text_hash, item, similarity, start_word, n_words: the best window of each
    document for each item that it holds with at least the threshold's similarity.

    Texts are lowered and split into words at ASCII white space.  Null and empty texts and items
    match nothing; an empty table of either gives no rows.  Other columns play no part.  A very
    long text costs memory in proportion to its length.  A text or item shorter than a shingle is one shingle, so a short item
    is found only where it is the whole text.  Null keys are matched like others; repeated
    rows give one result.  Of equal similarities the first window counts, then the longer.
    """
    k = shingle
    d = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("__text"))
    b = _shingles(benchmark.select(F.col(f"`{item}`").alias("item"), F.col(f"`{item_text}`").alias("__text")), "__text", k).filter("__n > 0").drop("__text")
    items = common.stage(b, "items")
    longest = items.agg(F.max("__n")).first()[0] or 0

    # 1. positions whose shingle occurs in the benchmark, with the lengths of its items.  (An
    # inner explode would make Spark compute the shingles a second time, in a filter below.)
    known = items.select("__n", F.explode_outer("__h").alias("__x")).groupBy("__x").agg(F.collect_set("__n").alias("__lens"))
    tagged = d.withColumn("text_hash", F.xxhash64("__text"))
    rows = _shingles(tagged, "__text", k).select("key", "text_hash", "__n", F.posexplode_outer("__h").alias("__p", "__x"))
    met = rows.join(_small(known), "__x").select("key", "text_hash", "__n", "__p", F.explode_outer("__lens").alias("__len"))
    hit = met.groupBy("key", "text_hash", "__n", "__len").agg(F.sort_array(F.collect_set("__p")).alias("__ps"))
    need = F.ceil(F.lit(threshold) * F.greatest(F.col("__len") - (k - 1), F.lit(1)) - 1e-9).cast("int")
    hit = hit.withColumn("__need", need).filter(F.size("__ps") >= F.col("__need"))

    # windows: starts s with the need-th next position still inside, each start once
    p = lambda i: F.get("__ps", i)
    last = F.greatest(F.col("__len") - k, F.lit(0))
    runs = F.transform(
        F.sequence(F.lit(0), F.size("__ps") - F.col("__need")),
        lambda i: F.struct(F.greatest(p(i + F.col("__need") - 1) - last, F.when(i > 0, p(i - 1) + 1).otherwise(0)).alias("lo"), p(i).alias("hi")),
    )
    w = hit.select("key", "text_hash", "__len", F.explode_outer(F.filter(runs, lambda r: r["lo"] <= r["hi"])).alias("__r")).filter("__r IS NOT NULL")
    w = w.select("key", "text_hash", "__len", F.explode_outer(F.sequence("__r.lo", "__r.hi")).alias("start"))
    groups = w.groupBy("key", "text_hash", "__len", F.floor(F.col("start") / STARTS).cast("int").alias("__b")).agg(F.collect_list("start").alias("__s"))
    windows = common.stage(groups.groupBy("key", "text_hash").agg(F.collect_list(F.struct("__len", "__b", "__s")).alias("__ws")), "windows")

    # their shingles, from the texts that have some window: a slice for each group of starts
    wanted = windows.select(F.col("key").alias("__k"), F.col("text_hash").alias("__t"))
    some = tagged.join(_small(wanted), tagged["key"].eqNullSafe(F.col("__k")) & (tagged["text_hash"] == F.col("__t")), "left_semi").dropDuplicates(["key", "text_hash"])
    some = _shingles(some, "__text", k).drop("__text")
    own = windows.select(F.col("key").alias("__k"), F.col("text_hash").alias("__t"), "__ws")
    joined = some.join(own, some["key"].eqNullSafe(own["__k"]) & (some["text_hash"] == own["__t"])).drop("__k", "__t")
    slices = F.transform("__ws", lambda g: F.struct(g["__len"].alias("l"), g["__b"].alias("b"), g["__s"].alias("s"), F.slice("__h", g["__b"] * STARTS + 1, g["__len"] + STARTS).alias("h")))
    part = joined.select("key", "text_hash", "__n", F.explode_outer(slices).alias("__g")).select("key", "text_hash", "__n", F.col("__g.l").alias("__len"), F.col("__g.b").alias("__b"), F.col("__g.s").alias("__s"), F.col("__g.h").alias("__h"))
    part = common.stage(part, "windows")
    each = part.select("key", "text_hash", "__n", "__len", "__b", "__h", F.explode_outer("__s").alias("start"))
    each = each.withColumn("n_words", F.least(F.col("__len"), F.col("__n") - F.col("start")))
    sh = F.slice("__h", F.col("start") - F.col("__b") * STARTS + 1, F.greatest(F.col("n_words") - (k - 1), F.lit(1)))
    each = each.select("key", "text_hash", "start", "__len", "n_words", sh.alias("__sh"))

    # 2. and 3. fingerprints and blocks
    by = ["key", "text_hash", "start", "__len"]
    fps = _fingerprints(each, by, "__sh", longest)
    item_fps = _fingerprints(items, ["item"], "__h", longest)
    blocks = F.explode_outer(F.array(*[F.struct(F.lit(b).alias("b"), _block(F.col("fp"), b).alias("v")) for b in range(BLOCKS)])).alias("__k")
    cut = fps.select(*by, "fp", blocks).select(*by, "fp", F.col("__k.b").alias("__b"), F.col("__k.v").alias("__v"))
    sized = item_fps.join(items.select("item", "__n"), "item")
    near = cut.join(_item_blocks(sized, radius), ["__len", "__b", "__v"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    near = common.stage(near.select(*by, "item").distinct(), "candidates")

    # 4. exact similarity
    pair = near.join(each, [near["key"].eqNullSafe(each["key"]), *[near[c] == each[c] for c in by[1:]]]).select(*[near[c] for c in by], near["item"], "n_words", "__sh")
    pair = pair.join(items.select("item", F.col("__h").alias("__ih")), "item")
    plain = (F.size(F.array_distinct("__sh")) == F.size("__sh")) | (F.size(F.array_distinct("__ih")) == F.size("__ih"))
    weighted = F.aggregate(F.array_distinct("__ih"), F.lit(0), lambda a, x: a + F.least(F.size(F.filter("__ih", lambda y: y == x)), F.size(F.filter("__sh", lambda y: y == x))))
    common_weight = F.when(plain, F.size(F.array_intersect("__sh", "__ih"))).otherwise(weighted)
    pair = pair.withColumn("__i", common_weight).withColumn("similarity", F.col("__i") / (F.size("__sh") + F.size("__ih") - F.col("__i")))
    best = pair.filter(F.col("similarity") >= threshold).groupBy("key", "text_hash", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n_words")).alias("__m"))
    return best.select(F.col("key").alias(key), "text_hash", F.col("item").alias(item), F.col("__m.similarity").alias("similarity"), (-F.col("__m.s")).cast("long").alias("start_word"), F.col("__m.n_words").cast("long").alias("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns, whatever their names."""
    base = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col(f"`{key}`").alias("__key"), F.xxhash64(F.col(f"`{text}`")).alias("__hash"))
    narrow = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    found = common.stage(matches(narrow, benchmark, "key", "text", **options).select(F.col("key").alias("__k"), F.col("text_hash").alias("__t")).distinct(), "leaks")
    left = base.join(_small(found), F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__hash") == F.col("__t")), "left_anti")
    return left.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def oracle_sql() -> str:
    """Every window against every item that shares enough shingles, in DuckDB SQL."""
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+')"
    return f"""
WITH dw AS (SELECT doc_id, {words} AS w FROM documents), bw AS (SELECT item_id, {words} AS w FROM benchmark),
ds AS (SELECT doc_id, len(w) AS n, i - 1 AS p, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM dw WHERE len(w) > 0)),
bs AS (SELECT item_id, len(w) AS n, i - 1 AS p, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM bw WHERE len(w) > 0)),
bc AS (SELECT item_id, n, s, count(*) AS c, sum(count(*)) OVER (PARTITION BY item_id) AS m FROM bs GROUP BY item_id, n, s),
pair AS (SELECT doc_id, item_id, any_value(ds.n) AS n, any_value(bc.n) AS l, any_value(m) AS m FROM ds JOIN bc USING (s) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(m) - 1e-9),
win AS (SELECT doc_id, item_id, m, s0, least(l, n - s0) AS size FROM (SELECT *, unnest(range(0, greatest(n - 4, 1))) AS s0 FROM pair)),
wc AS (SELECT win.doc_id, win.item_id, s0, size, m, s, count(*) AS c FROM win JOIN ds ON ds.doc_id = win.doc_id AND ds.p >= s0 AND ds.p < s0 + greatest(size - 4, 1) GROUP BY win.doc_id, win.item_id, s0, size, m, s),
sim AS (SELECT wc.doc_id, wc.item_id, s0, size, any_value(wc.m) AS m, sum(wc.c) AS a, sum(CASE WHEN bc.c IS NULL THEN 0 ELSE least(wc.c, bc.c) END) AS i FROM wc LEFT JOIN bc ON bc.item_id = wc.item_id AND bc.s = wc.s GROUP BY wc.doc_id, wc.item_id, s0, size),
ok AS (SELECT doc_id, item_id, s0, size, i / (a + m - i) AS similarity FROM sim WHERE i / (a + m - i) >= 0.8)
SELECT doc_id, item_id, similarity, CAST(s0 AS BIGINT) AS start_word, CAST(size AS BIGINT) AS n_words FROM ok
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s0, size DESC) = 1"""
