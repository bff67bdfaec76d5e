"""Exact removal of byte strings that occur twice, by suffix arrays over shards.

Each window of `length` bytes is named by the smallest hash of its grams, so equal windows
have equal names wherever they are; neighbouring windows of one name form a region.
Regions whose name occurs once, and has no second gram in them, hold no repeat and go.
The others are grouped by name: equal regions collapse, and the different regions of a
name lie in one shard, whose suffix array and permuted common prefixes show which windows
start twice.  A name with more bytes than HOT_BYTES is dealt out by window instead, so
that no shard outgrows its task.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common
from vellum.llm.suffix_array import permuted_lcp, suffix_array

LENGTH = 400
#: Bytes of a hashed gram; a window has LENGTH - GRAM + 1 of them.
GRAM = 64
#: Window starts hashed at once, bytes of a shard's suffix array, bytes of one name in it.
PIECE, SHARD_BYTES, HOT_BYTES = 1 << 20, 2 << 20, 4 << 20
#: Most (key, hash) rows, 16 bytes each, that are broadcast after they were counted.
BROADCAST_ROWS = 200_000
_BASE = np.uint64(0xD6E8FEB86659FD93)


@functools.lru_cache(maxsize=1)
def _powers(n: int):
    one = np.array([1], np.uint64)
    up = np.cumprod(np.concatenate([one, np.full(n, _BASE)]))
    down = np.cumprod(np.concatenate([one, np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))]))
    return up, down


def regions(data: bytes, length: int = LENGTH, gram: int = GRAM):
    """(start, windows, name, twice) of the regions of one byte string, as arrays."""
    width, out = length - gram + 1, []
    for a in range(0, len(data) - length + 1, PIECE):
        t = np.frombuffer(data, np.uint8, min(PIECE + length - 1, len(data) - a), a)
        up, down = _powers(PIECE + length)
        total = np.concatenate([[np.uint64(0)], np.cumsum((t.astype(np.uint64) + np.uint64(1)) * up[: len(t)])])
        n = len(t) - gram + 1
        h = (total[gram:] - total[:n]) * down[:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
        # sliding minimum over `width` grams: minima of blocks from both sides
        pad = -n % width
        blocks = np.concatenate([h, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - width + 1
        m = np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts])
        first = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1])
        name = m[first]
        # names with a second gram
        low = h[h <= name.max()]
        low = np.sort(low)
        twice = np.isin(name, low[1:][low[1:] == low[:-1]])
        out.append((first + a, np.diff(np.append(first, starts)), name, twice))
    if not out:
        return [np.zeros(0, np.int64)] * 4
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def repeated_starts(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part a mask of its windows that also start elsewhere in these parts."""
    # symbols: 0 ends all, 1 ends a part, bytes follow
    joined = b"\xff".join(parts) + b"\xff"
    t = np.frombuffer(joined, np.uint8).astype(np.uint16) + np.uint16(2)
    size = np.array([len(p) for p in parts])
    ends = np.cumsum(size + 1) - 1
    t[ends] = 1
    t = np.append(t, np.uint16(0))
    sa = suffix_array(t, 258)
    phi, plcp = permuted_lcp(joined + b"\xfe", sa)
    marked = np.zeros(len(t), bool)
    long = np.flatnonzero(plcp >= length)
    marked[long] = True
    marked[phi[long]] = True
    return [marked[e - n : max(e - n, e - length + 1)] for e, n in zip(ends, size, strict=True)]


def _intervals(mask: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


def covered(starts: list, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by windows that start in the given intervals."""
    out: list[list[int]] = []
    for a, b in sorted(starts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b - 1 + length)
        else:
            out.append([a, b - 1 + length])
    return [tuple(x) for x in out]


def _batches(rows: list[tuple], schema: pa.Schema):
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _marks(docs: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """docs(key, tag, text) -> (rows in question with their text, start intervals of each)."""
    key_type = docs.schema["key"].dataType.simpleString()

    def name_regions(batches):
        for b in batches:
            keys, tags, cols = b.column(0), b.column(1), []
            for i, text in enumerate(b.column(2)):
                data = text.as_py().encode()
                if len(data) >= length:
                    s, n, name, twice = regions(data, length, gram)
                    cols.append((np.full(len(s), i), s, n, name.view(np.int64), twice))
            if cols:
                row, s, n, name, twice = (np.concatenate(c) for c in zip(*cols, strict=True))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), tags.take(pa.array(row)), pa.array(s), pa.array(n), pa.array(name), pa.array(twice)], ["key", "tag", "s", "n", "name", "twice"])

    named = common.stage(docs.filter(F.octet_length("text") >= length).mapInArrow(name_regions, f"key {key_type}, tag long, s long, n long, name long, twice boolean"), "regions")
    # tables of names are written before rows meet them, so that Spark can divide a name with many rows
    again = common.stage(named.groupBy("name").agg((F.count("*") + F.max(F.col("twice").cast("long"))).alias("c")).filter("c > 1").select("name"), "again")
    some = named.join(again, "name").groupBy("key", "tag").agg(F.collect_set(F.struct("s", "n", "name")).alias("rs"))
    some = common.stage(some, "regions").withColumnsRenamed({"key": "__k", "tag": "__t"})

    def same(a, b):
        return a["key"].eqNullSafe(b["__k"]) & (a["tag"] == b["__t"])

    keys = _small(some.select("__k", "__t"))
    asked = docs.join(keys, same(docs, keys), "left_semi")
    asked = common.stage(asked.join(some, same(asked, some)).drop("__k", "__t"), "asked")

    def digest(batches):
        import xxhash

        for b in batches:
            rows = []
            for k, t, text, rs in zip(*(b.column(c).to_pylist() for c in ("key", "tag", "text", "rs")), strict=True):
                data = text.encode()
                rows += [(k, t, r["s"], r["n"], r["name"], xxhash.xxh3_128_digest(data[r["s"] : r["s"] + r["n"] - 1 + length])) for r in rs]
            yield from _batches(rows, pa.schema([("key", b.schema.field("key").type), *[(c, pa.int64()) for c in ("tag", "s", "n", "name")], ("digest", pa.binary())]))

    member = common.stage(asked.select("key", "tag", "text", "rs").mapInArrow(digest, f"key {key_type}, tag long, s long, n long, name long, digest binary"), "members")
    group = common.stage(member.groupBy("name", "digest").agg(F.count("*").alias("c"), F.min(F.struct("key", "tag", "s", "n")).alias("r")), "groups")
    # names with different regions, or with a second gram, need their order
    several = group.groupBy("name").agg(F.count("*").alias("k"), F.sum(F.col("r.n") + (length - 1)).alias("size"))
    twice = named.filter("twice").select("name").distinct().withColumn("two", F.lit(True))
    several = common.stage(several.join(twice, "name", "left").filter("k > 1 OR two").select("name", (F.col("size") > HOT_BYTES).alias("hot")), "several")
    chosen = group.join(several, "name").groupBy(F.col("r.key").alias("__k"), F.col("r.tag").alias("__t")).agg(F.collect_list(F.struct(F.col("r.s").alias("s"), F.col("r.n").alias("n"), "name", "digest", "hot")).alias("rs"))
    text_of = asked.select("key", "tag", "text").dropDuplicates(["key", "tag"])
    chosen = text_of.join(chosen, same(text_of, chosen)).select("text", "rs")

    def cut(batches):
        for b in batches:
            rows = []
            for text, rs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = text.encode()
                rows += [(r["name"], r["digest"], r["hot"], data[r["s"] : r["s"] + r["n"] - 1 + length]) for r in rs]
            for i in range(0, len(rows), 4096):
                yield from _batches(rows[i : i + 4096], pa.schema([("name", pa.int64()), ("digest", pa.binary()), ("hot", pa.bool_()), ("data", pa.binary())]))

    part = common.stage(chosen.mapInArrow(cut, "name long, digest binary, hot boolean, data binary"), "parts")

    found = pa.schema([("name", pa.int64()), ("digest", pa.binary()), ("starts", pa.list_(pa.list_(pa.int64())))])

    def order(batches):
        held, size, last = [], 0, None

        def solve():
            masks = repeated_starts([x[2] for x in held], length)
            return [(x[0], x[1], iv) for x, m in zip(held, masks, strict=True) if (iv := _intervals(m))]

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in (0, 1, 2)), strict=True):
                if size >= SHARD_BYTES and row[0] != last:
                    yield from _batches(solve(), found)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[2]), row[0]
        if held:
            yield from _batches(solve(), found)

    cold = part.filter("NOT hot").select("name", "digest", "data").repartition(common.partitions(docs), "name").sortWithinPartitions("name")
    solved = cold.mapInArrow(order, "name long, digest binary, starts array<array<long>>")

    def windows(batches):
        import xxhash

        for b in batches:
            for name, d, data in zip(*(b.column(c).to_pylist() for c in (0, 1, 2)), strict=True):
                for i in range(0, len(data) - length + 1, 65536):
                    s = range(i, min(i + 65536, len(data) - length + 1))
                    yield from _batches([(name, d, k, xxhash.xxh3_128_digest(data[k : k + length])) for k in s], pa.schema([("name", pa.int64()), ("digest", pa.binary()), ("s", pa.int64()), ("w", pa.binary())]))

    window = part.filter("hot").select("name", "digest", "data").mapInArrow(windows, "name long, digest binary, s long, w binary")
    more = common.stage(window.groupBy("w").agg(F.count("*").alias("c")).filter("c > 1").select("w"), "more")
    dealt = window.join(more, "w").groupBy("name", "digest").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: F.array(s, s + 1)).alias("starts"))
    starts = solved.unionByName(dealt)

    # equal regions repeat wholly; the others where their shard says so
    whole = group.filter("c > 1").select("name", "digest")
    all_of = member.join(whole, ["name", "digest"], "left_semi").select("key", "tag", F.array(F.array("s", F.col("s") + F.col("n"))).alias("iv"))
    own = member.join(group.filter("c = 1").select("name", "digest"), ["name", "digest"], "left_semi").join(starts, ["name", "digest"])
    some_of = own.select("key", "tag", F.transform("starts", lambda x: F.array(x[0] + F.col("s"), x[1] + F.col("s"))).alias("iv"))
    marks = all_of.unionByName(some_of).groupBy("key", "tag").agg(F.flatten(F.collect_set("iv")).alias("iv"))
    return asked.drop("rs"), common.stage(marks, "marks")


def _prepared(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, tag, text first; the document's own columns follow under numbered names."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    others = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns) if c not in (key, text)]
    return docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(body).alias("tag"), body.alias("text"), *others, F.col(f"`{text}`").isNull().alias("__null"))


def _cut(batches, length: int, finish, schema_of):
    for b in batches:
        rows = []
        for row in b.to_pylist():
            data = row.pop("text").encode()
            runs = covered(row.pop("iv"), length)
            left, at = [], 0
            for a, e in runs:
                left.append(data[at:a])
                at = e
            left.append(data[at:])
            rows.append(finish(row, data, b"".join(left), runs))
        yield from _batches(rows, schema_of(b.schema))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 for each row.

    Texts are UTF-8 bytes, null counts as empty; texts shorter than `length` lose nothing.
    Equal rows are each other's copies and lose what is long enough.  Null keys are kept.
    An empty table gives no rows; other columns play no part.
    """
    common.ship(docs.sparkSession)
    base = _prepared(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), key, text)
    asked, marks = _marks(base.select("key", "tag", "text"), length, gram)
    kind = base.schema["key"].dataType.simpleString()
    rows = asked.dropDuplicates(["key", "tag"])
    m = marks.withColumnsRenamed({"key": "__k", "tag": "__t"})
    rows = rows.join(m, rows["key"].eqNullSafe(m["__k"]) & (rows["tag"] == m["__t"])).select("key", "tag", "text", "iv")

    def run(batches):
        return _cut(batches, length, lambda r, data, kept, runs: (r["key"], r["tag"], sum(e - a for a, e in runs), len(runs), hashlib.sha256(kept).hexdigest()), lambda s: pa.schema([("key", s.field("key").type), ("tag", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    cut = rows.mapInArrow(run, f"key {kind}, tag long, n_removed long, n_spans long, kept_sha256 string").withColumnsRenamed({"key": "__k", "tag": "__t"})
    plain = base.select("key", "tag", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("__sha"))
    out = plain.join(cut, plain["key"].eqNullSafe(cut["__k"]) & (plain["tag"] == cut["__t"]), "left")
    return out.select(F.col("key").alias(key), "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "__sha").alias("kept_sha256"))


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with every repeated string of `length` bytes taken out of the texts.

    Rows and columns stay; bytes of a character cut in two go with it.  Only texts with
    something to take out are rewritten.
    """
    common.ship(docs.sparkSession)
    base = _prepared(docs, key, text)
    _, marks = _marks(base.select("key", "tag", "text"), length, gram)
    m = marks.withColumnsRenamed({"key": "__k", "tag": "__t"})
    names = [c for c in base.columns if c != "text"]
    keys = _small(m.select("__k", "__t"))
    plain = base.join(keys, base["key"].eqNullSafe(keys["__k"]) & (base["tag"] == keys["__t"]), "left_anti")
    touched = base.join(keys, base["key"].eqNullSafe(keys["__k"]) & (base["tag"] == keys["__t"]), "left_semi")
    touched = touched.join(m, touched["key"].eqNullSafe(m["__k"]) & (touched["tag"] == m["__t"])).select(*names, "text", "iv")

    def run(batches):
        for b in batches:
            texts = []
            for t, iv in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                data, left, at = t.encode(), [], 0
                for a, e in covered(iv, length):
                    left.append(data[at:a].decode("utf-8", "ignore"))
                    at = e
                left.append(data[at:].decode("utf-8", "ignore"))
                texts.append("".join(left))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(texts, pa.string())], [*names, "text"])

    cut = touched.mapInArrow(run, touched.drop("iv").schema)
    both = plain.select(*names, "text").unionByName(cut)
    of = {c: F.col(f"__c{i}") for i, c in enumerate(docs.columns) if c not in (key, text)}
    of |= {key: F.col("key"), text: F.when(F.col("__null"), F.lit(None)).otherwise(F.col("text"))}
    return both.select(*[of[c].alias(c) for c in docs.columns])
