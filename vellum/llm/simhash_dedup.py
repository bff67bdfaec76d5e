"""SimHash near-duplicates: segment popcounts, grid range-join, exact verification.

Every text gets a 64-bit fingerprint; equal fingerprints collapse first.  A half of a
fingerprint is embedded as bit counts of segments in two cuts of its 32-bit ring: sixteen
segments of two bits, and eight of four bits that begin one bit later.  The Manhattan distance
of two such vectors, within either cut, never exceeds the Hamming distance, and is below it
where bits of a segment differ in opposite ways.  Links within RADIUS differ in one half by
RADIUS // 2 = 1 bit at most: the range-join looks in a half's own grid cell and in those at
distance 1 in both cuts (halves of odd bit count reach out to the even ones, so one side does
all the reaching, to 36 cells on average).  Different halves share a cell, two random ones
once in 175 million (measured; the first cut alone: once in 6.5 million, and its strangers
outgrew the check), and exact comparison sorts such strangers out.
Members of a cell are compared exactly; a cell gives a spanning forest of its links, never
all pairs, and cells of many members are dealt out as pairs of bounded blocks.
Components come from alternating large-star and small-star steps over the forest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
#: Members of a cell that one group compares; larger cells are dealt out as block pairs.
BLOCK = 2048


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """The majority bits of the XXH64 of all shingles; 0 without words."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    h64, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle:
        hashes = [h64(join(words), SEED)]
    else:
        hashes = [h64(join(s), SEED) for s in zip(*[words[i:] for i in range(shingle)])]
    total = np.zeros(64, np.int64)
    array = np.array(hashes, "<u8")
    for i in range(0, len(array), 1 << 16):  # bounded memory for very long texts
        bits = np.unpackbits(array[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(array), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE_WORDS, name: str = "fp") -> DataFrame:
    """All columns but the text, and the fingerprint as a signed long."""
    common.ship(docs.sparkSession)
    carried = [c for c in docs.columns if c not in (text, name)]

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(b.num_columns - 1)], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], [*carried, name])

    base = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text}`").alias("__text"))
    return base.mapInArrow(run, base.drop("__text").withColumn(name, F.lit(0).cast("long")).schema)


_PAIRS, _FOURS = np.uint64(0x55555555), np.uint64(0x33333333)


def _counted(words: np.ndarray) -> np.ndarray:
    """Bit counts (0, 1, 2) of the 16 two-bit segments of 32-bit words, two bits a count."""
    return words - ((words >> np.uint64(1)) & _PAIRS)


def embedded(halves: np.ndarray) -> np.ndarray:
    """The counts of the two-bit segments of each half and, from bit 32 on, four bits a count,
    of the four-bit segments that begin one bit later."""
    turned = _counted((halves >> np.uint64(1)) | (halves << np.uint64(31)) & np.uint64(0xFFFFFFFF))
    return _counted(halves) | ((turned & _FOURS) + ((turned >> np.uint64(2)) & _FOURS)) << np.uint64(32)


def neighbours(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells at distance 1 in both cuts that one bit may lead to, and the row of each."""
    found, rows = [], []
    for i in range(16):
        small, own = np.uint64(2 * i), (counts >> np.uint64(2 * i)) & np.uint64(3)
        for j in sorted({(2 * i - 1) % 32 // 4, i // 2}):  # where the segment's bits lie in the other cut
            wide, other = np.uint64(32 + 4 * j), (counts >> np.uint64(32 + 4 * j)) & np.uint64(15)
            step = (np.uint64(1) << small) + (np.uint64(1) << wide)
            for at, d in ((np.flatnonzero((own < 2) & (other < 4)), step), (np.flatnonzero((own > 0) & (other > 0)), np.uint64(0) - step)):
                found.append(counts[at] + d)
                rows.append(at)
    return np.concatenate(found), np.concatenate(rows)


def cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid keys of the fingerprints (own cells, and reached ones) and, for each, the row.

    A key is the cell's coordinates, mixed with the half's place; keys that meet by chance
    only add comparisons.
    """
    keys, rows = [], []
    index = np.arange(len(fps))
    for half in (0, 1):
        v = (fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        own = embedded(v)
        odd = np.flatnonzero(np.bitwise_count(v) % 2)
        reached, of = neighbours(own[odd])
        for part, at in ((own, index), (reached, odd[of])):
            k = (part ^ part >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(half)
            keys.append(k.view(np.int64))
            rows.append(at)
    return np.concatenate(keys), np.concatenate(rows)


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints of one group."""
    edges = []
    rest = np.arange(len(fps))
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = np.bitwise_count(fps[rest] ^ fps[at]) <= radius
            if near.any():
                found = rest[near]
                edges += [(at, f) for f in found]
                frontier += list(found)
                rest = rest[~near]
    return edges


def _links_in_cells(radius: int):
    """Batches of (key, fp) sorted by key -> links as (a, b)."""

    def solve(keys: np.ndarray, fps: np.ndarray):
        out = []
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(cut, len(keys)))
        pairs = cut[size == 2]  # most groups are pairs of strangers: all at once
        near = pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= radius]
        if len(near):
            out.append(np.stack([fps[near], fps[near + 1]], axis=1))
        for i, n in zip(cut[size > 2], size[size > 2], strict=True):
            got = np.unique(fps[i : i + n])
            if len(got) > 1 and (e := _forest(got, radius)):
                e = np.array(e)
                out.append(np.stack([got[e[:, 0]], got[e[:, 1]]], axis=1))
        return np.concatenate(out) if out else np.zeros((0, 2), np.uint64)

    def batch(links: np.ndarray):
        links = links[links[:, 0] != links[:, 1]]
        a, b = links.view(np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches):
        keys, fps = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
        for b in batches:
            k = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)
            keys, fps = np.concatenate([keys, k]), np.concatenate([fps, b.column(2).to_numpy().view(np.uint64)])
            # keep the last, perhaps unfinished, group
            same = np.flatnonzero((keys != keys[-1]).any(axis=1))
            cut = same[-1] + 1 if len(same) else 0
            if cut:
                ident = np.cumsum(np.concatenate([[0], (keys[1:cut] != keys[: cut - 1]).any(axis=1)]))
                yield batch(solve(ident, fps[:cut]))
                keys, fps = keys[cut:], fps[cut:]
        if len(fps):
            yield batch(solve(np.zeros(len(fps), np.int64), fps))

    return run


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (column fp) -> links (a, b) that span every component.

    radius // 2 must be at most 1, the reach of the grid.
    """
    if radius // 2 > 1:
        raise ValueError("the grid reaches one cell in each half: radius 3 at most")

    def grid(batches):
        for b in batches:
            v = b.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(v), 1 << 14):
                part = v[i : i + (1 << 14)]
                k, r = cells(part)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(part[r].view(np.int64))], ["key", "fp"])

    cell = fps.select("fp").mapInArrow(grid, "key long, fp long")
    # Counts by key, summed on the map side; only keys of several members go on.
    sized = common.stage(cell.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "cells")
    member = cell.join(sized.hint("shuffle_hash"), "key")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    pair = F.when(F.col("n") <= block, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: (F.least(o, F.col("own")).cast("long") * (1 << 31) + F.greatest(o, F.col("own"))))
    )
    dealt = member.withColumn("own", own).select("key", F.explode_outer(pair).alias("pair"), "fp")
    dealt = dealt.repartition(common.partitions(fps), "key", "pair").sortWithinPartitions("key", "pair")
    return dealt.mapInArrow(_links_in_cells(radius), "a long, b long").distinct()


#: Links, 16 bytes each, that one task joins by itself.
TASK_LINKS = 500_000


def _joined(batches):
    """All links -> (node, root), root the smallest node reachable."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    if not parts:
        return
    nodes, place = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    u, v = place.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], least)
        np.minimum.at(new, root[v], least)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    for i in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)]), pa.array(nodes[root[i : i + (1 << 16)]])], ["node", "root"])


def components(edges: DataFrame, most_rounds: int = 64, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, root) for every node of the links (a, b), root the smallest node reachable.

    Links counted to be few are joined by one task.  More go through alternating large-star
    and small-star steps; each round is written to the shared folder, and the rounds end when
    a round changes no link.
    """
    now = common.stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    if now.count() <= task_links:
        return now.coalesce(1).mapInArrow(_joined, "node long, root long")
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        now = common.stage(small, "links")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    return now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id (smallest key reachable) for each row.

    Null and empty texts have fingerprint zero and link like any other.  Null keys are
    smaller than none: a component of null keys alone has component_id null.  Repeated rows
    are kept.  An empty table gives no rows; other columns play no part.
    """
    base = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    marked = common.stage(with_fingerprints(base, shingle=shingle), "fingerprints")
    unique = common.stage(marked.groupBy("fp").agg(F.min("key").alias("least")), "unique")
    comp = common.stage(components(links(unique, radius)), "components")
    # fingerprints without a link are their own root
    rooted = unique.join(comp, unique.fp == comp.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    top = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.select("fp", "root").join(top, "root").select("fp", "component_id")
    out = marked.join(by_fp, "fp")
    return out.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS, radius: int = RADIUS, similarity: float | None = 0.8) -> DataFrame:
    """The rows of docs that stay when each group keeps the document of its smallest key.

    Documents are one group when fingerprints link them or, unless similarity is None, when
    five-word shingle sets of that Jaccard similarity do (shingle_links says how those are
    found).  Keys are integers.  Of rows that share that key one stays.  Rows with a null key
    stay only where their group has no other key.  Null and empty texts are one group.  All
    columns stay, whatever their names.  An empty table gives no rows.
    """
    from vellum.llm import shingle_links

    narrow = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    near = near_duplicates(narrow, "key", "text", shingle, radius).select(F.col("key").alias("__key"), "component_id")
    if similarity is not None:
        known = common.stage(near.dropDuplicates().select(F.col("__key").alias("key"), "component_id"), "known").filter("key is not null")
        comp = common.stage(components(shingle_links.links(narrow, known, "key", "text", similarity)), "components")
        near = near.join(comp, near["component_id"] == comp["node"], "left").select("__key", F.coalesce("root", "component_id").alias("component_id"))
    near = near.filter(F.col("__key").eqNullSafe(F.col("component_id")))
    near = near.dropDuplicates(["__key"]).select("__key")
    # the rows' own columns follow under numbered names, so that none clashes
    base = docs.select(F.col(f"`{key}`").alias("__own"), *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)])
    one = base.join(near, F.col("__own").eqNullSafe(F.col("__key")), "left_semi")
    repeated = narrow.groupBy(F.col("key").alias("__k")).count().filter("count > 1").select("__k")
    plain = one.join(repeated, F.col("__own").eqNullSafe(F.col("__k")), "left_anti")
    again = one.join(repeated, F.col("__own").eqNullSafe(F.col("__k")), "left_semi").dropDuplicates(["__own"])
    return plain.unionByName(again).select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])
