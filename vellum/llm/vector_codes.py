"""Vector code compression: product codes by integer rounds of nearest entries.

A vector's components become integers and are cut into PARTS equal parts, each with a codebook
of its own.  Every round the driver builds one kd-tree per codebook and broadcasts them; tasks
find each part's nearest entry by branch and bound and add up the parts of every entry in
integers.  A branch is left only when its box is farther than the best entry so far: boxes
at the same distance are visited, since a tie goes to the lower index and that may lie there.
The sums of all tasks meet in one row for each part, entry and component; the driver takes no
more than a codebook.  A round is a pure function of the table and the codebooks, so a task
that is lost is run again with the same result.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common

PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: A component x becomes floor(SCALE * x).
SCALE = 4096
#: Entries in a leaf of a kd-tree, and vectors searched at once.
LEAF, SLICE = 2, 1 << 14


class Node(NamedTuple):
    low: np.ndarray
    high: np.ndarray
    entries: tuple[int, ...]  # of a leaf, ascending
    axis: int = -1
    cut: int = 0
    left: Node | None = None
    right: Node | None = None


def tree(book: np.ndarray, of: np.ndarray | None = None) -> Node:
    """The kd-tree over the rows of a codebook: halves at the middle of the widest axis."""
    of = np.arange(len(book)) if of is None else of
    low, high = book[of].min(axis=0), book[of].max(axis=0)
    if len(of) <= LEAF or not book.shape[1] or (low == high).all():
        return Node(low, high, tuple(int(i) for i in np.sort(of)))
    axis = int(np.argmax(high - low))
    order = of[np.argsort(book[of, axis], kind="stable")]
    cut = book[order[(len(order) - 1) // 2], axis]
    at = int(np.searchsorted(book[order, axis], cut, side="right"))
    if at == len(order):  # the upper half is all alike: cut below it
        at = int(np.searchsorted(book[order, axis], cut, side="left"))
        cut = book[order[at - 1], axis]
    return Node(low, high, (), axis, int(cut), tree(book, order[:at]), tree(book, order[at:]))


def nearest(points: np.ndarray, book: np.ndarray, root: Node) -> tuple[np.ndarray, np.ndarray]:
    """For each row of points the nearest entry, the lowest index of equals, and its squared distance."""
    best = np.full(len(points), np.iinfo(np.int64).max)
    at = np.zeros(len(points), np.int64)

    def visit(node: Node, rows: np.ndarray) -> None:
        x = points[rows]
        away = np.maximum(np.maximum(node.low - x, x - node.high), 0)
        near = np.einsum("ij,ij->i", away, away) <= best[rows]  # an equal bound may hold a lower index
        rows, x = rows[near], x[near]
        if not len(rows):
            return
        for i in node.entries:
            d = x - book[i]
            d = np.einsum("ij,ij->i", d, d)
            better = (d < best[rows]) | ((d == best[rows]) & (i < at[rows]))
            best[rows[better]], at[rows[better]] = d[better], i
        if node.left is not None:
            below = x[:, node.axis] <= node.cut
            for child, own in ((node.left, below), (node.right, ~below), (node.right, below), (node.left, ~below)):
                if own.any():
                    visit(child, rows[own])

    if len(points):
        visit(root, np.arange(len(points)))
    return at, best


def kept_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, label and the integer components q of every vector that counts.

    Left out are null vectors and those with null or non-finite components.  A vector so large
    that its error might not fit a long (32,768 in a component at 64 components) counts
    as non-finite.
    """
    v = F.col("v")
    bits = F.floor((62 - F.ceil(F.log2(F.greatest(F.size(v), F.lit(1))))) / 2) - 1
    bound = F.pow(F.lit(2.0), bits) / SCALE
    base = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v")).withColumn("bound", bound)
    fine = base.filter(v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x) <= F.col("bound"), F.lit(False))))
    return fine.select("key", "label", F.transform(v, lambda x: F.floor(x * SCALE).cast("int")).alias("q"))


def _matrix(batch: pa.RecordBatch, column: int, parts: int) -> np.ndarray:
    """(part, vector, component) of a batch; a length that the parts don't divide is filled up with zeros."""
    flat = batch.column(column).flatten().to_numpy().astype(np.int64)
    x = flat.reshape(batch.num_rows, -1)
    width = -(-x.shape[1] // parts)
    x = np.pad(x, ((0, 0), (0, width * parts - x.shape[1])))
    return np.ascontiguousarray(x.reshape(len(x), parts, width).transpose(1, 0, 2))


def _searched(batch: pa.RecordBatch, column: int, books: list[np.ndarray], trees: list[Node]):
    """Slices of a batch: first row, parts' matrix, nearest entries and distances by part."""
    for i in range(0, batch.num_rows, SLICE):
        x = _matrix(batch.slice(i, SLICE), column, len(books))
        got = [nearest(p, b, t) for p, b, t in zip(x, books, trees, strict=True)]
        yield i, x, np.array([g[0] for g in got]), np.array([g[1] for g in got])


def _sums(shared):
    """Batches of q -> sums and counts of the parts that fell to each entry in this task."""

    def run(batches):
        books, trees = shared.value
        n = np.zeros((len(books), len(books[0])), np.int64)
        total = np.zeros((*n.shape, books[0].shape[1]), np.int64)
        for b in batches:
            for _, x, at, _ in _searched(b, 0, books, trees):
                for p, i in np.argwhere(np.ones_like(n, bool)):
                    own = at[p] == i
                    n[p, i] += np.count_nonzero(own)
                    total[p, i] += x[p][own].sum(axis=0)
        used = np.argwhere(n > 0)
        if len(used):
            p, i = used.T
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(i, pa.int32()), pa.array(list(total[p, i]), pa.list_(pa.int64())), pa.array(n[p, i])], ["part", "entry", "total", "n"])

    return run


def _codes(shared):
    """Batches of (key, label, q) -> key, label, code, error."""

    def run(batches):
        books, trees = shared.value
        for b in batches:
            for i, _, at, d in _searched(b, 2, books, trees):
                code = [row.tobytes().hex() for row in np.ascontiguousarray(at.T.astype(np.uint8))]
                part = b.slice(i, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(code), pa.array(d.sum(axis=0))], ["key", "label", "code", "error"])

    return run


def fit(q: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of every part, from the staged vectors of kept_vectors() of one length."""
    spark = q.sparkSession
    first = q.orderBy(F.col("key").asc_nulls_last(), "q").limit(entries).select("q").toArrow()
    x = _matrix(first.combine_chunks().to_batches()[0], 0, parts)
    books = list(x)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((books, [tree(b) for b in books]))
        rows = q.select("q").mapInArrow(_sums(shared), "part int, entry int, total array<long>, n long")
        rows = rows.select("part", "entry", "n", F.posexplode_outer("total").alias("at", "x"))
        sums = rows.groupBy("part", "entry", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
        books = [b.copy() for b in books]
        for r in sums.collect():  # at most one row for each number of the codebooks
            if r["at"] is not None:
                books[r["part"]][r["entry"], r["at"]] = int(r["x"]) // r["n"]
        shared.destroy()
    return books


def digest(books: list[np.ndarray], width: int) -> str:
    """SHA-256 of all components in decimal by part, entry and position; not of what filled parts up."""
    size = books[0].shape[1]
    numbers = [x for p, b in enumerate(books) for e in b for x in e[: max(0, min(size, width - p * size))].tolist()]
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """key, code (two hex digits a part), error, label_error, codebooks_sha256 for each kept row.

    See kept_vectors() for what is left out.  All vectors have one length, that of the kept row
    of smallest key; rows of another length are left out too.  A length that the parts don't
    divide fills the last parts up with zeros.  Null keys come after all others and stay;
    rows of equal keys stay and count each, the smaller vector first.  Fewer rows than entries
    make smaller codebooks.  Null labels are one label.  An empty table, or one without
    a kept row, gives no rows.  Other columns play no part.
    """
    common.ship(vectors.sparkSession)
    q = common.stage(kept_vectors(vectors, key, vector, label), "vectors")
    names = {"key": key, "label": "__label"}
    head = q.orderBy(F.col("key").asc_nulls_last(), "q").select(F.size("q").alias("n")).first()
    if head is None:
        return q.select(F.col("key").alias(key), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    q = q.filter(F.size("q") == head["n"])
    books = fit(q, parts, entries, rounds)
    shared = q.sparkSession.sparkContext.broadcast((books, [tree(b) for b in books]))
    kinds = dict(q.dtypes)
    coded = common.stage(q.mapInArrow(_codes(shared), f"key {kinds['key']}, label {kinds['label']}, code string, error long"), "codes")
    by_label = coded.groupBy(F.col("label").alias("__label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    out = coded.join(common.small(common.stage(by_label, "labels")), F.col("label").eqNullSafe(F.col("__label")))
    return out.select(F.col("key").alias(names["key"]), "code", "error", "label_error", F.lit(digest(books, head["n"])).alias("codebooks_sha256"))


def oracle_sql(table: str = "embeddings") -> str:
    """The same in SQL: one assignment and one update a round, all distances compared."""
    long = f"""WITH ok AS MATERIALIZED (SELECT vec_id, label, embedding AS v, len(embedding) // {PARTS} AS w FROM {table}
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
px AS MATERIALIZED (SELECT vec_id, label, (i - 1) // w AS part, (i - 1) % w AS pos, CAST(floor({SCALE} * CAST(v[i] AS DOUBLE)) AS BIGINT) AS x
 FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM ok)),
b0 AS MATERIALIZED (SELECT part, entry, pos, x AS y FROM px JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM ok QUALIFY entry < {ENTRIES}) USING (vec_id))"""
    for r in range(ROUNDS + 1):
        long += f""",
a{r} AS MATERIALIZED (SELECT vec_id, part, min(d * {ENTRIES} + entry) % {ENTRIES} AS entry, min(d) AS d
 FROM (SELECT vec_id, part, entry, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM px JOIN b{r} USING (part, pos) GROUP BY ALL) GROUP BY ALL)"""
        if r < ROUNDS:
            long += f""",
s{r} AS MATERIALIZED (SELECT part, entry, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM px JOIN a{r} USING (vec_id, part) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT part, entry, pos, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y FROM b{r} LEFT JOIN s{r} USING (part, entry, pos))"""
    return long + f""",
coded AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} JOIN ok USING (vec_id) GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(y, ',' ORDER BY part, entry, pos)) FROM b{ROUNDS}) AS codebooks_sha256 FROM coded"""
