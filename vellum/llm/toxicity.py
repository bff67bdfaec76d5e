"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct lower-case words of a text and their beginnings of PREFIXES
letters, hashed.  A term enters the model if its own share differs clearly between toxic and
other labelled texts, or if its share together with another of the FREQUENT most frequent
terms does so more clearly than that of either alone, such as an insult that counts only
where a group is mentioned.  A factorization machine over them learns a weight for each and,
by the product of short vectors, for each pair.  The model is fitted on a bounded sample of
labelled rows (TRAIN_ROWS); every text is scored.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common

#: The documented bound of the training sample: labelled rows of smallest hash.
TRAIN_ROWS = 40_000
BUCKETS = 1 << 22
PREFIXES = (4, 5, 6)
#: Least z statistic of a term's share and the least number of texts with it.
LEAST_Z, LEAST_TEXTS = 6.0, 8
#: Bound of the model: terms of largest z statistic that enter by their own share.
MOST_TERMS = 4096
#: Most frequent terms whose pairs are counted, the least gain of a pair's z statistic over
#: those of its terms, and the bound of the terms that enter by pairs.
FREQUENT, LEAST_GAIN, MOST_PAIRED = 512, 4.0, 256
FACTORS, EPOCHS, RATE, DECAY, SEED = 8, 300, 0.1, 1e-4, 7
FOLDS = 5
_WORD = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 400_000


@functools.lru_cache(maxsize=CACHE_WORDS)
def _hashes(word: str) -> tuple[int, ...]:
    data = [b"w" + word.encode()] + [b"p" + word[:k].encode() for k in PREFIXES if len(word) > k]
    return tuple({zlib.crc32(x) % BUCKETS for x in data})


def terms(text: str | None) -> list[int]:
    """The hashed terms of a text, ascending."""
    return sorted({h for w in set(_WORD.findall((text or "").lower())) for h in _hashes(w)})


class Machine:
    """score = sigmoid(b + sum w_i + sum over pairs <v_i, v_j>) of the terms present."""

    def __init__(self, names: np.ndarray, factors: int = FACTORS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.names = np.asarray(names, np.int64)
        self.b, self.w = 0.0, np.zeros(len(names))
        self.v = rng.normal(0, 0.01, (len(names), factors))

    def raw(self, rows: np.ndarray, cols: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        linear = np.bincount(rows, self.w[cols], n)
        sums = np.stack([np.bincount(rows, self.v[cols, f], n) for f in range(self.v.shape[1])], axis=1)
        squares = np.bincount(rows, (self.v[cols] ** 2).sum(axis=1), n)
        return self.b + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def fit(self, rows: np.ndarray, cols: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> Machine:
        n, d = len(y), len(self.names)
        if not n:
            return self
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.b = float(np.log(rate / (1 - rate)))
        gb, gw, gv = 1e-8, np.full(d, 1e-8), np.full(self.v.shape, 1e-8)
        for _ in range(epochs):
            z, sums = self.raw(rows, cols, n)
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
            dw = np.bincount(cols, e[rows], d) + DECAY * self.w / d
            dv = np.stack([np.bincount(cols, e[rows] * (sums[rows, f] - self.v[cols, f]), d) for f in range(self.v.shape[1])], axis=1) + DECAY * self.v / d
            db = e.sum()
            gb, gw, gv = gb + db**2, gw + dw**2, gv + dv**2
            self.b -= RATE * db / np.sqrt(gb)
            self.w -= RATE * dw / np.sqrt(gw)
            self.v -= RATE * dv / np.sqrt(gv)
        return self

    def score(self, lists: list[list[int]]) -> np.ndarray:
        cols = np.array([c for x in lists for c in x], np.int64)
        rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        return 1 / (1 + np.exp(-np.clip(self.raw(rows, cols, len(lists))[0], -30, 30)))


def held_out(key: F.Column) -> F.Column:
    """Rows that no training sees: crc32 of the key's text divisible by FOLDS."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> Machine:
    """A machine from the labelled rows outside the held-out fold.

    A key with several labels counts as toxic if one says so; null keys and labels and
    labels without a text are left out; equal texts count once, by the least key.  Without any
    label, or with one class only, every score is the same, as for empty tables.
    """
    spark = docs.sparkSession
    common.ship(spark)
    lab = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).filter("k IS NOT NULL AND y IS NOT NULL").filter(~held_out(F.col("k")))
    lab = lab.groupBy("k").agg((F.max("y") > 0).cast("int").alias("y")).orderBy(F.xxhash64("k"), "k").limit(rows)
    lab = common.stage(lab, "labels")
    # at most `rows` rows of 12 bytes
    base = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).join(F.broadcast(lab), "k")
    # equal texts count once, and of a key with several texts the one of least hash
    base = base.groupBy("k", "y").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t"))
    used = common.stage(base.groupBy(F.xxhash64("t").alias("h")).agg(F.min_by(F.struct("k", "y", "t"), "k").alias("r")).select("r.*"), "train")
    n = {r["y"]: r["count"] for r in used.groupBy("y").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        model = Machine(np.zeros(0, np.int64))
        model.b = 30.0 if n1 else -30.0 if n0 else 0.0
        return model

    def tally(batches):
        counts: dict[int, list[int]] = {}
        for b in batches:
            for y, t in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                for h in terms(t.as_py()):
                    counts.setdefault(h, [0, 0])[y] += 1
        if counts:
            a = np.array([(h, *c) for h, c in counts.items()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, i]) for i in range(3)], ["term", "c0", "c1"])

    count = used.mapInArrow(tally, "term long, c0 long, c1 long").groupBy("term").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    share = (F.col("c0") + F.col("c1")) / (n0 + n1)
    z = (F.col("c1") / n1 - F.col("c0") / n0) / F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-12)
    count = common.stage(count.filter(F.col("c0") + F.col("c1") >= LEAST_TEXTS).withColumn("z", F.abs(z)), "terms")
    # at most MOST_TERMS and FREQUENT terms
    strong = {r["term"] for r in count.filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(MOST_TERMS).collect()}
    frequent = {r["term"] for r in count.orderBy(F.desc(F.col("c0") + F.col("c1")), "term").limit(FREQUENT).collect()}
    names = np.array(sorted(strong | frequent), np.int64)

    def place(batches):
        at = {int(h): i for i, h in enumerate(names)}
        for b in batches:
            lists = [[at[h] for h in terms(t.as_py()) if h in at] for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), pa.array(lists, pa.list_(pa.int32()))], ["k", "y", "at"])

    # at most `rows` rows of screened terms
    sample = used.mapInArrow(place, "k string, y int, at array<int>").orderBy("k").toPandas()
    sizes, y = sample["at"].map(len).to_numpy(), sample["y"].to_numpy(float)
    rows_of, cols = np.repeat(np.arange(len(sample)), sizes), np.concatenate([*sample["at"], []]).astype(np.int64)
    kept = np.isin(names, list(strong))
    kept[paired(rows_of, cols, y, np.flatnonzero(np.isin(names, list(frequent))))] = True
    mine = kept[cols]
    return Machine(names[kept]).fit(rows_of[mine], (np.cumsum(kept) - 1)[cols[mine]], y)


def paired(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """The candidates that matter together: terms of pairs whose share differs between the
    classes more clearly than the terms' own shares, those of largest gain first."""
    m, n1 = len(candidates), y.sum()
    n0, place = len(y) - n1, np.full(cols.max(initial=-1) + 1, -1)
    place[candidates[candidates < len(place)]] = np.flatnonzero(candidates < len(place))
    both = np.zeros((2, m, m), np.float32)
    mine = np.flatnonzero(place[cols] >= 0)
    for i in range(0, len(y), 2048):  # blocks of rows
        part = mine[np.searchsorted(rows[mine], i) : np.searchsorted(rows[mine], i + 2048)]
        x = np.zeros((min(2048, len(y) - i), m), np.float32)
        x[rows[part] - i, place[cols[part]]] = 1
        for k in (0, 1):
            some = x[y[i : i + 2048] == k]
            both[k] += some.T @ some
    share = (both[0] + both[1]) / (n0 + n1)
    z = np.abs(both[1] / n1 - both[0] / n0) / np.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-12)
    own = np.diag(z)
    gain = np.where((both[0] + both[1] >= LEAST_TEXTS) & (z >= LEAST_Z), z - np.maximum(own[:, None], own[None, :]), 0)
    best = gain.max(axis=0, initial=0)
    order = np.argsort(-best, kind="stable")[:MOST_PAIRED]
    return candidates[order[best[order] >= LEAST_GAIN]]


def score(docs: DataFrame, model: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score and predicted for every row; a null text counts as empty.

    One pass over the scan; rows, repeats and null keys (never held out) are kept.  Long texts
    are scored whole, by their distinct terms.  Other columns play no part.
    """
    common.ship(docs.sparkSession)
    base = docs.select(F.col(f"`{key}`").alias("key"), held_out(F.col(f"`{key}`")).alias("held_out"), F.col(f"`{text}`").alias("t"))
    kind = base.schema["key"].dataType.simpleString()

    def run(batches):
        at = {int(h): i for i, h in enumerate(model.names)}
        known: dict[str, tuple[int, ...]] = {}
        for b in batches:
            lists = []
            for t in b.column(2):
                words = set(_WORD.findall((t.as_py() or "").lower()))
                for w in words:
                    if w not in known:
                        known[w] = tuple(at[h] for h in _hashes.__wrapped__(w) if h in at)
                lists.append(sorted({i for w in words for i in known[w]}))
                if len(known) > CACHE_WORDS:
                    known.clear()
            s = model.score(lists)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["key", "held_out", "score", "predicted"])

    return base.mapInArrow(run, f"key {kind}, held_out boolean, score double, predicted int").withColumnRenamed("key", key)
