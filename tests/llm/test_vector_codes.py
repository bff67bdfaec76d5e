"""Vector codes against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from vellum.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int, key string, code string, __label int"


def _brute(rows):
    """vec_id -> (code, error, label_error, digest) by plain integers."""
    ok = [(k, [math.floor(4096 * x) for x in v], g) for k, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(ok[0][1]) // 8
    part = lambda v, p: v[p * w : p * w + w]
    books = [[part(v, p) for _, v, _ in ok[:16]] for p in range(8)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda v: [min(range(len(books[p])), key=lambda i: (dist(part(v, p), books[p][i]), i)) for p in range(8)]
    for _ in range(6):
        got = [assign(v) for _, v, _ in ok]
        for p in range(8):
            for i in range(len(books[p])):
                own = [part(v, p) for (_, v, _), a in zip(ok, got, strict=True) if a[p] == i]
                if own:
                    books[p][i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(k, g, a := assign(v), sum(dist(part(v, p), books[p][a[p]]) for p in range(8))) for k, v, g in ok]
    return sorted(((k, "".join(f"{i:02x}" for i in a), e, sum(f for _, h, _, f in out if h == g), sha) for k, g, a, e in out), key=repr)


def _run(spark, rows):
    df = spark.createDataFrame([(k, v, g, "clash", "clash", 1) for k, v, g in rows], SCHEMA)
    return sorted((tuple(r) for r in V.compressed(df).collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_tree_search_equals_brute_force_with_ties(seed):
    rng = np.random.default_rng(seed)
    for size, width, spread in ((16, 8, 2), (16, 1, 3), (16, 3, 50), (1, 2, 5), (5, 8, 1), (16, 8, 5000)):
        book = rng.integers(-spread, spread + 1, (size, width))
        book[rng.integers(0, size, size // 3)] = book[0]
        points = np.concatenate([rng.integers(-spread - 1, spread + 2, (300, width)), book, book[:1] + 1])
        d = ((points[:, None, :] - book[None]) ** 2).sum(axis=2)
        at, best = V.nearest(points, book, V.tree(book))
        assert (at == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_codes_equal_brute_force_with_ties_nulls_and_repeats(spark):
    rng = random.Random(5)
    vec = lambda: [rng.choice([-0.5, -1e-4, 0.0, 1e-4, 0.25, 1.0]) for _ in range(16)]
    rows = [(i, vec(), rng.choice([None, 1, 2])) for i in range(60)]
    rows += [rows[3], rows[3], (7, vec(), 1), (None, vec(), None), (None, vec(), 2)] + [(100 + i, rows[5][1], 1) for i in range(40)]
    odd = [(0, None, 1), (1, [None] + [0.0] * 15, 1), (2, [float("nan")] + [0.0] * 15, None), (3, [float("inf")] + [0.0] * 15, 2), (4, [-1e300] + [0.0] * 15, 2), (None, None, None)]
    want = _brute(rows)
    assert _run(spark, rows + odd) == want


def test_small_and_odd_tables(spark):
    assert _run(spark, []) == [] and _run(spark, [(1, None, 1), (2, [None], 1)]) == []
    few = [(1, [0.1] * 8, None), (2, [0.2] * 8, 1)]
    assert _run(spark, few) == _brute(few)
    assert [r[:3] for r in _run(spark, [*few, (5, [0.1] * 9, 1)])] == [r[:3] for r in _brute(few)]
    assert [r[:3] for r in _run(spark, [(1, [], 1), (2, [], 1)])] == [(1, "00" * 8, 0), (2, "00" * 8, 0)]
    eleven = _run(spark, [(1, [0.5] * 11, 1)])  # two components a part, the last ones filled up
    assert eleven[0][:4] == (1, "00" * 8, 0, 0) and eleven[0][4] == hashlib.sha256(",".join(["2048"] * 11).encode()).hexdigest()


def test_large_integers_stay_exact(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-32000, 32000) for _ in range(64)], i % 2) for i in range(40)]
    assert _run(spark, rows) == _brute(rows)
