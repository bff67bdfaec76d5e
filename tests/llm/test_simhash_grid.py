"""The grid of the near-dedup: a real embedding, and no pair within the radius is missed."""

from __future__ import annotations

import numpy as np

from vellum.llm import simhash_dedup as S


def _cuts(half: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Counts of two-bit segments, and of four-bit segments that begin one bit later."""
    bits = [half >> i & 1 for i in range(32)]
    return tuple(sum(bits[i : i + 2]) for i in range(0, 32, 2)), tuple(sum(bits[(4 * j + 1 + k) % 32] for k in range(4)) for j in range(8))


def _unpacked(x) -> tuple[tuple[int, ...], tuple[int, ...]]:
    return tuple(int(x) >> i & 3 for i in range(0, 32, 2)), tuple(int(x) >> 32 + i & 15 for i in range(0, 32, 4))


def test_counts_and_neighbours_are_those_of_the_segments():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 32, 500, dtype=np.uint64)
    got = S.embedded(v)
    assert [_unpacked(x) for x in got] == [_cuts(int(x)) for x in v]
    near, rows = S.neighbours(got)
    for i in range(0, 500, 25):
        mine = [_unpacked(x) for x in near[rows == i]]
        flipped = {_cuts(int(v[i]) ^ (1 << b)) for b in range(32)}
        assert flipped <= set(mine) and len(set(mine)) == len(mine) and len(mine) <= 48
        for small, wide in mine:
            assert sum(abs(a - b) for a, b in zip(small, _unpacked(got[i])[0], strict=True)) == 1 == sum(abs(a - b) for a, b in zip(wide, _unpacked(got[i])[1], strict=True))


def test_different_halves_share_a_cell():
    v = np.unique(np.random.default_rng(2).integers(0, 1 << 32, 3_000_000, dtype=np.uint64))
    strangers = len(v) - len(np.unique(S.embedded(v)))
    assert 5_000 < strangers < 100_000


def test_manhattan_distance_is_a_lower_bound():
    rng = np.random.default_rng(3)
    for a, b in rng.integers(0, 1 << 32, (2000, 2), dtype=np.uint64).tolist():
        for cut in (0, 1):
            assert sum(abs(x - y) for x, y in zip(_cuts(a)[cut], _cuts(b)[cut], strict=True)) <= (a ^ b).bit_count()


def test_no_pair_within_the_radius_is_missed():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps = [base]
    for bits in (1, 2, 3, 4, 5):
        flips = np.zeros(len(base), np.uint64)
        for _ in range(bits):
            flips |= np.uint64(1) << rng.integers(0, 64, len(base), dtype=np.uint64)
        fps.append(base ^ flips)
    fps = np.unique(np.concatenate(fps))
    keys, rows = S.cells(fps)
    met = set()
    order = np.lexsort((rows, keys))
    groups = np.split(rows[order], np.flatnonzero(np.diff(keys[order])) + 1)
    for g in groups:
        met |= {(int(a), int(b)) for i, a in enumerate(g) for b in g[i + 1 :]}
    met |= {(b, a) for a, b in met}
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= S.RADIUS, 1))
    assert len(near) > 600 and all((int(a), int(b)) in met for a, b in near)


def test_links_span_the_components_of_brute_force(spark):
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    for _ in range(3):
        fps = np.unique(np.concatenate([fps, fps ^ (np.uint64(1) << rng.integers(0, 64, len(fps), dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, len(fps), dtype=np.uint64))]))
    root = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= S.RADIUS
    for _ in range(len(fps)):
        new = np.array([root[n].min() for n in near])
        if (new == root).all():
            break
        root = new
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r.node: r.root for r in S.components(S.links(df, block=64)).collect()}
    want: dict[int, set] = {}
    for x, r in zip(fps.view(np.int64).tolist(), root.tolist(), strict=True):
        want.setdefault(r, set()).add(x)
    mine: dict[int, set] = {}
    for x in fps.view(np.int64).tolist():
        mine.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, mine.values()))
