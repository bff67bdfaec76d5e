"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

Suffixes are classified; leftmost-smaller (LMS) substrings are sorted by induction and
named; the string of names is sorted recursively, to the end; all suffixes are then induced
from the sorted LMS suffixes in two linear scans.  A scan sends the predecessor of each
suffix, in order, to the bucket of its first symbol.  Over few symbols it takes a whole
bucket at a time, in waves; over many, or where symbols follow themselves, so that buckets
or waves are small, one suffix after the other.
"""

from __future__ import annotations

import numpy as np

#: Fewest suffixes of a bucket, on average, and the largest share of symbols that follow
#: themselves, for which a scan by buckets pays.
BUCKET_MEAN, FOLLOWING = 256, 0.25
_BASE = np.uint64(0x9E3779B97F4A7C15)


def smaller_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last, a unique least, is."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1])
    step[-1] = 1
    at = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _split(pred: np.ndarray, symbols: np.ndarray, into: list[list]) -> None:
    """Append predecessors to the buckets of their symbols, keeping their order."""
    if not len(pred):
        return
    s = symbols[pred]
    order = np.argsort(s, kind="stable")
    s, pred = s[order], pred[order]
    cut = np.flatnonzero(s[1:] != s[:-1]) + 1
    for c, part in zip(s[np.concatenate([[0], cut])], np.split(pred, cut), strict=True):
        into[c].append(part)


def induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes, given the LMS suffixes in order."""
    if len(t) < BUCKET_MEAN * sigma or np.count_nonzero(t[1:] == t[:-1]) > FOLLOWING * len(t):
        return _scanned(t, small, lms, sigma)
    return _by_buckets(t, small, lms, sigma)


def _scanned(t: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The two scans, suffix by suffix."""
    n = len(t)
    size = np.bincount(t, minlength=sigma)
    ends = np.cumsum(size)
    sa = [-1] * n
    # LMS suffixes at the ends of their buckets
    tail = ends.tolist()
    symbols, order = t.tolist(), lms.tolist()
    for i in reversed(order):
        c = symbols[i]
        tail[c] -= 1
        sa[tail[c]] = i
    larger = (~small).tolist()
    head = (ends - size).tolist()
    for i in sa if n else ():
        if i > 0 and larger[i - 1]:
            c = symbols[i - 1]
            sa[head[c]] = i - 1
            head[c] += 1
    tail = ends.tolist()
    for k in range(n - 1, -1, -1):
        i = sa[k]
        if i > 0 and not larger[i - 1]:
            c = symbols[i - 1]
            tail[c] -= 1
            sa[tail[c]] = i - 1
    sa[0] = n - 1
    return np.array(sa, lms.dtype)


def _by_buckets(t: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The two scans, bucket by bucket."""
    larger: list[list] = [[] for _ in range(sigma)]
    seeds: list[list] = [[] for _ in range(sigma)]
    _split(lms, t, seeds)
    done: list[np.ndarray] = []
    empty = np.zeros(0, lms.dtype)
    for c in range(sigma):
        k, own = 0, larger[c]
        while k < len(own):  # grows while the bucket sends to itself
            wave = own[k]
            k += 1
            pred = wave[wave > 0] - 1
            _split(pred[~small[pred]], t, larger)
        done.append(np.concatenate(own) if own else empty)
        larger[c] = []
        for wave in seeds[c]:
            pred = wave[wave > 0] - 1
            _split(pred[~small[pred]], t, larger)
    below: list[list] = [[] for _ in range(sigma)]
    out: list[np.ndarray] = []
    for c in range(sigma - 1, -1, -1):
        k, own = 0, below[c]
        if c == 0:
            own.append(np.array([len(t) - 1], lms.dtype))
        while k < len(own):
            wave = own[k]
            k += 1
            pred = wave[wave > 0] - 1
            _split(pred[small[pred]], t, below)
        if own:
            out.append(np.concatenate(own))
        wave = done[c][::-1]
        out.append(wave)
        pred = wave[wave > 0] - 1
        _split(pred[small[pred]], t, below)
        below[c] = []
    return np.concatenate(out)[::-1]


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """t: symbols below sigma, ending in a 0 that occurs nowhere else."""
    n = len(t)
    small = smaller_types(t)
    at = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int64) + 1
    if len(at) <= 1:
        return induce(t, small, at, sigma)
    order = induce(t, small, at, sigma)
    is_lms = np.zeros(n, bool)
    is_lms[at] = True
    order = order[is_lms[order]]
    # names: LMS substrings are equal if their lengths and polynomial hashes are
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))]))
    total = np.concatenate([[np.uint64(0)], np.cumsum((t.astype(np.uint64) + np.uint64(1)) * power[:n])])
    end = np.append(at[1:], n - 1) + 1
    hashed = (total[end] - total[at]) * inverse[at]
    place = np.empty(n, np.int64)
    place[at] = np.arange(len(at))
    p = place[order]
    differs = np.concatenate([[True], (hashed[p[1:]] != hashed[p[:-1]]) | ((end - at)[p[1:]] != (end - at)[p[:-1]])])
    name = np.empty(len(at), np.int64)
    name[p] = np.cumsum(differs) - 1
    names = int(differs.sum())
    if names < len(at):
        order = at[suffix_array(name, names)]
    return induce(t, small, order, sigma)


def permuted_lcp(data: bytes, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phi, plcp) by text position: the preceding suffix, and the prefix they share.

    Only irreducible positions, whose left neighbours differ, are compared; after them the
    value falls by one at each position.
    """
    n = len(sa)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    t = np.frombuffer(data, np.uint8)
    i = np.arange(n)
    left = np.maximum(phi, 1) - 1
    reducible = (i > 0) & (phi > 0) & (t[np.maximum(i, 1) - 1] == t[left])
    head = np.flatnonzero(~reducible)
    words = np.ndarray((n,), "<u8", buffer=data + b"\0" * 8, strides=(1,))
    value = np.zeros(len(head), np.int64)
    live = np.flatnonzero(phi[head] >= 0)
    a, b = head[live], phi[head[live]]
    while len(live):
        end = n - np.maximum(a, b)
        x = words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)]
        same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
        value[live] += np.minimum(same, np.maximum(end, 0))
        go = (same == 8) & (end > 8)
        live, a, b = live[go], a[go] + 8, b[go] + 8
    at = np.maximum.accumulate(np.where(reducible, 0, i))
    full = np.zeros(n, np.int64)
    full[head] = value
    return phi, np.maximum(full[at] - (i - at), 0)
