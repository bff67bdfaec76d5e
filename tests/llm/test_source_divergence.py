"""Source divergence against plain Python, and on odd tables."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np

from vellum.llm import source_divergence as S

SCHEMA = "doc_id long, text string, lang string, source string, term string, part int, n string"


def _brute(rows, least):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in ((a or "", b or "", c or "") for a, b, c in rows):
        got = Counter(term.findall(lower(text)))
        df[lang].update(got.keys())
        counts[lang, source].update(got)
        groups.add((lang, source))
    out = []
    for lang in {g[0] for g in groups}:
        keep = [t for t, n in df[lang].items() if n >= least]
        own = {s: {t: counts[g, s][t] for t in keep} for g, s in groups if g == lang}
        share = lambda c, k=len(keep): {t: 1 + 10**9 * (n + 5) // (sum(c.values()) + 5 * k) for t, n in c.items()}
        p, q = {s: share(c) for s, c in own.items()}, share({t: sum(c[t] for c in own.values()) for t in keep})
        for s in own:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in keep), o) for o in own if o != s]
            more = [(p[s][t] - q[t], t) for t in keep if own[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", more, 50)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, i, v, k) for k, (v, i) in enumerate(ordered, 1)]
    return sorted(out)


def _run(spark, rows, **how):
    df = spark.createDataFrame([(i, *r, "clash", 1, "clash") for i, r in enumerate(rows)], SCHEMA)
    got = S.audit(df, **how)
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got.collect())


def test_equals_plain_python(spark):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("The", "é", "x", "Ümla", "中", "aa") for b in ("a", "Z", "ß", "d", " q", "İ")]
    text = lambda: "".join(rng.choice(words[: rng.randint(1, 36)]) + rng.choice([" ", "1", "-", "\x00", "\n", "_"]) for _ in range(rng.randint(0, 60)))
    rows = [(text(), rng.choice(["en", "fr", None, ""]), rng.choice([None, "s1", "s2", "S", "é", "s10"])) for _ in range(300)]
    rows += [rows[5]] * 50 + [(None, "en", "none"), ("", "de", "a"), (None, "de", "b"), ("once", "it", "alone"), ("word " * 300_000 + "É", "en", "s1")]
    want = _brute(rows, 30)
    assert _run(spark, rows) == want and {r[2] for r in want} == {"pair", "term"}
    assert _run(spark, rows, tile=2, run=500) == want
    assert _run(spark, rows, least=3) == _brute(rows, 3)


def test_empty_and_small_tables(spark):
    assert _run(spark, []) == []
    assert _run(spark, [(None, None, None)]) == []
    few = [("a b", "en", "x"), ("a", "en", "y"), ("", "en", "z")]
    assert _run(spark, few) == _brute(few, 30) and _run(spark, few, least=1) == _brute(few, 1)


def test_a_very_long_text_is_counted_in_slices():
    text = ("Some words, é" * 1_700_000).encode()
    assert len(text) > 4 * S.SLICE and S._counted(text) == Counter(S.terms_of(text))
    rows = list(S._long("en", "s", text))[0].to_pydict()
    assert rows["n"] == [Counter(S.terms_of(text))[t.encode()] for t in rows["term"]] and set(rows["docs"]) == {1}
    assert list(S._long("en", "s", b"12 34")) == []


def test_shares_are_exact():
    rng = random.Random(3)
    for _ in range(2000):
        total = rng.randint(1, 9 * 10**15)
        count = rng.randint(0, max(0, total - 5))
        assert int(S.shares(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * (count + 5) // total
