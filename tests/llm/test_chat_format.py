"""Chat formatting: exact round trips of odd texts, cut conversations, and digests by plain Python."""

from __future__ import annotations

import hashlib
import random

import pytest

from vellum.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, part string, c string, whole int"
BITS = ["### user:", "### assistant: ", "</turn>", "\\", "\n", "### ", "###", "</turn", "x", " ", "é", "\r", "### x_41:", "### :", ""]


@pytest.mark.parametrize("seed", range(5))
def test_every_text_comes_back(seed):
    rng = random.Random(seed)
    for _ in range(400):
        turns = [(rng.choice(["user", "assistant", "", "a b", "x_y", "x_41", "é\n:", "System"]), "".join(rng.choice(BITS) for _ in range(rng.randint(0, 12)))) for _ in range(rng.randint(1, 6))]
        text, loss = C.rendered(turns)
        assert [t[:2] for t in C.parse(text)] == turns
        assert [C.unescaped(text[s["start"] : s["end"]]) for s in loss] == [t for r, t in turns if r == "assistant"]
        for r, body, a, b in C.parse(text):  # no control string of a text stands bare, and only conflicts are escaped
            assert all(m[1] for m in C._CONTROL.finditer(text[a:b]))
            assert text[a:b] == body or C._CONTROL.search(body)


def test_broken_texts_have_no_parse():
    good = C.frame("user", "hi")
    for bad in ("x", good[:-1], good[1:], good + "y", good.replace("\n</turn>", "</turn>"), "### x_zz: a\n</turn>\n", "### x_75: a\n</turn>\n", "### user: a ### b: c\n</turn>\n"):
        assert C.parse(bad) is None
    assert C.parse("") == [] and C.parse(good * 2) is not None


def _brute(rows):
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted(((t is None, t or 0, r or "", x or "") for c, t, r, x in rows if c == key))
        said = [(r, x) for *_, r, x in own]
        learnt = "".join(x for r, x in said if r == "assistant")
        text = "".join(C.frame(r, C.escaped(x)) for r, x in said)
        out[key] = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in said).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text))
    return out


def _run(spark, rows, path, **how):
    df = spark.createDataFrame([(*r, "clash", "clash", 7) for r in rows], SCHEMA)
    C.write_formatted(df, path, **how)
    pieces = C.read_formatted(spark, path)
    return {r.conv_id: tuple(r)[1:] for r in C.digests(pieces).collect()}, pieces


def test_digests_equal_plain_python(spark, tmp_path):
    rng = random.Random(1)
    say = lambda n: "".join(rng.choice(BITS) for _ in range(n))
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", say(8), say(3)])) for c in range(60) for t in range(rng.randint(1, 5))]
    rows += [(3, 0, "user", "tie"), (3, 0, "assistant", "tie"), (3, 0, "user", "tie"), (4, None, "user", "last"), (None, 1, "user", "a"), (None, None, None, None), (5, 9, "assistant", "long " * 200_000)]
    rows += [(99, t, "assistant" if t % 2 else "user", say(6)) for t in range(3000)]  # a third of all rows and more
    rng.shuffle(rows)
    got, pieces = _run(spark, rows, str(tmp_path / "a"), chunk=500)
    assert got == _brute(rows)
    hot = pieces.filter("conv_id = 99")
    assert hot.count() > 5 and hot.select("part").distinct().count() > 1 and hot.filter("whole").count() == 0
    assert "".join(r.text for r in hot.orderBy("part", "seq").collect()) == "".join(C.rendered([(r or "", x or "")])[0] for c, t, r, x in sorted(rows, key=lambda r: r[1] or 0) if c == 99)
    assert _run(spark, rows, str(tmp_path / "b"))[0] == got  # other pieces, same digests


def test_an_empty_table(spark, tmp_path):
    assert _run(spark, [], str(tmp_path / "a"))[0] == {}
