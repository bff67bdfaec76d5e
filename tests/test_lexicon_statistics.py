"""The phrase automaton against str.count, and mergeable statistics against plain Python."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from vellum.operators import extract, lexicon, segment, statistics


def test_counts_equal_str_count(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("ab大概率") for _ in range(rng.randint(1, 4)))
    phrases = [word() for _ in range(60)] + ["aa", "aaa", "大概", "大概率", "", "aa"]
    groups = [phrases[:20], phrases[20:], [], ["aa", "aa", ""]]
    texts = [None, "", "aaaaa", "大概率大概", *["".join(rng.choice("ab大概率 ") for _ in range(rng.randint(0, 80))) for _ in range(300)]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (lexicon.SLICE, 20):  # many slices give the same
        got = {r.doc_id: r.n for r in lexicon.group_counts(d, groups, {"text": "n"}, size).collect()}
        assert got == {i: [sum((t or "").count(p) for p in g if p) for g in groups] for i, t in enumerate(texts)}
        rows = lexicon.phrase_counts(d, [("c", p) for p in phrases] + [("d", "aa")], size=size).collect()
        want = [(i, "c", p, (t or "").count(p)) for i, t in enumerate(texts) for p in phrases if p and p in (t or "")] + [(i, "d", "aa", (t or "").count("aa")) for i, t in enumerate(texts) if "aa" in (t or "")]
        assert sorted(map(tuple, rows)) == sorted(want)
    assert lexicon.phrase_counts(d, []).count() == 0 and extract.phrase_hits(d, []).count() == 0


def test_five_thousand_phrases_in_one_pass(spark):
    rng = random.Random(8)
    phrases = list(dict.fromkeys("".join(rng.choice("abcde") for _ in range(rng.randint(3, 9))) for _ in range(5000)))
    texts = ["".join(rng.choice("abcde ") for _ in range(20_000)) for _ in range(20)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.n for r in lexicon.group_counts(d, [[p] for p in phrases], {"text": "n"}).collect()}
    assert time.time() - began < 60
    assert all(got[i] == [t.count(p) for p in phrases] for i, t in list(enumerate(texts))[:3])


def test_buckets(spark):
    n = spark.range(100_000).select("id", statistics.bucket(F.col("id")).alias("b")).withColumn("low", statistics.bucket_start(F.col("b")))
    assert n.filter("low > id OR id - low > id / 16 OR (id < 32 AND low <> id)").count() == 0
    assert n.groupBy("b").agg(F.min("id").alias("i"), F.min("low").alias("l")).filter("i <> l").count() == 0


def test_statistics_of_documents_and_corpus(spark):
    texts = ["One two three. Four!\n\n“Five” -- six​ #tag **bold** 'x'.", "第一句，ok,第二句。「好」，中,", None, "w " * 300 + "."]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    s = statistics.document_statistics(d)
    got = {r.doc_id: r for r in s.collect()}
    r = got[0]
    assert (r.sentences, r.dashes, r.quotes_straight, r.quotes_curly, r.bold, r.hashtags, r.hidden, r.mixed_width) == (3, 1, 2, 2, 1, 1, 1, False)
    assert [tuple(x) for x in r.histogram] == [(1, 1), (3, 1), (5, 1)]
    assert got[1].mixed_width and got[1].lang == "zh" and got[1].quotes_corner == 2
    assert got[2].sentences == 0 and got[2].histogram == [] and [tuple(x) for x in got[3].histogram] == [(16 * 4 + 300 // 16, 1)]
    all_ = statistics.corpus_statistics(s.withColumn("g", F.lit(None).cast("string")), ["g"]).first()
    assert (all_.documents, all_.sentences, all_.longest, all_.p50) == (4, 3 + 2 + 1, 288, 3)


def test_candidates_are_numbered_in_order(spark):
    s = segment.sentences(spark.createDataFrame([(1, "No it is. No no 12 3."), (2, "x")], "doc_id long, text string"))
    found = extract.detected(s, [("B", "regex", "[Nn]o"), ("A", "lexicon", "l"), ("C", "count", "[0-9]+")], {"l": ["it", "no"]})
    c = statistics.numbered_candidates(found, ["B", "A", "C"])
    assert [tuple(r) for r in c.orderBy(F.substring("id", 2, 9).cast("int")).collect()] == [(1, "F1", 1, "B", 1), (1, "F2", 1, "A", 1), (1, "F3", 2, "B", 2), (1, "F4", 2, "A", 1), (1, "F5", None, "C", 2)]
    assert statistics.candidate_lines(c).first().candidates.split("\n")[3:] == ["- F4｜A｜第 2 句｜命中 1 次", "- F5｜C｜全文｜命中 2 次"]
