"""The llm operators against brute force, exact round trips and edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, __w string"


def _docs(spark, texts):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 2}", None, 3, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(rng.randint(5, 200))) for _ in range(40)]
    shared = " ".join(word() for _ in range(150))
    out = [None, "", "   \n", "one", "a b", *base, *base[:6]]
    out += [b + " changed" for b in base[:6]] + [f"{x} {shared} {y}" for x, y in zip(base[6:10], base[10:14], strict=True)]
    return [*out, "ab " * 3000, "<|endoftext|> x　y  z \n q"]


def test_tokens_round_trip(spark, texts, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from vellum.llm.token_counts import token_counts
    from vellum.llm.token_output import read_tokens, write_tokens

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [np.array([*e.ids, 1], "<u4") for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    write_tokens(_docs(spark, texts), str(tmp_path / "t"), shards=3)
    got = sorted(read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.key)
    assert [bytes(r.ids) for r in got] == [w.tobytes() for w in want]
    assert [r.start for r in got] == np.cumsum([0, *map(len, want[:-1])]).tolist()
    counts = sorted(token_counts(_docs(spark, texts)).collect(), key=lambda r: r.doc_id)
    assert [r.n_tokens for r in counts] == [len(w) - 1 for w in want]


def test_coder_decodes_from_every_mark():
    from vellum.llm.token_output import Coder, scaled

    ids = np.random.default_rng(1).zipf(1.3, 50_000).clip(max=999).astype(np.int64)
    c = Coder(scaled(np.bincount(ids, minlength=1000)))
    got = c.encode(ids, 64, 100)
    assert (c.decode(got["payload"], got["states"], len(ids), 64) == ids).all()
    assert (c.decode_from_marks(got["payload"], got["states"], got["marks"], len(ids), 64, 100) == ids).all()


def test_packing_covers_every_id_once(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    from vellum.llm.packing import pack

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: np.array([*e.ids, 1], "<u4") for i, e in enumerate(tok.encode_batch([t or "" for t in texts], add_special_tokens=False))}
    rows = pack(_docs(spark, texts)).collect()
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(want[r.doc_id])
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.length
    assert total == Counter({k: len(v) for k, v in want.items()})
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_simhash_components(spark, texts):
    from vellum.llm.simhash_dedup import fingerprint, near_duplicates

    fps = [fingerprint(t) for t in texts]
    root = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 3:
                    root[i] = min(root[i], root[j])
    got = {r.doc_id: r for r in near_duplicates(_docs(spark, texts)).collect()}
    assert [got[i].component_id for i in range(len(fps))] == root
    assert [int(got[i].fingerprint, 16) for i in range(len(fps))] == fps


def test_one_of_each_group_takes_similar_texts(spark):
    from vellum.llm.simhash_dedup import fingerprint, one_of_each_group

    rng = random.Random(9)
    out = [None, "", "one", "two words"]
    for _ in range(12):
        base = [f"{rng.choice('abcdef')}{rng.randint(0, 400)}" for _ in range(rng.randint(30, 300))]
        out.append(" ".join(base))
        for edits in (0, 1, 2, 4, 8):
            words = list(base)
            for at in rng.sample(range(len(words)), edits):
                words[at] = f"new{rng.randint(0, 99)}"
            out.append(" ".join(words))

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, fps = [shingles(t) for t in out], [fingerprint(t) for t in out]
    root = list(range(len(out)))
    for _ in range(4):
        for i in range(len(out)):
            for j in range(len(out)):
                both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
                if (fps[i] ^ fps[j]).bit_count() <= 3 or either and both >= 0.8 * either:
                    root[i] = min(root[i], root[j])
    docs = _docs(spark, out)
    got = one_of_each_group(docs.unionByName(docs.filter("doc_id in (3, 5)")))
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(root))


def test_similar_texts_of_one_template_meet(spark, monkeypatch):
    from vellum.llm import shingle_links
    from vellum.llm.simhash_dedup import components

    rng = random.Random(4)
    head = [f"t{i}" for i in range(180)]
    own = [[f"d{k}w{i}" for i in range(35)] for k in range(400)]
    out = [" ".join(head + w) for w in own]
    for w in own[:100]:  # part of the own words again: a near copy of this text alone
        out.append(" ".join(head + w[:-22] + [f"x{rng.randint(0, 10**9)}" for _ in range(22)]))
    sets = [shingle_links.shingle_set(t) for t in out]
    root = list(range(len(out)))
    for j in range(len(out)):
        for i in range(j):
            if shingle_links.similar(sets[i], sets[j], 0.8):
                root[j] = min(root[j], root[i])
    assert root == list(range(400)) + list(range(100))
    for block in (64, 512):
        monkeypatch.setattr(shingle_links, "BLOCK", block)
        got = {r.node: r.root for r in components(shingle_links.links(_docs(spark, out))).collect()}
        assert [got.get(i, i) for i in range(len(out))] == root


def test_cells_of_close_fingerprints_meet():
    from vellum.llm.simhash_dedup import cells

    rng = random.Random(1)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), 3):
            b ^= 1 << k
        keys, rows = cells(np.array([a, b], np.uint64))
        assert set(keys[rows == 0]) & set(keys[rows == 1])


def test_suffix_dedup(spark, texts):
    from vellum.llm.suffix_dedup import remove, report

    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 400] for d in data for i in range(len(d) - 399))
    got = {r.doc_id: r for r in report(_docs(spark, texts)).collect()}
    cut = {r.doc_id: r.text for r in remove(_docs(spark, texts)).collect()}
    for k, d in enumerate(data):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - 399):
            if seen[d[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        assert (got[k].n_removed, got[k].kept_sha256) == (gone.sum(), hashlib.sha256(kept).hexdigest())
        assert cut[k] == (None if texts[k] is None else kept.decode("utf-8", "ignore"))


def test_sharding(spark, texts):
    from vellum.llm.sharding import matrix, shard

    rows = shard(_docs(spark, texts), ["doc_id"], 7).collect()
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(rows) == len(texts)
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    m = matrix([10, 0, 25, 7], 5, 1)
    assert [sum(r) for r in m] == [10, 0, 25, 7] and sorted(map(sum, zip(*m, strict=True))) == [8, 8, 8, 9, 9]


def test_quality_rules(spark, texts):
    from vellum.llm.quality_rules import keep, verdicts

    got = {r.doc_id: r for r in verdicts(_docs(spark, texts)).collect()}
    assert len(got) == len(texts) and not got[0].kept and not got[3].kept
    kept = keep(_docs(spark, texts))
    assert kept.columns == _docs(spark, texts).columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.kept}


def test_decontamination(spark, texts):
    from vellum.llm.decontamination import clean, matches

    item = " ".join(f"bench{i}" for i in range(30))
    leaked = [*texts, "before " + item.upper() + " after", "before " + item.replace("bench15", "other") + " after", item[: len(item) // 2]]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in matches(_docs(spark, leaked), bench).collect()}
    n = len(texts)
    assert got == {(n, 1), (3, 4)}  # one word of thirty leaves 21 of 31 shingles: below 0.8
    assert clean(_docs(spark, leaked), bench).count() == len(leaked) - 2


def test_html():
    from vellum.llm.html_text import page_text

    assert page_text("<p>a<p>b<div hidden>c</div><script>d</script><ul><li>x<li>y</ul>") == "a\n\nb\n\n- x\n- y"
    assert page_text("<table><tr><td>long cell<td>b<tr><td>c<td>d</table>") == "long cell  b\nc          d"
    assert page_text("a &amp; b<br>c  d<!-- no -->e") == "a & b\nc de"
    assert page_text(None) == page_text("") == ""


def test_html_tables_keep_misplaced_text():
    from vellum.llm.html_text import page_text

    assert page_text("<table><tr><form><td>x</td><td>y</td></form></tr></table>") == "x  y"
    assert page_text("<table><tr>text<td>x</table>") == "text\nx"
    assert page_text("<table><tr><p>one <b>two</b></p></tr><tr><td>x</table>") == "one two\nx"
    assert page_text("<table><tbody>some <i>text</i> here<tr><td>x</table>") == "some text here\nx"
    assert page_text("<table><tbody><td>x<td>y<tr><td>z</table>") == "x  y\nz"
    assert page_text("<table><td>a<td>b</table>") == "a  b"
    assert page_text("<table><form>Name <tr><td>a<td hidden>no<td>b<tr><td>c</form></table>") == "Name\na  b\nc"
    assert page_text("<table><caption>cap</caption><tr><td>a<table><tr><td>in</table><td>b</table>") == "cap\na   b\nin"


def test_html_of_any_depth():
    from vellum.llm.html_text import page_text

    deep = "<i>" * 5000
    assert page_text(deep + "a<b hidden>no</b><div style='display:none'>no</div> b") == "a\nb".replace("\n", " ")
    assert page_text("<b>" + deep + "<table><tr><td>x<td>y<tr><td>z</table>") == "x  y\nz"
    assert page_text("<div hidden>" + "<div>" * 3000 + "no" + "</div>" * 3000 + "no</div>yes") == "yes"
    assert page_text("<table><tr><td>" * 1500 + "in") == "in" and page_text("<ul><li>" * 300 + "in").endswith("- in")


def test_toxicity(spark):
    from vellum.llm.toxicity import score, train

    rng = random.Random(2)
    texts = [" ".join(rng.choice(["calm", "blue", "tree", "road", "wind"]) for _ in range(20)) + (" vilely" if i % 3 == 0 else "") + f" w{i}" for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    docs = _docs(spark, [*texts, None])
    rows = [r for r in score(docs, train(docs, labels)).collect() if r.doc_id < 300]
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in rows if r.held_out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_empty_tables(spark):
    from vellum.llm import packing, quality_rules, sharding, simhash_dedup, suffix_dedup, token_counts

    none = _docs(spark, ["x"]).filter("doc_id < 0")
    for f in (packing.pack, quality_rules.verdicts, sharding.sharded_documents, simhash_dedup.near_duplicates, suffix_dedup.report, token_counts.token_counts):
        assert f(none).count() == 0


CLASH = ("__c", "__k", "__key", "__html", "__x", "__own", "__t", "__a", "c0", "key", "tag", "page", "component_id", "kept")


def _clashing(spark, texts):
    from pyspark.sql import functions as F

    return _docs(spark, texts).select("*", *[F.lit(7).alias(c) for c in CLASH])


def test_columns_of_clashing_names_stay(spark, texts):
    from vellum.llm import decontamination, html_text, quality_rules, sharding, simhash_dedup, suffix_dedup, token_counts

    docs = _clashing(spark, [*texts[:12], "<p>bench one two three four five six</p>"])
    bench = spark.createDataFrame([(1, "bench one two three four five six")], "item_id long, text string")
    for got in (decontamination.clean(docs, bench), simhash_dedup.one_of_each_group(docs, similarity=None), quality_rules.keep(docs), suffix_dedup.remove(docs)):
        assert got.columns == docs.columns and all(r[c] == 7 for r in got.collect() for c in CLASH)
    assert sharding.shard(docs, ["doc_id"], 3).columns == [*[c for c in docs.columns if c != "shard"], "shard", "slot"]  # the input's own is replaced
    assert sharding.shard(docs, ["doc_id"], 3).filter("__c = 7").count() == docs.count()
    assert html_text.extract(docs, "text", "shown").filter("page = 7 AND __html = 7").count() == docs.count()
    assert token_counts.token_counts(docs).filter("__c = 7").count() == docs.count()


def test_more_empty_tables(spark, tmp_path):
    from vellum.llm import decontamination, html_text, quality_rules, simhash_dedup, suffix_dedup, token_output, toxicity

    docs = _docs(spark, ["x y z"])
    none = docs.filter("doc_id < 0")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert decontamination.matches(none, bench).count() == decontamination.matches(docs, bench.filter("item_id < 0")).count() == 0
    assert decontamination.clean(none, bench).count() == 0 and decontamination.clean(docs, bench.filter("item_id < 0")).count() == 1
    token_output.write_tokens(none, str(tmp_path / "none"))
    assert token_output.read_tokens(spark, str(tmp_path / "none")).count() == 0
    assert html_text.extract(none.select("doc_id", "text"), "text", "t").count() == 0
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    assert simhash_dedup.one_of_each_group(none).count() == quality_rules.keep(none).count() == suffix_dedup.remove(none).count() == 0


def test_lost_and_long_blocks_of_tokens(spark, texts, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from vellum.llm import token_output

    monkeypatch.setattr(token_output, "BLOCK_TOKENS", 500)
    path = str(tmp_path / "t")
    token_output.write_tokens(_docs(spark, texts), path, shards=2)
    blocks = spark.read.parquet(path + "/blocks")
    assert blocks.filter("part").count() > 1
    got = sorted(token_output.read_tokens(spark, path).collect(), key=lambda r: r.key)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens for r in got)
    kept = blocks.filter(~((F.col("shard") == 0) & (F.col("block") == 1)))
    kept.write.parquet(str(tmp_path / "u/blocks"))
    for t in ("table", "shards"):
        spark.read.parquet(f"{path}/{t}").write.parquet(str(tmp_path / "u" / t))
    with pytest.raises(ValueError, match="complete"):
        token_output.read_tokens(spark, str(tmp_path / "u"))


def test_components_both_ways(spark):
    from vellum.llm.simhash_dedup import components

    rng = random.Random(11)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 430)]
    root = list(range(500))
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "a long, b long")
    for limit in (0, 10_000):
        got = {r.node: r.root for r in components(df, task_links=limit).collect()}
        assert all(got.get(i, i) == root[i] for i in range(500))
    with pytest.raises(RuntimeError):
        components(df, most_rounds=1, task_links=0)


def test_suffix_array_of_small_strings(monkeypatch):
    from vellum.llm import suffix_array

    rng = random.Random(2)
    for mean in (256, 0):
        monkeypatch.setattr(suffix_array, "BUCKET_MEAN", mean)
        for _ in range(150):
            n, letters = rng.randint(0, 70), rng.choice([b"a", b"ab", b"abcdefgh"])
            t = np.array([rng.choice(letters) for _ in range(n)] + [0], np.uint16)
            assert suffix_array.suffix_array(t, 256).tolist() == sorted(range(n + 1), key=lambda i: t[i:].tolist())


def test_shards_of_several_buckets(spark, monkeypatch):
    from vellum.llm import sharding

    monkeypatch.setattr(sharding, "CHUNK_ROWS", 5)
    rows = sharding.shard(spark.range(1000), ["id"], 8).collect()
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(125))
    # uniform: the chi-squared statistic of (id range, shard) counts, 7 x 7 degrees of freedom
    seen = Counter((r.id // 125, r.shard) for r in rows)
    assert sum((seen[i, j] - 15.625) ** 2 / 15.625 for i in range(8) for j in range(8)) < 95


def test_html_of_odd_build():
    import time

    from vellum.llm.html_text import page_text

    begun = time.time()
    assert page_text("<a " * 350_000) == "" and page_text("<p>x" + "<a '" * 250_000).startswith("x")
    assert page_text("<script>" + "</script " * 100_000) == ""
    assert page_text("<div>" * 10_000 + "<div hidden>secret</div>ok") == "ok"
    wide = page_text("<table>" + "<tr><td>a<td>b" * 1000 + "<tr><td>" + "z" * 1_000_000 + "</table>")
    assert len(wide) < 1_200_000 and time.time() - begun < 20
    assert page_text("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>") == "ab    c\n1  2  3"
    assert page_text("<table><tr><td rowspan=2>ab<td>c<tr><td>2</table>") == "ab  c\n    2"
    assert page_text("<div style='visibility:hidden'>no<span style='visibility: visible'>yes</span></div>") == "yes"
    assert page_text('a<a href="x>y">l</a> b < c') == "al b < c"


def test_toxicity_learns_pairs(spark):
    from vellum.llm.toxicity import score, train

    rng = random.Random(5)
    texts, toxic = [], {}
    for i in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [rng.choice(["calm", "blue", "tree", "road", "wind"]) for _ in range(12)] + ["alpha"] * a + ["omega"] * b
        rng.shuffle(words)
        texts.append(" ".join(words) + f" u{i}")
        toxic[i] = int(a == b)
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    rows = score(_docs(spark, texts), train(_docs(spark, texts), labels)).filter("held_out").collect()
    assert sum(r.predicted == toxic[r.doc_id] for r in rows) > 0.97 * len(rows)


def test_very_long_text(spark):
    from vellum.llm import packing, quality_rules, simhash_dedup, suffix_dedup, token_counts

    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400_000))
    docs = _docs(spark, [text, text[:900_000], "short one"])
    assert token_counts.token_counts(docs).filter("over_limit").count() == 2
    assert {r.doc_id: r.n for r in packing.pack(docs).groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}[0] > 400_000
    assert simhash_dedup.near_duplicates(docs).count() == quality_rules.verdicts(docs).count() == 3
    got = {r.doc_id: r for r in suffix_dedup.report(docs).collect()}
    assert got[1].n_removed == 900_000 and got[0].n_removed == 900_000


def test_pipeline_end_to_end(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    clean = [text(150) for _ in range(40)]
    passage, item = text(60), text(40)
    near = clean[0].split()
    near[70] = "changed"
    rows = [*clean, clean[1], " ".join(near), None, "", "too short", "again " * 200]
    rows += [f"{text(80)} {passage} {text(80)}" for _ in range(3)] + [f"{text(60)} {item} {text(60)}"]
    docs = _docs(spark, rows).withColumnRenamed("__w", "extra")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    staged, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, now, str(tmp_path))
        made.write.parquet(str(tmp_path / name))
        now = staged[name] = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or now.columns == docs.columns
    of = lambda name: {r.doc_id for r in staged[name].collect()}
    assert of("quality_rules") == set(range(42)) | {46, 47, 48, 49}
    assert of("simhash_near_dedup") == set(range(40)) | {46, 47, 48, 49}
    cut = {r.doc_id: r.text for r in staged["suffix_array_dedup"].collect()}
    assert all(cut[i] == rows[i] for i in range(40)) and all(passage[20:-20] not in cut[i] for i in (46, 47, 48))
    assert of("decontamination") == of("packing") == set(range(40)) | {46, 47, 48}
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(key, staged["packing"].collect()))
    for name in ("documents", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).filter("false").write.parquet(str(tmp_path / f"none/{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
