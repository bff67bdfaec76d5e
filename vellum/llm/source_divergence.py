"""Source divergence audit: how the terms of each source differ from those of the others.

Sort-based streaming.  A task sorts the terms of a bounded number of texts by (lang, term,
source, document) and scans the runs: a run over a document counts it once, a run over a source
gives one row with its documents and occurrences.  Those rows are dealt by (lang, term)
and sorted again with the source; a second scan adds up the sources of a term and keeps it
if enough documents hold it.  However frequent, a term sends one row for each source of a run.

Kept terms come as one row with the counts of all their sources.  A scan over them turns
counts into shares in blocks of terms by sources and emits, run by run, partial sums of
the differences of each pair of sources and the foremost terms that each source has more of;
a last sorted scan puts those of a source together.

All arithmetic is in integers.  What is broadcast is the table of (lang, source) groups, at most
common.BROADCAST_ROWS of them at once (more are taken language by language; a language's own
groups are as many as the square root of the rows that the result has of it).
"""

from __future__ import annotations

import collections

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.llm import common

#: A term that fewer documents of a language hold isn't kept; what is added to each count.
LEAST_DOCUMENTS, ADDED = 30, 5
#: Shares are in units of one in UNIT; terms are listed up to rank MOST_TERMS.
UNIT, MOST_TERMS = 1_000_000_000, 50
#: Terms of a sorted run, and bytes of text that are cut into terms at once.
RUN, SLICE = 1 << 22, 1 << 22
#: Counts of a block of terms by sources, and sources on a side of a task's sums of pairs.
CELLS, TILE = 1 << 21, 1024

#: Letters are lowered and bytes above ASCII stay; all else separates terms.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))
_RUN_ROW = "lang string, term string, source string, docs long, n long"
_TERM_ROW = "lang string, term string, sources array<string>, counts array<long>"
_PART_ROW = "part string, lang string, source string, tile int, items array<string>, sums array<long>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def _counted(text: bytes) -> collections.Counter:
    """The terms of a very long text, slice by slice."""
    out: collections.Counter = collections.Counter()
    rest = b""
    for i in range(0, len(text), SLICE):
        piece = rest + text[i : i + SLICE].translate(_BYTES)
        cut = len(piece) if i + SLICE >= len(text) else piece.rfind(b" ") + 1
        rest = piece[cut:]
        out.update(piece[:cut].split())
    return out


def _long(lang: str, source: str, text: bytes):
    """A run of one very long text."""
    got = sorted(_counted(text).items())
    if got:
        terms, n = pa.array([t for t, _ in got], pa.binary()).cast(pa.string()), pa.array([c for _, c in got], pa.int64())
        same = lambda x, kind: pa.array([x] * len(got), kind)
        yield pa.RecordBatch.from_arrays([same(lang, pa.string()), terms, same(source, pa.string()), same(1, pa.int64()), n], ["lang", "term", "source", "docs", "n"])


def _starts(*columns) -> np.ndarray:
    """Where the rows of sorted columns begin to differ from the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        if isinstance(c, np.ndarray):
            new[1:] |= c[1:] != c[:-1]
        elif len(c) > 1:
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _ranked(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values sorted, and the rank of each."""
    order = pc.sort_indices(values).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return values.take(pa.array(order)), rank


def _run(chunks: list[pa.Array], of: list[tuple[str, str]], sizes: list[int]):
    """One sorted run: tokens in chunks, and each document's (lang, source) and number of tokens."""
    tokens = pa.chunked_array(chunks).unify_dictionaries()
    terms, rank = _ranked(tokens.chunk(tokens.num_chunks - 1).dictionary)  # each chunk's dictionary begins the last one
    term = rank[np.concatenate([c.indices.to_numpy() for c in tokens.chunks])]
    groups = sorted(set(of))
    place = {g: i for i, g in enumerate(groups)}
    langs = {x: i for i, x in enumerate(sorted({lang for lang, _ in groups}))}
    doc_group = np.array([place[g] for g in of])
    group = np.repeat(doc_group, sizes)
    lang = np.array([langs[x] for x, _ in groups])[group]
    # by lang, term, group (source within lang), document: one number where it fits
    doc = np.repeat(np.arange(len(of)), sizes)
    spans = (len(langs), len(terms), len(groups), len(of))
    if np.prod([float(s) for s in spans]) < 2**62:
        key = np.sort(((lang * spans[1] + term) * spans[2] + group) * spans[3] + doc)
        key, doc = np.divmod(key, spans[3])
        key, group = np.divmod(key, spans[2])
        term = key % spans[1]
    else:
        order = np.lexsort((doc, group, term, lang))
        term, group, doc = term[order], group[order], doc[order]
    each_doc = _starts(term, group, doc)
    each = _starts(term, group)
    docs = np.diff(np.append(np.searchsorted(each_doc, each), len(each_doc)))
    n = np.diff(np.append(each, len(term)))
    names = [pa.array([g[i] for g in groups], pa.string()) for i in (0, 1)]
    at = pa.array(group[each])
    return pa.RecordBatch.from_arrays([names[0].take(at), terms.take(pa.array(term[each])).cast(pa.string()), names[1].take(at), pa.array(docs), pa.array(n)], ["lang", "term", "source", "docs", "n"])


def _runs(most: int):
    """Batches of (lang, source, text) -> rows of sorted runs of about `most` terms."""

    def run(batches):
        chunks, of, sizes, total = [], [], [], 0
        for b in batches:
            lang, source = b.column(0).to_pylist(), b.column(1).to_pylist()
            tokens: list[bytes] = []
            for i, text in enumerate(b.column(2).cast(pa.binary())):
                text = text.as_py()
                if len(text) > 4 * SLICE:
                    yield from _long(lang[i], source[i], text)
                    continue
                got = terms_of(text)
                if got:
                    tokens += got
                    of.append((lang[i], source[i]))
                    sizes.append(len(got))
            if tokens:
                chunks.append(pa.array(tokens, pa.binary()).dictionary_encode())
                total += len(tokens)
            if total >= most:
                yield _run(chunks, of, sizes)
                chunks, of, sizes, total = [], [], [], 0
        if total:
            yield _run(chunks, of, sizes)

    return run


def _merged(least: int):
    """Batches sorted by (lang, term, source) -> one row for each kept term."""

    def summed(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        at = _starts(t["lang"], t["term"], t["source"])
        sums = {c: pa.array(np.add.reduceat(t[c].to_numpy(), at)) for c in ("docs", "n")}
        return pa.table({c: t[c].take(pa.array(at)) for c in ("lang", "term", "source")} | sums)

    def kept(t: pa.Table):
        at = _starts(t["lang"], t["term"])
        docs = np.add.reduceat(t["docs"].to_numpy(), at)
        size = np.diff(np.append(at, len(t)))
        held = docs >= least
        rows = pa.array(np.repeat(held, size))
        of = t.filter(rows).combine_chunks()
        ends = pa.array(np.append(0, np.cumsum(size[held])).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, of[c].combine_chunks() if of.num_rows else pa.array([], k)) for c, k in (("source", pa.string()), ("n", pa.int64()))]
        first = pa.array(at[held])
        table = pa.table({"lang": t["lang"].take(first), "term": t["term"].take(first), "sources": lists[0], "counts": lists[1]})
        return table.combine_chunks().to_batches()

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = summed(t if rest is None else pa.concat_tables([rest, t]))
            cut = int(_starts(t["lang"], t["term"])[-1])  # the last term may go on
            rest = t.slice(cut)
            if cut:
                yield from kept(t.slice(0, cut))
        if rest is not None:
            yield from kept(rest)

    return run


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS, run: int = RUN) -> DataFrame:
    """lang, term, sources, counts of every kept term, from docs(lang, source, text) without nulls."""
    common.ship(docs.sparkSession)
    runs = docs.select("lang", "source", "text").mapInArrow(_runs(run), _RUN_ROW)
    dealt = runs.repartition(common.partitions(docs), "lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.mapInArrow(_merged(least), _TERM_ROW)


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (counts + ADDED) / total), by long division in thousands: exact for
    totals up to 9 * 10^15, which hold every count."""
    p, rest = np.divmod(counts + ADDED, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        p = p * 1000 + digit
    return p + 1


def _rows(found: list[tuple]) -> pa.RecordBatch:
    """(part, lang, source, tile, items, sums) as a batch of _PART_ROW."""
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["part", "lang", "source", "tile", "items", "sums"])


def _audited(shared, a: int, b: int, tile: int):
    """Batches of kept terms -> for each source of tile a the partial sums with those of tile b in
    their order, and, where both are one, its foremost terms of a block."""

    def block(lang, terms, counts, sums):
        order = sorted(range(len(terms)), key=lambda i: terms[i].encode())  # a block may hold the ends of two files
        terms, counts = [terms[i] for i in order], counts[order]
        names, n, v = shared.value[lang]
        p = shares(counts, n + ADDED * v)
        x, y = p[:, a * tile : (a + 1) * tile], p[:, b * tile : (b + 1) * tile]
        for s in range(x.shape[1]):
            sums[s] += np.abs(y - x[:, s : s + 1]).sum(axis=0)
        if a == b:
            q = shares(counts.sum(axis=1), int(n.sum()) + ADDED * v)
            found = []
            more = (counts[:, a * tile : (a + 1) * tile] > 0) & (x > q[:, None])
            for s in np.flatnonzero(more.any(axis=0)):
                at = np.flatnonzero(more[:, s])
                f = x[at, s] - q[at]
                if len(at) > MOST_TERMS:  # of a block no more can be among the first; terms are in order
                    best = np.argsort(-f, kind="stable")[:MOST_TERMS]
                    at, f = at[best], f[best]
                found.append(("term", lang, names[a * tile + s], a, [terms[i] for i in at], f))
            if found:
                yield _rows(found)

    def pairs(lang, sums):
        names = shared.value[lang][0]
        if sums.size:
            yield _rows([("pair", lang, names[a * tile + s], b, None, own) for s, own in enumerate(sums)])

    def run(batches):
        lang = terms = counts = sums = None
        for batch in batches:
            for key, term, sources, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key not in shared.value:
                    continue
                names = shared.value[key][0]
                if key != lang or len(terms) >= max(1, CELLS // len(names)):
                    if terms:
                        yield from block(lang, terms, np.array(counts), sums)
                    if key != lang:
                        if lang is not None:
                            yield from pairs(lang, sums)
                        size = [len(names[t * tile : (t + 1) * tile]) for t in (a, b)]
                        lang, sums, place = key, np.zeros(size, np.int64), {s: i for i, s in enumerate(names)}
                    terms, counts = [], []
                row = [0] * len(names)
                for s, c in zip(sources, n, strict=True):
                    row[place[s]] = c
                terms.append(term)
                counts.append(row)
        if lang is not None:
            yield from block(lang, terms, np.array(counts), sums)
            yield from pairs(lang, sums)

    return run


def _gathered(shared, tile: int):
    """Batches sorted by (part, lang, source, tile) -> one row for each: the sums with the
    sources that follow in name, or the MOST_TERMS foremost terms."""

    def closed(key, items, sums):
        part, lang, source, b = key
        if part == "pair":
            names = shared.value[lang][0]
            items = names[b * tile : (b + 1) * tile]
            own = [i for i, s in enumerate(items) if s.encode() > source.encode()]
            return part, lang, source, b, [items[i] for i in own], [int(sums[i]) for i in own]
        return part, lang, source, b, items, sums

    def run(batches):
        key = items = sums = None
        for batch in batches:
            done = []
            for part, lang, source, b, terms, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part, lang, source, b) != key:
                    if key is not None:
                        done.append(closed(key, items, sums))
                    key, items, sums = (part, lang, source, b), terms, np.array(values) if part == "pair" else values
                elif part == "pair":
                    sums = sums + np.array(values)
                else:
                    best = sorted(zip(items + terms, sums + values, strict=True), key=lambda x: (-x[1], x[0].encode()))[:MOST_TERMS]
                    items, sums = [t for t, _ in best], [v for _, v in best]
            if done:
                yield _rows(done)
        if key is not None:
            yield _rows([closed(key, items, sums)])

    return run


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, tile: int = TILE, run: int = RUN) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank.

    Null texts, languages and sources are empty ones.  Every row is a document, repeated rows
    too.  A group whose language keeps no term has its pairs with value 0.  A source that is
    alone in its language has no pairs.  An empty table gives no rows; other columns play no part.
    """
    spark = docs.sparkSession
    base = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    terms = common.stage(kept_terms(base, least, run), "terms")
    n = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    v = terms.groupBy("lang").agg(F.count("*").alias("v"))
    groups = base.select("lang", "source").distinct().join(n, ["lang", "source"], "left").join(v, "lang", "left").na.fill(0, ["n", "v"])
    groups = common.stage(groups, "groups")
    slices = -(-groups.count() // common.BROADCAST_ROWS)
    own = F.pmod(F.xxhash64("lang"), F.lit(max(1, slices)))
    parts = []
    for i in range(slices):
        table: dict[str, list] = collections.defaultdict(list)
        for r in groups.filter((own == i) & (F.col("v") > 0)).collect():
            table[r["lang"]].append((r["source"], r["n"], r["v"]))
        facts = {}
        for key, of in table.items():
            of.sort(key=lambda x: x[0].encode())
            facts[key] = ([s for s, _, _ in of], np.array([c for _, c, _ in of], np.int64), of[0][2])
        shared = spark.sparkContext.broadcast(facts)
        tiles = -(-max((len(f[0]) for f in facts.values()), default=0) // tile)
        keys = ("part", "lang", "source", "tile")
        for a, b in ((a, b) for b in range(tiles) for a in range(b + 1)):
            dealt = terms.mapInArrow(_audited(shared, a, b, tile), _PART_ROW).repartition(common.partitions(base), *keys).sortWithinPartitions(*keys)
            parts.append(dealt.mapInArrow(_gathered(shared, tile), _PART_ROW).select("part", "lang", "source", F.explode(F.arrays_zip("items", "sums")).alias("x")).select("part", "lang", "source", F.col("x.items").alias("item"), F.col("x.sums").alias("value")))
    g = groups.filter("v = 0")
    none = g.select("lang", "source").join(g.select("lang", F.col("source").alias("item")), "lang").filter("source < item")
    rows = none.select(F.lit("pair").alias("part"), "lang", "source", "item", F.lit(0).cast("long").alias("value"))
    for p in parts:
        rows = rows.unionByName(p)
    rows = common.stage(rows, "divergence")
    columns = ("lang", "source", "part", "item", "value")
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pair = rows.filter("part = 'pair'").select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    term = rows.filter("part = 'term'").select(*columns).withColumn("rank", rank).filter(F.col("rank") <= MOST_TERMS)
    return pair.withColumn("rank", rank).unionByName(term)


def oracle_sql(table: str = "documents") -> str:
    """The same by grouping and by joining every term with every group of its language."""
    upper, lower = common.UPPER, common.LOWER
    share = lambda c, n: f"CAST(1 + ({UNIT}::HUGEINT * ({c} + {ADDED})) // ({n} + {ADDED} * v) AS BIGINT)"
    return rf"""WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM {table}),
o AS MATERIALIZED (SELECT d, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT d) >= {LEAST_DOCUMENTS}),
g AS MATERIALIZED (SELECT lang, source, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, count(*) AS v FROM k GROUP BY ALL) USING (lang)),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM o JOIN k USING (lang, term) GROUP BY ALL),
f AS MATERIALIZED (SELECT lang, source, term, v, coalesce(c, 0) AS c FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS MATERIALIZED (SELECT lang, source, term, c, {share('c', 'sum(c) OVER (PARTITION BY lang, source)')} AS p FROM f),
q AS (SELECT lang, term, {share('c', 'sum(c) OVER (PARTITION BY lang)')} AS q FROM (SELECT lang, term, v, sum(c) AS c FROM f GROUP BY ALL)),
pair AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
 UNION ALL SELECT a.lang, a.source, b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
 UNION ALL SELECT lang, source, 'term', term, p - q, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= {MOST_TERMS}"""
