"""Statistics that detectors report beside their hits, by document and merged over a corpus,
and the numbers of their candidates.

Lengths of sentences go into a histogram whose buckets are the same everywhere: up to 32 one a
length, then 16 for each doubling.  Histograms of documents add up to that of a corpus,
whose quantiles are the lower ends of their buckets, at most a sixteenth below.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions.text import CJK, EMOJI, is_ascii, language, length_in, let
from vellum.operators.segment import with_sentences

# What the statistics count.
PATTERNS = {
    "dashes": r"\x{2014}|\x{2013}|--",
    "quotes_straight": "[\"']",
    "quotes_curly": r"[\x{2018}\x{2019}\x{201C}\x{201D}]",
    "quotes_corner": r"[\x{300C}-\x{300F}]",
    "quotes_angle": r"[\x{AB}\x{BB}]",
    "full_width": r"[\x{FF01}-\x{FF5E}\x{3001}\x{3002}]",
    "half_width": CJK + r"[,.!?;:()]",
    "bold": r"\*\*[^*\n]+\*\*|__[^_\n]+__",
    "emoji": EMOJI,
    "hashtags": r"#[^\s#]+",
    "hidden": r"[\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]",
}
#: What an ASCII text has none of, and what a text must hold for a match.
_BEYOND_ASCII = {"quotes_curly", "quotes_corner", "quotes_angle", "full_width", "half_width", "emoji", "hidden"}
_HOLDS = {"bold": ("**", "__"), "hashtags": ("#",)}
QUANTILES = {"p50": 0.5, "p90": 0.9}


def bucket(n: Column) -> Column:
    """The histogram bucket of a length."""
    e = F.greatest(F.length(F.bin(n)) - 5, F.lit(0))
    return (16 * e + F.floor(n / F.pow(F.lit(2.0), e))).cast("int")


def bucket_start(b: Column) -> Column:
    """The least length of a bucket."""
    e = F.greatest(F.floor(b / 16) - 1, F.lit(0))
    return ((b - 16 * e) * F.pow(F.lit(2.0), e)).cast("long")


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang, chars, sentences, a count for each of PATTERNS, mixed_width, histogram (array of
    bucket, n in order).  A sentence's length is in CJK characters or words by the document's
    language; null texts are empty."""
    t = F.coalesce(F.col("__t"), F.lit(""))
    d = with_sentences(docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__t")), "__t", "__s").withColumn("lang", language(t))
    lengths = F.transform("__s", lambda s: bucket(length_in(s["text"], F.col("lang"))))
    # sorted, so that a bucket's number is the distance between two ends
    each = let(F.array_sort(lengths), lambda a: F.transform(F.array_distinct(a), lambda b: F.struct(b.alias("bucket"), F.size(F.filter(a, lambda x: x == b)).cast("long").alias("n"))))

    def count(name: str, pattern: str) -> Column:
        n = F.regexp_count(t, F.lit(pattern))
        if name in _BEYOND_ASCII:
            return F.when(is_ascii(t), F.lit(0)).otherwise(n)
        held = [F.contains(t, F.lit(x)) for x in _HOLDS.get(name, ())]
        return F.when(functools.reduce(Column.__or__, held), n).otherwise(F.lit(0)) if held else n

    counts = [count(n, p).alias(n) for n, p in PATTERNS.items()]
    d = d.select(key, "lang", F.length(t).alias("chars"), F.size("__s").alias("sentences"), *counts, each.alias("histogram"))
    return d.withColumn("mixed_width", (F.col("full_width") > 0) & (F.col("half_width") > 0))


def corpus_statistics(statistics: DataFrame, by: list[str]) -> DataFrame:
    """Totals of document_statistics() by columns of it, and QUANTILES and the longest of the
    sentences, from the sum of all histograms.  A group without sentences has none."""
    # a document is one row of its counts and one for each bucket, so that both sums come from one
    # pass over the texts; the counts are the group's row without a bucket
    counted = ("chars", "sentences", *PATTERNS)
    row = lambda h, *c: F.struct(h["bucket"].alias("bucket"), h["n"].alias("n"), *[x.cast("long").alias(n) for x, n in zip(c, ("documents", *counted, "mixed_width"), strict=True)])
    none = F.lit(None).cast("struct<bucket:int,n:bigint>")
    own = row(none, F.lit(1), *map(F.col, counted), F.col("mixed_width"))
    rows = F.concat(F.array(own), F.transform("histogram", lambda h: row(h, *[F.lit(None)] * (len(counted) + 2))))
    # an inner explode would make Spark compute its array a second time, in a filter below it
    each = statistics.select(*by, F.explode_outer(rows).alias("h")).select(*by, "h.*")
    names = ("documents", *counted, "mixed_width")
    sums = each.groupBy(*by, "bucket").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
    w = Window.partitionBy(*by)
    sums = sums.withColumn("__c", F.sum("n").over(w.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.sum("n").over(w))
    at = [bucket_start(F.min(F.when(F.col("__c") >= F.lit(q) * F.col("__n"), F.col("bucket")))).alias(name) for name, q in QUANTILES.items()]
    return sums.groupBy(*by).agg(*[F.max(c).alias(c) for c in names], *at, bucket_start(F.max("bucket")).alias("longest"))


def numbered_candidates(found: DataFrame, rules: list[str], key: str = "doc_id") -> DataFrame:
    """key, id, sentence, rule, hits: what extract.detected() finds, numbered F1, F2, ... within a
    document by sentence, then in the order of the rules; counts of whole documents come last."""
    order = F.coalesce(*[F.when(F.col("rule") == r, F.lit(i)) for i, r in enumerate(rules)], F.lit(len(rules)))
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.col("sentence").asc_nulls_last(), order, "rule"))
    return found.select(key, F.concat(F.lit("F"), n).alias("id"), "sentence", "rule", "hits")


def candidate_lines(candidates: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, candidates: numbered candidates as the lines of a prompt."""
    place = F.coalesce(F.concat(F.lit("第 "), F.col("sentence"), F.lit(" 句")), F.lit("全文"))
    line = F.concat(F.lit("- "), F.col("id"), F.lit("｜"), F.col("rule"), F.lit("｜"), place, F.lit("｜命中 "), F.col("hits"), F.lit(" 次"))
    rows = candidates.withColumn("__o", F.substring("id", 2, 20).cast("int"))
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__o", line.alias("l")))).alias("a"))
    return g.select(key, F.array_join(F.transform("a", lambda x: x["l"]), "\n").alias("candidates"))
