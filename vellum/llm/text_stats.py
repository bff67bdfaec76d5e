"""Word and line statistics of whole texts, as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common

#: Characters counted as symbols (fixed by the rule).
SYMBOLS = "#*$%&|<>"
#: Words of a window whose repeats count.
REPEAT_WINDOW = 5
SPACES = " \t\n\x0b\x0c\r"

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the STATS columns (long); a null text counts as empty.  Columns beginning with
    two underscores are for the steps in between and don't stay."""
    k = REPEAT_WINDOW
    d = docs.withColumn("__t", F.coalesce(F.col(f"`{text}`"), F.lit(""))).withColumn("__w", common.words_of(F.col("__t")))
    d = d.withColumn("__n", F.size("__w"))
    at = F.when(F.col("__n") >= k, F.sequence(F.lit(0), F.col("__n") - k)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("__h", F.transform(at, lambda i: F.xxhash64(*[F.get("__w", i + j) for j in range(k)])))
    # only texts with some repeated window sort their windows
    d = d.withColumn("__rep", F.size(F.array_distinct("__h")) < F.size("__h"))
    d = d.withColumn("__p", F.when(F.col("__rep"), F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    m = F.size("__p")

    def same(p, j):
        before = F.when(j > 0, F.col("__p")[j - 1]["h"] == p["h"]).otherwise(False)
        after = F.when(j < m - 1, F.col("__p")[j + 1]["h"] == p["h"]).otherwise(False)
        return F.when(before | after, p["i"])

    d = d.withColumn("__at", F.when(F.col("__rep"), F.sort_array(F.array_compact(F.transform("__p", same)))))
    cover = F.transform("__at", lambda p, j: F.when(j < F.size("__at") - 1, F.least(F.lit(k), F.try_element_at("__at", j + 2) - p)).otherwise(k))
    d = d.withColumn("n_repeat_words", F.when(F.col("__rep"), F.aggregate(cover, F.lit(0), lambda a, x: a + x)).otherwise(0).cast("long"))
    d = d.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0))
    d = d.withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
    d = d.withColumn("word_chars", F.length(F.array_join("__w", "")).cast("long")).withColumn("n_words", F.col("__n").cast("long"))
    bare = F.col("__t")
    for c in SYMBOLS:  # one byte each: the bytes that go are the symbols
        bare = F.replace(bare, F.lit(c), F.lit(""))
    d = d.withColumn("n_symbols", (F.octet_length("__t") - F.octet_length(bare)).cast("long"))
    return d.select(*[c for c in docs.columns if c not in STATS], *STATS)
