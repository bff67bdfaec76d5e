"""Numbered sentences: lines, sentence ends, paragraphs and separators, in one pass over a text.

Regular expressions put marks where a sentence with its separator and where a paragraph ends;
the text is split at them into one array for each document, so neither a window nor an
exchange is needed.  Under a star stand character classes only: alternations and groups
there overflow the regex engine's stack on long lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import MARK, holds

#: Unicode noncharacters: the end of a sentence with its separator, of a paragraph, and the
#: begin of a line that is one placeholder.
_SEP, _PARAGRAPH, _ALONE = "\ufdd0", "\ufdd1", "\ufdd2"
_MARKS = _SEP + _PARAGRAPH + _ALONE
# What ends a sentence, what its end takes in, and white space in Unicode.
_ENDS, _SWALLOW = "。！？!?", r"”」』）\"')\]。！？!?"
_SPACE = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_LINE = r"(?<![^\n])"
_FIRST = rf"\A(?:[{_SPACE}]*\n)?[ \t]*"
_PLACEHOLDER = rf"{_LINE}([ \t]*+)(?=⟦[A-Z]+-[0-9]+⟧[ \t]*+(?:\n|\z))"
_HEADING = rf"{_LINE}[ \t]*#[^\n]*"
_SENTENCE = rf"{MARK}(?:[{_ENDS}]|\.(?=[{_SPACE}]|\z))[{_SWALLOW}]*+[ \t]*+"
#: Line ends: those at the end of the text, over blank lines, or one.
_GAP = rf"\n(?:[{_SPACE}]*\z|[{_SPACE}]*\n[ \t]*|[ \t]*)"
_BREAK = rf"(\n[{_SPACE}]*\n[ \t]*){_SEP}"
#: The array of with_sentences().
SENTENCES = "array<struct<text:string,sep:string,paragraph:int,protected:boolean>>"


def with_sentences(docs: DataFrame, text: str = "text", name: str = "sentences") -> DataFrame:
    """docs with an array of its sentences, by id from 1: text, sep, paragraph, protected.

    Blank lines end a paragraph; a line that is a placeholder or begins with # is one
    sentence.  Leading white space of a line belongs to the separator of the sentence before
    it; that of the first line is dropped.  A document of white space only is one empty
    sentence; null and empty documents have none.  CRLF is read as LF.  The noncharacters
    U+FDD0 to U+FDD2 are dropped.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    t = F.when(holds(t, "\r"), F.replace(t, F.lit("\r\n"), F.lit("\n"))).otherwise(t)
    d = docs.withColumn("__whole", t).withColumn("__whole", F.when(holds("__whole", *_MARKS), F.translate("__whole", _MARKS, "")).otherwise(F.col("__whole")))
    blank = F.substring("__whole", 1, 1).rlike(f"[{_SPACE}]")
    d = d.withColumn("__marked", F.when(blank, F.regexp_replace("__whole", _FIRST, "")).otherwise(F.col("__whole")))
    d = d.withColumn("__marked", F.when(F.contains("__marked", F.lit("⟦")), F.regexp_replace("__marked", _PLACEHOLDER, f"$1{_ALONE}")).otherwise(F.col("__marked")))
    # the heading's pattern looks at every line's begin: only where a text has a #
    marked = lambda pattern: F.regexp_replace("__marked", pattern, f"$0{_SEP}")
    # a line's end belongs to its last sentence; a heading must be passed over whole, so its mark goes again
    headed = F.replace(marked(f"{_HEADING}|{_SENTENCE}"), F.lit(f"{_SEP}\n"), F.lit("\n"))
    d = d.withColumn("__marked", F.when(F.contains("__marked", F.lit("#")), headed).otherwise(marked(rf"{_SENTENCE}(?!\n)")))
    # the pattern begins with a fixed character, which is found fast
    s = F.regexp_replace(F.regexp_replace("__marked", _GAP, f"$0{_SEP}"), _BREAK, f"$1{_PARAGRAPH}")

    def cut(x: Column) -> Column:
        # a step of its own, as Spark would compute the body anew for each field that reads it
        return F.struct(x.alias("x"), F.rtrim(F.substring_index(x, "\n", 1), F.lit(" \t")).alias("body"))

    def sentence(c: Column, paragraph: Column) -> Column:
        x, body = c["x"], c["body"]
        alone = body.startswith(_ALONE)  # that mark stands nowhere but at a sentence's begin
        return F.struct(F.when(alone, F.replace(body, F.lit(_ALONE), F.lit(""))).otherwise(body).alias("text"), F.substr(x, F.length(body) + 1).alias("sep"), (paragraph + 1).alias("paragraph"), alone.alias("protected"))

    found = F.transform(F.split(s, _PARAGRAPH), lambda p, i: F.transform(F.transform(F.filter(F.split(p, _SEP), lambda x: x != ""), cut), lambda c: sentence(c, i)))
    space = F.struct(F.lit("").alias("text"), F.col("__whole").alias("sep"), F.lit(1).alias("paragraph"), F.lit(False).alias("protected"))
    whole = F.when(F.col("__whole") == "", F.array().cast(SENTENCES)).when(F.col("__whole").rlike(r"(?U)\S"), F.flatten(found)).otherwise(F.array(space))
    return d.withColumn(name, whole.cast(SENTENCES)).drop("__whole", "__marked")


def exploded(docs: DataFrame, key: str = "doc_id", name: str = "sentences") -> DataFrame:
    """key, id, text, sep, paragraph, protected from the array of with_sentences()."""
    # an inner explode would make Spark compute its array a second time, in a filter below it
    rows = docs.select(F.col(f"`{key}`").alias(key), F.posexplode_outer(name).alias("id", "__x")).filter("id IS NOT NULL")
    return rows.select(key, (F.col("id") + 1).alias("id"), "__x.text", "__x.sep", "__x.paragraph", "__x.protected")


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, id, text, sep, paragraph, protected: the numbered sentences of every document,
    ids from 1 through all paragraphs; see with_sentences()."""
    return exploded(with_sentences(docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__body")), "__body"), key)


def first_line(text: Column) -> Column:
    """A text to the end of its first line that isn't blank; its first sentence is the text's."""
    return F.regexp_extract(text, rf"\A[{_SPACE}]*[^\n]*\n?", 0)


def joined_text(array: Column) -> Column:
    """The sentences of an array with their separators put together again."""
    return F.array_join(F.transform(array, lambda x: F.concat(x["text"], x["sep"])), "")


def numbered_text(array: Column) -> Column:
    """`[n] text` lines with an empty line between paragraphs."""
    new = lambda x, i: F.when(x["paragraph"] != F.get(array, i - 1)["paragraph"], "\n").otherwise("")
    return F.array_join(F.transform(array, lambda x, i: F.concat(new(x, i), F.lit("["), i + 1, F.lit("] "), x["text"])), "\n")


def gathered(sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, sentences: the array of with_sentences() from a table of sentences."""
    rows = F.array_sort(F.collect_list(F.struct("id", "text", "sep", "paragraph", "protected")))
    return sents.groupBy(key).agg(rows.alias("__s")).select(key, F.transform("__s", lambda x: F.struct(*[x[c].alias(c) for c in ("text", "sep", "paragraph", "protected")])).cast(SENTENCES).alias("sentences"))


def joined(sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text: a table of sentences put together again."""
    return gathered(sents, key).select(key, joined_text(F.col("sentences")).alias("text"))


def numbered(sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, numbered: a table of sentences as numbered_text()."""
    return gathered(sents, key).select(key, numbered_text(F.col("sentences")).alias("numbered"))
