"""Counting and classification of text, as column expressions."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The counted character ranges and the word pattern.
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
WORD = r"[A-Za-z0-9][A-Za-z0-9'\x{2019}\-]*"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
EXCLAMATION = r"[\x{FF01}!]"
#: Begins a pattern: the character here is no ASCII letter, space or comma.  One look into a table
#: passes over most of a text, where a pattern would try its alternatives.
MARK = rf"(?=[^{string.ascii_letters} ,])"
DASH = r"\x{2014}|\x{2013}|(?<=\S) - (?=\S)|--"
#: WORD as the regex engine is fastest with it: an ASCII class is one look into a table.
_WORD = r"\p{Alnum}[\p{Alnum}'\x{2019}\-]*"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, although lambdas within body read it for each of
    their elements; Spark may compute a column that a lambda reads anew each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def holds(c: Column | str, *parts: str) -> Column:
    """Whether a text has one of the parts: a plain search, far cheaper than a pattern."""
    there = F.contains(F.col(c) if isinstance(c, str) else c, F.lit(parts[0]))
    return there | holds(c, *parts[1:]) if parts[1:] else there


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def is_ascii(c: Column) -> Column:
    """Whether a text has as many bytes as characters."""
    return F.octet_length(_text(c)) == F.length(_text(c))


def count_cjk(c: Column) -> Column:
    return F.when(is_ascii(c), F.lit(0)).otherwise(F.regexp_count(_text(c), F.lit(CJK)))


def count_words(c: Column) -> Column:
    return F.regexp_count(_text(c), F.lit(_WORD))


def _count_where(c: Column, pattern: str, *parts: str) -> Column:
    """Matches of a pattern, looked for only in texts that hold one of the parts that each has."""
    return F.when(holds(c, *parts), F.regexp_count(c, F.lit(pattern))).otherwise(F.when(c.isNotNull(), 0))


def count_emoji(c: Column) -> Column:
    return F.when(F.octet_length(c) == F.length(c), F.lit(0)).otherwise(F.regexp_count(c, F.lit(EMOJI)))


def count_exclamations(c: Column) -> Column:
    return _count_where(c, EXCLAMATION, "!", "！")


def count_dashes(c: Column) -> Column:
    return _count_where(c, DASH, "-", "—", "–")


def language(c: Column) -> Column:
    """zh where CJK characters are at least as many as words, else en."""
    return F.when(count_cjk(c) >= count_words(c), F.lit("zh")).otherwise(F.lit("en"))


def length_in(c: Column, lang: Column) -> Column:
    return F.when(lang == "zh", count_cjk(c)).otherwise(count_words(c))


def occurrences(c: Column, phrase: Column) -> Column:
    """Non-overlapping occurrences of a non-empty phrase."""
    return ((F.length(_text(c)) - F.length(F.replace(_text(c), phrase, F.lit("")))) / F.length(phrase)).cast("int")


def count_phrases(c: Column, phrases: list[str]) -> Column:
    """Sum of the occurrences of all phrases; empty phrases count nothing."""
    total = F.lit(0)
    for p in phrases:
        if p:
            total = total + occurrences(c, F.lit(p))
    return total
