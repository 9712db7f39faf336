"""Text rules as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabveil.roles import NULL_TOKEN, SHORT_REST_TOKEN, TITLES

# Every character that counts as white space, which is more than
# the plain space that trim() removes by default.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def as_text(column: Column) -> Column:
    """Any value as text, null as the category ``NULL``."""
    return F.coalesce(column.cast("string"), F.lit(NULL_TOKEN))


def normalized(column: Column) -> Column:
    """Trimmed, upper-cased text; null and ``NAN`` become ``NULL``."""
    text = F.upper(F.trim(column.cast("string"), F.lit(WHITESPACE)))
    return F.coalesce(F.nullif(text, F.lit("NAN")), F.lit(NULL_TOKEN))


def contains_flag(column: Column, needle: str, excluding: str | None = None) -> Column:
    """1 if the upper-cased text contains ``needle``, else 0 (null gives 0).

    With ``excluding``, a text that also contains that word gives 0; the bare
    rule is true for "NÃO ELEITO" when asked for "ELEITO".
    """
    text = F.upper(column.cast("string"))
    hit = text.contains(needle)
    if excluding is not None:
        hit = hit & ~text.contains(excluding)
    return F.coalesce(hit, F.lit(False)).cast("int")


def collapse_two_way(column: Column, needle: str, label: str, rest: str = SHORT_REST_TOKEN) -> Column:
    """``label`` if the text contains ``needle``, else ``rest``."""
    return F.when(F.upper(column.cast("string")).contains(needle), label).otherwise(rest)


def title_flag(column: Column, titles: Sequence[str] = TITLES, whole_word: bool = False) -> Column:
    """1 if the name carries one of the titles.

    The default looks for substrings, so "DR" is found in "PEDRO";
    ``whole_word`` asks for the title as a word of its own.
    """
    body = "|".join(titles)
    if whole_word:
        # Spelled-out borders, because \\b treats accented letters as borders.
        body = rf"(^|[^\p{{L}}\p{{N}}])({body})([^\p{{L}}\p{{N}}]|$)"
    return F.coalesce(F.upper(column.cast("string")).rlike(body), F.lit(False)).cast("int")


def text_length(column: Column, null_length: int = 0) -> Column:
    """Characters of the text; a null counts as ``null_length``."""
    return F.coalesce(F.length(column.cast("string")), F.lit(null_length))
