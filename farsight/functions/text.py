"""Trimming, blank tests, case-insensitive distinct, clipping, ratios."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Fixed value: every character counted as white space when trimming.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regex character class body.
WS = r"\s\x0B\x{85}\p{Z}"

# Clip sizes in characters.
DOCUMENT_CHARS = 24000
EXEMPLAR_CHARS = 1200
BLOCK_CHARS = 48000
ITEM_CHARS = 2000
TRUNCATED = "\n[...truncated...]"
NO_TEXT = "(no text available)"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once per row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def trim_ws(c: Column) -> Column:
    """Trims all white space, not only blanks."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(trim_ws(c) == "", F.lit(True))


def trim_to_null(c: Column) -> Column:
    return F.nullif(trim_ws(c), F.lit(""))


def fold(c: Column) -> Column:
    """Key for case-insensitive comparison of trimmed text."""
    return F.lower(trim_ws(c))


def collapse_ws(c: Column) -> Column:
    return trim_ws(F.regexp_replace(c, f"[{WS}]+", " "))


def distinct_ignore_case(items: Column) -> Column:
    """Distinct array elements ignoring case; first spelling wins, order kept."""

    def firsts(values: Column, folded: Column) -> Column:
        return F.transform(
            F.array_distinct(folded),
            lambda k: F.element_at(values, F.array_position(folded, k).cast("int")),
        )

    return once(items, lambda values: once(F.transform(values, F.lower), lambda f: firsts(values, f)))


def split_list(c: Column) -> Column:
    """Comma list to trimmed, non-empty, distinct (ignoring case) parts; blank gives []."""
    parts = F.filter(F.transform(F.split(c, ","), trim_ws), lambda x: x != "")
    return F.coalesce(distinct_ignore_case(parts), F.array().cast("array<string>"))


def head_clip(c: Column, max_chars) -> Column:
    """The first ``max_chars`` characters (an int or a column)."""
    n = max_chars if isinstance(max_chars, Column) else F.lit(max_chars)
    return F.when(F.length(c) > n, F.substring(c, F.lit(1), n)).otherwise(c)


def document_clip(c: Column, max_chars: int = DOCUMENT_CHARS) -> Column:
    """Trimmed text cut to a document budget with a marker; blank gives a note."""
    t = trim_ws(c)
    return (
        F.when(is_blank(c), F.lit(NO_TEXT))
        .when(F.length(t) <= max_chars, t)
        .otherwise(F.concat(F.substring(t, 1, max_chars), F.lit(TRUNCATED)))
    )


def text_budget(n_items: Column, total: int = BLOCK_CHARS, least: int = ITEM_CHARS) -> Column:
    """Characters each of ``n_items`` texts may take of ``total``; never under ``least``."""
    share = F.floor(F.lit(total) / F.greatest(F.lit(1), n_items))
    return F.greatest(F.lit(least), share).cast("int")


def ratio(part: Column, whole: Column, empty: float) -> Column:
    """``part / whole`` as a double, ``empty`` where ``whole`` is zero."""
    return F.when(whole == 0, F.lit(empty)).otherwise(
        part.cast("double") / F.nullif(whole, F.lit(0)).cast("double")
    )


def percent(c: Column) -> Column:
    return F.format_string("%.0f%%", c.cast("double") * 100)


def fallback_query(keywords: Column, name: Column, jurisdiction: Column) -> Column:
    """Deterministic query: first keyword (else the group name), jurisdiction, 'update'."""
    return F.concat_ws(
        " ", F.coalesce(F.try_element_at(keywords, F.lit(1)), name), jurisdiction, F.lit("update")
    )
