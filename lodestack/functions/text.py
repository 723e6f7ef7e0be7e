"""Text predicates, counts, previews and pages.  Offsets are code points, ends exclusive."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points shown before a match, and from its start to the end of its line.
BEFORE, AFTER = 60, 180
#: Code points of a literal shown inline.
LITERAL_PREVIEW = 4096
#: Bounds and default of a text page.
PAGE_MOST, PAGE_DEFAULT = 128_000, 32_000


def pattern(query: str, regex: bool = False, case_sensitive: bool = True) -> str:
    """A Java pattern for a query; case-insensitive ones fold all of Unicode."""
    if regex and re.search(r"\(\?[=!<]|\\[1-9]", query):
        raise ValueError("look-around and back references are not in the dialect")
    body = query if regex else re.sub(r"([^\w\s])", r"\\\1", query)
    return body if case_sensitive else f"(?iu){body}"


def contains(text: Column, query: str, regex: bool = False, case_sensitive: bool = True) -> Column:
    """Whether the query occurs; a plain literal stays a `contains`, which Parquet and Catalyst know."""
    if not regex and case_sensitive:
        return text.contains(query)
    return text.rlike(pattern(query, regex, case_sensitive))


def count_literal(text: Column, query: str) -> Column:
    """How often a literal occurs without overlap."""
    if not query:
        raise ValueError("empty query")
    shorter = F.length(F.replace(text, F.lit(query), F.lit("")))
    return F.floor((F.length(text) - shorter) / len(query)).cast("long")


def count_matches(text: Column, query: str, regex: bool = True, case_sensitive: bool = True) -> Column:
    """How often a pattern matches; matches of no characters do not count."""
    found = F.regexp_extract_all(text, F.lit(pattern(query, regex, case_sensitive)), F.lit(0))
    return F.size(F.filter(found, lambda m: m != "")).cast("long")


def whole_word(text: Column, word: str) -> Column:
    """How often a word occurs with no word character on either side (Unicode letters, digits, underscore)."""
    guarded = r"(?U)(?<!\w)" + re.sub(r"([^\w\s])", r"\\\1", word) + r"(?!\w)"
    return F.size(F.regexp_extract_all(text, F.lit(guarded), F.lit(0))).cast("long")


def line_count(text: Column) -> Column:
    """Lines as an editor counts them: a final line break does not begin one."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.length(text) == 0, 0).otherwise(breaks + F.when(text.endswith("\n"), 0).otherwise(1)).cast("long")


def literal_preview(value: Column, most: int = LITERAL_PREVIEW) -> Column:
    """struct(preview, value_chars, value_truncated)."""
    size = F.length(value).cast("long")
    return F.struct(F.substring(value, 1, most).alias("preview"), size.alias("value_chars"), (size > most).alias("value_truncated"))


def text_page(text: Column, offset: int = 0, limit: int = PAGE_DEFAULT) -> Column:
    """struct(page, total_chars, next_offset): code points [offset, offset + limit)."""
    if not 1 <= limit <= PAGE_MOST or offset < 0:
        raise ValueError(f"limit must be 1 to {PAGE_MOST}, offset not negative")
    total = F.length(text).cast("long")
    return F.struct(
        F.substring(text, offset + 1, limit).alias("page"),
        total.alias("total_chars"),
        F.when(total > offset + limit, F.lit(offset + limit).cast("long")).alias("next_offset"),
    )


def xml_escape(text: Column) -> Column:
    # The five characters that XML escapes, the ampersand first.
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text
