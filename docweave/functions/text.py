"""Text normalisation, counts and predicates as Spark columns."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


@lru_cache
def glyph_table() -> tuple[str, str]:
    """Arguments of translate(): mathematical letters to their plain forms, odd glyphs, NUL to nothing."""
    table = dict(P.GLYPHS)
    for point in range(sys.maxunicode + 1):
        c = chr(point)
        if "MATHEMATICAL" in unicodedata.name(c, ""):
            plain = unicodedata.normalize("NFKC", c)
            if plain != c and len(plain) == 1:
                table.setdefault(c, plain)
    return "".join(table) + "\0", "".join(table.values())


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize(c: Column) -> Column:
    """Plain glyphs; each line with single blanks, without blanks at its ends; no empty lines."""
    source, target = glyph_table()
    lines = F.split(F.translate(c, source, target), P.LINE_BREAK)
    clean = F.transform(lines, lambda x: strip(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(clean, lambda x: x != ""), "\n")


def compact(c: Column) -> Column:
    return F.regexp_replace(normalize(F.regexp_replace(c, "\r", "\n")), "\n", " ")


def visible_chars(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"(?U)\s+", ""))


def garbled_chars(c: Column) -> Column:
    return F.regexp_count(c, F.lit(P.GARBLED))


def url_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(P.URL))


def url_chars(c: Column) -> Column:
    return F.aggregate(F.regexp_extract_all(c, F.lit(P.URL), F.lit(0)), F.lit(0), lambda n, x: n + F.length(x))


def plain_text(c: Column) -> Column:
    """Without tags, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, P.TAG, " "), r"[ \t\r\n]+", " "))


def terminal(c: Column) -> Column:
    return c.rlike(P.TERMINAL)


def needs_space(previous: Column, current: Column) -> Column:
    """Whether a blank goes between two lines that are joined."""
    last, first = F.right(previous, F.lit(1)), F.left(current, F.lit(1))
    both = last.rlike("^[A-Za-z0-9]$") & first.rlike("^[A-Za-z0-9]$")
    return (previous != "") & (current != "") & (last.rlike("^[-+=*/≤≥≈]$") | both)


def formula(c: Column) -> Column:
    body = c.rlike(P.FORMULA_START) & c.rlike("[=≤≥≈]") & c.rlike("[A-Za-zα-ωΑ-Ω][₀-₉]?")
    return c.rlike(P.FORMULA_WORD) | c.rlike(P.FORMULA_SYMBOL) | body


def safe_name(c: Column) -> Column:
    """The last part of a path with everything but word characters, dots and dashes replaced."""
    base = F.regexp_replace(F.substring_index(F.regexp_replace(c, "/+$", ""), "/", -1), P.UNSAFE_NAME, "_")
    return F.when(F.coalesce(base, F.lit("")) == "", "input.pdf").otherwise(base)
