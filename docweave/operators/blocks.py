"""HTML rows, block order, metrics, sizes and sets of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

ROW, CELL = r"(?is)<tr\b[^>]*>(.*?)</tr>", r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"


def html_rows(html: Column) -> Column:
    """array<array<string>> of cells' plain texts, without rows that have no cell."""
    rows = F.regexp_extract_all(html, F.lit(ROW), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(CELL), F.lit(1)), lambda c: T.plain_text(c)))
    return F.filter(cells, lambda r: F.size(r) > 0)


def padded(rows: Column) -> Column:
    """Rows of equal length, '' added."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def has_text(rows: Column) -> Column:
    return F.exists(F.flatten(rows), lambda x: x != "")


def required_missing(have: Column, required: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, required)), have))


def block_order(blocks: DataFrame, order: str, top: str, index: str) -> list[Column]:
    """Sort keys: blocks with an order come first, by it; the rest by top truncated, then by index."""
    return [F.col(order).isNull(), F.coalesce(F.col(order).cast("long"), F.col(top).cast("long")), F.col(index)]


def page_scale_millionths(width: Column, height: Column) -> Column:
    """Scale of a page of points so that its longer side is at most 11 inches, in millionths, truncated."""
    return F.least(F.lit(1_000_000), F.floor(F.lit(11 * 72 * 1_000_000) / F.greatest(width, height))).cast("long")
