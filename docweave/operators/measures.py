"""Sizes of pages, rows, columns and images, progress of stages, summaries of maps and records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points of an inch, least width of a column and height of a row, least page size.
POINTS, LEAST_COLUMN, LEAST_ROW, LEAST_PAGE = 72.0, 0.2, 6.0, 0.01
#: Progress when a stage of the export is reported.
STAGE_PROGRESS = {
    "text_export_started": 60, "text_layout_started": 60, "page_images_started": 60, "text_export_pages_completed": 90, "text_layout_page_completed": 90,
    "text_layout_completed": 90, "page_images_completed": 90, "ocr_text_started": 90, "ocr_text_completed": 95, "source_pages_completed": 95,
}


def page_inches(points: Column) -> Column:
    return F.greatest(points / POINTS, F.lit(LEAST_PAGE))


def steps(bounds: Column) -> Column:
    """Differences of neighbouring boundaries, at least 0; none for fewer than two."""
    each = F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), lambda i: F.greatest(F.element_at(bounds, i + 1) - F.element_at(bounds, i), F.lit(0.0)))
    return F.when(F.size(bounds) > 1, each).otherwise(F.array().cast("array<double>"))


def column_widths(bounds: Column, available: Column) -> Column:
    """Inches of the columns between boundaries in points, each at least LEAST_COLUMN, then scaled down to what is available."""
    wide = F.transform(steps(bounds), lambda w: F.greatest(w / POINTS, F.lit(LEAST_COLUMN)))
    scale = width_scale(bounds, available)
    return F.transform(wide, lambda w: w * scale)


def width_scale(bounds: Column, available: Column) -> Column:
    total = F.aggregate(F.transform(steps(bounds), lambda w: F.greatest(w / POINTS, F.lit(LEAST_COLUMN))), F.lit(0.0), lambda a, w: a + w)
    return F.least(F.lit(1.0), F.greatest(available, F.lit(LEAST_COLUMN)) / F.greatest(total, F.lit(LEAST_COLUMN)))


def row_heights(bounds: Column, scale: Column) -> Column:
    """Points of the rows between boundaries, scaled, at least LEAST_ROW."""
    return F.transform(steps(bounds), lambda h: F.greatest(h * scale, F.lit(LEAST_ROW)))


def render_scale(width: Column, height: Column, max_pixels: int) -> Column:
    """How large a page is drawn: at most twofold, so that it has at most max_pixels, at least a tenth."""
    return F.greatest(F.least(F.lit(2.0), F.sqrt(F.lit(float(max_pixels)) / F.greatest(width * height, F.lit(1.0)))), F.lit(0.1))


def image_quality(quality: Column) -> Column:
    return F.least(F.greatest(quality, F.lit(1)), F.lit(100))


def stage_progress(stage: Column, before: Column) -> Column:
    """What a stage says, else what it was before."""
    known = F.create_map(*[F.lit(x) for kv in STAGE_PROGRESS.items() for x in kv])
    return F.coalesce(F.get(F.map_values(F.map_filter(known, lambda k, _: k == stage)), F.lit(0)), before)


def page_progress(done: Column, pages: Column) -> Column:
    """Progress while pages are recognised: from 20 to 80."""
    return F.least(F.lit(80), F.lit(20) + F.floor(60 * done / F.greatest(pages, F.lit(1))))


def first_keys(keys: Column, most: int = 20) -> Column:
    """The first keys in order; the report shows no more."""
    return F.slice(F.array_sort(F.array_distinct(keys)), 1, most)


def field(record: Column, name: str, alias: str) -> Column:
    """A field of a map under its name or its alias."""
    return F.coalesce(record[name], record[alias])


def record_summary(record: Column) -> dict[str, Column]:
    """Of a map of texts: its keys in order, how long the markdown is (null without), and its page index as it stands."""
    return {"keys": F.array_sort(F.map_keys(record)), "markdown_chars": F.length(record["markdown"]), "page_index": record["page_index"]}


def ocr_page_stats(texts: Column, scores: Column) -> dict[str, Column]:
    """lines, raw characters (white space included) and the mean score to four places, null without scores."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s)
    return {
        "lines": F.size(texts),
        "chars": F.aggregate(texts, F.lit(0), lambda a, t: a + F.length(t)),
        "mean": F.when(F.size(scores) > 0, F.round(total / F.size(scores), 4)),
    }
