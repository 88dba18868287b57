"""Tables: bands of characters, candidates from ruling lines, merged cells, continuation over pages.

Bands, candidates and spans depend on the order in which things were taken before, so they run as plain Python on the
marks of one page or table at a time. A page's marks are few; they are gathered by key, and Arrow batches of
many pages go to a worker at once.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as St
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions import text as T
from . import geometry as G

# Functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: Fixed values, in points.
ROW_GAP, TABLE_WIDTH, LINE_COVER = 60.0, 60.0, 0.9
TOLERANCE, COVERAGE, MIN_CELL_LINE = G.TOLERANCE, G.COVERAGE, G.MIN_CELL_LINE


def by_page(marks: dict[str, tuple[DataFrame, list[str]]], keys: list[str], out: str, compute: Callable[..., list[tuple]]) -> DataFrame:
    """Rows (keys, out) that compute(*lists of tuples) gives for each page; marks: the frames and their columns, by name."""
    pages = None
    for name, (df, columns) in marks.items():
        one = df.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias(name))
        pages = one if pages is None else pages.join(one, keys, "full")
    kinds = dict(pages.dtypes)
    schema = St.StructType.fromDDL(", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + out)
    arrow, names, columns = to_arrow_schema(schema), schema.names, [c for _, c in marks.values()]

    def run(batches):
        for batch in batches:
            rows = []
            for page in batch.to_pylist():
                lists = [sorted(tuple(m[c] for c in cs) for m in page[n] or []) for n, cs in zip(marks_names, columns, strict=True)]
                key = tuple(page[k] for k in keys)
                rows += [dict(zip(names, key + row, strict=True)) for row in compute(*lists)]
            yield pa.RecordBatch.from_pylist(rows, arrow)

    marks_names = list(marks)
    return pages.mapInArrow(run, schema)


def band_of(chars: list[tuple]) -> list[int]:
    """For chars (top, bottom, x0, x1, font) by (top, x0): the band each belongs to.

    A character joins the latest band whose last character overlaps it by 0.35 of the lower height, or has its centre
    within 6 points or 0.6 of the larger font; else it opens a band.
    """
    last: list[tuple] = []
    out = []
    for c in chars:
        place = None
        for k in range(len(last) - 1, -1, -1):
            p = last[k]
            shared = min(p[1], c[1]) - max(p[0], c[0])
            apart = abs((p[0] + p[1]) - (c[0] + c[1])) / 2
            if shared >= 0.35 * min(p[1] - p[0], c[1] - c[0]) or apart <= max(6.0, 0.6 * max(p[4], c[4])):
                place = k
                break
        if place is None:
            place = len(last)
            last.append(c)
        last[place] = c
        out.append(place)
    return out


def bands(chars: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, char_no, band) of chars (char_no, top, bottom, x0, x1, font); bands are numbered within the page."""

    def page(marks: list[tuple]) -> list[tuple]:
        return [(no, band) for (_, _, no, *_), band in zip(marks, band_of([(top, bottom, x0, x1, font) for top, x0, _, bottom, x1, font in marks]), strict=True)]

    rows = chars.withColumn("char_no", F.col("char_no").cast("bigint"))
    return by_page({"chars": (rows, ["top", "x0", "char_no", "bottom", "x1", "font"])}, keys, "char_no bigint, band int", page)


def column_bounds(uprights: list[tuple], x0: float, x1: float, top: float, bottom: float) -> list[float]:
    """Means of the chains of x0, x1 and the uprights (x, top, bottom) that stand between them and share at least MIN_CELL_LINE of the height."""
    at = [x for x, t, b in uprights if x0 - TOLERANCE <= x <= x1 + TOLERANCE and min(b, bottom) - max(t, top) >= MIN_CELL_LINE]
    chains: list[list[float]] = []
    for x in sorted([x0, x1, *at]):
        if chains and x - chains[-1][-1] <= TOLERANCE:
            chains[-1].append(x)
        else:
            chains.append([x])
    return [sum(c) / len(c) for c in chains]


def find_candidates(rules: list[tuple], uprights: list[tuple]) -> list[tuple[int, int, list[float]]]:
    """(first, last, column bounds) of stretches of at least three rules (top, x0, x1), ordered by top, that make a table.

    A stretch grows while the next rule is near, shares enough width, and two uprights (x, top, bottom) cover
    most of the height that it would then have; the rule that ends it opens the next. One with a single column bound is no table.
    """

    def upright_count(x0: float, x1: float, top: float, bottom: float) -> int:
        height = max(bottom - top, 1e-9)
        return sum(x0 - TOLERANCE <= x <= x1 + TOLERANCE and (min(b, bottom) - max(t, top)) / height >= LINE_COVER for x, t, b in uprights)

    out, first = [], 0
    while first < len(rules):
        last, (top, x0, x1) = first, rules[first]
        while last + 1 < len(rules):
            here, ahead = rules[last], rules[last + 1]
            lo, hi = min(x0, ahead[1]), max(x1, ahead[2])
            near = ahead[0] - here[0] <= ROW_GAP and min(here[2], ahead[2]) - max(here[1], ahead[1]) >= TABLE_WIDTH
            if not near or upright_count(lo, hi, top, ahead[0]) < 2:
                break
            last, x0, x1 = last + 1, lo, hi
        if last - first >= 2 and x1 - x0 >= TABLE_WIDTH:
            bounds = column_bounds(uprights, x0, x1, top, rules[last][0])
            if len(bounds) > 1:
                out.append((first, last, bounds))
        first = last + 1
    return out


def candidates(rules: DataFrame, uprights: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, table_no, n_rules, top, bottom, x0, x1, bounds) from rules (top, x0, x1) and uprights (x, top, bottom); x0 and x1 are the outer bounds."""

    def page(r: list[tuple], u: list[tuple]) -> list[tuple]:
        return [(n, b - a + 1, r[a][0], r[b][0], bounds[0], bounds[-1], bounds) for n, (a, b, bounds) in enumerate(find_candidates(r, u))]

    marks = {"rules": (rules, ["top", "x0", "x1"]), "uprights": (uprights, ["x", "top", "bottom"])}
    return by_page(marks, keys, "table_no int, n_rules int, top double, bottom double, x0 double, x1 double, bounds array<double>", page)


def covered(pieces: list[tuple[float, float]], lo: float, hi: float) -> float:
    """The length of lo..hi under pieces, gaps of up to TOLERANCE between them closed."""
    total, start, end = 0.0, None, None
    for a, b in sorted((max(a, lo), min(b, hi)) for a, b in pieces if min(b, hi) > max(a, lo)):
        if end is not None and a <= end + TOLERANCE:
            end = max(end, b)
        else:
            total += end - start if end is not None else 0.0
            start, end = a, b
    return total + (end - start if end is not None else 0.0)


def grid_of(rules: list[tuple], uprights: list[tuple], tops: list[float], bounds: list[float]) -> list[tuple[int, int, int, int]]:
    """The spans of a table's cells: boundaries stand where marks near them cover at least COVERAGE of a side."""

    def wall(r: int, c: int) -> bool:
        lo, hi = tops[r], tops[r + 1]
        return covered([(t, b) for x, t, b in uprights if abs(x - bounds[c]) <= TOLERANCE], lo, hi) >= COVERAGE * max(hi - lo, 1e-9)

    def floor(r: int, c: int, end: int) -> bool:
        lo, hi = bounds[c], bounds[end]
        return covered([(a, b) for t, a, b in rules if abs(t - tops[r]) <= TOLERANCE], lo, hi) >= COVERAGE * max(hi - lo, 1e-9)

    n_rows, n_cols = len(tops) - 1, len(bounds) - 1
    walls = {(r, c) for r in range(n_rows) for c in range(1, n_cols) if wall(r, c)}
    floors = {(r, c, e) for r in range(1, n_rows) for c in range(n_cols) for e in range(c + 1, n_cols + 1) if floor(r, c, e)}
    return spans_of(n_rows, n_cols, walls, floors)


def cells(rules: DataFrame, uprights: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, table_no, row, col, row_span, col_span, x0, x1, top, bottom) of all tables that the marks of a page make."""

    def page(r: list[tuple], u: list[tuple]) -> list[tuple]:
        out = []
        for n, (a, b, bounds) in enumerate(find_candidates(r, u)):
            tops = [t for t, _, _ in r[a : b + 1]]
            for row, col, rows, cols in grid_of(r[a : b + 1], u, tops, bounds):
                out.append((n, row, col, rows, cols, bounds[col], bounds[col + cols], tops[row], tops[row + rows]))
        return out

    marks = {"rules": (rules, ["top", "x0", "x1"]), "uprights": (uprights, ["x", "top", "bottom"])}
    return by_page(marks, keys, "table_no int, row int, col int, row_span int, col_span int, x0 double, x1 double, top double, bottom double", page)


def tables(lines: DataFrame, rules: DataFrame, uprights: DataFrame, keys: list[str]) -> DataFrame:
    """cells() with their texts: the lines with their centre in the table, each in the cell that it shares most with ("" without any)."""
    found = cells(rules, uprights, keys)
    per = [*keys, "table_no"]
    box = found.groupBy(*per).agg(F.min("x0").alias("bx0"), F.max("x1").alias("bx1"), F.min("top").alias("btop"), F.max("bottom").alias("bbottom"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    inside = x.between(F.col("bx0") - 1.0, F.col("bx1") + 1.0) & y.between(F.col("btop") - 1.0, F.col("bbottom") + 1.0)
    held = lines.join(box, keys).where(inside).drop("bx0", "bx1", "btop", "bbottom")
    texts = G.cell_texts(held, found, per).withColumn("text", F.trim("text"))
    return found.join(texts, [*per, "row", "col"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def text_lines(chars: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, band, run, text, x0, x1, top, bottom, font) from characters (char_no, char, x0, x1, top, bottom): bands, cut at gaps.

    A character without text, or that is white space other than a blank, is no mark; a line has the outer edges and the largest font of its
    characters, which are joined from left to right (ties: by number). The font is the height of a character, at least 1.
    """
    kept = chars.where(~F.col("char").isin("", "\r", "\n", "\t", "\ufffe"))
    kept = kept.withColumn("char", F.when(F.col("char") == " ", " ").otherwise(T.compact(F.col("char")))).where("char <> ''")
    kept = kept.withColumn("font", F.greatest(F.col("bottom") - F.col("top"), F.lit(1.0)))
    rows = kept.join(bands(kept, keys), [*keys, "char_no"])
    band = [*keys, "band"]
    w = Window.partitionBy(*band).orderBy("x0", "char_no")
    gap = F.col("x0") - F.lag("x1").over(w)
    rows = rows.withColumn("_new", F.coalesce(gap > F.greatest(F.lit(14.0), 1.3 * F.greatest(F.col("font"), F.lag("font").over(w))), F.lit(True)))
    rows = rows.withColumn("run", F.sum(F.col("_new").cast("int")).over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "char_no", "char"))), lambda c: c["char"]), "")
    lines = rows.groupBy(*band, "run").agg(
        T.compact(joined).alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.max("font").alias("font")
    )
    return lines.where("text <> ''")


def spans_of(n_rows: int, n_cols: int, wall: set[tuple[int, int]], floor: set[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(row, col, row_span, col_span) of cells, row by row, each as wide as its first row and then as deep as it can be.

    wall has (row, col) where a boundary stands left of col; floor has (row, col, end) where one lies above row from
    col to end. Columns grow without a look at taken cells, rows stop at them.
    """
    taken: set[tuple[int, int]] = set()
    out = []
    for r in range(n_rows):
        for c in range(n_cols):
            if (r, c) in taken:
                continue
            end = next((k for k in range(c + 1, n_cols) if (r, k) in wall), n_cols)
            stop = next((k for k in range(r + 1, n_rows) if (k, c, end) in floor or any((k, j) in taken for j in range(c, end))), n_rows)
            taken.update((a, b) for a in range(r, stop) for b in range(c, end))
            out.append((r, c, stop - r, end - c))
    return out


def cell_spans(grids: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col, row_span, col_span) from grid cells (row, col, left_wall, top_floor: booleans of each cell)."""

    def one(marks: list[tuple]) -> list[tuple]:
        n_rows, n_cols = max(m[0] for m in marks) + 1, max(m[1] for m in marks) + 1
        lined = {(r, c) for r, c, _, f in marks if f}
        floor = {(r, c, e) for r in range(n_rows) for c in range(n_cols) for e in range(c + 1, n_cols + 1) if sum((r, k) in lined for k in range(c, e)) >= 0.6 * (e - c)}
        return spans_of(n_rows, n_cols, {(r, c) for r, c, w, _ in marks if w}, floor)

    return by_page({"cells": (grids, ["row", "col", "left_wall", "top_floor"])}, keys, "row int, col int, row_span int, col_span int", one)


def width_ratios(bounds: Column) -> Column:
    """Shares of the columns between boundaries; empty without any width."""
    total = F.element_at(bounds, -1) - F.element_at(bounds, 1)
    parts = F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), lambda i: (F.element_at(bounds, i + 1) - F.element_at(bounds, i)) / total)
    return F.when((F.size(bounds) > 1) & (total > 0), parts).otherwise(F.array().cast("array<double>"))


def continued(tables: DataFrame, doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    """tables (n_cols, top, bottom, x0, x1, width, height of the page, bounds, header) with continued, carried and header_rows.

    A table goes on from the one on the page before if that ends low, this starts high, and columns and sides agree.
    carried is that table's header where this one doesn't repeat it.
    """
    w = Window.partitionBy(doc).orderBy(page)
    was = lambda c: F.lag(c).over(w)
    close = lambda a, b: F.abs(a - b) <= 0.04
    share = lambda c, of: F.col(c) / F.col(of)
    rows = tables.withColumns({"_l": share("x0", "width"), "_r": share("x1", "width"), "_w": (F.col("x1") - F.col("x0")) / F.col("width"), "_q": width_ratios(F.col("bounds")), "_e": share("bottom", "height")})
    apart = F.array_max(F.zip_with(F.col("_q"), was("_q"), lambda a, b: F.abs(a - b)))
    goes = (
        (F.col(page) == was(page) + 1) & (F.col("n_cols") == was("n_cols")) & (was("_e") >= 0.7) & (share("top", "height") <= 0.3)
        & close(F.col("_l"), was("_l")) & close(F.col("_r"), was("_r")) & close(F.col("_w"), was("_w")) & (apart <= 0.06)
    )
    rows = rows.withColumns({"continued": F.coalesce(goes, F.lit(False)), "_h": was("header")})
    same = F.col("header") == F.col("_h")
    rows = rows.withColumn("carried", F.when(F.col("continued") & ~same, F.col("_h")))
    return rows.withColumn("header_rows", F.when(F.col("carried").isNotNull(), 0).otherwise(1)).drop("_l", "_r", "_w", "_q", "_e", "_h")
