"""One-dimensional clusters, interval merging, coverage, runs and containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values, in points.
TOLERANCE, COVERAGE, MIN_CELL_LINE = 2.5, 0.6, 8.0


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.least(a1, b1) - F.greatest(a0, b0)


def clusters(points: DataFrame, keys: list[str], at: str, gap: float = TOLERANCE) -> DataFrame:
    """points with cluster: a new one after each gap to the point before of more than gap."""
    w = Window.partitionBy(*keys).orderBy(at)
    rows = points.withColumn("_new", F.coalesce(F.col(at) - F.lag(at).over(w) > gap, F.lit(True)))
    return rows.withColumn("cluster", F.sum(F.col("_new").cast("long")).over(w)).drop("_new")


def merged(intervals: DataFrame, keys: list[str], bridge: float = TOLERANCE) -> DataFrame:
    """(keys, island, lo, hi) of intervals (lo, hi): those that overlap or lie within bridge become one."""
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.withColumn("_new", F.coalesce(F.col("lo") > reach + bridge, F.lit(True)))
    rows = rows.withColumn("island", F.sum(F.col("_new").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def covered(intervals: DataFrame, keys: list[str], lo: Column, hi: Column) -> DataFrame:
    """(keys, covered): the length of lo..hi that merged intervals cover; pages without any are left out."""
    islands = merged(intervals.where(overlap(F.col("lo"), F.col("hi"), lo, hi) > 0), keys)
    return islands.groupBy(*keys).agg(F.sum(overlap(F.col("lo"), F.col("hi"), lo, hi)).alias("covered"))


def path_kind(width: Column, height: Column) -> Column:
    return F.when((height <= 2) & (width >= 20), "H").when((width <= 2) & (height >= 10), "V")


def runs(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """glyphs (x0, x1, font) with run: a new one after a gap beyond 14 points and 1.3 times the larger font."""
    w = Window.partitionBy(*keys).orderBy("x0", "x1")
    gap = F.col("x0") - F.lag("x1").over(w)
    new = gap > F.greatest(F.lit(14.0), 1.3 * F.greatest(F.col("font"), F.lag("font").over(w)))
    rows = glyphs.withColumn("_new", F.coalesce(new, F.lit(True)))
    return rows.withColumn("run", F.sum(F.col("_new").cast("long")).over(w)).drop("_new")


def inside(x: Column, y: Column, box: str, slack: float = 1.0) -> Column:
    c = lambda n: F.col(f"{box}.{n}")
    return x.between(c("x0") - slack, c("x1") + slack) & y.between(c("top") - slack, c("bottom") + slack)


def outside_tables(lines: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Lines whose centre lies in no box of their page."""
    x, y = (F.col("l.x0") + F.col("l.x1")) / 2, (F.col("l.top") + F.col("l.bottom")) / 2
    same = [F.col(f"l.{k}") == F.col(f"b.{k}") for k in keys]
    on = same[0]
    for more in same[1:]:
        on = on & more
    return lines.alias("l").join(boxes.alias("b"), on & inside(x, y, "b"), "left_anti")


def cell_texts(lines: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col, text): each line goes to the cell it shares most area with (ties: first by row, col)."""
    both = lines.join(cells.select(*keys, "row", "col", *[F.col(c).alias(f"c_{c}") for c in ("x0", "x1", "top", "bottom")]), keys)
    ox = overlap(F.col("x0"), F.col("x1"), F.col("c_x0"), F.col("c_x1"))
    oy = overlap(F.col("top"), F.col("bottom"), F.col("c_top"), F.col("c_bottom"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    fits = ((ox > 0) | cx.between(F.col("c_x0"), F.col("c_x1"))) & cy.between(F.col("c_top"), F.col("c_bottom"))
    score = F.greatest(ox, F.lit(0.1)) * F.greatest(oy, F.lit(0.1))
    best = both.where(fits).withColumn("_score", score)
    w = Window.partitionBy(*keys, "line_no").orderBy(F.desc("_score"), "row", "col")
    best = best.withColumn("_rank", F.row_number().over(w)).where("_rank = 1")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "x0", "line_no", "text"))), lambda x: x["text"]), "\n")
    return best.groupBy(*keys, "row", "col").agg(text.alias("text"))
