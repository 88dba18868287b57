"""Roles of lines, demotion of bullets, blocks and list numbering, as windows over (keys, order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions import text as T


def text_role(text: Column, first: Column, numeric_headings: bool = False) -> Column:
    role = F.when(text.rlike(P.SECTION), "heading1").when(text.rlike(P.SUBSECTION), "heading2")
    if numeric_headings:
        role = role.when(text.rlike(P.NUMERIC_SECTION), "heading1")
    role = role.when(text.rlike(P.ORDERED), "ordered").when(text.rlike(P.BULLET), "bullet").when(text.rlike(P.PLUGIN), "plugin")
    return role.when(T.formula(text), "formula").when(first, "title").otherwise("body")


def layout_role(text: Column, indent: Column, first: Column) -> Column:
    """indent: distance of the line from the leftmost line of its page."""
    role = F.when(text.rlike(P.SECTION), "heading1").when(text.rlike(P.SUBSECTION), "heading2")
    role = role.when(text.rlike(P.NUMERIC_SECTION) & (indent <= 12), "heading1").when(text.rlike(P.ORDERED), "ordered")
    role = role.when(text.rlike(P.LEADING_DOT) & (indent >= 12), "ordered").when(text.rlike(P.BULLET), "bullet").when(text.rlike(P.PLUGIN), "plugin")
    return role.when(indent >= 22, "bullet").when(T.formula(text), "formula").when(first, "title").otherwise("body")


def demoted(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """lines (text, x0, role) with final_role: bullets that continue the line above become body.

    A bullet after an unterminated bullet depends on what that one became, so in a run of them
    roles alternate; the parity of the place in the run, and the row before it, give the result without a loop.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before = lambda c: F.lag(c).over(w)
    bullet = F.col("role") == "bullet"
    indented = bullet & (before("role") == "ordered") & before("text").rlike(P.COLON) & (F.col("x0") <= before("x0") + 14)
    chained = bullet & (before("role") == "bullet") & ~T.terminal(before("text")) & ~F.col("text").rlike(P.BULLET)
    rows = lines.withColumns({"_d": F.coalesce(indented, F.lit(False)), "_c": F.coalesce(chained, F.lit(False))})
    rows = rows.withColumn("_run", F.sum(F.when(~F.col("_c"), 1).otherwise(0)).over(w))
    in_run = Window.partitionBy(*keys, "_run").orderBy(order)
    place = F.row_number().over(in_run) - 1
    odd = F.first("_d").over(in_run) != (place % 2 == 1)
    rows = rows.withColumn("_down", F.when(F.col("_c"), odd).otherwise(F.col("_d")))
    return rows.withColumn("final_role", F.when(F.col("_down"), "body").otherwise(F.col("role"))).drop("_d", "_c", "_run", "_down")


def block_ids(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """lines (text, role) with block_id: wrapped lines share their block, in closed form. Lines are stripped, and those without text left out.

    A list item stays open unless it ends a sentence otherwise than by a colon; a body line stays open until any
    terminal mark. The last row that opened or closed a list tells whether a body line belongs to an item.
    """
    lines = lines.withColumn("text", T.strip(F.col("text"))).where("text <> ''")
    w = Window.partitionBy(*keys).orderBy(order)
    end, colon = T.terminal(F.col("text")), F.col("text").rlike(P.COLON)
    closes = end & ~colon
    listed, body = F.col("role").isin("ordered", "bullet", "plugin"), F.col("role") == "body"
    state = F.when(listed & ~closes, "open").when(listed | ~body | closes, "shut")
    rows = lines.withColumn("_state", state).withColumn("_body_open", body & ~end)
    inside = F.coalesce(F.last("_state", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) == "open", F.lit(False))
    running = F.coalesce(F.lag("_body_open").over(w), F.lit(False))
    rows = rows.withColumn("_start", (F.col("role") != "body") | (~inside & ~running))
    return rows.withColumn("block_id", F.sum(F.col("_start").cast("long")).over(w)).drop("_state", "_body_open", "_start")


def block_texts(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, block_id, role, text) of lines with block_id: lines joined, list marks taken off."""
    w = Window.partitionBy(*keys, "block_id").orderBy(order)
    blank = F.when(T.needs_space(F.lag("text").over(w), F.col("text")), " ").otherwise("")
    rows = lines.withColumn("_piece", F.concat(blank, F.col("text")))
    joined = rows.groupBy(*keys, "block_id").agg(
        F.min_by("role", order).alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_piece"))), lambda x: x["_piece"]), "").alias("text")
    )
    text = F.col("text")
    mark = lambda pattern: F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text)
    item = F.when(text.rlike(P.PLUGIN), F.concat(F.regexp_extract(text, P.PLUGIN, 1), F.lit("："), F.regexp_extract(text, P.PLUGIN, 2))).otherwise(text)
    return joined.withColumn("text", F.when(F.col("role") == "ordered", mark(P.ORDERED)).when(F.col("role") == "bullet", mark(P.BULLET)).when(F.col("role") == "plugin", item).otherwise(text))


def list_ids(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """blocks with list_id: numbering starts anew when the kind of list changes or anything else lies between."""
    w = Window.partitionBy(*keys).orderBy("block_id")
    kind = F.when(F.col("role") == "ordered", "ordered").when(F.col("role").isin("bullet", "plugin"), "bullet")
    rows = blocks.withColumn("_kind", kind)
    new = F.col("_kind").isNotNull() & (F.col("_kind") != F.coalesce(F.lag("_kind").over(w), F.lit("")))
    rows = rows.withColumn("_new", new)
    return rows.withColumn("list_id", F.when(F.col("_kind").isNotNull(), F.sum(F.col("_new").cast("long")).over(w))).drop("_kind", "_new")
