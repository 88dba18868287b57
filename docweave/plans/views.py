"""Decorated views: integer rules that put marks, indents, images and odd characters on plain texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import table

PREFIXES = ("1. ", "• ", "2.1 ", "一、", "plugin_x: ", "（3）", "max ")


def line_text(line: Column, line_no: Column) -> Column:
    """A physical line with a prefix and an end by rule; its document is the column doc_id."""
    doc = F.col("doc_id")
    m, k = (doc * 17 + line_no * line_no * 3 + line_no) % 5, (doc * 31 + line_no * line_no * 7 + line_no * 3) % 17
    short = F.substring(line, F.lit(1), F.length(line) - 1)
    base = F.when(m < 2, short).when(m == 2, F.concat(short, F.lit(":"))).otherwise(line)
    return F.concat(F.coalesce(F.get(F.array(*map(F.lit, PREFIXES)), k.cast("int")), F.lit("")), base)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, text, x0, x1, top, bottom) for each physical line of documents."""
    raw = table(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("p", "l")).where("l is not null")
    raw = raw.select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "l")
    x0 = F.expr("36 + ((doc_id*13 + line_no*line_no*5 + line_no) % 7) * 6")
    out = raw.select("doc_id", "line_no", line_text(F.col("l"), F.col("line_no")).alias("text"), x0.alias("x0"), (F.lit(40) + F.col("line_no") * 14).alias("top"))
    return out.selectExpr("doc_id", "line_no", "text", "x0", "x0 + length(text) * 5 as x1", "top", "top + 10 as bottom")


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, text) with garbled characters and long urls by rule."""
    text = F.expr("concat(text, if(doc_id % 9 = 0, '\\uFFFD', ''), if(doc_id % 5 = 0, concat(' https://e.com/', repeat('a', cast(floor(length(text) / 2) as int))), ''))")
    return table(spark, sf_dir, "documents").select("doc_id", "source", text.alias("text"))


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full-page image for every fourth document, a small one for the next."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 4 < 2").select("doc_id")
    return docs.selectExpr("doc_id", "if(doc_id % 4 = 0, 1224, 100) as width", "if(doc_id % 4 = 0, 1584, 100) as height", "612 as page_width", "792 as page_height")


def role_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import structure

    rows = lines(spark, sf_dir)
    return rows.withColumn("role", structure.text_role(F.col("text"), F.col("line_no") == 1))


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import structure

    left = F.min("x0").over(Window.partitionBy("doc_id"))
    rows = lines(spark, sf_dir).withColumn("indent", F.col("x0") - left)
    return rows.withColumn("role", structure.layout_role(F.col("text"), F.col("indent"), F.col("line_no") == 1))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, lo, hi, top) from line items."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as page", "l_quantity * 3 as lo", "l_quantity * 3 + l_linenumber * 4 as hi", "l_linenumber * 2 as top")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, x) of distinct rule positions from parts."""
    return table(spark, sf_dir, "part").selectExpr("p_brand as page", "p_size * 10 + (p_partkey % 3) as x").distinct()
