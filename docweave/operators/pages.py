"""Composition of pages: lines and tables in one order, text between tables, blocks of recognised pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import geometry as G
from . import structure as S

#: Labels of recognised blocks that are headings, and the longest line that heads an abstract.
TITLES, ABSTRACT_HEAD = ("doc_title", "paragraph_title", "title", "figure_title"), 24
#: Fixed value: the heading of a recognised page.
PAGE_HEADING = "第 %d 页"
#: Kinds of events; a table comes before a line of the same height.
TABLE, LINE = 0, 1


def events(lines: DataFrame, tables: DataFrame, keys: list[str], line_no: str = "line_no") -> DataFrame:
    """(keys, kind, top, line_no, table_no, seq, segment): tables and the lines outside them, in reading order.

    seq numbers them in a page by top, tables first, then by number. segment counts the tables so far, so lines of a
    segment lie between the same tables. tables: (keys, table_no, x0, x1, top, bottom).
    """
    out = G.outside_tables(lines, tables, keys).select(*keys, F.lit(LINE).alias("kind"), "top", line_no)
    tagged = tables.select(*keys, F.lit(TABLE).alias("kind"), "top", "table_no").unionByName(out, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("top", "kind", "table_no", line_no)
    return tagged.withColumn("seq", F.row_number().over(w).cast("long")).withColumn("segment", F.count_if(F.col("kind") == TABLE).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def compose(lines: DataFrame, tables: DataFrame, keys: list[str], doc_start: Column, line_no: str = "line_no") -> DataFrame:
    """(keys, segment, block_id, role, text, list_id) of pages: the blocks of each segment, and a row of role "table" for each table.

    lines: (keys, line_no, text, x0, x1, top, bottom). Roles go by the distance from the leftmost line of the page, all lines
    counted. Only the first line of a page that starts a document, before any table, can be a title. Blocks and demotions
    don't reach over a table, and lists begin anew after one. A table's row ends the segment before it: it has the
    segment that it opens, and block_id 0. Lines without text are left out.
    """
    lines = lines.withColumn("text", T.strip(F.col("text"))).where("text <> ''")
    page = Window.partitionBy(*keys)
    indented = lines.withColumn("indent", F.col("x0") - F.min("x0").over(page))
    placed = events(indented, tables, keys, line_no)
    rows = indented.join(placed.where(F.col("kind") == LINE).select(*keys, line_no, "seq", "segment"), [*keys, line_no])
    part = [*keys, "segment"]
    first = (F.row_number().over(Window.partitionBy(*part).orderBy("seq")) == 1) & (F.col("segment") == 0) & doc_start
    rows = rows.withColumn("_first", first).withColumn("role", S.layout_role(F.col("text"), F.col("indent"), F.col("_first")))
    rows = S.demoted(rows, part, "seq").drop("role").withColumnRenamed("final_role", "role")
    blocks = S.block_texts(S.block_ids(rows, part, "seq"), part, "seq")
    marks = placed.where(F.col("kind") == TABLE).select(*part, F.lit(0).cast("long").alias("block_id"), F.lit("table").alias("role"), F.lit(None).cast("string").alias("text"))
    both = blocks.select(*part, "block_id", "role", "text").unionByName(marks)
    order = Window.partitionBy(*keys).orderBy("segment", "block_id")
    numbered = S.list_ids(both.withColumn("_block", F.col("block_id")).withColumn("block_id", F.row_number().over(order).cast("long")), keys)
    return numbered.withColumn("block_id", F.col("_block")).drop("_block")


def clamped(pages: DataFrame, sizes: DataFrame, keys: list[str], index: str = "page_no") -> DataFrame:
    """pages with the columns of sizes of the same index, or of the last one if there are fewer sizes (both count from 0)."""
    n = sizes.groupBy(*keys).agg((F.max(index) + 1).alias("_n"))
    at = pages.join(n, keys, "left").withColumn("_at", F.least(F.col(index), F.col("_n") - 1))
    return at.join(sizes.withColumnRenamed(index, "_at"), [*keys, "_at"], "left").drop("_at", "_n")


def role_at(roles: Column, place: Column, otherwise: Column) -> Column:
    """The role given for a place (from 0), or what is computed where the list is short."""
    return F.coalesce(F.get(roles, place.cast("int")), otherwise)


def block_kind(label: Column, content: Column) -> Column:
    """table, title or text; null for a block without content."""
    kind = F.when((label == "table") | F.contains(F.lower(content), F.lit("<table")), "table").when(label.isin(*TITLES), "title").otherwise("text")
    return F.when(F.coalesce(T.strip(content), F.lit("")) != "", kind)


def abstract_head(label: Column, first_line: Column) -> Column:
    """Whether the first line of an abstract is its heading."""
    return (label == "abstract") & (F.length(first_line) <= ABSTRACT_HEAD) & ~first_line.rlike("[：:。；;]")


def recognised_lines(blocks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, order, kind, line_no, text, role) of recognised blocks (label, content): a title's text, an abstract's heading, and the lines of texts.

    Lines are stripped and empty ones left out; tables come as a row with their content. role is null but for headings.
    """
    rows = blocks.withColumn("kind", block_kind(F.col("label"), F.col("content"))).where("kind is not null")
    lines = F.filter(F.transform(F.split("content", r"\r\n|[\n\r]"), lambda x: T.strip(x)), lambda x: x != "")
    rows = rows.withColumn("_lines", F.when(F.col("kind") == "text", lines).otherwise(F.array(T.strip(F.col("content")))))
    rows = rows.select(*keys, order, "kind", "label", F.posexplode("_lines").alias("line_no", "text"))
    head = (F.col("kind") == "title") | ((F.col("line_no") == 0) & abstract_head(F.col("label"), F.col("text")))
    return rows.select(*keys, order, "kind", "line_no", F.when(F.col("kind") == "table", F.col("text")).otherwise(T.plain_text(F.col("text"))).alias("text"), F.when(head, "heading1").alias("role"))


def recognition_export(pages: DataFrame, lines: DataFrame, keys: list[str], page: str, hybrid: Column) -> DataFrame:
    """(keys, part, page, kind, line_no, text): what an export of recognised pages holds; in order by part, page and line_no.

    Part 0 has a row of kind "image" for each page, for documents where hybrid holds; it comes before part 1, which has for each
    page its heading (line_no -1) and then its lines, of kind "line", or "table". pages has a row for each page, from 0;
    lines are those of recognised_lines(). Pages without lines keep their heading.
    """
    none = F.lit(None).cast("string")
    images = pages.where(hybrid).select(*keys, F.lit(0).alias("part"), page, F.lit("image").alias("kind"), F.lit(0).alias("line_no"), none.alias("text"))
    title = F.format_string(PAGE_HEADING, (F.col(page) + 1).cast("long"))
    heads = pages.select(*keys, F.lit(1).alias("part"), page, F.lit("heading2").alias("kind"), F.lit(-1).alias("line_no"), title.alias("text"))
    kind = F.when(F.col("kind") == "table", "table").otherwise("line")
    return images.unionByName(heads).unionByName(lines.select(*keys, F.lit(1).alias("part"), page, kind.alias("kind"), "line_no", "text"))


def table_counts(documents: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tables): how many tables each document has, 0 included."""
    n = tables.groupBy(*keys).agg(F.count("*").alias("tables"))
    return documents.join(n, keys, "left").select(*keys, F.coalesce("tables", F.lit(0)).alias("tables"))
