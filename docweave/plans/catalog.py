"""q01 to q68: each operator over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions import text as T
from ..operators import blocks as B
from ..operators import geometry as G
from ..operators import jobs as J
from ..operators import measures as M
from ..operators import pages as PG
from ..operators import quality as Q
from ..operators import structure as S
from ..operators import tables as TB
from ..operators.config import EngineConfig
from ..sinks import docx as DX
from ..sources.tables import table
from . import views as V

CFG = EngineConfig()
ROUTE_MIN_CHARS = (20, 200, 1000)


def q01_normalize_lines(spark: SparkSession, d: str) -> DataFrame:
    each = F.transform(F.split("text", "\n"), lambda x, i: V.line_text(x, (i + 1).cast("long")))
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(each, " \t\n  ").alias("text"))
    clean = rows.select("doc_id", T.normalize(F.col("text")).alias("text"))
    return clean.select("doc_id", "text", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


def q02_page_char_counts(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.visible_chars(F.col("text")).cast("long").alias("chars"))


def q03_garbled_counts(spark, d):
    return V.page_texts(spark, d).select("doc_id", T.garbled_chars(F.col("text")).cast("long").alias("garbled"))


def q04_url_stats(spark, d):
    return V.page_texts(spark, d).select("doc_id", T.url_count(F.col("text")).cast("long").alias("url_count"), T.url_chars(F.col("text")).cast("long").alias("url_chars"))


def q05_image_page_stats(spark, d):
    out = Q.image_stats(V.page_images(spark, d), ["doc_id"], CFG)
    return out.select("doc_id", "images", F.col("full_images").cast("long"), "max_pixels")


def _pages(spark, d, cfg):
    images = Q.image_stats(V.page_images(spark, d), ["doc_id"], cfg)
    pages = V.page_texts(spark, d).join(images, "doc_id", "left").fillna(0, ["images", "full_images", "max_pixels"])
    return Q.page_quality(pages, cfg)


def q06_page_quality(spark, d):
    return _pages(spark, d, CFG).select("doc_id", F.col("chars").cast("long"), F.col("score").cast("long"), "high_quality")


def q07_doc_quality(spark, d):
    out = Q.document_quality(_pages(spark, d, CFG), "source", CFG)
    return out.select("source", *[F.col(c).cast("long") for c in out.columns if c != "source"])


def q08_doc_route(spark, d):
    """Texts are normalised and counted once; the counts meet each threshold, and only then they are scored."""
    talk = table(spark, d, "conversations").selectExpr("concat('c', conv_id) as doc", "text", "0 as images", "0 as full_images")
    images = Q.image_stats(V.page_images(spark, d), ["doc_id"], CFG)
    pages = V.page_texts(spark, d).join(images, "doc_id", "left").fillna(0, ["images", "full_images"]).select(F.col("source").alias("doc"), "text", "images", "full_images")
    counted = Q.page_counts(pages.unionByName(talk))
    each = F.array(*[F.struct(F.lit(n).alias("min_page_chars"), Q.page_verdict(EngineConfig(min_page_chars=n)).alias("v")) for n in ROUTE_MIN_CHARS])
    scored = counted.select("*", F.inline(each)).select("doc", "min_page_chars", "chars", "garbled", "url_chars", "full_images", "v.score", "v.high_quality")
    rows = None
    for n in ROUTE_MIN_CHARS:
        usable = F.count_if((F.col("min_page_chars") == n) & (F.col("chars") >= n))
        rows = usable if rows is None else rows + usable
    documents = scored.groupBy("doc", "min_page_chars").agg(F.count("*").alias("pages"), rows.alias("usable"), F.count_if("high_quality").alias("high_quality"), F.sum("chars").alias("chars"))
    route = None
    for n in ROUTE_MIN_CHARS:
        pair = Q.route_of(EngineConfig(min_page_chars=n))
        route = F.when(F.col("min_page_chars") == n, pair) if route is None else route.when(F.col("min_page_chars") == n, pair)
    return documents.withColumn("r", route).select("doc", F.col("min_page_chars").cast("long").alias("min_page_chars"), "r.route", "r.reason")


def q09_line_roles_text(spark, d):
    return V.role_lines(spark, d).select("doc_id", "line_no", "role")


def q10_line_roles_layout(spark, d):
    return V.layout_lines(spark, d).select("doc_id", "line_no", "role")


def q11_bullet_demotion(spark, d):
    return S.demoted(V.layout_lines(spark, d), ["doc_id"], "line_no").select("doc_id", "line_no", "final_role")


def q12_block_ids(spark, d):
    return S.block_ids(V.role_lines(spark, d), ["doc_id"], "line_no").select("doc_id", "line_no", "block_id")


def _blocks(spark, d):
    return S.block_texts(S.block_ids(V.role_lines(spark, d), ["doc_id"], "line_no"), ["doc_id"], "line_no")


def q13_block_text(spark, d):
    return _blocks(spark, d)


def q14_list_instances(spark, d):
    return S.list_ids(_blocks(spark, d), ["doc_id"]).where("list_id is not null").select("doc_id", "block_id", "list_id")


def q15_role_histogram(spark, d):
    return _blocks(spark, d).groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def q16_word_space_join(spark, d):
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = V.lines(spark, d).withColumn("blank", T.needs_space(F.lag("text").over(w), F.col("text")))
    return rows.groupBy("doc_id").agg(F.count_if("blank").alias("blanks"), F.count("*").alias("n"))


def q17_sentence_terminal_rate(spark, d):
    rows = table(spark, d, "documents").select("lang", F.explode_outer(F.split("text", "\n")).alias("l"))
    return rows.groupBy("lang").agg(F.count_if(T.terminal(F.col("l"))).alias("terminal"), F.count("*").alias("total"))


def q18_plugin_items(spark, d):
    rows = V.lines(spark, d).where(F.col("text").rlike(P.PLUGIN))
    return rows.select("doc_id", "line_no", F.regexp_extract("text", P.PLUGIN, 1).alias("name"), F.regexp_extract("text", P.PLUGIN, 2).alias("value"))


def q19_formula_lines(spark, d):
    return V.lines(spark, d).where(T.formula(F.col("text"))).select("doc_id", "line_no")


def q20_chain_clusters(spark, d):
    rows = G.clusters(V.rules(spark, d), ["page"], "x")
    return rows.groupBy("page", "cluster").agg(F.sum("x").alias("total"), F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))


def q21_interval_merge(spark, d):
    return G.merged(V.segments(spark, d), ["page"]).select("page", "island", "lo", "hi")


def q22_interval_coverage(spark, d):
    return G.covered(V.segments(spark, d), ["page"], F.lit(20.0), F.lit(100.0))


def q23_band_coverage(spark, d):
    bands = F.expr("explode(array(struct(4.0D as rule, 0.0D as c0, 60.0D as c1), struct(10.0D as rule, 30.0D as c0, 150.0D as c1)))")
    rows = V.segments(spark, d).select("*", bands.alias("band")).select("page", "lo", "hi", "top", "band.*").where(F.abs(F.col("top") - F.col("rule")) <= G.TOLERANCE)
    rows = rows.where(G.overlap(F.col("lo"), F.col("hi"), F.col("c0"), F.col("c1")) > 0)
    islands = G.merged(rows, ["page", "rule", "c0", "c1"])
    out = islands.groupBy("page", "rule", "c0", "c1").agg(F.sum(G.overlap(F.col("lo"), F.col("hi"), F.col("c0"), F.col("c1"))).alias("covered"))
    return out.select("page", "rule", "covered", (F.col("covered") >= G.COVERAGE * (F.col("c1") - F.col("c0"))).alias("present"))


def q24_path_classify(spark, d):
    rows = table(spark, d, "lineitem").select(G.path_kind(F.expr("l_quantity * (l_linenumber % 2) * 2"), F.expr("(l_orderkey % 25) * 1.0")).alias("kind"))
    return rows.groupBy(F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


def q25_run_split(spark, d):
    words = V.lines(spark, d).select("doc_id", "line_no", F.posexplode_outer(F.split("text", " ")).alias("j", "word")).where("word is not null")
    glyphs = words.selectExpr("doc_id", "line_no", "j", "cast(j * 45 + (j * j * doc_id) % 7 * 5 as double) as x0", "length(word) as n", "10.0D as font").selectExpr("*", "x0 + n * 4 as x1")
    return G.runs(glyphs, ["doc_id", "line_no"]).groupBy("doc_id", "line_no").agg(F.max("run").alias("runs"), F.count("*").alias("words"))


def q26_column_boundaries(spark, d):
    lo, hi = 50, 450
    uprights = table(spark, d, "part").selectExpr("p_brand as page", "p_size * 10 + (p_partkey % 3) as x", "p_partkey % 30 as top", "p_partkey % 30 + p_size as bottom")
    near = uprights.where(F.col("x").between(lo, hi) & (G.overlap(F.col("top"), F.col("bottom"), F.lit(0), F.lit(40)) >= G.MIN_CELL_LINE)).select("page", "x")
    edges = uprights.select("page").distinct().select("page", F.explode(F.array(F.lit(lo).cast("bigint"), F.lit(hi).cast("bigint"))).alias("x"))
    rows = G.clusters(near.unionByName(edges), ["page"], "x")
    return rows.groupBy("page", "cluster").agg(F.sum("x").alias("total"), F.count("*").alias("n"))


def _boxes(spark, d):
    docs = table(spark, d, "documents").select("doc_id").distinct()
    return docs.selectExpr("doc_id", "explode(array(named_struct('x0', 30, 'x1', 400 + doc_id % 300, 'top', 110, 'bottom', 166), named_struct('x0', 30, 'x1', 900, 'top', 250, 'bottom', 300))) as b").select("doc_id", "b.*")


def q27_lines_outside_tables(spark, d):
    return G.outside_tables(V.lines(spark, d), _boxes(spark, d), ["doc_id"]).select("doc_id", "line_no")


def q28_cell_assignment(spark, d):
    docs = table(spark, d, "documents").select("doc_id").distinct()
    grid = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("c")).selectExpr("doc_id", "cast(floor(c / 2) as int) as row", "c % 2 as col")
    cells = grid.selectExpr("doc_id", "row", "col", "36 + col * 300 as x0", "336 + col * 900 as x1", "40 + row * 42 as top", "82 + row * 42 as bottom")
    return G.cell_texts(V.lines(spark, d), cells, ["doc_id"]).select("doc_id", F.col("row").cast("long"), F.col("col").cast("long"), "text")


def _page_tables(spark, d):
    first = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"), F.min("l_returnflag").alias("l_returnflag"))
    rows = first.selectExpr(
        "l_orderkey as doc_id", "l_linenumber as page_no", "cast(2 + l_orderkey % 2 as int) as n_cols", "(l_quantity * 11) % 400 as top", "300 + (l_quantity * 7) % 480 as bottom",
        "36.0D + (l_linenumber % 2) * 12 as x0", "540.0D as x1", "612.0D as width", "792.0D as height", "l_returnflag as header")
    return rows.withColumn("bounds", F.expr("if(n_cols = 2, array(x0, 200.0D, x1), array(x0, 200.0D, 400.0D, x1))"))


def q29_table_continuation(spark, d):
    return TB.continued(_page_tables(spark, d)).select("doc_id", "page_no", "continued", "carried", F.col("header_rows").cast("long"))


def q30_merged_cells(spark, d):
    cells = table(spark, d, "part").where("p_partkey > 0").selectExpr(
        "p_partkey as table_id", "explode(transform(sequence(0, 15), c -> named_struct('row', cast(floor(c / 4) as int), 'col', c % 4,"
        " 'left_wall', (p_size + c * c * 3 + c) % 3 > 0, 'top_floor', (p_size * 7 + c * c + 5 * c) % 4 > 0))) as x")  # fmt: skip
    return TB.cell_spans(cells.select("table_id", "x.*"), ["table_id"])


def q31_bands_and_candidates(spark, d):
    chars = V.lines(spark, d).selectExpr("doc_id", "line_no as char_no", "cast(top + (line_no * line_no) % 5 as double) as top", "cast(bottom + (line_no * line_no) % 5 as double) as bottom", "cast(x0 as double) as x0", "cast(x1 as double) as x1", "10.0D as font")
    per = TB.bands(chars, ["doc_id"]).groupBy("doc_id").agg((F.max("band") + 1).cast("long").alias("bands"))
    rules = table(spark, d, "lineitem").selectExpr("l_orderkey as doc_id", "cast(l_linenumber * (20 + l_orderkey % 30) as double) as top", "cast(36 + l_quantity as double) as x0", "cast(300 + l_quantity as double) as x1")
    posts = table(spark, d, "orders").selectExpr("o_orderkey as doc_id", "explode(array(80.0D, 200.0D, 290.0D)) as x", "0.0D as top", "cast(100 + o_orderkey % 200 as double) as bottom")
    found = TB.candidates(rules, posts, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("tables"), F.sum("n_rules").alias("rules"))
    return per.join(found, "doc_id", "full")


def _ocr(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.split("text", "\n").alias("texts"))
    score = "transform(sequence(0, size(texts) - 1), i -> cast((((conv_id * 7 + turn * 3 + i * 11) % 100) / 100) as string))"
    return Q.ocr_audit(rows.withColumn("scores", F.expr(score)))


def q32_ocr_audit(spark, d):
    big = lambda c: F.col(c).cast("long")
    return _ocr(spark, d).select("conv_id", "turn", big("lines"), big("non_empty"), big("chars"), big("low"), big("suspicious"), "min", "needs_review")


def q33_ocr_needs_review(spark, d):
    return _ocr(spark, d).groupBy("role").agg(F.count_if("needs_review").alias("review"), F.count("*").alias("n"))


def q34_html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(T.plain_text(F.col("html"))).cast("long").alias("n"))


def q35_html_rows(spark, d):
    made = F.regexp_replace(F.regexp_replace("html", "<li>", "<tr><td>"), "</li>", "</td></tr>")
    rows = table(spark, d, "pages").select("page_id", B.html_rows(made).alias("rows"))
    rows = rows.select("page_id", F.posexplode_outer("rows").alias("row", "cells")).where("cells is not null")
    return rows.select("page_id", "row", F.posexplode("cells").alias("col", "text")).select("page_id", F.col("row").cast("long"), F.col("col").cast("long"), "text")


def q36_block_order(spark, d):
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn", "if(turn % 2 = 0, (conv_id * 3 + turn * 5) % 7, null) as ord", "(turn * 37 + conv_id) % 11 + 0.7 as top")
    w = Window.partitionBy("conv_id").orderBy(*B.block_order(rows, "ord", "top", "turn"))
    return rows.select("conv_id", "turn", F.row_number().over(w).cast("long").alias("rank"))


def q37_latest_event(spark, d):
    return J.latest(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


#: Event types as states of a job.
STATUS = {"signup": "queued", "view": "processing", "click": "processing", "purchase": "succeeded", "error": "failed"}


def _events(spark, d):
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return table(spark, d, "events").withColumn("status", status[F.col("event_type")])


def q38_job_fold(spark, d):
    return J.fold(_events(spark, d), "user_id", "event_id", "status")


def q39_retry_outcome(spark, d):
    rows = _events(spark, d)
    done = rows.where("status = 'succeeded'").groupBy("user_id").agg(F.min("event_id").alias("done"))
    per = rows.join(done, "user_id", "left").groupBy("user_id").agg(
        F.count_if((F.col("status") == "failed") & (F.col("done").isNull() | (F.col("event_id") < F.col("done")))).alias("failures"), F.count_if(F.col("status") == "succeeded").alias("successes"))
    return per.select("user_id", *[c.alias(n) for n, c in J.retried(F.col("failures"), F.col("successes"), CFG.max_retries).items()])


def q40_deadlines(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumn("elapsed", F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts")) / 1e6)
    late = J.over_budget(F.col("elapsed"), F.when(F.col("event_type") == "view", "ocr"), 6000.0, 1500.0)
    return rows.groupBy("user_id").agg(F.count_if(F.coalesce(late, F.lit(False))).alias("late"), F.count("*").alias("n"))


def q41_ttl_expiry(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("finished"))
    now = table(spark, d, "events").agg(F.max("ts").alias("now"))  # one row, broadcast
    return last.join(F.broadcast(now), ~J.expired(F.col("finished"), F.col("now"), CFG.ttl_s)).select("user_id")


def q42_admission_queue(spark, d):
    first = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("created"), F.min_by("event_type", F.struct("ts", "event_id")).alias("queue"))
    return J.admitted(first, "created", "user_id", CFG.max_pending, "queue").select("user_id", "queue", "position", "admitted")


def q43_upsert_delete(spark, d):
    records = table(spark, d, "orders").selectExpr("o_orderkey as id", "o_orderstatus as state", "o_custkey as owner")
    changes = records.where("id % 7 = 0").withColumn("state", F.lit("X")).unionByName(records.where("id % 11 = 0 and id % 7 <> 0").selectExpr("-id as id", "'N' as state", "owner"))
    changes = changes.withColumn("n", F.lit(1)).unionByName(records.where("id % 14 = 0").selectExpr("id", "'Y' as state", "owner", "2 as n"))
    gone = records.where("owner % 13 = 0").select("id")
    return J.delete(J.upsert(records, changes, "id", "n"), gone, "id").groupBy("state").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def q44_catalogue_default(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("quality", F.lit(-1)).cast("long").alias("quality"))


def q45_corpus_metrics(spark, d):
    source = table(spark, d, "documents").select("doc_id", "source")
    rows = _blocks(spark, d).join(source, "doc_id")
    count = lambda *roles: F.count_if(F.col("role").isin(*roles))
    per = rows.groupBy("source").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("blocks"), count("heading1", "heading2", "title").alias("headings"), count("bullet", "plugin").alias("bullets"), count("ordered").alias("ordered"), F.sum(F.length("text")).alias("chars"))
    return per.withColumn("ok", F.col("blocks") > 0)


def q46_page_size_scale(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey", "p_size * 40 + 100 as w", "(p_partkey % 50) * 30 + 200 as h")
    return rows.select("p_partkey", B.page_scale_millionths(F.col("w"), F.col("h")).alias("scale"), (F.col("w") * 1000000 / 72).cast("long").alias("width_millionths"))


def q47_required_entries(spark, d):
    need = ["body", "bullet", "heading1", "ordered"]
    rows = V.role_lines(spark, d).groupBy("doc_id").agg(F.collect_set("role").alias("roles"))
    return rows.select("doc_id", B.required_missing(F.col("roles"), need).cast("long").alias("missing"), (B.required_missing(F.col("roles"), need) == 0).alias("complete"))


def q48_sanitize_names(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


def q49_page_metrics(spark, d):
    bounds = F.expr("array(0.0D, p_size * 1.0D, p_size * 1.0D + (p_partkey % 7) * 9 - 18, 900.0D + p_size)")
    rows = table(spark, d, "part").select("p_partkey", bounds.alias("b"), F.expr("p_size * 40 + 100").alias("w"), F.expr("(p_partkey % 50) * 30 + 200").alias("h"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    widths, scale = M.column_widths(F.col("b"), F.lit(6.0)), M.width_scale(F.col("b"), F.lit(6.0))
    whole = lambda x, n: F.round(x * n).cast("long")
    return rows.select(
        "p_partkey", whole(total(M.steps(F.col("b"))), 10).alias("height"), whole(F.array_min(M.steps(F.col("b"))), 10).alias("least"), whole(total(widths), 1000).alias("width"),
        whole(total(M.row_heights(F.col("b"), scale)), 1000).alias("rows"), whole(M.render_scale(F.col("w"), F.col("h"), 1_000_000), 100000).alias("render"), M.image_quality(F.col("w") - 150).cast("long").alias("quality"))


#: Event types as stages of an export.
STAGE = {"view": "text_layout_started", "click": "text_layout_completed", "purchase": "ocr_text_completed"}


def q50_stage_progress(spark, d):
    stage = F.create_map(*[F.lit(x) for kv in STAGE.items() for x in kv])[F.col("event_type")]
    rows = table(spark, d, "events").select("event_type", M.stage_progress(F.coalesce(stage, F.lit("other")), M.page_progress(F.col("event_id") % 9, F.col("user_id") % 5)).alias("progress"))
    return rows.groupBy("event_type", "progress").agg(F.count("*").alias("n")).select("event_type", F.col("progress").cast("long"), "n")


def _jobs(spark, d):
    return table(spark, d, "orders").selectExpr(
        "o_orderkey as id", "element_at(array('queued', 'processing', 'succeeded', 'failed', 'timed_out', 'cancelled'), cast(o_orderkey % 6 + 1 as int)) as status",
        "o_custkey % 4 as attempt", "1 as retries", "o_orderkey % 5 > 0 as has_input", "o_custkey % 3 > 0 as has_output", "if(o_custkey % 7 = 0, 'timed_out', null) as reported", "o_orderdate as created")


def q51_job_lifecycle(spark, d):
    c = F.col
    return _jobs(spark, d).select(
        "id", J.recovered(c("status"), c("has_input"), c("attempt"), c("retries")).alias("recovered"), J.exited(c("status"), c("has_output"), c("reported"), c("attempt"), c("retries")).alias("exited"),
        J.cancelled(c("status")).alias("cancelled"), J.shut_down(c("status")).alias("stopped"), J.download_status(c("status"), c("has_output")).cast("long").alias("download"),
        J.download_url(c("id"), c("status")).alias("url"), J.page_count_status(c("attempt"), c("id") % 10 == 0, 2).cast("long").alias("pages"))


def q52_latest_state(spark, d):
    payload = """case when event_id % 11 = 0 then '{"status": "brok' when event_id % 5 = 0 then concat('{"progress": "', event_id % 100, '", "route": "ocr"}')
        when event_id % 7 = 0 then concat('{"status": 5, "table_count": -1, "progress": ', event_id % 100, '}')
        else concat('{"status": "', event_type, '", "table_count": ', user_id % 4, '}') end"""
    out = J.latest_state(table(spark, d, "events").selectExpr("user_id", "event_id", f"{payload} as payload"), "user_id", "event_id")
    return out.select("user_id", "status", F.col("progress").cast("long"), "route", F.col("table_count").cast("long"))


def q53_scheduler(spark, d):
    return J.started(_jobs(spark, d).where("status = 'queued'"), "status", "created", "id", 4).select("id")


def _tables_of_documents(spark, d):
    boxes = _boxes(spark, d)
    return boxes.withColumn("table_no", F.when(F.col("top") < 200, 0).otherwise(1))


def q54_page_events(spark, d):
    out = PG.events(V.lines(spark, d), _tables_of_documents(spark, d), ["doc_id"])
    return out.select("doc_id", F.col("kind").cast("long"), F.coalesce(F.col("line_no"), F.col("table_no").cast("long")).alias("no"), "seq", "segment")


def q55_page_composition(spark, d):
    out = PG.compose(V.lines(spark, d), _tables_of_documents(spark, d), ["doc_id"], F.col("doc_id") % 2 == 0)
    return out.select("doc_id", "segment", "block_id", "role", "text", "list_id")


def q56_recognised_blocks(spark, d):
    label = "element_at(array('text', 'doc_title', 'abstract', 'abstract', 'table', 'text'), cast((conv_id + turn) % 6 + 1 as int))"
    content = "case when (conv_id + turn) % 6 = 3 then concat('Summary', chr(10), text) when (conv_id + turn) % 6 = 5 and turn % 4 = 0 then concat('<TABLE><tr><td>', text, '</td></tr></TABLE>') else text end"
    rows = PG.recognised_lines(table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{label} as label", f"{content} as content"), ["conv_id"], "turn")
    return rows.groupBy("conv_id", "turn", "kind").agg(F.count("*").alias("lines"), F.count("role").alias("heads"), F.sum(F.length("text")).alias("chars"))


def q57_page_sizes(spark, d):
    pages = table(spark, d, "lineitem").selectExpr("l_orderkey as id", "cast(l_linenumber - 1 as int) as page_no")
    sizes = table(spark, d, "orders").selectExpr("o_orderkey as id", "explode(sequence(0, cast(o_orderkey % 3 as int))) as page_no").selectExpr("id", "page_no", "(id % 9) * 72.0D + page_no * 36 as points")
    out = PG.clamped(pages, sizes, ["id"]).select("id", "page_no", F.round(M.page_inches(F.col("points")) * 1000).cast("long").alias("milli_inches"))
    return out.groupBy("id", "page_no").agg(F.max("milli_inches").alias("milli_inches"), F.count("*").alias("n")).select("id", F.col("page_no").cast("long"), "milli_inches", "n")


def q58_given_roles(spark, d):
    given = F.array(F.lit("title"), F.when(F.col("doc_id") % 2 == 0, "heading1"))
    return V.role_lines(spark, d).select("doc_id", "line_no", PG.role_at(given, F.col("line_no") - 1, F.col("role")).alias("role"))


def q59_render_deltas(spark, d):
    source = V.lines(spark, d).groupBy("doc_id").agg(F.count("*").alias("pages"))
    rendered = source.where("doc_id % 3 = 0").selectExpr("doc_id", "pages + doc_id % 4 - 1 as rendered")
    return source.join(rendered, "doc_id", "left").select("doc_id", "pages", "rendered", (F.col("rendered") - F.col("pages")).alias("delta"))


def q60_recognition_stats(spark, d):
    scores = F.expr("if(turn % 5 = 0, cast(array() as array<double>), transform(texts, (t, i) -> ((conv_id * 7 + turn * 3 + i * 11) % 100) / 128.0D))")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.split("text", "\n").alias("texts")).withColumn("scores", scores)
    stats = M.ocr_page_stats(F.col("texts"), F.col("scores"))
    return rows.select("conv_id", "turn", stats["lines"].cast("long").alias("lines"), stats["chars"].cast("long").alias("chars"), F.round(stats["mean"] * 10000).cast("long").alias("mean"))


def q61_first_keys(spark, d):
    words = F.split(F.lower("text"), "[^a-z]+")
    keys = M.first_keys(F.filter(words, lambda w: w != ""))
    return table(spark, d, "documents").select("doc_id", F.array_join(keys, " ").alias("keys"))


def q62_docx_round_trip(spark, d):
    rows = S.list_ids(_blocks(spark, d), ["doc_id"])
    found = DX.metrics(DX.documents(rows, "doc_id", "block_id"), "doc_id")
    return found.select("doc_id", "paragraphs", "headings", "bullets", "ordered", "text_chars", "media_count", "text_nodes", "complete", "zip_ok")


def q63_text_lines(spark, d):
    """Words of each line stand for characters, so bands, gaps and joins all happen."""
    words = V.lines(spark, d).select("doc_id", "line_no", "top", F.posexplode(F.split("text", " ")).alias("j", "char"))
    chars = words.selectExpr(
        "doc_id", "line_no * 10000 + j as char_no", "char", "cast(36 + j * 40 + (j * j * doc_id) % 7 * 6 as double) as x0", "cast(36 + j * 40 + (j * j * doc_id) % 7 * 6 + 30 as double) as x1",
        "cast(top + (j * line_no) % 3 as double) as top", "cast(top + (j * line_no) % 3 + 10 as double) as bottom")
    out = TB.text_lines(chars, ["doc_id"])
    return out.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"), F.sum("x0").alias("x0"), F.sum("bottom").alias("bottom"))


def q64_whole_tables(spark, d):
    """Rules and uprights of each order, with lines in them: cells with their spans and texts."""
    rules = table(spark, d, "lineitem").selectExpr("l_orderkey as id", "cast(l_linenumber * (20 + l_orderkey % 30) as double) as top", "cast(36 + l_quantity as double) as x0", "cast(300 + l_quantity as double) as x1")
    posts = table(spark, d, "orders").selectExpr("o_orderkey as id", "explode(array(80.0D, 200.0D, 290.0D)) as x", "o_orderkey").selectExpr("id", "x", "if(x = 200 and id % 3 = 0, 30.0D, 0.0D) as top", "cast(100 + id % 200 as double) as bottom")
    lines = table(spark, d, "lineitem").selectExpr("l_orderkey as id", "l_linenumber as line_no", "l_returnflag as text", "cast(60 + l_linenumber * 30 as double) as x0", "cast(100 + l_linenumber * 30 as double) as x1", "cast(l_linenumber * 22 as double) as top", "cast(l_linenumber * 22 + 9 as double) as bottom")
    out = TB.tables(lines.dropDuplicates(["id", "line_no"]), rules, posts, ["id"])
    return out.select("id", "table_no", "row", "col", "row_span", "col_span", "text")


def q65_recognition_export(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("page_no"), F.lit("text").alias("label"), F.col("text").alias("content"))
    lines = PG.recognised_lines(turns, ["conv_id"], "page_no")
    out = PG.recognition_export(turns.select("conv_id", "page_no").distinct(), lines, ["conv_id"], "page_no", F.col("conv_id") % 2 == 0)
    return out.select("conv_id", F.col("part").cast("long"), "page_no", "kind", F.col("line_no").cast("long"), "text")


def q66_table_counts(spark, d):
    boxes = _tables_of_documents(spark, d).where("top < 200 or doc_id % 3 = 0").where("doc_id % 5 > 0")
    return PG.table_counts(table(spark, d, "documents").select("doc_id").distinct(), boxes, ["doc_id"])


def q67_settings(spark, d):
    return CFG.as_rows(spark)


def q68_record_summaries(spark, d):
    record = F.expr("map('markdown', if(conv_id % 3 = 0, null, text), concat('k', turn % 4), text, 'page_index', cast(turn as string))")
    s = M.record_summary(record)
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(s["keys"], ",").alias("keys"), s["markdown_chars"].cast("long").alias("markdown_chars"), s["page_index"].alias("page_index"))


QUERIES = {name: f for name, f in list(globals().items()) if name[:1] == "q" and name[1:3].isdigit()}
