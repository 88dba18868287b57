"""Page quality, document roll-up, routing, and the audit of recognised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from .config import EngineConfig


def full_page(width: Column, height: Column, page_width: Column, page_height: Column, least_pixels: int) -> Column:
    """Large enough, and shaped as the page within 3 percent; false for unknown sizes."""
    aspect, page = width / height, page_width / page_height
    return F.coalesce((width * height >= least_pixels) & (F.abs(aspect - page) / page <= 0.03), F.lit(False))


def image_stats(images: DataFrame, keys: list[str], cfg: EngineConfig) -> DataFrame:
    """images, full_images and max_pixels a page; images without size count only as images."""
    full = full_page(F.col("width"), F.col("height"), F.col("page_width"), F.col("page_height"), cfg.full_page_pixels)
    return images.groupBy(*keys).agg(
        F.count("*").alias("images"), F.count_if(full).alias("full_images"), F.coalesce(F.max(F.col("width") * F.col("height")), F.lit(0)).cast("long").alias("max_pixels")
    )


def page_counts(pages: DataFrame) -> DataFrame:
    """pages (text, ...) with chars, garbled and url_chars in place of text."""
    return pages.withColumn("clean", T.normalize(F.col("text"))).select(
        *[c for c in pages.columns if c != "text"], T.visible_chars(F.col("clean")).alias("chars"), T.garbled_chars(F.col("clean")).alias("garbled"), T.url_chars(F.col("clean")).alias("url_chars")
    )


def page_verdict(cfg: EngineConfig) -> Column:
    """struct(score in hundredths, high_quality) of a row of page_counts() with images and full_images."""
    n = F.greatest("chars", F.lit(1))
    off = lambda test, k: F.when(test, k).otherwise(0)
    score = (
        F.lit(100) - off(F.col("chars") < cfg.min_page_chars, 55) - off(F.col("full_images") > 0, 45) - off(F.col("garbled") > 0, 35)
        - off(F.col("garbled") / n > cfg.garbled_ratio, 25) - off(F.col("url_chars") * 100 > n * 25, 15)
        - off((F.col("images") > 0) & (F.col("chars") < max(5 * cfg.min_page_chars, 100)), 15)
    )
    score = F.greatest(F.lit(0), score)
    return F.struct(score.alias("score"), ((F.col("chars") >= cfg.min_page_chars) & (score >= 75)).alias("high_quality"))


def page_quality(pages: DataFrame, cfg: EngineConfig) -> DataFrame:
    """pages (text, images, full_images) with chars, garbled, url_chars, score in hundredths and high_quality."""
    counted = page_counts(pages)
    return counted.withColumn("_v", page_verdict(cfg)).select(*counted.columns, "_v.score", "_v.high_quality")


def document_quality(pages: DataFrame, key: str, cfg: EngineConfig) -> DataFrame:
    return pages.groupBy(key).agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("chars") >= cfg.min_page_chars).alias("usable"),
        F.count_if("high_quality").alias("high_quality"),
        F.sum("chars").alias("chars"),
        F.count_if(F.col("full_images") > 0).alias("full_image_pages"),
        F.sum("garbled").alias("garbled"),
        F.sum("url_chars").alias("url_chars"),
    )


def route(documents: DataFrame, cfg: EngineConfig) -> DataFrame:
    """documents of document_quality() with route and reason."""
    return documents.withColumn("_r", route_of(cfg)).select(*documents.columns, "_r.route", "_r.reason")


def route_of(cfg: EngineConfig) -> Column:
    """struct(route, reason) of a row of document_quality()."""
    n = F.greatest("pages", F.lit(1))
    usable = (F.col("usable") > 0) & (F.col("chars") >= cfg.min_page_chars) & (F.col("usable") / n >= cfg.usable_ratio)
    complete = (F.col("pages") > 0) & (F.col("high_quality") > 0) & (F.col("high_quality") / n >= cfg.high_quality_ratio)
    pair = lambda a, b: F.struct(F.lit(a).alias("route"), F.lit(b).alias("reason"))
    if cfg.route_mode == "ocr":
        return pair("ocr", "forced_ocr")
    if cfg.route_mode == "text":
        return F.when(usable, pair("text", "forced_text")).otherwise(pair("error", "text_layer_not_usable"))
    return F.when(complete, pair("text", "text_layer_complete")).when(usable, pair("page_image", "text_layer_incomplete")).otherwise(pair("ocr", "text_layer_not_usable"))


def ocr_audit(pages: DataFrame) -> DataFrame:
    """pages (texts array<string>, scores array<string>) with the audit columns; scores that aren't numbers are skipped.

    mean and min are null without scores, low_ratio is then 1.
    """
    scores = F.filter(F.transform("scores", lambda s: s.try_cast("double")), lambda s: s.isNotNull() & ~F.isnan(s))
    texts = F.transform("texts", lambda t: T.normalize(t))
    rows = pages.withColumns({"_s": scores, "_t": texts})
    n = F.size("_s")
    chars = F.aggregate("_t", F.lit(0), lambda a, t: a + T.visible_chars(t))
    rows = rows.withColumns({
        "lines": F.size("texts"), "non_empty": F.size(F.filter("_t", lambda t: t != "")), "chars": chars,
        "mean": F.when(n > 0, F.aggregate("_s", F.lit(0.0), lambda a, s: a + s) / n), "min": F.array_min("_s"),
        "low": F.size(F.filter("_s", lambda s: s < 0.75)), "suspicious": F.aggregate("_t", F.lit(0), lambda a, t: a + F.regexp_count(t, F.lit(P.SUSPICIOUS))),
    })
    rows = rows.withColumn("low_ratio", F.when(n > 0, F.col("low") / n).otherwise(1.0))
    doubt = (F.col("lines") == 0) | (F.col("non_empty") == 0) | (n == 0) | (F.col("low_ratio") > 0.25) | (F.col("mean") < 0.75) | (F.col("suspicious") * 20 > F.greatest("chars", F.lit(1)))
    return rows.withColumn("needs_review", F.coalesce(doubt, F.lit(True))).drop("_s", "_t")
