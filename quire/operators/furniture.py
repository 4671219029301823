"""Running heads and folios; scanned documents; page statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0
BAND, REPEAT, SAMPLE, LEAST_PAGES = 0.08, 0.6, 20, 5
SCAN_GLYPHS, SCAN_PAGES, COVER, GRID = 20, 0.8, 0.8, 32
#: Fixed value: a number, a roman numeral, or one of them between dashes or after "page".
FOLIO = r"^(?i:[ \t]*(?:page[ \t]+)?[-–—]?[ \t]*(?:[0-9]{1,4}|[ivxlcdm]{1,7})[ \t]*[-–—]?[ \t]*)$"


def even_sample(pages: DataFrame, n: int = SAMPLE) -> DataFrame:
    """``(doc_id, page)`` of at most ``n`` pages, evenly spread, the first and last among them."""
    ranked = pages.select("doc_id", "page").distinct().groupBy("doc_id").agg(F.sort_array(F.collect_set("page")).alias("all"))
    at = F.when(F.size("all") <= n, F.sequence(F.lit(0), F.size("all") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(i * (F.size("all") - 1) / F.lit(float(n - 1))).cast("int")))
    return ranked.select("doc_id", F.explode(F.array_distinct(F.transform(at, lambda i: F.col("all")[i]))).alias("page"))


def text_key(text: Column) -> Column:
    """Digits as ``#``, small letters, without punctuation and spaces; 16 hex digits of SHA-256."""
    flat = F.regexp_replace(F.lower(F.regexp_replace(text, "[0-9]", "#")), r"[^\p{L}#]+", "")
    return F.substring(F.sha2(flat, 256), 1, 16)


def in_band(min_y: Column, max_y: Column) -> Column:
    return (max_y <= PAGE_HEIGHT * BAND) | (min_y >= PAGE_HEIGHT * (1 - BAND))


def furniture(blocks: DataFrame) -> DataFrame:
    """``(doc_id, ord, reason)`` of blocks to remove: text repeated, folio, or position repeated, in that order.

    Repeats are counted on the sampled pages, in the bands; removal is on all pages. A
    document of fewer than five pages keeps everything.
    """
    band = blocks.where(in_band(F.col("min_y"), F.col("max_y")))
    position = F.concat_ws(":", *(F.round(c).cast("long").cast("string") for c in ("min_y", "max_y", "min_x")))
    band = band.select("doc_id", "ord", "page", F.col("text").rlike(FOLIO).alias("folio"), text_key(F.col("text")).alias("text_key"), position.alias("position_key"))
    sample = even_sample(blocks)
    need = sample.groupBy("doc_id").agg(F.greatest(F.lit(2), F.ceil(F.count("*") * F.lit(REPEAT))).alias("need"), F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    seen = band.join(sample, ["doc_id", "page"])
    out = band.join(need, "doc_id")
    for key in ("text_key", "position_key"):
        n = seen.groupBy("doc_id", key).agg(F.countDistinct("page").alias(f"n_{key}"))
        out = out.join(n, ["doc_id", key], "left")
    reason = F.when(F.col("n_text_key") >= F.col("need"), "text").when(F.col("folio"), "folio").when(F.col("n_position_key") >= F.col("need"), "position")
    return out.withColumn("reason", reason).where("reason IS NOT NULL").select("doc_id", "ord", "reason")


def scan_outcome(pages: DataFrame) -> DataFrame:
    """Per document ``no_text_layer``, ``warn`` or ``ok`` from visible glyphs and image cover of its pages."""
    agg = pages.groupBy("doc_id").agg(F.median("visible").alias("median_glyphs"), F.avg((F.col("cover") >= COVER).cast("double")).alias("image_pages"))
    low = F.col("median_glyphs") < SCAN_GLYPHS
    return agg.select("doc_id", "median_glyphs", F.round("image_pages", 6).alias("image_pages"), F.when(low & (F.col("image_pages") > SCAN_PAGES), "no_text_layer").when(low, "warn").otherwise("ok").alias("outcome"))


def image_cover(images: DataFrame) -> DataFrame:
    """Per page the share of a 32 x 32 grid that image rectangles touch."""
    def span(a: str, b: str, size: float) -> Column:
        low = F.greatest(F.floor(F.col(a) / size * GRID), F.lit(0))
        high = F.least(F.ceil(F.col(b) / size * GRID) - 1, F.lit(GRID - 1))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    cells = images.select("doc_id", "page", F.explode(span("min_x", "max_x", PAGE_WIDTH)).alias("cx"), span("min_y", "max_y", PAGE_HEIGHT).alias("rows"))
    cells = cells.select("doc_id", "page", "cx", F.explode("rows").alias("cy")).select("doc_id", "page", (F.col("cx") * GRID + F.col("cy")).alias("cell"))
    return cells.groupBy("doc_id", "page").agg(F.round(F.countDistinct("cell") / float(GRID * GRID), 6).alias("cover"))


def page_sizes(pages: DataFrame) -> DataFrame:
    """Distinct page sizes per document with counts and first page."""
    return pages.groupBy("doc_id", F.round("width", 2).alias("width"), F.round("height", 2).alias("height"), "rotate").agg(F.count("*").alias("n_pages"), F.min("page").alias("first_page"))


#: Blocks of scripts written right to left.
RTL = r"[֐-׿؀-ۿ܀-ݏݐ-ݿހ-޿߀-߿ࠀ-࠿ࡀ-࡟ࢠ-ࣿיִ-﷿ﹰ-﻿]"


def script_ratio(blocks: DataFrame) -> DataFrame:
    """Letters per document, those right to left, and whether they are a fifth or more."""
    letters = F.regexp_count("text", F.lit(r"\p{L}"))
    rtl = F.regexp_count(F.regexp_replace("text", r"[^\p{L}]", ""), F.lit(RTL))
    agg = blocks.groupBy("doc_id").agg(F.sum(letters).alias("letters"), F.sum(rtl).alias("rtl_letters"))
    return agg.withColumn("right_to_left", (F.col("letters") > 0) & (F.col("rtl_letters") >= 0.2 * F.col("letters")))


def quality(pages: DataFrame) -> DataFrame:
    """Score per document: 100 less for undecoded glyphs, warnings, and pages without text."""
    agg = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("n_glyphs").alias("glyphs"), F.sum("n_missing").alias("missing"), F.sum((F.col("n_glyphs") == 0).cast("long")).alias("empty"))
    rate = F.when(F.col("glyphs") > 0, F.col("missing") / F.col("glyphs")).otherwise(F.lit(0.0))
    warnings = F.when(rate > 0.05, 1).otherwise(0)
    score = 100 - F.least(F.lit(40.0), rate * 800) - F.least(F.lit(20.0), 2.0 * warnings) - F.when(F.col("glyphs") == 0, 30.0).otherwise(0.0) - F.least(F.lit(20.0), F.col("empty") * 40.0 / F.col("pages"))
    return agg.select("doc_id", "pages", "glyphs", "missing", F.greatest(F.lit(0.0), F.round(score)).cast("long").alias("score"))
