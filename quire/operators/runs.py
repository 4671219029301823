"""Runs within lines and small merges: styles, gutter splits, lone markers, inline figures, upper medians, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAST_LETTERS = 2
SPACE_RATIO = 0.25


def style_runs(glyphs: DataFrame, line: str = "ord") -> DataFrame:
    """``(doc_id, page, line, start, end, bold, italic)``: stretches of styled glyphs of a line, in glyph positions.

    A stretch that covers its whole line is the line's own style and goes, as do those of
    fewer than two letters.
    """
    key = ["doc_id", "page", line]
    order = W.partitionBy(*key).orderBy("x", "seq")
    rows = glyphs.withColumn("at", F.row_number().over(order) - 1)
    same = (F.lag("bold").over(order) == F.col("bold")) & (F.lag("italic").over(order) == F.col("italic"))
    rows = rows.withColumn("run", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("n_line", F.count("*").over(W.partitionBy(*key)))
    runs = rows.groupBy(*key, "run", "bold", "italic", "n_line").agg(F.min("at").alias("start"), (F.max("at") + 1).alias("end"), F.count_if(F.col("rune").rlike(r"\p{L}")).alias("letters"))
    kept = runs.where((F.col("bold") | F.col("italic")) & (F.col("end") - F.col("start") < F.col("n_line")) & (F.col("letters") >= LEAST_LETTERS))
    return kept.select(*key, "start", "end", "bold", "italic")


def split_at_gutters(glyphs: DataFrame, cuts: DataFrame, line: str = "ord") -> DataFrame:
    """Glyphs with ``segment``: a line parts after a glyph whose gap holds a gutter's middle and is twice a space wide."""
    key = ["doc_id", "page", line]
    mids = cuts.groupBy("doc_id", "page").agg(F.collect_list((F.col("min_x") + F.col("max_x")) / 2).alias("mids"))
    step = glyphs.groupBy(*key).agg(F.median("advance").alias("step"))
    order = W.partitionBy(*key).orderBy("x", "seq")
    rows = glyphs.join(step, key).join(mids, ["doc_id", "page"], "left").withColumn("from_x", F.lag(F.col("x") + F.col("advance")).over(order))
    inside = F.exists(F.coalesce("mids", F.array().cast("array<double>")), lambda m: (m > F.col("from_x")) & (m < F.col("x")))
    opens = inside & (F.col("x") - F.col("from_x") >= 2 * SPACE_RATIO * F.col("step"))
    rows = rows.withColumn("segment", F.sum(F.when(F.coalesce(opens, F.lit(False)), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.drop("step", "mids", "from_x")


def merge_markers(blocks: DataFrame, page_height: float = 792.0, band: float = 0.2) -> DataFrame:
    """Blocks with lone footnote markers joined to the prose that follows them.

    A marker by itself, in the bottom band, next to prose (eight letters) of the same page
    that is not set farther left and less than two sizes away. Prose can never be a lone
    marker itself, so one look ahead is enough.
    """
    order = W.partitionBy("doc_id").orderBy("ord")
    lone = F.col("text").rlike(r"^(?:[0-9]{1,3}|[*†‡])[.)\]]?$")
    prose = F.regexp_count("text", F.lit(r"\p{L}")) >= 8
    low = F.col("min_y") >= page_height * (1 - band)

    def pair(first: list, then: list):
        return first[0] & then[1] & first[2] & then[2] & (first[3] == then[3]) & (then[4] >= first[4] - 1) & (F.abs(then[5] - first[5]) < 2 * F.greatest(first[6], then[6]))

    rows = blocks.withColumns({"lone": lone, "prose": prose, "low": low})
    own = [F.col(c) for c in ("lone", "prose", "low", "page", "min_x", "min_y", "size")]
    ahead = [F.lead(c).over(order) for c in ("lone", "prose", "low", "page", "min_x", "min_y", "size")]
    behind = [F.lag(c).over(order) for c in ("lone", "prose", "low", "page", "min_x", "min_y", "size")]
    rows = rows.withColumns({"goes": F.coalesce(pair(own, ahead), F.lit(False)), "takes": F.coalesce(pair(behind, own), F.lit(False)), "marker": F.lag("text").over(order)})
    text = F.when(F.col("takes"), F.concat_ws(" ", "marker", "text")).otherwise(F.col("text"))
    return rows.withColumn("text", text).where(~F.col("goes")).select(*blocks.columns)


def inline_figures(figures: DataFrame, blocks: DataFrame, column_width: float) -> DataFrame:
    """Figures narrower than 0.4 of the column that lie strictly inside a block of two lines or more."""
    hosts = blocks.where("n_lines >= 2").select("doc_id", "page", F.col("min_y").alias("host_y0"), F.col("max_y").alias("host_y1"))
    small = figures.where(F.col("max_x") - F.col("min_x") < 0.4 * column_width)
    inside = (small["doc_id"] == hosts["doc_id"]) & (small["page"] == hosts["page"]) & (hosts["host_y0"] < small["min_y"]) & (hosts["host_y1"] > small["max_y"])
    return small.join(hosts, inside, "left_semi")


def upper_median(rows: DataFrame, value: str, *key: str) -> DataFrame:
    """The middle value, the upper one of two; never a mean."""
    ranked = rows.select(*key, value).withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(value))).withColumn("n", F.count("*").over(W.partitionBy(*key)))
    return ranked.where(F.col("rank") == F.floor(F.col("n") / 2) + 1).select(*key, F.col(value).alias("upper_median"))


def metadata(info: DataFrame) -> DataFrame:
    """Title, language and time of change: what was asked for, what the file says, a default."""
    given = lambda c: F.when(F.trim(c) != "", F.trim(c))
    title = F.coalesce(given("asked_title"), given("title"), F.lit("Untitled"))
    language = F.coalesce(given("asked_language"), given("language"), F.lit("en"))
    return info.select("doc_id", title.alias("title"), language.alias("language"), F.coalesce("asked_modified", "modified", "created", F.to_timestamp(F.lit("1970-01-01 00:00:00"))).alias("modified"))
