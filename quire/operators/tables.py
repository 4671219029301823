"""Ruled tables: regions, grid lines, cells, confidence; figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REGION_GAP, CLUSTER_GAP, COVER = 36.0, 2.0, 0.6
LEAST_FILLED, COLUMN_ROWS, ALIGNED_COLUMNS = 0.5, 3, 2


def regions(rules: DataFrame) -> DataFrame:
    """Rules with ``region``: by their top, a new one where it lies more than 36 below all before."""
    order = W.partitionBy("doc_id", "page").orderBy("min_y", "seq")
    reach = F.max("max_y").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rules.withColumn("opens", F.coalesce(F.col("min_y") - reach > REGION_GAP, F.lit(False)).cast("int"))
    return rows.withColumn("region", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("opens")


def grid_lines(ruled: DataFrame) -> DataFrame:
    """``(doc_id, page, region, horizontal, k, at)``: positions chained by gaps of two points, at their mean, numbered."""
    key = ["doc_id", "page", "region", "horizontal"]
    at = F.when(F.col("horizontal"), (F.col("min_y") + F.col("max_y")) / 2).otherwise((F.col("min_x") + F.col("max_x")) / 2)
    order = W.partitionBy(*key).orderBy("at", "seq")
    rows = ruled.withColumn("at", at).withColumn("opens", F.coalesce(F.col("at") - F.lag("at").over(order) > CLUSTER_GAP, F.lit(False)).cast("int"))
    rows = rows.withColumn("k", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*key, "k").agg(F.avg("at").alias("at"))


def grids(ruled: DataFrame) -> DataFrame:
    """Regions with at least three different lines each way."""
    n = grid_lines(ruled).groupBy("doc_id", "page", "region").agg(F.count_if("horizontal").alias("n_rows"), F.count_if(~F.col("horizontal")).alias("n_cols"))
    return n.where("n_rows >= 3 AND n_cols >= 3").select("doc_id", "page", "region", (F.col("n_rows") - 1).alias("n_rows"), (F.col("n_cols") - 1).alias("n_cols"))


def cells(ruled: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Glyph counts and text by grid cell, empty cells included. A glyph lies in a cell by its centre and baseline, edges included.

    The containment join is an equi-join on the page with range conditions, so it stays
    within pages; each side of it is small.
    """
    key = ["doc_id", "page", "region"]
    lines = grid_lines(ruled).join(grids(ruled).select(*key), key)
    step = W.partitionBy(*key, "horizontal").orderBy("k")
    lines = lines.withColumn("upto", F.lead("at").over(step)).where("upto IS NOT NULL")
    rows = lines.where("horizontal").select(*key, F.col("k").alias("row"), F.col("at").alias("y0"), F.col("upto").alias("y1"))
    cols = lines.where(~F.col("horizontal")).select(*key, F.col("k").alias("col"), F.col("at").alias("x0"), F.col("upto").alias("x1"))
    boxes = rows.join(cols, key)
    centre = F.col("x") + F.col("advance") / 2
    placed = boxes.join(glyphs.select("doc_id", "page", "seq", "ord", "x", "y", "advance", "rune"), ["doc_id", "page"]).where((centre >= F.col("x0")) & (centre <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1")))
    text = placed.groupBy(*key, "row", "col").agg(F.sort_array(F.collect_list(F.struct("ord", "x", "seq", "rune"))).alias("all"))
    text = text.select(*key, "row", "col", F.trim(F.array_join(F.transform("all", lambda g: g["rune"]), "")).alias("text"))
    return boxes.select(*key, "row", "col").join(text, [*key, "row", "col"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def confidence(found: DataFrame) -> DataFrame:
    """Tables of at least two rows and columns whose cells are filled and substantial; high where two columns are filled on three rows."""
    key = ["doc_id", "page", "region"]
    full = F.length("text") > 0
    columns = found.groupBy(*key, "col").agg(F.count_if(full).alias("n")).groupBy(*key).agg(F.count_if(F.col("n") >= COLUMN_ROWS).alias("aligned"), F.count("*").alias("n_cols"))
    table = found.groupBy(*key).agg(F.countDistinct("row").alias("n_rows"), F.count("*").alias("n_cells"), F.count_if(full).alias("filled"), F.count_if(F.length("text") > 1).alias("substantial"))
    out = table.join(columns, key).where("n_rows >= 2 AND n_cols >= 2").where((F.col("filled") >= LEAST_FILLED * F.col("n_cells")) & (F.col("substantial") >= 0.5 * F.col("filled")) & (F.col("filled") > 0))
    return out.select(*key, "n_rows", "n_cols", "filled", F.when(F.col("aligned") >= ALIGNED_COLUMNS, "high").otherwise("medium").alias("confidence"))


def figures(images: DataFrame, page_width: float = 612.0, page_height: float = 792.0) -> DataFrame:
    """Image placements that are figures: not inline, not a background under text, neither thin nor tiny."""
    width, height = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    area = width * height / (page_width * page_height)
    backdrop = (area > 0.95) & (F.col("glyphs_before") == 0) & (F.col("page_glyphs") > 0)
    return images.where(~F.col("inline") & (width > 0) & (height > 0) & ~backdrop & (F.least(width, height) >= 16) & (area >= 0.02))


def image_ids(images: DataFrame) -> DataFrame:
    """Images by content digest, first appearance first, with ids ``img000`` onwards per document."""
    first = images.groupBy("doc_id", "digest").agg(F.min(F.struct("page", "ord")).alias("at"), F.count("*").alias("placements"))
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("at")) - 1
    return first.select("doc_id", "digest", F.concat(F.lit("img"), F.lpad(n.cast("string"), 3, "0")).alias("image_id"), "placements")
