"""Chapters, parts and the navigation tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPLIT_LEVEL, LEVELS = 2, 6
WRAPPER, LEAST_PART = 512, 1024


def chapters(blocks: DataFrame) -> DataFrame:
    """Blocks (``doc_id, ord, level``) with ``chapter``: a heading of a splitting level opens one, the first block never does."""
    order = W.partitionBy("doc_id").orderBy("ord")
    opens = (F.col("level") <= SPLIT_LEVEL) & (F.row_number().over(order) > 1)
    return blocks.withColumn("opens", F.coalesce(opens, F.lit(False)).cast("int")).withColumn("chapter", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("opens")


def chapter_titles(rows: DataFrame) -> DataFrame:
    """Per chapter its first heading that is not blank; else the document for chapter 0, else the page."""
    head = F.when(F.col("level").isNotNull() & (F.trim("text") != ""), F.col("text"))
    agg = rows.groupBy("doc_id", "chapter").agg(F.min_by(head, F.when(head.isNotNull(), F.col("ord"))).alias("head"), F.min("page").alias("page"), F.count("*").alias("n_blocks"))
    title = F.coalesce("head", F.when(F.col("chapter") == 0, F.lit("Untitled")).otherwise(F.concat(F.lit("Page "), (F.col("page") + 1).cast("string"))))
    return agg.select("doc_id", "chapter", title.alias("title"), "n_blocks")


def nav_tree(heads: DataFrame) -> DataFrame:
    """Headings with ``parent``, the ord of the nearest heading before of a lower level, and ``depth``.

    Levels are few, so the parent is the latest of the last headings of each lower level;
    no stack is needed and each document is one window.
    """
    before = W.partitionBy("doc_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    level = F.greatest(F.col("level"), F.lit(1))
    rows = heads.withColumn("level", level)
    last = [F.last(F.when(F.col("level") == k, F.col("ord")), ignorenulls=True).over(before) for k in range(1, LEVELS)]
    rows = rows.withColumns({f"last_{k + 1}": c for k, c in enumerate(last)})
    parent = F.greatest(F.lit(None).cast("long"), F.lit(None).cast("long"), *(F.when(F.col("level") > k, F.col(f"last_{k}")) for k in range(1, LEVELS)))
    return rows.withColumn("parent", parent).drop(*(f"last_{k}" for k in range(1, LEVELS)))


def truncated(nav: DataFrame, depth: int = 2) -> DataFrame:
    """The entries at most ``depth`` deep: an entry's depth is one more than its parent's."""
    level_one = nav.where("parent IS NULL").select("doc_id", "ord", F.lit(1).alias("depth"))
    out, above = level_one, level_one
    for k in range(2, depth + 1):
        above = nav.join(above.select("doc_id", F.col("ord").alias("parent")), ["doc_id", "parent"]).select("doc_id", "ord", F.lit(k).alias("depth"))
        out = out.unionByName(above)
    return nav.join(out, ["doc_id", "ord"])


def rendered_size(text: Column) -> Column:
    """Estimated bytes of a rendered block."""
    return F.floor(F.octet_length(text) * 12 / 10) + 32


def split_by_size(rows: DataFrame, limit: int) -> DataFrame:
    """Rows (``doc_id, chapter, ord, size``) with ``part``: greedy packing up to the limit, in order.

    A sum that starts anew when it overflows is no window, so each chapter folds over its
    sizes (numbers, not texts). An oversized block has a part of its own if that part is empty.
    """
    budget = max(LEAST_PART, limit - WRAPPER)
    packed = rows.groupBy("doc_id", "chapter").agg(F.sort_array(F.collect_list(F.struct("ord", "size"))).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("part"), F.array().cast("array<struct<ord:bigint,part:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        over = (acc["used"] > 0) & (acc["used"] + x["size"] > budget)
        part = acc["part"] + F.when(over, 1).otherwise(0)
        return F.struct((F.when(over, 0).otherwise(acc["used"]) + x["size"]).cast("long").alias("used"), part.alias("part"), F.concat(acc["out"], F.array(F.struct(x["ord"].alias("ord"), part.alias("part")))).alias("out"))

    done = packed.select("doc_id", "chapter", F.explode(F.aggregate("items", zero, step, lambda acc: acc["out"])).alias("x"))
    return done.select("doc_id", "chapter", "x.ord", "x.part")


def hrefs(links: DataFrame) -> DataFrame:
    """``#id`` within a file, ``file#id`` across files."""
    return links.withColumn("href", F.when(F.col("from_file") == F.col("to_file"), F.concat(F.lit("#"), F.col("to_id"))).otherwise(F.concat(F.col("to_file"), F.lit("#"), F.col("to_id"))))
