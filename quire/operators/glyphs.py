"""Glyphs to lines: visibility, rotation, clustering, spacing, superscripts, fonts.

Glyphs: one row each with ``doc_id, page, seq, x, y, advance, size, rise, rotation, rune,
font_id, render_mode, missing``; ``seq`` is paint order and closes every sort.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import stream
from .fixed import BASELINE_TOLERANCE, BINS, CLEAR, CLOSE, LEAST_ROWS, OPEN, ROTATION, SPACE_RATIO, SUPER_RISE, SUPER_SIZE
from .paragraphs import Leading


def visible(glyphs: DataFrame) -> DataFrame:
    """Without render modes 3 and 7, unless a page has nothing else."""
    seen = ~F.col("render_mode").isin(3, 7)
    any_seen = F.max(seen).over(W.partitionBy("doc_id", "page"))
    return glyphs.withColumn("any_seen", any_seen).where(seen | ~F.col("any_seen")).drop("any_seen")


def upright(glyphs: DataFrame) -> DataFrame:
    return glyphs.where(F.abs("rotation") <= ROTATION)


def page_counts(glyphs: DataFrame) -> DataFrame:
    """Per page: glyphs, visible and rotated ones, undecoded ones, and whether only invisible ones were there to use."""
    seen = ~F.col("render_mode").isin(3, 7)
    return glyphs.groupBy("doc_id", "page").agg(F.count("*").alias("n_glyphs"), F.count_if(seen).alias("n_visible"), F.count_if(F.abs("rotation") > ROTATION).alias("n_rotated"), F.count_if("missing").alias("n_missing"), (~F.max(seen)).alias("used_invisible"))


def cluster_lines(glyphs: DataFrame) -> DataFrame:
    """Glyphs with ``line``: by baseline, a new line where one lies farther than the tolerance from the line's first glyph.

    The anchor moves when a line opens, so this is a fold. It runs over a page's different
    baselines, with their glyph counts, rather than its glyphs.
    """
    rows = glyphs.withColumn("base", F.col("y") + F.col("rise"))
    size = rows.where("size > 0").groupBy("doc_id", "page").agg(F.median("size").alias("median_size"))
    bases = rows.groupBy("doc_id", "page").agg(F.sort_array(F.collect_set("base")).alias("bases")).join(size, ["doc_id", "page"], "left")
    tolerance = F.when(F.col("median_size") > 0, F.col("median_size") * BASELINE_TOLERANCE).otherwise(F.lit(1.0))
    zero = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("line"), F.array().cast("array<struct<base:double,line:int>>").alias("out"))

    def step(acc, y):
        opens = acc["anchor"].isNull() | (y - acc["anchor"] > F.col("tolerance"))
        line = acc["line"] + F.when(opens, 1).otherwise(0)
        return F.struct(F.when(opens, y).otherwise(acc["anchor"]).alias("anchor"), line.alias("line"), F.concat(acc["out"], F.array(F.struct(y.alias("base"), line.alias("line")))).alias("out"))

    numbered = bases.withColumn("tolerance", tolerance).select("doc_id", "page", F.explode(F.aggregate("bases", zero, step, lambda acc: acc["out"])).alias("b")).select("doc_id", "page", "b.base", "b.line")
    return rows.join(numbered, ["doc_id", "page", "base"]).drop("base")


def line_text(glyphs: DataFrame, line: str = "line") -> DataFrame:
    """One row per line: text with spaces put in at gaps, superscript runs bracketed, geometry, dominant font.

    A gap counts when it exceeds a quarter of the line's median advance. A run closes
    before a space. Blank lines go.
    """
    key = ["doc_id", "page", line]
    stats = glyphs.groupBy(*key).agg(F.median("advance").alias("step"), F.median(F.when(F.col("size") > 0, F.col("size"))).alias("line_size"), F.median(F.col("y") + F.col("rise")).alias("baseline"), F.min("x").alias("min_x"), F.max(F.col("x") + F.col("advance")).alias("max_x"), F.min(F.col("y") - 0.75 * F.col("size") - F.col("rise")).alias("min_y"), F.max(F.col("y") + 0.25 * F.col("size") - F.col("rise")).alias("max_y"), F.count("*").alias("n_glyphs"))
    fonts = glyphs.groupBy(*key, "font_id").count()
    fonts = fonts.groupBy(*key).agg(F.min(F.struct((-F.col("count")).alias("n"), "font_id")).alias("best")).select(*key, F.col("best.font_id").alias("font_id"))
    order = W.partitionBy(*key).orderBy("x", "seq")
    rows = glyphs.select(*key, "x", "seq", "advance", "rune", "rise", "y", "size").join(stats.select(*key, "step", "line_size", "baseline"), key)
    gap = F.col("x") - F.lag(F.col("x") + F.col("advance")).over(order)
    raised = (F.col("rise") > 0) | ((F.col("baseline") - F.col("y") > SUPER_RISE * F.col("line_size")) & (F.col("size") < SUPER_SIZE * F.col("line_size")))
    rows = rows.withColumn("space", F.coalesce(gap > SPACE_RATIO * F.col("step"), F.lit(False)) & (F.col("rune") != " ") & (F.lag("rune").over(order) != " ")).withColumn("sup", raised)
    was, nxt = F.coalesce(F.lag("sup").over(order), F.lit(False)), F.coalesce(F.lead("sup").over(order), F.lit(False))
    ends = F.when(F.col("sup") & ~nxt, CLOSE).otherwise("")
    piece = F.concat(F.when(F.col("space"), " ").otherwise(""), F.when(F.col("sup") & ~was, OPEN).otherwise(""), F.col("rune"), ends)
    texts = rows.withColumn("piece", piece).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("x", "seq", "piece"))).alias("all"), F.max("sup").alias("has_superscript"))
    texts = texts.select(*key, F.rtrim(F.array_join(F.transform("all", lambda p: p["piece"]), "")).alias("text"), "has_superscript")
    out = texts.join(stats.drop("step"), key).join(fonts, key)
    return out.where(F.trim(F.translate("text", OPEN + CLOSE, "")) != "").select(*key, "text", "has_superscript", F.col("line_size").alias("size"), "baseline", "min_x", "max_x", "min_y", "max_y", "n_glyphs", "font_id")


def strip_marks(text):
    return F.translate(text, OPEN + CLOSE, "")


def gutters(glyphs: DataFrame) -> DataFrame:
    """``(doc_id, page, min_x, max_x, strength)`` of vertical strips that most text rows leave clear.

    Rows are 1.2 median sizes high, the page's text width is cut in 512 bins, a glyph
    covers the bins of its advance. A strip of bins clear in 60 % of the rows, not at an
    edge and twice a space wide, is a gutter. Rows that a stream gives too (see
    ``stream.also``) are taken from there, and none of them is moved.
    """
    if "spread_from" in vars(glyphs):
        return stream.over(*glyphs.spread_from, stream.gutters, stream.GUTTERS)
    key = ["doc_id", "page"]
    page = glyphs.groupBy(*key).agg(F.min("x").alias("x0"), F.max(F.col("x") + F.col("advance")).alias("x1"), F.min("y").alias("y0"), F.median("size").alias("mid"))
    page = page.where("x1 > x0")
    rows = glyphs.where("rune <> ' '").join(page, key)
    row = F.floor((F.col("y") - F.col("y0")) / (1.2 * F.col("mid")))
    at = lambda v: F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((v - F.col("x0")) / (F.col("x1") - F.col("x0")) * BINS))).cast("int")
    spans = rows.select(*key, row.alias("row"), at(F.col("x")).alias("b0"), at(F.col("x") + F.col("advance")).alias("b1")).distinct()
    n_rows = spans.groupBy(*key).agg(F.countDistinct("row").alias("n_rows")).where(F.col("n_rows") >= LEAST_ROWS)
    covered = spans.select(*key, "row", F.explode(F.sequence("b0", "b1")).alias("bin")).groupBy(*key, "bin").agg(F.countDistinct("row").alias("full"))
    bins = n_rows.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1)))).join(covered, [*key, "bin"], "left")
    bins = bins.withColumn("clear", 1 - F.coalesce("full", F.lit(0)) / F.col("n_rows")).where(F.col("clear") >= CLEAR)
    run = F.col("bin") - F.row_number().over(W.partitionBy(*key).orderBy("bin"))
    runs = bins.withColumn("run", run).groupBy(*key, "run").agg(F.min("bin").alias("b0"), F.max("bin").alias("b1"), F.avg("clear").alias("clear")).join(page, key)
    width = (F.col("x1") - F.col("x0")) / BINS
    low, high = F.col("x0") + F.col("b0") * width, F.col("x0") + (F.col("b1") + 1) * width
    found = runs.where((F.col("b0") > 0) & (F.col("b1") < BINS - 1)).select(*key, low.alias("min_x"), high.alias("max_x"), ((high - low) * F.col("clear")).alias("strength"), (0.5 * F.col("mid")).alias("least"))
    return found.where(F.col("max_x") - F.col("min_x") >= F.col("least")).drop("least")


def strongest(found: DataFrame, columns: int = 3) -> DataFrame:
    """The gutters that part a page into at most ``columns``, numbered from the left."""
    rank = F.row_number().over(W.partitionBy("doc_id", "page").orderBy(F.desc("strength"), "min_x"))
    kept = found.withColumn("rank", rank).where(F.col("rank") < columns)
    return kept.withColumn("gutter", F.row_number().over(W.partitionBy("doc_id", "page").orderBy("min_x")) - 1).drop("rank")


def reading_order(lines: DataFrame, cuts: DataFrame) -> DataFrame:
    """Lines (``doc_id, page, ord, min_x, max_x``) with ``col`` and ``position``.

    A line over a gutter's middle is a barrier (column -1) and opens a band; within a band
    the columns follow each other.
    """
    key = ["doc_id", "page"]
    mids = cuts.groupBy(*key).agg(F.sort_array(F.collect_list((F.col("min_x") + F.col("max_x")) / 2)).alias("mids"))
    rows = lines.join(mids, key, "left").withColumn("mids", F.coalesce("mids", F.array().cast("array<double>")))
    over = F.exists("mids", lambda m: (m > F.col("min_x")) & (m < F.col("max_x")))
    col = F.when(over, -1).otherwise(F.size(F.filter("mids", lambda m: m <= (F.col("min_x") + F.col("max_x")) / 2)))
    rows = rows.withColumn("col", col)
    order = W.partitionBy(*key).orderBy("ord")
    rows = rows.withColumn("band", F.sum((F.col("col") == -1).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.withColumn("position", F.row_number().over(W.partitionBy(*key).orderBy("band", F.col("col") != -1, "col", "ord"))).drop("mids", "band")


def segment_blocks(lines: DataFrame) -> DataFrame:
    """Ordered lines with ``block``: a break at a wide gap, another size or family, a step back, or too little overlap.

    The usual leading is the median of those seen in the block so far, or 1.2 sizes where
    that is not positive, and the bounds grow with it, so a page is a fold over its lines; pages are grouped, lines are few.
    """
    def fold(key, page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("ord").reset_index(drop=True)
        block, out, leading = -1, [], Leading()
        left = right = 0.0
        prev = None
        for r in page.itertuples():
            opens = prev is None
            if not opens:
                gap = r.baseline - prev.baseline
                largest = max(abs(prev.size), abs(r.size))
                shared, narrow = min(right, r.max_x) - max(left, r.min_x), min(right - left, r.max_x - r.min_x)
                overlap = 0.0 if shared <= 0 else shared / narrow if narrow > 0 else 1.0
                opens = gap < 0 or gap > 1.5 * leading.usual(max(prev.size, r.size)) or (largest > 0 and abs(prev.size - r.size) / largest > 0.15) or r.family != prev.family or overlap < 0.5
            if opens:
                block, leading, left, right = block + 1, Leading(), r.min_x, r.max_x
            else:
                leading.add(gap)
                left, right = min(left, r.min_x), max(right, r.max_x)
            out.append(block)
            prev = r
        return pd.DataFrame({"doc_id": page["doc_id"], "page": page["page"], "ord": page["ord"], "block": pd.Series(out, dtype="int64")})

    cols = lines.select("doc_id", "page", "ord", "baseline", "size", "family", "min_x", "max_x")
    return cols.groupBy("doc_id", "page").applyInPandas(fold, "doc_id long, page int, ord long, block long")
