"""Document-wide statistics and block kinds.

Blocks: one row each with ``doc_id, ord, page, text, size, family, bold, fixed, n_lines,
n_glyphs, min_x, max_x, min_y, max_y``. Aggregates go per document and come back by an
equi-join on ``doc_id``, which reuses the blocks' own partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SIZE_STEP = 0.5
HEADING_SIZE_RATIO, HEADING_MAX_WORDS, HEADING_BOLD_MAX_WORDS, HEADING_LEVELS = 0.15, 50, 15, 6
QUOTE_INDENT_EM = 1.5
FOOTNOTE_BAND, FOOTNOTE_SIZE, PROSE_LETTERS = 0.2, 0.1, 8
PAGE_HEIGHT = 792.0
#: Fixed value: a bullet, or a short number, roman numeral or letter with its closing mark, then white space and text.
MARKER = r"^(?:[•◦▪‣*-]|\(?(?:[0-9]{1,3}|[ivxlcdm]+|[A-Za-z])[.)\]])[ \t\n]+[^ \t\n]"
NOTE_MARKER = r"^(?:[0-9]{1,3}|[*†‡])[.)\]]?[ \t\n]+[^ \t\n]"
#: Fixed value: closing quotes and brackets may follow the mark that ends a sentence.
TERMINAL = r"[.!?…。！？][\"'”’)\] \t\n]*$"


def quantised(size: Column) -> Column:
    """Sizes in half points, halves away from zero."""
    return F.round(size / SIZE_STEP) * SIZE_STEP


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t\n\r\x0B\f]+"))


def n_letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}"))


def ends_sentence(text: Column) -> Column:
    return text.rlike(TERMINAL)


def body_font(blocks: DataFrame) -> DataFrame:
    """Per document the font that sets most glyphs: (family, half-point size, bold, fixed). Ties: smaller, then by name, then regular."""
    counts = blocks.groupBy("doc_id", F.col("family").alias("body_family"), quantised(F.col("size")).alias("body_size"), F.col("bold").alias("body_bold"), F.col("fixed").alias("body_fixed")).agg(F.sum("n_glyphs").alias("body_glyphs"))
    best = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("body_glyphs"), "body_size", "body_family", "body_bold", "body_fixed"))
    return counts.withColumn("rank", best).where("rank = 1").drop("rank")


def modal_margins(blocks: DataFrame) -> DataFrame:
    """Per document the most frequent left and right edge, in whole points, of blocks of two lines or more; 0 without any. Ties: smaller."""
    out = blocks.select("doc_id").distinct()
    for edge, name in (("min_x", "left_margin"), ("max_x", "right_margin")):
        n = blocks.where("n_lines >= 2").groupBy("doc_id", F.round(edge).alias(name)).count()
        n = n.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("count"), name))).where("rank = 1")
        out = out.join(n.select("doc_id", name), "doc_id", "left")
    return out.select("doc_id", *(F.coalesce(n, F.lit(0.0)).alias(n) for n in ("left_margin", "right_margin")))


def headings(blocks: DataFrame, body: DataFrame | None = None) -> DataFrame:
    """Blocks set larger than the body, or bold where the body is not, short and without a full stop."""
    rows = blocks.join(body_font(blocks) if body is None else body, "doc_id")
    words = n_words(F.col("text"))
    large = (quantised(F.col("size")) >= quantised(F.col("body_size") * (1 + HEADING_SIZE_RATIO))) & (words <= HEADING_MAX_WORDS)
    strong = F.col("bold") & ~F.col("body_bold") & (words < HEADING_BOLD_MAX_WORDS) & ~ends_sentence(F.col("text"))
    return rows.where(large | strong).select(*blocks.columns)


def heading_levels(heads: DataFrame) -> DataFrame:
    """Headings with ``level``: distinct styles, larger first, bold before regular, six at most."""
    rank = F.dense_rank().over(W.partitionBy("doc_id").orderBy(F.desc(quantised(F.col("size"))), F.desc("bold")))
    return heads.withColumn("level", F.least(rank, F.lit(HEADING_LEVELS)))


def quotes(blocks: DataFrame) -> DataFrame:
    """Blocks of two lines or more that are set in from both margins."""
    inset = F.col("size") * QUOTE_INDENT_EM
    rows = blocks.join(modal_margins(blocks), "doc_id")
    return rows.where((F.col("n_lines") >= 2) & (F.col("min_x") >= F.col("left_margin") + inset) & (F.col("max_x") <= F.col("right_margin") - inset)).select(*blocks.columns)


def footnotes(blocks: DataFrame) -> DataFrame:
    """Small prose with a marker in the bottom band, and the marker as ``label``."""
    rows = blocks.join(body_font(blocks), "doc_id")
    low = F.col("min_y") >= PAGE_HEIGHT * (1 - FOOTNOTE_BAND)
    small = F.col("size") < F.col("body_size") * (1 - FOOTNOTE_SIZE)
    note = F.col("text").rlike(NOTE_MARKER) & (n_letters(F.col("text")) >= PROSE_LETTERS)
    label = F.regexp_extract("text", r"^([0-9]{1,3}|[*†‡])", 1)
    return rows.where(low & small & note).select(*blocks.columns, label.alias("label"))


def lists(blocks: DataFrame) -> DataFrame:
    """Runs of marked blocks with the same ordering on one page, one row per run.

    A lone item of a single line is a paragraph again. ``start`` is the first number.
    """
    own = F.col("text").rlike(MARKER)
    ordered = own & ~F.col("text").rlike(r"^[•◦▪‣*-]")
    order = W.partitionBy("doc_id").orderBy("ord")
    rows = blocks.withColumn("item", own).withColumn("ordered", ordered)
    same = F.col("item") & F.lag("item").over(order) & (F.lag("ordered").over(order) == F.col("ordered")) & (F.lag("page").over(order) == F.col("page"))
    rows = rows.withColumn("run", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0))).where("item")
    out = rows.groupBy("doc_id", "run", "ordered", "page").agg(F.min("ord").alias("first_ord"), F.count("*").alias("items"), F.sum("n_lines").alias("n_lines"), F.min_by("text", "ord").alias("first_text"))
    start = F.coalesce(F.regexp_extract("first_text", r"^\(?([0-9]{1,3})[.)\]]", 1).try_cast("int"), F.lit(0))
    return out.where((F.col("items") > 1) | (F.col("n_lines") >= 2)).select("doc_id", "first_ord", "page", "ordered", "items", start.alias("start"))


def kinds(blocks: DataFrame) -> DataFrame:
    """``(doc_id, ord, kind, level)``, first match of heading, code, footnote, list, quote, else paragraph."""
    key = ["doc_id", "ord"]
    out = blocks.select(*key, "text", "fixed").join(body_font(blocks).select("doc_id", "body_fixed"), "doc_id")
    out = out.join(heading_levels(headings(blocks)).select(*key, "level"), key, "left")
    for found, flag in ((footnotes(blocks), "is_note"), (quotes(blocks), "is_quote")):
        out = out.join(found.select(*key, F.lit(True).alias(flag)), key, "left")
    kind = F.when(F.col("level").isNotNull(), "heading").when(F.col("fixed") & ~F.col("body_fixed"), "code").when(F.col("is_note"), "footnote").when(F.col("text").rlike(MARKER), "list").when(F.col("is_quote"), "blockquote").otherwise("paragraph")
    return out.select(*key, kind.alias("kind"), "level")


def block_ids(blocks: DataFrame, kind: str | Column = "paragraph") -> DataFrame:
    """``b`` and eight hex digits of SHA-256 over kind, page and text; later equal ones get ``-`` and their number in hex."""
    raw = F.concat(F.encode(F.lit(kind) if isinstance(kind, str) else kind, "UTF-8"), F.unhex(F.lit("00")), F.unhex(F.lpad(F.hex(F.col("page").cast("long")), 8, "0")), F.encode("text", "UTF-8"))
    rows = blocks.withColumn("base", F.concat(F.lit("b"), F.substring(F.sha2(raw, 256), 1, 8)))
    n = F.row_number().over(W.partitionBy("doc_id", "base").orderBy("ord")) - 1
    return rows.select("doc_id", "ord", F.when(n == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.lower(F.lpad(F.hex(n), 2, "0")))).alias("block_id"))
