"""Blocks of lines to paragraphs: where one begins, how its lines join, what becomes of line-end hyphens."""

from __future__ import annotations

from bisect import insort_left
from statistics import median

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hyphenation
from . import batches as batches_of
from .classify import MARKER, TERMINAL

#: Share of the usual leading that a wider gap adds, indent in em, share of the block's width that a last line is short of.
GAP_RATIO, INDENT_EM, SHORT_RATIO = 0.25, 0.5, 0.8
#: Leading that is assumed before any is seen, in sizes.
SEED_LEADING = 1.2


class Leading:
    """The median of the leadings seen so far, or the seed where that is not positive."""

    def __init__(self) -> None:
        self.seen: list[float] = []

    def add(self, gap: float) -> None:
        insort_left(self.seen, gap)

    def usual(self, size: float) -> float:
        n = len(self.seen)
        middle = 0.0 if not n else (self.seen[(n - 1) // 2] + self.seen[n // 2]) / 2
        return middle if middle > 0 else SEED_LEADING * size


def paragraphs(lines: DataFrame, together: bool = False) -> DataFrame:
    """``(doc_id, page, ord, block, paragraph)`` of segmented lines (see ``with_paragraphs``)."""
    marked = _marked(lines).select("doc_id", "page", "ord", "block", "baseline", "size", "min_x", "max_x", *_FLAGS)
    return _numbered(marked, together).select("doc_id", "page", "ord", "block", "paragraph")


def with_paragraphs(lines: DataFrame, together: bool = False) -> DataFrame:
    """All columns of segmented lines and ``paragraph``, numbered within a block.

    A line opens one when it is indented over the block's median indent, stands apart by
    more than the usual leading of the paragraph so far, or follows a short line that
    ends a sentence. A list marker always opens one; lines set farther right than the
    marker's stay with it. What the usual leading is depends on where the paragraph
    began, so a block is a fold over its lines; blocks are laid together, not grouped.
    Lines that lie block by block in order already (``together``), as they come from the
    typesetter, are not moved.
    """
    return _numbered(_marked(lines), together).drop(*_FLAGS)


_KEY, _FLAGS = ["doc_id", "page", "block"], ["__marked", "__ends"]


def _marked(lines: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return lines.drop("paragraph").withColumns(dict(zip(_FLAGS, (text.rlike(MARKER), text.rlike(TERMINAL.removesuffix("$") + r"\z")), strict=True)))


def _numbered(rows: DataFrame, together: bool) -> DataFrame:
    def run(batches):
        for batch in batches_of.whole_groups(batches, _KEY):
            at = [*batches_of.starts(batch, _KEY).tolist(), batch.num_rows]
            baseline, size, left, right = (batches_of.numbers(batch, c).tolist() for c in ("baseline", "size", "min_x", "max_x"))
            marked, ends = (batch.column(c).to_pylist() for c in _FLAGS)
            out: list[int] = []
            for a, b in zip(at, at[1:], strict=False):
                fold(a, b, baseline, size, left, right, marked, ends, out)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "paragraph"])

    def fold(a: int, b: int, baseline, size, left, right, marked, ends, out: list[int]) -> None:
        indent = median(left[a:b])
        width = max(right[a:b]) - min(left[a:b])
        em_else = None
        number, leading, first = 0, Leading(), a
        out.append(0)
        for k in range(a + 1, b):
            gap = baseline[k] - baseline[k - 1]
            if marked[k]:
                opens = True
            elif marked[first] and left[k] > left[first]:
                opens = False
            else:
                em = size[k]
                if not em > 0:
                    if em_else is None:
                        em_else = median([s for s in size[a:b] if s > 0] or [0.0])
                    em = em_else
                opens = (
                    left[k] - indent > INDENT_EM * em
                    or gap > leading.usual(max(size[k - 1], size[k])) * (1 + GAP_RATIO)
                    or ends[k - 1] and width > 0 and right[k - 1] - left[k - 1] < SHORT_RATIO * width
                )
            if opens:
                number, leading, first = number + 1, Leading(), k
            else:
                leading.add(gap)
            out.append(number)

    schema = T.StructType([*rows.schema.fields, T.StructField("paragraph", T.LongType())])
    batches_of.bounded(rows.sparkSession)
    return (rows if together else batches_of.laid_together(rows, _KEY, "ord")).mapInArrow(run, schema)


def _bare(word: Column) -> Column:
    """Without what follows the last letter."""
    return F.regexp_replace(word, r"[^\p{L}]+$", "")


def paragraph_text(lines: DataFrame, patterns: hyphenation.Patterns | None = None) -> DataFrame:
    """One row per paragraph of lines with ``block`` and ``paragraph``: text, lines, size, bounds, and hyphens kept and dropped.

    Lines are trimmed and joined by a space; blank ones count for nothing in the text.
    After a hyphen before a letter they join without one, and the hyphen goes where the
    patterns permit a break. Without patterns every hyphen stays.
    """
    key = ["doc_id", "page", "block", "paragraph"]
    full = lambda name, way: F.expr(f"{way}(nullif({name}, '')) IGNORE NULLS OVER (PARTITION BY {', '.join(key)} ORDER BY ord)")
    rows = lines.withColumn("piece", F.coalesce(F.regexp_replace("text", r"^\s+|\s+$", ""), F.lit("")))
    rows = rows.withColumns({"ahead": full("piece", "lead"), "behind": full("piece", "lag")})
    some = F.col("piece") != ""
    broken = some & F.coalesce(F.col("piece").endswith("-") & F.col("ahead").rlike(r"^\p{L}"), F.lit(False))
    joins = F.coalesce(F.col("behind").endswith("-") & F.col("piece").rlike(r"^\p{L}"), F.lit(False))
    rows = rows.withColumns({"broken": broken, "sep": F.when(F.col("behind").isNull() | joins, "").otherwise(" ")})
    if patterns is None:
        rows = rows.withColumn("drops", F.lit(False))
    else:
        before = F.element_at(F.split(F.expr("substring(piece, 1, length(piece) - 1)"), r"\s+"), -1)
        after = _bare(F.element_at(F.split("ahead", r"\s+"), 1))
        said = hyphenation.hyphen_decisions(F.when(F.col("broken"), before), F.when(F.col("broken"), after), patterns)
        rows = rows.withColumn("drops", F.coalesce(said.startswith("drop"), F.lit(False)))
    piece = F.concat("sep", F.when(F.col("drops"), F.expr("substring(piece, 1, length(piece) - 1)")).otherwise(F.col("piece")))
    pieces = F.sort_array(F.collect_list(F.when(some, F.struct("ord", piece.alias("piece"))))).alias("pieces")
    shape = [F.min("ord").alias("ord"), F.count("*").alias("n_lines"), F.median("size").alias("size"), *(F.min(c).alias(c) for c in ("min_x", "min_y")), *(F.max(c).alias(c) for c in ("max_x", "max_y"))]
    out = rows.groupBy(*key).agg(*shape, pieces, F.count_if(F.col("broken") & ~F.col("drops")).alias("hyphens_kept"), F.count_if("drops").alias("hyphens_dropped"))
    return out.withColumn("text", F.array_join("pieces.piece", "")).drop("pieces")
