"""Footnote links, cross-references and bookmarks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import batches as batches_of

ABOVE_PENALTY = 1e6
#: Fixed value: the labels that captions open with, before a number.
CAPTION_LABEL = r"^[ \t\n]*(?:Figure|Fig\.|Table|Plate|Abbildung|Tabelle|Abb\.)[ \t\n]*[0-9IVXivx]"


def distance(y: Column, min_y: Column, max_y: Column) -> Column:
    """How far a point lies from a block: 0 inside; a block that ends above the point is a last resort; an unknown y prefers the first."""
    return F.when(y.isNull(), 0.0).when(y < min_y, min_y - y).when(y <= max_y, 0.0).otherwise(y - max_y + ABOVE_PENALTY)


def footnote_links(references: DataFrame, notes: DataFrame) -> DataFrame:
    """References (``doc_id, page, ord, label``) with ``note_ord``: the first footnote of that label on the page, or null."""
    first = notes.groupBy("doc_id", "page", "label").agg(F.min("ord").alias("note_ord"))
    return references.join(first, ["doc_id", "page", "label"], "left")


def cross_references(links: DataFrame, blocks: DataFrame) -> DataFrame:
    """Links (``doc_id, seq, target_page, target_y``) with ``target_ord``: the nearest block of the target page, the first of equals; null where that page has none.

    An equi-join on document and page, then the best of each link's page.
    """
    rows = links.join(blocks.select("doc_id", F.col("page").alias("target_page"), "ord", "min_y", "max_y"), ["doc_id", "target_page"], "left")
    rows = rows.withColumn("gap", distance(F.col("target_y"), F.col("min_y"), F.col("max_y")))
    return rows.groupBy(*links.columns).agg(F.min(F.when(F.col("ord").isNotNull(), F.struct("gap", "ord"))).alias("best")).select(*links.columns, F.col("best.ord").alias("target_ord"))


def reconcile_outline(outline: DataFrame, blocks: DataFrame) -> DataFrame:
    """Bookmarks bound in order to the nearest block of their page that no earlier one took.

    The used set makes each page a fold; a page's blocks are few, so pages are grouped.
    """
    def bind(key, marks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        used: set[int] = set()
        out = []
        for m in marks.sort_values("seq").itertuples():
            best = None
            for b in rows.itertuples():
                if b.ord in used:
                    continue
                y = m.y
                gap = 0.0 if pd.isna(y) else b.min_y - y if y < b.min_y else 0.0 if y <= b.max_y else y - b.max_y + ABOVE_PENALTY
                if best is None or gap < best[0]:
                    best = (gap, b.ord)
            if best is not None:
                used.add(best[1])
                out.append((key[0], key[1], m.seq, min(6, max(1, m.depth)), best[1]))
        return pd.DataFrame(out, columns=["doc_id", "page", "seq", "level", "ord"])

    return outline.groupBy("doc_id", "page").cogroup(blocks.select("doc_id", "page", "ord", "min_y", "max_y").groupBy("doc_id", "page")).applyInPandas(bind, "doc_id long, page int, seq long, level int, ord long")


def assign_captions(figures: DataFrame, blocks: DataFrame) -> DataFrame:
    """Figures in order, each with the nearest block below or above that overlaps it and no earlier figure took.

    Labelled blocks may lie farther off, others must be smaller than the body. Blank blocks
    are no captions. A block without a size counts as one of the body's. What an earlier
    figure took makes a page a fold; pages are laid together, not grouped.
    """
    def bind(figs, rows):
        used: set[int] = set()
        for fig, f0, f1, f2, f3, body in sorted(figs, key=lambda f: (f[3], f[1], f[0])):
            best = None
            for ord_, x0, x1, y0, y1, size, labelled in rows:
                if ord_ in used or min(f1, x1) - max(f0, x0) < 0.3 * min(f1 - f0, x1 - x0):
                    continue
                gap = max(y0 - f3, f2 - y1, 0.0)
                line = size if size > 0 else body
                near = gap <= 1.5 * line and size < 0.95 * body
                if (near or labelled and gap <= 4.5 * line) and (best is None or gap < best[0]):
                    best = (gap, ord_)
            if best is not None:
                used.add(best[1])
                yield fig, best[1]

    def run(batches):
        for batch in batches_of.whole_groups(batches, key):
            is_fig = batches_of.numbers(batch, "is_fig")
            at = np.r_[batches_of.starts(batch, key), batch.num_rows]
            with_figs = np.flatnonzero(np.add.reduceat(is_fig.astype(np.int64), at[:-1]))
            out = []
            for g in with_figs.tolist():
                group = batch.slice(int(at[g]), int(at[g + 1] - at[g]))
                n = int(np.count_nonzero(is_fig[at[g] : at[g + 1]]))
                page, doc = group.column("page")[0].as_py(), group.column("doc_id")[0].as_py()
                rows = list(zip(*(batches_of.numbers(group, c).tolist() for c in ("id", "min_x", "max_x", "min_y", "max_y", "size", "labelled")), strict=True))
                out += [(doc, page, fig, found) for fig, found in bind([r[:6] for r in rows[:n]], rows[n:])]
            yield pa.RecordBatch.from_pylist([dict(zip(result.names, r, strict=True)) for r in out], result)

    key = ["doc_id", "page"]
    result = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("fig", pa.int32()), ("caption_ord", pa.int64())])
    where = [F.col(c).cast("double").alias(c) for c in ("min_x", "max_x", "min_y", "max_y")]
    labelled = F.coalesce(F.col("text").rlike(CAPTION_LABEL), F.lit(False))
    figs = figures.select(*key, F.lit(True).alias("is_fig"), F.col("fig").cast("long").alias("id"), *where, F.col("body_size").alias("size"), F.lit(False).alias("labelled"))
    rows = blocks.where(F.trim("text") != "").select(*key, F.lit(False).alias("is_fig"), F.col("ord").alias("id"), *where, "size", labelled.alias("labelled"))
    both = figs.unionByName(rows).withColumn("after", ~F.col("is_fig"))
    return batches_of.laid_together(both, key, "after", "id").drop("after").mapInArrow(run, "doc_id long, page int, fig int, caption_ord long")


def without_overlaps(spans: DataFrame) -> DataFrame:
    """Spans (``key, start, end``) by start, longest first; one that begins before the last kept one ends goes.

    What counts is the last span kept, so each key's few spans are folded.
    """
    packed = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", (-F.col("end")).alias("minus_end")))).alias("all"))
    zero = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        reach = F.when(F.size(acc) > 0, F.element_at(acc, -1)["end"]).otherwise(F.lit(0))
        kept = F.struct(x["start"].cast("long").alias("start"), (-x["minus_end"]).cast("long").alias("end"))
        return F.when((F.size(acc) == 0) | (x["start"] >= reach), F.concat(acc, F.array(kept))).otherwise(acc)

    return packed.select("key", F.explode(F.aggregate("all", zero, step)).alias("x")).select("key", "x.start", "x.end")
