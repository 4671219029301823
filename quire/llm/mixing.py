"""Mixing sources to target weights.

Rows get a hash-random key. A source is sorted by that key in 4,096 equal ranges of
the key space, so a source of any size is spread over as many groups and a rerun or a
lost executor sees the same ranges. Distributed prefix sums (within a range, plus the
totals of the ranges before it) place each row on its source's line of tokens, and the
source is cut at its exact budget, after whole epochs where the budget exceeds it.
Whole rows are shuffled once: the prefix sums and the join with the ranges' totals
take the same keys, none of them null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, free_name, stage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "mix-1"
#: Hex digits of the key that name its range.
RANGE_DIGITS = 3


def n_words(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """``(source, source_size)`` plus ``target``: weighted shares with a ceiling.

    Sources by code point, null last, take the weights in turn. A source never gets
    more than ``most_epochs`` times its size; what is over goes to the others by weight,
    until none is above. With ceilings c and weights w in order of c/w, that is the first
    level (total - ceilings before) / (weights from here) that its own c/w does not cut;
    later levels are lower, so it is the greatest of those.
    One row per source goes through one task; the rows are the sources, not the documents.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    whole = W.partitionBy()
    by_ratio = W.orderBy("__ratio", F.col("source").asc_nulls_last())
    before, onward = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    out = sizes.withColumn("__weight", weight).withColumn("__ceiling", F.col("source_size") * F.lit(float(most_epochs)))
    out = out.withColumn("__ratio", F.col("__ceiling") / F.col("__weight"))
    out = out.withColumn("__total", F.sum("source_size").over(whole) * F.lit(float(share)))
    out = out.withColumn("__level", (F.col("__total") - F.coalesce(F.sum("__ceiling").over(before), F.lit(0.0))) / F.sum("__weight").over(onward))
    out = out.withColumn("__level", F.max(F.when(F.col("__level") <= F.col("__ratio"), F.col("__level"))).over(whole))
    target = F.least("__ceiling", F.coalesce(F.col("__weight") * F.col("__level"), F.col("__ceiling")))
    return out.select("source", "source_size", target.alias("target"))


def mix(rows: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", weights=WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """The rows plus ``source_size``, ``target`` and ``taken``.

    ``taken`` counts the tokens the mix takes from the row, repeats counted: whole
    epochs give its size each; in the last, partial epoch rows before the cut give all,
    the row at the cut gives what is missing, rows after it nothing. So a source's sum
    is its target without the fraction.

    Null sizes count 0; a null source is a source of its own, last in order. Repeated
    rows are separate rows with the same key, in any order among themselves. Columns of
    the input stay, whatever their names, except that ``source_size``, ``target`` and
    ``taken`` are replaced. An empty table gives an empty result. All sizes 0: targets 0.
    ``rows`` is read twice: stage it where reading it is dear or does not repeat.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = rows.drop("source_size", "target", "taken")
    own = rows.columns
    line, size, named, range_, end, of, start_range, before = free_name(own, "line", "size", "key", "range", "end", "of", "of_range", "before")
    source = F.col(source_col)
    name = F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))  # null, and it alone, is empty
    keyed = rows.withColumns({line: name, size: F.coalesce(F.col(size_col).cast("long"), F.lit(0).cast("long")), named: key})
    keyed = keyed.withColumn(range_, F.substring(named, 1, RANGE_DIGITS))
    ranges = keyed.groupBy(source.alias("of"), F.col(line).alias("line"), F.col(range_).alias("range")).agg(F.sum(size).alias("range_size"))
    sizes = ranges.groupBy(F.col("of").alias("source")).agg(F.sum("range_size").alias("source_size"))
    in_order = W.partitionBy("of").orderBy("range", "line").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("range_size").over(in_order), F.lit(0).cast("long")))
    goal = targets(sizes, weights, share, most_epochs)
    ranges = ranges.join(goal, F.col("of").eqNullSafe(F.col("source"))).select(F.col("line").alias(of), F.col("range").alias(start_range), F.col("before").alias(before), "source_size", "target")
    by_key = W.partitionBy(line, range_).orderBy(named, size).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = keyed.withColumn(end, F.sum(size).over(by_key))
    placed = placed.join(ranges, (F.col(line) == F.col(of)) & (F.col(range_) == F.col(start_range)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("target") - epochs * F.col("source_size")).cast("long")
    start = F.col(before) + F.col(end) - F.col(size)
    taken = epochs * F.col(size) + F.greatest(F.lit(0).cast("long"), F.least(F.col(size), rest - start))
    return placed.select(*(F.col(f"`{c}`") for c in own), "source_size", "target", taken.alias("taken"))


def repeat(mixed: DataFrame, size_col: str = "size") -> DataFrame:
    """One row for each copy that the mix takes of a whole document.

    The document at a source's cut counts when the cut takes at least half of it; so a
    text stays whole and a source is off its target by half a document at most. A
    document without tokens costs nothing and stays once.
    """
    size = F.coalesce(F.col(size_col).cast("double"), F.lit(0.0))
    copies = F.when(size > 0, F.round(F.col("taken") / size)).otherwise(F.lit(1.0)).cast("int")
    copy = free_name(mixed.columns, "copy")
    return mixed.withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies))).drop(copy)


def op9_mix(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words().alias("size"))
    return mix(stage(docs)).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, source_size * 2.0::DOUBLE AS ceiling,
             [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
      FROM s),
l AS (SELECT *, ceiling / weight AS ratio,
             (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
              - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / sum(weight) OVER (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
      FROM w),
t AS (SELECT source, source_size, least(ceiling, weight * max(CASE WHEN lev <= ratio THEN lev END) OVER ()) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start,
             CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(floor(target - epochs * source_size) AS BIGINT) - start)) AS BIGINT) AS taken
FROM p
"""
