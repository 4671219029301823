"""Streams of Arrow batches in which rows of a group follow each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows, about, that are handed to Python at once.
_ARROW, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bounded(spark: SparkSession) -> None:
    """Bound the bytes of a batch, unless the session has a setting of its own."""
    spark.conf.set(_ARROW, spark.sparkContext.getConf().get(_ARROW, str(ARROW_BYTES)))


def laid_together(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """Rows of a group in one partition, one after another, by ``order``; batches handed to Python are bounded in bytes."""
    bounded(df.sparkSession)
    return df.repartition(*key).sortWithinPartitions(*key, *order)


def starts(batch: pa.RecordBatch, key: list[str]) -> np.ndarray:
    """Where groups start in a batch; 0 is always one. Nulls are a group."""
    change = np.zeros(max(0, batch.num_rows - 1), bool)
    for name in key:
        column = batch.column(name)
        null = column.is_null().to_numpy(zero_copy_only=False)
        values = pc.rank(column, "ascending", tiebreaker="dense") if pa.types.is_string(column.type) else column
        values = (values.fill_null(0) if column.null_count else values).to_numpy(zero_copy_only=False)
        change |= (values[1:] != values[:-1]) | (null[1:] != null[:-1])
    return np.r_[0, np.flatnonzero(change) + 1]


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.RecordBatch]:
    """The same rows, cut so that no group lies in two batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = starts(batch, key)
        name = lambda k, b=batch: tuple(b.column(c)[int(k)].as_py() for c in key)
        cut = int(at[-1])
        if cut or name(0) != last:
            done = held if name(0) != last else [*held, batch.slice(0, int(at[1]))]
            rest = 0 if name(0) != last else int(at[1])
            if done:
                yield pa.concat_batches(done)
            if cut > rest:
                yield batch.slice(rest, cut - rest)
            held = []
        held.append(batch.slice(cut))
        last = name(cut)
    if held:
        yield pa.concat_batches(held)


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column as an array; nulls of any number become NaN."""
    return batch.column(name).to_numpy(zero_copy_only=False)
