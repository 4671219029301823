"""Helpers shared by the operators of this package."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of code points other than space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows a Python worker turns into Python objects at once.
SLICE_ROWS, SLICE_BYTES = 256, 2 << 20

#: Bytes of rows that an executor hands to a Python worker at once (one row at least).
ARROW_BYTES = 4 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"

_staged: list[tuple[SparkSession, str]] = []


def small_batches(spark: SparkSession) -> None:
    """Bound what executor and Python worker hold of a batch, unless the session has a setting of its own.

    By default a batch is 10,000 rows, whatever their size up to 64 MB, held on both sides.
    """
    spark.conf.set(_ARROW, spark.sparkContext.getConf().get(_ARROW, str(ARROW_BYTES)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, for reading in small Arrow batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it gets a temporary folder.
    """
    conf = spark.sparkContext.getConf()
    if folder := conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="quire-stage-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, never a recomputation,
    and every later use sees the same rows. Staged tables go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{stage_dir(spark).rstrip('/')}/quire-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _staged:
        atexit.register(_drop_staged)
    _staged.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "staged_at", None)
        if path and (df.sparkSession, path) in _staged:
            _staged.remove((df.sparkSession, path))
            _delete(df.sparkSession, path)


def _drop_staged() -> None:
    while _staged:
        spark, path = _staged.pop()
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if getattr(context, "_jsc", None) is not None:  # else the session has ended
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def free_name(taken: list[str], *wanted: str) -> str | list[str]:
    """Names that no column of a caller has, whatever their case: each wanted one with as many underscores before it as it takes."""
    low, out = {t.lower() for t in taken}, []
    for name in wanted:
        name = f"__{name}"
        while name.lower() in low:
            name = f"_{name}"
        out.append(name)
    return out[0] if len(out) == 1 else out


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the evaluation fold: crc32 of its id as text, mod 4, is 2. A null id never does."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most SLICE_ROWS rows and SLICE_BYTES bytes (one row at least)."""
    for batch in batches:
        todo = [batch.slice(at, SLICE_ROWS) for at in range(0, batch.num_rows, SLICE_ROWS)][::-1]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > SLICE_BYTES:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def extended(df: DataFrame, *fields: tuple[str, object]) -> T.StructType:
    """The schema of ``df`` with more fields; ``df.schema`` itself stays."""
    schema = T.StructType(list(df.schema.fields))
    for name, kind in fields:
        schema = schema.add(name, T.StructType.fromDDL(f"x {kind}")[0].dataType if isinstance(kind, str) else kind)
    return schema


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in large batches, but of no more text bytes than ``most_bytes`` (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if row > start and held + size > most_bytes:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)
