"""Documents as they arrive: a file source whose batches go through a batch function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, folder: str, schema, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Parquet files that appear in ``folder`` are processed once each; results append to ``out`` by batch."""
    def write(batch: DataFrame, epoch: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
