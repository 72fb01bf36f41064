"""Starting streams and reading what they wrote.

Sinks are tables with one folder per micro-batch, written again in full if the
batch is retried, so a restart neither loses nor repeats rows.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, use_utc

BatchWriter = Callable[[DataFrame, int], None]


def read_stream(spark: SparkSession, path: str, schema: T.StructType, rate: dict[str, str] | None = None) -> DataFrame:
    """Stream a Parquet folder, or a single file, in arrival order of its files.

    ``rate`` takes source options that bound a micro-batch, such as
    ``{"maxBytesPerTrigger": "10g"}``.
    """
    use_utc(spark)
    reader = spark.readStream.schema(schema).options(**(rate or {}))
    if path.endswith(".parquet") and os.path.isfile(path):
        return reader.option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))
    return reader.parquet(path)


def batch_table(path: str) -> BatchWriter:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def table_path(spark: SparkSession, checkpoint: str | None, label: str) -> str:
    """Where a stream's own tables go: bound to its checkpoint, or a new place if it has none."""
    return f"{checkpoint.rstrip('/')}.tables" if checkpoint else scratch_path(spark, label)


def run_to_table(
    stream: DataFrame, mode: str = "append", writer: BatchWriter | None = None, path: str | None = None,
    checkpoint: str | None = None,
) -> str:
    """Process everything available, then stop. Returns the table's path.

    With a ``checkpoint`` and no ``path`` the table lies beside the checkpoint, so
    that a restart goes on with the table it began.
    """
    spark = stream.sparkSession
    path = path or table_path(spark, checkpoint, "stream-table")
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(writer or batch_table(path))
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return path


def latest_rows(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A table of updates reduced to the last version of each key."""
    body = [c for c in table.columns if c not in (*keys, "batch_id")]
    last = table.groupBy(*keys).agg(F.max_by(F.struct(*body), "batch_id").alias("_r"))
    return last.select(*keys, "_r.*")
