"""Drain a stream into a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumewatch.schemas import EVENTS
from plumewatch.session import scratch_path


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process everything available now and read back what was written.

    Output and stream checkpoint live in the shared scratch folder.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("checkpointLocation", state).trigger(availableNow=True).start(out))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_latest(stream: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Process everything available in update mode and keep the rows of each key's last version.

    Every micro-batch overwrites its own folder, so a replayed batch leaves nothing twice.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write).outputMode("update")
        .option("checkpointLocation", state).trigger(availableNow=True).start())
    query.awaitTermination()
    newest = F.max("batch").over(W.partitionBy(*keys))
    return spark.read.parquet(out).withColumn("_newest", newest).where(
        "batch = _newest").select(*stream.columns)


def event_stream(spark: SparkSession, sf: str, files_per_trigger: int | None = None) -> DataFrame:
    """The driver's event table as a file stream."""
    reader = spark.readStream.schema(EVENTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # a pattern, because a stream takes a plain path for a folder and the table may be one file
    return reader.parquet(f"{sf.rstrip('/')}/events.parque[t]")
