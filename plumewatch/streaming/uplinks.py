"""Continuous decoding of uplinks with an error side output."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumewatch.session import scratch_path
from plumewatch.sources.telemetry import decode_uplinks, split_decoded


def decode_continuously(uplinks: DataFrame, good: str, bad: str, checkpoint: str):
    """Start a query that decodes every micro-batch once and writes two tables.

    Each batch overwrites its own folder, so a replayed batch leaves no duplicates.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        decoded = decode_uplinks(batch).persist()
        try:
            fine, broken = split_decoded(decoded)
            fine.write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
            broken.write.mode("overwrite").parquet(f"{bad}/batch={batch_id}")
        finally:
            decoded.unpersist()

    return (
        uplinks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())


def decode_available(uplinks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drain the stream; (decoded, quarantined) tables."""
    spark = uplinks.sparkSession
    good, bad = scratch_path(spark, "decoded"), scratch_path(spark, "rejected")
    decode_continuously(uplinks, good, bad, scratch_path(spark, "decode-state")).awaitTermination()
    return spark.read.parquet(good).drop("batch"), spark.read.parquet(bad).drop("batch")
