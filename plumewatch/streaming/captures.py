"""Tile stream to capture results, and daily de-duplication of notices."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumewatch import constants as C
from plumewatch.functions import policy
from plumewatch.operators.rules import score_of, tile_order
from plumewatch.session import remove, scratch_path
from plumewatch.streaming.closing import Rule, closing, drain_closing


def capture_alerts(tiles: DataFrame, delay: str = "10 minutes", threshold_x1000: int = C.ALERT_X1000,
                   min_tiles: int = C.MIN_TILES, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One result per frame, open frames included, and the tiles that came after their frame had closed.

    `tiles` is a stream with frame_id, ts (TIMESTAMP), tile_id, x, y and prob_x1000; all tiles of a frame carry
    its capture time. A frame closes when the watermark, the newest time of the batches before less `delay`, reaches
    that time. Tiles without a time are late.

    There are as many frames as captures, so none has a state of its own: a batch writes one mergeable part for each frame
    it has tiles of, by hash aggregation, and a result merges the parts of its frame. Each batch overwrites its own
    folders, so a replayed batch leaves nothing twice. A later call with the same folder goes on where this one stopped.
    """
    spark = tiles.sparkSession
    folder = folder or scratch_path(spark, "capture-alerts")
    parts, late, seen = (f"{folder}/{name}" for name in ("parts", "late", "seen"))
    delay_ms = spark.range(1).select(F.unix_millis(F.timestamp_millis(F.lit(0)) + F.expr(f"INTERVAL {delay}"))).first()[0]
    at, order = F.unix_millis("ts"), tile_order()

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = spark.read.parquet(f"{seen}/v{batch_id - 1}").first()[0] if batch_id else None
        reached = max(0, (newest or 0) - delay_ms)
        in_time = F.coalesce(at > reached, F.lit(False))
        batch.where(in_time).groupBy("frame_id").agg(
            F.max(at).alias("at_ms"), F.count(F.lit(1)).alias("tiles_total"),
            F.count_if(F.col("prob_x1000") >= threshold_x1000).alias("tiles_over"), F.max(order).alias("best"),
            *[F.max_by(c, order).alias(c) for c in ("x", "y")],
        ).write.mode("overwrite").parquet(f"{parts}/batch={batch_id}")
        batch.where(~in_time).select("frame_id", "tile_id", "x", "y", "prob_x1000").write.mode("overwrite").parquet(
            f"{late}/batch={batch_id}")
        # late tiles are older than the newest one
        spark.read.parquet(f"{parts}/batch={batch_id}").agg(F.greatest(F.max("at_ms"), F.lit(newest)).alias(
            "newest")).write.mode("overwrite").parquet(f"{seen}/v{batch_id}")
        if batch_id > 1:
            remove(spark, f"{seen}/v{batch_id - 2}")

    query = (
        tiles.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start())
    query.awaitTermination()
    some, over = F.col("_prob") > 0, F.col("tiles_over")
    frames = spark.read.parquet(parts).groupBy("frame_id").agg(
        F.sum("tiles_total").alias("tiles_total"), F.sum("tiles_over").alias("tiles_over"),
        score_of(F.max("best")).alias("_prob"), *[F.max_by(c, "best").alias(c) for c in ("x", "y")]).select(
        "frame_id", "tiles_total", "tiles_over", F.coalesce("_prob", F.lit(0)).alias("prob_max_x1000"),
        *[F.when(some, F.col(c)).otherwise(-1).alias(f"{c}_max") for c in ("x", "y")],
        ((over >= min_tiles) & F.lit(min_tiles > 0)).alias("alert"))
    return frames, spark.read.parquet(late).drop("batch")


class Notice(Rule):
    """One notice for each key, with the earliest reading that asks for it."""

    result = "node_id int, date date, kind string, event_id long"
    reads = ("node_id", "event_id", "kind", "at_us")

    def fold(self, held, rows: pd.DataFrame):
        first = rows.sort_values(["at_us", "event_id"]).iloc[0]
        mine = [int(first["at_us"]), int(first["event_id"])]
        return mine if held is None else min(held, mine)

    def shown(self, key, held):
        return [(int(key[0]), key[1], key[2], held[1])]


def once_a_day(readings: DataFrame, delay: str = "1 day", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One notice per (node, date, kind), from the earliest reading; and the readings later than their date.

    `readings` is a stream with node_id, event_id, ts (TIMESTAMP), hour, clock_ok and soc. Kinds are heartbeats
    after the set hour and low-battery notices. A date closes when the watermark reaches its end.
    """
    seen = [F.col(c) for c in ("hour", "clock_ok", "soc")]
    kinds = F.array_compact(F.array(
        F.when(policy.sends_heartbeat(*seen), F.lit("heartbeat")),
        F.when(policy.sends_battery_notice(*seen), F.lit("bateria_baja"))))
    rows = readings.select(
        "node_id", "event_id", "ts", F.unix_micros("ts").alias("at_us"), F.to_date("ts").alias("date"),
        F.explode(kinds).alias("kind"))
    end = F.unix_millis(F.date_add("date", 1).cast("timestamp"))
    keys = ["node_id", "date", "kind"]
    return drain_closing(closing(rows, keys, Notice(), end, delay), keys, "notices", folder)
