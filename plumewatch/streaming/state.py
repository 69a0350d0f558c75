"""Node rules that need memory across micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumewatch import constants as C
from plumewatch.operators.timeline import (
    CELL, confirmed_rows, run_carries, run_rows, run_segments, score_carries, score_tails)
from plumewatch.session import remove, scratch_path
from plumewatch.streaming.closing import Rule, closing, drain_closing

class HourCap(Rule):
    """The earliest alerts of a node hour."""

    result = "node_id int, hour_start long, event_id long, rank int"
    reads = ("node_id", "event_id", "at_us")

    def __init__(self, limit: int):
        self.limit = limit

    def fold(self, held, rows: pd.DataFrame):
        # only the earliest rows can pass, whatever batch they come in
        early = rows.sort_values(["at_us", "event_id"]).head(self.limit)
        return sorted((held or []) + [[int(t), int(e)] for t, e in zip(early["at_us"], early["event_id"])])[:self.limit]

    def shown(self, key, held):
        return [(int(key[0]), int(key[1]), e, i + 1) for i, (_, e) in enumerate(held)]


def capped_alerts(alerts: DataFrame, limit: int = C.MAX_ALERTS_PER_HOUR, delay: str = "1 hour",
                  grace_ms: int = 60_000, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Hourly alert cap on a stream with node_id, event_id and ts (TIMESTAMP): capped alerts and late ones.

    The earliest alerts of a node hour pass, not the first to arrive: when an earlier one comes later, the
    hour is emitted anew, and its newest version counts. The grouping key holds the hour, so a busy node
    spreads over its hours; at most `limit` alerts are kept for each. An hour closes when the watermark is
    `grace_ms` past its end; alerts of a closed hour are the second table.
    """
    rows = alerts.select("node_id", "event_id", "ts", F.unix_micros("ts").alias("at_us"), F.unix_seconds(
        F.date_trunc("hour", F.col("ts"))).alias("hour_start"))
    end = (F.col("hour_start") + 3600) * 1000 + grace_ms
    return drain_closing(closing(rows, ["node_id", "hour_start"], HourCap(limit), end, delay),
                         ["node_id", "hour_start"], "capped", folder)


def _repaired(stream: DataFrame, key: str, ts: str, tie: str, columns: Sequence[str],
              segments: Callable[[DataFrame], DataFrame], carries: Callable[[DataFrame], DataFrame],
              finish: Callable[[DataFrame, DataFrame], DataFrame], folder: str,
              replaced: Callable[[DataFrame | None, DataFrame | None, int], None] | None = None) -> DataFrame:
    """Run a timeline operator over micro-batches whose rows may come in any order.

    Timelines are cut into hours. What an hour does to the ones after it is a small segment, and segments
    combine. A batch computes the segments of the hours it touches anew, from all their rows so far, and
    with them what goes into each hour of its keys. Only hours that were touched or get something else from
    before are worked out again; their rows come out with the batch as `version`, and the newest version of an
    hour counts. A late row so costs its hour and those that its carry reaches, in one busy key as in many.

    Everything is written per batch, so a replayed batch starts from the same state and overwrites its own
    folders. Of the segments the state before a batch is kept, older ones are removed. A later call with the
    same folder goes on where this one stopped. `replaced` is called in every batch with the new rows of the hours
    it works out and with their rows before it, None if there are none.
    """
    spark = stream.sparkSession
    out, cells, kept, state = (f"{folder}/{name}" for name in ("rows", "cells", "segments", "state"))

    def held(days: DataFrame, batch_id: int) -> DataFrame:
        """Rows so far of the (key, hour) pairs; only the folders of their days are read."""
        some = [r[0] for r in days.select(F.to_date("_cell").alias("day")).distinct().collect()]
        return spark.read.parquet(cells).where((F.col("batch") <= batch_id) & F.col("day").isin(some)).join(
            days, [key, "_cell"], "left_semi").drop("batch", "day")

    def write(batch: DataFrame, batch_id: int) -> None:
        dealt = batch.select(*columns).withColumn("_cell", F.date_trunc(CELL, F.col(ts)))
        dealt.withColumn("day", F.to_date("_cell")).write.mode("overwrite").partitionBy("day").parquet(
            f"{cells}/batch={batch_id}")
        fresh = spark.read.schema(dealt.schema).parquet(f"{cells}/batch={batch_id}")
        touched = fresh.select(key, "_cell").distinct()
        if touched.isEmpty():
            changed = None
        else:
            segments(held(touched, batch_id)).write.mode("overwrite").parquet(f"{folder}/changed")
            changed = spark.read.parquet(f"{folder}/changed")
        old = None if batch_id == 0 else spark.read.parquet(f"{kept}/v{batch_id - 1}")
        if changed is None:
            new = old if old is not None else segments(fresh)
        else:
            new = changed if old is None else changed.unionByName(old.join(changed, [key, "_cell"], "left_anti"))
        new.write.mode("overwrite").parquet(f"{kept}/v{batch_id}")
        if batch_id > 1:
            remove(spark, f"{kept}/v{batch_id - 2}")
        if changed is None:
            if replaced:
                replaced(None, None, batch_id)
            return
        mine = changed.select(key).distinct()
        before = None
        after = carries(spark.read.parquet(f"{kept}/v{batch_id}").join(mine, key, "left_semi"))
        if old is not None:
            # what goes into an hour, before and after this batch
            value = next(c for c in after.columns if c not in (key, "_cell"))
            before = carries(old.join(mine, key, "left_semi"))
            after = after.join(before.withColumnRenamed(value, "_was"), [key, "_cell"], "left").join(
                touched.withColumn("_touched", F.lit(True)), [key, "_cell"], "left").where(
                F.col("_touched") | ~F.col(value).eqNullSafe(F.col("_was"))).drop("_was", "_touched")
        after.write.mode("overwrite").parquet(f"{folder}/carried")
        carried = spark.read.parquet(f"{folder}/carried")
        finish(held(carried.select(key, "_cell"), batch_id), carried).write.mode("overwrite").parquet(
            f"{out}/version={batch_id}")
        if replaced:
            cells_now = carried.select(key, "_cell")
            gone = None if before is None else finish(held(cells_now, batch_id - 1), before)
            replaced(spark.read.parquet(f"{out}/version={batch_id}"), gone, batch_id)

    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", state)
        .trigger(availableNow=True).start())
    query.awaitTermination()
    rows = spark.read.parquet(out)
    newest = rows.groupBy(key, "_cell").agg(F.max("version").alias("version"))
    return rows.join(newest, [key, "_cell", "version"]).drop("_cell")


def confirmed_stream(captures: DataFrame, ns: Sequence[int] = (2, 3), key: str = "camera",
                     ts: str = "ts", tie: str = "frame_id", score: str = "score", folder: str | None = None,
                     replaced: Callable[[DataFrame | None, DataFrame | None, int], None] | None = None) -> DataFrame:
    """Temporal confirmation of captures in any order of batches; a segment is the last n - 1 scores of an hour."""
    depth = max(ns) - 1
    return _repaired(
        captures, key, ts, tie, captures.columns,
        lambda rows: score_tails(rows, depth, key, ts, tie, score), lambda tails: score_carries(tails, depth, key),
        lambda rows, carried: confirmed_rows(rows, carried, ns, key, ts, tie, score),
        folder or scratch_path(captures.sparkSession, "confirmed"), replaced)


def run_length_stream(captures: DataFrame, hit: Column, key: str = "node_id", ts: str = "ts",
                      tie: str = "event_id", folder: str | None = None) -> DataFrame:
    """Consecutive-detection counter over captures in any order of batches; a segment is the run at an hour's end."""
    hits = captures.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    return _repaired(
        hits, key, ts, tie, hits.columns, lambda rows: run_segments(rows, key, ts, tie),
        lambda segments: run_carries(segments, key),
        lambda rows, carried: run_rows(rows, carried, key, ts, tie).drop("_hit"),
        folder or scratch_path(captures.sparkSession, "runs"))
