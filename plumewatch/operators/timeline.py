"""Per-camera and per-node history.

A camera may hold a large share of all rows, so no window runs over a whole camera. A timeline is cut
into cells of fixed length; windows run inside (key, cell), and what a cell must know of the past
comes from a summary with one row per (key, cell), whose size is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumewatch import constants as C
from plumewatch.functions import policy

CELL = "hour"


def _celled(df: DataFrame, ts: str, cell: str = CELL) -> DataFrame:
    return df.withColumn("_cell", F.date_trunc(cell, F.col(ts)))


def score_tails(celled: DataFrame, depth: int, key: str, ts: str, tie: str, score: str) -> DataFrame:
    """(key, cell, `_tail`): the last `depth` scores of each cell, oldest first.

    Tails combine: that of two neighbouring cells is the end of both in a row.
    """
    newest_first = W.partitionBy(key, "_cell").orderBy(F.col(ts).desc(), F.col(tie).desc())
    return (
        celled.select(key, "_cell", ts, tie, score)
        .withColumn("_r", F.row_number().over(newest_first)).where(F.col("_r") <= depth)
        .groupBy(key, "_cell")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("_r")).alias("o"), F.col(score).alias("s"))))
             .alias("_t"))
        .select(key, "_cell", F.transform("_t", lambda e: e.s).alias("_tail")))


def score_carries(tails: DataFrame, depth: int, key: str) -> DataFrame:
    """(key, cell, `_past`): the last `depth` scores before each cell, oldest first."""
    earlier = W.partitionBy(key).orderBy("_cell").rowsBetween(-depth, -1)
    recent = F.flatten(F.collect_list("_tail").over(earlier))
    size = F.size(recent)
    return tails.select(key, "_cell", F.slice(
        recent, F.greatest(size - depth + 1, F.lit(1)), F.lit(depth)).alias("_past"))


def confirmed_rows(celled: DataFrame, carries: DataFrame, ns: Sequence[int], key: str, ts: str, tie: str,
                   score: str) -> DataFrame:
    """Add `confirmed_<n>` to the rows of whole cells, given what came before each cell."""
    depth = max(ns) - 1
    inside = W.partitionBy(key, "_cell").orderBy(ts, tie)
    rows = celled.select(
        "*", F.row_number().over(inside).alias("_n"),
        *[F.lag(score, i).over(inside).alias(f"_lag{i}") for i in range(1, depth + 1)])
    rows = rows.join(carries, [key, "_cell"])

    def before(i: int) -> Column:
        carried = F.try_element_at(
            "_past", F.least(F.col("_n") - 1 - i, F.lit(-1)).cast("int"))
        return F.when(F.col("_n") > i, F.col(f"_lag{i}")).otherwise(carried)

    for n in ns:
        parts = [F.col(score), *[before(i) for i in range(1, n)]]
        complete = F.lit(True)
        for p in parts:
            complete = complete & p.isNotNull()
        rows = rows.withColumn(f"confirmed_{n}", F.when(
            complete, F.least(*parts) if n > 1 else parts[0]))
    return rows.drop("_n", "_past", *[f"_lag{i}" for i in range(1, depth + 1)])


def confirmed_scores(df: DataFrame, ns: Sequence[int], key: str = "camera", ts: str = "ts",
                     tie: str = "frame_id", score: str = "score", cell: str = CELL) -> DataFrame:
    """Add `confirmed_<n>`: the lowest of the last n scores of the key, NULL if there are fewer."""
    depth = max(ns) - 1
    df = _celled(df, ts, cell)
    carries = score_carries(score_tails(df, depth, key, ts, tie, score), depth, key)
    return confirmed_rows(df, carries, ns, key, ts, tie, score).drop("_cell")


def _numbered_hits(celled: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    inside = W.partitionBy(key, "_cell").orderBy(ts, tie)
    rows = celled.withColumn("_n", F.row_number().over(inside))
    return rows.withColumn("_miss", F.max(F.when(~F.col("_hit"), F.col("_n"))).over(
        inside.rowsBetween(W.unboundedPreceding, 0)))


def _segments(numbered: DataFrame, key: str) -> DataFrame:
    # the group has the distribution of the window above, so it adds no shuffle
    return numbered.groupBy(key, "_cell").agg(
        F.max("_n").alias("_rows"), F.max("_miss").alias("_gone")).select(
        key, "_cell", F.col("_gone").isNotNull().alias("_reset"),
        (F.col("_rows") - F.coalesce("_gone", F.lit(0))).alias("_tail"))


def run_segments(celled: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """(key, cell, `_reset`, `_tail`): whether a cell has a miss, and the hits at its end.

    Segments combine: two neighbouring cells have the right one's tail, lengthened by the left one's if the
    right one has no miss.
    """
    return _segments(_numbered_hits(celled, key, ts, tie), key)


def run_carries(segments: DataFrame, key: str) -> DataFrame:
    """(key, cell, `_carry`): the run that goes into each cell."""
    order = W.partitionBy(key).orderBy("_cell")
    islands = segments.withColumn("_island", F.sum(F.col("_reset").cast("int")).over(
        order.rowsBetween(W.unboundedPreceding, 0)))
    upto = W.partitionBy(key, "_island").orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)
    return islands.withColumn("_end", F.sum("_tail").over(upto)).select(
        key, "_cell", F.coalesce(F.lag("_end").over(order), F.lit(0)).alias("_carry"))


def run_rows(celled: DataFrame, carries: DataFrame | None, key: str, ts: str, tie: str,
             wrap_at: int | None = None) -> DataFrame:
    """Add `run` to the rows of whole cells; without carries these are all cells, and they are found here."""
    rows = _numbered_hits(celled, key, ts, tie)
    carried = run_carries(_segments(rows, key), key) if carries is None else carries
    run = F.when(F.col("_miss").isNull(), F.col("_n") + F.col("_carry")).otherwise(
        F.col("_n") - F.col("_miss"))
    if wrap_at:
        run = run % wrap_at
    return rows.join(carried, [key, "_cell"]).withColumn("run", run).drop("_n", "_miss", "_carry")


def run_lengths(df: DataFrame, hit: Column, key: str, ts: str = "ts", tie: str = "event_id",
                cell: str = CELL, wrap_at: int | None = None) -> DataFrame:
    """Add `run`: consecutive hits up to and including the row, 0 on a miss.

    `wrap_at` makes the counter wrap as an unsigned integer would (256 on a node).
    """
    df = _celled(df, ts, cell).withColumn("_hit", F.coalesce(hit, F.lit(False)))
    return run_rows(df, None, key, ts, tie, wrap_at).drop("_cell", "_hit")


def capped_alerts(alerts: DataFrame, key: str = "node_id", ts: str = "ts", tie: str = "event_id",
                  limit: int = C.MAX_ALERTS_PER_HOUR, mode: str = "calendar") -> DataFrame:
    """Alerts that pass the hourly cap, with their `rank` in the hour.

    `calendar` counts per node, date and hour. `hour_change` keeps only the hour of day, as a node
    does: the counter restarts when an alert falls in another hour of day than the one before it.
    """
    df = alerts.withColumn("_date", F.to_date(ts)).withColumn("_hour", F.hour(ts))
    cell = [key, "_date", "_hour"]
    w = W.partitionBy(*cell).orderBy(ts, tie)
    first = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    if mode == "calendar":
        return first.drop("_date", "_hour")
    counts = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("_c"))
    order = W.partitionBy(key).orderBy("_date", "_hour")
    changed = F.coalesce((F.lag("_hour").over(order) != F.col("_hour")).cast("int"), F.lit(0))
    counts = counts.withColumn("_new", changed).withColumn(
        "_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    before = W.partitionBy(key, "_island").orderBy("_date", "_hour").rowsBetween(
        W.unboundedPreceding, -1)
    counts = counts.select(*cell, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    return (
        first.join(counts, cell).withColumn("rank", (F.col("rank") + F.col("_before")).cast("int"))
        .where(F.col("rank") <= limit).drop("_date", "_hour", "_before"))


def first_of_day(df: DataFrame, eligible: Column, key: str = "node_id", ts: str = "ts",
                 tie: str = "event_id") -> DataFrame:
    """First eligible row per key and date, found by a partial aggregate."""
    return (
        df.where(eligible).withColumn("date", F.to_date(ts))
        .groupBy(key, "date").agg(F.min(F.struct(ts, tie)).alias("_f"))
        .select(key, "date", F.col(f"_f.{ts}").alias(ts), F.col(f"_f.{tie}").alias(tie)))


def heartbeats_due(df: DataFrame, **kw) -> DataFrame:
    """First pass of the day that captures at or after the set hour; a node that sleeps or saves its
    battery sends none."""
    return first_of_day(df, policy.sends_heartbeat(
        F.col("hour"), F.col("clock_ok"), F.col("soc")), **kw)


def battery_notices(df: DataFrame, **kw) -> DataFrame:
    """First awake pass of the day with a critical battery."""
    return first_of_day(df, policy.sends_battery_notice(
        F.col("hour"), F.col("clock_ok"), F.col("soc")), **kw)


def untrusted_clock(df: DataFrame) -> DataFrame:
    """Rows that no dated notice can be made from."""
    return df.where(~F.coalesce(F.col("clock_ok"), F.lit(False)))
