"""What each recorded pass of a node should have done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumewatch import constants as C
from plumewatch.functions import policy


def policy_audit(passes: DataFrame, mode: str = "calendar") -> DataFrame:
    """Expected action, flags, transmissions and next wake for every pass.

    Needs node_id, event_id, ts, date, hour, minute, clock_ok, soc, detected (capture result) and the
    error columns camera_error and model_error. After a camera error the detector does not run, so it
    cannot report an error of its own.

    `calendar` allows a number of alerts per node, date and hour; alerts under an untrusted clock are
    counted by themselves and sent too. `hour_change` follows the node's counter: it restarts when an
    alert is due in another hour of day than the alert before it, and battery notices raise it as well.
    Windows see one node hour; what an hour must know of others comes from one row per node hour.
    """
    hour, minute, ok, soc = (F.col(c) for c in ("hour", "minute", "clock_ok", "soc"))
    act = policy.action(hour, ok, soc)
    capture, no = act == policy.CAPTURE, F.lit(False)
    seen = F.col("detected") & ~F.col("camera_error")
    df = passes.select(
        "node_id", "event_id", "ts", "date", "hour", "clock_ok", "soc",
        act.alias("action"), policy.next_wake(hour, minute, ok, soc).alias("wake_s"),
        (capture & seen).alias("alert"),
        F.when(act == policy.SLEEP, 0).when(capture, policy.uplink_flags(
            seen, F.col("camera_error"), F.col("model_error") & ~F.col("camera_error"), soc)).otherwise(
            policy.uplink_flags(no, no, no, soc)).alias("flags"),
        policy.sends_heartbeat(hour, ok, soc).alias("_beat"),
        policy.sends_battery_notice(hour, ok, soc).alias("_low"))
    cell = ["node_id", "date", "hour"]
    upto = W.partitionBy(*cell).orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)

    def nth(cond):
        return F.count_if(cond).over(upto)

    alert, low = F.col("alert"), F.col("_low")
    rows = df.select(
        "*", nth(alert & ok).alias("_timed"), nth(alert & ~ok).alias("_untimed"),
        nth(alert).alias("_a"), nth(F.col("_beat")).alias("_b"), nth(low).alias("_l"))
    # the group has the distribution of the window above, so it adds no shuffle
    cells = rows.groupBy(*cell).agg(
        F.max("_beat").alias("_beat"), F.max("_low").alias("_low"), F.max("_a").alias("_alerts"),
        F.coalesce(F.max(F.when(F.col("_a") == 0, F.col("_l"))), F.lit(0)).alias("_ahead"))
    day = W.partitionBy("node_id", "date")
    first = [F.coalesce(F.min(F.when(F.col(c), F.col("hour"))).over(day) == F.col("hour"), no)
             for c in ("_beat", "_low")]
    cells = cells.select(*cell, "_alerts", "_ahead", first[0].alias("_beat_hour"),
                         first[1].alias("_low_hour"))
    notice = low & F.col("_low_hour") & (F.col("_l") == 1)
    if mode == "calendar":
        allowed = F.when(ok, F.col("_timed")).otherwise(F.col("_untimed")) <= C.MAX_ALERTS_PER_HOUR
    else:
        cells = _node_counter(cells)
        # in the notice's own hour it stands before or after the row's place
        earlier = F.col("_low_hour") & (F.col("_l") >= 1) & ~(F.col("_opens") & (F.col("_ahead") >= 1))
        allowed = F.col("_before") + F.col("_a") + earlier.cast("int") <= C.MAX_ALERTS_PER_HOUR
    return rows.join(cells, cell).select(
        "event_id", "node_id", "action", "flags", "alert", "wake_s",
        (alert & allowed).alias("send_alert"),
        (F.col("_beat") & F.col("_beat_hour") & (F.col("_b") == 1)).alias("send_heartbeat"),
        notice.alias("send_battery"))


def _node_counter(cells: DataFrame) -> DataFrame:
    """Add `_before`, alerts and notices since the counter's restart up to this node hour, and
    `_opens`, whether the counter restarts at this hour's first alert."""
    order = W.partitionBy("node_id").orderBy("date", "hour")
    some = F.col("_alerts") > 0
    last = F.last(F.when(some, F.col("hour")), True).over(order.rowsBetween(W.unboundedPreceding, -1))
    cells = cells.withColumn("_opens", some & ~last.eqNullSafe(F.col("hour")))
    cells = cells.withColumn("_span", F.sum(F.col("_opens").cast("int")).over(
        order.rowsBetween(W.unboundedPreceding, 0)))
    before = W.partitionBy("node_id", "_span").orderBy("date", "hour").rowsBetween(
        W.unboundedPreceding, -1)
    # a notice ahead of the first alert of its span does not count in that span
    notices = (F.col("_low_hour") & ~(F.col("_opens") & (F.col("_ahead") >= 1))).cast("int")
    return cells.withColumn("_before", F.coalesce(F.sum(F.col("_alerts") + notices).over(before), F.lit(0)))
