"""Node energy and transmission policy as column expressions.

`hour` and `minute` are local clock fields, `clock_ok` tells whether they can be trusted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumewatch import constants as C

SLEEP, TELEMETRY, CAPTURE = "sleep", "telemetry", "capture"


def battery_percent(mv: Column) -> Column:
    """Charge from voltage: linear between breakpoints, whole percents, 0..100.

    The curve is a fixed list of eight points, so it is folded into the expression instead of being
    joined.
    """
    pct = F.lit(0)
    for (hi_mv, hi), (lo_mv, lo) in reversed(list(zip(C.BATTERY_CURVE, C.BATTERY_CURVE[1:]))):
        step = lo + F.floor((mv - lo_mv) * (hi - lo) / (hi_mv - lo_mv))
        pct = F.when(mv >= lo_mv, step).otherwise(pct)
    top_mv, top = C.BATTERY_CURVE[0]
    return F.when(mv >= top_mv, F.lit(top)).otherwise(pct).cast("int")


def clock_valid(epoch_s: Column) -> Column:
    return epoch_s > C.VALID_EPOCH_S


def daytime(hour: Column, clock_ok: Column) -> Column:
    """An untrusted clock counts as day."""
    return ~clock_ok | ((hour >= C.DAY_HOURS[0]) & (hour < C.DAY_HOURS[1]))


def action(hour: Column, clock_ok: Column, soc: Column) -> Column:
    return (
        F.when(~daytime(hour, clock_ok), SLEEP)
        .when(soc < C.SOC_CRITICAL, TELEMETRY)
        .otherwise(CAPTURE)
    )


def sends_heartbeat(hour: Column, clock_ok: Column, soc: Column) -> Column:
    """A capturing pass at or after the heartbeat hour, with a date to go by."""
    return clock_ok & (action(hour, clock_ok, soc) == CAPTURE) & (hour >= C.HEARTBEAT_HOUR)


def sends_battery_notice(hour: Column, clock_ok: Column, soc: Column) -> Column:
    """An awake pass whose battery is critical, with a date to go by."""
    return clock_ok & (action(hour, clock_ok, soc) == TELEMETRY)


def next_interval(hour: Column, clock_ok: Column, soc: Column) -> Column:
    high_risk = (hour >= C.HIGH_RISK_HOURS[0]) & (hour < C.HIGH_RISK_HOURS[1])
    return (
        F.when(soc < C.SOC_CRITICAL, C.INTERVAL_CRITICAL_S)
        .when(soc < C.SOC_SAVING, C.INTERVAL_SAVING_S)
        .when(~clock_ok, C.INTERVAL_NORMAL_S)
        .when(high_risk, C.INTERVAL_NORMAL_S)
        .otherwise(C.INTERVAL_SAVING_S)
    )


def seconds_to_dawn(hour: Column, minute: Column, clock_ok: Column) -> Column:
    delta = C.DAY_HOURS[0] * 3600 - (hour * 3600 + minute * 60)
    return (
        F.when(~clock_ok, C.INTERVAL_SAVING_S)
        .when(delta <= 0, delta + 86400)
        .otherwise(delta)
    )


def next_wake(hour: Column, minute: Column, clock_ok: Column, soc: Column) -> Column:
    return F.when(action(hour, clock_ok, soc) == SLEEP,
                  seconds_to_dawn(hour, minute, clock_ok)).otherwise(
        next_interval(hour, clock_ok, soc))


def uplink_flags(alert: Column, camera_error: Column, model_error: Column, soc: Column) -> Column:
    """Flag byte of an alert frame."""
    bits = C.FLAG_BITS

    def bit(cond, name):
        return F.when(cond, F.lit(bits[name])).otherwise(F.lit(0))

    return (
        bit(alert, "alarma_activa")
        .bitwiseOR(bit(camera_error, "error_camara"))
        .bitwiseOR(bit(model_error, "error_modelo"))
        .bitwiseOR(bit(soc < C.SOC_SAVING, "modo_ahorro"))
    )
