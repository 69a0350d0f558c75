"""A pass-by-pass replay of the node against the policy audit."""

import random

import pytest
from pyspark.sql import functions as F

from plumewatch import constants as C
from plumewatch.functions import codec
from plumewatch.operators import audit, timeline
from plumewatch.sources.telemetry import decode_uplinks


def passes():
    rng = random.Random(21)
    out = []
    for node in range(4):
        t = 1704067200 + node * 100
        for i in range(700):
            t += rng.choice((60, 300, 900, 900, 3600))
            out.append((node, node * 1000 + i, t, rng.random() < 0.95, rng.choice((80, 80, 30, 10)),
                        rng.random() < 0.6, rng.random() < 0.1, rng.random() < 0.1))
    return out


def replay(rows, mode):
    """One node after another, one pass after another."""
    want, memory = {}, {}
    for node, event, t, ok, soc, detected, camera, model in rows:
        hour, day = t // 3600 % 24, t // 86400
        m = memory.setdefault(node, {"hour": None, "sent": 0, "cap": {}, "beat": set(), "low": set()})
        saving = 16 if soc < C.SOC_SAVING else 0
        if ok and not 6 <= hour < 18:
            want[event] = ("sleep", 0, False, False, False, False)
            continue
        if soc < C.SOC_CRITICAL:
            send = ok and day not in m["low"]
            if send:
                m["low"].add(day)
                m["sent"] += 1
            want[event] = ("telemetry", saving, False, False, False, send)
            continue
        alert = detected and not camera
        flags = saving | (1 if alert else 0) | (4 if camera else 0) | (8 if model and not camera else 0)
        send = False
        if alert and mode == "calendar":
            key = (day, hour, ok)
            send = m["cap"].get(key, 0) < 2
            m["cap"][key] = m["cap"].get(key, 0) + 1
        elif alert:
            if m["hour"] != hour:
                m["hour"], m["sent"] = hour, 0
            send = m["sent"] < 2
            m["sent"] += send
        beat = ok and hour >= C.HEARTBEAT_HOUR and day not in m["beat"]
        if beat:
            m["beat"].add(day)
        want[event] = ("capture", flags, alert, send, beat, False)
    return want


@pytest.mark.parametrize("mode", ["calendar", "hour_change"])
def test_audit_replays_the_node(spark, mode):
    rows = passes()
    df = spark.createDataFrame(rows, "node_id int, event_id long, s long, clock_ok boolean, soc int, "
                               "detected boolean, camera_error boolean, model_error boolean").select(
        "*", F.timestamp_seconds("s").alias("ts")).select(
        "*", F.to_date("ts").alias("date"), F.hour("ts").alias("hour"), F.minute("ts").alias("minute"))
    got = {r.event_id: (r.action, r.flags, r.alert, r.send_alert, r.send_heartbeat, r.send_battery)
           for r in audit.policy_audit(df, mode).collect()}
    want = replay(rows, mode)
    wrong = {k: (got[k], want[k]) for k in want if got[k] != want[k]}
    assert not wrong and len(got) == len(want)
    beats = {r.event_id for r in timeline.heartbeats_due(df).collect()}
    notices = {r.event_id for r in timeline.battery_notices(df).collect()}
    assert beats == {k for k, v in want.items() if v[4]} and notices == {k for k, v in want.items() if v[5]}


def test_frames_without_payload_or_port_have_reasons(spark):
    df = spark.createDataFrame([(None, 10), (bytearray(6), None), (None, None)], "payload binary, fport int")
    assert [r.errors for r in decode_uplinks(df).collect()] == [
        ["sin payload"], ["sin FPort"], ["sin payload", "sin FPort"]]


def test_wrongly_typed_message_is_rejected(spark):
    lines = ['{"dispositivo":"a","alerta":"humo","confianza":0.5,"rssi":-40}',
             '{"dispositivo":"a","alerta":"humo","confianza":"x","rssi":-40}', "{", None]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = [r.m for r in df.select(codec.link_message(F.col("value")).alias("m")).collect()]
    assert got[0].confianza == 0.5 and got[1:] == [None, None, None]
