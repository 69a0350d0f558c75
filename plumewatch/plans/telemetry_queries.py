"""Queries over node telemetry: uplink codec, link messages, traces, policy, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumewatch import constants as C
from plumewatch.functions import codec, policy
from plumewatch.operators import audit, rules, summaries, timeline
from plumewatch.plans import views as V
from plumewatch.plans.registry import query
from plumewatch.plans.score_queries import K5_SQL, RESULT_SQL, RUN_SQL
from plumewatch.schemas import EVENTS
from plumewatch.session import materialize, scratch_path
from plumewatch.sources import telemetry as src
from plumewatch.streaming import captures as live
from plumewatch.streaming import state
from plumewatch.streaming.runs import event_stream
from plumewatch.streaming.sweeps import leaderboard_stream
from plumewatch.streaming.uplinks import decode_available

BYTE = "lpad(upper(to_hex(({})::BIGINT & 255)),2,'0')"
INT32 = "lpad(upper(to_hex((({})::BIGINT + 4294967296) % 4294967296)),8,'0')"


def sql_byte(expr: str) -> str:
    return BYTE.format(expr)


ALERT_HEX = "||".join(map(sql_byte, (
    "node_id", "kind", "conf_pct", "soc", "temp+40", "flags")))
BEAT_HEX = "||".join((
    sql_byte("node_id"), "'00'", INT32.format("lat_e7"), INT32.format("lon_e7"),
    sql_byte("soc"), sql_byte("temp+40"), sql_byte("hr"), sql_byte("event_id%4")))


# ---------------------------------------------------------------- sources

@query("A11_uplink_source", "uplinks", f"""
SELECT event_id AS uplink_id, fport, n_bytes, substr(CASE WHEN fport=11 THEN {BEAT_HEX} ELSE {ALERT_HEX} END,1,n_bytes*2) AS payload_hex FROM uplinks""")
def uplink_source(spark, sf):
    path = scratch_path(spark, "uplinks")
    V.uplinks(spark, sf).withColumn("node_ts", F.col("node_ts").cast("timestamp")).write.parquet(path)
    return src.read_uplinks(spark, path).select(
        "uplink_id", "fport", F.length("payload").alias("n_bytes"),
        F.hex("payload").alias("payload_hex"))


@query("A12_link_messages", "telemetry", """
WITH m AS (SELECT *, 'NODE'||node_id||'-'||event_id AS dispositivo, CASE WHEN event_id%3=0 THEN 'test' ELSE 'humo' END AS alerta,
 '0.'||lpad((event_id%100)::VARCHAR,2,'0') AS conf, -(event_id%60)-40 AS rssi FROM telemetry)
SELECT CASE WHEN event_id%89<>0 THEN dispositivo END AS dispositivo, CASE WHEN event_id%89<>0 THEN alerta END AS alerta,
 CASE WHEN event_id%89<>0 THEN conf::DOUBLE END AS confianza, CASE WHEN event_id%89<>0 THEN rssi END AS rssi,
 CASE WHEN event_id%89=0 THEN substr('{"dispositivo":"'||dispositivo||'","alerta":"'||alerta,1,20) END AS reject FROM m""")
def link_messages(spark, sf):
    path = scratch_path(spark, "link")
    V.link_lines(spark, sf).write.text(path)
    return src.read_link_messages(spark, path)


@query("A13_trace_lines", "telemetry", f"""
WITH t AS (SELECT *, event_id AS e, CASE WHEN prob_x1000>=1000 THEN 100 ELSE (prob_x1000+5)//10 END AS conf_pct,
 greatest(-40,least(87,temp_c)) AS temp, 1 AS kind, event_id%32 AS flags FROM telemetry)
SELECT 'pass' AS kind, NULL::INT AS fport, NULL::BIGINT AS fcnt, NULL AS payload_hex, NULL::INT AS tiles_total, NULL::INT AS tiles_over,
 NULL::DOUBLE AS prob_max, NULL::INT AS x_max, NULL::INT AS y_max, NULL::BIGINT AS ms_resample, NULL::BIGINT AS ms_infer,
 date::VARCHAR AS date, hour, minute, soc, e AS captures FROM t
UNION ALL SELECT 'capture', NULL, NULL, NULL, 32, e%4, (e%1000)/1000.0::DOUBLE, (e%7)*168, (e%3)*168, e%500, e%9000, NULL, NULL, NULL, NULL, NULL FROM t
UNION ALL SELECT 'uplink', 10, e, {ALERT_HEX}, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM t""")
def trace_lines(spark, sf):
    path = scratch_path(spark, "trace")
    V.trace_lines(spark, sf).write.text(path)
    return src.read_trace(spark, path).withColumn("payload_hex", F.hex("payload")).drop("payload")


@query("A13_pass_records", "telemetry", f"""
WITH t AS (SELECT *, event_id AS e, CASE WHEN prob_x1000>=1000 THEN 100 ELSE (prob_x1000+5)//10 END AS conf_pct,
 greatest(-40,least(87,temp_c)) AS temp, 1 AS kind, event_id%32 AS flags FROM telemetry)
SELECT date::VARCHAR AS date, hour, minute, soc, e AS captures, CASE WHEN e%5<>0 THEN e%4 END AS tiles_over,
 CASE WHEN e%5<>0 THEN (e%1000)/1000.0::DOUBLE END AS prob_max, CASE WHEN e%5<>0 THEN e%9000 END AS ms_infer,
 CASE WHEN e%7=0 THEN 2 ELSE 1 END AS n_uplinks, {ALERT_HEX} AS first_payload,
 CASE WHEN e%7=0 THEN e+1 ELSE e END AS last_fcnt FROM t""")
def pass_records(spark, sf):
    """Trace lines put together again: every pass with its capture, if it has one, and its uplinks."""
    path = scratch_path(spark, "trace")
    V.trace_lines(spark, sf, ragged=True).write.text(path)
    up = F.col("uplinks")
    return src.read_passes(spark, path).select(
        "date", "hour", "minute", "soc", "captures", "tiles_over", "prob_max", "ms_infer", F.size(up).alias(
            "n_uplinks"), F.hex(up[0].payload).alias("first_payload"), F.element_at(up, -1).fcnt.alias("last_fcnt"))


# ---------------------------------------------------------------- codec

@query("C1_encode_alert", "uplinks", f"""
SELECT event_id AS uplink_id, {ALERT_HEX} AS payload_hex FROM uplinks WHERE fport=10 AND n_bytes=6""")
def encode_alert(spark, sf):
    return V.uplinks(spark, sf).where((F.col("fport") == 10) & (F.length("payload") == 6)).select(
        "uplink_id", F.hex("payload").alias("payload_hex"))


@query("C2_encode_heartbeat", "uplinks", f"""
SELECT event_id AS uplink_id, {BEAT_HEX} AS payload_hex FROM uplinks WHERE fport=11 AND n_bytes=14""")
def encode_heartbeat(spark, sf):
    return V.uplinks(spark, sf).where((F.col("fport") == 11) & (F.length("payload") == 14)).select(
        "uplink_id", F.hex("payload").alias("payload_hex"))


@query("C3_temperature_byte", "telemetry", """
SELECT event_id, temp_c, greatest(-40,least(87,temp_c))+40 AS temp_byte FROM telemetry""")
def temperature_byte(spark, sf):
    return V.telemetry(spark, sf).select(
        "event_id", "temp_c", codec.temperature_byte(F.col("temp_c")).alias("temp_byte"))


@query("Q4_confidence_percent", "telemetry", """
SELECT event_id, prob_x1000, CASE WHEN prob_x1000>=1000 THEN 100 ELSE (prob_x1000+5)//10 END AS confidence FROM telemetry""")
def confidence_percent(spark, sf):
    return V.telemetry(spark, sf).select(
        "event_id", "prob_x1000", codec.confidence_percent(F.col("prob_x1000")).alias("confidence"))


EVENT_SQL = "CASE kind WHEN 0 THEN 'heartbeat' WHEN 1 THEN 'humo' WHEN 2 THEN 'bateria_baja' WHEN 3 THEN 'test' ELSE 'desconocido_'||kind END"
_ALERTS = "fport=10 AND n_bytes=6"
_BEATS = "fport=11 AND n_bytes=14"


def _stored(spark, sf):
    """Encoded frames as a stored table, the form in which a server receives them. Decoding the
    encoding expression instead would let filters on the payload repeat the whole encoder."""
    return materialize(V.uplinks(spark, sf), "uplink-table")


def _decoded(spark, sf):
    return src.decode_uplinks(_stored(spark, sf))


@query("C4_decode_alert", "uplinks", f"""
SELECT event_id AS uplink_id, node_id, {EVENT_SQL} AS evento, conf_pct/100.0::DOUBLE AS confianza, soc AS bateria_pct, temp AS temp_c
FROM uplinks WHERE {_ALERTS}""")
def decode_alert(spark, sf):
    up = _stored(spark, sf).where((F.col("fport") == 10) & (F.length("payload") >= C.ALERT_BYTES))
    return up.select("uplink_id", *codec.alert_fields(F.col("payload"))[:5])


@query("C5_decode_heartbeat", "uplinks", f"""
SELECT event_id AS uplink_id, node_id, 'heartbeat' AS evento, lat_e7/1e7::DOUBLE AS lat, lon_e7/1e7::DOUBLE AS lon, soc AS bateria_pct,
 temp AS temp_c, hr AS hr_pct, (event_id%4)::VARCHAR AS fw FROM uplinks WHERE {_BEATS}""")
def decode_heartbeat(spark, sf):
    up = _stored(spark, sf).where(
        (F.col("fport") == 11) & (F.length("payload") >= C.HEARTBEAT_BYTES))
    return up.select("uplink_id", *codec.heartbeat_fields(F.col("payload")))


@query("C6_flag_bits", "uplinks", f"""
SELECT event_id AS uplink_id, flags&1<>0 AS alarma_activa, flags&2<>0 AS tamper, flags&4<>0 AS error_camara, flags&8<>0 AS error_modelo,
 flags&16<>0 AS modo_ahorro FROM uplinks WHERE {_ALERTS}""")
def flag_bits(spark, sf):
    fine = src.split_decoded(_decoded(spark, sf))[0]
    return fine.where(F.col("fport") == C.PORT_ALERT).select("uplink_id", *C.FLAG_BITS)


@query("C7_event_names", "", """
SELECT event_id, CASE event_id%9 WHEN 0 THEN 'heartbeat' WHEN 1 THEN 'humo' WHEN 2 THEN 'bateria_baja' WHEN 3 THEN 'test'
 ELSE 'desconocido_'||(event_id%9) END AS evento FROM events""")
def event_names(spark, sf):
    return V.columns(spark, sf, "events", "event_id").select(
        "event_id", codec.event_name(F.col("event_id") % 9).alias("evento"))


@query("C8_route_and_errors", "uplinks", """
SELECT event_id AS uplink_id, fport, CASE WHEN fport=99 THEN 'FPort 99 no reconocido'
 WHEN fport=10 AND n_bytes<6 THEN 'alerta de '||n_bytes||' bytes, se esperaban 6'
 WHEN fport=11 AND n_bytes<14 THEN 'heartbeat de '||n_bytes||' bytes, se esperaban 14' END AS error,
 NOT (fport=99 OR n_bytes<6 OR (fport=11 AND n_bytes<14)) AS decoded FROM uplinks""")
def route_and_errors(spark, sf):
    return _decoded(spark, sf).select(
        "uplink_id", "fport", F.get("errors", F.lit(0)).alias("error"),
        F.col("node_id").isNotNull().alias("decoded"))


WARNINGS_SQL = """array_to_string(list_filter([
 CASE WHEN fport=10 AND kind=1 AND conf_pct<90 THEN 'confianza '||CASE WHEN conf_pct=0 THEN '0' WHEN conf_pct%10=0 THEN '0.'||(conf_pct//10)
  ELSE '0.'||lpad(conf_pct::VARCHAR,2,'0') END||' por debajo del umbral de diseno' END,
 CASE WHEN soc<20 THEN 'bateria por debajo del 20 %' END,
 CASE WHEN fport=10 AND flags&4<>0 THEN 'el nodo reporta error de camara' END,
 CASE WHEN fport=10 AND flags&8<>0 THEN 'el nodo reporta error de inferencia' END], lambda m: m IS NOT NULL), '; ')"""
TEXT_SQL = f"""'NODE'||right('0'||node_id,2)||' | EVT='||upper(CASE WHEN fport=11 THEN 'heartbeat' ELSE {EVENT_SQL} END)
 ||CASE WHEN fport=10 THEN ' | CONF='||printf('%.2f',conf_pct/100.0::DOUBLE) ELSE ' | LAT='||printf('%.5f',lat_e7/1e7::DOUBLE)||' | LON='||printf('%.5f',lon_e7/1e7::DOUBLE) END
 ||' | BAT='||soc||'% | T='||temp||'C'||CASE WHEN fport=11 THEN ' | HR='||hr||'% | FW='||(event_id%4) ELSE '' END"""


@query("C9_quality_warnings", "uplinks", f"""
SELECT event_id AS uplink_id, {WARNINGS_SQL} AS warnings FROM uplinks WHERE ({_ALERTS}) OR ({_BEATS})""")
def quality_warnings(spark, sf):
    return src.split_decoded(_decoded(spark, sf))[0].select(
        "uplink_id", F.array_join("warnings", "; ").alias("warnings"))


@query("C10_readable_text", "uplinks", f"""
SELECT event_id AS uplink_id, {TEXT_SQL} AS texto FROM uplinks WHERE ({_ALERTS}) OR ({_BEATS})""")
def readable_text(spark, sf):
    return src.split_decoded(_decoded(spark, sf))[0].select("uplink_id", "texto")


@query("C11_clock_validity", "", """
SELECT event_id, CASE WHEN event_id%50=0 THEN event_id ELSE epoch_us(ts)//1000000 END>1577836800 AS valid FROM events""")
def clock_validity(spark, sf):
    e = V.columns(spark, sf, "events", "event_id", "ts")
    epoch = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    epoch = F.when(F.col("event_id") % 50 == 0, F.col("event_id")).otherwise(epoch)
    return e.select("event_id", policy.clock_valid(epoch).alias("valid"))


@query("C12_weak_links", "telemetry", """
SELECT 'NODE'||node_id||'-'||event_id AS dispositivo, -(event_id%60)-40 < -75 AS weak_link, event_id%3=0 AS is_test
FROM telemetry WHERE event_id%89<>0""")
def weak_links(spark, sf):
    m = V.link_lines(spark, sf).select(codec.link_message(F.col("value")).alias("m"))
    return m.where(F.col("m").isNotNull()).select(
        "m.dispositivo", (F.col("m.rssi") < C.WEAK_RSSI_DBM).alias("weak_link"),
        (F.col("m.alerta") == "test").alias("is_test"))


# ---------------------------------------------------------------- policy

DAY = "(NOT clock_ok OR (hour>=6 AND hour<18))"
ACTION_SQL = f"CASE WHEN NOT {DAY} THEN 'sleep' WHEN soc<15 THEN 'telemetry' ELSE 'capture' END"
INTERVAL_SQL = """CASE WHEN soc<15 THEN 10800 WHEN soc<35 THEN 3600 WHEN NOT clock_ok THEN 900
 WHEN hour>=9 AND hour<17 THEN 900 ELSE 3600 END"""
DAWN_SQL = """CASE WHEN NOT clock_ok THEN 3600 WHEN 21600-hour*3600-minute*60<=0 THEN 108000-hour*3600-minute*60
 ELSE 21600-hour*3600-minute*60 END"""


@query("C13_node_action", "telemetry", f"SELECT event_id, {ACTION_SQL} AS action FROM telemetry")
def node_action(spark, sf):
    return V.telemetry(spark, sf).select("event_id", policy.action(
        F.col("hour"), F.col("clock_ok"), F.col("soc")).alias("action"))


@query("C14_next_interval", "telemetry", f"SELECT event_id, {INTERVAL_SQL} AS interval_s FROM telemetry")
def next_interval(spark, sf):
    return V.telemetry(spark, sf).select("event_id", policy.next_interval(
        F.col("hour"), F.col("clock_ok"), F.col("soc")).alias("interval_s"))


@query("C15_seconds_to_dawn", "telemetry", f"SELECT event_id, {DAWN_SQL} AS seconds FROM telemetry")
def seconds_to_dawn(spark, sf):
    return V.telemetry(spark, sf).select("event_id", policy.seconds_to_dawn(
        F.col("hour"), F.col("minute"), F.col("clock_ok")).alias("seconds"))


@query("C16_alert_flags", "telemetry", """
SELECT event_id, (CASE WHEN prob_x1000>=300 THEN 1 ELSE 0 END)+(CASE WHEN event_id%37=0 THEN 4 ELSE 0 END)
 +(CASE WHEN event_id%41=0 THEN 8 ELSE 0 END)+(CASE WHEN soc<35 THEN 16 ELSE 0 END) AS flags FROM telemetry""")
def alert_flags(spark, sf):
    e = F.col("event_id")
    return V.telemetry(spark, sf).select("event_id", policy.uplink_flags(
        F.col("prob_x1000") >= 300, e % 37 == 0, e % 41 == 0, F.col("soc")).alias("flags"))


@query("J8_battery_curve", "telemetry", """
WITH curve(hi_mv,hi,lo_mv,lo) AS (VALUES (3400,100,3300,90),(3300,90,3250,70),(3250,70,3200,40),(3200,40,3150,20),
 (3150,20,3000,10),(3000,10,2800,5),(2800,5,2500,0))
SELECT event_id, mv, CASE WHEN mv>=3400 THEN 100 WHEN mv<2500 THEN 0 ELSE lo+(mv-lo_mv)*(hi-lo)//(hi_mv-lo_mv) END AS soc
FROM telemetry LEFT JOIN curve ON mv>=lo_mv AND mv<hi_mv""")
def battery_curve(spark, sf):
    return V.telemetry(spark, sf).select(
        "event_id", "mv", policy.battery_percent(F.col("mv")).alias("soc"))


AUDIT_SQL = f"""WITH result AS ({RESULT_SQL.strip()} FROM tile_scores GROUP BY frame_id),
 passes AS (SELECT t.*, tiles_over>=1 AS detected, event_id%37=0 AS camera_error, event_id%41=0 AS model_error,
  {ACTION_SQL} AS action FROM telemetry_dense t JOIN result ON frame_id=event_id),
 a AS (SELECT *, action='capture' AND detected AND NOT camera_error AS alert,
  clock_ok AND action='capture' AND hour>=7 AS beat, clock_ok AND action='telemetry' AS low FROM passes),
 r AS (SELECT *, row_number() OVER (PARTITION BY node_id, date, hour, alert, clock_ok ORDER BY ts, event_id) AS ra,
  row_number() OVER (PARTITION BY node_id, date, beat ORDER BY ts, event_id) AS rb,
  row_number() OVER (PARTITION BY node_id, date, low ORDER BY ts, event_id) AS rl FROM a)
SELECT event_id, node_id, action, CASE WHEN action='sleep' THEN 0 WHEN action='telemetry' THEN (CASE WHEN soc<35 THEN 16 ELSE 0 END)
 ELSE (CASE WHEN alert THEN 1 ELSE 0 END)+(CASE WHEN camera_error THEN 4 ELSE 0 END)+(CASE WHEN model_error AND NOT camera_error THEN 8 ELSE 0 END)
 +(CASE WHEN soc<35 THEN 16 ELSE 0 END) END AS flags, alert,
 CASE WHEN action='sleep' THEN {DAWN_SQL} ELSE {INTERVAL_SQL} END AS wake_s,
 {{allowed}} AS send_alert, beat AND rb=1 AS send_heartbeat, low AND rl=1 AS send_battery FROM r"""

# the node's counter: spans start at alerts whose hour differs from that of the alert before
NODE_SQL = """ s AS (SELECT *, lag(hour) OVER (PARTITION BY node_id, alert ORDER BY ts, event_id) AS prev, low AND rl=1 AS note FROM r0),
 p AS (SELECT *, sum(CASE WHEN alert AND prev IS DISTINCT FROM hour THEN 1 ELSE 0 END) OVER (PARTITION BY node_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS span FROM s),
 r AS (SELECT *, sum(CASE WHEN alert OR note THEN 1 ELSE 0 END) OVER (PARTITION BY node_id, span ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS used FROM p)
"""


def _audited(spark, sf, **how):
    # stored, because the audit reads its passes twice and tiles are 32 times as many
    result = materialize(rules.capture_result(V.tile_scores(spark, sf)).select(
        F.col("frame_id").alias("event_id"), F.col("alert").alias("detected")), "capture-results")
    e = F.col("event_id")
    passes = V.telemetry(spark, sf, dense=True).join(result, "event_id").withColumn(
        "camera_error", e % 37 == 0).withColumn("model_error", e % 41 == 0)
    return audit.policy_audit(passes, **how)


@query("C17_policy_audit", "tile_scores telemetry_dense", AUDIT_SQL.format(allowed="alert AND ra<=2"))
def policy_audit(spark, sf):
    return _audited(spark, sf)


@query("C17_policy_audit_node", "tile_scores telemetry_dense", AUDIT_SQL.format(
    allowed="alert AND used<=2").replace(" r AS (SELECT *, row_number()", " r0 AS (SELECT *, row_number()").replace(
    "FROM a)\nSELECT", f"FROM a),\n{NODE_SQL}SELECT"))
def policy_audit_node(spark, sf):
    return _audited(spark, sf, mode="hour_change")


@query("G16_node_days", "telemetry", """
SELECT node_id, date::VARCHAR AS date, count(*) AS captures, count_if(prob_x1000>=970) AS alerts, sum(32)::BIGINT AS inferences,
 sum(event_id%500+event_id%9000)::BIGINT AS cpu_ms FROM telemetry GROUP BY ALL""")
def node_days(spark, sf):
    e = F.col("event_id")
    t = V.telemetry(spark, sf).select(
        "node_id", F.col("date").cast("string").alias("date"),
        (F.col("prob_x1000") >= C.ALERT_X1000).alias("alert"), F.lit(32).alias("tiles_total"),
        (e % 500 + e % 9000).alias("ms"))
    return summaries.node_days(t)


# ---------------------------------------------------------------- windows over nodes

CAP_SQL = """SELECT node_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY node_id, date, hour
 ORDER BY ts, event_id) AS rank FROM alerts) WHERE rank<=2"""


@query("W3_hourly_alert_cap", "alerts", CAP_SQL)
def hourly_alert_cap(spark, sf):
    alerts = V.alerts_from(V.columns(spark, sf, "events", "event_id", "user_id", "ts"))
    return timeline.capped_alerts(alerts).select("node_id", "event_id", "rank")


@query("W3_alert_cap_hour_change", "alerts", """
WITH l AS (SELECT *, lag(hour) OVER (PARTITION BY node_id ORDER BY ts, event_id) AS before FROM alerts),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR before=hour THEN 0 ELSE 1 END) OVER (PARTITION BY node_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM l)
SELECT node_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY node_id, island ORDER BY ts, event_id) AS rank FROM g) WHERE rank<=2""")
def alert_cap_hour_change(spark, sf):
    alerts = V.alerts_from(V.columns(spark, sf, "events", "event_id", "user_id", "ts"))
    return timeline.capped_alerts(alerts, mode="hour_change").select("node_id", "event_id", "rank")


@query("W4_daily_heartbeat", "telemetry", """
SELECT node_id, date::VARCHAR AS date, event_id FROM (SELECT *, row_number() OVER (PARTITION BY node_id, date ORDER BY ts, event_id) AS r
FROM telemetry WHERE clock_ok AND hour>=7 AND hour<18 AND soc>=15) WHERE r=1""")
def daily_heartbeat(spark, sf):
    return timeline.heartbeats_due(V.telemetry(spark, sf)).select(
        "node_id", F.col("date").cast("string").alias("date"), "event_id")


@query("W5_low_battery_notice", "telemetry", """
SELECT node_id, date::VARCHAR AS date, event_id FROM (SELECT *, row_number() OVER (PARTITION BY node_id, date ORDER BY ts, event_id) AS r
FROM telemetry WHERE clock_ok AND soc<15 AND hour>=6 AND hour<18) WHERE r=1""")
def low_battery_notice(spark, sf):
    return timeline.battery_notices(V.telemetry(spark, sf)).select(
        "node_id", F.col("date").cast("string").alias("date"), "event_id")


@query("W4_untrusted_clock", "telemetry", "SELECT node_id, event_id FROM telemetry WHERE NOT clock_ok")
def untrusted_clock(spark, sf):
    """The side output of W4 and W5: readings without a date to go by."""
    return timeline.untrusted_clock(V.telemetry(spark, sf)).select("node_id", "event_id")


# ---------------------------------------------------------------- streams

def _timed(df, column="ts"):
    return df.withColumn(column, F.col(column).cast("timestamp"))


@query("T1_continuous_decode", "uplinks", f"""
SELECT event_id AS uplink_id, 'decoded' AS route, {TEXT_SQL} AS detail FROM uplinks WHERE ({_ALERTS}) OR ({_BEATS})
UNION ALL SELECT event_id, 'rejected', CASE WHEN fport=99 THEN 'FPort 99 no reconocido' WHEN fport=10 THEN 'alerta de '||n_bytes||' bytes, se esperaban 6'
 ELSE 'heartbeat de '||n_bytes||' bytes, se esperaban 14' END FROM uplinks WHERE NOT (({_ALERTS}) OR ({_BEATS}))""")
def continuous_decode(spark, sf):
    good, bad = decode_available(V.uplinks_from(event_stream(spark, sf)))
    return good.select("uplink_id", F.lit("decoded").alias("route"), F.col("texto").alias("detail")
                       ).unionByName(bad.select(
                           "uplink_id", F.lit("rejected").alias("route"),
                           F.get("errors", F.lit(0)).alias("detail")))


@query("T2_stateful_alert_cap", "alerts", CAP_SQL)
def stateful_alert_cap(spark, sf):
    alerts = _timed(V.alerts_from(event_stream(spark, sf)))
    return state.capped_alerts(alerts)[0].select("node_id", "event_id", "rank")


# Events in three batches by time, a seventh of them held back to the last one, and the watermark before each batch.
def _batches_sql(rows, delay_ms, ends):
    return f"""b AS (SELECT *, epoch_us(ts)//1000 AS seen_ms, {ends} AS ends FROM ({rows})),
w AS (SELECT i AS batch, greatest(0, coalesce((SELECT max(seen_ms) FROM b WHERE b.batch<i)-{delay_ms}, 0)) AS reached
 FROM (SELECT unnest(range(3)) AS i)),
s AS (SELECT b.*, ends<=reached AS late FROM b JOIN w USING (batch))"""


def _batch_sql(key, third):
    return f"CASE WHEN {key}%7=3 THEN 2 ELSE least(2, {third}) END AS batch"


def _in_batches(spark, sf, build):
    """Feed the events to a stream in three runs of one checkpoint; rows held back come after their time."""
    path, folder = scratch_path(spark, "late-events"), scratch_path(spark, "late-run")
    third = F.floor(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 864000)
    batch = F.when(F.col("event_id") % 7 == 3, 2).otherwise(F.least(F.lit(2), third))
    for i in range(3):
        V.table(spark, sf, "events").where(batch == i).write.mode("append").parquet(path)
        out = build(spark.readStream.schema(EVENTS).parquet(path), folder)
    return out


@query("T2_late_alerts", "alerts", f"""
WITH {_batches_sql(f"SELECT *, {_batch_sql('event_id', 'secs//36000')} FROM alerts", 3600000,
                   "(epoch_us(ts)//3600000000+1)*3600000+60000")}
SELECT node_id, event_id, rank, false AS late FROM (SELECT *, row_number() OVER (PARTITION BY node_id, date, hour ORDER BY ts, event_id) AS rank
 FROM s WHERE NOT late) WHERE rank<=2
UNION ALL SELECT node_id, event_id, NULL, true FROM s WHERE late""")
def late_alerts(spark, sf):
    """The streamed cap over batches that are out of order, with the alerts that came after their hour had closed."""
    capped, late = _in_batches(spark, sf, lambda events, folder: state.capped_alerts(
        _timed(V.alerts_from(events)), folder=folder))
    return capped.select("node_id", "event_id", "rank", F.lit(False).alias("late")).unionByName(
        late.select("node_id", "event_id", F.lit(None).cast("int").alias("rank"), F.lit(True).alias("late")))


@query("T3_daily_notices", "telemetry", """
SELECT DISTINCT node_id, date::VARCHAR AS date, 'heartbeat' AS kind FROM telemetry WHERE clock_ok AND hour>=7 AND hour<18 AND soc>=15
UNION ALL SELECT DISTINCT node_id, date::VARCHAR, 'bateria_baja' FROM telemetry WHERE clock_ok AND soc<15 AND hour>=6 AND hour<18""")
def daily_notices(spark, sf):
    readings = _timed(V.telemetry_from(event_stream(spark, sf)))
    return live.once_a_day(readings)[0].select("node_id", F.col("date").cast("string").alias("date"), "kind")


_NOTICES = f"""SELECT *, {_batch_sql('event_id', 'secs//864000')} FROM (
SELECT *, 'heartbeat' AS kind FROM telemetry WHERE clock_ok AND hour>=7 AND hour<18 AND soc>=15
UNION ALL SELECT *, 'bateria_baja' FROM telemetry WHERE clock_ok AND soc<15 AND hour>=6 AND hour<18)"""


@query("T3_late_notices", "telemetry", f"""
WITH {_batches_sql(_NOTICES, 86400000, "(epoch_us(date::TIMESTAMP)//86400000000+1)*86400000")}
SELECT node_id, kind, event_id, false AS late FROM (SELECT *, row_number() OVER (PARTITION BY node_id, date, kind ORDER BY ts, event_id) AS r
 FROM s WHERE NOT late) WHERE r=1
UNION ALL SELECT node_id, kind, event_id, true FROM s WHERE late""")
def late_notices(spark, sf):
    """Daily notices over batches that are out of order, with the readings that came after their day had closed."""
    notices, late = _in_batches(spark, sf, lambda events, folder: live.once_a_day(
        _timed(V.telemetry_from(events)), folder=folder))
    return notices.select("node_id", "kind", "event_id", F.lit(False).alias("late")).unionByName(
        late.select("node_id", "kind", "event_id", F.lit(True).alias("late")))


def _capture_stream(spark, sf):
    """Captures with their best tile score, computed inside the row."""
    caps = V.captures_from(event_stream(spark, sf))
    return caps, V.tiles_of(caps)


def _scored_captures(spark, sf):
    """Stream of captures with one score each (the telemetry probability)."""
    t = V.telemetry_from(event_stream(spark, sf))
    return t.select("event_id", F.concat(F.lit("cam-"), F.col("node_id")).alias("camera"), "ts",
                    (F.col("prob_x1000") / 1000.0).alias("score"))


@query("T4_streamed_confirmation", "telemetry", """
WITH h AS (SELECT event_id, 'cam-'||node_id AS camera, prob_x1000/1000.0::DOUBLE AS score, lag(prob_x1000/1000.0::DOUBLE,1) OVER w AS l1,
 lag(prob_x1000/1000.0::DOUBLE,2) OVER w AS l2 FROM telemetry WINDOW w AS (PARTITION BY node_id ORDER BY ts, event_id))
SELECT event_id, camera, CASE WHEN l1 IS NOT NULL THEN least(score,l1) END AS confirmed_2,
 CASE WHEN l2 IS NOT NULL THEN least(score,l1,l2) END AS confirmed_3 FROM h""")
def streamed_confirmation(spark, sf):
    rows = state.confirmed_stream(_scored_captures(spark, sf), (2, 3), tie="event_id")
    return rows.select("event_id", "camera", "confirmed_2", "confirmed_3")


def _scores_of(events):
    return V.telemetry_from(events).select(
        "event_id", F.concat(F.lit("cam-"), (F.col("node_id") % 4).cast("string")).alias("camera"), "ts",
        (F.col("prob_x1000") / 1000.0).alias("score"))


@query("T4_late_confirmation", "telemetry", """
WITH h AS (SELECT event_id, prob_x1000/1000.0::DOUBLE AS score, lag(prob_x1000/1000.0::DOUBLE,1) OVER w AS l1,
 lag(prob_x1000/1000.0::DOUBLE,2) OVER w AS l2 FROM telemetry WINDOW w AS (PARTITION BY node_id%4 ORDER BY ts, event_id))
SELECT event_id, CASE WHEN l1 IS NOT NULL THEN least(score,l1) END AS confirmed_2,
 CASE WHEN l2 IS NOT NULL THEN least(score,l1,l2) END AS confirmed_3 FROM h""")
def late_confirmation(spark, sf):
    """Four busy cameras over batches that are out of order: the newest versions are those of one pass in order."""
    rows = _in_batches(spark, sf, lambda events, folder: state.confirmed_stream(
        _scores_of(events), (2, 3), tie="event_id", folder=folder))
    return rows.select("event_id", "confirmed_2", "confirmed_3")


@query("T5_late_runs", "telemetry", f"""
WITH f AS (SELECT event_id AS frame_id, node_id%4 AS camera, ts, prob_x1000>=100 AS hit FROM telemetry), {RUN_SQL}""")
def late_runs(spark, sf):
    """Runs of four busy cameras over batches that are out of order."""
    def run(events, folder):
        t = V.telemetry_from(events).select(
            "event_id", (F.col("node_id") % 4).cast("long").alias("camera"), "ts", "prob_x1000")
        return state.run_length_stream(t, F.col("prob_x1000") >= 100, "camera", folder=folder)

    return _in_batches(spark, sf, run).select(F.col("event_id").alias("frame_id"), "camera", "run")


@query("K5_streamed_leaderboard", "tile_scores", K5_SQL)
def streamed_leaderboard(spark, sf):
    """The rule leaderboard kept up to date over batches that are out of order."""
    return _in_batches(spark, sf, lambda events, folder: leaderboard_stream(
        V.scored_frames_of(V.captures_from(events)), folder=folder))


@query("T5_streamed_runs", "telemetry", f"""
WITH f AS (SELECT event_id AS frame_id, node_id AS camera, ts, prob_x1000>=300 AS hit FROM telemetry), {RUN_SQL}""")
def streamed_runs(spark, sf):
    t = V.telemetry_from(event_stream(spark, sf)).select("event_id", "node_id", "ts", "prob_x1000")
    rows = state.run_length_stream(t, F.col("prob_x1000") >= 300)
    return rows.select(F.col("event_id").alias("frame_id"), F.col("node_id").alias("camera"), "run")


@query("T6_capture_stream", "tile_scores", f"""
SELECT *, tiles_over>=1 AS alert FROM ({RESULT_SQL.strip()} FROM tile_scores GROUP BY frame_id)""")
def capture_stream(spark, sf):
    caps, tiles = _capture_stream(spark, sf)
    return live.capture_alerts(_timed(tiles))[0]


@query("T6_late_tiles", "tile_scores", f"""
WITH {_batches_sql(f"SELECT *, {_batch_sql('(frame_id*32+tile_id)', '(epoch_us(ts)//1000000-1704067200)//864000')} FROM tile_scores",
                   600000, "epoch_us(ts)//1000")}
SELECT frame_id, NULL AS tile_id, tiles_total, tiles_over, prob_max_x1000, x_max, y_max, false AS late FROM (
 {RESULT_SQL.strip()} FROM s WHERE NOT late GROUP BY frame_id)
UNION ALL SELECT frame_id, tile_id, NULL, NULL, NULL, NULL, NULL, true FROM s WHERE late""")
def late_tiles(spark, sf):
    """Capture results over batches that are out of order, with the tiles that came after their frame had closed."""
    tile = "frame_id long, ts timestamp, tile_id int, x int, y int, prob_x1000 int"
    path, folder = scratch_path(spark, "late-tiles"), scratch_path(spark, "late-run")
    tiles = _timed(V.tile_scores(spark, sf)).select(*[c.split()[0] for c in tile.split(", ")])
    third = F.floor((F.unix_seconds("ts") - V.EPOCH0) / 864000)
    batch = F.when((F.col("frame_id") * 32 + F.col("tile_id")) % 7 == 3, 2).otherwise(F.least(F.lit(2), third))
    for i in range(3):
        tiles.where(batch == i).write.mode("append").parquet(path)
        frames, late = live.capture_alerts(spark.readStream.schema(tile).parquet(path), folder=folder)
    cols = ["tiles_total", "tiles_over", "prob_max_x1000", "x_max", "y_max"]
    blank = [F.lit(None).cast(frames.schema[c].dataType).alias(c) for c in cols]
    return frames.select("frame_id", F.lit(None).cast("int").alias("tile_id"), *cols, F.lit(False).alias("late")).unionByName(
        late.select("frame_id", "tile_id", *blank, F.lit(True).alias("late")))
