"""Binary uplinks, link messages and trace lines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumewatch import constants as C
from plumewatch import schemas as S
from plumewatch.functions.hashing import hex_int


def _byte(value: Column) -> Column:
    return F.lpad(F.hex(value.cast("bigint").bitwiseAND(F.lit(255))), 2, "0")


def _percent(value: Column) -> Column:
    return _byte(F.least(value.cast("bigint"), F.lit(100)))


def _int32(value: Column) -> Column:
    return F.lpad(F.hex(F.pmod(value.cast("bigint"), F.lit(2**32))), 8, "0")


def temperature_byte(celsius: Column) -> Column:
    """Temperature limited to -40..87 and shifted into 0..127."""
    return F.least(F.greatest(celsius, F.lit(-40)), F.lit(87)) + 40


def confidence_percent(prob_x1000: Column) -> Column:
    """Per-mille probability to a rounded percent, at most 100."""
    return F.when(prob_x1000 >= 1000, F.lit(100)).otherwise(
        F.floor((prob_x1000 + 5) / 10)).cast("int")


def encode_alert(node, kind, confidence_pct, battery_pct, celsius, flags) -> Column:
    return F.unhex(F.concat(
        _byte(node), _byte(kind), _percent(confidence_pct), _percent(battery_pct),
        _byte(temperature_byte(celsius)), _byte(flags)))


def encode_heartbeat(node, lat_e7, lon_e7, battery_pct, celsius, humidity_pct, firmware) -> Column:
    return F.unhex(F.concat(
        _byte(node), F.lit("00"), _int32(lat_e7), _int32(lon_e7), _percent(battery_pct),
        _byte(temperature_byte(celsius)), _percent(humidity_pct), _byte(firmware)))


def event_name(kind: Column) -> Column:
    name = F.concat(F.lit("desconocido_"), kind.cast("string"))
    for code, text in C.EVENT_NAMES.items():
        name = F.when(kind == code, F.lit(text)).otherwise(name)
    return name


def flag_columns(flags: Column) -> list[Column]:
    return [
        (flags.bitwiseAND(F.lit(bit).cast("bigint")) != 0).alias(name)
        for name, bit in C.FLAG_BITS.items()
    ]


def signed32(hexed: Column, start: int) -> Column:
    """Two's-complement big-endian int32 from eight hex digits."""
    raw = hex_int(hexed, start, 8)
    return F.when(raw >= 2**31, raw - 2**32).otherwise(raw)


def _at(hexed: Column, index: int) -> Column:
    return hex_int(hexed, 1 + 2 * index, 2)


def alert_fields(payload: Column) -> list[Column]:
    """Fields of a 6-byte alert frame."""
    h = F.hex(payload)
    return [
        _at(h, 0).alias("node_id"),
        event_name(_at(h, 1)).alias("evento"),
        (_at(h, 2) / 100).alias("confianza"),
        _at(h, 3).alias("bateria_pct"),
        (_at(h, 4) - 40).alias("temp_c"),
        *flag_columns(_at(h, 5)),
    ]


def heartbeat_fields(payload: Column) -> list[Column]:
    """Fields of a 14-byte heartbeat frame."""
    h = F.hex(payload)
    return [
        _at(h, 0).alias("node_id"),
        event_name(_at(h, 1)).alias("evento"),
        (signed32(h, 5) / 1e7).alias("lat"),
        (signed32(h, 13) / 1e7).alias("lon"),
        _at(h, 10).alias("bateria_pct"),
        (_at(h, 11) - 40).alias("temp_c"),
        _at(h, 12).alias("hr_pct"),
        _at(h, 13).cast("string").alias("fw"),
    ]


ALERT_ONLY = ("confianza", *C.FLAG_BITS)
HEARTBEAT_ONLY = ("lat", "lon", "hr_pct", "fw")


def uplink_errors(payload: Column, fport: Column) -> Column:
    """Reasons a frame cannot be decoded; an empty array means it can."""
    n = F.length(payload)

    def short(kind, need):
        return F.concat(F.lit(f"{kind} de "), n.cast("string"), F.lit(f" bytes, se esperaban {need}"))

    return F.array_compact(F.array(
        F.when(payload.isNull(), F.lit("sin payload")),
        F.when(fport.isNull(), F.lit("sin FPort")),
        F.when((fport == C.PORT_ALERT) & (n < C.ALERT_BYTES), short("alerta", C.ALERT_BYTES)),
        F.when((fport == C.PORT_HEARTBEAT) & (n < C.HEARTBEAT_BYTES),
               short("heartbeat", C.HEARTBEAT_BYTES)),
        F.when(~fport.isin(C.PORT_ALERT, C.PORT_HEARTBEAT),
               F.concat(F.lit("FPort "), fport.cast("string"), F.lit(" no reconocido"))),
    ))


def decodable(payload: Column, fport: Column) -> Column:
    """Known port and enough bytes: the cheap test behind `uplink_errors`, fit for filters."""
    n = F.length(payload)
    return (((fport == C.PORT_ALERT) & (n >= C.ALERT_BYTES))
            | ((fport == C.PORT_HEARTBEAT) & (n >= C.HEARTBEAT_BYTES)))


def number_text(value: Column) -> Column:
    """Shortest decimal text, whole numbers without a trailing '.0'."""
    return F.regexp_replace(value.cast("string"), "\\.0$", "")


def uplink_warnings() -> Column:
    """Quality warnings over decoded columns."""
    c = F.col
    smoke_alert = (c("fport") == C.PORT_ALERT) & (c("evento") == "humo")
    return F.array_compact(F.array(
        F.when(smoke_alert & (c("confianza") < 0.9), F.concat(
            F.lit("confianza "), number_text(c("confianza")),
            F.lit(" por debajo del umbral de diseno"))),
        F.when(c("bateria_pct") < 20, F.lit("bateria por debajo del 20 %")),
        F.when(c("error_camara"), F.lit("el nodo reporta error de camara")),
        F.when(c("error_modelo"), F.lit("el nodo reporta error de inferencia")),
    ))


def uplink_text() -> Column:
    """Readable line; the node part keeps only the last two digits of its number."""
    c = F.col

    def fixed(name, label, pattern):
        # format_string would print a NULL as text
        return F.when(c(name).isNotNull(), F.concat(F.lit(label), F.format_string(pattern, c(name))))

    return F.when(c("node_id").isNotNull(), F.concat_ws(
        " | ",
        F.concat(F.lit("NODE"), F.substring(F.concat(F.lit("0"), c("node_id")), -2, 2)),
        F.concat(F.lit("EVT="), F.upper(c("evento"))),
        fixed("confianza", "CONF=", "%.2f"),
        fixed("lat", "LAT=", "%.5f"),
        fixed("lon", "LON=", "%.5f"),
        F.concat(F.lit("BAT="), c("bateria_pct"), F.lit("%")),
        F.concat(F.lit("T="), c("temp_c"), F.lit("C")),
        F.concat(F.lit("HR="), c("hr_pct"), F.lit("%")),
        F.concat(F.lit("FW="), c("fw")),
    ))


def link_message(text: Column) -> Column:
    """Parsed JSON line; NULL when the text is not a message or a field has another type."""
    kept = T.StructType([*S.LINK_MESSAGE.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json(text, kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    message = F.struct(*[parsed[f.name].alias(f.name) for f in S.LINK_MESSAGE.fields])
    return F.when(parsed.dispositivo.isNotNull() & parsed["_bad"].isNull(), message)


# fixed texts of the node trace
TRACE_UPLINK = r"^\[lora\] uplink fport=(\d+) fcnt=(\d+) payload=([0-9A-F]*)$"
TRACE_CAPTURE = (
    r"^\[nodo\] teselas=(\d+) sobre=(\d+) pmax=(\d+\.\d+) \((-?\d+),(-?\d+)\) "
    r"remuestreo=(\d+)ms inferencia=(\d+)ms$"
)
TRACE_PASS = r"^\[nodo\] (\d{4}-\d{2}-\d{2}) (\d{2}):(\d{2})  SoC=(\d+)%  capturas=(\d+)$"


def _group(text: Column, pattern: str, index: int, kind: str) -> Column:
    found = F.regexp_extract(text, pattern, index)
    return F.when(found != "", found.try_cast(kind))


def trace_fields(line: Column) -> list[Column]:
    """Fields of one trace line; those of other line kinds are NULL."""
    up, cap, pas = TRACE_UPLINK, TRACE_CAPTURE, TRACE_PASS
    return [
        F.when(line.rlike(up), "uplink").when(line.rlike(cap), "capture")
        .when(line.rlike(pas), "pass").otherwise("other").alias("kind"),
        _group(line, up, 1, "int").alias("fport"),
        _group(line, up, 2, "bigint").alias("fcnt"),
        F.when(line.rlike(up), F.unhex(F.regexp_extract(line, up, 3))).alias("payload"),
        _group(line, cap, 1, "int").alias("tiles_total"),
        _group(line, cap, 2, "int").alias("tiles_over"),
        _group(line, cap, 3, "double").alias("prob_max"),
        _group(line, cap, 4, "int").alias("x_max"),
        _group(line, cap, 5, "int").alias("y_max"),
        _group(line, cap, 6, "bigint").alias("ms_resample"),
        _group(line, cap, 7, "bigint").alias("ms_infer"),
        _group(line, pas, 1, "string").alias("date"),
        _group(line, pas, 2, "int").alias("hour"),
        _group(line, pas, 3, "int").alias("minute"),
        _group(line, pas, 4, "int").alias("soc"),
        _group(line, pas, 5, "bigint").alias("captures"),
    ]
