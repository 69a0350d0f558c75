"""Known values of geometry, codec, policy, scoring and metrics."""

import pytest
from pyspark.sql import functions as F

from plumewatch import constants as C
from plumewatch.functions import codec, geometry as geo, policy, scoring
from plumewatch.operators import curves, metrics
from plumewatch.sources.reports import training_summary
from plumewatch.sources.telemetry import decode_uplinks


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("size,n", [
    ((1280, 720), 32), ((200, 200), 0), ((1600, 1200), 70), ((640, 480), 12), ((2592, 1944), 192)])  # 16 x 12 by the rule; a published table says 195
def test_grid_sizes(spark, size, n):
    assert len(one(spark, geo.tile_grid(F.lit(size[0]), F.lit(size[1])))[0]) == n


def test_grid_order(spark):
    grid = [tuple(t) for t in one(spark, geo.tile_grid(F.lit(1280), F.lit(720)))[0]]
    xs = [0, 168, 336, 504, 672, 840, 1008, 1056]
    assert grid == [(x, y) for y in (0, 168, 336, 496) for x in xs]


def test_parse_boxes_skips_malformed(spark):
    text = "0 0.5 0.5 0.1 0.2\r\n\n 1 2 3\n0 0.5 0.5 0.1 x\n  0\t0.25 0.5 0.1 0.2  \n0 1 2 3 4 5"
    boxes = one(spark, geo.parse_boxes(F.lit(text), F.lit(1000), F.lit(100)))[0]
    assert [tuple(round(v, 6) for v in b) for b in boxes] == [
        (450.0, 40.0, 550.0, 60.0), (200.0, 40.0, 300.0, 60.0)]
    null = F.lit(None).cast("string")
    assert one(spark, geo.parse_boxes(null, F.lit(1000), F.lit(100)))[0] == []


def test_smoke_text(spark):
    row = one(spark, geo.has_smoke_text(F.lit(" \n\t")), geo.has_smoke_text(F.lit("x")),
              geo.has_smoke_text(F.lit(None).cast("string")))
    assert tuple(row) == (False, True, False)


def test_window_smaller_than_a_tall_box(spark):
    box = geo.box_struct(*[F.lit(float(v)) for v in (600, 10, 640, 700)])
    win = one(spark, geo.window_around(box, F.lit(1280), F.lit(720)))[0]
    assert win.x1 - win.x0 == 720 and win.y0 == 0


@pytest.mark.parametrize("camera,bucket", [
    ("brison-20", 16), ("courmettes-212", 4), ("serre-de-barre-108", 16)])
def test_split_buckets(spark, camera, bucket):
    from plumewatch.functions.hashing import hex_int

    row = one(spark, hex_int(F.md5(F.lit(camera)), 1, 8) % 100,
              geo.split_part(F.lit(camera), F.lit("p")),
              geo.split_part(F.lit(camera), F.lit("sdis-77")))
    assert tuple(row) == (bucket, "val", "cruzado")


def test_encode_alert(spark):
    alert = codec.encode_alert(*[F.lit(v) for v in (3, 1, 92, 87, 31, 1)])
    assert bytes(one(spark, alert)[0]).hex().upper() == "03015C574701"
    over = codec.encode_alert(*[F.lit(v) for v in (3, 1, 200, 150, 31, 1)])
    assert bytes(one(spark, over)[0]).hex().upper() == "030164644701"


def test_encode_heartbeat(spark):
    beat = codec.encode_heartbeat(*[F.lit(v) for v in (1, -61234500, -751234500, 85, 31, 86, 1)])
    assert bytes(one(spark, beat)[0]).hex().upper() == "0100FC59A2BCD339123C55475601"


def decoded(spark, hexed, port):
    df = spark.createDataFrame([(bytearray.fromhex(hexed), port)], "payload binary, fport int")
    return decode_uplinks(df).first()


def test_decode_heartbeat(spark):
    r = decoded(spark, "0100FC59A2BCD339123C55475601", 11)
    assert (r.lat, r.lon, r.bateria_pct, r.temp_c, r.hr_pct, r.fw) == (
        -6.12345, -75.12345, 85, 31, 86, "1")
    assert r.texto == ("NODE01 | EVT=HEARTBEAT | LAT=-6.12345 | LON=-75.12345 | BAT=85% | T=31C | "
                       "HR=86% | FW=1")


def test_decode_alerts(spark):
    r = decoded(spark, "030161574701", 10)
    assert (r.node_id, r.evento, r.confianza, r.bateria_pct, r.temp_c, r.alarma_activa) == (
        3, "humo", 0.97, 87, 31, True)
    r = decoded(spark, "010200124311", 10)
    assert (r.evento, r.bateria_pct, r.modo_ahorro) == ("bateria_baja", 18, True)
    assert r.warnings == ["bateria por debajo del 20 %"]
    r = decoded(spark, "7B0900124311", 10)
    assert r.evento == "desconocido_9" and r.texto.startswith("NODE23 | EVT=DESCONOCIDO_9")


def test_decode_errors(spark):
    assert decoded(spark, "0301", 10).errors == ["alerta de 2 bytes, se esperaban 6"]
    assert decoded(spark, "0301", 11).errors == ["heartbeat de 2 bytes, se esperaban 14"]
    r = decoded(spark, "030161574701", 12)
    assert r.errors == ["FPort 12 no reconocido"] and r.node_id is None and r.warnings == []


def test_bytes(spark):
    row = one(spark, *[codec.temperature_byte(F.lit(v)) for v in (-50, 100)],
              *[codec.confidence_percent(F.lit(v)) for v in (970, 1000, 994, 995)])
    assert tuple(row) == (0, 127, 97, 100, 99, 100)


@pytest.mark.parametrize("hour,ok,soc,expected", [
    (3, True, 80, ("sleep", 10800)), (12, True, 80, ("capture", 900)),
    (12, True, 30, ("capture", 3600)), (12, True, 10, ("telemetry", 10800)),
    (7, True, 80, ("capture", 3600)), (19, True, 80, ("sleep", 39600)),
    (3, False, 80, ("capture", 900))])
def test_policy(spark, hour, ok, soc, expected):
    args = F.lit(hour), F.lit(ok), F.lit(soc)
    row = one(spark, policy.action(*args), policy.next_wake(F.lit(hour), F.lit(0), F.lit(ok), F.lit(soc)))
    assert tuple(row) == expected


def test_battery_curve(spark):
    rows = spark.createDataFrame([(m,) for m in (4000, 3400, 3399, 3300, 3225, 2650, 2500, 2000)],
                                 "mv int")
    got = [r[0] for r in rows.select(policy.battery_percent(F.col("mv"))).collect()]
    assert got == [100, 100, 99, 90, 55, 2, 0, 0]


def test_quantization(spark):
    row = one(spark, scoring.quantize(F.lit(0.5), 1.0, 0), scoring.quantize(F.lit(1.5), 1.0, 0),
              scoring.quantize(F.lit(999.0), 1.0, 0), scoring.per_mille(F.lit(121)),
              scoring.per_mille(F.lit(120)))
    assert tuple(row) == (0, 2, 127, 973, 969)


# tp, fp, fn, tn -> recall, precision, f1, fpr, exactitud as published
@pytest.mark.parametrize("counts,rates", [
    ((7423, 254, 1861, 15351), (0.7995, 0.9669, 0.8753, 0.0163, 0.915)),
    ((8683, 1533, 601, 14072), (0.9353, 0.8499, 0.8906, 0.0982, 0.9143)),
    ((0, 0, 0, 0), (0.0, 0.0, 0.0, 0.0, 0.0))])
def test_rates(spark, counts, rates):
    df = spark.createDataFrame([counts], "tp long, fp long, fn long, tn long")
    assert tuple(metrics.with_rates(df).first())[4:] == rates


def test_rounded_fpr_is_allowed(spark):
    df = spark.createDataFrame([(90, 1561, 10, 14044)], "tp long, fp long, fn long, tn long")
    point = metrics.with_rates(df).withColumn("umbral", F.lit(0.3))
    assert metrics.operating_point(point, fallback=False).count() == 1


def test_operating_point_fallback(spark):
    df = spark.createDataFrame([(0.1, 0.9, 0.5, 0.5), (0.2, 0.8, 0.7, 0.4), (0.3, 0.1, 0.7, 0.3)],
                               "umbral double, recall double, f1 double, fpr double")
    assert metrics.operating_point(df).first().umbral == 0.2
    assert metrics.operating_point(df, fallback=False).count() == 0


def test_class_weights(spark):
    df = spark.range(135561).select((F.col("id") < 51526).cast("int").alias("y"))
    got = {r.y: r.weight for r in metrics.class_weights(df, "y").collect()}
    assert got == {0: 0.8066, 1: 1.3155}


@pytest.mark.parametrize("fpr,recall,false_day,shares", [
    (0.0034, 0.622, 4.8, (0.86, 0.98, 1.0, 1.0)), (0.001, 0.427, 1.5, (0.67, 0.89, 0.99, 1.0)),
    (0.00032, 0.313, 0.5, (0.53, 0.78, 0.95, 0.99)), (0.00032, 0.074, 0.5, (0.14, 0.27, 0.46, 0.6))])
def test_detection_delay(spark, fpr, recall, false_day, shares):
    df = spark.createDataFrame([(fpr, recall)], "fpr_target double, recall double")
    rows = curves.detection_delay(df, captures=(2, 4, 8, 12)).orderBy("captures").collect()
    assert round(rows[0].false_per_day, 1) == false_day
    assert [round(r.detected, 2) for r in rows] == pytest.approx(shares, abs=0.0101)


def test_training_phases(spark):
    values = [(0, .5), (1, .6), (2, .4), (0, .7), (1, .9), (2, .8), (3, .8), (4, .8), (5, .85), (6, .8)]
    df = spark.createDataFrame([("r", i, e, v) for i, (e, v) in enumerate(values)],
                               "run string, line int, epoch int, val_auc_pr double")
    got = {r.phase: (r.best_epoch, r.stop_epoch) for r in training_summary(df).collect()}
    assert got == {1: (1, None), 2: (1, 5)}


def test_haze_keeps_range(spark):
    px = F.array(*[F.lit(float(v)) for v in (0, 128, 255)])
    assert one(spark, scoring.haze(px, F.lit(0.5), F.lit(200.0)))[0] == [100.0, 164.0, 227.5]


def test_gray(spark):
    px = F.array(*[F.lit(v) for v in (255, 255, 255, 0, 0, 0, 255, 0, 0, 9)])
    assert one(spark, scoring.gray_triples(px))[0] == [255] * 3 + [0] * 3 + [76] * 3


def test_capture_result_ties_zeros_and_failed_tiles(spark):
    from plumewatch.operators.rules import capture_result

    rows = [(1, 0, 10, 0, 980, False), (1, 1, 20, 0, 980, False), (1, 2, 30, 0, 999, True),
            (2, 0, 10, 0, 0, False), (3, 0, 10, 0, 990, True)]
    df = spark.createDataFrame(
        rows, "frame_id long, tile_id int, x int, y int, prob_x1000 int, error boolean")
    got = {r.frame_id: tuple(r)[1:] for r in capture_result(df).collect()}
    assert got == {1: (3, 2, 980, 10, 0, True, True), 2: (1, 0, 0, -1, -1, False, False),
                   3: (1, 0, 0, -1, -1, False, True)}


def test_frame_size_from_bytes(spark):
    """PNG, JPEG with other segments and fill bytes before the frame header, cut and unknown images."""
    from plumewatch.sources.frames import with_frame_size

    png = "89504E470D0A1A0A0000000D4948445200000280000001E00802000000"
    jpeg = "FFD8FFE000104A46494600010100000100010000FFDB0004AABBFFFFC2001108012C019003"
    rows = [(1, png), (2, jpeg), (3, jpeg[:50]), (4, "00000000"), (5, ""), (6, None), (7, "FFD8FFC4000400")]
    df = spark.createDataFrame(
        [(i, (None if h is None else bytearray.fromhex(h), None, None)) for i, h in rows]
        + [(8, (bytearray.fromhex(png), 7, 9))],
        "id int, image struct<bytes:binary,width:int,height:int>")
    got = {r.id: (r.width, r.height) for r in with_frame_size(df).collect()}
    none = (None, None)
    assert got == {1: (640, 480), 2: (400, 300), 3: none, 4: none, 5: none, 6: none, 7: none, 8: (7, 9)}
