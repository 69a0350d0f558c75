"""Explicit schemas of every table the library reads or writes."""

from pyspark.sql import types as T

BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")])

ANNOTATED_FRAME = T.StructType([
    T.StructField("image", T.StructType([
        T.StructField("bytes", T.BinaryType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
    ])),
    T.StructField("image_name", T.StringType()),
    T.StructField("annotations", T.StringType()),
    T.StructField("camera", T.StringType()),
    T.StructField("partner", T.StringType()),
    T.StructField("date", T.StringType()),
])

PATCH = T.StructType([
    T.StructField("frame_id", T.LongType()),
    T.StructField("camera", T.StringType()),
    T.StructField("part", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("item", T.IntegerType()),
    T.StructField("crop", T.IntegerType()),
    *BOX.fields,
    T.StructField("patch", T.BinaryType()),
])

TILE_SCORE = T.StructType([
    T.StructField("frame_id", T.LongType()),
    T.StructField("tile_id", T.IntegerType()),
    T.StructField("x", T.IntegerType()),
    T.StructField("y", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
])

FRAME_META = T.StructType([
    T.StructField("frame_id", T.LongType()),
    T.StructField("camera", T.StringType()),
    T.StructField("partner", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("smoke", T.BooleanType()),
])

DETECTION = T.StructType([
    T.StructField("alert", T.BooleanType()),
    T.StructField("tiles_over", T.LongType()),
    T.StructField("tiles_total", T.LongType()),
    T.StructField("prob_max_x1000", T.IntegerType()),
    T.StructField("x_max", T.IntegerType()),
    T.StructField("y_max", T.IntegerType()),
    T.StructField("ms_resample", T.LongType()),
    T.StructField("ms_infer", T.LongType()),
    T.StructField("error", T.BooleanType()),
])

UPLINK = T.StructType([
    T.StructField("uplink_id", T.LongType()),
    T.StructField("node_ts", T.TimestampType()),
    T.StructField("fport", T.IntegerType()),
    T.StructField("payload", T.BinaryType()),
])

LINK_MESSAGE = T.StructType([
    T.StructField("dispositivo", T.StringType()),
    T.StructField("alerta", T.StringType()),
    T.StructField("confianza", T.DoubleType()),
    T.StructField("rssi", T.IntegerType()),
])

HISTORY = T.StructType(
    [T.StructField("epoch", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in (
        "auc_pr", "exactitud", "loss", "precision", "recall",
        "val_auc_pr", "val_exactitud", "val_loss", "val_precision", "val_recall")]
)

POINT = T.StructType(
    [T.StructField("umbral", T.DoubleType())]
    + [T.StructField(c, T.LongType()) for c in ("tp", "fp", "fn", "tn")]
    + [T.StructField(c, T.DoubleType()) for c in ("recall", "precision", "f1", "fpr", "exactitud")]
)

EVALUATION = T.StructType([
    T.StructField("modelo", T.StringType()),
    T.StructField("metas", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("resultados", T.MapType(
        T.StringType(), T.MapType(T.StringType(), T.MapType(T.StringType(), POINT)))),
])

# the driver's event table, used as a stream source
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])
