"""Sources of uplinks, link messages and trace lines, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumewatch import constants as C
from plumewatch import schemas as S
from plumewatch.functions import codec
from plumewatch.operators.segments import read_lines, with_record


def read_uplinks(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(S.UPLINK).parquet(path)


def decode_uplinks(df: DataFrame) -> DataFrame:
    """Decoded fields, warnings and errors of (payload, fport) rows; works on streams too.

    A frame that cannot be decoded becomes a row with its reasons in `errors` and no data.
    """
    payload, port = F.col("payload"), F.col("fport")
    df = df.withColumn("errors", codec.uplink_errors(payload, port))
    fine = codec.decodable(payload, port)
    alert = F.when(fine & (port == C.PORT_ALERT), F.struct(*codec.alert_fields(payload)))
    beat = F.when(fine & (port == C.PORT_HEARTBEAT), F.struct(*codec.heartbeat_fields(payload)))
    df = df.withColumn("_a", alert).withColumn("_h", beat)
    shared = [F.coalesce(f"_a.{c}", f"_h.{c}").alias(c)
              for c in ("node_id", "evento", "bateria_pct", "temp_c")]
    df = df.select(
        *[c for c in df.columns if c not in ("_a", "_h")], *shared,
        *[F.col(f"_a.{c}").alias(c) for c in codec.ALERT_ONLY],
        *[F.col(f"_h.{c}").alias(c) for c in codec.HEARTBEAT_ONLY])
    return df.withColumn("warnings", codec.uplink_warnings()).withColumn(
        "texto", codec.uplink_text())


def split_decoded(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decoded, quarantined) rows."""
    fine = F.coalesce(codec.decodable(F.col("payload"), F.col("fport")), F.lit(False))
    return df.where(fine), df.where(~fine)


def read_link_messages(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON lines; a line that is no message keeps its text in `reject`."""
    reader = spark.readStream if stream else spark.read
    lines = reader.text(path)
    parsed = lines.withColumn("m", codec.link_message(F.col("value")))
    return parsed.select("m.*", F.when(F.col("m").isNull(), F.col("value")).alias("reject"))


def read_trace(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.text(path).select(*codec.trace_fields(F.col("value")))


def read_passes(spark: SparkSession, path: str) -> DataFrame:
    """One row per pass: its own fields, those of its capture line, and its uplinks in order.

    The capture and uplink lines up to the next pass line belong to a pass, also where a split of a large file
    ends between them. A pass without a capture has NULL there, and of several captures the first counts. Lines
    before the first pass of a file make a row without pass fields; lines of other kinds are left out.
    """
    fields = codec.trace_fields(F.col("value"))
    lines = read_lines(spark, path).select("file", "block", "line", *fields).where("kind <> 'other'")
    at = F.struct("block", "line")
    own, capture = ["date", "hour", "minute", "soc", "captures"], [
        "tiles_total", "tiles_over", "prob_max", "x_max", "y_max", "ms_resample", "ms_infer"]
    made = with_record(lines, F.col("kind") == "pass").groupBy("file", "open_block", "open_line", "record_no").agg(
        F.any_value(F.when(F.col("kind") == "pass", F.struct(*own)), True).alias("_pass"),
        F.min_by(F.struct(*capture), F.when(F.col("kind") == "capture", at)).alias("_capture"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "uplink", F.struct(
            "block", "line", "fport", "fcnt", "payload")))).alias("_uplinks"))
    return made.select("file", "record_no", "_pass.*", "_capture.*", F.transform(
        "_uplinks", lambda u: F.struct(u.fport, u.fcnt, u.payload)).alias("uplinks"))
