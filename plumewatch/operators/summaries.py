"""Dataset, node and label summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumewatch import constants as C


def part_summary(patches: DataFrame) -> DataFrame:
    """Per part: patches, positives, negatives, cameras.

    A first grouping by camera keeps the distinct count from sending all rows of a part to one task.
    """
    per_camera = patches.groupBy("part", "camera").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("label") == 1).alias("_p"))
    return per_camera.groupBy("part").agg(
        F.sum("_n").alias("n"), F.sum("_p").alias("positivos"),
        (F.sum("_n") - F.sum("_p")).alias("negativos"), F.count(F.lit(1)).alias("camaras"))


def dataset_document(patches: DataFrame) -> DataFrame:
    """The summary as one JSON document per part, with the fixed build parameters."""
    return part_summary(patches).select("part", F.to_json(F.struct(
        F.lit(C.WINDOW_PX).alias("ventana_px"), F.lit(C.PATCH_PX).alias("salida_px"),
        F.lit(C.SEED).alias("semilla"), F.lit(C.HELD_OUT_PARTNER).alias("partner_cruzado"),
        "n", "positivos", "negativos", "camaras")).alias("resumen"))


def build_counters(frames: DataFrame) -> DataFrame:
    """Counters of a dataset build from frames with `readable`, `boxes` and `negatives`."""
    ok = F.col("readable")
    smoke = ok & (F.size("boxes") > 0)
    clean = ok & (F.size("boxes") == 0)

    def total(cond, value):
        return F.sum(F.when(cond, value).otherwise(0))

    return frames.agg(
        F.count(F.lit(1)).alias("cuadros"), F.count_if(~ok).alias("ilegibles"),
        F.count_if(smoke).alias("cuadros_con_humo"), F.count_if(clean).alias("cuadros_sin_humo"),
        total(smoke, F.size("boxes") * C.CROPS_PER_BOX).alias("positivos"),
        total(smoke, F.size("negatives")).alias("neg_duros"),
        total(clean, F.size("negatives")).alias("neg_limpios"))


def most_common(df: DataFrame, column: str, n: int = 8) -> DataFrame:
    return (
        df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), column).limit(n))


def node_days(df: DataFrame) -> DataFrame:
    """Captures, alerts and inference time per node and date."""
    return df.groupBy("node_id", "date").agg(
        F.count(F.lit(1)).alias("captures"), F.count_if("alert").alias("alerts"),
        F.sum("tiles_total").alias("inferences"), F.sum("ms").alias("cpu_ms"))
