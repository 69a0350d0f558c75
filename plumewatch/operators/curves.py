"""Operating curves over exact scores, without sorting a part in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumewatch import constants as C
from plumewatch.functions import scoring
from plumewatch.operators.ranking import COARSE, at_ranks, running_totals, value_cell


def score_curve(df: DataFrame, score: str, label: str, keys: Sequence[str]) -> DataFrame:
    """Positives and negatives at or above every distinct score."""
    counts = df.groupBy(*keys, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    return running_totals(counts, keys, value_cell(F.col(score)), F.col(score), ["pos", "neg"],
                          descending=True)


def curve_points(df: DataFrame, score: str, label: str, keys: Sequence[str],
                 fprs: Sequence[float] = C.CURVE_FPRS) -> DataFrame:
    """Threshold and recall for target false-positive rates.

    The threshold is element int(f * n) of the descending negative scores, 1.0 when there is no such
    element; recall is the share of positives at or above it.
    """
    own, keys = list(keys), [*keys] or ["_one"]
    df = df if own else df.withColumn("_one", F.lit(1))

    def counted(wanted):
        return F.coalesce(F.col(label) == wanted, F.lit(False)).cast("int")

    held = df.select(*keys, score, counted(0).alias("neg"), counted(1).alias("pos"))

    def rank(f):
        return lambda total: F.lit(float(f)) * total

    hist, found = at_ranks(held, keys, score, ["neg", "pos"], [rank(f) for f in fprs], descending=True)
    # the cell of 1.0 begins there
    at_one = F.col("_coarse") >= value_cell(F.lit(1.0), COARSE)
    totals = hist.groupBy(*keys).agg(
        F.sum("pos").alias("pos_all"), F.coalesce(F.sum(F.when(at_one, F.col("pos"))), F.lit(0)).alias("pos_at_one"))
    thresholds = found.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_i") == i, F.col(c))).alias(f"{t}_{i}")
        for i in range(len(fprs)) for t, c in (("t", score), ("p", "pos_upto"))])
    wide = totals.join(thresholds, keys, "left")
    rows = F.array(*[F.struct(
        F.lit(float(f)).alias("fpr_target"),
        F.coalesce(F.col(f"t_{i}"), F.lit(1.0)).alias("umbral"),
        (F.coalesce(F.col(f"p_{i}"), F.col("pos_at_one")) / F.greatest(F.lit(1), F.col("pos_all")))
        .alias("recall")) for i, f in enumerate(fprs)])
    return wide.select(*own, F.inline(rows)).select(
        *own, "fpr_target", F.round("umbral", 4).alias("umbral"),
        F.round("recall", 4).alias("recall"))


def average_precision(df: DataFrame, score: str, label: str, keys: Sequence[str]) -> DataFrame:
    """Step-wise area under the precision-recall curve."""
    curve = score_curve(df, score, label, keys)
    step = F.col("pos") * F.col("pos_upto") / (F.col("pos_upto") + F.col("neg_upto"))
    return curve.groupBy(*keys).agg(
        F.round(F.sum(step) / F.greatest(F.lit(1), F.max("pos_all")), 6).alias("auc_pr"),
        F.max("pos_all").alias("positives"), F.max("neg_all").alias("negatives"))


def detection_delay(points: DataFrame, captures: Sequence[int] = C.DETECTION_CAPTURES,
                    n_tiles: int = C.CLEAN_TILES, per_day: int = C.CAPTURES_PER_DAY,
                    cadence_min: int = C.CADENCE_MIN) -> DataFrame:
    """Chance of detection after M captures, with the false alarms that threshold costs."""
    fpr = scoring.capture_fpr(F.col("fpr_target"), n_tiles)
    return (
        points.withColumn("capture_fpr", F.round(fpr, 4))
        .withColumn("false_per_day", F.round(scoring.false_alarms_per_day(fpr, per_day), 4))
        .withColumn("captures", F.explode(F.array(*[F.lit(m) for m in captures])))
        .withColumn("minutes", F.col("captures") * cadence_min)
        .withColumn("detected", F.round(
            scoring.detected_within(F.col("recall"), F.col("captures")), 4)))
