"""Confusion metrics and the single-pass threshold sweep.

Every rule of the form "alert if score >= t" is evaluated at all thresholds with one scan: a score is
replaced by the number of grid thresholds it reaches, rows are counted per such level (partially in
each task), and a suffix sum over the few levels gives the counts at every threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumewatch import constants as C


def _truth(label: Column) -> Column:
    return label.cast("int") == 1


def confusion(df: DataFrame, score: str, label: str, thresholds: Sequence[float],
              keys: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn at a few given thresholds, one scan."""
    truth = _truth(F.col(label))
    aggs = []
    for i, t in enumerate(thresholds):
        hit = F.coalesce(F.col(score) >= F.lit(float(t)), F.lit(False))
        for name, cond in (("tp", hit & truth), ("fp", hit & ~truth),
                           ("fn", ~hit & truth), ("tn", ~hit & ~truth)):
            aggs.append(F.count_if(cond).alias(f"{name}_{i}"))
    wide = df.groupBy(*keys).agg(*aggs)
    points = F.array(*[
        F.struct(F.lit(float(t)).alias("umbral"),
                 *[F.col(f"{n}_{i}").alias(n) for n in ("tp", "fp", "fn", "tn")])
        for i, t in enumerate(thresholds)])
    return wide.select(*keys, F.inline(points))


def with_rates(df: DataFrame) -> DataFrame:
    """recall, precision, f1, fpr and exactitud, four decimals, guarded denominators."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall = tp / F.greatest(F.lit(1), tp + fn)
    precision = tp / F.greatest(F.lit(1), tp + fp)
    f1 = 2 * precision * recall / F.greatest(F.lit(1e-9), precision + recall)
    fpr = fp / F.greatest(F.lit(1), fp + tn)
    right = (tp + tn) / F.greatest(F.lit(1), tp + fp + fn + tn)
    return df.select(
        "*", F.round(recall, 4).alias("recall"), F.round(precision, 4).alias("precision"),
        F.round(f1, 4).alias("f1"), F.round(fpr, 4).alias("fpr"),
        F.round(right, 4).alias("exactitud"))


def level(score: Column, grid: Sequence[float]) -> Column:
    """Number of thresholds of an evenly spaced ascending grid that the score reaches.

    The arithmetic guess can be off by one through rounding, so it is settled against the grid's own
    numbers.
    """
    n, first = len(grid), float(grid[0])
    step = (float(grid[-1]) - first) / (n - 1)
    known = F.array(*[F.lit(float(t)) for t in grid])
    guess = F.greatest(F.lit(0), F.least(
        F.lit(n), F.floor((score - F.lit(first)) / F.lit(step)) + 1)).cast("int")
    up = (guess < n) & (score >= F.element_at(known, F.least(guess + 1, F.lit(n))))
    down = (guess > 0) & (score < F.element_at(known, F.greatest(guess, F.lit(1))))
    return F.when(score.isNull(), 0).when(up, guess + 1).when(down, guess - 1).otherwise(guess)


def sweep(df: DataFrame, score: str, label: str, grid: Sequence[float],
          keys: Sequence[str] = ()) -> DataFrame:
    """Confusion metrics at every grid threshold, per key."""
    return swept(level_counts(df, score, label, grid, keys), grid, keys)


def level_counts(df: DataFrame, score: str, label: str, grid: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives of each level: a summary that adds up over any parts of the rows."""
    keys = list(keys)
    return (
        df.select(*keys, level(F.col(score), grid).alias("_level"), _truth(F.col(label)).alias("_truth"))
        .groupBy(*keys, "_level")
        .agg(F.count_if(F.col("_truth")).alias("_p"), F.count_if(~F.col("_truth")).alias("_n")))


def swept(levels: DataFrame, grid: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Confusion metrics at every grid threshold from the counts of levels, per key."""
    keys = list(keys)
    n = len(grid)
    # at most n + 1 levels per key are gathered here
    packed = levels.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_level", F.struct("_p", "_n")))).alias("_m"))
    dense = packed.select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(n))).alias("_level"), "_m").select(
        *keys, "_level",
        F.coalesce(F.try_element_at("_m", "_level")["_p"], F.lit(0)).alias("_p"),
        F.coalesce(F.try_element_at("_m", "_level")["_n"], F.lit(0)).alias("_n"))
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    reach = group.orderBy(F.col("_level").desc()).rowsBetween(W.unboundedPreceding, 0)
    known = F.array(*[F.lit(float(t)) for t in grid])
    counts = dense.select(
        *keys, "_level",
        F.sum("_p").over(reach).alias("tp"), F.sum("_n").over(reach).alias("fp"),
        F.sum("_p").over(group).alias("_all_p"), F.sum("_n").over(group).alias("_all_n"))
    counts = counts.where("_level > 0").select(
        *keys, F.element_at(known, F.col("_level")).alias("umbral"), "tp", "fp",
        (F.col("_all_p") - F.col("tp")).alias("fn"), (F.col("_all_n") - F.col("fp")).alias("tn"))
    return with_rates(counts)


def operating_point(points: DataFrame, keys: Sequence[str] = (), fpr_max: float = C.GOALS["fpr"],
                    fallback: bool = True) -> DataFrame:
    """Best threshold per key: highest recall among those whose rounded FPR is allowed, the lowest
    threshold on ties. Without any allowed one, the best F1 (`fallback`) or no row."""
    ok = F.col("fpr") <= fpr_max
    if not fallback:
        points = points.where(ok)
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    order = group.orderBy(
        ok.desc(), F.when(ok, F.col("recall")).otherwise(F.col("f1")).desc(), F.col("umbral"))
    return points.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def verdict(df: DataFrame, goals: dict[str, float] = C.GOALS) -> DataFrame:
    """CUMPLE, or the list of missed goals; fpr is an upper bound."""
    missed = F.array_compact(F.array(*[
        F.when(F.col(k) > g if k == "fpr" else F.col(k) < g, F.lit(k)) for k, g in goals.items()]))
    return df.withColumn("veredicto", F.when(F.size(missed) == 0, "CUMPLE").otherwise(
        F.concat(F.lit("NO CUMPLE: "), F.array_join(missed, ", "))))


def compare_precisions(metrics: DataFrame, keys: Sequence[str], first: str = "float32",
                       second: str = "int8", kind: str = "precision_kind") -> DataFrame:
    """Loss of the second number format against the first, per key (metric rows are few)."""
    def side(name):
        return metrics.where(F.col(kind) == name).select(
            *keys, F.col("umbral").alias(f"umbral_{name}"), F.col("f1").alias(f"f1_{name}"))

    return side(first).join(side(second), list(keys)).withColumn(
        "f1_loss", F.round(F.col(f"f1_{second}") - F.col(f"f1_{first}"), 4))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(0)))
    return counts.select(label, "n", F.round(total / (2 * F.col("n")), 4).alias("weight"))


def fpr_by_provenance(df: DataFrame, score: str, source: str, thresholds: Sequence[float],
                      hard: str = C.HARD, clean: str = C.CLEAN) -> DataFrame:
    """Share of hard and of clean negatives over each threshold, and their ratio."""
    aggs = [F.count_if(F.col(source) == s).alias(f"n_{s}") for s in (hard, clean)]
    for i, t in enumerate(thresholds):
        for s in (hard, clean):
            aggs.append(F.count_if((F.col(source) == s) & (F.col(score) >= float(t)))
                        .alias(f"{s}_{i}"))
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(
        F.lit(float(t)).alias("umbral"),
        (F.col(f"{hard}_{i}") / F.greatest(F.lit(1), F.col(f"n_{hard}"))).alias("fd"),
        (F.col(f"{clean}_{i}") / F.greatest(F.lit(1), F.col(f"n_{clean}"))).alias("fl"))
        for i, t in enumerate(thresholds)])
    return wide.select(f"n_{hard}", f"n_{clean}", F.inline(rows)).select(
        "umbral", F.round("fd", 4).alias(f"fpr_{hard}"), F.round("fl", 4).alias(f"fpr_{clean}"),
        F.round(F.col("fd") / F.greatest(F.col("fl"), F.lit(1e-6)), 4).alias("ratio"),
        f"n_{hard}", f"n_{clean}")
