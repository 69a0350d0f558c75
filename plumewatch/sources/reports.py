"""Evaluation reports, training histories and file trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumewatch import schemas as S
from plumewatch.operators.segments import read_lines, with_record


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Training-history CSV files, one run per file.

    (`block`, `line`) is the order inside a file: a split is read from its first line to its last by
    one task, and splits are ordered by where they start.
    """
    return (
        spark.read.option("header", True).schema(S.HISTORY).csv(path)
        .select(*S.HISTORY.fieldNames(), F.col("_metadata.file_path").alias("run"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("line")))


def read_history_logs(spark: SparkSession, path: str) -> DataFrame:
    """Training logs in which a file may hold many runs, one after the other, each behind a header line.

    `run_no` counts the runs of a file from 0, wherever its splits begin; (`block`, `line`) is the order inside a
    file. A file without a header has one run of its own, with NULL as number.
    """
    names = S.HISTORY.fieldNames()
    header = F.regexp_replace("value", r'[\s"]', "") == ",".join(names)
    lines = with_record(read_lines(spark, path), header).where(~header & (F.trim("value") != ""))
    return lines.withColumn("_row", F.from_csv("value", S.HISTORY.simpleString()[7:-1].replace(":", " "))).select(
        "_row.*", "file", F.col("record_no").alias("run_no"), "block", "line")


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation reports flattened to one row per (model, part, precision kind, point)."""
    doc = spark.read.option("multiLine", True).schema(S.EVALUATION).json(path)
    parts = doc.select("modelo", F.explode("resultados").alias("part", "_kinds"))
    kinds = parts.select("modelo", "part", F.explode("_kinds").alias("precision_kind", "_points"))
    points = kinds.select(
        "modelo", "part", "precision_kind", F.explode("_points").alias("point", "_m"))
    return points.select("modelo", "part", "precision_kind", "point", "_m.*")


def write_report(df: DataFrame, path: str) -> None:
    """Report rows as JSON lines; reports are small, so they go to one file."""
    df.select(F.to_json(F.struct("*")).alias("value")).repartition(1).write.mode("overwrite").text(path)


def training_summary(history: DataFrame, run: str | Sequence[str] = "run", order: str | Sequence[str] = "line",
                     metric: str = "val_auc_pr", patience: int = 4) -> DataFrame:
    """Per run and phase: best epoch, and the epoch at which early stopping would end it.

    A phase starts when the epoch number does not grow. A training run has at most some hundred
    epochs, so one window per run stays small.
    """
    order = [order] if isinstance(order, str) else list(order)
    run = [run] if isinstance(run, str) else list(run)
    w = W.partitionBy(*run).orderBy(*order)
    restart = F.coalesce((F.lag("epoch").over(w) >= F.col("epoch")).cast("int"), F.lit(0))
    df = history.withColumn("_restart", restart).withColumn(
        "phase", F.sum("_restart").over(w.rowsBetween(W.unboundedPreceding, 0)) + 1)
    p = W.partitionBy(*run, "phase").orderBy(*order)
    before = F.max(metric).over(p.rowsBetween(W.unboundedPreceding, -1))
    df = df.withColumn("_better", before.isNull() | (F.col(metric) > before))
    last_better = F.max(F.when(F.col("_better"), F.col("epoch"))).over(
        p.rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumn("_stale", F.col("epoch") - last_better)
    return df.groupBy(*run, "phase").agg(
        F.max_by("epoch", F.struct(F.col(metric), -F.col("epoch"))).alias("best_epoch"),
        F.max(metric).alias("best"),
        F.min(F.when(F.col("_stale") >= patience, F.col("epoch"))).alias("stop_epoch"),
        F.count(F.lit(1)).alias("epochs"))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, hash) of every file below `root`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    # the first occurrence ends the root: names below it may repeat it
    base = root.rstrip("/") + "/"
    return files.select(
        F.substr("path", F.locate(base, F.col("path")) + F.lit(len(base))).alias("path"),
        F.sha2("content", 256).alias("hash"))
