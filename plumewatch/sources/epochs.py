"""Training epochs as files: a trainer that reads them in the order of their names gets batch after batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumewatch import constants as C
from plumewatch.operators.sampling import epoch_order
from plumewatch.session import materialize

#: Batches of a file, about.
BATCHES = 4096
#: Files of an epoch whose files hold fewer batches than that.
FILES = 256


def write_epoch(df: DataFrame, path: str, index: str, epoch: int, seed: int = C.SEED, chunk: int = 8,
                batch: int = 64, batches: int = BATCHES) -> None:
    """Write the rows of an epoch in its order, with their `batch_id`.

    The order is that of `epoch_order`: blocks of neighbours permuted, index order inside a batch. Rows are dealt
    by range of batch ids and sorted inside, so a task holds about `batches` batches at a time and none is cut.

    A file is a task, and every task reports to the driver, as do the samples that ranges are found by. An epoch that
    would need more than `FILES` files of fewer than `BATCHES` batches has larger files, up to that many batches.
    """
    ordered = materialize(epoch_order(df, index, epoch, seed, chunk, batch), "epoch-order")
    last = ordered.agg(F.max("batch_id")).first()[0]
    files = n_files(1 + (last or 0), batches)
    ordered.repartitionByRange(files, "batch_id").sortWithinPartitions("batch_id", index).write.mode(
        "overwrite").parquet(path)


def n_files(held: int, batches: int = BATCHES) -> int:
    """Files for `held` batches."""
    fewest = -(-held // max(batches, BATCHES))
    return max(fewest, min(-(-held // batches), FILES))


def read_epoch(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a written epoch with `position`: their place when the files are read in the order of names.

    Rows are numbered inside each split; what stands before a split comes from one count for each split.
    """
    rows = spark.read.parquet(path).select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"))
    inside = W.partitionBy("_file", "_block").orderBy("_line")
    numbered = rows.withColumn("_n", F.row_number().over(inside))
    counts = numbered.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.select("_file", "_block", F.coalesce(F.sum("_rows").over(W.orderBy("_file", "_block").rowsBetween(
        W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return numbered.join(before, ["_file", "_block"]).withColumn("position", F.col("_before") + F.col("_n") - 1).drop(
        "_file", "_block", "_line", "_n", "_before")
