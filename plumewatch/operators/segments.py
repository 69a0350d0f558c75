"""Records of several lines in large text files: a segmented scan over file splits.

A record opens at some line and holds all lines up to the next opening one, in this split or in later ones.
Lines are numbered inside their split, so no window runs over a file: each split tells whether and where it
opens a record last, and how many it opens; what goes into a split comes from these summaries, one row for each
split of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PLACE = ("file", "block", "line")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where the split starts), line (a number that grows inside the split) and value."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value")


def with_record(lines: DataFrame, opens: Column) -> DataFrame:
    """Add `open_block` and `open_line`, the place of the line that opened the record, and `record_no`.

    Records of a file are numbered from 0. Lines before the first record of a file have NULL in all three.
    `lines` must have the columns of `read_lines` but for value; each split is read by one task.
    """
    inside = W.partitionBy("file", "block").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    rows = lines.withColumn("_opens", F.coalesce(opens, F.lit(False)))
    rows = rows.select("*", F.max(F.when(F.col("_opens"), F.col("line"))).over(inside).alias("_open"),
                       F.count_if("_opens").over(inside).alias("_no"))
    # the group has the distribution of the window above, so it adds no shuffle
    splits = rows.groupBy("file", "block").agg(F.max("_open").alias("_last"), F.max("_no").alias("_opened"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = splits.select(
        "file", "block",
        F.last(F.when(F.col("_last").isNotNull(), F.struct("block", "_last")), ignorenulls=True).over(before).alias(
            "_into"), F.coalesce(F.sum("_opened").over(before), F.lit(0)).alias("_before"))
    joined = rows.join(carried, ["file", "block"])
    own = F.col("_open").isNotNull()
    number = F.col("_before") + F.col("_no") - 1
    return joined.select(
        *lines.columns, F.when(own, F.col("block")).otherwise(F.col("_into.block")).alias("open_block"),
        F.coalesce("_open", "_into._last").alias("open_line"), F.when(number >= 0, number).alias("record_no"))
