"""Exact dedup by content sort, in DataFrame operations only.

Sampled splitters range-partition the rows by the head of their normalised text and its SHA-256, which
keeps splitters short; Spark's external sort then places equal texts next to each other, and every row
is compared in full with its neighbour. A text that holds many rows is first cut into slices by row id;
the slices' representatives are sorted and compared once more. There are never more than `HOT_TEXTS`
such texts, whatever the input's size, so their table is a safe broadcast.

Null texts count as empty and equal each other. Of equal texts the row with the largest id stays; null
ids come after all others, and of rows that share the largest id exactly one stays. Very long texts are
hashed and compared whole. An empty table gives an empty table; other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumewatch.llm.frames import UPPER, documents, lowered, name, packed, store

#: Texts that may be cut into slices, at most; a slice holds about 1/HOT_TEXTS of all rows.
HOT_TEXTS = 20_000
#: Rows a text needs at least before it is cut.
SLICE_ROWS = 256
#: Characters of the text that lead the sort key.
HEAD = 12


def _hot(keyed: DataFrame) -> DataFrame:
    """Texts with too many rows for one task, and their number of slices."""
    rows = keyed.count()
    limit = max(SLICE_ROWS, -(-rows // HOT_TEXTS))
    return store(keyed.groupBy("sha").count().where(F.col("count") > limit).select(
        F.col("sha").alias("hot_sha"), F.ceil(F.col("count") / limit).cast("int").alias("slices")),
        "hot-texts")[0]


def _sliced(df: DataFrame, text: str, row_id: str) -> tuple[DataFrame, DataFrame]:
    """Rows as a struct `row` with their sort keys, and the table of large texts."""
    keyed = df.select(packed(df).alias("row"), F.col(name(row_id)).alias("id"),
                      lowered(F.col(name(text))).alias("norm")).select(
        "row", "id", F.substring("norm", 1, HEAD).alias("head"),
        F.sha2(F.col("norm").cast("binary"), 256).alias("sha"))
    hot = _hot(keyed.select("sha"))
    return keyed.join(F.broadcast(hot), F.col("sha") == F.col("hot_sha"), "left").select(
        "row", "id", "head", "sha", F.col("slices").isNotNull().alias("hot"),
        F.pmod(F.xxhash64("id"), F.coalesce("slices", F.lit(1))).cast("int").alias("slice")), hot


def _compared(sliced: DataFrame, text: str) -> DataFrame:
    """Sorted by content; `leads` marks rows that differ from the one before, `run` numbers them.

    The window needs no shuffle of its own: the range partitioning already keeps its keys together.
    The first of equal rows has the largest id.
    """
    placed = sliced.repartitionByRange("head", "sha", "slice").withColumn(
        "norm", lowered(F.col(f"row.{name(text)}")))
    near = Window.partitionBy("head", "sha", "slice").orderBy("norm", F.col("id").desc_nulls_last())
    return placed.withColumn(
        "leads", ~F.col("norm").eqNullSafe(F.lag("norm").over(near))).withColumn(
        "run", F.sum(F.col("leads").cast("int")).over(
            near.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def classes(df: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    run = Window.partitionBy("head", "sha", "slice", "run")
    narrow = df.select(F.col(name(row_id)).alias("doc_id"), F.col(name(text)).alias("text"))
    ranked = _compared(_sliced(narrow, "text", "doc_id")[0], "text").select(
        "id", "head", "sha", "slice", "run", "leads", "hot",
        F.when(F.col("leads") & F.col("hot"), F.col("norm")).alias("norm")).select(
        "*", F.max("id").over(run).alias("keep"), F.count(F.lit(1)).over(run).alias("size"))
    table, _ = store(ranked, "content-sort")
    # representatives of the slices of large groups, once more sorted and compared
    near = Window.partitionBy("head", "sha").orderBy("norm", F.col("id").desc_nulls_last(), "slice")
    again = table.where(F.col("hot") & F.col("leads")).withColumn(
        "leads", ~F.col("norm").eqNullSafe(F.lag("norm").over(near))).withColumn(
        "whole", F.sum(F.col("leads").cast("int")).over(
            near.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("norm")
    group = Window.partitionBy("head", "sha", "whole")
    merged = again.select(
        F.col("sha").alias("m_sha"), F.col("slice").alias("m_slice"), F.col("run").alias("m_run"),
        F.max("keep").over(group).alias("m_keep"), F.sum("size").over(group).alias("m_size"),
        F.col("leads").alias("m_leads"))
    cold = table.where(~F.col("hot")).select(
        "id", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"),
        F.col("leads").alias("kept"), "sha")
    hot = table.where("hot").join(
        merged, (F.col("sha") == F.col("m_sha")) & (F.col("slice") == F.col("m_slice"))
        & (F.col("run") == F.col("m_run"))).select(
        "id", F.col("m_keep").alias("keep_id"), F.col("m_size").alias("group_size"),
        (F.col("leads") & F.col("m_leads")).alias("kept"), "sha")
    return cold.unionByName(hot).withColumnsRenamed({"id": "doc_id", "sha": "text_sha256"})


def dedup(df: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """The rows that stay, with their own columns.

    Each slice keeps its first row; the few rows kept by the slices of a large text are compared again.
    """
    sliced, hot = _sliced(df, text, row_id)
    kept = _compared(sliced.where(~F.col("hot")), text).where("leads").select("row.*")
    if hot.isEmpty():
        return kept
    near = Window.partitionBy("head", "sha").orderBy("norm", F.col("id").desc_nulls_last())
    large = _compared(sliced.where("hot"), text).where("leads").withColumn(
        "leads", ~F.col("norm").eqNullSafe(F.lag("norm").over(near)))
    return kept.unionByName(large.where("leads").select("row.*"))


def op6_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir).select("doc_id", "text"))


OP6_SQL = f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
 doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS norm FROM documents)
WINDOW same AS (PARTITION BY norm)
"""
