"""Scans of annotated frames and the patch dataset."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumewatch import schemas as S
from plumewatch.functions.geometry import readable_image
from plumewatch.session import ship_package
from plumewatch.sources.footers import read_footers, short_shards

PNG_HEAD = "89504E470D0A1A0A"


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """All shards as one table; image bytes are read only if a query uses them.

    A shard that cannot be read stops the job.
    """
    return spark.read.schema(S.ANNOTATED_FRAME).parquet(path)


def read_frames_and_short_shards(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Frames of all readable parts, and the shards that gave fewer rows than their footers say, or have none.

    The second table has path, length, row_groups, rows, readable and rows_read. Shards go by their full path.
    """
    frames = spark.read.schema(S.ANNOTATED_FRAME).option("ignoreCorruptFiles", "true").parquet(path)
    return frames, short_shards(frames, read_footers(spark, path))


def _jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the frame header of a JPEG image, found by walking its segments."""
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            return None
        kind = data[at + 1]
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2  # fill byte, or a marker without length
            continue
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7:at + 9], "big"), int.from_bytes(data[at + 5:at + 7], "big")
        at += 2 + int.from_bytes(data[at + 2:at + 4], "big")
    return None


def with_frame_size(df: DataFrame, image: str = "image") -> DataFrame:
    """Add `width` and `height`, taken from the image's bytes where the row does not hold them.

    PNG sizes stand at a fixed place; JPEG headers are walked in Arrow batches. An image without a size
    in its bytes has NULL.
    """
    data = F.col(f"{image}.bytes")
    png = F.hex(F.substring(data, 1, 8)) == PNG_HEAD

    def png_number(start):
        return F.when(png, F.conv(F.hex(F.substring(data, start, 4)), 16, 10).cast("int"))

    @F.pandas_udf("width int, height int")
    def jpeg(column: pd.Series) -> pd.DataFrame:
        found = [_jpeg_size(bytes(v)) if v is not None and bytes(v[:2]) == b"\xff\xd8" else None
                 for v in column]
        return pd.DataFrame([f or (None, None) for f in found], columns=["width", "height"]).astype("Int32")

    ship_package(df.sparkSession)
    held = df.withColumn("_jpeg", jpeg(F.when(~png, data)))
    return held.withColumns({
        "width": F.coalesce(f"{image}.width", png_number(17), "_jpeg.width"),
        "height": F.coalesce(f"{image}.height", png_number(21), "_jpeg.height")}).drop("_jpeg")


def per_file_limit(df: DataFrame, file: str, order: str, n: int) -> DataFrame:
    """First `n` rows of every file. The rank filter trims each task before the shuffle."""
    w = W.partitionBy(file).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def split_readable(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable, quarantined) frames."""
    ok = readable_image(F.col("image.bytes"))
    return df.where(ok), df.where(~ok)


def write_patches(patches: DataFrame, path: str) -> None:
    """Patch dataset partitioned by part; label and camera stay in the row.

    Only three parts exist, so rows are not repartitioned by it: every task writes its own files.
    """
    patches.write.mode("overwrite").partitionBy("part").parquet(path)


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.PATCH).parquet(path)
