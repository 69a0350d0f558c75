"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumewatch.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def name(column: str) -> str:
    """A column name in back quotes: dots and quotes in names are harmless."""
    return "`" + column.replace("`", "``") + "`"


def fresh(label: str) -> str:
    """A column name that no input has."""
    return f"__{label}_{uuid.uuid4().hex[:12]}"


def packed(df: DataFrame) -> Column:
    """The whole row as a struct, so that helper columns cannot clash with its names."""
    return F.struct(*[F.col(name(c)) for c in df.columns])


def lowered(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty. Pure ASCII rows take the quick built-in."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def store(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes a table to the shared folder and returns it with its path."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table that no plan reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
