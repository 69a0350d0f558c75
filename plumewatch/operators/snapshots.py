"""Differences between keyed trees (path, hash)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumewatch.session import materialize

MISSING, EXTRA, DIFFERENT = "falta", "sobra", "distinto"


def tree_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths missing from b, only in b, or with other content.

    The full outer comparison is written as one aggregate over both trees: rows of a hot path
    collapse inside each task before the shuffle, which an outer join cannot do.
    """
    both = a.select("path", F.col("hash").alias("_a"), F.lit(None).cast("string").alias("_b")
                    ).unionByName(b.select("path", F.lit(None).cast("string").alias("_a"),
                                           F.col("hash").alias("_b")))
    merged = both.groupBy("path").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    kind = (
        F.when(F.col("_b").isNull(), MISSING).when(F.col("_a").isNull(), EXTRA)
        .when(F.col("_a") != F.col("_b"), DIFFERENT))
    return merged.select("path", kind.alias("problem")).where(F.col("problem").isNotNull())


def only_in_first(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("path").subtract(b.select("path"))


def one_sided(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths of exactly one tree with the side they are on ("a" or "b"): one aggregate, one scan each."""
    both = a.select("path", F.lit(1).alias("_side")).unionByName(b.select("path", F.lit(2).alias("_side")))
    seen = both.groupBy("path").agg(F.bit_or("_side").alias("_side")).where("_side < 3")
    return seen.select(F.when(F.col("_side") == 1, "a").otherwise("b").alias("side"), "path")


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("path").intersect(b.select("path"))


def fleet_verdict(copies: DataFrame, masters: DataFrame) -> DataFrame:
    """One row per copy of a library: counts of problems against its master.

    Missing files are counted, not listed, so no copy is multiplied by the files of its master.
    """
    sizes = masters.groupBy("library").agg(F.count(F.lit(1)).alias("_files"))
    known = masters.select("library", "path", F.col("hash").alias("_master"))
    found = copies.join(known, ["library", "path"], "left")
    per_copy = found.groupBy("copy_id", "library").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("_master").isNull()).alias("extra"),
        F.count_if(F.col("_master") != F.col("hash")).alias("different"))
    joined = per_copy.join(sizes, "library", "left")
    missing = F.coalesce(F.col("_files"), F.lit(0)) - (F.col("files") - F.col("extra"))
    orphan = F.col("_files").isNull()
    return joined.select(
        "copy_id", "library", "files", missing.alias("missing"), "extra", "different",
        F.when(orphan, "no master").when((missing + F.col("extra") + F.col("different")) == 0, "equal")
        .otherwise("differs").alias("verdict"))


def fleet_differences(copies: DataFrame, masters: DataFrame) -> DataFrame:
    """Every differing file of every copy that has a master.

    Extra and different files are found from the copies' own rows. Only copies that lack files are
    set against the files of their master. Libraries are few, so files are never dealt by them: what is known of
    libraries and copies is written, and Spark broadcasts it by its true size.
    """
    key = ["library", "path"]
    known = masters.select(*key, F.col("hash").alias("_master"))
    owned = materialize(masters.select("library").distinct(), "owned-libraries")
    kind = F.when(F.col("_master").isNull(), EXTRA).when(F.col("_master") != F.col("hash"), DIFFERENT)
    own = copies.join(owned, "library", "left_semi").join(known, key, "left").select(
        "copy_id", *key, kind.alias("problem")).where(F.col("problem").isNotNull())
    short = materialize(fleet_verdict(copies, masters).where(
        (F.col("verdict") == "differs") & (F.col("missing") > 0)).select("copy_id", "library"), "short-copies")
    absent = short.join(masters.select(*key), "library").join(
        copies.select("copy_id", *key), ["copy_id", *key], "left_anti")
    return own.unionByName(absent.select("copy_id", *key, F.lit(MISSING).alias("problem")))
