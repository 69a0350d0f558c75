"""Trees (path, hash) compared from the top: equal folders are settled by one digest and never opened.

A folder's digest is made of all files below it, whatever their order: exclusive ors of two hashes of (path, hash)
and the number of files. Such digests merge, so a tree is rolled up in one aggregate that combines inside each
task; no folder's files are gathered, and the root is one row for each task. A roll-up is stored with its tree once
and serves every later comparison.

A file whose hash is NULL has unknown content; folders with one are never settled. A repeated path counts once, by its
largest hash. A NULL path is a file of the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumewatch.operators.snapshots import tree_differences
from plumewatch.session import materialize

#: What must agree for a folder to be settled, and for the files that lie in the folder itself.
BELOW = ("files", "unknown", "h0", "h1")
OWN = ("own_files", "own_unknown", "own_h0", "own_h1")


def _names() -> Column:
    return F.split(F.coalesce("path", F.lit("")), "/")


def roll_up(tree: DataFrame) -> DataFrame:
    """One row for each folder, the root included: depth, folder, and digests of the files below and directly in it."""
    files = tree.groupBy("path").agg(F.max("hash").alias("hash"))
    deep = F.size("_names") - 1
    places = F.transform(F.sequence(F.lit(0), deep), lambda d: F.struct(
        d.alias("depth"), F.array_join(F.slice("_names", 1, d), "/").alias("folder"), (d == deep).alias("own")))
    each = files.select(
        F.col("hash").isNull().alias("_u"), F.xxhash64("path", "hash").alias("_h0"),
        F.xxhash64(F.lit(1), "path", "hash").alias("_h1"), _names().alias("_names")).select(
        "_u", "_h0", "_h1", F.inline_outer(places))

    def digests(names, only):
        mine = lambda c: F.when(only, c)
        return [F.count_if(only).alias(names[0]), F.count_if(only & F.col("_u")).alias(names[1]),
                F.coalesce(F.bit_xor(mine(F.col("_h0"))), F.lit(0)).alias(names[2]),
                F.coalesce(F.bit_xor(mine(F.col("_h1"))), F.lit(0)).alias(names[3])]

    return each.groupBy("depth", "folder").agg(*digests(BELOW, F.lit(True)), *digests(OWN, F.col("own")))


def compared_folders(a: DataFrame, b: DataFrame) -> DataFrame:
    """The folders of two roll-ups that a comparison from the top looks at.

    `opened` says that something below differs, `own_opened` that files in the folder itself may. Each level
    meets only children of folders opened before it, so the rows grow with the difference and not with the
    trees. One small table is written for each level that has an opened folder.
    """
    seen, depth, parents = None, 0, None

    def level(roll, side):
        rows = roll.where(F.col("depth") == depth)
        if parents is not None:
            up = F.array_join(F.slice(F.split("folder", "/"), 1, F.lit(depth - 1)), "/")
            rows = rows.withColumn("_up", up).join(parents, "_up", "left_semi").drop("_up")
        return rows.select("folder", F.struct(*BELOW).alias(f"{side}_all"), F.struct(*OWN).alias(f"{side}_own"))

    def differ(left, right, unknown):
        return ~F.col(left).eqNullSafe(F.col(right)) | (F.coalesce(F.col(f"{left}.{unknown}"), F.lit(0)) > 0)

    while True:
        now = materialize(level(a, "a").join(level(b, "b"), "folder", "full").select(
            F.lit(depth).alias("depth"), "folder", differ("a_all", "b_all", "unknown").alias("opened"),
            differ("a_own", "b_own", "own_unknown").alias("own_opened")), "compared-folders")
        seen = now if seen is None else seen.unionByName(now)
        parents = now.where("opened").select(F.col("folder").alias("_up"))
        if parents.isEmpty():
            return seen
        depth += 1


def opened_files(tree: DataFrame, compared: DataFrame) -> DataFrame:
    """The files of a tree that lie directly in folders which may differ."""
    where = compared.where("own_opened").select(F.col("depth").alias("_depth"), F.col("folder").alias("_folder"))
    names = _names()
    return tree.withColumn("_depth", F.size(names) - 1).withColumn(
        "_folder", F.array_join(F.slice(names, 1, F.size(names) - 1), "/")).join(
        where, ["_depth", "_folder"], "left_semi").select("path", "hash")


def folder_differences(a: DataFrame, b: DataFrame, rolled_a: DataFrame, rolled_b: DataFrame) -> DataFrame:
    """The rows of `tree_differences`; only files of folders with other digests are compared."""
    compared = compared_folders(rolled_a, rolled_b)
    return tree_differences(opened_files(a, compared), opened_files(b, compared))
