"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumewatch.llm.frames import discard, store
from plumewatch.session import ship_package

#: Edges that a task reduces at a time.
EDGES = 2_000_000


def _thin(limit: int):
    """Stars with the components of the edges of a task, `limit` more at a time."""
    def run(batches):
        a = b = np.zeros(0, np.int64)
        left, right, size = [], [], 0

        def reduced():
            return forest(np.concatenate([a, *left]), np.concatenate([b, *right]))

        for batch in batches:
            left.append(batch.column(0).to_numpy(zero_copy_only=False))
            right.append(batch.column(1).to_numpy(zero_copy_only=False))
            size += batch.num_rows
            if size >= limit:
                a, b = reduced()
                left, right, size = [], [], 0
        a, b = reduced()
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

    return run


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """`node` and `root` (the smallest node of its component) of every node that has an edge.

    `edges` has long columns a and b. Each round points a node's larger, then its smaller neighbours at
    the smallest one; the number of rounds grows with the logarithm of a component. Minima are combined
    before the shuffle and neighbours are never gathered, so a hub costs no more than its edges. Before the
    first round the edges of each task, dealt by their larger node, are reduced to a forest: a node with many
    edges enters with about one. Rounds are written to the shared folder and the one before is removed.
    """
    spark = edges.sparkSession
    ship_package(spark)
    dealt = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    table, path = store(dealt.repartition("u").mapInArrow(_thin(EDGES), "u long, v long"), label)
    seen = None
    while True:
        both = table.unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).distinct()
        new, new_path = store(small, label)
        discard(spark, path)
        table, path = new, new_path
        count, mark = table.agg(F.count(F.lit(1)), F.sum(
            F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (count, mark) == seen:
            return table.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                table.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = (count, mark)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between two arrays of nodes reduced to stars with the same components."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            break
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    inner = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[inner], nodes[root[inner]]
