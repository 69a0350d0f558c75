"""Embedding near-dedup by an exact metric range join.

Equal vectors are joined first. The others are scaled to length one, where cosine >= c is the same as a
distance of at most r = sqrt(2 - 2c). Pivots, a bounded sample, part the vectors into cells of the nearest
pivot. A vector x with nearest pivot p may have a partner in the cell of q only if

    d(x, q) <= d(x, p) + 2 r              (triangle inequality, twice)
    x.p - x.q <= r |p - q|                (the plane between p and q is within r)

so it is replicated to those cells alone, and only to cells of a higher number, which meets each pair of
cells once. Cells are joined independently, by matrix products in double precision. A cell of many
vectors is cut into chunks of about `CHUNK`; visitors go to each chunk. Degrees are summed up, links leave a
task as stars with the same components, never as pairs.

How much is replicated depends on the data: vectors in random directions of many dimensions are all
within reach of most planes, and then the join compares nearly all pairs, spread over cells and chunks.

Vectors that are null, empty, zero, or hold null, NaN or infinite components link with nothing. Vectors of
different length link with nothing either. Equal vectors link with each other. Repeated rows count as
vectors of their own; null ids are never the smallest. An empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumewatch.llm.frames import name, store
from plumewatch.llm.graph import components, forest
from plumewatch.session import ship_package

COSINE = 0.95
#: Vectors for each pivot, and most pivots.
PER_PIVOT, PIVOTS = 4096, 512
#: Vectors of a cell held by a task.
CHUNK = 2048
#: Visitors multiplied with them at a time.
BLOCK = 1024
#: Room for rounding in the bounds of replication; the comparison itself has none.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(flat: np.ndarray, size: int) -> np.ndarray:
    """Rows of length one; the largest component is divided out first, so that no square overflows."""
    rows = flat.reshape(-1, size)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


class Cells:
    """Nearest pivots and the cells that a vector has to visit."""

    def __init__(self, pivots: list[list[float]], radius: float):
        self.radius = radius
        self.by_size: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        first = 0
        for size in sorted({len(p) for p in pivots}):
            rows = units(np.array([p for p in pivots if len(p) == size], np.float64), size)
            gaps = np.sqrt(np.maximum(0, 2 - 2 * rows @ rows.T))
            self.by_size[size] = (first, rows, gaps)
            first += len(rows)

    def home(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell of each row, and (row, cell) of its visits. Lengths without a pivot form one cell each."""
        none = np.zeros(0, np.int64)
        if rows.shape[1] not in self.by_size:
            return np.full(len(rows), -rows.shape[1]), none, none
        first, pivots, gaps = self.by_size[rows.shape[1]]
        near = rows @ pivots.T
        own = near.argmax(axis=1)
        best = near[np.arange(len(rows)), own][:, None]
        away = np.sqrt(np.maximum(0, 2 - 2 * near))
        reach = (away <= np.sqrt(np.maximum(0, 2 - 2 * best)) + 2 * self.radius + SLACK) & (
            best - near <= self.radius * gaps[own] + SLACK)
        reach &= np.arange(len(pivots)) > own[:, None]
        row, cell = np.nonzero(reach)
        return own + first, row, cell + first


def _matrices(batch: pa.RecordBatch):
    """(places, unit rows) for each vector length in a batch whose column 0 is the vector."""
    column = batch.column(0)
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        yield places, units(flat[begins[places][:, None] + np.arange(size)], int(size))


def _counted(cells: Cells):
    def run(batches):
        for batch in batches:
            for _, rows in _matrices(batch):
                found, counts = np.unique(cells.home(rows)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts)], names=["cell", "n"])

    return run


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A hash of row numbers that spreads neighbours."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x >> np.uint64(33)


def _placed(cells: Cells, chunks: dict[int, int]):
    """Rows of (cell, chunk): homes with role 0 and visitors with role 1."""
    def run(batches):
        for batch in batches:
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            copies = batch.column(2).to_numpy(zero_copy_only=False)
            for places, rows in _matrices(batch):
                for at in range(0, len(rows), BLOCK):
                    yield from place(rows[at:at + BLOCK], ids[places[at:at + BLOCK]],
                                     copies[places[at:at + BLOCK]])

    def place(rows, ids, copies):
        own, row, cell = cells.home(rows)
        many = np.array([chunks[c] for c in own.tolist()], np.int64)
        chunk = (_mixed(ids) % many.astype(np.uint64)).astype(np.int64)
        every = np.arange(len(rows))

        def spread(row, cell, times):
            """Chunks 0 to times - 1 of each."""
            to = np.repeat(np.arange(len(row)), times)
            return row[to], cell[to], np.arange(len(to)) - np.repeat(np.cumsum(times) - times, times)

        groups = [(0, every, own, chunk), (1, *spread(every, own, chunk))]
        if len(row):
            groups.append((1, *spread(row, cell, np.array([chunks.get(c, 0) for c in cell.tolist()]))))
        for role, r, c, k in groups:
            for at in range(0, len(r), 4096):
                some = r[at:at + 4096]
                yield pa.RecordBatch.from_arrays([
                    pa.array(c[at:at + 4096], pa.int64()), pa.array(k[at:at + 4096], pa.int64()),
                    pa.array(np.full(len(some), role, np.int8)), pa.array(ids[some], pa.int64()),
                    pa.array(copies[some], pa.int64()),
                    pa.array([v.tobytes() for v in rows[some]], pa.binary())],
                    names=["cell", "chunk", "role", "rid", "copies", "unit"])

    return run


def _joined(cosine: float):
    """Degrees (b null) and stars (n null) of the links of each (cell, chunk)."""
    def run(batches):
        key, homes, ids, copies = None, None, None, None
        for batch in batches:
            cell = batch.column(0).to_numpy(zero_copy_only=False)
            chunk = batch.column(1).to_numpy(zero_copy_only=False)
            role = batch.column(2).to_numpy(zero_copy_only=False)
            if not len(cell):
                continue
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (chunk[1:] != chunk[:-1])
                                  | (role[1:] != role[:-1])) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)]):
                for at in range(low, high, BLOCK):
                    part = batch.slice(at, min(BLOCK, high - at))
                    rows = np.frombuffer(b"".join(part.column(5).to_pylist()), np.float64).reshape(
                        part.num_rows, -1)
                    own = part.column(3).to_numpy(zero_copy_only=False)
                    weight = part.column(4).to_numpy(zero_copy_only=False)
                    if key != (cell[low], chunk[low]):
                        key = (cell[low], chunk[low])
                        homes, ids, copies = rows[:0], own[:0], weight[:0]
                    yield from against(rows, own, weight, homes, ids, copies)
                    if role[low] == 0:
                        yield from against(rows, own, weight, rows, own, weight, True)
                        homes = np.concatenate([homes, rows])
                        ids, copies = np.concatenate([ids, own]), np.concatenate([copies, weight])

    def against(rows, own, weight, others, ids, copies, itself=False):
        if not len(others):
            return
        linked = rows @ others.T >= cosine
        if itself:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return
        degrees = [(own, linked @ copies)]
        if not itself:
            degrees.append((ids, weight @ linked))
        for who, n in degrees:
            some = n > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(who[some]), pa.nulls(int(some.sum()), pa.int64()),
                 pa.array(n[some].astype(np.int64))], names=["a", "b", "n"])
        x, y = np.nonzero(linked)
        a, b = forest(own[x], ids[y])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())],
                                         names=["a", "b", "n"])

    return run


def clusters(df: DataFrame, vector: str = "embedding", row_id: str = "vec_id", cosine: float = COSINE,
             ) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = df.sparkSession
    ship_package(spark)
    rows = df.select(F.col(name(row_id)).alias("vec_id"),
                     F.col(name(vector)).cast("array<double>").alias("vector"))
    distinct, _ = store(rows.where(usable(F.col("vector"))).groupBy("vector").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")).withColumn(
        "rid", F.monotonically_increasing_id()), "vectors")
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))
    wanted = min(PIVOTS, max(1, distinct.count() // PER_PIVOT))
    cells = Cells([r.vector for r in distinct.orderBy(F.xxhash64("vector"), "rid").select(
        "vector").limit(wanted).collect()], radius)
    # one row for each pivot, and for each length that has none
    counts = distinct.select("vector").mapInArrow(_counted(cells), "cell long, n long").groupBy(
        "cell").agg(F.sum("n").alias("n")).collect()
    chunks = {r.cell: -(-r.n // CHUNK) for r in counts}
    found, _ = store(distinct.select("vector", "rid", "copies").mapInArrow(
        _placed(cells, chunks), "cell long, chunk long, role byte, rid long, copies long, unit binary")
        .repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "role").mapInArrow(
        _joined(cosine), "a long, b long, n long"), "vector-links")
    degrees = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("degree"))
    linked = components(found.where("b IS NOT NULL").select("a", "b"), "vector-components")
    labelled = distinct.join(linked, F.col("rid") == F.col("node"), "left").select(
        "vector", "rid", "copies", "least", F.coalesce("root", "rid").alias("root"))
    lowest = labelled.groupBy("root").agg(F.min("least").alias("component"))
    classes = labelled.join(lowest, "root").join(degrees, F.col("rid") == F.col("a"), "left").select(
        F.col("vector").alias("c_vector"), "component",
        (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("links"))
    component = F.when(F.col("c_vector").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return rows.join(classes, F.col("vector") == F.col("c_vector"), "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op8_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet").select(
        "vec_id", "embedding"))
