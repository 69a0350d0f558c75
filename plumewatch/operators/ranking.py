"""Exact ranks and running totals without a single-task sort.

A plain `row_number() over (partition by part order by score)` puts a whole part into one task. Here
rows are first reduced to distinct values, then a coarse monotone cell splits every group: cell
totals (a small table) give each cell its offset, and the fine window runs inside one cell.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumewatch.session import materialize

#: Cells for each power of two: of running totals, and of histograms that ranks are looked up in.
CELLS, COARSE = 2048, 64
_LARGEST = 1.7976931348623157e308


def value_cell(value: Column, cells: int = CELLS) -> Column:
    """Monotone cell of any number: its sign, power of two and leading bits.

    Cells are as fine near zero as elsewhere, so scores piled up at 1e-9 are spread like others.
    Infinity and NaN share the cell of the largest numbers.
    """
    # the logarithm is semi-monotonic, and so is its floor; 1,100 powers put the smallest number above 0
    size = F.floor(F.log2(F.least(F.abs(value), F.lit(_LARGEST))) * cells) + 1100 * cells
    return F.when(value == 0, 0).when(value > 0, size).when(value < 0, -size).cast("int")


def hex_cell(digest: Column) -> Column:
    """Monotone cell of a hex digest under text order."""
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")


def running_totals(df: DataFrame, keys: Sequence[str], cell: Column, order: Column,
                   values: Sequence[str], descending: bool = False) -> DataFrame:
    """Add `<v>_upto` (inclusive running sum) and `<v>_all` (group total) for each value column.

    `order` must be unique within `keys`; `cell` must be monotone in `order`.
    """
    keys = list(keys)
    df = df.withColumn("_cell", cell)

    def by(c):
        return F.col(c).desc() if descending else F.col(c).asc()

    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = group.orderBy(by("_cell")).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, "_cell").agg(*[F.sum(v).alias(f"_{v}") for v in values])
        .select(*keys, "_cell",
                *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}_off")
                  for v in values],
                *[F.sum(f"_{v}").over(group).alias(f"{v}_all") for v in values]))
    inside = W.partitionBy(*keys, "_cell").orderBy(
        order.desc() if descending else order.asc()).rowsBetween(W.unboundedPreceding, 0)
    local = df.select("*", *[F.sum(v).over(inside).alias(f"_{v}_run") for v in values])
    kept = [c for c in df.columns if c != "_cell"]
    return local.join(offsets, [*keys, "_cell"]).select(
        *kept,
        *[(F.col(f"_{v}_off") + F.col(f"_{v}_run")).alias(f"{v}_upto") for v in values],
        *[f"{v}_all" for v in values])


def at_ranks(df: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str], ranks: Sequence[Callable],
             cell: Column | None = None, descending: bool = False) -> tuple[DataFrame, DataFrame]:
    """Exact values at ranks by radix selection, without ordering all values.

    A histogram over coarse monotone cells finds the cell in which each rank falls; a second pass over the rows
    takes only those of these border cells apart. What is shuffled are histogram cells and the distinct values of
    border cells, however many distinct values there are.

    The first column of `sums` is the weight that ranks count, from 0; `ranks` are functions from its group total
    to a rank. Returns the histogram (keys, `_coarse`, `sums`), and for each rank number `_i` that exists the value
    and `<s>_upto`, the inclusive running sums.
    """
    keys = list(keys)
    base = df.withColumn("_coarse", value_cell(F.col(value), COARSE) if cell is None else cell)
    hist = materialize(base.groupBy(*keys, "_coarse").agg(*[F.sum(s).alias(s) for s in sums]), "rank-histogram")
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    place = F.col("_coarse").desc() if descending else F.col("_coarse").asc_nulls_last()
    before = group.orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    by = sums[0]
    placed = hist.select(
        *keys, "_coarse", by, *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_{s}_before") for s in sums],
        F.sum(by).over(group).alias("_all"))
    border = placed.select("*", F.posexplode(F.array(*[r(F.col("_all")).cast("bigint") for r in ranks])).alias(
        "_i", "_rank")).where((F.col("_rank") >= F.col(f"_{by}_before")) & (
            F.col("_rank") < F.col(f"_{by}_before") + F.col(by))).drop(by, "_all")
    border = materialize(border, "rank-borders")
    at = [*keys, "_coarse"]
    inside = materialize(base.join(border.select(*at).distinct(), at, "left_semi").groupBy(*at, value).agg(
        *[F.sum(s).alias(s) for s in sums]), "border-values")
    run = running_totals(inside, at, value_cell(F.col(value)) if cell is None else cell, F.col(value), sums, descending)
    upto = [(F.col(f"_{s}_before") + F.col(f"{s}_upto")).alias(f"{s}_upto") for s in sums]
    found = run.join(border, at).where(F.col(f"_{by}_before") + F.col(f"{by}_upto") > F.col("_rank")).select(
        *keys, "_i", value, *upto)
    first = F.max(value) if descending else F.min(value)
    return hist, found.groupBy(*keys, "_i").agg(first.alias(value), *[F.min(f"{s}_upto").alias(f"{s}_upto") for s in sums])


def lower_rank_percentiles(df: DataFrame, value: str, probs: Sequence[float],
                           keys: Sequence[str] = (), cell: Column | None = None) -> DataFrame:
    """Exact percentile as element int(p * (n - 1)) of the sorted values, per group."""
    keys = list(keys)
    held = df.where(F.col(value).isNotNull()).select(*keys, value, F.lit(1).alias("n"))

    def rank(p):
        return lambda total: F.lit(float(p)) * (total - 1)

    _, found = at_ranks(held, keys, value, ["n"], [rank(p) for p in probs], cell)
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_i") == i, F.col(value))).alias(f"p{round(p * 100)}") for i, p in enumerate(probs)])
