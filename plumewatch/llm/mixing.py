"""Mixing sources to target weights by capped water-filling.

The budget is shared by weight; a source whose share exceeds its most epochs is clamped there and the
rest is shared again among the others, until no share is too large. A source's target over its size is
then split into whole repetitions of every document and a fraction; the fraction is a seeded sample of
whole documents, drawn so that the source's words come within half a document of the target.

The draw of a document is a hash of seed, id and text, so reruns and other partitionings agree. The draw
up to which documents are taken is found from two histograms of 4,096 cells per source, the second one
inside the border cell of the first, and one exact look into the last cell, which holds one document in
16 million; no source is ever gathered or sorted whole.

Null texts have no words. Null is a source like others and comes last. Repeated rows have the same draw
and are taken together. Sources without words have target 0. A very long text is taken whole or
not at all and may leave its source half its length from the target. Ties of the draw are taken together. An
empty table gives an empty table; other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumewatch.llm.frames import WORD, documents, name, packed, store

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix has.
BUDGET = 1.5
#: Most repetitions of a source.
EPOCHS = 2
SEED = 20240611
#: Up to this many sources their table is sent to all tasks; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000
#: Bits of the draw that each of two histograms resolves.
CELL_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(row_id: Column, text: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), row_id, F.xxhash64(text))


def _level(sources: DataFrame, budget: float) -> float:
    """Words per unit of weight once all clamped sources are set aside.

    Each round is one small aggregation over the stored table of sources. The level only rises, and a
    clamped source stays clamped.
    """
    level = -1.0
    while True:
        clamped = F.col("most") <= F.lit(level) * F.col("weight")
        full, weight = sources.agg(
            F.sum(F.when(clamped, F.col("most")).otherwise(0)),
            F.sum(F.when(clamped, 0).otherwise(F.col("weight")))).first()
        if not weight:
            return level
        now = (budget - full) / weight
        if now <= level:
            return now
        over = sources.where(~clamped & (F.col("most") < F.lit(now) * F.col("weight"))).limit(1).count()
        level = now
        if not over:
            return level


def _cell(bits: int) -> Column:
    """The leading bits of a draw."""
    return F.shiftright("draw", 64 - bits)


def _border(sums: DataFrame, aims: DataFrame) -> DataFrame:
    """The cell of each source in which its fraction ends; `base` words come before all its cells."""
    upto = Window.partitionBy("source").orderBy("cell")
    before = F.col("base") + F.sum("words").over(upto) - F.col("words")
    return sums.withColumn("before", before).join(aims, F.col("source").eqNullSafe(F.col("aim"))).where(
        (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))).select(
        F.col("aim").alias("b_source"), F.col("cell").alias("b_cell"), "before", "rest")


def _within(rows: DataFrame, border: DataFrame, bits: int) -> DataFrame:
    return rows.join(border, F.col("source").eqNullSafe(F.col("b_source"))
                     & (_cell(bits) == F.col("b_cell")))


def plan(rows: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS,
         ) -> DataFrame:
    """Per source: source_size, target, whole repetitions and the last draw of the fraction.

    `rows` has source, size and draw and is read several times; it should be a stored table.
    """
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    # one short row per source
    sources, _ = store(rows.groupBy("source").agg(F.sum("size").alias("source_size")).select(
        "source", "source_size", (F.col("source_size") * epochs).alias("most"),
        F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int")).alias("weight")),
        "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = _level(sources, total * budget)
    target = F.when(F.col("most") <= F.lit(level) * F.col("weight"), F.col("most").cast("double")).otherwise(
        F.lit(level) * F.col("weight"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aims = sources.withColumn("target", target).withColumn("whole", whole.cast("long")).select(
        F.col("source").alias("aim"), "source_size", "target", "whole",
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))
    # the cell in which the fraction ends: first of 4,096 of a source, then of 4,096 of that cell
    border = _border(rows.groupBy("source", _cell(CELL_BITS).alias("cell")).agg(
        F.sum("size").alias("words"), F.lit(0).cast("long").alias("base")), aims.select("aim", "rest"))
    near = _within(rows, border, CELL_BITS)
    border = _border(near.groupBy("source", _cell(2 * CELL_BITS).alias("cell")).agg(
        F.sum("size").alias("words"), F.first("before").alias("base")), aims.select("aim", "rest"))
    inside = Window.partitionBy("b_source", "b_cell").orderBy("draw")
    last = _within(rows, border, 2 * CELL_BITS).withColumn(
        "middle", F.col("before") + F.sum("size").over(inside) - F.col("size") / 2)
    last = last.groupBy("b_source").agg(
        F.max(F.when(F.col("middle") <= F.col("rest"), F.col("draw"))).alias("inner"),
        F.min("b_cell").alias("b_cell")).select(
        "b_source", F.coalesce("inner", F.try_subtract(
            F.shiftleft("b_cell", 64 - 2 * CELL_BITS), F.lit(1))).alias("last_draw"))
    found, _ = store(aims.join(last, F.col("aim").eqNullSafe(F.col("b_source")), "left").select(
        "aim", "source_size", "target", "whole",
        # without a fraction nothing more is taken, not even documents without words
        F.when(F.col("rest") > 0, F.col("last_draw")).alias("last_draw")), "mix-plan")
    return found


def _small(found: DataFrame) -> DataFrame:
    return F.broadcast(found) if found.count() <= BROADCAST_SOURCES else found


def _repeats() -> Column:
    # no last draw: the fraction takes nothing
    extra = F.coalesce(F.col("draw") <= F.col("last_draw"), F.lit(False))
    return F.col("whole") + extra.cast("long")


def _narrow(df: DataFrame, text: str, row_id: str, source: str, seed: int) -> DataFrame:
    content = F.col(name(text))
    return df.select(
        F.col(name(row_id)).alias("doc_id"), F.col(name(source)).alias("source"),
        word_count(content).alias("size"), draw(F.col(name(row_id)), content, seed).alias("draw"))


def quotas(df: DataFrame, text: str = "text", row_id: str = "doc_id", source: str = "source",
           seed: int = SEED, **how) -> DataFrame:
    """doc_id, size, source_size, target and taken (words with repeats) of every row."""
    rows, _ = store(_narrow(df, text, row_id, source, seed), "mix-rows")
    found = _small(plan(rows, **how))
    return rows.join(found, F.col("source").eqNullSafe(F.col("aim"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _repeats()).alias("taken"))


def mix(df: DataFrame, text: str = "text", row_id: str = "doc_id", source: str = "source",
        seed: int = SEED, **how) -> DataFrame:
    """The mixed rows: each as often as the mix takes it, with its own columns.

    Only the table of sources is joined, so texts are not shuffled.
    """
    rows, _ = store(_narrow(df, text, row_id, source, seed), "mix-rows")
    found = _small(plan(rows.select("source", "size", "draw"), **how))
    return df.select(
        packed(df).alias("row"), F.col(name(source)).alias("source"),
        draw(F.col(name(row_id)), F.col(name(text)), seed).alias("draw")).join(
        found, F.col("source").eqNullSafe(F.col("aim"))).select(
        "row", F.explode(F.array_repeat(F.lit(True), _repeats().cast("int"))).alias("one")).select("row.*")


def op3_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotas(documents(spark, sf_dir).select("doc_id", "text", "source"))
