"""Detection rules reduced to one effective score per frame, and their leaderboard."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumewatch import constants as C
from plumewatch.operators.metrics import operating_point, sweep
from plumewatch.operators.timeline import confirmed_scores
from plumewatch.session import materialize

MAX_INT = 2**31 - 1


def tile_order() -> Column:
    """Score and tile in one number, of equal scores the lower tile above; NULL without a score.

    A struct as maximum would be found by sorting all tiles.
    """
    tile = F.coalesce(F.col("tile_id").cast("long"), F.lit(MAX_INT))
    return F.shiftleft(F.col("prob_x1000").cast("long"), 32) + (F.lit(MAX_INT) - tile)


def score_of(order: Column) -> Column:
    return F.shiftright(order, 32).cast("int")


def capture_result(tiles: DataFrame, threshold_x1000: int = C.ALERT_X1000,
                   min_tiles: int = C.MIN_TILES, keys: Sequence[str] = ("frame_id",)) -> DataFrame:
    """Tiles over threshold, best tile (first on ties, -1 if all are zero) and alert per frame.

    Optional tile columns: `error` marks tiles that could not be scored, which count only in the total;
    `ms_resample` and `ms_infer` are summed. `prob_x1000` and `tile_id` fit 32 bits; of equal tiles any one counts.
    """
    has = set(tiles.columns)
    scored = ~F.col("error") if "error" in has else F.lit(True)
    order = F.when(scored, tile_order())
    extra = [F.sum(c).alias(c) for c in ("ms_resample", "ms_infer") if c in has]
    extra += [F.bool_or("error").alias("error")] if "error" in has else []
    agg = tiles.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tiles_total"),
        F.count_if(scored & (F.col("prob_x1000") >= threshold_x1000)).alias("tiles_over"),
        score_of(F.max(order)).alias("_prob"),
        *[F.max_by(c, order).alias(f"_{c}") for c in ("x", "y")], *extra)
    some = F.col("_prob") > 0
    return agg.select(
        "frame_id", "tiles_total", "tiles_over",
        F.coalesce("_prob", F.lit(0)).alias("prob_max_x1000"),
        F.when(some, F.col("_x")).otherwise(-1).alias("x_max"),
        F.when(some, F.col("_y")).otherwise(-1).alias("y_max"),
        ((F.col("tiles_over") >= min_tiles) & F.lit(min_tiles > 0)).alias("alert"),
        *[c for c in ("ms_resample", "ms_infer", "error") if c in has])


def kth_scores(tiles: DataFrame, ks: Sequence[int] = (1, 2, 3), score: str = "score") -> DataFrame:
    """k-th largest tile score per frame; NULL if the frame has fewer tiles.

    Filtering on the rank lets every task drop all but max(ks) rows per frame before the shuffle. Before that sort, each
    Arrow batch drops the tiles that enough others of their frame in the same batch reach, so that a task sorts a few
    rows for each frame instead of all tiles where those of a frame stand near each other, and all of them at worst.
    """
    w = W.partitionBy("frame_id").orderBy(F.col(score).desc(), "tile_id")
    top = (
        _leading(tiles.select("frame_id", "tile_id", score), score, max(ks)).withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= max(ks)))
    return top.groupBy("frame_id").agg(
        *[F.max(F.when(F.col("_r") == k, F.col(score))).alias(f"top_{k}") for k in ks])


def _leading(tiles: DataFrame, score: str, k: int) -> DataFrame:
    """Rows of which the `k` largest scores of every frame are the same; of equal scores any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(score)
            if values.null_count or not pa.types.is_floating(values.type):
                yield batch  # Spark's order of these is left to Spark
                continue
            frame = batch.column("frame_id").dictionary_encode("encode").indices.to_numpy()
            order = np.lexsort((values.to_numpy(), frame))  # NaN last, as the largest
            last = np.searchsorted(frame[order], frame[order], side="right")
            yield batch.take(pa.array(np.sort(order[last - np.arange(len(order)) <= k])))

    return tiles.mapInArrow(run, tiles.schema)


def top_columns(scores: Column, ks: Sequence[int] = (1, 2, 3)) -> list[Column]:
    """k-th largest score of a frame that carries its tile scores as an array; NULL beyond its size."""
    best = F.slice(F.sort_array(scores, False), 1, max(ks))
    return [F.get(best, F.lit(k - 1)).alias(f"top_{k}") for k in ks]


RULE_CAPS = {
    "1_de_N": (0.10,),
    "2_de_N": (0.10, 0.01),
    "3_de_N": (0.10, 0.01),
    "temporal_2": (0.10,),
    "temporal_3": (0.10,),
}


def effective_scores(tiles: DataFrame, meta: DataFrame, ks: Sequence[int] = (1, 2, 3),
                     ns: Sequence[int] = (2, 3)) -> DataFrame:
    """Long table (frame_id, camera, smoke, rule, score): alert at t means score >= t.

    The per-frame scores are written once: they feed the per-camera history twice and are a small
    fraction of the tile table.
    """
    return _rule_scores(kth_scores(tiles, ks).join(
        meta.select("frame_id", "camera", "ts", "smoke"), "frame_id"), ks, ns)


def effective_scores_of_frames(frames: DataFrame, ks: Sequence[int] = (1, 2, 3),
                               ns: Sequence[int] = (2, 3), scores: str = "scores") -> DataFrame:
    """The same for frames that carry their tile scores as an array, as scoring emits them.

    The k-th scores are taken inside the row: no shuffle over tiles and no join with the captures.
    """
    return _rule_scores(frames.select(
        "frame_id", "camera", "ts", "smoke", *top_columns(F.col(scores), ks)), ks, ns)


def _rule_scores(frames: DataFrame, ks: Sequence[int], ns: Sequence[int]) -> DataFrame:
    frames = materialize(frames, "frame-scores")
    return by_rule(confirmed_scores(frames, ns, score="top_1"), ks, ns)


def by_rule(frames: DataFrame, ks: Sequence[int], ns: Sequence[int]) -> DataFrame:
    """One row per frame and rule, from frames with their k-th and confirmed scores."""
    rules = [F.struct(F.lit(f"{k}_de_N").alias("rule"), F.col(f"top_{k}").alias("score"))
             for k in ks]
    rules += [F.struct(F.lit(f"temporal_{n}").alias("rule"), F.col(f"confirmed_{n}").alias("score"))
              for n in ns]
    return frames.select("frame_id", "camera", "smoke", F.inline(F.array(*rules)))


def leaderboard(scores: DataFrame, grid: Sequence[float] = C.FRAME_GRID,
                caps: dict[str, Sequence[float]] = RULE_CAPS) -> DataFrame:
    """Best point of every rule under its false-positive caps; unreachable rules keep a row with
    NULL metrics."""
    return best_of_rules(sweep(scores, "score", "smoke", grid, ["rule"]), caps)


def best_of_rules(points: DataFrame, caps: dict[str, Sequence[float]] = RULE_CAPS) -> DataFrame:
    """The leaderboard from the swept points of all rules."""
    # one short literal row per rule and cap
    wanted = points.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cap"),
                 F.lit(f"{r}_fpr{c}" if len(caps[r]) > 1 else r).alias("regla"))
        for r in caps for c in caps[r]])))
    fitting = points.join(wanted, "rule").where(F.col("fpr") <= F.col("cap"))
    best = operating_point(fitting, ["regla"], fpr_max=1.0, fallback=False)
    return wanted.select("regla").join(
        best.select("regla", "umbral", "tp", "fp", "fn", "tn", "recall", "precision", "f1", "fpr"),
        "regla", "left")
