"""A leaderboard of detection rules that is kept up to date as frames come in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumewatch import constants as C
from plumewatch.operators.metrics import level_counts, swept
from plumewatch.operators.rules import RULE_CAPS, best_of_rules, by_rule, top_columns
from plumewatch.session import remove, scratch_path
from plumewatch.streaming.state import confirmed_stream


def leaderboard_stream(frames: DataFrame, ks: Sequence[int] = (1, 2, 3), ns: Sequence[int] = (2, 3),
                       grid: Sequence[float] = C.FRAME_GRID, caps: dict[str, Sequence[float]] = RULE_CAPS,
                       scores: str = "scores", folder: str | None = None) -> DataFrame:
    """The rule leaderboard after everything available, from a stream of frames that carry their tile scores.

    Counts of levels, at most one for each grid threshold and rule, are the whole state of the sweep. A batch adds
    the levels of the rows it works out and takes off those that they replace, because a late frame changes what its
    camera's next frames confirm. The counts before a batch are kept, so a replayed batch adds them to the same
    state again. A later call with the same folder goes on where this one stopped.
    """
    spark = frames.sparkSession
    folder = folder or scratch_path(spark, "leaderboard")
    kept = f"{folder}/levels"
    rows = frames.select("frame_id", "camera", "ts", "smoke", *top_columns(F.col(scores), ks))

    def counted(rows: DataFrame, sign: int) -> DataFrame:
        counts = level_counts(by_rule(rows, ks, ns), "score", "smoke", grid, ["rule"])
        return counts.select("rule", "_level", (F.col("_p") * sign).alias("_p"), (F.col("_n") * sign).alias("_n"))

    def replaced(new: DataFrame | None, old: DataFrame | None, batch_id: int) -> None:
        parts = [] if new is None else [counted(new, 1)]
        parts += [] if old is None else [counted(old, -1)]
        if batch_id:
            parts.append(spark.read.parquet(f"{kept}/v{batch_id - 1}"))
        if not parts:
            parts = [spark.createDataFrame([], "rule string, _level int, _p long, _n long")]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        every.groupBy("rule", "_level").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n")).where(
            "_p <> 0 or _n <> 0").write.mode("overwrite").parquet(f"{kept}/v{batch_id}")
        spark.createDataFrame([(batch_id,)], "batch long").write.mode("overwrite").parquet(f"{folder}/newest")
        if batch_id > 1:
            remove(spark, f"{kept}/v{batch_id - 2}")

    confirmed_stream(rows, ns, score="top_1", folder=folder, replaced=replaced)
    newest = spark.read.parquet(f"{folder}/newest").first()[0]
    return best_of_rules(swept(spark.read.parquet(f"{kept}/v{newest}"), grid, ["rule"]), caps)
