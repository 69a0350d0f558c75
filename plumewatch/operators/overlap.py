"""Window and box joins.

Frames usually hold a few boxes, and then `frame_id` is a good join key. A frame with very many boxes
would be a hot key with every pair inside it, so frames are treated by their number of boxes:

* more than `dense_rows`: both sides are cut into a spatial grid and meet on (frame, cell). A pair that
  shares several cells is kept only in the cell where its intersection starts. The grid's lines are the frame's
  own: percentiles of where its boxes start, so that cells hold about as many boxes wherever these lie, and no
  two lines within `CELL_PX`, so that boxes on one spot do not fall into many cells each.
* more than `hot_rows`: in addition, boxes are dealt to several salts, to each of which the windows of
  that frame are repeated.

Both sides come out of generators, whose size Spark takes for that of their input. The join of the sides is therefore
told to sort and merge: on the estimate a few million windows would be sent through the driver as a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumewatch.functions.geometry import covered_share, meets
from plumewatch.session import materialize

CELL_PX = 160
#: Cells along an axis. The first and the last one have no outer end.
GRID = 64
DENSE_ROWS = 200
HOT_ROWS = 1_000_000
WHOLE = -1_000_000_000
EDGES = ("x0", "y0", "x1", "y1")
KEY = ("frame_id", "_salt", "_cx", "_cy")


def _lines(edge: str) -> Column:
    """Grid lines of an axis: multiples of the cell width, at most GRID - 1 of them. Percentile sketches merge."""
    shares = F.array(*[F.lit(k / GRID) for k in range(1, GRID)])
    found = F.percentile_approx(F.col(edge).cast("double"), shares, 10 * GRID)
    lines = F.array_distinct(F.transform(found, lambda x: x - F.pmod(x, F.lit(float(CELL_PX)))))
    return F.coalesce(lines, F.array().cast("array<double>"))


def _cell(edge: str, lines: str) -> str:
    """The number of lines up to an edge, which keeps order and so the meeting of rectangles."""
    return f"size(filter({lines}, l -> l <= {edge}))"


def _sides(windows: DataFrame, boxes: DataFrame, dense_rows: int,
           hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both inputs with their rectangle packed and a place (salt, cell) to meet in.

    A row of an ordinary frame has one place, the whole frame. The table of dense frames is written,
    so Spark knows its true size when it decides whether to broadcast it.
    """
    dense = materialize(
        boxes.groupBy("frame_id").agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > dense_rows)
        .select("frame_id", F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts")),
        "dense-frames")
    # the lines of dense frames alone: ordinary ones need no sketch
    dense = materialize(boxes.join(dense, "frame_id").groupBy("frame_id", "_salts").agg(
        _lines("x0").alias("_xs"), _lines("y0").alias("_ys")), "dense-grids")

    def places(name, salts):
        def cells(low, high, lines):
            first, last = _cell(f"{name}.{low}", lines), _cell(f"{name}.{high}", lines)
            return f"sequence({first}, greatest({first}, {last}))"

        # a rectangle with a NULL edge meets nothing, so any place will do
        gap = " OR ".join(f"{name}.{c} IS NULL" for c in EDGES)
        return F.expr(
            f"if(_salts IS NULL OR {gap}, array(struct(0 AS s, {WHOLE} AS cx, {WHOLE} AS cy, {WHOLE} AS fx, {WHOLE} AS fy)), "
            f"flatten(transform({salts}, s -> flatten(transform({cells('x0', 'x1', '_xs')}, cx -> "
            f"transform({cells('y0', 'y1', '_ys')}, cy -> struct(s, cx, cy, "
            f"{_cell(f'{name}.x0', '_xs')} AS fx, {_cell(f'{name}.y0', '_ys')} AS fy)))))))")

    def packed(df, name, salts):
        keep = [c for c in df.columns if c not in EDGES]
        df = df.select(*keep, F.struct(*EDGES).alias(name)).join(dense, "frame_id", "left")
        # outer: an inner generator would add a size filter that computes the places twice
        df = df.select(*keep, name, places(name, salts).alias("_all"))
        return df.select(
            *keep, name, F.size("_all").alias("_places"),
            F.inline_outer("_all").alias("_salt", "_cx", "_cy", f"_{name}_x", f"_{name}_y"))

    return (packed(windows, "win", "sequence(0, _salts - 1)"),
            packed(boxes, "box", "array(int(pmod(xxhash64(box), _salts)))"))


def overlapping_pairs(windows: DataFrame, boxes: DataFrame, threshold: float = 0.0,
                      dense_rows: int = DENSE_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs of one frame whose window covers more than `threshold` of the box.

    Both inputs have `frame_id` and the edges x0, y0, x1, y1; other column names must differ. Edges of rectangles
    whose area passes 32 bits must be bigint or double.
    """
    w, b = _sides(windows, boxes, dense_rows, hot_rows)
    w, b = w.drop("_places"), b.drop("_places")
    win, box = F.col("win"), F.col("box")
    # cells keep order: an intersection starts in the later of both first cells
    first_cell = (F.col("_cx") == F.greatest("_win_x", "_box_x")) & (F.col("_cy") == F.greatest("_win_y", "_box_y"))
    return (
        w.hint("merge").join(b, list(KEY)).where(meets(win, box) & first_cell)
        .withColumn("share", covered_share(win, box))
        .where(F.col("share") > threshold)
        .drop("_cx", "_cy", "_salt", "_win_x", "_win_y", "_box_x", "_box_y"))


def untouched_windows(windows: DataFrame, boxes: DataFrame, key: str = "window_id",
                      dense_rows: int = DENSE_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Windows that touch no box of their frame; the pairs themselves are never emitted.

    Windows that share frame and `key` are judged one by one.
    """
    tagged = windows.withColumn("_row", F.monotonically_increasing_id())
    w, b = _sides(tagged, boxes, dense_rows, hot_rows)
    w, b = w.hint("merge").alias("w"), b.alias("b")
    same = meets(F.col("w.win"), F.col("b.box"))
    for c in KEY:
        same = same & (F.col(f"w.{c}") == F.col(f"b.{c}"))
    # a window is free if it survives in every place it was sent to
    others = [c for c in windows.columns if c not in EDGES]
    free = w.join(b, same, "left_anti").groupBy("_row").agg(
        F.count(F.lit(1)).alias("_left"), F.any_value("_places").alias("_places"),
        *[F.any_value(f"win.{c}").alias(c) for c in EDGES],
        *[F.any_value(c).alias(c) for c in others])
    return free.where("_left = _places").select(*windows.columns)


def negative_provenance(frames: DataFrame, boxes: DataFrame, hard: str, clean: str) -> DataFrame:
    """Frames labelled by whether any box belongs to them; boxes collapse before the shuffle."""
    marked = boxes.select("frame_id").distinct().withColumn("_has", F.lit(True))
    return (
        frames.join(marked, "frame_id", "left")
        .withColumn("source", F.when(F.col("_has"), hard).otherwise(clean)).drop("_has"))
