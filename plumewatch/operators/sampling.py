"""Patch construction and samplers, reproducible under any partitioning."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumewatch import constants as C
from plumewatch.functions.geometry import box_struct, jitter_draws, split_part, window_around
from plumewatch.functions.hashing import TWO_32, between, digest, unit
from plumewatch.operators.ranking import hex_cell, running_totals
from plumewatch.session import ship_package

EDGES = ("x0", "y0", "x1", "y1")
#: Pairs of a window and a box that are compared at a time.
PAIRS = 1 << 20


def each(df: DataFrame, array: str, index: str, item: str) -> DataFrame:
    """One row per array element, with its index.

    The outer generator keeps the optimizer from adding a `size(array) > 0` filter: pushed below the
    projections that build the array, that filter would compute it a second time.
    """
    return df.select("*", F.posexplode_outer(array).alias(index, item)).where(
        F.col(index).isNotNull())


def place_windows(df: DataFrame, seed: int = C.SEED) -> DataFrame:
    """Add `win`, the window around `box`: centred for crop 0, jittered for the others.

    Same result as the expression for one window, but side, shift and corner are columns of their
    own, so none of them is computed more than once per row.
    """
    box = F.col("box")
    w, h = box.x1 - box.x0, box.y1 - box.y0
    side = F.least(
        F.greatest(F.lit(float(C.WINDOW_PX)), w * C.BOX_MARGIN, h * C.BOX_MARGIN),
        F.col("height").cast("double"))
    centred = F.col("crop") == 0

    def centre(low, high, extent, slot):
        slack = F.greatest(F.lit(0.0), (F.col("_side") - extent) / 2 * C.JITTER_SHARE)
        shift = between(unit(F.col("_h"), slot), -slack, slack)
        return (low + high) / 2 + F.when(centred, F.lit(0.0)).otherwise(shift)

    def corner(middle, length):
        free = F.col(length) - F.col("_side")
        return F.least(F.greatest(F.col(middle) - F.col("_side") / 2, F.lit(0.0)), free)

    x, y, s = F.col("_x"), F.col("_y"), F.col("_side")
    return (
        df.withColumn("_side", side)
        .withColumn("_h", F.when(~centred, digest(seed, "jitter", F.col("frame_id"), F.col("item"))))
        .withColumns({"_cx": centre(box.x0, box.x1, w, 0), "_cy": centre(box.y0, box.y1, h, 1)})
        .withColumns({"_x": corner("_cx", "width"), "_y": corner("_cy", "height")})
        .withColumn("win", box_struct(x, y, x + s, y + s))
        .drop("_side", "_h", "_cx", "_cy", "_x", "_y"))


def box_windows(df: DataFrame, seed: int = C.SEED) -> DataFrame:
    """Two windows per box: centred, then jittered. Needs boxes, width and height columns."""
    crops = each(df, "boxes", "item", "box").withColumn(
        "crop", F.explode(F.sequence(F.lit(0), F.lit(C.CROPS_PER_BOX - 1))))
    return place_windows(crops, seed)


def negative_quota(boxes: Column) -> Column:
    return F.when(F.size(boxes) > 0, C.NEGATIVES_SMOKE_FRAME).otherwise(C.NEGATIVES_CLEAN_FRAME)


def _drawn_windows(heads: list[bytes], attempts: np.ndarray, width: np.ndarray,
                   height: np.ndarray) -> np.ndarray:
    """Edges of the windows of `geometry.random_windows`, one row for each digest head and attempt number."""
    low, high = C.NEGATIVE_SIDE
    digests = b"".join([md5(b"%b:%d" % key).digest() for key in zip(heads, attempts.tolist())])
    draws = np.frombuffer(digests, ">u4").reshape(-1, 4)[:, :3] / TWO_32
    # without a height the side has no bound, as in SQL
    side = np.fmin((low + draws[:, 0] * (high - low)) * C.WINDOW_PX, height)
    x, y = draws[:, 1] * (width - side), draws[:, 2] * (height - side)
    return np.stack([x, y, x + side, y + side])


def _touched(windows: np.ndarray, boxes: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which windows share area with one of their `count` boxes from `first` on, or may do: an edge is missing."""
    touched = np.zeros(len(count), bool)
    upto = np.cumsum(count)
    # windows in a row with about PAIRS boxes, then those boxes in slices, so that crowded frames stay bounded
    cuts = np.flatnonzero(np.diff((upto - count) // PAIRS)) + 1
    for part in np.split(np.arange(len(count)), cuts):
        begin = upto[part[0]] - count[part[0]] if len(part) else 0
        for at in range(begin, upto[part[-1]] if len(part) else 0, PAIRS):
            pair = np.arange(at, min(at + PAIRS, upto[part[-1]]))
            window = part[0] + np.searchsorted(upto[part], pair, side="right")
            x0, y0, x1, y1 = windows[:, window]
            bx0, by0, bx1, by1 = boxes[:, first[window] + pair - (upto - count)[window]]
            touched[window[~((x0 >= bx1) | (bx0 >= x1) | (y0 >= by1) | (by0 >= y1))]] = True
    return touched


def _first_free(heads: pa.Array, width: pa.Array, height: pa.Array, boxes: pa.Array, quota: pa.Array) -> pa.Array:
    """For each frame its first `quota` random windows that touch none of its boxes.

    Attempts are made in their order, in rounds of as many as a frame still lacks, so none is made in vain; frames
    drop out when their quota is full or their budget spent.
    """
    heads = np.array(heads.cast("binary").to_pylist(), object)
    width, height, quota = (np.asarray(c.cast("double").to_numpy(zero_copy_only=False)) for c in (width, height, quota))
    quota = quota.astype(np.int64)
    offsets = boxes.offsets.to_numpy().astype(np.int64)
    start, held = offsets[:-1], np.diff(offsets)
    held_edges = dict(zip((f.name for f in boxes.values.type), boxes.values.flatten()))
    # a missing edge reaches everything; SQL orders NaN above all numbers
    edges = np.stack([
        np.nan_to_num(pc.fill_null(c.cast("double"), far).to_numpy(zero_copy_only=False), nan=np.inf, posinf=np.inf,
                      neginf=-np.inf)
        for c, far in ((held_edges[e], -np.inf if e in EDGES[:2] else np.inf) for e in EDGES)])
    budget = quota * C.ATTEMPTS_PER_NEGATIVE
    made, got = np.zeros_like(quota), np.zeros_like(quota)
    found = []
    open_ = np.flatnonzero(boxes.is_valid().to_numpy(zero_copy_only=False))
    while len(open_):
        tries = np.minimum(quota - got, budget - made)[open_]
        frame = np.repeat(open_, tries)
        attempt = np.arange(len(frame)) - np.repeat(np.cumsum(tries) - tries, tries) + made[frame]
        windows = _drawn_windows(heads[frame].tolist(), attempt, width[frame], height[frame])
        free = ~_touched(windows, edges, start[frame], held[frame])
        found.append((frame[free], attempt[free], windows[:, free]))
        made[open_] += tries
        got += np.bincount(frame[free], minlength=len(got))
        open_ = open_[(got[open_] < quota[open_]) & (made[open_] < budget[open_])]
    frame, attempt, windows = (
        np.concatenate(c, axis=-1) for c in zip(*found)) if found else (made[:0], made[:0], np.zeros((4, 0)))
    order = np.lexsort((attempt, frame))
    win = pa.StructArray.from_arrays([pa.array(c[order], from_pandas=True) for c in windows], EDGES)
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(got)]), pa.int32()),
        pa.StructArray.from_arrays([pa.array(attempt[order], pa.int32()), win], ("attempt", "win")))


def with_negative_windows(df: DataFrame, seed: int = C.SEED) -> DataFrame:
    """Add `negatives`: the first accepted random windows of each frame, up to its quota.

    A frame row carries all of its boxes, so rejection happens inside the row and nothing is
    shuffled. Attempts keep their numbers, and the whole budget of 25 per window is spent when the first ones do
    not fill the quota. Only boxes and sizes go to Python, batches of frames at a time; other columns do not.
    """
    ship_package(df.sparkSession)
    edges = ",".join(f"{c}:double" for c in EDGES)
    free = F.arrow_udf(_first_free, f"array<struct<attempt:int,win:struct<{edges}>>>")
    return df.withColumn("quota", negative_quota(F.col("boxes"))).withColumn("negatives", free(
        F.concat_ws(":", F.lit(str(seed)), F.lit("window"), F.col("frame_id").cast("string")), "width", "height", "boxes",
        "quota"))


def negative_windows(df: DataFrame, seed: int = C.SEED) -> DataFrame:
    return (
        each(with_negative_windows(df, seed), "negatives", "item", "neg")
        .withColumn("attempt", F.col("neg.attempt")).withColumn("win", F.col("neg.win"))
        .drop("negatives", "neg"))


PATCH_COLUMNS = ("frame_id", "camera", "part", "source", "label", "item", "crop")


def _patch_rows(df: DataFrame) -> DataFrame:
    edges = [F.col(f"win.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")]
    return df.select(*PATCH_COLUMNS, *edges)


def positive_patches(df: DataFrame, seed: int = C.SEED) -> DataFrame:
    return _patch_rows(
        box_windows(df, seed).withColumn("part", split_part(F.col("camera"), F.col("partner")))
        .withColumn("source", F.lit(C.POSITIVE)).withColumn("label", F.lit(1)))


def negative_patches(df: DataFrame, seed: int = C.SEED) -> DataFrame:
    return _patch_rows(
        negative_windows(df, seed)
        .withColumn("part", split_part(F.col("camera"), F.col("partner")))
        .withColumn("source", F.when(F.size("boxes") > 0, C.HARD).otherwise(C.CLEAN))
        .withColumn("label", F.lit(0)).withColumn("crop", F.col("attempt")))


def all_patches(df: DataFrame, seed: int = C.SEED) -> DataFrame:
    """Positives, hard and clean negatives of every frame in one pass over the frames."""
    df = with_negative_windows(df, seed)
    positives = F.flatten(F.transform(F.col("boxes"), lambda b, i: F.transform(
        F.sequence(F.lit(0), F.lit(C.CROPS_PER_BOX - 1)),
        lambda crop: F.struct(
            F.lit(1).alias("label"), i.alias("item"), crop.alias("crop"), b.alias("win")))))
    negatives = F.transform(F.col("negatives"), lambda n, i: F.struct(
        F.lit(0).alias("label"), i.alias("item"), n.attempt.alias("crop"), n.win.alias("win")))
    rows = df.select(
        "frame_id", "camera", "width", "height",
        split_part(F.col("camera"), F.col("partner")).alias("part"),
        F.when(F.size("boxes") > 0, C.HARD).otherwise(C.CLEAN).alias("_kind"),
        F.inline(F.concat(positives, negatives)))
    # positives still hold their box; the window is computed on flat rows, in generated code
    rows = place_windows(rows.withColumnRenamed("win", "box"), seed)
    positive = F.col("label") == 1
    return _patch_rows(
        rows.withColumn("source", F.when(positive, C.POSITIVE).otherwise(F.col("_kind")))
        .withColumn("win", F.when(positive, F.col("win")).otherwise(F.col("box"))))


def frame_windows(df: DataFrame, seed: int = C.SEED) -> DataFrame:
    """Add `windows`, the patches of `all_patches` as an array in the frame's own row, and `part`.

    The form that pixel extraction takes: a frame with its pixels crosses to Python once.
    """
    size = F.col("width"), F.col("height")

    def patch(label, source, item, crop, win):
        return F.struct(
            F.lit(label).alias("label"), source.alias("source"), item.cast("int").alias("item"),
            crop.cast("int").alias("crop"), *[win[c].alias(c) for c in ("x0", "y0", "x1", "y1")])

    made = [F.transform(F.col("boxes"), _positive(crop, size, seed, patch))
            for crop in range(C.CROPS_PER_BOX)]
    kind = F.when(F.size("boxes") > 0, C.HARD).otherwise(C.CLEAN)
    negatives = F.transform(F.col("negatives"), lambda n, i: patch(0, kind, i, n.attempt, n.win))
    return with_negative_windows(df, seed).select(
        *df.columns, split_part(F.col("camera"), F.col("partner")).alias("part"),
        F.concat(*made, negatives).alias("windows"))


def _positive(crop: int, size, seed: int, patch):
    def one(box: Column, item: Column) -> Column:
        draws = jitter_draws(F.col("frame_id"), item, seed) if crop else None
        return patch(1, F.lit(C.POSITIVE), item, F.lit(crop), window_around(box, *size, draws))

    return one


def fixed_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """`n` rows without replacement, in key order; equal digests fall back to the key."""
    return (
        df.withColumn("_h", digest(seed, F.col(key))).orderBy("_h", key).limit(n).drop("_h")
        .orderBy(key))


def class_sample(df: DataFrame, label: str, key: str, n: int, seed: int = 3) -> DataFrame:
    """`n` rows per class. The rank filter lets Spark keep only n rows per class and task before
    the shuffle."""
    w = W.partitionBy(label).orderBy("_h", key)
    return (
        df.withColumn("_h", digest(seed, F.col(key)))
        .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("_h"))


def epoch_order(df: DataFrame, index: str, epoch: int, seed: int = C.SEED, chunk: int = 8,
                batch: int = 64) -> DataFrame:
    """Chunk-local shuffle: blocks of `chunk` neighbours are permuted, a batch holds
    `batch // chunk` blocks in index order. Adds `batch_id`."""
    df = df.withColumn("_chunk", F.floor(F.col(index) / chunk))
    blocks = df.select("_chunk").distinct().withColumn("_h", digest(seed + epoch, F.col("_chunk")))
    blocks = blocks.withColumn("n", F.lit(1))
    ranked = running_totals(blocks, [], hex_cell(F.col("_h")),
                            F.struct(F.col("_h"), F.col("_chunk")), ["n"])
    per_batch = max(1, batch // chunk)
    ids = ranked.select("_chunk", F.floor((F.col("n_upto") - 1) / per_batch).alias("batch_id"))
    return df.join(ids, "_chunk").drop("_chunk")


def top_by_score(df: DataFrame, score: str, tie: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(F.col(score).desc(), *tie).limit(n)


def showcase(df: DataFrame, score: str, tie: Sequence[str], top: int = 60, every: int = 10,
             keep: int = 6) -> DataFrame:
    """Every `every`-th of the best `top` rows, at most `keep`."""
    w = W.orderBy(F.col(score).desc(), *tie)
    best = top_by_score(df, score, tie, top)
    return (
        best.withColumn("rank", F.row_number().over(w))
        .where(((F.col("rank") - 1) % every == 0) & (F.col("rank") <= keep * every)))
