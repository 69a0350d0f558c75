"""Pixel work in Arrow batches: patch extraction and batched model scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumewatch import constants as C
from plumewatch.session import ship_package

FRACTION_BITS = 22
EDGES = ("x0", "y0", "x1", "y1")


def axis_taps(size: int, start: float, length: float, out: int) -> tuple[np.ndarray, np.ndarray]:
    """Input places and integer weights (both out x taps) of an antialiased triangle filter.

    Output sample i is centred on its share of [start, start + length); the triangle widens with the
    reduction factor, its taps are normalised and rounded to 22 fraction bits.
    """
    step = length / out
    reach = max(step, 1.0)
    centres = start + (np.arange(out) + 0.5) * step
    low = np.maximum((centres - reach + 0.5).astype(np.int64), 0)
    high = np.minimum((centres + reach + 0.5).astype(np.int64), size)
    taps = low[:, None] + np.arange(max(1, int((high - low).max())))
    distance = np.abs((taps - centres[:, None] + 0.5) * (1.0 / reach))
    weights = np.where(taps < high[:, None], np.clip(1.0 - distance, 0.0, None), 0.0)
    total = weights.sum(axis=1, keepdims=True)
    weights = np.divide(weights, total, out=np.zeros_like(weights), where=total != 0)
    return np.minimum(taps, size - 1), np.floor(weights * (1 << FRACTION_BITS) + 0.5).astype(np.int32)


#: Whole-pixel windows, as tiles are, repeat; random windows never do and are not kept.
_kept_taps = lru_cache(maxsize=128)(axis_taps)


def _taps(size: int, start: float, length: float, out: int) -> tuple[np.ndarray, np.ndarray]:
    whole = start.is_integer() and length.is_integer()
    return (_kept_taps if whole else axis_taps)(size, start, length, out)


def _pass(places: np.ndarray, weights: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Weighted sums of lines, one tap at a time; they stay below 2**31."""
    total = np.full((len(places), *lines.shape[1:]), 1 << (FRACTION_BITS - 1), np.int32)
    for k in range(places.shape[1]):
        total += weights[:, k].reshape(-1, *[1] * (lines.ndim - 1)) * lines[places[:, k]]
    return np.clip(total >> FRACTION_BITS, 0, 255).astype(np.uint8)


def resample(image: np.ndarray, window: tuple[float, float, float, float],
             out: int = C.PATCH_PX, out_height: int | None = None) -> np.ndarray:
    """Window of an (h, w, 3) uint8 image as out x out x 3, saturated to 8 bits after each pass.

    `out_height` gives another height than width. Taps at the window edge may reach pixels just outside
    it. For the result of a node, which sees each tile alone, pass the tile cut out of the frame.
    """
    h, w = image.shape[:2]
    x0, y0, x1, y1 = (float(v) for v in window)
    across, across_weights = _taps(w, x0, x1 - x0, out)
    down, down_weights = _taps(h, y0, y1 - y0, out_height or out)
    # only the columns and rows that a tap reaches
    left, top = int(across.min()), int(down.min())
    part = image[top:int(down.max()) + 1, left:int(across.max()) + 1].astype(np.int32)
    rows = _pass(across - left, across_weights, part.transpose(1, 0, 2)).transpose(1, 0, 2)
    return _pass(down - top, down_weights, rows.astype(np.int32))


#: Frames up to this many pixels are resampled by whole matrices, all windows of many frames at a time.
SMALL_FRAME = 1 << 14
#: Windows handled at a time.
GROUP = 512


def dense_taps(size: int, starts: np.ndarray, lengths: np.ndarray, out: int) -> np.ndarray:
    """The weights of `axis_taps` for many windows, as windows x out x size.

    Windows with equally many taps are worked out together, so that weights are summed in the same order as there.
    """
    step = lengths / out
    reach = np.maximum(step, 1.0)
    centres = starts[:, None] + (np.arange(out) + 0.5) * step[:, None]
    low = np.maximum((centres - reach[:, None] + 0.5).astype(np.int64), 0)
    high = np.minimum((centres + reach[:, None] + 0.5).astype(np.int64), size)
    widths = np.maximum(1, (high - low).max(axis=1))
    found = np.zeros((len(starts), out, size))
    for width in np.unique(widths):
        own = widths == width
        taps = low[own][:, :, None] + np.arange(width)
        distance = np.abs((taps - centres[own][:, :, None] + 0.5) * (1.0 / reach[own])[:, None, None])
        weights = np.where(taps < high[own][:, :, None], np.clip(1.0 - distance, 0.0, None), 0.0)
        total = weights.sum(axis=2, keepdims=True)
        weights = np.divide(weights, total, out=np.zeros_like(weights), where=total != 0)
        placed = np.zeros((len(taps), out, size + 1))
        np.put_along_axis(placed, np.minimum(taps, size), np.floor(weights * (1 << FRACTION_BITS) + 0.5), axis=2)
        found[own] = placed[:, :, :size]
    return found


def _levels(sums: np.ndarray) -> np.ndarray:
    """8-bit levels of weighted sums, which doubles hold exactly."""
    sums += 1 << (FRACTION_BITS - 1)
    sums *= 1.0 / (1 << FRACTION_BITS)
    return np.clip(np.floor(sums, out=sums), 0, 255, out=sums)


def resample_many(images: list[np.ndarray], counts: list[int], windows: np.ndarray, out: int) -> np.ndarray:
    """`resample` for the windows (rows x0, y0, x1, y1) of small images of one size, `counts` of them for each image."""
    h, w = images[0].shape[:2]
    x0, y0, x1, y1 = windows.T
    across, down = dense_taps(w, x0, x1 - x0, out), dense_taps(h, y0, y1 - y0, out)
    made, at = [], 0
    for image, n in zip(images, counts):
        columns = image.transpose(1, 0, 2).reshape(w, h * 3).astype(np.float64)
        rows = _levels(across[at:at + n].reshape(n * out, w) @ columns).reshape(n, out, h, 3)
        rows = rows.transpose(0, 2, 1, 3).reshape(n, h, out * 3)
        made.append(_levels(down[at:at + n] @ rows).astype(np.uint8).reshape(n, out, out, 3))
        at += n
    return np.concatenate(made)


def signed_levels(patch: np.ndarray) -> np.ndarray:
    """Levels as a quantised network takes them: 0..255 becomes -128..127."""
    return (patch.astype(np.int16) - 128).astype(np.int8)


def extract_patches(df: DataFrame, windows: str = "windows", out: int = C.PATCH_PX,
                    bgr: bool = False, alone: bool = False,
                    output_bytes: int = 16 << 20) -> DataFrame:
    """One row per window of each frame, with its `patch`.

    Needs data (height x width x 3 bytes), height, width and an array of structs with the edges x0, y0,
    x1, y1; the struct becomes the column `window`. A frame's pixels reach Python once, however many
    windows it has, in batches that Spark limits by bytes. `bgr` swaps the channel order of
    Spark's image source; `alone` cuts whole-pixel windows out first, as a node does.
    """
    ship_package(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name not in ("data", "height", "width", windows)]
    schema = T.StructType([
        *kept, T.StructField("window", df.schema[windows].dataType.elementType),
        T.StructField("patch", T.BinaryType())])
    names = [f.name for f in kept]

    def cut(image: np.ndarray, window: tuple) -> bytes:
        if alone:
            x0, y0, x1, y1 = (int(v) for v in window)
            image = image[y0:y1, x0:x1]
            window = (0, 0, x1 - x0, y1 - y0)
        return resample(image, window, out).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, lists = batch.column("data"), batch.column(windows)
            heights, widths = (batch.column(c).to_numpy() for c in ("height", "width"))
            held, ends, there = lists.values, lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
            fields = dict(zip((f.name for f in held.type), held.flatten()))
            edges = np.stack([fields[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in EDGES], axis=1)

            def flush(rows: list[int]) -> pa.RecordBatch:
                counts = [int(ends[i + 1] - ends[i]) for i in rows]
                shown = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in rows])
                images = [np.frombuffer(data[i].as_buffer(), np.uint8).reshape(
                    int(heights[i]), int(widths[i]), 3)[:, :, ::-1 if bgr else 1] for i in rows]
                if small(rows[0]):
                    patches = [p.tobytes() for p in resample_many(images, counts, edges[shown], out)]
                else:
                    own = np.repeat(np.arange(len(rows)), counts)
                    patches = [cut(images[k], tuple(edges[j])) for k, j in zip(own, shown)]
                kept_rows = batch.select(names).take(pa.array(np.repeat(rows, counts), pa.int64()))
                return pa.RecordBatch.from_arrays(
                    [*[kept_rows.column(n) for n in names], held.take(pa.array(shown, pa.int64())),
                     pa.array(patches, pa.binary())], names=[*names, "window", "patch"])

            def small(i: int) -> bool:
                return not alone and int(heights[i]) * int(widths[i]) <= SMALL_FRAME

            rows: list[int] = []
            waiting = 0
            for i in range(batch.num_rows):
                if not there[i] or ends[i + 1] == ends[i]:
                    continue
                if rows and (heights[i] != heights[rows[0]] or widths[i] != widths[rows[0]]):
                    yield flush(rows)
                    rows, waiting = [], 0
                rows.append(i)
                waiting += int(ends[i + 1] - ends[i])
                if waiting * out * out * 3 > output_bytes or waiting >= GROUP:
                    yield flush(rows)
                    rows, waiting = [], 0
            if rows:
                yield flush(rows)

    return df.mapInArrow(run, schema)


def level_sums(df: DataFrame, patch: str = "patch") -> DataFrame:
    """Add `n_bytes`, `level_sum` and `weighted_sum`, the levels times their places from 1, and drop the patch."""
    ship_package(df.sparkSession)

    @F.pandas_udf("n_bytes int, level_sum long, weighted_sum long")
    def sums(patches: pd.Series) -> pd.DataFrame:
        lengths = patches.map(len).to_numpy(np.int64)
        levels = np.frombuffer(b"".join(patches), np.uint8).astype(np.int64)
        ends = np.cumsum(lengths)
        places = np.arange(len(levels)) - np.repeat(ends - lengths, lengths) + 1

        def total(values):
            upto = np.concatenate([[0], np.cumsum(values)])
            return upto[ends] - upto[ends - lengths]

        return pd.DataFrame({"n_bytes": lengths, "level_sum": total(levels), "weighted_sum": total(levels * places)})

    return df.select("*", sums(patch).alias("_s")).select(
        *[c for c in df.columns if c != patch], "_s.n_bytes", "_s.level_sum", "_s.weighted_sum")


Model = Callable[[np.ndarray], np.ndarray]


def score_with(load: Callable[[], Model], features: Column) -> Column:
    """Score column from a model that each Python worker loads once.

    `load` returns a function from a (rows, features) float array to scores; an Arrow batch is one
    model call.
    """
    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            rows = np.stack(batch.to_numpy()).astype(np.float64)
            yield pd.Series(np.asarray(model(rows), dtype=np.float64).reshape(-1))

    return score(features)


def logistic_model(weights, bias: float) -> Callable[[], Model]:
    weights = np.asarray(weights, dtype=np.float64)

    def load() -> Model:
        return lambda x: 1.0 / (1.0 + np.exp(-(x @ weights + bias)))

    return load


def centroid_weights(df: DataFrame, features: str, positive: Column) -> tuple[list[float], float]:
    """Linear model between the class means: one aggregate, as many numbers as there are features."""
    means = (
        df.select(positive.alias("_y"), F.posexplode(features).alias("_i", "_v"))
        .groupBy("_i").agg(
            F.avg(F.when(F.col("_y"), F.col("_v").cast("double"))).alias("a"),
            F.avg(F.when(~F.col("_y"), F.col("_v").cast("double"))).alias("b"))
        .orderBy("_i").collect())
    weights = [r.a - r.b for r in means]
    bias = -sum((r.a - r.b) * (r.a + r.b) / 2 for r in means)
    return weights, bias
