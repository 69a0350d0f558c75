"""Patch extraction: known bytes, and a slow direct version."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumewatch.operators import pixels


def lcg_image(size=224, seed=20260905):
    x, out = seed, bytearray()
    for _ in range(size * size * 3):
        x = (1103515245 * x + 12345) & 0x7FFFFFFF
        out.append((x >> 16) & 255)
    return np.frombuffer(bytes(out), np.uint8).reshape(size, size, 3)


def test_known_bytes():
    out = pixels.resample(lcg_image(), (0, 0, 224, 224), 96).reshape(-1)
    assert out[:32].tolist() == [
        166, 121, 89, 120, 108, 128, 112, 117, 162, 140, 130, 137, 162, 104, 36, 154,
        105, 130, 148, 120, 155, 113, 118, 93, 110, 99, 168, 145, 92, 103, 134, 100]
    assert out[-16:].tolist() == [
        130, 177, 156, 118, 163, 136, 143, 133, 130, 149, 102, 140, 146, 157, 151, 132]


def slow(image, window, out):
    def line(values, start, length):
        step = length / out
        reach = max(step, 1.0)
        res = []
        for i in range(out):
            c = start + (i + 0.5) * step
            lo, hi = max(int(c - reach + 0.5), 0), min(int(c + reach + 0.5), len(values))
            ws = [max(0.0, 1 - abs((t - c + 0.5) / reach)) for t in range(lo, hi)]
            ks = [math.floor(w / sum(ws) * 2**22 + 0.5) for w in ws]
            res.append(min(255, max(0, (sum(k * int(v) for k, v in zip(ks, values[lo:hi])) + 2**21) >> 22)))
        return res

    x0, y0, x1, y1 = window
    h = image.shape[0]
    mid = np.array([[line(image[r, :, c], x0, x1 - x0) for c in range(3)] for r in range(h)])
    return np.array([[line(mid[:, c, i], y0, y1 - y0) for i in range(out)] for c in range(3)]).transpose(2, 1, 0)


@pytest.mark.parametrize("window", [(0, 0, 40, 30), (3.3, 2.1, 21.9, 20.7), (10, 5, 16, 11)])
def test_against_direct_version(window):
    image = np.random.default_rng(1).integers(0, 256, (30, 40, 3), dtype=np.uint8)
    assert (pixels.resample(image, window, 8) == slow(image, window, 8)).all()


@pytest.mark.parametrize("size,out", [((48, 64), 8), ((30, 40), 16), ((7, 5), 8), ((200, 32), 16)])
def test_many_windows_at_once_are_those_one_by_one(size, out):
    """Windows inside, over the edge, outside, tiny and whole; every byte."""
    rng = np.random.default_rng(3)
    h, w = size
    images = [rng.integers(0, 256, (h, w, 3), dtype=np.uint8) for _ in range(3)]
    x, y = rng.random(300) * w * 0.7, rng.random(300) * h * 0.7
    side = 0.2 + rng.random(300) * min(h, w)
    wins = np.stack([x, y, x + side, y + side], axis=1)
    wins[::50] = (0, 0, w, h)
    wins[1::50] = (1, 2, 5, 4)
    wins[2::50] = (w + 3, 0, w + 9, 6)
    got = pixels.resample_many(images, [100, 0, 200], wins, out)
    want = [pixels.resample(images[0 if i < 100 else 2], win, out) for i, win in enumerate(wins)]
    assert (got == np.stack(want)).all()


def test_level_sums_of_patches_of_any_length(spark):
    held = [bytes(range(n)) for n in (0, 1, 5, 200)]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(held)], "k int, patch binary")
    got = sorted(tuple(r) for r in pixels.level_sums(df).collect())
    assert got == [(i, len(b), sum(b), sum(v * (j + 1) for j, v in enumerate(b))) for i, b in enumerate(held)]


def test_extract_swaps_channels_and_cuts_tiles(spark):
    image = np.random.default_rng(2).integers(0, 256, (24, 32, 3), dtype=np.uint8)
    kind = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
    wins = [(4.0, 2.0, 20.0, 18.0), (0.0, 0.0, 32.0, 24.0)]
    df = spark.createDataFrame(
        [(1, bytearray(image.tobytes()), 24, 32, wins), (2, bytearray(image.tobytes()), 24, 32, []),
         (3, bytearray(image.tobytes()), 24, 32, wins[1:])],
        f"k int, data binary, height int, width int, windows {kind}").coalesce(1)

    def patches(**kw):
        return {(r.k, tuple(r.window)): np.frombuffer(r.patch, np.uint8).reshape(8, 8, 3)
                for r in pixels.extract_patches(df, out=8, **kw).collect()}

    plain = patches()
    assert sorted(plain) == sorted([(1, wins[0]), (1, wins[1]), (3, wins[1])])
    for (_, w), got in plain.items():
        assert (got == pixels.resample(image, w, 8)).all()
    assert (patches(bgr=True)[1, wins[0]] == plain[1, wins[0]][:, :, ::-1]).all()
    assert (patches(alone=True)[1, wins[0]]
            == pixels.resample(image[2:18, 4:20], (0, 0, 16, 16), 8)).all()
    assert sorted(patches(output_bytes=1)) == sorted(plain)


def test_model_is_loaded_once_per_worker_stream(spark):
    df = spark.range(100).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("f"))
    got = [r[0] for r in df.select(pixels.score_with(
        pixels.logistic_model([0.1, -2.0], 0.5), F.col("f"))).collect()]
    assert got == pytest.approx([1 / (1 + math.exp(-(0.1 * i - 1.5))) for i in range(100)])


def test_other_height_and_signed_levels():
    image = np.random.default_rng(4).integers(0, 256, (30, 40, 3), dtype=np.uint8)
    out = pixels.resample(image, (0, 0, 40, 30), 16, 9)
    assert out.shape == (9, 16, 3)
    flat = pixels.resample(np.full((20, 20, 3), 77, np.uint8), (1.5, 2.5, 18.5, 17.0), 5, 3)
    assert (flat == 77).all()
    assert pixels.signed_levels(np.array([0, 128, 255], np.uint8)).tolist() == [-128, 0, 127]


def test_random_windows_are_not_kept():
    before = pixels._kept_taps.cache_info().currsize
    for i in range(300):
        pixels.resample(np.zeros((8, 8, 3), np.uint8), (0.5 + i / 1000, 0.25, 7.5, 7.75), 4)
    assert pixels._kept_taps.cache_info().currsize == before
    assert pixels._kept_taps.cache_info().maxsize <= 128


def _rounded(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_frame_windows_are_those_of_the_patch_build(spark, sf):
    from plumewatch.operators import sampling
    from plumewatch.plans import views as V

    frames = V.raster_frames(spark, sf)
    cols = ["frame_id", "label", "source", "item", "crop", "x0", "y0", "x1", "y1"]
    inside = sampling.frame_windows(frames).select("frame_id", F.inline("windows")).select(cols)
    flat = sampling.all_patches(frames).select(cols)
    assert _rounded(inside) == _rounded(flat)
    assert "Exchange" not in inside._jdf.queryExecution().executedPlan().toString()
