"""Score arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dequantize(y: Column, scale: float, zero: int) -> Column:
    return (y - zero) * F.lit(float(scale))


def quantize(x: Column, scale: float, zero: int) -> Column:
    """Signed 8-bit lattice; halves go to the even neighbour."""
    return F.greatest(F.lit(-128), F.least(
        F.lit(127), F.bround(x / F.lit(float(scale)) + zero, 0).cast("int")))


def per_mille(y_int8: Column) -> Column:
    """INT8 output to a probability in thousandths, whole numbers only."""
    return F.floor(((y_int8.cast("bigint") + 128) * 1000 + 128) / 256).cast("int")


def capture_fpr(tile_fpr: Column, n: int) -> Column:
    return 1 - F.pow(1 - tile_fpr, F.lit(n))


def tile_fpr_for(capture: Column, n: int) -> Column:
    return 1 - F.pow(1 - capture, F.lit(1.0 / n))


def detected_within(recall: Column, captures: Column) -> Column:
    return 1 - F.pow(1 - recall, captures)


def false_alarms_per_day(capture: Column, captures_per_day: int = 48) -> Column:
    return capture * captures_per_day


def haze(pixels: Column, alpha: Column, veil: Column) -> Column:
    return F.transform(pixels, lambda x: x * (1 - alpha) + veil * alpha)


def gray_triples(rgb: Column) -> Column:
    """Interleaved RGB values (0..255) to gray, replicated to three channels.

    Weights and the conversion back to 8 bits follow the public definition of the luma transform
    for 8-bit images: scale to [0, 1], weigh, multiply by 255.5, truncate.
    """
    n = F.floor(F.size(rgb) / 3).cast("int")

    def level(i):
        r, g, b = (rgb[i * 3 + k].cast("double") / 255.0 for k in range(3))
        return F.floor((r * 0.2989 + g * 0.587 + b * 0.114) * 255.5).cast("int")

    return F.when(n > 0, F.flatten(F.transform(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
        lambda i: F.array_repeat(level(i), 3)))).otherwise(F.array().cast("array<int>"))


def mean_brightness(channel: Column, step: int = 8) -> Column:
    """Whole-number mean of every `step`-th value."""
    kept = F.filter(channel, lambda x, i: i % step == 0)
    total = F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    return F.floor(total / F.size(kept))
