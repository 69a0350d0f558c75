"""Frame geometry as column expressions: boxes, windows, tiles, overlap, splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumewatch import constants as C
from plumewatch.functions.hashing import between, digest, hex_int, unit

LINE_BREAK = "\\r\\n|[\\n\\x0B\\f\\r\\x1c-\\x1e\\x85\\u2028\\u2029]"


def box_struct(x0, y0, x1, y1) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def annotation_lines(text: Column) -> Column:
    """Token arrays of the well-formed lines (five tokens, numeric box)."""
    lines = F.split(F.coalesce(text, F.lit("")), LINE_BREAK)
    tokens = F.transform(lines, lambda s: F.regexp_extract_all(s, F.lit("(?U)\\S+"), F.lit(0)))
    return F.filter(tokens, lambda t: F.size(t) == 5)


def fraction_boxes(text: Column) -> Column:
    """Boxes as (xc, yc, w, h) fractions of the frame."""
    parsed = F.transform(
        annotation_lines(text),
        lambda t: F.struct(*[
            t[i + 1].try_cast("double").alias(n) for i, n in enumerate(("xc", "yc", "w", "h"))
        ]),
    )
    return F.filter(
        parsed,
        lambda b: b.xc.isNotNull() & b.yc.isNotNull() & b.w.isNotNull() & b.h.isNotNull(),
    )


def parse_boxes(text: Column, width: Column, height: Column) -> Column:
    """Pixel boxes of an annotation text; NULL text gives an empty array."""
    w, h = width.cast("double"), height.cast("double")

    def pixels(b):
        x0 = (b.xc - b.w / 2) * w
        y0 = (b.yc - b.h / 2) * h
        return box_struct(x0, y0, x0 + b.w * w, y0 + b.h * h)

    return F.transform(fraction_boxes(text), pixels)


def has_smoke_text(text: Column) -> Column:
    """Smoke flag of frame evaluation: any non-blank annotation text."""
    return F.coalesce(text, F.lit("")).rlike("(?U)\\S")


def rescale_box(box: Column, width: Column, height: Column, size=C.FRAME_SIZE) -> Column:
    """Box coordinates after the frame is resized to `size`."""
    sx, sy = F.lit(float(size[0])) / width, F.lit(float(size[1])) / height
    return box_struct(box.x0 * sx, box.y0 * sy, box.x1 * sx, box.y1 * sy)


def window_around(box: Column, width: Column, height: Column, shift=None) -> Column:
    """Square window with context around a box, kept inside the frame.

    `shift` is a pair of draws in [0, 1) that move the centre without losing the box.
    """
    w, h = box.x1 - box.x0, box.y1 - box.y0
    side = F.least(
        F.greatest(F.lit(float(C.WINDOW_PX)), w * C.BOX_MARGIN, h * C.BOX_MARGIN),
        height.cast("double"),
    )
    cx, cy = (box.x0 + box.x1) / 2, (box.y0 + box.y1) / 2
    if shift is not None:
        slack_x = F.greatest(F.lit(0.0), (side - w) / 2 * C.JITTER_SHARE)
        slack_y = F.greatest(F.lit(0.0), (side - h) / 2 * C.JITTER_SHARE)
        cx = cx + between(shift[0], -slack_x, slack_x)
        cy = cy + between(shift[1], -slack_y, slack_y)
    x = F.least(F.greatest(cx - side / 2, F.lit(0.0)), width - side)
    y = F.least(F.greatest(cy - side / 2, F.lit(0.0)), height - side)
    return box_struct(x, y, x + side, y + side)


def jitter_draws(frame_id: Column, item: Column, seed: int = C.SEED):
    h = digest(seed, "jitter", frame_id, item)
    return unit(h, 0), unit(h, 1)


def random_windows(attempts: str, frame_id: str = "frame_id", width: str = "width",
                   height: str = "height", seed: int = C.SEED) -> Column:
    """Candidate negative windows, one (attempt, win) per element of `attempts`.

    Arguments are SQL expressions. Built in steps, because a lambda repeats every expression it
    mentions: each digest is computed once and its draws are handed on.
    """
    low, high = C.NEGATIVE_SIDE

    def draw(slot):
        return f"cast(conv(substring(d.h, {1 + 8 * slot}, 8), 16, 10) AS BIGINT) / 4294967296D"

    hashed = (f"transform({attempts}, a -> "
              f"struct(a, md5(concat_ws(':', '{seed}', 'window', {frame_id}, a)) AS h))")
    sized = (f"transform({hashed}, d -> struct(d.a, least(({low}D + {draw(0)} * ({high}D - {low}D))"
             f" * {C.WINDOW_PX}, double({height})) AS s, {draw(1)} AS u, {draw(2)} AS v))")
    placed = (f"transform({sized}, d -> "
              f"struct(d.a, d.s, d.u * ({width} - d.s) AS x, d.v * ({height} - d.s) AS y))")
    return F.expr(
        f"transform({placed}, d -> struct(d.a AS attempt, struct(d.x AS x0, d.y AS y0, "
        f"d.x + d.s AS x1, d.y + d.s AS y1) AS win))")


def intersection(a: Column, b: Column) -> Column:
    ix = F.greatest(F.lit(0.0), F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0))
    iy = F.greatest(F.lit(0.0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))
    return ix * iy


def covered_share(window: Column, box: Column) -> Column:
    """Share of the box area inside the window, the box counting at least one pixel."""
    area = F.greatest(F.lit(1.0), (box.x1 - box.x0) * (box.y1 - box.y0))
    return intersection(window, box) / area


def meets(a: Column, b: Column) -> Column:
    """Whether two rectangles share area: the cheap form of an intersection above zero."""
    return (a.x0 < b.x1) & (b.x0 < a.x1) & (a.y0 < b.y1) & (b.y0 < a.y1)


def touches_any(window: Column, boxes: Column, threshold: float = 0.0) -> Column:
    if threshold == 0:
        return F.exists(boxes, lambda b: meets(window, b))
    return F.exists(boxes, lambda b: covered_share(window, b) > threshold)


def tile_axis(length: Column, window: int = C.WINDOW_PX, overlap=C.OVERLAP) -> Column:
    """Tile corners along one axis; the last one is snapped to the border."""
    step = window * (overlap[1] - overlap[0]) // overlap[1]
    n = length.cast("int")
    corners = F.array_union(
        F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)), F.lit(step)),
        F.array(n - window),
    )
    return F.when(n >= window, corners).otherwise(F.array().cast("array<int>"))


def tile_grid(width: Column, height: Column) -> Column:
    """Row-major array of tile corners (x, y); empty if the frame is smaller than a window."""
    xs, ys = tile_axis(width), tile_axis(height)
    return F.flatten(F.transform(ys, lambda y: F.transform(
        xs, lambda x: F.struct(x.alias("x"), y.alias("y")))))


def tile_coverage(box: Column, width: Column, height: Column) -> Column:
    """Tiles of the frame grid that see the box, with the share of its area they cover.

    The grid follows from the frame size alone, so no join is needed: each axis is narrowed to the
    corners that reach the box before the two are combined.
    """
    win = float(C.WINDOW_PX)
    xs, ys = tile_axis(width), tile_axis(height)
    nx = F.size(xs)
    hit_x = F.filter(
        F.transform(xs, lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
        lambda t: (t.x < box.x1) & (t.x + win > box.x0))
    hit_y = F.filter(
        F.transform(ys, lambda y, j: F.struct(y.alias("y"), j.alias("j"))),
        lambda t: (t.y < box.y1) & (t.y + win > box.y0))

    def tile(tx, ty):
        window = box_struct(
            tx.x.cast("double"), ty.y.cast("double"), tx.x + F.lit(win), ty.y + F.lit(win))
        return F.struct(
            (ty.j * nx + tx.i).alias("tile_id"), tx.x.alias("x"), ty.y.alias("y"),
            covered_share(window, box).alias("share"))

    seen = F.flatten(F.transform(hit_y, lambda ty: F.transform(hit_x, lambda tx: tile(tx, ty))))
    return F.filter(seen, lambda t: t.share > 0)


def split_part(camera: Column, partner: Column) -> Column:
    """Leakage-free split: whole held-out partner, the rest hashed by camera."""
    bucket = hex_int(F.md5(camera), 1, 8) % 100
    return (
        F.when(partner == C.HELD_OUT_PARTNER, C.PART_HELD_OUT)
        .when(bucket < C.VAL_PERCENT, C.PART_VAL)
        .otherwise(C.PART_TRAIN)
    )


def readable_image(payload: Column) -> Column:
    """Image bytes that start like a JPEG or PNG file."""
    head = F.hex(F.substring(payload, 1, 4))
    return F.coalesce(head.startswith("FFD8FF") | (head == "89504E47"), F.lit(False))
