"""Split windows and joins against brute force, with one key holding most rows."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumewatch.functions import geometry as geo
from plumewatch.operators import curves, metrics, overlap, ranking, rules, sampling, timeline
from plumewatch.plans import views as V


@pytest.fixture(scope="module")
def history(spark):
    """Hot camera 'a' with dense and empty stretches and ties; 'b' sparse; 'c' a single row."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        camera = rng.choices("abc", (80, 19, 1))[0]
        hours = rng.choice((0, 0, 0, 1, 5, 30, 31)) + (rng.randrange(400) if camera == "b" else 0)
        secs = hours * 3600 + rng.randrange(40) * 90
        rows.append((i, camera, 1704067200 + secs, round(rng.random(), 3)))
    rows.append((1000, "d", 1704067200, 0.5))
    df = spark.createDataFrame(rows, "frame_id long, camera string, s long, score double").select(
        "frame_id", "camera", F.timestamp_seconds("s").alias("ts"), "score")
    ordered = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    return df, ordered


def by_camera(ordered):
    groups = {}
    for r in ordered:
        groups.setdefault(r[1], []).append(r)
    return groups


def test_confirmation(history):
    df, ordered = history
    want = {}
    for rows in by_camera(ordered).values():
        for j, r in enumerate(rows):
            want[r[0]] = tuple(
                min(x[3] for x in rows[j - n + 1:j + 1]) if j >= n - 1 else None for n in (2, 3, 5))
    got = timeline.confirmed_scores(df, (2, 3, 5)).collect()
    assert {r.frame_id: (r.confirmed_2, r.confirmed_3, r.confirmed_5) for r in got} == want


def test_run_lengths(history):
    df, ordered = history
    want = {}
    for rows in by_camera(ordered).values():
        run = 0
        for r in rows:
            run = run + 1 if r[3] > 0.15 else 0
            want[r[0]] = run
    got = timeline.run_lengths(df, F.col("score") > 0.15, "camera", tie="frame_id").collect()
    assert {r.frame_id: r.run for r in got} == want
    wrapped = timeline.run_lengths(
        df, F.col("score") > 0.15, "camera", tie="frame_id", wrap_at=4).collect()
    assert {r.frame_id: r.run for r in wrapped} == {k: v % 4 for k, v in want.items()}


def test_hour_change_cap(spark, history):
    df, ordered = history
    want = set()
    for rows in by_camera(ordered).values():
        last, sent = None, 0
        for r in rows:
            hour = r[2] // 3600 % 24
            if hour != last:
                last, sent = hour, 0
            if sent < 2:
                sent += 1
                want.add(r[0])
    got = timeline.capped_alerts(df, "camera", tie="frame_id", mode="hour_change").collect()
    assert {r.frame_id for r in got} == want


def test_running_totals_and_percentiles(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.9 else "cold", rng.choice((rng.random(), 0.25, 1e-7 * rng.random())))
            for _ in range(3000)]
    df = spark.createDataFrame(rows, "part string, v double")
    got = {r.part: (r.p10, r.p50, r.p99) for r in ranking.lower_rank_percentiles(
        df, "v", (0.1, 0.5, 0.99), ["part"]).collect()}
    for part in ("hot", "cold"):
        vs = sorted(v for p, v in rows if p == part)
        assert got[part] == tuple(vs[int(p * (len(vs) - 1))] for p in (0.1, 0.5, 0.99))


def test_curve_points_with_ties_and_few_negatives(spark):
    rng = random.Random(5)
    rows = [("big", rng.randrange(256) / 256, int(rng.random() < 0.3)) for _ in range(2000)]
    rows += [("small", 0.4, 0), ("small", 0.3, 1), ("positive_only", 0.9, 1), ("positive_only", 1.0, 1)]
    df = spark.createDataFrame(rows, "part string, score double, label int")
    got = {(r.part, r.fpr_target): (r.umbral, r.recall) for r in curves.curve_points(
        df, "score", "label", ["part"]).collect()}
    for part in ("big", "small", "positive_only"):
        neg = sorted((s for p, s, y in rows if p == part and y == 0), reverse=True)
        pos = [s for p, s, y in rows if p == part and y == 1]
        for f in (0.10, 0.01, 0.0034, 0.001, 0.00032):
            k = int(f * len(neg))
            t = neg[k] if k < len(neg) else 1.0
            assert got[part, f] == pytest.approx(
                (round(t, 4), round(sum(s >= t for s in pos) / len(pos), 4)), abs=1e-4)


@pytest.mark.parametrize("grid", ["patch", "frame"])
def test_levels_at_grid_values(spark, grid):
    """Scores on, just below and just above every threshold fall on the right side."""
    import math

    from plumewatch import constants as C

    ts = C.PATCH_GRID if grid == "patch" else C.FRAME_GRID
    scores = [v for t in ts for v in (math.nextafter(t, 0), t, math.nextafter(t, 1))] + [0.0, 1.0, -1.0, 2.0]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    got = [r[0] for r in df.select(metrics.level(F.col("s"), ts)).collect()]
    assert got == [sum(s >= t for t in ts) for s in scores]


def brute_overlap(w, b):
    ix = max(0.0, min(w[4], b[4]) - max(w[2], b[2]))
    iy = max(0.0, min(w[5], b[5]) - max(w[3], b[3]))
    return ix * iy / max(1.0, (b[4] - b[2]) * (b[5] - b[3]))


@pytest.mark.parametrize("dense_rows,hot_rows", [(200, 1_000_000), (50, 1_000_000), (0, 20)])
def test_overlap_with_a_hot_frame(spark, dense_rows, hot_rows):
    rng = random.Random(11)

    def rects(n, small):
        out = []
        for i in range(n):
            frame = 1 if rng.random() < 0.6 else rng.randrange(2, 12)
            x, y = rng.uniform(-20, 1200), rng.uniform(-20, 650)
            side = rng.uniform(1, 60) if small else rng.uniform(190, 360)
            out.append((frame, i, x, y, x + side, y + side))
        return out

    ws, bs = rects(60, False), rects(200, True)
    bs.append((1, 999, 160.0, 160.0, 160.0, 320.0))  # no area
    edges = "x0 double, y0 double, x1 double, y1 double"
    w = spark.createDataFrame(ws, f"frame_id long, window_id int, {edges}")
    b = spark.createDataFrame(bs, f"frame_id long, box_id int, {edges}")
    want = {(x[0], x[1], y[1]) for x in ws for y in bs if x[0] == y[0] and brute_overlap(x, y) > 0.1}
    got = overlap.overlapping_pairs(w, b, 0.1, dense_rows, hot_rows).collect()
    assert len(got) == len(want)
    assert {(r.frame_id, r.window_id, r.box_id) for r in got} == want
    touched = {x[:2] for x in ws for y in bs if x[0] == y[0] and brute_overlap(x, y) > 0}
    free = overlap.untouched_windows(
        w, b, dense_rows=dense_rows, hot_rows=hot_rows).collect()
    assert {(r.frame_id, r.window_id) for r in free} == {x[:2] for x in ws} - touched


def test_negative_windows_spend_the_whole_budget(spark):
    """Crowded frames need late attempts; a covered frame yields none."""
    boxes = [[(i * 80.0, 0.0, i * 80.0 + 30, 720.0) for i in range(0, 9)],
             [(0.0, 0.0, 1280.0, 720.0)], []]
    rows = [(k, boxes[k % 3]) for k in range(60)]
    kind = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
    df = spark.createDataFrame(rows, f"frame_id long, boxes {kind}").withColumn(
        "width", F.lit(1280)).withColumn("height", F.lit(720))
    tried = df.select("frame_id", "boxes", "width", "height", F.inline(geo.random_windows(
        "sequence(0, if(size(boxes) > 0, 74, 99))"))).collect()
    want = {}
    for r in sorted(tried, key=lambda r: (r.frame_id, r.attempt)):
        v = (0, 0, r.win.x0, r.win.y0, r.win.x1, r.win.y1)
        if all(brute_overlap(v, (0, 0, *b)) <= 0 for b in r.boxes):
            want.setdefault(r.frame_id, []).append(r.attempt)
    got = {}
    for r in sampling.negative_windows(df).collect():
        got.setdefault(r.frame_id, []).append((r.item, r.attempt))
    for k in range(60):
        quota = 3 if boxes[k % 3] else 4
        assert [a for _, a in sorted(got.get(k, []))] == want.get(k, [])[:quota]
    assert any(a > 10 for k in got for _, a in got[k])


def _held_negatives(spark, rows, id_type="long", size="double"):
    """Windows of odd frames by the search in batches, and by SQL expressions over the whole budget."""
    kind = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
    df = spark.createDataFrame(rows, f"frame_id {id_type}, width {size}, height {size}, boxes {kind}")
    every = F.filter(geo.random_windows("sequence(0, if(size(boxes) > 0, 75, 100) - 1)"),
                     lambda s: ~geo.touches_any(s.win, F.col("boxes")))
    want = df.withColumn("quota", sampling.negative_quota(F.col("boxes"))).select(
        "*", F.slice(every, F.lit(1), F.col("quota")).alias("negatives"))

    def listed(d):
        return sorted((str(r.frame_id), repr(r.negatives or [])) for r in d.select("frame_id", "negatives").collect())

    got = sampling.with_negative_windows(df)
    assert got.schema["negatives"].dataType.simpleString() == want.schema["negatives"].dataType.simpleString()
    assert listed(got) == listed(want)
    return got


def test_negative_windows_of_odd_frames(spark):
    """Missing, endless and many boxes, sizes that are missing, ids of other types: as the SQL expressions say."""
    nan, inf = float("nan"), float("inf")
    odd = [[], None, [(600.0, 300.0, 700.0, 400.0)], [(nan, 0.0, nan, 720.0)], [(0.0, 0.0, nan, 720.0)],
           [(-inf, 300.0, inf, 320.0)], [(None, 0.0, None, 30.0)], [(600.0, None, 700.0, 400.0), (0.0, 0.0, 30.0, 30.0)],
           [(i * 13.0 % 1280, i * 7.0 % 720, i * 13.0 % 1280 + 2, i * 7.0 % 720 + 2) for i in range(700)],
           [(0.0, 0.0, 1280.0, 720.0)], [(i * 1.0, 0.0, i + 1.0, 10.0) for i in range(1280)]]
    sizes = [(1280.0, 720.0), (200.0, 200.0), (None, 720.0), (1280.0, None)]
    rows = [(k, *sizes[k // 11 % 4], odd[k % 11]) for k in range(220)]
    got = _held_negatives(spark, rows)
    assert {len(r.negatives or []) for r in got.collect()} >= {0, 3, 4}
    _held_negatives(spark, [(f"é{k}" if k % 5 else None, *r[1:]) for k, r in enumerate(rows)], "string")
    _held_negatives(spark, [(k, 1280, 720, r[3]) for k, r in enumerate(rows)], "int", "int")
    assert sampling.with_negative_windows(got.where("frame_id < 0").select("frame_id", "width", "height", "boxes")).isEmpty()


def test_no_window_is_drawn_in_vain(monkeypatch):
    """A frame's attempts end with the window that fills its quota, or with its budget; boxes are compared in slices."""
    drawn, draw = [], sampling._drawn_windows
    monkeypatch.setattr(sampling, "PAIRS", 50)
    monkeypatch.setattr(sampling, "_drawn_windows", lambda heads, attempts, *size: (
        drawn.extend(zip(heads, attempts.tolist())), draw(heads, attempts, *size))[1])
    boxes = [[], [(600.0, 300.0, 700.0, 400.0)], [(0.0, 0.0, 1280.0, 720.0)],
             [(i * 10.0, 0.0, i * 10.0 + 2, 60.0) for i in range(128)]]
    held = [[dict(zip(sampling.EDGES, b)) for b in boxes[k % 4]] for k in range(200)]
    quota = [3 if b else 4 for b in held]
    kind = pa.list_(pa.struct([(e, pa.float64()) for e in sampling.EDGES]))
    # a slice of longer columns, as batches may be
    cut = [pa.array(c[:1] + c, t).slice(1) for c, t in (
        ([f"42:window:{k}" for k in range(200)], pa.string()), ([1280] * 200, pa.int32()), ([720] * 200, pa.int32()),
        (held, kind), (quota, pa.int32()))]
    found = sampling._first_free(*cut).to_pylist()
    tries = {}
    for head, attempt in drawn:
        tries.setdefault(head, []).append(attempt)
    for k in range(200):
        made, got = tries[b"42:window:%d" % k], [n["attempt"] for n in found[k]]
        full = len(got) == quota[k]
        assert sorted(made) == list(range(got[-1] + 1 if full else quota[k] * 25))
        assert full or len(got) < quota[k]
    assert {len(f) for f in found[2::4]} == {0} and len(found[0]) == 4
    monkeypatch.setattr(sampling, "PAIRS", 1 << 20)
    assert sampling._first_free(*cut).to_pylist() == found


def test_jittered_windows_hold_their_box(spark):
    rng = random.Random(2)
    kind = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
    rows = []
    for k in range(50):
        x, y, w, h = rng.uniform(0, 1100), rng.uniform(0, 600), rng.uniform(5, 180), rng.uniform(5, 110)
        rows.append((k, [(x, y, x + w, y + h)]))
    df = spark.createDataFrame(rows, f"frame_id long, boxes {kind}").withColumn(
        "width", F.lit(1280)).withColumn("height", F.lit(720))
    out = sampling.box_windows(df).collect()
    assert len(out) == 100
    for r in out:
        assert r.win.x0 <= r.box.x0 + 1e-9 and r.win.x1 >= r.box.x1 - 1e-9
        assert r.win.y0 <= r.box.y0 + 1e-9 and r.win.y1 >= r.box.y1 - 1e-9
        assert 0 <= r.win.x0 and r.win.x1 <= 1280 and 0 <= r.win.y0 and r.win.y1 <= 720.0001
    single = df.select(F.col("frame_id"), geo.window_around(
        F.col("boxes")[0], F.col("width"), F.col("height"),
        geo.jitter_draws(F.col("frame_id"), F.lit(0))).alias("win")).collect()
    staged = {r.frame_id: r.win for r in out if r.crop == 1}
    for r in single:
        assert tuple(staged[r.frame_id]) == pytest.approx(tuple(r.win))


def test_samples_do_not_depend_on_partitioning(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("label"))
    one, many = df.coalesce(1), df.repartition(13)
    assert sampling.fixed_sample(one, "k", 50).collect() == sampling.fixed_sample(many, "k", 50).collect()
    a, b = (sorted(sampling.class_sample(d, "label", "k", 24).collect()) for d in (one, many))
    assert a == b and len(a) == 72
    orders = [sorted(sampling.epoch_order(d, "k", e).collect()) for d in (one, many) for e in (0, 1)]
    assert orders[0] == orders[2] and orders[1] == orders[3] and orders[0] != orders[1]
    sizes = {}
    for r in orders[0]:
        sizes[r.batch_id] = sizes.get(r.batch_id, 0) + 1
    assert sorted(sizes) == list(range(47)) and set(list(sizes.values())[:46]) <= {64, 56}


def test_ranks_of_tiny_and_odd_values(spark):
    """Scores piled up near zero and outside [0, 1] are ranked exactly and spread over many cells."""
    rng = random.Random(9)
    vs = [rng.choice((10 ** rng.uniform(-9, -6), -10 ** rng.uniform(-9, 3), 10 ** rng.uniform(0, 30), 0.0, 5e-324))
          for _ in range(4000)] + [float("inf"), -float("inf")]
    df = spark.createDataFrame([(v,) for v in vs], "v double")
    got = ranking.lower_rank_percentiles(df, "v", (0.01, 0.5, 0.9, 1.0)).first()
    order = sorted(vs)
    assert tuple(got) == tuple(order[int(p * (len(vs) - 1))] for p in (0.01, 0.5, 0.9, 1.0))
    cells = df.where("v > 0 AND v < 1e-3 AND v > 1e-300").distinct().groupBy(
        ranking.value_cell(F.col("v")).alias("c")).count()
    total, most = cells.agg(F.sum("count"), F.max("count")).first()
    assert most <= 0.02 * total
    placed = [(r.c, r.v) for r in df.select("v", ranking.value_cell(F.col("v")).alias("c")).orderBy("v").collect()]
    assert [c for c, _ in placed] == sorted(c for c, _ in placed)


@pytest.mark.parametrize("dense_rows", [200, 0])
def test_awkward_rectangles_and_repeated_windows(spark, dense_rows):
    """NULL edges, giant boxes and windows with one key give the same rows on both paths."""
    edges = "x0 double, y0 double, x1 double, y1 double"
    w = spark.createDataFrame(
        [(1, 1, 0.0, 0.0, 50.0, 50.0), (1, 1, 0.0, 0.0, 50.0, 50.0), (1, 1, 900.0, 0.0, 950.0, 50.0),
         (1, 2, None, 0.0, 50.0, 50.0), (2, 1, 0.0, 0.0, 200.0, 200.0), (2, 2, -9e6, -9e6, -8e6, -8e6),
         (3, 1, 5.0, 5.0, 6.0, 6.0)], f"frame_id long, window_id int, {edges}")
    b = spark.createDataFrame(
        [(1, 1, 920.0, 10.0, 930.0, 20.0), (1, 2, None, None, None, None), (2, 1, -1e6, -1e6, 1e6, 1e6),
         (2, 2, 3e6, 3e6, 4e6, 4e6)], f"frame_id long, box_id int, {edges}")
    free = overlap.untouched_windows(w, b, dense_rows=dense_rows).collect()
    assert sorted((r.frame_id, r.window_id, r.x0 or -1) for r in free) == [
        (1, 1, -1), (1, 1, -1), (1, 2, -1), (2, 2, -9e6), (3, 1, 5.0)]
    pairs = overlap.overlapping_pairs(w, b, 0.0, dense_rows).collect()
    assert sorted((r.frame_id, r.window_id, r.box_id) for r in pairs) == [(1, 1, 1), (2, 1, 1)]


def _largest_cell(w, b):
    placed = overlap._sides(w, b, overlap.DENSE_ROWS, overlap.HOT_ROWS)[1]
    sizes = [r["count"] for r in placed.groupBy("frame_id", "_salt", "_cx", "_cy").count().collect()]
    return max(sizes), sum(sizes)


def test_cells_of_a_dense_frame_follow_its_boxes(spark):
    """Boxes far out of any fixed grid, with an outlier, and boxes on one spot."""
    rnd = random.Random(8)

    def rects(n, draw, size):
        return [("f", x, y, x + rnd.randrange(5, size), y + rnd.randrange(5, size))
                for x, y in ((draw(), draw()) for _ in range(n))]

    def tables(boxes):
        windows = [(f"w{i}", *r) for i, r in enumerate(rnd.sample(boxes, 60))] + [("far", "f", -9, -9, -1, -1)]
        w = spark.createDataFrame(windows, "window_id string, frame_id string, x0 long, y0 long, x1 long, y1 long")
        b = spark.createDataFrame([(i, *r) for i, r in enumerate(boxes)],
                                  "box_id int, frame_id string, x0 long, y0 long, x1 long, y1 long")
        got = {(r.window_id, r.box_id) for r in overlap.overlapping_pairs(w, b).collect()}
        assert got == {(x[0], i) for x in windows for i, y in enumerate(boxes)
                       if min(x[4], y[3]) > max(x[2], y[1]) and min(x[5], y[4]) > max(x[3], y[2])}
        free = {r.window_id for r in overlap.untouched_windows(w, b).collect()}
        assert free == {x[0] for x in windows} - {p[0] for p in got}
        return _largest_cell(w, b)

    spread = rects(3000, lambda: rnd.randrange(20_000, 400_000), 300) + [("f", -10**8, -10**8, 10**8, 10**8)]
    largest, placed = tables(spread)
    assert largest < 30 and placed < 3000 * 2 + 64 * 64
    largest, placed = tables(rects(1500, lambda: 50_000 + rnd.randrange(20), 100))
    assert placed <= 1500 * 4


def test_kth_scores_sort_a_few_tiles_of_a_frame(spark, sf):
    """Tiles of a frame that stand together are cut down before the sort; a batch border may part a frame."""
    tiles = V.tile_scores(spark, sf)
    left = rules._leading(tiles.select("frame_id", "tile_id", "score"), "score", 3)
    assert 3000 <= left.count() <= 3000 + 3 * 8


def test_kth_scores_of_scattered_and_odd_tiles(spark):
    """A hot frame, frames of one or two tiles, ties, missing and infinite scores and NaN, rows of a frame apart."""
    rng = random.Random(5)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.5, 0.5]
    rows = [(rng.choice([1, 1, 1, i, None]), i % 40, rng.choice(odd) if i % 9 == 0 else rng.random()) for i in range(900)]
    even = [(f, t, s) for f, t, s in rows if s is not None and s == s]
    for held in (rows, even):
        df = spark.createDataFrame(held, "frame_id long, tile_id int, score double").repartition(5)
        want = {}
        for f, _, s in held:
            want.setdefault(f, []).append(s)
        order = lambda s: (s is None, 0 if s is None else 0 if s != s else 1, 0 if s is None or s != s else -s)
        want = {f: [str(s) for s in (sorted(v, key=order) + [None] * 3)[:3]] for f, v in want.items()}
        got = {r[0]: [str(s) for s in r[1:]] for r in rules.kth_scores(df).collect()}
        assert got == want
