"""Streams fed in several micro-batches against their batch twins."""

import pytest
from pyspark.sql import functions as F

from plumewatch.operators import timeline
from plumewatch.plans import views as V
from plumewatch.schemas import EVENTS
from plumewatch.session import scratch_path
from plumewatch.operators import rules
from plumewatch.operators.rules import capture_result
from plumewatch.streaming import captures, state, sweeps
from plumewatch.streaming.uplinks import decode_available

FILES = 4


@pytest.fixture(scope="module")
def split_events(spark, sf):
    """The event table cut into files in time order, each read as one micro-batch."""
    path = scratch_path(spark, "split-events")
    events = V.table(spark, sf, "events")
    for i in range(FILES):
        part = events.where(F.floor(F.col("event_id") * FILES / 1000) == i)
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)


def timed(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_earliest_alerts_pass_whatever_the_order_of_batches(spark, sf, tmp_path):
    """Files with rows of all times: the same as the batch operator."""
    path = str(tmp_path / "mixed")
    events = V.table(spark, sf, "events")
    for i in (2, 0, 3, 1):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i).coalesce(1).write.mode(
            "append").parquet(path)
    got, late = state.capped_alerts(timed(V.alerts_from(stream(spark, path))), delay="60 days")
    got = got.select("node_id", "event_id", "rank")
    assert late.isEmpty()
    want = timeline.capped_alerts(V.alerts_from(events)).select("node_id", "event_id", "rank")
    assert rows(got) == rows(want)
    tiles = timed(V.tiles_of(V.captures_from(stream(spark, path))))
    frames, late = captures.capture_alerts(tiles, delay="60 days")
    assert late.isEmpty()
    batch = capture_result(V.tile_scores(spark, sf))
    assert rows(frames.select(batch.columns)) == rows(batch)


def test_alert_cap_across_batches(spark, sf, split_events):
    got = state.capped_alerts(timed(V.alerts_from(stream(spark, split_events))))[0].select("node_id", "event_id", "rank")
    want = timeline.capped_alerts(V.alerts_from(V.table(spark, sf, "events"))).select(
        "node_id", "event_id", "rank")
    assert rows(got) == rows(want)


def scored(df):
    return V.telemetry_from(df).select(
        "event_id", F.col("node_id").cast("string").alias("camera"), "ts",
        (F.col("prob_x1000") / 1000.0).alias("score"))


def test_confirmation_across_batches(spark, sf, split_events):
    got = state.confirmed_stream(scored(stream(spark, split_events)), (2, 3), tie="event_id")
    want = timeline.confirmed_scores(scored(V.table(spark, sf, "events")), (2, 3), tie="event_id")
    cols = ["event_id", "confirmed_2", "confirmed_3"]
    got, want = ({r[0]: r[1:] for r in d.select(cols).collect()} for d in (got, want))
    assert len(got) == 1000 and got == want


def test_runs_across_batches(spark, sf, split_events):
    hit = F.col("score") >= 0.2
    got = state.run_length_stream(scored(stream(spark, split_events)), hit, "camera")
    want = timeline.run_lengths(scored(V.table(spark, sf, "events")), hit, "camera")
    assert rows(got.select("event_id", "run")) == rows(want.select("event_id", "run"))


def test_runs_go_on_after_a_restart(spark, sf, tmp_path):
    """A second drain of the same folder sees only new files and carries the old runs on."""
    path, folder = str(tmp_path / "in"), str(tmp_path / "run")
    events = V.table(spark, sf, "events")
    hit = F.col("score") >= 0.2
    for low, high in ((0, 300), (300, 1000)):
        events.where(F.col("event_id").between(low, high - 1)).coalesce(1).write.mode(
            "append").parquet(path)
        got = state.run_length_stream(scored(stream(spark, path)), hit, "camera", folder=folder)
    want = timeline.run_lengths(scored(events), hit, "camera")
    assert rows(got.select("event_id", "run")) == rows(want.select("event_id", "run"))


def test_decode_across_batches(spark, sf, split_events):
    good, bad = decode_available(V.uplinks_from(stream(spark, split_events)))
    ids = {r[0] for r in good.select("uplink_id").collect()}
    broken = {r[0] for r in bad.select("uplink_id").collect()}
    assert ids | broken == set(range(1000)) and not ids & broken


def test_every_tile_is_in_a_frame_or_in_the_late_table(spark, tmp_path):
    path, folder = str(tmp_path / "tiles"), str(tmp_path / "run")
    tile = "frame_id long, ts timestamp, tile_id int, x int, y int, prob_x1000 int"

    def put(*batch):
        spark.createDataFrame(
            [(f, None, t, 7, 8, p, s) for f, s, t, p in batch], tile + ", s long"
        ).withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode(
            "append").parquet(path)
        tiles = spark.readStream.schema(tile).parquet(path)
        frames, late = captures.capture_alerts(tiles, folder=folder)
        return ({r.frame_id: tuple(r)[1:] for r in frames.collect()},
                sorted((r.frame_id, r.tile_id, r.prob_x1000) for r in late.collect()))

    base = 1704067200
    frames, late = put((1, base, 1, 990), (1, base, 0, 980), (2, base + 60, 0, 0))
    assert frames == {1: (2, 2, 990, 7, 8, True), 2: (1, 0, 0, -1, -1, False)} and late == []
    frames, late = put((1, base, 2, None), (3, base + 7200, 0, 10))  # frame 1 is open until this batch has been read
    assert frames[1] == (3, 2, 990, 7, 8, True) and late == []
    frames, late = put((1, base, 3, 999), (4, base + 20000, 0, 1), (3, base + 7200, 1, 10), (9, base + 5, 4, 1000))
    assert frames[1] == (3, 2, 990, 7, 8, True) and frames[3][:2] == (2, 0) and frames[4][:2] == (1, 0)
    assert late == [(1, 3, 999), (9, 4, 1000)] and 9 not in frames


def test_frames_of_a_stream_have_no_state_of_their_own(spark, sf, tmp_path):
    """Frames are as many as captures, so no worker is called for each; a replayed batch counts once."""
    path, folder = str(tmp_path / "in"), str(tmp_path / "run")
    events = V.table(spark, sf, "events")
    for low, high in ((0, 500), (500, 1000)):
        events.where(F.col("event_id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(path)
        tiles = timed(V.tiles_of(V.captures_from(spark.readStream.schema(EVENTS).parquet(path))))
        frames, late = captures.capture_alerts(tiles, delay="60 days", folder=folder)
    assert not (tmp_path / "run" / "state" / "state").exists()
    (tmp_path / "run" / "state" / "commits" / "1").unlink()
    for crc in (tmp_path / "run" / "state" / "commits").glob(".1*"):
        crc.unlink()
    frames, late = captures.capture_alerts(tiles, delay="60 days", folder=folder)
    batch = capture_result(V.tile_scores(spark, sf))
    assert rows(frames.select(batch.columns)) == rows(batch) and late.isEmpty()


def test_alerts_in_any_order_are_capped_or_late(spark, sf, tmp_path):
    """Shuffled files: the cap over what was in time and the late table make up all alerts."""
    path, folder = str(tmp_path / "in"), str(tmp_path / "run")
    events = V.table(spark, sf, "events")
    for i in (1, 3, 0, 2):
        events.where(F.floor(F.col("event_id") / 250) == i).coalesce(1).write.mode("append").parquet(path)
        capped, late = state.capped_alerts(timed(V.alerts_from(spark.readStream.schema(EVENTS).parquet(path))),
                                           folder=folder)
    gone = {r.event_id for r in late.collect()}
    alerts = V.alerts_from(events)
    assert gone and len(gone) == late.count()
    want = timeline.capped_alerts(alerts.where(~F.col("event_id").isin(list(gone)))).select("node_id", "event_id", "rank")
    assert rows(capped.select("node_id", "event_id", "rank")) == rows(want)
    assert gone <= {r.event_id for r in alerts.collect()}


def test_any_order_of_batches_ends_with_the_batch_result(spark, sf, tmp_path):
    """Rows of all times in every file: late rows change their hour and what its carry reaches, no more."""
    path, folders = str(tmp_path / "in"), [str(tmp_path / n) for n in ("runs", "confirmed")]
    # few cameras, so that runs reach over hours
    events = V.table(spark, sf, "events").withColumn("user_id", F.col("user_id") % 3)
    hit = F.col("score") >= 0.1
    versions = []
    for i in range(4):
        events.where(F.pmod(F.xxhash64("event_id", F.lit(1)), F.lit(4)) == i).coalesce(1).write.mode(
            "append").parquet(path)
        runs = state.run_length_stream(scored(stream(spark, path)), hit, "camera", folder=folders[0])
        versions.append({r.event_id: (r.run, r.version) for r in runs.collect()})
        confirmed = state.confirmed_stream(scored(stream(spark, path)), (2, 3), tie="event_id", folder=folders[1])
    want = {r.event_id: r.run for r in timeline.run_lengths(scored(events), hit, "camera").collect()}
    assert {e: run for e, (run, _) in versions[-1].items()} == want and max(want.values()) > 20
    cols = ["event_id", "confirmed_2", "confirmed_3"]
    batch = timeline.confirmed_scores(scored(events), (2, 3), tie="event_id")
    assert rows(confirmed.select(cols)) == rows(batch.select(cols))
    # a value that changed has a newer version, and some hours were left alone by the last file
    for old, new in zip(versions, versions[1:]):
        assert all(new[e][1] > v for e, (run, v) in old.items() if new[e][0] != run)
    assert any(v < 3 for _, v in versions[-1].values())


def test_leaderboard_after_every_batch_and_after_a_replay(spark, sf, tmp_path):
    """Few cameras and mixed batches: late frames take back what the frames after them had confirmed."""
    path, folder = str(tmp_path / "in"), str(tmp_path / "run")
    events = V.table(spark, sf, "events").withColumn("user_id", F.col("user_id") % 3)
    mixed = F.pmod(F.xxhash64("event_id"), F.lit(3))
    for i in range(3):
        events.where(mixed == i).coalesce(1).write.mode("append").parquet(path)
        got = sweeps.leaderboard_stream(V.scored_frames_of(V.captures_from(stream(spark, path))), folder=folder)
        want = rules.leaderboard(rules.effective_scores_of_frames(
            V.scored_frames_of(V.captures_from(events.where(mixed <= i)))))
        assert rows(got.na.fill(-1)) == rows(want.na.fill(-1))
        assert spark.read.parquet(f"{folder}/levels/v{i}").count() <= 5 * 200
    # the last batch fails after its writes and runs again
    (tmp_path / "run" / "state" / "commits" / "2").unlink()
    for crc in (tmp_path / "run" / "state" / "commits").glob(".2*"):
        crc.unlink()
    got = sweeps.leaderboard_stream(V.scored_frames_of(V.captures_from(stream(spark, path))), folder=folder)
    assert rows(got.na.fill(-1)) == rows(want.na.fill(-1))
