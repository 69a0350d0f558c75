"""Shapes of physical plans that must hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from plumewatch import session
from plumewatch.operators import rules, sampling
from plumewatch.plans import catalog, score_queries, views as V
from plumewatch.sources import footers
from plumewatch.sources import frames as src

LAZY = [n for n in catalog.QUERIES if n[0] != "T"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join(spark, sf, name):
    text = plan(catalog.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_patch_build_needs_no_shuffle_of_its_own(spark, sf):
    frames = V.frames_from(V.table(spark, sf, "orders"))
    df = frames.select("frame_id", "camera", "partner", F.lit(1280).alias("width"),
                       F.lit(720).alias("height"),
                       F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
                       .alias("boxes"))
    assert "Exchange" not in plan(sampling.all_patches(df))


def test_tile_coverage_needs_no_join(spark, sf):
    assert "Join" not in plan(catalog.QUERIES["J3_tile_box_coverage"](spark, sf))


@pytest.mark.parametrize("name", ["J1_window_box_overlap", "J2_untouched_windows"])
def test_windows_are_not_sent_through_the_driver(spark, sf, name):
    """The tables are small by the estimate, which does not see that a generator makes rows."""
    text = plan(catalog.QUERIES[name](spark, sf))
    assert "SortMergeJoin" in text
    # only dense frames are broadcast, a written table
    sent = re.findall(r"BroadcastExchange.*\n(.*)\n(.*)", text)
    assert sent and all("_xs" in "".join(below) for below in sent)


@pytest.mark.parametrize("name", [
    "W1_temporal_confirmation", "W2_run_lengths", "W9_suffix_counts", "K4_frame_operating_point"])
def test_tiles_are_hashed_by_frame_not_sorted(spark, sf, name, monkeypatch):
    """Stored frames are looked at before they are written."""
    plans = []
    monkeypatch.setattr(score_queries, "materialize", lambda df, label: plans.append(plan(df)) or df)
    plans.append(plan(catalog.QUERIES[name](spark, sf)))
    # the aggregates of tiles are the ones above the scan
    assert all("SortAggregate" not in text for text in plans) and "HashAggregate" in plans[0]
    frames = plans[0][plans[0].rindex("HashAggregate"):]
    assert "Sort [" not in frames


def test_capture_results_hash_their_tiles(spark, sf):
    text = plan(catalog.QUERIES["G6_capture_result"](spark, sf))
    assert "HashAggregate" in text and "SortAggregate" not in text and "Sort [" not in text


def test_best_tile_of_odd_frames(spark):
    """Highest score, then lowest tile; missing and negative scores, and errors, are never the best."""
    tiles = spark.createDataFrame([
        (1, 5, 50, 51, 900, False), (1, 2, 20, 21, 900, False), (1, 0, 1, 2, 999, True), (1, 9, 3, 4, None, False),
        (2, 0, 7, 8, None, False), (3, 0, 7, 8, 0, False), (4, 0, 7, 8, -5, False), (5, 2**31 - 1, 7, 8, 1, False)],
        "frame_id long, tile_id int, x int, y int, prob_x1000 int, error boolean")
    got = {r.frame_id: tuple(r)[1:6] for r in rules.capture_result(tiles).collect()}
    assert got == {1: (4, 0, 900, 20, 21), 2: (1, 0, 0, -1, -1), 3: (1, 0, 0, -1, -1), 4: (1, 0, -5, -1, -1),
                   5: (1, 0, 1, 7, 8)}


def test_files_are_not_dealt_by_library(spark, sf):
    """Tables over the broadcast threshold: a library holds a large share of all files."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        text = plan(catalog.QUERIES["J10_fleet_differences"](spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in text and not re.search(r"hashpartitioning\(library#\d+, \d", text)


def test_only_tiles_that_become_patches_are_made(spark, sf):
    text = plan(V.patch_scores(spark, sf))
    assert "Generate explode(array(" in text
    # the part of a camera is found once for a capture
    assert text.rindex("md5(cast(camera") > text.index("Generate explode")


def test_scores_of_a_frame_read_one_digest_for_each_tile(spark, sf):
    frames = V.frame_tile_scores(spark, sf)
    assert plan(frames).count("md5(") == 1
    flat = frames.select("frame_id", F.posexplode("scores").alias("tile_id", "score"))
    assert flat.exceptAll(V.tile_scores(spark, sf).select("frame_id", "tile_id", "score")).isEmpty()


def test_top_k_is_trimmed_before_the_shuffle(spark, sf):
    text = plan(rules.kth_scores(V.tile_scores(spark, sf)))
    partial = text.index(", Partial")
    assert text.index("Exchange hashpartitioning(frame_id") < partial
    assert "WindowGroupLimit" in plan(catalog.QUERIES["A2_per_file_limit"](spark, sf))


def test_frame_scan_reads_no_image_bytes(spark, sf, tmp_path):
    path = str(tmp_path / "frames")
    V.frames(spark, sf).drop("frame_id").write.parquet(path)
    held = src.read_frames(spark, path).where(F.col("partner") == "sdis-77").select(
        "camera", "annotations")
    text = plan(held)
    assert "bytes" not in re.search(r"ReadSchema: (.*)", text).group(1)
    assert "EqualTo(partner,sdis-77)" in text


def test_sweep_reads_its_scores_once(spark, sf):
    text = plan(catalog.QUERIES["G5_threshold_sweep"](spark, sf))
    assert text.count("FileScan") == 1


def test_corrupt_shard_stops_or_is_listed(spark, sf, tmp_path):
    path = tmp_path / "frames"
    V.frames(spark, sf).drop("frame_id").repartition(2).write.parquet(str(path))
    n = src.read_frames(spark, str(path)).count()
    (path / "broken.parquet").write_bytes(b"PAR1 not a table")
    with pytest.raises(Exception, match="broken.parquet"):
        src.read_frames(spark, str(path)).select("camera", "annotations").collect()
    frames, short = src.read_frames_and_short_shards(spark, str(path))
    assert frames.count() == n
    assert [(r.path.rsplit("/", 1)[1], r.length, r.rows, r.rows_read) for r in short.collect()] == [
        ("broken.parquet", 16, None, 0)]


def test_shards_go_by_their_full_path(spark, sf, tmp_path):
    """Equal names in two folders, one of them with a space; the later row groups of one shard are damaged."""
    frames = V.frames(spark, sf).drop("frame_id")
    for folder in ("day=a b+c", "day=2"):
        frames.limit(450).coalesce(1).write.option("parquet.block.size", 1).parquet(str(tmp_path / "in" / folder))
        shard, = (tmp_path / "in" / folder).glob("*.parquet")
        shard.rename(shard.with_name("part-0.parquet"))
        (shard.parent / f".{shard.name}.crc").unlink()
    whole = footers.read_footers(spark, str(tmp_path / "in")).collect()
    assert len(whole) == 2 and all(r.readable and r.rows == 450 and r.row_groups > 2 for r in whole)
    _, short = src.read_frames_and_short_shards(spark, str(tmp_path / "in"))
    assert short.isEmpty()
    shard = tmp_path / "in" / "day=2" / "part-0.parquet"
    data = bytearray(shard.read_bytes())
    at = footers.first_byte(str(shard), 1)
    data[at:at + 64] = b"\xff" * 64
    shard.write_bytes(data)
    found, = src.read_frames_and_short_shards(spark, str(tmp_path / "in"))[1].collect()
    assert found.path.endswith("/day=2/part-0.parquet") and found.readable and found.rows_read < found.rows == 450


@pytest.mark.parametrize("name", LAZY)
def test_no_round_robin(spark, sf, name):
    assert "RoundRobin" not in plan(catalog.QUERIES[name](spark, sf))


def test_per_file_limit_over_several_files(spark, tmp_path):
    path = str(tmp_path / "shards")
    spark.range(100).repartition(3).write.parquet(path)
    df = spark.read.parquet(path).select("id", F.col("_metadata.file_name").alias("file"))
    counts = [r["count"] for r in src.per_file_limit(df, "file", "id", 7).groupBy("file").count().collect()]
    assert counts == [7, 7, 7]


def test_a_half_written_table_is_never_read(spark):
    """Nothing points to a folder whose builder died; the next one builds anew, and later ones read."""
    made = []

    def build():
        made.append(1)
        return spark.range(5)

    def dies():
        raise RuntimeError("lost")

    key = session.scratch_path(spark, "key")
    with pytest.raises(RuntimeError):
        session.build_or_read(dies, spark, "kept", key)
    assert session.build_or_read(build, spark, "kept", key).count() == 5
    assert session.build_or_read(build, spark, "kept", key).count() == 5 and len(made) == 1
    # a builder that comes second leaves the first one's table in place
    def slow():
        other = session.build_or_read(build, spark, "kept", key + "2")
        return other.unionByName(other)

    assert session.build_or_read(slow, spark, "kept", key + "2").count() == 5
