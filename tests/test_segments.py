"""Records and runs of large text files, cut by splits at any place."""

import pytest
from pyspark.sql import functions as F

from plumewatch import schemas as S
from plumewatch.operators.segments import read_lines, with_record
from plumewatch.operators.sampling import epoch_order
from plumewatch.sources import epochs, reports
from plumewatch.sources.telemetry import read_passes

PASS = "[nodo] 2024-01-0{} 08:1{}  SoC=50%  capturas={}"
CAPTURE = "[nodo] teselas=32 sobre={} pmax=0.125 (168,336) remuestreo=10ms inferencia=20ms"
UPLINK = "[lora] uplink fport=10 fcnt={} payload=0102"


@pytest.fixture(params=[120, 333, 1 << 27])
def splits(spark, request):
    """Splits of so many bytes."""
    names = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    old = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], request.param)
    spark.conf.set(names[1], 1)
    yield request.param
    for n, v in zip(names, old):
        spark.conf.set(n, v)


def test_passes_across_splits(spark, splits, tmp_path):
    want = set()
    for name in ("a.log", "b.log"):
        lines = [CAPTURE.format(9), UPLINK.format(999)]  # before the first pass
        want.add((name, None, None, 9, (999,)))
        for i in range(25):
            lines.append(PASS.format(i % 9 + 1, i % 6, i))
            lines += ["boot"] * (i % 3)
            if i % 4:
                lines += [CAPTURE.format(i), CAPTURE.format(31)]
            ups = tuple(range(i, i + (i % 11)))
            lines += [UPLINK.format(u) for u in ups]
            want.add((name, i, i, i if i % 4 else None, ups))
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    got = read_passes(spark, str(tmp_path))
    assert {(r.file.rsplit("/", 1)[1], r.record_no, r.captures, r.tiles_over, tuple(u.fcnt for u in r.uplinks))
            for r in got.collect()} == want
    assert got.count() == len(want)
    if splits < 1000:
        assert read_lines(spark, str(tmp_path)).select("file", "block").distinct().count() > 6


def test_runs_across_splits(spark, splits, tmp_path):
    """Two files of runs with two phases each; a run's rows go across several splits."""
    names = S.HISTORY.fieldNames()
    rows = {}
    for name, runs in (("x.csv", 7), ("y.csv", 3)):
        lines = []
        for run in range(runs):
            lines.append(",".join(names))
            for i in range(20):
                epoch = i if i < 6 else i - 6
                values = [epoch if n == "epoch" else round((run * 31 + i * 7) % 50 / 64, 6) for n in names]
                lines.append(",".join(map(str, values)))
                rows.setdefault((name, run), []).append(tuple(values))
        (tmp_path / name).write_text("\n".join(lines) + "\n\n")
    logs = reports.read_history_logs(spark, str(tmp_path))
    got = {}
    for r in sorted(logs.collect(), key=lambda r: (r.file, r.block, r.line)):
        got.setdefault((r.file.rsplit("/", 1)[1], r.run_no), []).append(tuple(r)[:len(names)])
    assert {k: [tuple(float(x) for x in v) for v in rows] for k, rows in got.items()} == {
        k: [tuple(float(x) for x in v) for v in some] for k, some in rows.items()}
    found = reports.training_summary(logs, ["file", "run_no"], ("block", "line")).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.run_no, r.phase, r.epochs) for r in found) == sorted(
        (name, run, phase, n) for name, run in rows for phase, n in ((1, 6), (2, 14)))


def test_a_record_longer_than_many_splits(spark, splits, tmp_path):
    (tmp_path / "one.txt").write_text("head\n" + "".join(f"row {i}\n" for i in range(400)))
    out = with_record(read_lines(spark, str(tmp_path)), F.col("value") == "head")
    assert out.where("record_no = 0").count() == 401 and out.select("open_block", "open_line").distinct().count() == 1
    none = with_record(read_lines(spark, str(tmp_path)), F.col("value") == "absent")
    assert none.where("record_no is null and open_line is null").count() == 401


@pytest.mark.parametrize("rows,batches", [(1003, 2), (20_001, 40)])
def test_epoch_files_hold_the_epoch_in_order(spark, tmp_path, rows, batches):
    df = spark.range(rows).select((F.col("id") * 3).alias("i"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    path = str(tmp_path / "epoch")
    epochs.write_epoch(df.repartition(5), path, "i", 3, batches=batches)
    want = sorted((r.batch_id, r.i) for r in epoch_order(df, "i", 3).collect())
    files = sorted(p for p in (tmp_path / "epoch").iterdir() if p.suffix == ".parquet")
    read, most = [], 0
    for file in files:  # as a trainer would
        part = [(r.batch_id, r.i) for r in spark.read.parquet(str(file)).collect()]
        most, read = max(most, len(part)), read + part
    assert read == want and len(files) > 3 and most < rows / 2
    got = epochs.read_epoch(spark, path).collect()
    assert [(r.batch_id, r.i) for r in sorted(got, key=lambda r: r.position)] == want
    assert sorted(r.position for r in got) == list(range(rows))


def test_small_files_of_a_long_epoch_are_bounded(spark, tmp_path, monkeypatch):
    """Each file is a task that reports to the driver; the order of a long epoch stays the same in larger files."""
    assert [epochs.n_files(n, 16) for n in (1, 16, 17, 1563, 562_500, 5_625_000)] == [1, 1, 2, 98, 256, 1374]
    assert epochs.n_files(9000) == 3 and epochs.n_files(9000, 8192) == 2
    monkeypatch.setattr(epochs, "FILES", 4)
    monkeypatch.setattr(epochs, "BATCHES", 60)
    df = spark.range(20_001).select((F.col("id") * 3).alias("i"))
    path = str(tmp_path / "epoch")
    epochs.write_epoch(df.repartition(5), path, "i", 3, batches=2)
    files = [p for p in (tmp_path / "epoch").iterdir() if p.suffix == ".parquet"]
    want = sorted((r.batch_id, r.i) for r in epoch_order(df, "i", 3).collect())
    assert 4 < len(files) <= epochs.n_files(want[-1][0] + 1, 2) < 20
    got = sorted(epochs.read_epoch(spark, path).collect(), key=lambda r: r.position)
    assert [(r.batch_id, r.i) for r in got] == want and [r.position for r in got] == list(range(20_001))
