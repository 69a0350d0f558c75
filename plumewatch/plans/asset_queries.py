"""Queries over reports, histories, file trees and pixels."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumewatch.functions.geometry import box_struct
from plumewatch.functions.hashing import digest, unit
from plumewatch.operators import metrics, pixels, rollup, snapshots
from plumewatch.plans import views as V
from plumewatch.plans.registry import query
from plumewatch.plans.score_queries import (
    _OPERATION_SQL, POINT_COLS, _both_models, operating_points, precision_loss)
from plumewatch.session import materialize, scratch_path
from plumewatch.sources import reports

# ---------------------------------------------------------------- histories and reports

EPOCHS = 20
PHASE_TWO = 6


def _history(spark, sf):
    """Training logs of EPOCHS lines per run, in two phases, derived from events."""
    e = F.col("event_id")
    step = e % EPOCHS
    h = digest("run", e)
    cols = ["auc_pr", "exactitud", "loss", "precision", "recall",
            "val_auc_pr", "val_exactitud", "val_loss", "val_precision", "val_recall"]
    draws = [F.round(unit(digest(c, e), 0), 6).alias(c) for c in cols if c != "val_auc_pr"]
    metric = F.round(0.5 + 0.02 * step + 0.2 * unit(h, 0), 6).alias("val_auc_pr")
    return V.columns(spark, sf, "events", "event_id").select(
        F.floor(e / EPOCHS).alias("run"), step.alias("line"),
        F.when(step < PHASE_TWO, step).otherwise(step - PHASE_TWO).cast("int").alias("epoch"),
        *draws, metric)


_METRIC = f"round(0.5::DOUBLE+0.02::DOUBLE*line+0.2::DOUBLE*{V.sql_unit('h', 0)},6)"


OTHERS = ("auc_pr", "exactitud", "loss", "precision", "recall", "val_exactitud", "val_loss",
          "val_precision", "val_recall")


def _others_sql() -> str:
    return ", ".join(
        f"sum(round({V.sql_unit(f'md5({chr(39)}{c}:{chr(39)}||event_id)', 0)}*1000000)::BIGINT)::BIGINT AS {c}_sum"
        for c in OTHERS)


@query("A5_history_csv", "", f"""
SELECT event_id//20%8 AS model, count(*) AS epochs, sum(round({_METRIC}*1000000)::BIGINT)::BIGINT AS metric_sum,
 {_others_sql()} FROM (SELECT event_id, event_id%20 AS line, md5('run:'||event_id) AS h FROM events) GROUP BY model""")
def history_csv(spark, sf):
    """Logs as CSV files in one folder per model, read back with a fixed schema."""
    path = scratch_path(spark, "history")
    columns = [f.name for f in reports.S.HISTORY.fields]
    _history(spark, sf).select((F.col("run") % 8).alias("model"), *columns).write.partitionBy(
        "model").option("header", True).csv(path)
    logs = reports.read_history(spark, path).withColumn(
        "model", F.regexp_extract("run", r"model=(\d+)", 1).cast("bigint"))
    return logs.groupBy("model").agg(
        F.count("val_auc_pr").alias("epochs"),
        F.sum(F.round(F.col("val_auc_pr") * 1000000).cast("bigint")).alias("metric_sum"),
        *[F.sum(F.round(F.col(c) * 1000000).cast("bigint")).alias(f"{c}_sum") for c in OTHERS])


SUMMARY_SQL = f"""
WITH t AS (SELECT event_id//20 AS run, line, CASE WHEN line<6 THEN 1 ELSE 2 END AS phase, CASE WHEN line<6 THEN line ELSE line-6 END AS epoch,
 {_METRIC} AS m FROM (SELECT event_id, event_id%20 AS line, md5('run:'||event_id) AS h FROM events)),
b AS (SELECT *, max(m) OVER (PARTITION BY run, phase ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t),
s AS (SELECT *, epoch-max(CASE WHEN before IS NULL OR m>before THEN epoch END) OVER (PARTITION BY run, phase ORDER BY line ROWS UNBOUNDED PRECEDING) AS stale FROM b)
SELECT run, phase, arg_max(epoch, m) AS best_epoch, max(m) AS best, min(CASE WHEN stale>=4 THEN epoch END) AS stop_epoch, count(*) AS epochs FROM s GROUP BY run, phase"""


@query("W7_training_summary", "", SUMMARY_SQL)
def training_summary(spark, sf):
    return reports.training_summary(_history(spark, sf)).withColumn(
        "phase", F.col("phase").cast("int"))


@query("W7_summary_of_files", "", SUMMARY_SQL)
def summary_of_files(spark, sf):
    """The logs as files of many runs, each run behind a header line, scanned and summarised in line order."""
    path = scratch_path(spark, "logs")
    columns = [f.name for f in reports.S.HISTORY.fields]
    held = _history(spark, sf)
    lines = held.select("run", "line", F.to_csv(F.struct(*columns)).alias("value")).unionByName(
        held.select("run").distinct().select("run", F.lit(-1).cast("long").alias("line"), F.lit(",".join(columns)).alias(
            "value")))
    lines.repartitionByRange("run").sortWithinPartitions("run", "line").select("value").write.text(path)
    out = reports.training_summary(reports.read_history_logs(spark, path), ["file", "run_no"], ("block", "line"))
    # files hold ranges of runs in the order of their names: a row for each file
    out = materialize(out, "log-summaries")
    files = out.groupBy("file").agg((F.max("run_no") + 1).alias("n"))
    first = files.select("file", (F.sum("n").over(W.orderBy("file")) - F.col("n")).alias("first"))
    return out.join(first, "file").select((F.col("first") + F.col("run_no")).alias("run"), F.col("phase").cast(
        "int").alias("phase"), "best_epoch", "best", "stop_epoch", "epochs")


def _evaluation_rows(spark, sf):
    half = metrics.with_rates(metrics.confusion(
        _both_models(spark, sf), "score", "label", (0.5,), ["precision_kind", "part"]))
    cols = POINT_COLS.split(",")
    return half.select("precision_kind", "part", F.lit("umbral_0.5").alias("point"), *cols
                       ).unionByName(operating_points(spark, sf).select(
                           "precision_kind", "part", F.lit("operacion").alias("point"), *cols))


@query("A6_evaluation_report", "patch_scores patch_scores_b", f"""WITH {_OPERATION_SQL}
SELECT 'cam_model' AS modelo, precision_kind, part, 'operacion' AS point, {POINT_COLS} FROM operation
UNION ALL SELECT 'cam_model', precision_kind, part, 'umbral_0.5', {POINT_COLS} FROM swept WHERE umbral=0.5::DOUBLE""")
def evaluation_report(spark, sf):
    """Write the nested report document, then scan and flatten it."""
    points = _evaluation_rows(spark, sf)
    values = F.struct(*POINT_COLS.split(","))

    def nest(df, keys, name, value):
        # a handful of parts, kinds and points exist
        return df.groupBy(*keys).agg(
            F.map_from_entries(F.collect_list(F.struct(name, value))).alias("m"))

    kinds = nest(points, ["part", "precision_kind"], "point", values)
    parts = nest(kinds, ["part"], "precision_kind", F.col("m"))
    doc = nest(parts.withColumn("modelo", F.lit("cam_model")), ["modelo"], "part", F.col("m"))
    path = scratch_path(spark, "evaluation")
    doc.select(F.to_json(F.struct("modelo", F.col("m").alias("resultados"))).alias("value")
               ).write.text(path)
    return reports.read_evaluation(spark, path)


@query("A7_report_sink", "patch_scores patch_scores_b", f"""WITH {_OPERATION_SQL}
SELECT a.part, a.umbral AS umbral_float32, a.f1 AS f1_float32, b.umbral AS umbral_int8, b.f1 AS f1_int8, round(b.f1-a.f1,4) AS f1_loss
FROM operation a JOIN operation b USING (part) WHERE a.precision_kind='float32' AND b.precision_kind='int8'""")
def report_sink(spark, sf):
    rows = precision_loss(spark, sf)
    path = scratch_path(spark, "report")
    reports.write_report(rows, path)
    return spark.read.schema(rows.schema).json(path)


# ---------------------------------------------------------------- trees

@query("A14_file_tree", "", """
SELECT 'lang='||lang||'/source='||source AS folder, sha256(count(*)||chr(10)) AS hash, count(*) AS documents
FROM documents GROUP BY lang, source""")
def file_tree(spark, sf):
    """Store one small text file per (lang, source), then list and hash the tree."""
    path = scratch_path(spark, "tree")
    d = V.table(spark, sf, "documents").groupBy("lang", "source").agg(
        F.count(F.lit(1)).cast("string").alias("value"))
    d.write.partitionBy("lang", "source").text(path)
    tree = reports.read_tree(spark, path).where(F.col("path").endswith(".txt"))
    text = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("value").cast("bigint").alias("documents"),
        F.col("_metadata.file_path").alias("file"))
    name = F.substring_index("file", "/", -1)
    return tree.select("path", "hash").join(
        text, F.substring_index("path", "/", -1) == name).where(
        F.expr("endswith(file, path)")).select(
        F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "hash", "documents")


_DIFF_SQL = """SELECT path, CASE WHEN b.hash IS NULL THEN 'falta' WHEN a.hash IS NULL THEN 'sobra' ELSE 'distinto' END AS problem
FROM tree_a a FULL OUTER JOIN tree_b b USING (path) WHERE a.hash IS DISTINCT FROM b.hash"""


@query("J9_tree_difference", "tree_a tree_b", _DIFF_SQL)
def tree_difference(spark, sf):
    return snapshots.tree_differences(V.tree_a(spark, sf), V.tree_b(spark, sf))


def _foldered(tree):
    """Ids as paths of three levels."""
    number = F.col("path").cast("bigint")
    return tree.select(F.concat_ws("/", F.floor(number / 10000).cast("string"), F.floor(number / 100).cast("string"),
                                   "path").alias("path"), "hash")


@query("J9_folder_difference", "tree_a tree_b", f"""
SELECT (path::BIGINT//10000)||'/'||(path::BIGINT//100)||'/'||path AS path, problem FROM ({_DIFF_SQL})""")
def folder_difference(spark, sf):
    """Both trees with their stored roll-ups; equal folders are settled by one digest."""
    a, b = _foldered(V.tree_a(spark, sf)), _foldered(V.tree_b(spark, sf))
    return rollup.folder_differences(a, b, materialize(rollup.roll_up(a), "rolled-tree"),
                                     materialize(rollup.roll_up(b), "rolled-tree"))


@query("J10_fleet_verdict", "copies masters", """
WITH size AS (SELECT library, count(*) AS files FROM masters GROUP BY library),
m AS (SELECT c.copy_id, c.library, count(*) AS files, count_if(m.path IS NULL) AS extra, coalesce(count_if(m.hash<>c.hash),0) AS different
 FROM copies c LEFT JOIN masters m ON m.library=c.library AND m.path=c.path GROUP BY ALL)
SELECT copy_id, m.library, m.files, coalesce(s.files,0)-(m.files-extra) AS missing, extra, different,
 CASE WHEN s.files IS NULL THEN 'no master' WHEN s.files-(m.files-extra)+extra+different=0 THEN 'equal' ELSE 'differs' END AS verdict
FROM m LEFT JOIN size s ON s.library=m.library""")
def fleet_verdict(spark, sf):
    return snapshots.fleet_verdict(V.copies(spark, sf), V.masters(spark, sf))


@query("J10_fleet_differences", "copies masters", """
WITH want AS (SELECT c.copy_id, m.* FROM (SELECT DISTINCT copy_id, library FROM copies) c JOIN masters m USING (library)),
have AS (SELECT * FROM copies WHERE library IN (SELECT library FROM masters))
SELECT copy_id, library, path, CASE WHEN h.hash IS NULL THEN 'falta' WHEN w.hash IS NULL THEN 'sobra' ELSE 'distinto' END AS problem
FROM want w FULL OUTER JOIN have h USING (copy_id, library, path) WHERE w.hash IS DISTINCT FROM h.hash""")
def fleet_differences(spark, sf):
    return snapshots.fleet_differences(V.copies(spark, sf), V.masters(spark, sf))


@query("U2_paths_only_in_one", "tree_a tree_b", """
SELECT 'a' AS side, path FROM (SELECT path FROM tree_a EXCEPT SELECT path FROM tree_b)
UNION ALL SELECT 'b', path FROM (SELECT path FROM tree_b EXCEPT SELECT path FROM tree_a)""")
def paths_only_in_one(spark, sf):
    return snapshots.one_sided(V.tree_a(spark, sf), V.tree_b(spark, sf))


@query("U3_paths_in_both", "tree_a tree_b", "SELECT path FROM tree_a INTERSECT SELECT path FROM tree_b")
def paths_in_both(spark, sf):
    return snapshots.in_both(V.tree_a(spark, sf), V.tree_b(spark, sf))


# ---------------------------------------------------------------- pixels

RASTER_WIDTH = 32


def _weights_sql(name: str, source: str, length: str, out: int) -> str:
    """Integer triangle-filter weights of every axis length found in `source`."""
    return f"""
 {name}_c AS (SELECT n, i, (i+0.5::DOUBLE)*(n/{out}.0::DOUBLE) AS c, greatest(n/{out}.0::DOUBLE,1) AS reach
  FROM (SELECT DISTINCT {length} AS n FROM {source}) CROSS JOIN range({out}) r(i)),
 {name}_t AS (SELECT *, unnest(range(greatest(trunc(c-reach+0.5::DOUBLE),0)::BIGINT, least(trunc(c+reach+0.5::DOUBLE),n)::BIGINT)) AS t FROM {name}_c),
 {name}_w AS (SELECT n, i, t, greatest(0,1-abs((t-c+0.5::DOUBLE)*(1/reach))) AS w FROM {name}_t),
 {name} AS (SELECT n, i, t, floor(w/sum(w) OVER (PARTITION BY n, i)*4194304+0.5::DOUBLE)::BIGINT AS k FROM {name}_w)"""


_CLIP = "least(255,greatest(0,(sum(k*v)::BIGINT+2097152)>>22))"


@query("P1_patch_extraction", "", f"""
WITH docs AS (SELECT doc_id, hex(encode(text)) AS hx, greatest(1,(octet_length(encode(text))+95)//96) AS h FROM documents),
 lines AS (SELECT doc_id, h, r, rpad(substr(hx,r*192+1,192),192,'0') AS seg FROM (SELECT *, unnest(range(h)) AS r FROM docs)),
 px AS (SELECT doc_id, h, r, j//3 AS x, j%3 AS ch, ('0x'||substr(seg,j*2+1,2))::BIGINT AS v FROM (SELECT *, unnest(range(96)) AS j FROM lines)),
 {_weights_sql('across', 'docs', '32', 16)}, {_weights_sql('down', 'docs', 'h', 16)},
 mid AS (SELECT doc_id, h, r, i AS ix, ch, {_CLIP} AS v FROM px JOIN across ON t=x GROUP BY doc_id, h, r, i, ch),
 patch AS (SELECT doc_id, i AS iy, ix, ch, {_CLIP} AS v FROM mid JOIN down ON n=h AND t=r GROUP BY doc_id, i, ix, ch)
SELECT doc_id, count(*) AS n_bytes, sum(v)::BIGINT AS level_sum, sum(v*((iy*16+ix)*3+ch+1))::BIGINT AS weighted_sum FROM patch GROUP BY doc_id""")
def patch_extraction(spark, sf):
    """Each document's bytes as an RGB raster of fixed width (padded to whole rows), resampled."""
    raw = F.col("text").cast("binary")
    row = RASTER_WIDTH * 3
    height = F.greatest(F.lit(1), F.ceil(F.length(raw) / row)).cast("int")
    hexed = F.rpad(F.hex(raw), height * row * 2, "0")
    d = V.columns(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", F.unhex(hexed).alias("data"), height.alias("height"),
        F.lit(RASTER_WIDTH).alias("width"), F.array(box_struct(
            F.lit(0.0), F.lit(0.0), F.lit(float(RASTER_WIDTH)), height.cast("double")))
        .alias("windows"))
    return pixels.level_sums(pixels.extract_patches(d, out=16)).select(
        "doc_id", "n_bytes", "level_sum", "weighted_sum")


@query("P2_batched_scoring", "", """
WITH x AS (SELECT vec_id, label=0 AS y, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding,1) AS i FROM embeddings),
m AS (SELECT i, avg(v) FILTER (WHERE y) AS a, avg(v) FILTER (WHERE NOT y) AS b FROM x GROUP BY i),
bias AS (SELECT -sum((a-b)*(a+b)/2) AS c FROM m)
SELECT vec_id, round(1/(1+exp(-(sum(v*(a-b))+any_value(c)))),6) AS score FROM x JOIN m USING (i) CROSS JOIN bias GROUP BY vec_id""")
def batched_scoring(spark, sf):
    e = V.columns(spark, sf, "embeddings", "vec_id", "embedding", "label")
    weights, bias = pixels.centroid_weights(e, "embedding", F.col("label") == 0)
    score = pixels.score_with(pixels.logistic_model(weights, bias), F.col("embedding"))
    return e.select("vec_id", F.round(score, 6).alias("score"))
