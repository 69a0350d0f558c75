"""Queries over tile and patch scores: scoring, metrics, rules, curves, captures over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumewatch import constants as C
from plumewatch.functions import scoring
from plumewatch.functions.geometry import tile_grid
from plumewatch.functions.hashing import between, digest, hex_int, unit
from plumewatch.operators import curves, metrics, rules, sampling, timeline
from plumewatch.plans import views as V
from plumewatch.plans.registry import query
from plumewatch.session import build_or_read, materialize, table_state

# ---------------------------------------------------------------- SQL pieces

RATES = """round(tp/greatest(1,tp+fn),4) AS recall, round(tp/greatest(1,tp+fp),4) AS precision,
 round(2*(tp/greatest(1,tp+fp))*(tp/greatest(1,tp+fn))/greatest(1e-9::DOUBLE,tp/greatest(1,tp+fp)+tp/greatest(1,tp+fn)),4) AS f1,
 round(fp/greatest(1,fp+tn),4) AS fpr, round((tp+tn)/greatest(1,tp+fp+fn+tn),4) AS exactitud"""
COUNTS = """count_if(score>=umbral AND y=1) AS tp, count_if(score>=umbral AND y=0) AS fp,
 count_if(NOT coalesce(score>=umbral,false) AND y=1) AS fn, count_if(NOT coalesce(score>=umbral,false) AND y=0) AS tn"""
PATCH_GRID = "(SELECT (10+5*i)/1000.0::DOUBLE AS umbral FROM range(197) r(i))"
FRAME_GRID = "(SELECT (5+i)/100.0::DOUBLE AS umbral FROM range(95) r(i))"


def sweep_sql(name: str, scores: str, keys: str, grid: str, label: str = "label") -> str:
    """Brute force: every score against every threshold."""
    return f"""{name} AS (SELECT *, {RATES} FROM (SELECT {keys}, umbral, {COUNTS}
 FROM (SELECT {keys}, {label}::INT AS y, score FROM {scores}) CROSS JOIN {grid} GROUP BY {keys}, umbral))"""


POINT_COLS = "umbral,tp,fp,fn,tn,recall,precision,f1,fpr,exactitud"

# ---------------------------------------------------------------- scans of score tables


@query("A10_tile_table", "tile_scores model_b_scores", """
SELECT 'A' AS model, count(*) AS tiles, count(DISTINCT frame_id) AS frames, sum(b)::BIGINT AS level_sum,
 count(DISTINCT x*10000+y) AS corners FROM tile_scores
UNION ALL SELECT 'B', count(*), count(DISTINCT frame_id), sum(b)::BIGINT, count(DISTINCT x*10000+y) FROM model_b_scores""")
def tile_table(spark, sf):
    """Tiles are cut once and stored under their frame size and input, then scored by two models.

    A later call over the same table reads them.
    """
    w, h = C.FRAME_SIZE

    def cut():
        return V.captures(spark, sf).select(
            "frame_id", "smoke", F.posexplode(tile_grid(F.lit(w), F.lit(h))).alias("tile_id", "t")).select(
            "frame_id", "smoke", "tile_id", "t.x", "t.y")

    held = table_state(spark, f"{sf.rstrip('/')}/events.parquet")
    tiles = build_or_read(cut, spark, "tiles", f"{w}x{h}:{C.WINDOW_PX}:{C.OVERLAP}:{held}")
    key = [F.col("frame_id"), F.col("tile_id")]
    rows = tiles.select("*", F.inline(F.array(
        F.struct(F.lit("A").alias("model"), digest(*key).alias("h")),
        F.struct(F.lit("B").alias("model"), digest("B", *key).alias("h")))))
    b1, b2 = hex_int(F.col("h"), 1, 2), hex_int(F.col("h"), 3, 2)
    planted = F.col("smoke") & (F.col("tile_id") == F.col("frame_id") % V.TILES)
    b = F.when(planted, F.greatest(b1, b2)).otherwise(F.floor(b1 * b2 / 256))
    per_corner = rows.withColumn("b", b).groupBy("model", "x", "y").agg(
        F.count(F.lit(1)).alias("n"), F.sum("b").alias("s"),
        F.count_if(F.col("tile_id") == 0).alias("f"))
    return per_corner.groupBy("model").agg(
        F.sum("n").alias("tiles"),
        F.sum("f").alias("frames"),
        F.sum("s").alias("level_sum"), F.count(F.lit(1)).alias("corners"))


# ---------------------------------------------------------------- scoring projections

SCALE, ZERO = 1 / 256, -128


@query("Q1_dequantize", "patch_scores", """
SELECT frame_id, tile_id, round((b-128+128)*(1/256.0::DOUBLE),6) AS score FROM patch_scores""")
def dequantize(spark, sf):
    y = F.col("b") - 128
    return V.patch_scores(spark, sf).select(
        "frame_id", "tile_id", F.round(scoring.dequantize(y, SCALE, ZERO), 6).alias("score"))


@query("Q2_quantize", "", """
SELECT vec_id, i, greatest(-128,least(127,round_even(x/0.004::DOUBLE+3,0)::INT)) AS q FROM (
 SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding,1)-1 AS i FROM embeddings)""")
def quantize(spark, sf):
    e = V.columns(spark, sf, "embeddings", "vec_id", "embedding")
    return e.select("vec_id", F.posexplode("embedding").alias("i", "x")).select(
        "vec_id", "i", scoring.quantize(F.col("x").cast("double"), 0.004, 3).alias("q"))


@query("Q3_per_mille", "patch_scores", """
SELECT frame_id, tile_id, (b*1000+128)//256 AS prob_x1000 FROM patch_scores""")
def per_mille(spark, sf):
    return V.patch_scores(spark, sf).select(
        "frame_id", "tile_id", scoring.per_mille(F.col("b") - 128).alias("prob_x1000"))


@query("Q5_capture_fpr", "patch_scores", """
SELECT camera, f, round(1-pow(1-f,31),6) AS capture_31, round(1-pow(1-f,32),6) AS capture_32 FROM (
 SELECT camera, round(count_if(score>=0.9)/greatest(1,count(*)),6) AS f FROM patch_scores WHERE label=0 GROUP BY camera)""")
def capture_fpr(spark, sf):
    per_camera = V.patch_scores(spark, sf).where("label = 0").groupBy("camera").agg(F.round(
        F.count_if(F.col("score") >= 0.9) / F.greatest(F.lit(1), F.count(F.lit(1))), 6).alias("f"))
    return per_camera.select(
        "camera", "f", F.round(scoring.capture_fpr(F.col("f"), 31), 6).alias("capture_31"),
        F.round(scoring.capture_fpr(F.col("f"), 32), 6).alias("capture_32"))


@query("Q6_tile_fpr_needed", "tile_scores", """
SELECT camera, big, round(1-pow(1-big,1.0::DOUBLE/31),6) AS tile_fpr FROM (
 SELECT camera, round(count_if(m>=0.95)/greatest(1,count(*)),6) AS big FROM (
 SELECT camera, frame_id, max(score) AS m FROM tile_scores WHERE NOT smoke GROUP BY ALL) GROUP BY camera)""")
def tile_fpr_needed(spark, sf):
    t = V.tile_scores(spark, sf).where(~F.col("smoke"))
    frames = t.groupBy("camera", "frame_id").agg(F.max("score").alias("m"))
    return frames.groupBy("camera").agg(F.round(
        F.count_if(F.col("m") >= 0.95) / F.greatest(F.lit(1), F.count(F.lit(1))), 6).alias("big")
    ).select("camera", "big",
             F.round(scoring.tile_fpr_for(F.col("big"), 31), 6).alias("tile_fpr"))


_CURVE_SQL = """
 ranked AS (SELECT part, score, row_number() OVER (PARTITION BY part ORDER BY score DESC)-1 AS i FROM patch_scores WHERE label=0),
 sizes AS (SELECT part, count_if(label=0) AS n, count_if(label=1) AS p FROM patch_scores GROUP BY part),
 goals AS (SELECT part, n, p, f::DOUBLE AS fpr_target, trunc(f::DOUBLE*n)::BIGINT AS k FROM sizes
  CROSS JOIN (VALUES (0.10),(0.01),(0.0034),(0.001),(0.00032)) v(f)),
 cut AS (SELECT g.*, coalesce(r.score,1.0::DOUBLE) AS t FROM goals g LEFT JOIN ranked r ON r.part=g.part AND r.i=g.k),
 curve AS (SELECT part, fpr_target, round(t,4) AS umbral, round((SELECT count(*) FROM patch_scores s WHERE s.part=cut.part
  AND label=1 AND score>=t)/greatest(1,p),4) AS recall FROM cut)"""


def _curve(spark, sf):
    return curves.curve_points(V.patch_scores(spark, sf), "score", "label", ["part"])


@query("Q7_detection_delay", "patch_scores", f"""WITH {_CURVE_SQL}
SELECT part, fpr_target, m AS captures, m*15 AS minutes, round(1-pow(1-recall,m),4) AS detected
FROM curve CROSS JOIN (VALUES (1),(2),(4),(8),(12)) v(m)""")
def detection_delay(spark, sf):
    return curves.detection_delay(_curve(spark, sf)).select(
        "part", "fpr_target", "captures", "minutes", "detected")


@query("Q8_false_alarms", "patch_scores", f"""WITH {_CURVE_SQL}
SELECT part, fpr_target, round(1-pow(1-fpr_target,31),4) AS capture_fpr, round((1-pow(1-fpr_target,31))*48,4) AS false_per_day FROM curve""")
def false_alarms(spark, sf):
    return curves.detection_delay(_curve(spark, sf), captures=(1,)).select(
        "part", "fpr_target", "capture_fpr", "false_per_day")


# ---------------------------------------------------------------- confusion and sweeps

@query("G3_confusion_counts", "patch_scores", f"""
SELECT part, umbral, {COUNTS} FROM (SELECT part, label AS y, score FROM patch_scores)
CROSS JOIN (VALUES (0.5::DOUBLE),(0.97::DOUBLE)) v(umbral) GROUP BY part, umbral""")
def confusion_counts(spark, sf):
    return metrics.confusion(V.patch_scores(spark, sf), "score", "label", (0.5, 0.97), ["part"])


@query("G4_confusion_rates", "patch_scores", f"""
SELECT *, {RATES} FROM (SELECT camera, umbral, {COUNTS} FROM (SELECT camera, label AS y, score FROM patch_scores)
CROSS JOIN (VALUES (0.5::DOUBLE),(0.97::DOUBLE)) v(umbral) GROUP BY camera, umbral)""")
def confusion_rates(spark, sf):
    return metrics.with_rates(metrics.confusion(
        V.patch_scores(spark, sf), "score", "label", (0.5, 0.97), ["camera"]))


@query("G5_threshold_sweep", "patch_scores",
       f"WITH {sweep_sql('s', 'patch_scores', 'part', PATCH_GRID)} SELECT part,{POINT_COLS} FROM s")
def threshold_sweep(spark, sf):
    return metrics.sweep(V.patch_scores(spark, sf), "score", "label", C.PATCH_GRID, ["part"])


RESULT_SQL = """
SELECT frame_id, count(*) AS tiles_total, count_if(prob_x1000>=970) AS tiles_over, max(prob_x1000) AS prob_max_x1000,
 CASE WHEN max(prob_x1000)>0 THEN arg_max(x, prob_x1000*100-tile_id) ELSE -1 END AS x_max,
 CASE WHEN max(prob_x1000)>0 THEN arg_max(y, prob_x1000*100-tile_id) ELSE -1 END AS y_max"""


@query("G6_capture_result", "tile_scores", """
WITH t AS (SELECT *, (frame_id*7+tile_id)%9 AS ms_r, (frame_id+tile_id*11)%40 AS ms_i, (frame_id*32+tile_id)%997=0 AS bad FROM tile_scores)
SELECT frame_id, count(*) AS tiles_total, count_if(NOT bad AND prob_x1000>=970) AS tiles_over,
 coalesce(max(prob_x1000) FILTER (WHERE NOT bad),0) AS prob_max_x1000,
 CASE WHEN max(prob_x1000) FILTER (WHERE NOT bad)>0 THEN arg_max(x, prob_x1000*100-tile_id) FILTER (WHERE NOT bad) ELSE -1 END AS x_max,
 CASE WHEN max(prob_x1000) FILTER (WHERE NOT bad)>0 THEN arg_max(y, prob_x1000*100-tile_id) FILTER (WHERE NOT bad) ELSE -1 END AS y_max,
 sum(ms_r)::BIGINT AS ms_resample, sum(ms_i)::BIGINT AS ms_infer, bool_or(bad) AS error FROM t GROUP BY frame_id""")
def capture_result(spark, sf):
    f, t = F.col("frame_id"), F.col("tile_id")
    tiles = V.tile_scores(spark, sf).withColumns({
        "ms_resample": (f * 7 + t) % 9, "ms_infer": (f + t * 11) % 40,
        "error": (f * 32 + t) % 997 == 0})
    return rules.capture_result(tiles).drop("alert")


@query("G7_frame_maximum", "tile_scores",
       "SELECT frame_id, max(score) AS score FROM tile_scores GROUP BY frame_id")
def frame_maximum(spark, sf):
    return V.tile_scores(spark, sf).groupBy("frame_id").agg(F.max("score").alias("score"))


@query("G8_kth_score", "tile_scores", """
WITH r AS (SELECT frame_id, score, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC) AS r FROM tile_scores)
SELECT frame_id, max(score) FILTER (WHERE r=1) AS top_1, max(score) FILTER (WHERE r=2) AS top_2,
 max(score) FILTER (WHERE r=3) AS top_3, count_if(score>=0.6) AS tiles_at_060 FROM r GROUP BY frame_id""")
def kth_score(spark, sf):
    frames = V.frame_tile_scores(spark, sf)
    return frames.select("frame_id", *rules.top_columns(F.col("scores")), F.size(F.filter(
        "scores", lambda s: s >= 0.6)).alias("tiles_at_060"))


@query("G8_kth_score_long", "tile_scores", """
WITH r AS (SELECT frame_id, score, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC) AS r FROM tile_scores)
SELECT frame_id, max(score) FILTER (WHERE r=1) AS top_1, max(score) FILTER (WHERE r=2) AS top_2,
 max(score) FILTER (WHERE r=3) AS top_3 FROM r GROUP BY frame_id""")
def kth_score_long(spark, sf):
    """The form for a long tile table whose rows of a frame may lie apart."""
    return rules.kth_scores(V.tile_scores(spark, sf))


@query("G9_capture_alert", "tile_scores", """
SELECT frame_id, count_if(prob_x1000>=970)>=1 AS alert_1, count_if(prob_x1000>=620)>=2 AS alert_2,
 count_if(prob_x1000>=320)>=3 AS alert_3, false AS alert_0 FROM tile_scores GROUP BY frame_id""")
def capture_alert(spark, sf):
    def enough(threshold, k):
        return (F.count_if(F.col("prob_x1000") >= threshold) >= k) & F.lit(k > 0)

    return V.tile_scores(spark, sf).groupBy("frame_id").agg(
        enough(970, 1).alias("alert_1"), enough(620, 2).alias("alert_2"),
        enough(320, 3).alias("alert_3"), enough(970, 0).alias("alert_0"))


@query("G10_class_weights", "patch_scores", """
SELECT label, n, round(sum(n) OVER ()/(2*n),4) AS weight FROM (SELECT label, count(*) AS n FROM patch_scores GROUP BY label)""")
def class_weights(spark, sf):
    return metrics.class_weights(V.patch_scores(spark, sf), "label")


@query("G11_fpr_by_provenance", "patch_scores", """
SELECT umbral, round(fd,4) AS fpr_duro, round(fl,4) AS fpr_limpio, round(fd/greatest(fl,1e-6::DOUBLE),4) AS ratio, n_duro, n_limpio FROM (
 SELECT umbral, count_if(source='duro' AND score>=umbral)/greatest(1,count_if(source='duro')) AS fd,
 count_if(source='limpio' AND score>=umbral)/greatest(1,count_if(source='limpio')) AS fl,
 count_if(source='duro') AS n_duro, count_if(source='limpio') AS n_limpio
 FROM patch_scores CROSS JOIN (VALUES (0.06::DOUBLE),(0.5::DOUBLE),(0.9::DOUBLE)) v(umbral) GROUP BY umbral)""")
def fpr_by_provenance(spark, sf):
    return metrics.fpr_by_provenance(V.patch_scores(spark, sf), "score", "source", (0.06, 0.5, 0.9))


@query("G14_average_precision", "patch_scores", """
WITH d AS (SELECT part, score, count_if(label=1) AS pos, count_if(label=0) AS neg FROM patch_scores GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM d
 WINDOW w AS (PARTITION BY part ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT part, round(sum(pos*(tp/(tp+fp)))/greatest(1,sum(pos)),6) AS auc_pr, sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives
FROM c GROUP BY part""")
def average_precision(spark, sf):
    return curves.average_precision(V.patch_scores(spark, sf), "score", "label", ["part"])


@query("G15_mean_brightness", "", """
SELECT vec_id, sum(v)::BIGINT//count(*) AS brightness FROM (SELECT vec_id, floor((x+1)*127.5::DOUBLE)::BIGINT AS v, i FROM (
 SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding,1)-1 AS i FROM embeddings)) WHERE i%8=0 GROUP BY vec_id""")
def mean_brightness(spark, sf):
    e = V.columns(spark, sf, "embeddings", "vec_id", "embedding")
    channel = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5))
    return e.select("vec_id", scoring.mean_brightness(channel).alias("brightness"))


# ---------------------------------------------------------------- operating points

def _both_models(spark, sf):
    """Model A plays the float32 scores, model B the int8 scores."""
    return V.patch_scores(spark, sf).withColumn("precision_kind", F.lit("float32")).unionByName(
        V.patch_scores(spark, sf, "B").withColumn("precision_kind", F.lit("int8")))


def operating_points(spark, sf):
    keys = ["precision_kind", "part"]
    points = metrics.sweep(_both_models(spark, sf), "score", "label", C.PATCH_GRID, keys)
    return metrics.operating_point(points, keys)


_OPERATION_SQL = f"""
 both_models AS (SELECT 'float32' AS precision_kind, * FROM patch_scores UNION ALL SELECT 'int8', * FROM patch_scores_b),
 {sweep_sql('swept', 'both_models', 'precision_kind,part', PATCH_GRID)},
 operation AS (SELECT precision_kind,part,{POINT_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY precision_kind,part
  ORDER BY (fpr<=0.10) DESC, CASE WHEN fpr<=0.10 THEN recall ELSE f1 END DESC, umbral) AS r FROM swept) WHERE r=1)"""


@query("J6_precision_loss", "patch_scores patch_scores_b", f"""WITH {_OPERATION_SQL}
SELECT a.part, a.umbral AS umbral_float32, a.f1 AS f1_float32, b.umbral AS umbral_int8, b.f1 AS f1_int8, round(b.f1-a.f1,4) AS f1_loss
FROM operation a JOIN operation b USING (part) WHERE a.precision_kind='float32' AND b.precision_kind='int8'""")
def precision_loss(spark, sf):
    return metrics.compare_precisions(operating_points(spark, sf), ["part"])


@query("J7_verdict", "patch_scores patch_scores_b", f"""WITH {_OPERATION_SQL}
SELECT precision_kind, part, umbral, CASE WHEN len(missed)=0 THEN 'CUMPLE' ELSE 'NO CUMPLE: '||array_to_string(missed, ', ') END AS veredicto
FROM (SELECT *, list_filter([CASE WHEN recall<0.9 THEN 'recall' END, CASE WHEN precision<0.8 THEN 'precision' END,
 CASE WHEN f1<0.75 THEN 'f1' END, CASE WHEN fpr>0.1 THEN 'fpr' END], lambda m: m IS NOT NULL) AS missed FROM operation)""")
def verdict(spark, sf):
    return metrics.verdict(operating_points(spark, sf)).select(
        "precision_kind", "part", "umbral", "veredicto")


@query("K3_patch_operating_point", "patch_scores patch_scores_b",
       f"WITH {_OPERATION_SQL} SELECT * FROM operation")
def patch_operating_point(spark, sf):
    return operating_points(spark, sf).select("precision_kind", "part", *POINT_COLS.split(","))


def _frame_maximum(spark, sf, *own):
    """Maximum tile score per capture.

    What belongs to the capture is part of the key: an aggregate that holds a string, such as any_value, is done by
    sorting all tiles, one over numbers alone by hashing the captures.
    """
    return V.tile_scores(spark, sf).groupBy("frame_id", *own).agg(F.max("score").alias("score"))


_FRAME_SWEEP_SQL = f"""
 frame_max AS (SELECT frame_id, camera, partner, smoke, max(score) AS score FROM tile_scores GROUP BY ALL),
 {sweep_sql('swept', 'frame_max', 'partner', FRAME_GRID, 'smoke')}"""


@query("K4_frame_operating_point", "tile_scores", f"""WITH {_FRAME_SWEEP_SQL}
SELECT cap, partner, {POINT_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY cap,partner ORDER BY recall DESC, umbral) AS r
FROM swept CROSS JOIN (VALUES (0.10::DOUBLE),(0.01::DOUBLE)) v(cap) WHERE fpr<=cap) WHERE r=1""")
def frame_operating_point(spark, sf):
    frames = _frame_maximum(spark, sf, "partner", "smoke")
    points = metrics.sweep(frames, "score", "smoke", C.FRAME_GRID, ["partner"])
    capped = points.withColumn("cap", F.explode(F.array(F.lit(0.10), F.lit(0.01)))).where(
        F.col("fpr") <= F.col("cap"))
    return metrics.operating_point(capped, ["cap", "partner"], 1.0, fallback=False).select(
        "cap", "partner", *POINT_COLS.split(","))


def flagship(spark, sf):
    """Best threshold of the any-tile rule on the held-out partner."""
    held_out = V.captures(spark, sf).where(F.col("partner") == C.HELD_OUT_PARTNER)
    frames = V.tiles_of(held_out).groupBy("frame_id").agg(
        F.max("score").alias("score"), F.any_value("smoke").alias("smoke"))
    points = metrics.sweep(frames, "score", "smoke", C.FRAME_GRID)
    return metrics.operating_point(points, fallback=False)


query("any_tile_held_out", "tile_scores", f"""WITH {_FRAME_SWEEP_SQL}
SELECT {POINT_COLS} FROM swept WHERE partner='sdis-77' AND fpr<=0.10 ORDER BY recall DESC, umbral LIMIT 1""")(flagship)


_RULES_SQL = f"""
 ranked AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC) AS r FROM tile_scores),
 frame_top AS (SELECT frame_id, camera, ts, smoke, max(score) FILTER (WHERE r=1) AS t1, max(score) FILTER (WHERE r=2) AS t2,
  max(score) FILTER (WHERE r=3) AS t3 FROM ranked GROUP BY ALL),
 history AS (SELECT *, lag(t1,1) OVER w AS l1, lag(t1,2) OVER w AS l2 FROM frame_top WINDOW w AS (PARTITION BY camera ORDER BY ts, frame_id)),
 scores AS (SELECT frame_id, smoke, '1_de_N' AS rule, t1 AS score FROM history UNION ALL SELECT frame_id, smoke, '2_de_N', t2 FROM history
  UNION ALL SELECT frame_id, smoke, '3_de_N', t3 FROM history
  UNION ALL SELECT frame_id, smoke, 'temporal_2', CASE WHEN l1 IS NOT NULL THEN least(t1,l1) END FROM history
  UNION ALL SELECT frame_id, smoke, 'temporal_3', CASE WHEN l2 IS NOT NULL THEN least(t1,l1,l2) END FROM history)"""


K5_SQL = f"""WITH {_RULES_SQL},
 {sweep_sql('swept', 'scores', 'rule', FRAME_GRID, 'smoke')},
 wanted(rule, cap, regla) AS (VALUES ('1_de_N',0.10::DOUBLE,'1_de_N'),('2_de_N',0.10::DOUBLE,'2_de_N_fpr0.1'),('2_de_N',0.01::DOUBLE,'2_de_N_fpr0.01'),
  ('3_de_N',0.10::DOUBLE,'3_de_N_fpr0.1'),('3_de_N',0.01::DOUBLE,'3_de_N_fpr0.01'),('temporal_2',0.10::DOUBLE,'temporal_2'),('temporal_3',0.10::DOUBLE,'temporal_3')),
 best AS (SELECT * FROM (SELECT w.regla, s.*, row_number() OVER (PARTITION BY regla ORDER BY recall DESC, umbral) AS r
  FROM swept s JOIN wanted w ON s.rule=w.rule AND s.fpr<=w.cap) WHERE r=1)
SELECT w.regla, umbral, tp, fp, fn, tn, recall, precision, f1, fpr FROM wanted w LEFT JOIN best b ON b.regla=w.regla"""


@query("K5_rule_leaderboard", "tile_scores", K5_SQL)
def rule_leaderboard(spark, sf):
    return rules.leaderboard(rules.effective_scores_of_frames(V.frame_tile_scores(spark, sf)))


# ---------------------------------------------------------------- windows over captures

def _frame_scores(spark, sf):
    """Maximum tile score per capture, stored once: histories read it twice."""
    return materialize(_frame_maximum(spark, sf, "camera", "ts"), "frame-maximum")


@query("W1_temporal_confirmation", "tile_scores", """
WITH f AS (SELECT frame_id, camera, ts, max(score) AS score FROM tile_scores GROUP BY ALL),
h AS (SELECT *, lag(score,1) OVER w AS l1, lag(score,2) OVER w AS l2 FROM f WINDOW w AS (PARTITION BY camera ORDER BY ts, frame_id))
SELECT frame_id, camera, score, CASE WHEN l1 IS NOT NULL THEN least(score,l1) END AS confirmed_2,
 CASE WHEN l2 IS NOT NULL THEN least(score,l1,l2) END AS confirmed_3 FROM h""")
def temporal_confirmation(spark, sf):
    return timeline.confirmed_scores(_frame_scores(spark, sf), (2, 3)).select(
        "frame_id", "camera", "score", "confirmed_2", "confirmed_3")


RUN_SQL = """
h AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY camera ORDER BY ts, frame_id ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT frame_id, camera, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY camera, g ORDER BY ts, frame_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM h"""


@query("W2_run_lengths", "tile_scores", f"""
WITH f AS (SELECT frame_id, camera, ts, count_if(prob_x1000>=700)>0 AS hit FROM tile_scores GROUP BY ALL), {RUN_SQL}""")
def run_lengths(spark, sf):
    frames = V.tile_scores(spark, sf).groupBy("frame_id", "camera", "ts").agg(
        F.count_if(F.col("prob_x1000") >= 700).alias("over"))
    frames = materialize(frames, "frame-over")
    return timeline.run_lengths(frames, F.col("over") > 0, "camera", tie="frame_id").select(
        "frame_id", "camera", "run")


@query("W6_curve_points", "patch_scores", f"WITH {_CURVE_SQL} SELECT * FROM curve")
def curve_points(spark, sf):
    return _curve(spark, sf)


@query("W8_showcase", "patch_scores", """
SELECT rank, frame_id, tile_id, round(score,3) AS score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, frame_id, tile_id) AS rank
FROM patch_scores WHERE label=1) WHERE rank<=60 AND (rank-1)%10=0""")
def showcase(spark, sf):
    pos = V.patch_scores(spark, sf).where("label = 1")
    return sampling.showcase(pos, "score", ["frame_id", "tile_id"]).select(
        "rank", "frame_id", "tile_id", F.round("score", 3).alias("score"))


@query("W9_suffix_counts", "tile_scores", f"""WITH {_FRAME_SWEEP_SQL} SELECT partner, umbral, tp, fp, fn, tn FROM swept""")
def suffix_counts(spark, sf):
    frames = _frame_maximum(spark, sf, "partner", "smoke")
    return metrics.sweep(frames, "score", "smoke", C.FRAME_GRID, ["partner"]).select(
        "partner", "umbral", "tp", "fp", "fn", "tn")


# ---------------------------------------------------------------- sorts

@query("K1_camera_order", "captures", "SELECT camera, ts, frame_id FROM captures ORDER BY camera, ts, frame_id")
def camera_order(spark, sf):
    return V.captures(spark, sf).select("camera", "ts", "frame_id").orderBy(
        "camera", "ts", "frame_id")


@query("K2_top_false_positives", "patch_scores", """
SELECT frame_id, tile_id, round(score,3) AS score FROM patch_scores WHERE source='limpio' ORDER BY patch_scores.score DESC, frame_id, tile_id LIMIT 6""")
def top_false_positives(spark, sf):
    clean = V.patch_scores(spark, sf).where(F.col("source") == C.CLEAN)
    return sampling.top_by_score(clean, "score", ["frame_id", "tile_id"], 6).select(
        "frame_id", "tile_id", F.round("score", 3).alias("score"))


# ---------------------------------------------------------------- array pixels

def _haze_sql() -> str:
    h = "md5('42:haze:'||vec_id)"
    return f"""
SELECT vec_id, i, round(x*(1-alpha)+veil*alpha,4) AS value FROM (SELECT vec_id, i, (x+1)*127.5::DOUBLE AS x,
 CASE WHEN {V.sql_unit('h', 0)}<0.35::DOUBLE THEN {V.sql_unit('h', 1)}*0.45::DOUBLE ELSE 0 END AS alpha,
 180+{V.sql_unit('h', 2)}*75 AS veil FROM (SELECT vec_id, {h} AS h, unnest(embedding)::DOUBLE AS x,
 generate_subscripts(embedding,1)-1 AS i FROM embeddings))"""


@query("P3_haze", "", _haze_sql())
def haze(spark, sf):
    e = V.columns(spark, sf, "embeddings", "vec_id", "embedding").withColumn(
        "h", digest(C.SEED, "haze", F.col("vec_id")))
    h = F.col("h")
    alpha = F.when(unit(h, 0) < C.HAZE_PROB, unit(h, 1) * C.HAZE_MAX_ALPHA).otherwise(0.0)
    e = e.select("vec_id", F.transform("embedding", lambda x: (x.cast("double") + 1) * 127.5)
                 .alias("px"), alpha.alias("alpha"), between(unit(h, 2), *C.HAZE_VEIL).alias("veil"))
    return e.select("vec_id", F.posexplode(
        scoring.haze(F.col("px"), F.col("alpha"), F.col("veil"))).alias("i", "v")).select(
        "vec_id", "i", F.round("v", 4).alias("value"))


@query("P4_grayscale", "", """
WITH px AS (SELECT vec_id, list_transform(embedding, lambda x: floor((x::DOUBLE+1)*127.5::DOUBLE)::INT) AS p FROM embeddings),
g AS (SELECT vec_id, t, floor((p[3*t+1]/255.0::DOUBLE*0.2989::DOUBLE+p[3*t+2]/255.0::DOUBLE*0.587::DOUBLE+p[3*t+3]/255.0::DOUBLE*0.114::DOUBLE)*255.5::DOUBLE)::INT AS v
 FROM (SELECT *, unnest(range(len(p)//3)) AS t FROM px))
SELECT vec_id, t*3+c AS i, v AS value FROM g CROSS JOIN range(3) r(c)""")
def grayscale(spark, sf):
    e = V.columns(spark, sf, "embeddings", "vec_id", "embedding").select(
        "vec_id", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5))
        .alias("px"))
    return e.select("vec_id", F.posexplode(scoring.gray_triples(F.col("px"))).alias("i", "value"))
