"""Queries over annotated frames: scans, geometry, joins, patch building, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumewatch import constants as C
from plumewatch.functions import geometry as geo
from plumewatch.operators import overlap, pixels, sampling, summaries
from plumewatch.operators.ranking import lower_rank_percentiles
from plumewatch.plans import views as V
from plumewatch.plans.registry import query
from plumewatch.session import scratch_path
from plumewatch.sources import epochs
from plumewatch.sources import frames as src
from plumewatch.sources.footers import first_byte, read_footers

BOX_COLS = ("x0", "y0", "x1", "y1")
SQL_ROUND = ",".join(f"round({c},4) AS {c}" for c in BOX_COLS)


def rounded(prefix: str = ""):
    return [F.round(f"{prefix}{c}", 4).alias(c) for c in BOX_COLS]


# ---------------------------------------------------------------- scans and sinks

@query("A1_scan_frames", "frame_base frame_boxes", r"""
WITH lines AS (SELECT frame_id, string_agg('0 0.'||lpad((round(xc*1000)::INT)::VARCHAR,3,'0')||' 0.'
 ||lpad((round(yc*1000)::INT)::VARCHAR,3,'0')||' 0.'||lpad((round(bw*1000)::INT)::VARCHAR,3,'0')||' 0.'
 ||lpad((round(bh*1000)::INT)::VARCHAR,3,'0'), chr(10) ORDER BY box_no) AS t FROM frame_boxes GROUP BY frame_id)
SELECT f.frame_id, 'frame_'||f.frame_id||'.jpg' AS image_name, camera, partner, date,
 CASE WHEN f.frame_id%101=0 THEN NULL WHEN f.frame_id%97=0 THEN coalesce(t,'')||chr(10)||'0 0.500 0.500 0.100'
 ELSE coalesce(t,'') END AS annotations, CASE WHEN readable THEN width END AS width, CASE WHEN readable THEN height END AS height
FROM frame_base f LEFT JOIN lines USING (frame_id)""")
def scan_frames(spark, sf):
    """Stored shards, whose images hold their bytes only, read with the size that the bytes tell."""
    path = scratch_path(spark, "frames")
    held = V.frames(spark, sf)
    held.select(F.struct("image.bytes").alias("image"), *[
        c for c in held.columns if c not in ("frame_id", "image")]).write.parquet(path)
    frames = src.with_frame_size(src.read_frames(spark, path))
    return frames.select(
        F.regexp_extract("image_name", r"frame_(\d+)", 1).cast("bigint").alias("frame_id"),
        "image_name", "camera", "partner", "date", "annotations", "width", "height")


@query("A2_per_file_limit", "", """
SELECT o_orderkey AS frame_id, 'orders.parquet' AS file FROM (
 SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) WHERE r<=200""")
def per_file_limit(spark, sf):
    df = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("frame_id"), F.col("_metadata.file_name").alias("file"))
    return src.per_file_limit(df, "file", "frame_id", 200)


@query("A3_matched_limit", "frame_base", """
SELECT frame_id, camera FROM frame_base WHERE partner='sdis-77' ORDER BY frame_id LIMIT 500""")
def matched_limit(spark, sf):
    return (V.frames(spark, sf).where(F.col("partner") == C.HELD_OUT_PARTNER)
            .select("frame_id", "camera").orderBy("frame_id").limit(500))


@query("A4_quarantine", "frame_base", """
SELECT frame_id, camera, partner FROM frame_base WHERE NOT readable""")
def quarantine(spark, sf):
    return src.split_readable(V.frames(spark, sf))[1].select("frame_id", "camera", "partner")


def damage(spark, path: str, at: int, size: int = 64) -> None:
    """Overwrites some bytes of a small file."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    data = bytearray(spark.read.format("binaryFile").load(path).first().content)
    data[at:at + size] = b"\xff" * size
    out = files.create(target, True)
    out.write(data)
    out.close()


@query("A4_short_shards", "frame_base", """
SELECT frame_id%3 AS half, count(*) AS footer_rows, CASE WHEN frame_id%3=2 THEN 1 ELSE 0 END AS short_shards,
 frame_id%3=2 AS fewer_read FROM frame_base GROUP BY ALL""")
def short_shards(spark, sf):
    """Shards in three folders with equal file names; one is damaged in its second row group."""
    path = scratch_path(spark, "sharded-frames")
    held = V.frames(spark, sf)
    for half in range(3):
        # small row groups, so that the damaged shard has several
        held.where(F.col("frame_id") % 3 == half).drop("frame_id").write.option(
            "parquet.block.size", 1 if half == 2 else 1 << 27).parquet(f"{path}/half={half}")
    whole = read_footers(spark, path)
    victim = whole.where("row_groups > 1 and path like '%half=2%'").orderBy("length", "path").first()
    damage(spark, victim.path, first_byte(victim.path, 1))
    _, short = src.read_frames_and_short_shards(spark, path)
    half = F.regexp_extract("path", "half=([0-9])", 1).cast("long").alias("half")
    found = short.select(half, "rows", "rows_read").groupBy("half").agg(
        F.count(F.lit(1)).alias("short_shards"), F.bool_and(F.col("rows_read") < F.col("rows")).alias("fewer_read"))
    return whole.select(half, "rows").groupBy("half").agg(F.sum("rows").alias("footer_rows")).join(
        found, "half", "left").select("half", "footer_rows", F.coalesce("short_shards", F.lit(0)).alias(
            "short_shards"), F.coalesce("fewer_read", F.lit(False)).alias("fewer_read"))


def _negatives_sql() -> str:
    h = "md5('42:window:'||frame_id||':'||attempt)"
    return f"""
 base AS (SELECT f.*, (SELECT count(*) FROM frame_boxes b WHERE b.frame_id=f.frame_id) AS nb
  FROM frame_base f WHERE readable),
 tries AS (SELECT frame_id,camera,partner,width,height,nb,quota,unnest(range(quota*25)) AS attempt FROM (
  SELECT *, CASE WHEN nb>0 THEN 3 ELSE 4 END AS quota FROM base)),
 sides AS (SELECT *, least((0.85::DOUBLE+{V.sql_unit('h', 0)}*(1.6::DOUBLE-0.85::DOUBLE))*224,height) AS side FROM (
  SELECT *, {h} AS h FROM tries)),
 wins AS (SELECT frame_id,camera,partner,nb,quota,attempt,x0,y0,x0+side AS x1,y0+side AS y1 FROM (
  SELECT *, {V.sql_unit('h', 1)}*(width-side) AS x0, {V.sql_unit('h', 2)}*(height-side) AS y0 FROM sides)),
 free AS (SELECT * FROM wins w WHERE NOT EXISTS (SELECT 1 FROM frame_boxes b WHERE b.frame_id=w.frame_id
  AND w.x0<b.x1 AND b.x0<w.x1 AND w.y0<b.y1 AND b.y0<w.y1)),
 negs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY attempt)-1 AS item FROM free)
  WHERE item<quota)"""


def _positives_sql() -> str:
    h = "md5('42:jitter:'||frame_id||':'||(box_no-1))"
    return f"""
 sized AS (SELECT *, least(greatest(224::DOUBLE,(x1-x0)*2.2::DOUBLE,(y1-y0)*2.2::DOUBLE),height) AS side, {h} AS h
  FROM frame_boxes WHERE readable),
 slack AS (SELECT *, greatest(0,(side-(x1-x0))/2*0.6::DOUBLE) AS sx, greatest(0,(side-(y1-y0))/2*0.6::DOUBLE) AS sy FROM sized),
 centres AS (SELECT *, 0 AS crop, (x0+x1)/2 AS cx, (y0+y1)/2 AS cy FROM slack
  UNION ALL SELECT *, 1, (x0+x1)/2-sx+{V.sql_unit('h', 0)}*(2*sx), (y0+y1)/2-sy+{V.sql_unit('h', 1)}*(2*sy) FROM slack),
 poss AS (SELECT frame_id,camera,partner,item,crop,vx AS x0,vy AS y0,vx+side AS x1,vy+side AS y1 FROM (
  SELECT *, box_no-1 AS item, least(greatest(cx-side/2,0),width-side) AS vx,
  least(greatest(cy-side/2,0),height-side) AS vy FROM centres))"""


PATCHES_SQL = f"""WITH {_negatives_sql()}, {_positives_sql()},
 patches AS (SELECT frame_id,camera,{V.sql_part()} AS part,'positive' AS source,1 AS label,item,crop,x0,y0,x1,y1 FROM poss
 UNION ALL SELECT frame_id,camera,{V.sql_part()},CASE WHEN nb>0 THEN 'duro' ELSE 'limpio' END,0,item,attempt,x0,y0,x1,y1 FROM negs)"""


@query("A8_patch_dataset", "frame_base frame_boxes", PATCHES_SQL + """
SELECT part, source, label, count(*) AS n, count(DISTINCT camera) AS cameras, round(sum(x1-x0),2) AS side_sum
FROM patches GROUP BY ALL""")
def patch_dataset(spark, sf):
    path = scratch_path(spark, "patches")
    src.write_patches(sampling.all_patches(V.framed_boxes(spark, sf)), path)
    p = src.read_patches(spark, path)
    per_camera = p.groupBy("part", "source", "label", "camera").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("x1") - F.col("x0")).alias("s"))
    return per_camera.groupBy("part", "source", "label").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("cameras"),
        F.round(F.sum("s"), 2).alias("side_sum"))


PATCH_OUT = 8


def _taps_sql(name: str, low: str, length: str, size: str) -> str:
    """Weights of the triangle filter for each patch's own start and length."""
    step = f"(({length})/{PATCH_OUT}.0::DOUBLE)"
    return f"""
 {name}_c AS (SELECT pid, i, {low}+(i+0.5::DOUBLE)*{step} AS c, greatest({step},1) AS reach, {size} AS n
  FROM numbered CROSS JOIN range({PATCH_OUT}) r(i)),
 {name}_t AS (SELECT *, unnest(range(greatest(trunc(c-reach+0.5::DOUBLE),0)::BIGINT, least(trunc(c+reach+0.5::DOUBLE),n)::BIGINT)) AS t FROM {name}_c),
 {name} AS (SELECT pid, i, t, floor(w/sum(w) OVER (PARTITION BY pid, i)*4194304+0.5::DOUBLE)::BIGINT AS k FROM (
  SELECT pid, i, t, greatest(0,1-abs((t-c+0.5::DOUBLE)*(1/reach))) AS w FROM {name}_t))"""


_LEVEL = "least(255,greatest(0,(sum(k*v)::BIGINT+2097152)>>22))"
PIXELS_SQL = PATCHES_SQL.replace("frame_base", "raster_base").replace("frame_boxes", "raster_boxes") + f""",
 numbered AS (SELECT *, row_number() OVER () AS pid FROM patches),
 lines AS (SELECT frame_id, r, substr(hx,(r*384+1)::BIGINT,384) AS seg FROM (SELECT frame_id, hx, unnest(range(48)) AS r FROM raster_base)),
 px AS (SELECT frame_id, r, j//3 AS x, j%3 AS ch, ('0x'||substr(seg,j*2+1,2))::BIGINT AS v FROM (
  SELECT *, unnest(range(192)) AS j FROM lines)),
 {_taps_sql('across', 'x0', 'x1-x0', '64')}, {_taps_sql('down', 'y0', 'y1-y0', '48')},
 mid AS (SELECT n.pid, r, i AS ix, ch, {_LEVEL} AS v FROM numbered n JOIN across a ON a.pid=n.pid
  JOIN px ON px.frame_id=n.frame_id AND px.x=a.t GROUP BY ALL),
 cut AS (SELECT d.pid, d.i AS iy, ix, ch, {_LEVEL} AS v FROM mid JOIN down d ON d.pid=mid.pid AND d.t=mid.r GROUP BY ALL),
 sums AS (SELECT pid, count(*) AS n_bytes, sum(v)::BIGINT AS level_sum, sum(v*((iy*{PATCH_OUT}+ix)*3+ch+1))::BIGINT AS weighted_sum
  FROM cut GROUP BY pid)
SELECT frame_id, part, source, label, item, crop, n_bytes, level_sum, weighted_sum FROM numbered JOIN sums USING (pid)"""


@query("A8_pixel_dataset", "raster_base raster_boxes", PIXELS_SQL)
def pixel_dataset(spark, sf):
    """The whole dataset build: boxes, windows, pixels cut and resampled, stored by part, read back."""
    path = scratch_path(spark, "pixel-patches")
    frames = sampling.frame_windows(V.raster_frames(spark, sf)).drop("boxes", "partner")
    cut = pixels.extract_patches(frames, out=PATCH_OUT).select(
        "frame_id", "camera", "part", "window.*", "patch")
    src.write_patches(cut, path)
    return pixels.level_sums(src.read_patches(spark, path)).select(
        "frame_id", "part", "source", "label", "item", "crop", "n_bytes", "level_sum", "weighted_sum")


@query("A9_dataset_document", "frame_base frame_boxes", PATCHES_SQL + """
SELECT part, '{"ventana_px":224,"salida_px":96,"semilla":42,"partner_cruzado":"sdis-77","n":'||count(*)
 ||',"positivos":'||count_if(label=1)||',"negativos":'||count_if(label=0)||',"camaras":'||count(DISTINCT camera)||'}' AS resumen
FROM patches GROUP BY part""")
def dataset_document(spark, sf):
    return summaries.dataset_document(sampling.all_patches(V.framed_boxes(spark, sf)))


# ---------------------------------------------------------------- geometry

def _exploded(spark, sf):
    return sampling.each(V.framed_boxes(spark, sf), "boxes", "item", "box")


@query("B1_parse_boxes", "frame_boxes", f"""
SELECT frame_id, box_no-1 AS item, {SQL_ROUND} FROM frame_boxes WHERE readable""")
def parse_boxes(spark, sf):
    return _exploded(spark, sf).select("frame_id", "item", *rounded("box."))


@query("B2_smoke_flags", "frame_base", """
SELECT frame_id, smoke_text, n_boxes>0 AS smoke_boxes FROM frame_base WHERE readable""")
def smoke_flags(spark, sf):
    df = src.split_readable(V.frames(spark, sf))[0]
    return df.select(
        "frame_id", geo.has_smoke_text(F.col("annotations")).alias("smoke_text"),
        (F.size(geo.fraction_boxes(F.col("annotations"))) > 0).alias("smoke_boxes"))


@query("B3_centred_windows", "frame_boxes", f"""WITH {_positives_sql()}
SELECT frame_id, item, {SQL_ROUND} FROM poss WHERE crop=0""")
def centred_windows(spark, sf):
    df = _exploded(spark, sf)
    return df.withColumn("win", geo.window_around(
        F.col("box"), F.col("width"), F.col("height"))).select("frame_id", "item", *rounded("win."))


@query("B4_jittered_windows", "frame_boxes", f"""WITH {_positives_sql()}
SELECT frame_id, item, {SQL_ROUND} FROM poss WHERE crop=1""")
def jittered_windows(spark, sf):
    df = _exploded(spark, sf)
    return df.withColumn("win", geo.window_around(
        F.col("box"), F.col("width"), F.col("height"),
        geo.jitter_draws(F.col("frame_id"), F.col("item")))).select(
        "frame_id", "item", *rounded("win."))


@query("B5_crops_per_box", "frame_boxes", f"""WITH {_positives_sql()}
SELECT frame_id, item, crop, {SQL_ROUND} FROM poss""")
def crops_per_box(spark, sf):
    return sampling.box_windows(V.framed_boxes(spark, sf)).select(
        "frame_id", "item", "crop", *rounded("win."))


@query("B6_tile_grid", "frame_base", """
WITH sizes AS (SELECT width, height, count(*) AS frames FROM frame_base WHERE readable GROUP BY ALL),
xs AS (SELECT DISTINCT width, height, x FROM (SELECT width, height, unnest(range(0,width-223,168)) AS x FROM sizes WHERE width>=224 AND height>=224
 UNION ALL SELECT width, height, width-224 FROM sizes WHERE width>=224 AND height>=224)),
ys AS (SELECT DISTINCT width, height, y FROM (SELECT width, height, unnest(range(0,height-223,168)) AS y FROM sizes WHERE width>=224 AND height>=224
 UNION ALL SELECT width, height, height-224 FROM sizes WHERE width>=224 AND height>=224))
SELECT width, height, row_number() OVER (PARTITION BY width,height ORDER BY y,x)-1 AS tile_id, x, y, frames
FROM xs JOIN ys USING (width,height) JOIN sizes USING (width,height)""")
def tile_grid(spark, sf):
    df = src.split_readable(V.frames(spark, sf))[0]
    grid = geo.tile_grid(F.col("image.width"), F.col("image.height"))
    return (
        df.select(F.col("image.width").alias("width"), F.col("image.height").alias("height"),
                  F.posexplode(grid).alias("tile_id", "t"))
        .groupBy("width", "height", "tile_id", "t.x", "t.y")
        .agg(F.count(F.lit(1)).alias("frames")))


@query("B7_rescaled_boxes", "frame_boxes", """
SELECT frame_id, box_no-1 AS item, round(x0*(1280::DOUBLE/width),4) AS x0, round(y0*(720::DOUBLE/height),4) AS y0,
 round(x1*(1280::DOUBLE/width),4) AS x1, round(y1*(720::DOUBLE/height),4) AS y1
FROM frame_boxes WHERE readable""")
def rescaled_boxes(spark, sf):
    return _exploded(spark, sf).withColumn("r", geo.rescale_box(F.col("box"), F.col("width"), F.col("height"))).select(
        "frame_id", "item", *rounded("r."))


def _fractions(spark, sf):
    df = src.split_readable(V.frames(spark, sf))[0]
    return df.select("frame_id", "partner", F.inline(geo.fraction_boxes(F.col("annotations"))))


@query("B8_box_profile", "frame_boxes", """
SELECT frame_id, bw AS w, bh AS h, round(bw*bh,8) AS area FROM frame_boxes WHERE readable""")
def box_profile(spark, sf):
    return _fractions(spark, sf).select(
        "frame_id", "w", "h", F.round(F.col("w") * F.col("h"), 8).alias("area"))


@query("B9_partner_or_cameras", "frame_base", """
SELECT frame_id, camera, 'partner' AS chosen FROM frame_base WHERE partner='sdis-77'
UNION ALL SELECT frame_id, camera, 'cameras' FROM frame_base WHERE camera IN ('cam-1','cam-2','cam-12')""")
def partner_or_cameras(spark, sf):
    df = V.frames(spark, sf).select("frame_id", "camera", "partner")
    chosen = F.array_compact(F.array(
        F.when(F.col("partner") == C.HELD_OUT_PARTNER, "partner"),
        F.when(F.col("camera").isin("cam-1", "cam-2", "cam-12"), "cameras")))
    return df.select("frame_id", "camera", F.explode(chosen).alias("chosen"))


@query("B10_camera_split", "frame_base", f"""
SELECT DISTINCT camera, partner, {V.sql_part()} AS part FROM frame_base""")
def camera_split(spark, sf):
    return V.frames(spark, sf).select("camera", "partner").distinct().withColumn(
        "part", geo.split_part(F.col("camera"), F.col("partner")))


# ---------------------------------------------------------------- joins

N_WINDOWS = 6


def _windows(spark, sf):
    w, h = C.FRAME_SIZE
    made = geo.random_windows(f"sequence(0, {N_WINDOWS - 1})", "o_orderkey", f"{w}D", f"{h}D")
    return V.columns(spark, sf, "orders", "o_orderkey").select(
        F.col("o_orderkey").alias("frame_id"), F.inline(made)).select(
        "frame_id", F.col("attempt").alias("window_id"), "win.*")


WINDOWS_SQL = f"""windows AS (SELECT frame_id,window_id,x0,y0,x0+side AS x1,y0+side AS y1 FROM (
 SELECT *, {V.sql_unit('h', 1)}*(1280-side) AS x0, {V.sql_unit('h', 2)}*(720-side) AS y0 FROM (
 SELECT *, least((0.85::DOUBLE+{V.sql_unit('h', 0)}*(1.6::DOUBLE-0.85::DOUBLE))*224,720) AS side FROM (
 SELECT frame_id, window_id, md5('42:window:'||frame_id||':'||window_id) AS h FROM (
 SELECT o_orderkey AS frame_id, unnest(range({N_WINDOWS})) AS window_id FROM orders)))))"""
MEET = "w.frame_id=b.frame_id AND w.x0<b.x1 AND b.x0<w.x1 AND w.y0<b.y1 AND b.y0<w.y1"
SHARE = ("(least(w.x1,b.x1)-greatest(w.x0,b.x0))*(least(w.y1,b.y1)-greatest(w.y0,b.y0))"
         "/greatest(1,(b.x1-b.x0)*(b.y1-b.y0))")


@query("J1_window_box_overlap", "line_boxes", f"""WITH {WINDOWS_SQL}
SELECT w.frame_id, window_id, box_id, part_key, supp_key, round({SHARE},6) AS share
FROM windows w JOIN line_boxes b ON {MEET} WHERE {SHARE}>0.25""")
def window_box_overlap(spark, sf):
    pairs = overlap.overlapping_pairs(_windows(spark, sf), V.line_boxes(spark, sf), 0.25)
    return pairs.select("frame_id", "window_id", "box_id", "part_key", "supp_key",
                        F.round("share", 6).alias("share"))


@query("J2_untouched_windows", "line_boxes", f"""WITH {WINDOWS_SQL}
SELECT frame_id, window_id, round(x0,4) AS x0, round(y0,4) AS y0 FROM windows w
WHERE NOT EXISTS (SELECT 1 FROM line_boxes b WHERE {MEET})""")
def untouched_windows(spark, sf):
    free = overlap.untouched_windows(_windows(spark, sf), V.line_boxes(spark, sf))
    return free.select("frame_id", "window_id", F.round("x0", 4).alias("x0"),
                       F.round("y0", 4).alias("y0"))


@query("J3_tile_box_coverage", "line_boxes", f"""
WITH tiles AS (SELECT j*8+i AS tile_id, CASE WHEN i=7 THEN 1056 ELSE i*168 END AS x, CASE WHEN j=3 THEN 496 ELSE j*168 END AS y
 FROM range(8) a(i), range(4) c(j)),
w AS (SELECT tile_id, x, y, x::DOUBLE AS x0, y::DOUBLE AS y0, x+224::DOUBLE AS x1, y+224::DOUBLE AS y1 FROM tiles)
SELECT frame_id, box_id, part_key, supp_key, tile_id, x, y, round({SHARE},6) AS share
FROM line_boxes b JOIN w ON {MEET.replace('w.frame_id=b.frame_id AND ', '')}""")
def tile_box_coverage(spark, sf):
    b = V.line_boxes(spark, sf)
    box = geo.box_struct(*[F.col(c) for c in BOX_COLS])
    w, h = (F.lit(v) for v in C.FRAME_SIZE)
    return b.select(
        "frame_id", "box_id", "part_key", "supp_key",
        F.inline(geo.tile_coverage(box, w, h))).withColumn("share", F.round("share", 6))


@query("J4_attach_part", "frame_base frame_boxes", f"""
SELECT b.frame_id, box_no-1 AS item, camera, {V.sql_part()} AS part FROM frame_boxes b WHERE readable""")
def attach_part(spark, sf):
    return _exploded(spark, sf).select(
        "frame_id", "item", "camera",
        geo.split_part(F.col("camera"), F.col("partner")).alias("part"))


@query("J5_negative_provenance", "", """
SELECT o_orderkey AS frame_id, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey)
 THEN 'duro' ELSE 'limpio' END AS source FROM orders""")
def negative_provenance(spark, sf):
    frames = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("frame_id"))
    boxes = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame_id"))
    return overlap.negative_provenance(frames, boxes, C.HARD, C.CLEAN)


# ---------------------------------------------------------------- samplers

@query("S1_negative_windows", "frame_base frame_boxes", f"""WITH {_negatives_sql()}
SELECT frame_id, item, attempt, {SQL_ROUND} FROM negs""")
def negative_windows(spark, sf):
    return sampling.negative_windows(V.framed_boxes(spark, sf)).select(
        "frame_id", "item", "attempt", *rounded("win."))


@query("S2_negative_quota", "frame_base", """
SELECT frame_id, CASE WHEN n_boxes>0 THEN 3 ELSE 4 END AS quota FROM frame_base WHERE readable""")
def negative_quota(spark, sf):
    return V.framed_boxes(spark, sf).select(
        "frame_id", sampling.negative_quota(F.col("boxes")).alias("quota"))


@query("S3_patch_build", "frame_base frame_boxes", PATCHES_SQL + f"""
SELECT frame_id, camera, part, source, label, item, crop, {SQL_ROUND} FROM patches""")
def patch_build(spark, sf):
    return sampling.all_patches(V.framed_boxes(spark, sf)).select(
        *sampling.PATCH_COLUMNS, *rounded())


@query("S4_fixed_sample", "", """
SELECT event_id FROM (SELECT event_id FROM events ORDER BY md5('0:'||event_id), event_id LIMIT 3000)
ORDER BY event_id""")
def fixed_sample(spark, sf):
    return sampling.fixed_sample(V.table(spark, sf, "events").select("event_id"), "event_id", 3000)


@query("S5_class_sample", "patch_scores", """
SELECT label, key, rank FROM (SELECT label, key, row_number() OVER (PARTITION BY label ORDER BY md5('3:'||key), key) AS rank
FROM (SELECT label, frame_id||'-'||tile_id AS key FROM patch_scores)) WHERE rank<=24""")
def class_sample(spark, sf):
    df = V.patch_scores(spark, sf).select(
        "label", F.concat_ws("-", "frame_id", "tile_id").alias("key"))
    return sampling.class_sample(df, "label", "key", 24)


@query("S6_epoch_order", "", """
SELECT epoch, event_id, batch_id FROM (SELECT epoch, chunk, (row_number() OVER (PARTITION BY epoch
 ORDER BY md5((42+epoch)||':'||chunk), chunk)-1)//8 AS batch_id FROM (SELECT DISTINCT event_id//8 AS chunk FROM events)
 CROSS JOIN range(2) e(epoch)) JOIN events ON chunk=event_id//8""")
def epoch_order(spark, sf):
    df = V.table(spark, sf, "events").select("event_id")
    passes = [sampling.epoch_order(df, "event_id", e).withColumn("epoch", F.lit(e)) for e in (0, 1)]
    return passes[0].unionByName(passes[1]).select("epoch", "event_id", "batch_id")


@query("S6_epoch_files", "", """
SELECT epoch, event_id, batch_id, row_number() OVER (PARTITION BY epoch ORDER BY batch_id, event_id)-1 AS position FROM (
SELECT epoch, event_id, batch_id FROM (SELECT epoch, chunk, (row_number() OVER (PARTITION BY epoch
 ORDER BY md5((42+epoch)||':'||chunk), chunk)-1)//8 AS batch_id FROM (SELECT DISTINCT event_id//8 AS chunk FROM events)
 CROSS JOIN range(2) e(epoch)) JOIN events ON chunk=event_id//8)""")
def epoch_files(spark, sf):
    """Two epochs written in their order, with the place that every row has in the files."""
    df = V.table(spark, sf, "events").select("event_id")
    out = []
    for epoch in (0, 1):
        path = scratch_path(spark, "epoch")
        epochs.write_epoch(df, path, "event_id", epoch, batches=16)
        out.append(epochs.read_epoch(spark, path).withColumn("epoch", F.lit(epoch)))
    return out[0].unionByName(out[1]).select("epoch", "event_id", "batch_id", "position")


# ---------------------------------------------------------------- summaries

@query("G1_part_summary", "frame_base frame_boxes", PATCHES_SQL + """
SELECT part, count(*) AS n, count_if(label=1) AS positivos, count_if(label=0) AS negativos,
 count(DISTINCT camera) AS camaras FROM patches GROUP BY part""")
def part_summary(spark, sf):
    return summaries.part_summary(sampling.all_patches(V.framed_boxes(spark, sf)))


@query("G2_build_counters", "frame_base frame_boxes", f"""WITH {_negatives_sql()}
SELECT (SELECT count(*) FROM frame_base) AS cuadros, (SELECT count(*) FROM frame_base WHERE NOT readable) AS ilegibles,
 (SELECT count(*) FROM base WHERE nb>0) AS cuadros_con_humo, (SELECT count(*) FROM base WHERE nb=0) AS cuadros_sin_humo,
 (SELECT sum(nb)*2 FROM base)::BIGINT AS positivos, (SELECT count(*) FROM negs WHERE nb>0) AS neg_duros,
 (SELECT count(*) FROM negs WHERE nb=0) AS neg_limpios""")
def build_counters(spark, sf):
    df = V.frames(spark, sf).select(
        "frame_id", geo.readable_image(F.col("image.bytes")).alias("readable"),
        F.col("image.width").alias("width"), F.col("image.height").alias("height"),
        geo.parse_boxes(F.col("annotations"), F.col("image.width"), F.col("image.height"))
        .alias("boxes"))
    return summaries.build_counters(sampling.with_negative_windows(df))


@query("G12_box_percentiles", "frame_boxes", """
WITH s AS (SELECT 'w' AS side, bw AS v FROM frame_boxes WHERE readable UNION ALL SELECT 'h', bh FROM frame_boxes WHERE readable),
r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY v)-1 AS i, count(*) OVER (PARTITION BY side) AS n FROM s)
SELECT side, max(v) FILTER (WHERE i=floor(0.1::DOUBLE*(n-1))) AS p10, max(v) FILTER (WHERE i=floor(0.5::DOUBLE*(n-1))) AS p50,
 max(v) FILTER (WHERE i=floor(0.9::DOUBLE*(n-1))) AS p90 FROM r GROUP BY side""")
def box_percentiles(spark, sf):
    sides = _fractions(spark, sf).select(F.inline(F.array(
        F.struct(F.lit("w").alias("side"), F.col("w").alias("v")),
        F.struct(F.lit("h").alias("side"), F.col("h").alias("v")))))
    return lower_rank_percentiles(sides, "v", (0.1, 0.5, 0.9), ["side"])


@query("G13_most_common", "frame_base", """
SELECT camera, count(*) AS n FROM frame_base GROUP BY camera ORDER BY n DESC, camera LIMIT 8""")
def most_common(spark, sf):
    return summaries.most_common(V.frames(spark, sf).select("camera"), "camera", 8)


# ---------------------------------------------------------------- set operations

@query("U1_patch_union", "frame_base frame_boxes", PATCHES_SQL + """
SELECT source, part, count(*) AS n FROM patches GROUP BY ALL""")
def patch_union(spark, sf):
    df = V.framed_boxes(spark, sf)
    return sampling.positive_patches(df).unionByName(sampling.negative_patches(df)).groupBy(
        "source", "part").agg(F.count(F.lit(1)).alias("n"))


@query("U4_part_cameras", "frame_base", f"""
SELECT DISTINCT {V.sql_part()} AS part, camera FROM frame_base WHERE readable""")
def part_cameras(spark, sf):
    df = src.split_readable(V.frames(spark, sf))[0]
    return df.select(geo.split_part(F.col("camera"), F.col("partner")).alias("part"),
                     "camera").distinct()
