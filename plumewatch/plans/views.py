"""Smoke-camera views over the driver tables.

Every view is a narrow projection of one table: no shuffle, and no key of the source table is
gathered. `CTE` holds the same views for the SQL side; boxes there come straight from integers
instead of from annotation text, so the two sides are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumewatch import constants as C
from plumewatch.functions import codec, policy
from plumewatch.functions.geometry import parse_boxes, readable_image, split_part
from plumewatch.functions.hashing import digest, hex_int

TILES = 32


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def columns(spark: SparkSession, sf: str, name: str, *cols: str) -> DataFrame:
    """A pruned scan; its splits are those of the files."""
    return table(spark, sf, name).select(*cols)


def partner_of(n: Column) -> Column:
    return F.concat(F.lit("sdis-"), F.when(n % 8 == 7, F.lit("77")).otherwise(
        (n % 8).cast("string")))


# ---------------------------------------------------------------- annotated frames

def frames_from(orders: DataFrame) -> DataFrame:
    """One annotated frame per order; `n_boxes` boxes as text, some rows malformed or unreadable."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    size = [
        F.when(k % 23 == 0, big).when(k % 29 == 0, small).when(k % 31 == 0, tiny).otherwise(usual)
        for big, small, tiny, usual in ((1600, 640, 200, 1280), (1200, 480, 200, 720))]

    def thousandths(v):
        return F.concat(F.lit("0."), F.lpad(v.cast("string"), 3, "0"))

    def line(i):
        return F.concat_ws(
            " ", F.lit("0"),
            thousandths(100 + (c * 7919 + i * 131) % 800),
            thousandths(100 + (k * 31 + i * 977) % 800),
            thousandths(15 + (k + i * 7) % 50),
            thousandths(23 + i * 10))

    n = k % 5
    text = F.array_join(F.transform(
        F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(
            F.array().cast("array<int>")), line), "\n")
    text = F.when(k % 101 == 0, F.lit(None).cast("string")).when(
        k % 97 == 0, F.concat(text, F.lit("\n0 0.500 0.500 0.100"))).otherwise(text)
    # the first bytes of a PNG or a JPEG image of that size; the rest is noise
    wide, high = (F.lpad(F.hex(v), 8, "0") for v in size)
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), wide, high, F.lit("0802000000"))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC0001108"),
                    F.substring(high, 5, 4), F.substring(wide, 5, 4), F.lit("03012200021101031101"))
    head = F.when(k % 43 == 0, F.lit("00000000")).when(k % 2 == 0, png).otherwise(jpeg)
    return orders.select(
        k.alias("frame_id"),
        F.struct(
            F.unhex(F.concat(head, F.md5(k.cast("string")))).alias("bytes"),
            size[0].alias("width"), size[1].alias("height")).alias("image"),
        F.concat(F.lit("frame_"), k.cast("string"), F.lit(".jpg")).alias("image_name"),
        text.alias("annotations"),
        F.concat(F.lit("cam-"), c.cast("string")).alias("camera"),
        partner_of(c).alias("partner"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return frames_from(columns(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate"))


RASTER = (64, 48)


def raster_frames(spark: SparkSession, sf: str) -> DataFrame:
    """The bytes of each document as a run of small RGB frames with up to two boxes each.

    A frame is 9,216 bytes; the last one of a document repeats its bytes to fill the raster.
    """
    w, h = RASTER
    size = w * h * 3
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    count = F.greatest(F.lit(1), F.ceil(F.length(raw) / size)).cast("int")
    shots = columns(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", raw.alias("raw"), F.explode_outer(F.sequence(F.lit(0), count - 1)).alias("shot"))
    shots = shots.select(
        (F.col("doc_id") * 1000000 + F.col("shot")).alias("frame_id"),
        F.expr(f"substring(raw, shot * {size} + 1, {size})").alias("raw"))
    k = F.col("frame_id")
    hexed = F.when(F.length("raw") > 0, F.hex("raw")).otherwise("00")

    def thousandths(v):
        return F.concat(F.lit("0."), F.lpad(v.cast("string"), 3, "0"))

    text = F.array_join(F.transform(
        F.when(k % 3 > 0, F.sequence(F.lit(1), (k % 3).cast("int"))).otherwise(
            F.array().cast("array<int>")), lambda i: F.concat_ws(
            " ", F.lit("0"), thousandths(200 + (k * 31 + i * 97) % 600),
            thousandths(200 + (k * 17 + i * 53) % 600), thousandths(40 + (k + i * 7) % 90),
            thousandths(60 + (k + i * 13) % 90))), "\n")
    return shots.select(
        k, F.concat(F.lit("cam-"), (k % 50).cast("string")).alias("camera"),
        partner_of(k).alias("partner"), F.lit(w).alias("width"), F.lit(h).alias("height"),
        parse_boxes(text, F.lit(w), F.lit(h)).alias("boxes"),
        F.unhex(F.rpad(hexed, w * h * 6, hexed)).alias("data"))


def framed_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Readable frames with parsed pixel boxes."""
    # sizes are columns of their own first: then the image bytes are made for the filter only
    df = frames(spark, sf).where(readable_image(F.col("image.bytes"))).select(
        "frame_id", "camera", "partner", "annotations", F.col("image.width").alias("width"),
        F.col("image.height").alias("height"))
    return df.select(
        "frame_id", "camera", "partner", "width", "height",
        parse_boxes(F.col("annotations"), F.col("width"), F.col("height")).alias("boxes"))


def line_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """A long box table keyed by frame, one box per order line, on 1280x720 frames."""
    li = columns(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                 "l_quantity")
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    w, h = (float(v) for v in C.FRAME_SIZE)
    xc = (100 + (p * 7919) % 800) / F.lit(1000.0)
    yc = (100 + (s * 7919 + p * 31) % 800) / F.lit(1000.0)
    bw = (15 + F.col("l_quantity").cast("int")) / F.lit(1000.0)
    bh = (23 + 10 * n) / F.lit(1000.0)
    return li.select(
        F.col("l_orderkey").alias("frame_id"), n.alias("box_id"), p.alias("part_key"),
        s.alias("supp_key"),
        ((xc - bw / 2) * w).alias("x0"), ((yc - bh / 2) * h).alias("y0"),
        ((xc - bw / 2) * w + bw * w).alias("x1"), ((yc - bh / 2) * h + bh * h).alias("y1"))


# ---------------------------------------------------------------- captures and tile scores

def captures_from(events: DataFrame) -> DataFrame:
    u = F.col("user_id")
    return events.select(
        F.col("event_id").alias("frame_id"),
        F.concat(F.lit("cam-"), u.cast("string")).alias("camera"),
        partner_of(u).alias("partner"), "ts",
        (F.col("event_type") != "view").alias("smoke"))


def captures(spark: SparkSession, sf: str) -> DataFrame:
    return captures_from(columns(spark, sf, "events", "event_id", "user_id", "ts", "event_type"))


def tiles_of(caps: DataFrame, salt: str = "", tiles: Column | None = None) -> DataFrame:
    """Scored tiles per capture on the INT8 lattice `b` (0..255): all 32, or those of an array."""
    every = F.sequence(F.lit(0), F.lit(TILES - 1))
    df = caps.select("*", F.explode(every if tiles is None else tiles).alias("tile_id"))
    key = [F.col("frame_id"), F.col("tile_id")]
    df = df.withColumn("h", digest(*( [salt] if salt else []), *key))
    b1, b2 = hex_int(F.col("h"), 1, 2), hex_int(F.col("h"), 3, 2)
    planted = F.col("smoke") & (F.col("tile_id") == F.col("frame_id") % TILES)
    b = F.when(planted, F.greatest(b1, b2)).otherwise(F.floor(b1 * b2 / 256)).cast("int")
    col, row = F.col("tile_id") % 8, F.floor(F.col("tile_id") / 8).cast("int")
    return (
        df.withColumn("b", b).drop("h")
        .withColumn("x", F.when(col == 7, 1056).otherwise(col * 168))
        .withColumn("y", F.when(row == 3, 496).otherwise(row * 168))
        .withColumn("score", F.col("b") / F.lit(256.0))
        .withColumn("prob_x1000", F.floor((F.col("b") * 1000 + 128) / 256).cast("int")))


def tile_scores(spark: SparkSession, sf: str, salt: str = "") -> DataFrame:
    return tiles_of(captures(spark, sf), salt)


def scored_frames_of(caps: DataFrame, salt: str = "") -> DataFrame:
    """Captures with the scores of their tiles as an array in tile order, as a scorer emits them.

    In two steps, because a lambda repeats every expression it mentions: each digest is computed and read once.
    """
    draws = F.transform(F.sequence(F.lit(0), F.lit(TILES - 1)), lambda tile: hex_int(
        digest(*([salt] if salt else []), F.col("frame_id"), tile), 1, 4))
    planted = F.when(F.col("smoke"), F.col("frame_id") % TILES).otherwise(-1)

    def score(draw: Column, tile: Column) -> Column:
        b1, b2 = F.shiftright(draw, 8), draw.bitwiseAND(255)
        return F.when(tile == planted, F.greatest(b1, b2)).otherwise(F.shiftright(b1 * b2, 8)) / F.lit(256.0)

    return caps.select("*", F.transform(draws, score).alias("scores"))


def frame_tile_scores(spark: SparkSession, sf: str, salt: str = "") -> DataFrame:
    return scored_frames_of(captures(spark, sf), salt)

def patch_scores(spark: SparkSession, sf: str, salt: str = "") -> DataFrame:
    """Scored patches: a positive and three hard negatives per smoke capture, four clean ones else."""
    smoke = F.col("smoke")
    first = F.when(smoke, F.pmod(F.col("frame_id"), F.lit(TILES))).otherwise(0)
    # only the tiles that become patches are made
    tiles = F.array(*[((first + i) % TILES).cast("int") for i in range(4)])
    offset = F.pmod(F.col("tile_id") - F.col("frame_id") % TILES, F.lit(TILES))
    caps = captures(spark, sf).withColumn("part", split_part(F.col("camera"), F.col("partner")))
    return tiles_of(caps, salt, tiles).select(
        "frame_id", "tile_id", "camera", "part",
        F.when(smoke & (offset == 0), 1).otherwise(0).alias("label"),
        F.when(smoke & (offset == 0), C.POSITIVE).when(smoke, C.HARD).otherwise(C.CLEAN)
        .alias("source"),
        "b", "score")


# ---------------------------------------------------------------- telemetry

EPOCH0 = 1704067200


def telemetry_from(events: DataFrame, dense: bool = False) -> DataFrame:
    """Per-pass node readings; `dense` squeezes the month into thirty hours."""
    e = F.col("event_id")
    secs = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    if dense:
        secs = F.floor(secs / 24)
    node = (F.col("user_id") % 256).cast("int")
    b = hex_int(digest("T", e), 1, 2)
    df = events.select(
        e.alias("event_id"), node.alias("node_id"), secs.cast("bigint").alias("secs"),
        (2400 + (e * 7919) % 1100).cast("int").alias("mv"),
        (e % 140 - 45).cast("int").alias("temp_c"),
        (e % 111).cast("int").alias("humidity"),
        F.floor((b * 1000 + 128) / 256).cast("int").alias("prob_x1000"),
        (e % 50 != 0).alias("clock_ok"))
    start = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"
    return df.select(
        "*", F.expr(f"{start} + make_dt_interval(0, 0, 0, secs)").alias("ts"),
        F.expr(f"to_date({start} + make_dt_interval(0, 0, 0, secs))").alias("date"),
        F.floor(F.col("secs") % 86400 / 3600).cast("int").alias("hour"),
        F.floor(F.col("secs") % 3600 / 60).cast("int").alias("minute"),
        policy.battery_percent(F.col("mv")).alias("soc"),
        (-61234500 - F.col("node_id") * 1000).alias("lat_e7"),
        (-751234500 + F.col("node_id") * 1000).alias("lon_e7"))


def telemetry(spark: SparkSession, sf: str, dense: bool = False) -> DataFrame:
    return telemetry_from(columns(spark, sf, "events", "event_id", "user_id", "ts"), dense)


ALERT_FROM = 300


def alerts_from(events: DataFrame, dense: bool = True) -> DataFrame:
    t = telemetry_from(events, dense)
    return t.where(F.col("clock_ok") & (F.col("prob_x1000") >= ALERT_FROM))


def uplinks_from(events: DataFrame) -> DataFrame:
    """Encoded frames; some ports are unknown and some payloads are cut short."""
    t = telemetry_from(events)
    e = F.col("event_id")
    alert = codec.encode_alert(
        F.col("node_id"), F.floor(e % 7 / 2), codec.confidence_percent(F.col("prob_x1000")),
        F.col("soc"), F.col("temp_c"), e % 32)
    beat = codec.encode_heartbeat(
        F.col("node_id"), F.col("lat_e7"), F.col("lon_e7"), F.col("soc"), F.col("temp_c"),
        F.col("humidity"), (e % 4).cast("int"))
    port = F.when(e % 83 == 0, 99).when(e % 5 == 0, C.PORT_HEARTBEAT).otherwise(C.PORT_ALERT)
    payload = F.when(port == C.PORT_HEARTBEAT, beat).otherwise(alert)
    return t.select(
        e.alias("uplink_id"), F.col("ts").alias("node_ts"), port.alias("fport"),
        F.when(e % 71 == 0, F.substring(payload, 1, 4)).otherwise(payload).alias("payload"))


def uplinks(spark: SparkSession, sf: str) -> DataFrame:
    return uplinks_from(columns(spark, sf, "events", "event_id", "user_id", "ts"))


def link_lines(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines of the short-range link, some cut off."""
    e = F.col("event_id")
    text = F.format_string(
        '{"dispositivo":"NODE%s-%s","alerta":"%s","confianza":%s,"rssi":%s}',
        F.col("node_id").cast("string"), e.cast("string"),
        F.when(e % 3 == 0, "test").otherwise("humo"),
        F.format_string("0.%02d", e % 100), (-(e % 60) - 40).cast("string"))
    return telemetry(spark, sf).select(
        F.when(e % 89 == 0, F.substring(text, 1, 20)).otherwise(text).alias("value"))


def trace_lines(spark: SparkSession, sf: str, ragged: bool = False) -> DataFrame:
    """Three trace lines per pass; `ragged` passes have no capture, two uplinks or lines of other kinds."""
    e = F.col("event_id")
    t = telemetry(spark, sf)
    alert = F.hex(codec.encode_alert(
        F.col("node_id"), F.lit(1), codec.confidence_percent(F.col("prob_x1000")), F.col("soc"),
        F.col("temp_c"), e % 32))
    head = F.format_string("[nodo] %s %02d:%02d  SoC=%d%%  capturas=%d",
                           F.col("date").cast("string"), "hour", "minute", "soc", e)
    capture = F.format_string(
        "[nodo] teselas=32 sobre=%d pmax=0.%03d (%d,%d) remuestreo=%dms inferencia=%dms",
        e % 4, e % 1000, (e % 7) * 168, (e % 3) * 168, e % 500, e % 9000)
    uplink = F.format_string("[lora] uplink fport=10 fcnt=%d payload=%s", e, alert)
    if not ragged:
        return t.select(F.explode(F.array(head, capture, uplink)).alias("value"))
    again = F.format_string("[lora] uplink fport=10 fcnt=%d payload=%s", e + 1, alert)
    return t.select(F.explode(F.array_compact(F.array(
        head, F.when(e % 3 == 0, F.lit("[nodo] AVISO: sin sesion LoRaWAN, la pasada no podra transmitir")),
        F.when(e % 5 != 0, capture), uplink, F.when(e % 7 == 0, again)))).alias("value"))


# ---------------------------------------------------------------- keyed trees

def tree_a(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("hash"))


def _edited(d: DataFrame, shift: int) -> DataFrame:
    k = F.col("doc_id")
    h = F.md5("text")
    kept = F.when(k % (13 + shift) != 0, F.struct(
        k.cast("string").alias("path"),
        F.when(k % (17 + shift) == 0, F.concat(F.lit("x"), h)).otherwise(h).alias("hash")))
    added = F.when(k % (19 + shift) == 0, F.struct(
        (k + 1000000).cast("string").alias("path"), h.alias("hash")))
    return d.select("*", F.inline(F.array_compact(F.array(kept, added))))


def tree_b(spark: SparkSession, sf: str) -> DataFrame:
    return _edited(table(spark, sf, "documents"), 0).select("path", "hash")


def masters(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("lang").alias("library"), F.col("doc_id").cast("string").alias("path"),
                    F.md5("text").alias("hash"))


def copies(spark: SparkSession, sf: str) -> DataFrame:
    """Three edited copies of every library, one exact copy, and one library without a master."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    out = None
    for i in range(4):
        part = _edited(d, i) if i < 3 else d.select(
            "*", F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("hash"))
        library = F.when((F.lit(i) == 2) & (F.col("lang") == "en"), "orphan").otherwise(F.col("lang"))
        part = part.select(F.concat(F.lit("copy"), F.lit(str(i))).alias("copy_id"),
                           library.alias("library"), "path", "hash")
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- SQL side

HEX = "('0x'||substr({h},{start},{n}))::BIGINT"


def sql_hex(h: str, start: int, n: int) -> str:
    return HEX.format(h=h, start=start, n=n)


def sql_unit(h: str, slot: int) -> str:
    return f"({sql_hex(h, 1 + 8 * slot, 8)}::DOUBLE/4294967296::DOUBLE)"


def _sql_partner(n: str) -> str:
    return f"CASE WHEN {n}%8=7 THEN 'sdis-77' ELSE 'sdis-'||({n}%8) END"


def sql_part(camera: str = "camera", partner: str = "partner") -> str:
    return (f"CASE WHEN {partner}='sdis-77' THEN 'cruzado' WHEN {sql_hex(f'md5({camera})', 1, 8)}"
            "%100<20 THEN 'val' ELSE 'train' END")


def _sql_tiles(salt: str) -> str:
    return f"""SELECT frame_id,camera,partner,ts,smoke,tile_id,b,
 CASE WHEN tile_id%8=7 THEN 1056 ELSE (tile_id%8)*168 END AS x,
 CASE WHEN tile_id//8=3 THEN 496 ELSE (tile_id//8)*168 END AS y,
 b/256.0::DOUBLE AS score, (b*1000+128)//256 AS prob_x1000 FROM (
 SELECT *, CASE WHEN smoke AND tile_id=frame_id%32 THEN greatest(b1,b2) ELSE (b1*b2)//256 END AS b
 FROM (SELECT *, {sql_hex('h', 1, 2)} AS b1, {sql_hex('h', 3, 2)} AS b2 FROM (
 SELECT *, md5({salt}frame_id||':'||tile_id) AS h FROM (
 SELECT c.*, unnest(range(32)) AS tile_id FROM captures c))))"""


def _sql_patches(tiles: str) -> str:
    return f"""SELECT frame_id,tile_id,camera,{sql_part()} AS part,
 CASE WHEN smoke AND o=0 THEN 1 ELSE 0 END AS label,
 CASE WHEN smoke AND o=0 THEN 'positive' WHEN smoke THEN 'duro' ELSE 'limpio' END AS source,b,score
 FROM (SELECT *, (tile_id-frame_id%32+32)%32 AS o FROM {tiles})
 WHERE CASE WHEN smoke THEN o<4 ELSE tile_id<4 END"""


def _sql_telemetry(secs: str) -> str:
    return f"""SELECT *, TIMESTAMP '2024-01-01'+to_seconds(secs) AS ts,
 CAST(TIMESTAMP '2024-01-01'+to_seconds(secs) AS DATE) AS date,
 (secs%86400)//3600 AS hour, (secs%3600)//60 AS minute,
 -61234500-node_id*1000 AS lat_e7, -751234500+node_id*1000 AS lon_e7,
 CASE WHEN mv>=3400 THEN 100 WHEN mv>=3300 THEN 90+(mv-3300)*10//100 WHEN mv>=3250 THEN 70+(mv-3250)*20//50
 WHEN mv>=3200 THEN 40+(mv-3200)*30//50 WHEN mv>=3150 THEN 20+(mv-3150)*20//50
 WHEN mv>=3000 THEN 10+(mv-3000)*10//150 WHEN mv>=2800 THEN 5+(mv-2800)*5//200
 WHEN mv>=2500 THEN (mv-2500)*5//300 ELSE 0 END AS soc FROM (
 SELECT event_id, user_id%256 AS node_id, {secs} AS secs, 2400+(event_id*7919)%1100 AS mv,
 event_id%140-45 AS temp_c, event_id%111 AS humidity,
 ({sql_hex("md5('T:'||event_id)", 1, 2)}*1000+128)//256 AS prob_x1000, event_id%50<>0 AS clock_ok
 FROM events)"""


_SECS = "(epoch_us(ts)//1000000-1704067200)"

CTE = {
    "frame_base": ((), f"""SELECT o_orderkey AS frame_id, o_custkey, 'cam-'||o_custkey AS camera,
 {_sql_partner('o_custkey')} AS partner, strftime(o_orderdate,'%Y-%m-%d') AS date,
 CASE WHEN o_orderkey%23=0 THEN 1600 WHEN o_orderkey%29=0 THEN 640 WHEN o_orderkey%31=0 THEN 200 ELSE 1280 END AS width,
 CASE WHEN o_orderkey%23=0 THEN 1200 WHEN o_orderkey%29=0 THEN 480 WHEN o_orderkey%31=0 THEN 200 ELSE 720 END AS height,
 o_orderkey%43<>0 AS readable,
 CASE WHEN o_orderkey%101=0 THEN 0 ELSE o_orderkey%5 END AS n_boxes,
 (o_orderkey%101<>0 AND (o_orderkey%5>0 OR o_orderkey%97=0)) AS smoke_text FROM orders"""),
    "frame_boxes": (("frame_base",), """SELECT frame_id,camera,partner,width,height,readable,i AS box_no,
 xc,yc,bw,bh,(xc-bw/2)*width AS x0,(yc-bh/2)*height AS y0,
 (xc-bw/2)*width+bw*width AS x1,(yc-bh/2)*height+bh*height AS y1 FROM (
 SELECT *, (100+(o_custkey*7919+i*131)%800)/1000.0::DOUBLE AS xc,(100+(frame_id*31+i*977)%800)/1000.0::DOUBLE AS yc,
 (15+(frame_id+i*7)%50)/1000.0::DOUBLE AS bw,(23+i*10)/1000.0::DOUBLE AS bh FROM (
 SELECT f.*, unnest(range(1,n_boxes+1)) AS i FROM frame_base f))"""),
    "raster_base": ((), f"""SELECT frame_id,'cam-'||(frame_id%50) AS camera,{_sql_partner('frame_id')} AS partner,
 64 AS width,48 AS height,true AS readable,frame_id%3 AS n_boxes,
 rpad(CASE WHEN part='' THEN '00' ELSE part END,18432,CASE WHEN part='' THEN '00' ELSE part END) AS hx FROM (
 SELECT doc_id*1000000+shot AS frame_id, substr(h,(shot*18432+1)::BIGINT,18432) AS part FROM (
 SELECT *, unnest(range(greatest(1,(length(h)+18431)//18432))) AS shot FROM (
 SELECT doc_id, hex(encode(coalesce(text,''))) AS h FROM documents)))"""),
    "raster_boxes": (("raster_base",), """SELECT *,(xc-bw/2)*width AS x0,(yc-bh/2)*height AS y0,
 (xc-bw/2)*width+bw*width AS x1,(yc-bh/2)*height+bh*height AS y1 FROM (
 SELECT frame_id,camera,partner,width,height,readable,i AS box_no,(200+(frame_id*31+i*97)%600)/1000.0::DOUBLE AS xc,
 (200+(frame_id*17+i*53)%600)/1000.0::DOUBLE AS yc,(40+(frame_id+i*7)%90)/1000.0::DOUBLE AS bw,
 (60+(frame_id+i*13)%90)/1000.0::DOUBLE AS bh FROM (SELECT f.*, unnest(range(1,n_boxes+1)) AS i FROM raster_base f))"""),
    "line_boxes": ((), """SELECT frame_id,box_id,part_key,supp_key,(xc-bw/2)*1280 AS x0,(yc-bh/2)*720 AS y0,
 (xc-bw/2)*1280+bw*1280 AS x1,(yc-bh/2)*720+bh*720 AS y1 FROM (
 SELECT l_orderkey AS frame_id,l_linenumber AS box_id,l_partkey AS part_key,l_suppkey AS supp_key,
 (100+(l_partkey*7919)%800)/1000.0::DOUBLE AS xc,(100+(l_suppkey*7919+l_partkey*31)%800)/1000.0::DOUBLE AS yc,
 (15+l_quantity::INT)/1000.0::DOUBLE AS bw,(23+10*l_linenumber)/1000.0::DOUBLE AS bh FROM lineitem)"""),
    "captures": ((), f"""SELECT event_id AS frame_id,'cam-'||user_id AS camera,
 {_sql_partner('user_id')} AS partner,ts,event_type<>'view' AS smoke FROM events"""),
    "tile_scores": (("captures",), _sql_tiles("")),
    "model_b_scores": (("captures",), _sql_tiles("'B:'||")),
    "patch_scores": (("tile_scores",), _sql_patches("tile_scores")),
    "patch_scores_b": (("model_b_scores",), _sql_patches("model_b_scores")),
    "telemetry": ((), _sql_telemetry(_SECS)),
    "telemetry_dense": ((), _sql_telemetry(f"{_SECS}//24")),
    "alerts": (("telemetry_dense",), f"""SELECT * FROM telemetry_dense
 WHERE clock_ok AND prob_x1000>={ALERT_FROM}"""),
    "uplinks": (("telemetry",), """SELECT *, CASE WHEN event_id%71=0 THEN 4 WHEN fport=11 THEN 14 ELSE 6 END AS n_bytes,
 (event_id%7)//2 AS kind, CASE WHEN prob_x1000>=1000 THEN 100 ELSE (prob_x1000+5)//10 END AS conf_pct,
 greatest(-40,least(87,temp_c)) AS temp, least(100,humidity) AS hr, event_id%32 AS flags FROM (
 SELECT *, CASE WHEN event_id%83=0 THEN 99 WHEN event_id%5=0 THEN 11 ELSE 10 END AS fport FROM telemetry)"""),
    "tree_a": ((), "SELECT doc_id::VARCHAR AS path, md5(text) AS hash FROM documents"),
    "tree_b": ((), """SELECT doc_id::VARCHAR AS path,
 CASE WHEN doc_id%17=0 THEN 'x'||md5(text) ELSE md5(text) END AS hash FROM documents WHERE doc_id%13<>0
 UNION ALL SELECT (doc_id+1000000)::VARCHAR, md5(text) FROM documents WHERE doc_id%19=0"""),
    "masters": ((), "SELECT lang AS library, doc_id::VARCHAR AS path, md5(text) AS hash FROM documents"),
    "copies": ((), " UNION ALL ".join(f"""
 SELECT 'copy{i}' AS copy_id, {"CASE WHEN lang='en' THEN 'orphan' ELSE lang END" if i == 2 else 'lang'} AS library,
 doc_id::VARCHAR AS path, CASE WHEN doc_id%{17 + i}=0 THEN 'x'||md5(text) ELSE md5(text) END AS hash
 FROM documents WHERE doc_id%{13 + i}<>0
 UNION ALL SELECT 'copy{i}', {"CASE WHEN lang='en' THEN 'orphan' ELSE lang END" if i == 2 else 'lang'},
 (doc_id+1000000)::VARCHAR, md5(text) FROM documents WHERE doc_id%{19 + i}=0""" for i in range(3)) + """
 UNION ALL SELECT 'copy3', lang, doc_id::VARCHAR, md5(text) FROM documents"""),
}


def with_views(needs: str, body: str) -> str:
    """SQL text: the named views (and what they build on) in front of `body`."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in CTE[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    head = ",\n".join(f"{n} AS ({CTE[n][1]})" for n in order)
    body = body.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {head},\n{body[4:].strip()}"
    return f"WITH {head}\n{body}"
