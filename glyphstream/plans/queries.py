"""Registered queries: each runs bytes made of the driver's tables through the engine, and SQL over the tables checks it.

The tables hold no media. ``plans.synth`` writes .sup bytes, transport packets or run lengths
out of them, the query reads those back, and the oracle computes the same from the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import columns as C
from ..functions.codec import parse_timestamp
from ..functions.language import normalize_language
from ..operators import ndjson, recipes
from ..sources.mkv import Movie
from . import assemble as A
from . import containers, synth
from .synth import TICKS, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Register a function under its name, with its oracle."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# The relation that the events' bytes stand for.
SETS = f"""
WITH sets AS (
  SELECT 1 + user_id % 4 AS track_id, event_id AS e, user_id, event_type, CAST(event_id * {TICKS} AS BIGINT) AS pts,
         CASE event_type WHEN 'signup' THEN 'epoch_start' WHEN 'view' THEN 'acquisition_point' ELSE 'normal' END AS state
  FROM events WHERE event_type <> 'error'),
numbered AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY e) - 1 AS idx FROM sets)
"""


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.event_sets(spark, sf_dir)


def _structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.project(_sets(spark, sf_dir), decode=False)


@query(SETS + "SELECT track_id, count(*) AS display_sets FROM sets GROUP BY track_id")
def sets_per_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.sets_per_track(_sets(spark, sf_dir)).select("track_id", "display_sets")


@query(SETS + "SELECT track_id, idx AS index, pts, pts / 90.0::DOUBLE AS pts_ms, state FROM numbered")
def set_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.timing(_sets(spark, sf_dir)).drop("file")


@query(SETS + "SELECT track_id, idx AS index, pts FROM numbered WHERE state = 'epoch_start'")
def epoch_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.epoch_starts(_sets(spark, sf_dir)).select("track_id", "index", "pts")


@query(SETS + "SELECT track_id, pts, row_number() OVER (PARTITION BY track_id ORDER BY e) - 1 AS index FROM sets WHERE pts / 90.0::DOUBLE BETWEEN 4000 AND 20000")
def time_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.assemble(synth.read_segments(table(spark, sf_dir, "events")))
    return A.numbered(A.in_time(found, 4000, 20000)).select("track_id", "pts", "index")


@query(SETS + "SELECT track_id, idx AS index, pts FROM numbered WHERE track_id IN (1, 3)")
def track_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = synth.event_blocks(table(spark, sf_dir, "events")).filter(F.col("track_id").isin(1, 3))
    return A.numbered(A.assemble(A.segments(blocks, whole_times=True))).select("track_id", "index", "pts")


@query("SELECT 1 + user_id % 4 AS track_id, count(*) FILTER (event_type = 'error') AS discarded, count(*) FILTER (event_type <> 'error') AS complete FROM events GROUP BY 1")
def incomplete_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets that a PCS opens and nothing closes."""
    segments = synth.read_segments(table(spark, sf_dir, "events"))
    opened = segments.filter("segment_type = 'PCS'").groupBy("track_id").agg(F.count(F.lit(1)).alias("opened"))
    complete = A.assemble(segments).groupBy("track_id").agg(F.count(F.lit(1)).alias("complete"))
    return opened.join(complete, "track_id", "left").select("track_id", (F.col("opened") - F.coalesce("complete", F.lit(0))).alias("discarded"), F.coalesce("complete", F.lit(0)).cast("long").alias("complete"))


@query(
    "SELECT 1 + user_id % 4 AS track_id, t.segment_type, count(*) AS segments FROM events, (VALUES ('PCS'), ('WDS'), ('PDS'), ('END')) t(segment_type)"
    " WHERE t.segment_type <> 'END' OR event_type <> 'error' GROUP BY ALL"
)
def segment_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.read_segments(table(spark, sf_dir, "events")).groupBy("track_id", "segment_type").agg(F.count(F.lit(1)).alias("segments"))


@query(SETS + "SELECT track_id, count(*) AS display_sets, 4 * count(*) AS segments, min(pts) AS first_pts, max(pts) AS last_pts, count(*) AS n_pcs, CAST(0 AS BIGINT) AS n_ods FROM sets GROUP BY track_id")
def track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.summary(_sets(spark, sf_dir)).select("track_id", "display_sets", "segments", "first_pts", "last_pts", "n_pcs", "n_ods")


PLACED = SETS + ", placed AS (SELECT *, e % 5 AS object_id, user_id % 1920 AS x, (e * 7) % 1080 AS y FROM numbered WHERE event_type <> 'purchase') "


@query(PLACED + "SELECT track_id, idx AS index, object_id, 0 AS window_id, x, y, CASE WHEN e % 3 = 0 THEN 10 END AS crop_sum FROM placed")
def object_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recipes.placements(_structured(spark, sf_dir))
    crop = F.col("crop.x") + F.col("crop.y") + F.col("crop.width") + F.col("crop.height")
    return found.select("track_id", "index", "object_id", "window_id", "x", "y", crop.alias("crop_sum"))


@query(SETS + "SELECT track_id, idx AS index, e % 65536 AS number, state, 1920 AS video_width, 1080 AS video_height, event_type = 'click' AS palette_only, e % 256 AS palette_id FROM numbered")
def compositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structured(spark, sf_dir).select("track_id", "index", *[f"composition.{n}" for n in ("number", "state", "video_width", "video_height", "palette_only", "palette_id")])


@query(SETS + "SELECT track_id, idx AS index, 0 AS id, e % 1900 AS x, (e * 3) % 1000 AS y, (e * 5) % 700 AS width, (e * 7) % 90 AS height FROM numbered")
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structured(spark, sf_dir).select("track_id", "index", F.explode("windows").alias("w")).select("track_id", "index", "w.*")


ENTRIES = SETS + """, entries AS (
  SELECT track_id, idx AS index, e % 256 AS palette_id, i AS id, (e + 40 * i) % 256 AS luminance, (3 * e + 40 * i) % 256 AS cr, (5 * e + 40 * i) % 256 AS cb, CASE WHEN i % 3 = 0 THEN 0 ELSE 255 END AS alpha
  FROM numbered, range(5) t(i)) """


@query(ENTRIES + "SELECT * FROM entries WHERE alpha > 0")
def palette_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.visible_entries(_structured(spark, sf_dir)).drop("file")


def _built(parts: DataFrame) -> DataFrame:
    """Sets whose palettes were changed, written again by Catalyst and read back."""
    written = parts.select(
        "file", "track_id", F.col("set_seq").alias("block_seq"), "pts", F.lit(0).cast("long").alias("dts"), F.lit("sup").alias("framing"),
        F.concat(
            C.sup_bytes(F.col("pts"), F.lit(0), F.lit("PCS"), C.write_pcs(F.col("composition"))), C.joined(F.transform("palettes", lambda p: C.sup_bytes(F.col("pts"), F.lit(0), F.lit("PDS"), C.write_pds(p)))),
            C.sup_bytes(F.col("pts"), F.lit(0), F.lit("END"), F.lit(b"")),
        ).alias("data"),
    )
    return A.project(A.numbered(A.assemble(A.segments(written))), decode=False)


@query(ENTRIES + "SELECT track_id, index, id, least(255, luminance + 20) AS luminance, alpha FROM entries")
def palette_brighten(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = _built(recipes.brighten(_structured(spark, sf_dir), 20))
    return again.select("track_id", "index", F.explode(F.flatten(F.transform("palettes", lambda p: p["entries"]))).alias("e")).select("track_id", "index", "e.id", "e.luminance", "e.alpha")


@query(
    ENTRIES + """SELECT track_id, index, id, greatest(0, least(255, trunc(luminance + 1.402::DOUBLE * (cr - 128))))::INTEGER AS r,
    greatest(0, least(255, trunc(luminance - 0.344136::DOUBLE * (cb - 128) - 0.714136::DOUBLE * (cr - 128))))::INTEGER AS g,
    greatest(0, least(255, trunc(luminance + 1.772::DOUBLE * (cb - 128))))::INTEGER AS b, alpha AS a FROM entries"""
)
def palette_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _structured(spark, sf_dir).select("track_id", "index", F.explode("palettes").alias("p")).select("track_id", "index", F.explode("p.entries").alias("e"))
    return found.select("track_id", "index", "e.id", C.rgba(F.col("e")).alias("c")).select("track_id", "index", "id", "c.*")


@query(SETS + "SELECT track_id, idx AS index, pts FROM numbered WHERE state = 'normal' AND event_type = 'purchase'")
def clear_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.clear_events(_structured(spark, sf_dir)).select("track_id", "index", "pts")


@query(PLACED + "SELECT track_id, idx AS index, object_id, e % 1900 AS window_x, CAST(5 AS BIGINT) AS entries, true AS no_object FROM placed")
def placement_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids looked up within their set: window and palette exist, the object doesn't."""
    found = recipes.resolved(_structured(spark, sf_dir))
    return found.select("track_id", "index", F.col("placement.object_id").alias("object_id"), F.col("window.x").alias("window_x"), F.size("palette.entries").cast("long").alias("entries"), F.col("object").isNull().alias("no_object"))


@query(SETS + "SELECT track_id, idx AS index, (idx + 1) / n::DOUBLE AS progress FROM numbered JOIN (SELECT track_id, count(*) AS n FROM sets GROUP BY 1) USING (track_id)")
def set_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = _sets(spark, sf_dir)
    totals = sets.groupBy("file", "track_id").agg(F.count(F.lit(1)).alias("display_set_count"))
    return recipes.progress(sets, totals).select("track_id", "index", "progress")


@query(SETS + "SELECT track_id, idx AS index, lead(pts) OVER (PARTITION BY track_id ORDER BY e) - pts AS ticks FROM numbered")
def set_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.durations(_sets(spark, sf_dir)).select("track_id", "index", "ticks")


@query(SETS + "SELECT track_id, idx AS index, sum(CAST(state = 'epoch_start' AS BIGINT)) OVER (PARTITION BY track_id ORDER BY e)::BIGINT AS epoch FROM numbered")
def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.with_epoch(_sets(spark, sf_dir)).select("track_id", "index", "epoch")


@query(SETS + "SELECT track_id, idx AS index, pts FROM numbered QUALIFY row_number() OVER (ORDER BY e) <= 25")
def first_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sets of the file, its tracks interleaved: a top-k report."""
    return _sets(spark, sf_dir).orderBy("set_seq").limit(25).select("track_id", "index", "pts")


@query(
    """SELECT 1 + user_id % 4 AS track_id, count(*) AS sets,
    sum(13 + 11 + CASE WHEN event_type = 'purchase' THEN 0 WHEN event_id % 3 = 0 THEN 16 ELSE 8 END + 13 + 10 + 13 + 27 + 13)::BIGINT AS bytes
    FROM events WHERE event_type <> 'error' GROUP BY 1"""
)
def sup_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that the .sup writer makes of each track."""
    return A.sup_of(_sets(spark, sf_dir)).groupBy("track_id").agg(F.count(F.lit(1)).alias("sets"), F.sum(F.octet_length("sup")).alias("bytes"))


@query(
    SETS + """SELECT track_id, idx AS index, pts, pts / 90.0::DOUBLE AS pts_ms, e % 65536 AS number, state, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS placements,
    e % 1900 AS window_x, 5 AS entries FROM numbered"""
)
def ndjson_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured sets as JSON lines, parsed, built and read again."""
    lines = ndjson.to_json_lines(A.project(_sets(spark, sf_dir))).select((F.col("set_seq") + 1).alias("line"), "value")
    again = A.project(A.numbered(ndjson.encoded(ndjson.parse_lines(lines))), decode=False)
    return again.select(
        "track_id", "index", "pts", "pts_ms", "composition.number", "composition.state", F.size("composition.objects").alias("placements"), F.col("windows")[0]["x"].alias("window_x"),
        F.size(F.col("palettes")[0]["entries"]).alias("entries"),
    )



@query(
    """SELECT event_id AS line, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 + user_id % 4 END AS track_id,
    CASE WHEN event_id % 2 = 0 THEN event_id * 3600 ELSE CAST(floor((event_id * 40.5::DOUBLE) * 90 + 0.5) AS BIGINT) END AS pts FROM events WHERE event_type <> 'error' AND event_type <> 'click'"""
)
def encode_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with pts, or pts_ms alone; without a track for some, of other types, and without a composition."""
    e = table(spark, sf_dir, "events")
    track = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.format_string('"track_id":%d,', 1 + F.col("user_id") % 4))
    time = F.when(F.col("event_id") % 2 == 0, F.format_string('"pts":%d', F.col("event_id") * 3600)).otherwise(F.format_string('"pts_ms":%.1f', F.col("event_id") * 40.5))
    body = F.lit('{"state":"normal","video_width":1920,"video_height":1080,"number":1,"palette_only":false,"palette_id":0}')
    line = F.concat(F.lit('{"type":"'), F.when(F.col("event_type") == "error", "tracks").otherwise("display_set"), F.lit('",'), track, time, F.lit(',"composition":'), F.when(F.col("event_type") == "click", "null").otherwise(body), F.lit("}"))
    parsed = ndjson.parse_lines(e.select(F.col("event_id").alias("line"), line.alias("value")))
    return ndjson.encoded(parsed).select(F.col("set_seq").alias("line"), "track_id", "pts")


# Bitmaps of orders

BITMAPS = """
WITH lines AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 0 ELSE ascii(l_returnflag) END AS v, CAST(l_quantity AS BIGINT) % 8 AS run, ascii(l_linestatus) AS s FROM lineitem),
codes AS (SELECT l_orderkey, l_linenumber, v, run, s, repeat(printf('%02X', v), CAST(run AS INTEGER)) || repeat(printf('%02X', s), CAST(8 - run AS INTEGER)) AS code FROM lines),
orders_ AS (SELECT l_orderkey, string_agg(code, '' ORDER BY l_linenumber, code) AS code, count(*) AS height FROM codes GROUP BY l_orderkey)
"""


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = synth.order_bitmaps(table(spark, sf_dir, "lineitem"))
    return b.withColumn("rle", C.rle_encode("pixels", "width", "height"))


@query(BITMAPS + "SELECT l_orderkey, height, md5(code) AS pixels_md5 FROM orders_")
def rle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = _encoded(spark, sf_dir).withColumn("again", C.rle_decode("rle", "width", "height"))
    return again.select("l_orderkey", F.col("height").cast("long").alias("height"), F.md5(F.hex("again").cast("binary")).alias("pixels_md5"))


# A row has one run, or two: of v and of the status; a run of n takes 2 bytes for zeros, n bytes for one or two of a colour, else 3.
SIZE = "CASE WHEN {n} = 0 THEN 0 WHEN {v} = 0 THEN 2 WHEN {n} <= 2 THEN {n} ELSE 3 END"


@query(
    BITMAPS + f"SELECT l_orderkey, sum(2 + CASE WHEN v = s THEN 3 ELSE ({SIZE.format(n='run', v='v')}) + ({SIZE.format(n='(8 - run)', v='s')}) END)::BIGINT AS rle_bytes FROM lines GROUP BY l_orderkey"
)
def rle_encoded_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(spark, sf_dir).select("l_orderkey", F.octet_length("rle").cast("long").alias("rle_bytes"))


@query(BITMAPS + "SELECT l_orderkey, to_base64(unhex(code)) AS bitmap FROM orders_")
def base64_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = synth.order_bitmaps(table(spark, sf_dir, "lineitem"))
    return b.withColumn("text", C.base64(F.col("pixels"))).withColumn("back", C.unbase64("text")).select("l_orderkey", C.base64(F.col("back")).alias("bitmap"))


def _object_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's bitmap as a display set with two objects, built, serialised and read back."""
    b = synth.order_bitmaps(table(spark, sf_dir, "lineitem"))
    empty = F.lit(None)
    composition = F.struct(F.lit(1).alias("number"), F.lit("epoch_start").alias("state"), F.lit(1920).alias("video_width"), F.lit(1080).alias("video_height"), F.lit(False).alias("palette_only"), F.lit(0).cast("short").alias("palette_id"), F.array().cast("array<struct<object_id:int,window_id:smallint,x:int,y:int,crop:struct<x:int,y:int,width:int,height:int>>>").alias("objects"))
    bitmap = lambda i: F.struct(F.lit(i).alias("id"), F.lit(0).cast("short").alias("version"), "width", "height", "pixels")
    parts = b.select(
        F.lit("orders.sup").alias("file"), (F.col("l_orderkey") % 16).alias("track_id"), F.col("l_orderkey").alias("set_seq"), (F.col("l_orderkey") * 90).alias("pts"), F.lit(0).cast("long").alias("dts"),
        composition.cast(S.COMPOSITION).alias("composition"), empty.cast("array<struct<id:smallint,x:int,y:int,width:int,height:int>>").alias("windows"),
        empty.cast("array<struct<id:smallint,version:smallint,entries:array<struct<id:smallint,luminance:smallint,cr:smallint,cb:smallint,alpha:smallint>>>>").alias("palettes"),
        F.array(bitmap(3), bitmap(4)).alias("objects"),
    )
    sup = A.sup_of(A.built_sets(parts))
    blocks = sup.select("file", "track_id", F.col("set_seq").alias("block_seq"), "pts", F.lit(0).cast("long").alias("dts"), F.lit("sup").alias("framing"), F.col("sup").alias("data"))
    return A.numbered(A.assemble(A.segments(blocks)))


@query(BITMAPS + "SELECT v AS value, sum(n)::BIGINT * 2 AS pixels FROM (SELECT v, run AS n FROM lines UNION ALL SELECT s, 8 - run FROM lines) GROUP BY v HAVING sum(n) > 0")
def bitmap_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.histogram(A.project(_object_sets(spark, sf_dir))).groupBy("value").agg(F.sum("pixels").alias("pixels"))


@query(
    BITMAPS
    + f""", sizes AS (SELECT l_orderkey, sum(2 + CASE WHEN v = s THEN 3 ELSE ({SIZE.format(n='run', v='v')}) + ({SIZE.format(n='(8 - run)', v='s')}) END)::BIGINT AS n, count(*) AS height FROM lines GROUP BY l_orderkey)
    SELECT l_orderkey, id, 'complete' AS sequence, n + 4 AS data_length, CAST(8 AS BIGINT) AS width, height FROM sizes, (VALUES (3), (4)) t(id)"""
)
def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.project(_object_sets(spark, sf_dir)).select((F.col("pts") / 90).cast("long").alias("l_orderkey"), F.explode("objects").alias("o"))
    return found.select("l_orderkey", "o.id", "o.sequence", *[F.col(f"o.{n}").cast("long").alias(n) for n in ("data_length", "width", "height")])


# Lookups and scalar functions



@query(
    f"""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'qaa' WHEN doc_id % 4 = 2 THEN lang || '-XY' ELSE lang END AS language FROM documents"""
)
def language_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = F.try_element_at(F.create_map(*map(F.lit, ("de", "ger", "en", "eng", "es", "spa", "fr", "fra"))), F.col("lang"))
    r = F.col("doc_id") % 4
    code = F.when(r == 0, three).when(r == 1, F.upper(three)).when(r == 2, F.concat(three, F.lit("-XY"))).otherwise("qaa")
    return table(spark, sf_dir, "documents").select("doc_id", normalize_language(code, spark).alias("language"))


SCALE = "(CASE WHEN event_id % 3 = 0 THEN 1000000 ELSE 333333 + event_id % 1000 END)"


@query(f"SELECT event_id, CAST(greatest(0, ((event_id * 977 - 50000)::HUGEINT * {SCALE} * 9) // 100000) AS BIGINT) AS pts FROM events")
def mkv_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    ticks = C.listwise(T.LongType())(lambda time, scale: Movie(0, 0, [], scale=scale).pts(time))
    return table(spark, sf_dir, "events").select("event_id", ticks(e * 977 - 50000, F.when(e % 3 == 0, 1000000).otherwise(333333 + e % 1000).cast("long")).alias("pts"))


@query("SELECT event_id, greatest(0, event_id * 3600 - 900000) AS pts FROM events")
def pts_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", C.minus_offset(F.col("event_id") * 3600, F.lit(900000).cast("long")).alias("pts"))


def _pes(e: Column) -> Column:
    """A PES packet with a PTS and an END segment."""
    pts = e * 3600
    five = F.concat(
        C.to_be(F.lit(0x21) + F.shiftleft(F.shiftright(pts, 30).bitwiseAND(F.lit(7)), 1), 1), C.to_be(F.shiftright(pts, 22), 1), C.to_be(F.shiftleft(F.shiftright(pts, 15).bitwiseAND(F.lit(127)), 1) + 1, 1),
        C.to_be(F.shiftright(pts, 7), 1), C.to_be(F.shiftleft(pts.bitwiseAND(F.lit(127)), 1) + 1, 1),
    )
    return F.concat(F.unhex(F.lit("000001BD0000848005")), five, F.unhex(F.lit("800000")))


@query(
    """WITH p AS (SELECT 1 + user_id % 4 AS track_id, event_id AS e, event_type NOT IN ('view', 'click') AS starts, (event_id * 7) % 50 AS n FROM events),
    g AS (SELECT *, sum(CAST(starts AS BIGINT)) OVER (PARTITION BY track_id ORDER BY e) AS grp FROM p)
    SELECT track_id, min(e) * 3600 AS pts, (3 + sum(CASE WHEN starts THEN 0 ELSE n END))::BIGINT AS payload_bytes FROM g WHERE grp > 0 GROUP BY track_id, grp"""
)
def pes_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of four PIDs; signups, purchases and errors start a unit, others continue it.

    A PES time has 33 bits, so each round of them is a clip of its own, put behind those before it.
    """
    e = F.col("event_id")
    starts = ~F.col("event_type").isin("view", "click")
    filler = F.unhex(F.repeat(F.lit("FF"), ((e * 7) % 50).cast("int")))
    packets = table(spark, sf_dir, "events").select(
        F.lit("a.ts").alias("file"), (1 + F.col("user_id") % 4).alias("track_id"), e.alias("packet_seq"), starts.alias("starts"), F.when(starts, _pes(e)).otherwise(filler).alias("payload"), (F.pmod(e * TICKS, F.lit(1 << 33)) - e * TICKS).alias("pts_offset")
    )
    return A.reassemble_pes(packets).select("track_id", "pts", F.octet_length("data").cast("long").alias("payload_bytes"))


@query(
    """WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN printf('%d', event_id) WHEN 1 THEN printf('%d:%d.5', event_id % 90, event_id % 60) WHEN 2 THEN printf('%d:%d:%d', event_id % 7, event_id % 60, event_id % 50)
      WHEN 3 THEN 'x' || event_id ELSE '1:2:3:4' END AS text,
      CASE event_id % 5 WHEN 0 THEN event_id * 1000.0::DOUBLE WHEN 1 THEN ((event_id % 90) * 60 + (event_id % 60) + 0.5::DOUBLE) * 1000 WHEN 2 THEN ((event_id % 7) * 3600 + (event_id % 60) * 60 + event_id % 50) * 1000.0::DOUBLE END AS ms FROM events)
    SELECT event_id, text, ms FROM t"""
)
def timestamp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    text = (
        F.when(e % 5 == 0, F.format_string("%d", e)).when(e % 5 == 1, F.format_string("%d:%d.5", e % 90, e % 60)).when(e % 5 == 2, F.format_string("%d:%d:%d", e % 7, e % 60, e % 50)).when(e % 5 == 3, F.concat(F.lit("x"), e.cast("string"))).otherwise("1:2:3:4")
    )
    return table(spark, sf_dir, "events").select("event_id", text.alias("text")).select("event_id", "text", C.listwise(T.DoubleType())(parse_timestamp)("text").alias("ms"))


@query("SELECT l_orderkey, l_linenumber, CAST(least(255, greatest(0, trunc(l_extendedprice / 100 - 100))) AS BIGINT) AS byte, CAST(least(65535, trunc(l_extendedprice)) AS BIGINT) AS word FROM lineitem")
def saturating_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    number = C.listwise(T.LongType())(ndjson.whole_number)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", number((price / 100 - 100).cast("double"), F.lit(255)).alias("byte"), number(price.cast("double"), F.lit(65535)).alias("word"))


@query("SELECT event_id, event_id % 65536 AS low, (event_id * 3600) % 16777216 AS three, event_id * 3600 AS four FROM events")
def big_endian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers written in two, three and four bytes, and read back; what four bytes can't hold takes four more."""
    e = F.col("event_id")
    data = table(spark, sf_dir, "events").select("event_id", F.concat(C.to_be(e, 2), C.to_be(e * 3600, 3), C.to_be(e * 3600, 4), C.to_be(F.shiftright(e * 3600, 32), 4)).alias("b"))
    return data.select("event_id", C.be("b", 0, 2).alias("low"), C.be("b", 2, 3).alias("three"), (F.shiftleft(C.be("b", 9, 4), 32) + C.be("b", 5, 4)).alias("four"))


for _name, (_made, _sql) in containers.QUERIES.items():
    QUERIES[_name], ORACLES[_name] = _made, _sql
