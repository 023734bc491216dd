"""Container files made of the driver's events, and queries that read them back through the readers.

Events ``PER_FILE`` at a time make a file of each kind; an event is a block of track
``1 + user_id % 4`` at ``event_id * 40`` milliseconds, an error has no END. Files are built in
tasks. ``contents`` hands them over as rows, for ``sources.binary``; ``written`` puts them into
the folder that the cluster shares, for ``format("pgs")``.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import codec
from ..functions.columns import listwise, since
from ..functions.language import normalize_language
from ..operators.extractor import Extractor
from ..sources import binary, ts
from ..sources.datasource import batches
from ..sources.reader import Reader
from . import assemble as A
from . import media
from .synth import TICKS, table

PER_FILE = 1500
PER_OBJECT_FILE = 64
LANGUAGES = ("eng", "ger", "fre", "und")
STATES = {"signup": "epoch_start", "view": "acquisition_point"}
FILES = T.StructType().add("path", T.StringType()).add("content", T.BinaryType())
_folders: list[str] = []

# The relation that the files stand for: sets are numbered from zero in each track of a file.
FILE_SETS = f"""
WITH blocks AS (SELECT event_id // {PER_FILE} AS file_no, 1 + user_id % 4 AS track, event_id AS e, event_type, event_id * {TICKS} AS pts FROM events),
sets AS (SELECT *, row_number() OVER (PARTITION BY file_no, track ORDER BY e) - 1 AS idx,
         CASE event_type WHEN 'signup' THEN 'epoch_start' WHEN 'view' THEN 'acquisition_point' ELSE 'normal' END AS state FROM blocks WHERE event_type <> 'error')
"""
ALL_SETS = "SELECT file_no, {track} AS track_id, CAST(idx AS BIGINT) AS index, pts, state, CAST(CASE WHEN state = 'normal' THEN 2 ELSE 5 END AS BIGINT) AS segments FROM sets"


def segments_of(event_id: int, event_type: str) -> list[tuple[str, bytes]]:
    parts = media.display_set(event_id % 65536, STATES.get(event_type, "normal"))
    return parts[:-1] if event_type == "error" else parts


def tracks_of(rows: list[tuple[int, int, str]]) -> dict[int, list]:
    """(pts, segments) of each track's blocks, out of (event_id, track, event_type) in order."""
    out: dict[int, list] = {}
    for event_id, track, event_type in rows:
        out.setdefault(track, []).append((event_id * TICKS, segments_of(event_id, event_type)))
    return out


def _keywords(track: int) -> dict:
    """Track 2 has whole-block compression, track 3 stripped headers, track 4 no compression but a BCP 47 tag."""
    named = {"language": LANGUAGES[track - 1], "name": f"Track {track}", "default": int(track == 1), "forced": int(track == 2)}
    return {1: named, 2: named | {"compression": (0, b"")}, 3: named | {"compression": (3, b"\x16\0")}, 4: {"bcp47": "pt-BR"}}[track]


def matroska(file_no: int, rows: list, **options) -> bytes:
    return media.matroska({t: (_keywords(t), sets) for t, sets in tracks_of(rows).items()}, **options)


def cued(file_no: int, rows: list) -> bytes:
    """Cues in two files of three, frame counts in every other; half of the cues name clusters only."""
    return matroska(file_no, rows, cues=file_no % 3 != 2, tags=file_no % 2 == 0, relative=file_no % 3 == 0)


def plain(file_no: int, rows: list) -> bytes:
    """No cues, clusters of unknown size."""
    return matroska(file_no, rows, cues=False, tags=False, unknown=True)


def m2ts(file_no: int, rows: list) -> bytes:
    return media.transport({0x1200 + t: (LANGUAGES[t - 1], sets) for t, sets in tracks_of(rows).items()})


def junked(file_no: int, rows: list) -> bytes:
    """188-byte packets, and junk between two sets that shifts the packets after it."""
    return media.transport({0x1200 + t: (None, sets) for t, sets in tracks_of(rows).items()}, m2ts=False, junk=b"x" * (50 + file_no * 77 % 1000))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows by key over a fixed number of tasks: small rows make large files, so their size tells nothing of the work."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def built(spark: SparkSession, sf_dir: str, make: Callable[[int, list], dict[str, bytes]]) -> DataFrame:
    """(path, content) of all files that ``make`` gives, by name, for each file's events."""

    def build(key: tuple, group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(n).to_pylist() for n in ("event_id", "track", "event_type")), strict=True))
        found = make(key[0].as_py(), rows)
        return pa.table({"path": list(found), "content": list(found.values())}, schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    events = table(spark, sf_dir, "events").select((F.col("event_id") / PER_FILE).cast("long").alias("file_no"), "event_id", (1 + F.col("user_id") % 4).alias("track"), "event_type")
    return spread(events, "file_no").groupBy("file_no").applyInArrow(build, FILES)


def contents(spark: SparkSession, sf_dir: str, make: Callable[[int, list], bytes], extension: str) -> DataFrame:
    """(path, content) of all files of a kind."""
    return built(spark, sf_dir, lambda file_no, rows: {f"{file_no}.{extension}": make(file_no, rows)})


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir as a path; a temporary one where that is unset, in a local session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = os.path.join(found.removeprefix("file://") if found else tempfile.mkdtemp(), f"glyphstream-media-{uuid.uuid4().hex}")
    _folders.append(folder)
    return folder


@atexit.register
def _remove() -> None:
    for folder in _folders:
        shutil.rmtree(folder, ignore_errors=True)


def written(files: DataFrame, folder: str) -> str:
    """Tasks write the files under a folder that they share; a lost task writes the same again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = os.path.join(folder, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(f"{target}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(content)
                os.replace(f.name, target)
            yield pa.record_batch([pa.array([batch.num_rows], type=pa.int64())], names=["n"])

    files.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return folder


def _file_no() -> F.Column:
    return F.regexp_extract("file", r"(\d+)\.\w+$", 1).cast("long").alias("file_no")


def _pts(bits: int) -> F.Column:
    """Times of .sup files have 32 bits, of transport streams 33; a file's number says when it starts, so they go on from there."""
    return since(_file_no() * (PER_FILE * TICKS), F.col("pts"), bits).alias("pts")


def _listed(sets: DataFrame, pts: F.Column | str = "pts") -> DataFrame:
    return sets.select(_file_no(), "track_id", "index", pts, F.col("composition_state").alias("state"), F.size("segments").cast("long").alias("segments"))


def _assembled(blocks: DataFrame, pts: F.Column | str = "pts") -> DataFrame:
    return _listed(A.numbered(A.assemble(A.segments(blocks))), pts)


def mkv_cued_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matroska by its cues where there are any: compressed, stripped and plain blocks."""
    return _assembled(binary.from_contents(contents(spark, sf_dir, cued, "mkv"), "blocks"))


def mkv_sequential_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matroska without cues, clusters of unknown size, read from end to end."""
    return _assembled(binary.from_contents(contents(spark, sf_dir, plain, "mkv"), "blocks", strategy="sequential"))


def m2ts_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of 192 bytes, reassembled."""
    return _assembled(A.reassemble_pes(binary.from_contents(contents(spark, sf_dir, m2ts, "m2ts"), "packets")), _pts(33))


def ts_junk_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of 188 bytes around junk, in files cut into many splits."""
    folder = written(contents(spark, sf_dir, junked, "ts"), shared_folder(spark))
    return _listed(Extractor(spark, folder, split_bytes=20_011).display_sets(), _pts(33))


def mkv_track_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks with language, name, flags, frame counts of tags and whether cues name them."""
    found = binary.from_contents(contents(spark, sf_dir, cued, "mkv"), "tracks").withColumn("language", normalize_language(F.col("language"), spark))
    return found.select(_file_no(), "track_id", "language", "name", "is_default", "is_forced", "display_set_count", "indexed")


def transport_track_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of the programme map, and their languages."""
    found = binary.from_contents(contents(spark, sf_dir, m2ts, "m2ts"), "tracks").withColumn("language", normalize_language(F.col("language"), spark))
    return found.select(_file_no(), "track_id", "language", "container")


def every_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events through every container of the data source, in splits: the same totals."""
    kinds = ((cued, "mkv"), (m2ts, "m2ts"), (junked, "ts"))
    folder = written(built(spark, sf_dir, lambda n, rows: {f"{n}.{extension}": make(n, rows) for make, extension in kinds}), shared_folder(spark))
    sets = Extractor(spark, folder, split_bytes=50_000).display_sets().withColumn("pts", F.when(F.col("container") == "Matroska", F.col("pts")).otherwise(_pts(33)))
    return sets.groupBy(_file_no(), "container", (F.col("track_id") % 8).alias("track")).agg(F.count(F.lit(1)).alias("display_sets"), F.min("pts").alias("first_pts"), F.max("pts").alias("last_pts"))


def sup_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A .sup file of each track and file, written and read in splits."""
    made = built(spark, sf_dir, lambda n, rows: {f"{t}/{n}.sup": media.sup(sets) for t, sets in tracks_of(rows).items()})
    folder = written(made, shared_folder(spark))
    found = Extractor(spark, [f"{folder}/{t}" for t in range(1, 5)], split_bytes=10_007).display_sets()
    own = found.withColumn("track_id", F.regexp_extract("file", r"/(\d)/[^/]*$", 1).cast("long"))
    return _listed(own, _pts(32))


def pushed_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks and a time range, which reach the readers of files with cues and without."""
    folder = written(contents(spark, sf_dir, cued, "mkv"), shared_folder(spark))
    opened = Extractor(spark, folder).with_tracks(1, 4).with_time_range(1_000.0, 30_000.0)
    return opened.display_sets().select("track_id", "pts")


def bytes_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a reader leaves a tenth of a file unread: where cues name blocks it does, else it doesn't."""
    files = contents(spark, sf_dir, cued, "mkv")
    auto = binary.from_contents(files, "stats").select(_file_no(), "container", (F.col("bytes_read") < 0.9 * F.col("file_size")).alias("auto_skips"))
    whole = binary.from_contents(files, "stats", strategy="sequential").select(_file_no(), (F.col("bytes_read") >= 0.9 * F.col("file_size")).alias("sequential_reads"))
    return auto.join(whole, "file_no")


def clip_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's own language, else the one that the clip information has for its PID, with the clip's start."""

    @listwise(T.StructType().add("language", T.StringType()).add("start", T.LongType()))
    def listed(customer, nation):  # noqa: ANN001, ANN202
        pid = 0x1200 + customer % 32
        stream = media.transport({pid: ("ger" if customer % 3 == 0 else None, [(9000, media.display_set(1))])})
        clip = media.clip_info({pid: "eng" if nation % 2 == 0 else "und", 0x1100: "fre"}, nation * 45, 9_000_000)
        reader = Reader(stream)
        (track,) = ts.tracks(reader, ts.detect_layout(reader), clip)
        return {"language": track["language"], "start": ts.pts_offset(reader, clip)}

    found = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("track_id"), listed("c_custkey", "c_nationkey").alias("t"))
    return found.select("track_id", normalize_language(F.col("t.language"), spark).alias("language"), F.col("t.start").alias("start"))


def fragment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run lengths of a size, cut into object segments, serialised, parsed and joined again."""
    piece = T.StructType().add("sequence", T.StringType()).add("bytes", T.LongType())
    whole = T.StructType().add("pieces", T.ArrayType(piece)).add("data_length", T.LongType()).add("joined", T.LongType())

    @listwise(whole)
    def cut(key, size):  # noqa: ANN001, ANN202
        payloads = [codec.write_ods(o) for o in codec.fragments(key % 65536, 1, 640, 480, bytes(size))]
        back = [codec.parse_ods(p) for p in payloads]
        return {"pieces": [{"sequence": o["sequence"], "bytes": len(p)} for o, p in zip(back, payloads, strict=True)], "data_length": back[0]["data_length"], "joined": sum(len(o["rle"]) for o in back)}

    found = table(spark, sf_dir, "orders").select("o_orderkey", cut("o_orderkey", 20000 + F.col("o_orderkey") % 200000).alias("c"))
    return found.select(
        "o_orderkey", F.size("c.pieces").cast("long").alias("segments"), F.col("c.pieces")[0]["sequence"].alias("head"), F.element_at("c.pieces", -1)["bytes"].alias("last_bytes"),
        F.col("c.data_length").alias("data_length"), F.col("c.joined").alias("joined"),
    )


def fragmented_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitmaps whose run lengths fill several segments: built, assembled, joined and decoded to the same pixels.

    A file holds the sets of some keys, as a track of a file is assembled in one task.
    """

    def rows(key: int) -> Iterator[tuple]:
        pixels = bytes(1 + (key + i) % 3 for i in range(251)) * (100 + key % 1200)
        parts = codec.build_display_set(media.composition(key % 65536), None, [], [{"id": 1, "version": 0, "width": 251, "height": 100 + key % 1200, "pixels": pixels}])
        for place, (kind, payload) in enumerate(parts):
            yield f"{key // PER_OBJECT_FILE}.sup", 1, key * 64 + place, key * 90, 0, kind, payload

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield from batches((r for key in part.column(0).to_pylist() for r in rows(key)), S.SEGMENTS)

    segments = spread(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long")), "s_suppkey").mapInArrow(run, S.SEGMENTS)
    found = A.project(A.assemble(segments)).select((F.col("pts") / 90).cast("long").alias("key"), F.explode("objects").alias("o"))
    return found.select("key", F.col("o.sequence").alias("sequence"), F.col("o.height").cast("long").alias("height"), F.length("o.bitmap").cast("long").alias("pixels"), F.md5("o.bitmap").alias("pixels_md5"))


LANGUAGE = "CASE track WHEN 1 THEN 'en' WHEN 2 THEN 'de' WHEN 3 THEN 'fr' END"
FRAGMENTS = """WITH t AS (SELECT o_orderkey, 20000 + o_orderkey % 200000 AS n FROM orders)
SELECT o_orderkey, CASE WHEN n <= 65524 THEN 1 ELSE 1 + CAST(ceil((n - 65524) / 65531.0) AS BIGINT) END AS segments, CASE WHEN n <= 65524 THEN 'complete' ELSE 'first' END AS head,
       CASE WHEN n <= 65524 THEN n + 11 ELSE 4 + (n - 65524) - 65531 * (CAST(ceil((n - 65524) / 65531.0) AS BIGINT) - 1) END AS last_bytes, n + 4 AS data_length, n AS joined FROM t"""
#: Name: (query, oracle).
QUERIES = {
    "mkv_cued_sets": (mkv_cued_sets, FILE_SETS + ALL_SETS.format(track="track")),
    "mkv_sequential_sets": (mkv_sequential_sets, FILE_SETS + ALL_SETS.format(track="track")),
    "m2ts_sets": (m2ts_sets, FILE_SETS + ALL_SETS.format(track="track + 4608")),
    "ts_junk_sets": (ts_junk_sets, FILE_SETS + ALL_SETS.format(track="track + 4608")),
    "sup_files": (sup_files, FILE_SETS + ALL_SETS.format(track="track")),
    "mkv_track_list": (
        mkv_track_list,
        FILE_SETS + f"""SELECT file_no, track AS track_id, CASE WHEN track = 4 THEN 'pt-BR' ELSE {LANGUAGE} END AS language, CASE WHEN track < 4 THEN 'Track ' || track END AS name,
        CASE WHEN track < 4 THEN track = 1 END AS is_default, CASE WHEN track < 4 THEN track = 2 END AS is_forced, CASE WHEN file_no % 2 = 0 THEN count(*) END AS display_set_count, file_no % 3 <> 2 AS indexed
        FROM blocks GROUP BY file_no, track""",
    ),
    "transport_track_list": (transport_track_list, FILE_SETS + f"SELECT DISTINCT file_no, track + 4608 AS track_id, {LANGUAGE} AS language, 'M2TS' AS container FROM blocks"),
    "every_container": (
        every_container,
        FILE_SETS + """SELECT file_no, container, track, count(*) AS display_sets, min(pts) AS first_pts, max(pts) AS last_pts
        FROM sets, (VALUES ('Matroska'), ('M2TS'), ('TransportStream')) c(container) GROUP BY ALL""",
    ),
    "pushed_filters": (pushed_filters, FILE_SETS + "SELECT track AS track_id, pts FROM sets WHERE track IN (1, 4) AND pts BETWEEN 90000 AND 2700000"),
    "bytes_read": (bytes_read, FILE_SETS + "SELECT DISTINCT file_no, 'Matroska' AS container, file_no % 3 = 0 AS auto_skips, true AS sequential_reads FROM blocks"),
    "clip_languages": (
        clip_languages,
        "SELECT c_custkey AS track_id, CASE WHEN c_custkey % 3 = 0 THEN 'de' WHEN c_nationkey % 2 = 0 THEN 'en' END AS language, CAST(c_nationkey * 45 AS BIGINT) AS start FROM customer",
    ),
    "fragment_plan": (fragment_plan, FRAGMENTS),
    "fragmented_objects": (
        fragmented_objects,
        """WITH s AS (SELECT s_suppkey AS key, 100 + s_suppkey % 1200 AS height FROM supplier),
        r AS (SELECT key, height, list_reduce(list_transform(range(251), lambda i: chr(CAST(1 + (key + i) % 3 AS INTEGER))), lambda a, b: a || b) AS line FROM s)
        SELECT key, CASE WHEN height * 253 > 65524 THEN 'reassembled' ELSE 'complete' END AS sequence, height, height * 251 AS pixels, md5(repeat(line, height)) AS pixels_md5 FROM r""",
    ),
}
