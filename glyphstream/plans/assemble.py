"""From container blocks to display sets: windows and aggregates, all Catalyst but the byte walks.

Order is explicit. A block's number is its position in the file, a segment's is the block's
times 65536 plus its place in it, so sorting by number gives the file's order whatever
partition a row came from. One track of one file is a window partition; PGS tracks are a few
megabytes, whatever the container's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import codec
from ..functions import columns as C
from ..sources.datasource import batches

PLACES = 1 << 16
TRACK = ("file", "track_id")


def reassemble_pes(packets: DataFrame) -> DataFrame:
    """Blocks (raw framing) of transport packets: each unit start opens a PES packet of its PID.

    What comes before the first start is dropped; the last one ends with the input. Times are
    relative to the clip's start, and never negative. The offset is the unit start's; one below
    zero puts the clip's 33 bits behind an earlier time.
    """
    w = Window.partitionBy(*TRACK).orderBy("packet_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = packets.withColumn("grp", F.sum(F.col("starts").cast("long")).over(w)).filter("grp > 0")
    parts = F.sort_array(F.collect_list(F.struct("packet_seq", "payload")))
    whole = grouped.groupBy(*TRACK, "grp").agg(F.min("packet_seq").alias("block_seq"), F.min_by("pts_offset", "packet_seq").alias("pts_offset"), C.joined(F.transform(parts, lambda p: p["payload"])).alias("pes"))
    return pes_blocks(whole)


def pes_blocks(pes: DataFrame) -> DataFrame:
    """schema.BLOCKS of whole PES packets (file, track_id, block_seq, pts_offset, pes); others are dropped."""
    data = F.col("pes")
    flags, size = F.shiftright(C.be(data, 7, 1), 6), C.be(data, 8, 1)
    sound = (F.octet_length(data) >= 9) & (F.substring(data, 1, 3) == F.lit(b"\0\0\1")) & (size + 9 <= F.octet_length(data))
    pts = F.when((flags >= 2) & (size >= 5), C.pes_time(F.substring(data, 10, 5))).otherwise(0)
    dts = F.when((flags == 3) & (size >= 10), C.pes_time(F.substring(data, 15, 5))).otherwise(0)
    return pes.filter(sound).select(
        *TRACK,
        "block_seq",
        C.minus_offset(pts, F.col("pts_offset")).alias("pts"),
        C.minus_offset(dts, F.col("pts_offset")).alias("dts"),
        F.lit("raw").alias("framing"),
        F.substr(data, (size + 10).cast("int")).alias("data"),
        F.lit(None).cast("string").alias("error"),
    )


def segments(blocks: DataFrame, *, whole_times: bool = False) -> DataFrame:
    """schema.SEGMENTS of blocks in either framing; blocks without data (errors) give none.

    PG headers hold the last 32 bits of a time, which go round after 13 hours. With
    ``whole_times`` the bits above them are those of the block's own times, for containers that have them.
    """

    def rows(part: pa.RecordBatch) -> Iterator[tuple]:
        for file, track, seq, pts, dts, data in zip(*(part.column(i).to_pylist() for i in range(6)), strict=True):
            for place, (own_pts, own_dts, kind, payload) in enumerate(codec.split_block(data, pts, dts)):
                if whole_times:
                    own_pts, own_dts = codec.nearest(own_pts, pts), codec.nearest(own_dts, dts)
                yield file, track, seq * PLACES + min(place, PLACES - 1), own_pts, own_dts, kind, payload

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield from batches(rows(part), S.SEGMENTS)

    return blocks.filter("data is not null").select(*TRACK, "block_seq", "pts", "dts", "data").mapInArrow(run, S.SEGMENTS)


def assemble(found: DataFrame) -> DataFrame:
    """Display sets: file, track_id, set_seq, pts, pts_ms, composition_state, segments (in order).

    A PCS opens a set and discards one that is still open; END closes it. A set counts if it
    was closed and the state in its PCS is known. What stands outside of a set is dropped.
    """
    w = Window.partitionBy(*TRACK).orderBy("seg_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = found.withColumn("grp", F.count(F.when(F.col("segment_type") == "PCS", True)).over(w)).filter("grp > 0")
    listed = grouped.groupBy(*TRACK, "grp").agg(
        F.min(F.when(F.col("segment_type") == "END", F.col("seg_seq"))).alias("end_seq"),
        F.sort_array(F.collect_list(F.struct(*S.SEGMENT.fieldNames()))).alias("segments"),
    )
    inside = F.filter("segments", lambda s: s["seg_seq"] <= F.col("end_seq"))
    head = F.col("segments")[0]
    return listed.filter("end_seq is not null").select(
        *TRACK, head["seg_seq"].alias("set_seq"), head["pts"].alias("pts"), C.pts_ms(head["pts"]).alias("pts_ms"), C.state(head["payload"]).alias("composition_state"), inside.alias("segments")
    ).filter("composition_state is not null")


def in_time(sets: DataFrame, start_ms: float | None, end_ms: float | None) -> DataFrame:
    """Sets from start to end, both inclusive."""
    kept = sets if start_ms is None else sets.filter(F.col("pts_ms") >= float(start_ms))
    return kept if end_ms is None else kept.filter(F.col("pts_ms") <= float(end_ms))


def numbered(sets: DataFrame) -> DataFrame:
    """Adds ``index``: from zero in each track, in the order of the file."""
    w = Window.partitionBy(*TRACK).orderBy("set_seq")
    return sets.withColumn("index", F.row_number().over(w).cast("long") - 1)


def _payloads(kind: str) -> Column:
    return F.transform(F.filter("segments", lambda s: s["segment_type"] == kind), lambda s: s["payload"])


def project(sets: DataFrame, *, raw: bool = False, decode: bool = True) -> DataFrame:
    """Adds composition, windows, palettes and objects.

    ``raw`` adds the payload bytes to each item, ``decode`` the objects' bitmaps. Windows,
    palettes and objects whose payload can't be parsed are left out; a composition that can't
    is null (with ``raw``: its payload alone). Objects with one id are fragments of one: the
    first gives version and size, and the run lengths are joined.
    """
    out = sets.withColumn("__pcs", F.get(_payloads("PCS"), F.lit(0))).withColumn("__c", C.pcs(F.col("__pcs")))
    composition = F.col("__c")
    if raw:
        fields = [F.col(f"__c.{n}").alias(n) for n in S.COMPOSITION.fieldNames()]
        composition = F.when(F.col("__pcs").isNotNull(), F.struct(*fields, F.col("__pcs").alias("payload")))

    def windows_of(payload: Column) -> Column:
        found = C.wds(payload)
        return F.transform(found, lambda w: w.withField("payload", payload)) if raw else found

    kept = lambda items: F.filter(items, lambda x: x.isNotNull())
    windows = F.flatten(kept(F.transform(_payloads("WDS"), windows_of)))
    palettes = kept(F.transform(_payloads("PDS"), lambda p: C.pds(p).withField("payload", p) if raw else C.pds(p)))
    fragments = kept(F.transform(_payloads("ODS"), lambda p: C.ods(p).withField("payload", p) if raw else C.ods(p)))
    out = out.withColumns({"composition": composition, "windows": windows, "palettes": palettes, "__f": fragments})

    def whole(object_id: Column) -> Column:
        own = F.filter("__f", lambda f: f["id"] == object_id)
        first = F.get(own, F.lit(0))
        fields = [first[n].alias(n) for n in ("id", "version")]
        fields.append(F.when(F.size(own) > 1, "reassembled").otherwise(first["sequence"]).alias("sequence"))
        fields += [first[n].alias(n) for n in ("data_length", "width", "height")]
        fields.append(C.joined(F.transform(own, lambda f: f["rle"])).alias("rle"))
        return F.struct(*fields, *([C.joined(F.transform(own, lambda f: f["payload"])).alias("payload")] if raw else []))

    out = out.withColumn("objects", F.transform(F.array_distinct(F.transform("__f", lambda f: f["id"])), whole))
    if decode:
        out = out.withColumn("__b", C.bitmaps(F.transform("objects", lambda o: C.record(rle=o["rle"], width=o["width"], height=o["height"]))))
        out = out.withColumn("objects", F.zip_with("objects", "__b", lambda o, b: o.withField("bitmap", b)))
    return out.drop("__pcs", "__c", "__f", "__b")


def built_sets(parts: DataFrame) -> DataFrame:
    """Display sets from file, track_id, set_seq, pts, dts, composition, windows, palettes and objects.

    ``objects`` hold id, version, width, height and pixels. Run lengths are encoded and cut to
    fit; the composition state is the composition's.
    """
    made = C.built("composition", "windows", "palettes", "objects")
    numbered_ = F.transform(F.col("__s"), lambda s, i: C.record(seg_seq=F.col("set_seq") * PLACES + i, pts=F.col("pts"), dts=F.col("dts"), segment_type=s["segment_type"], payload=s["payload"]))
    return parts.withColumn("__s", made).select(*TRACK, "set_seq", "pts", C.pts_ms(F.col("pts")).alias("pts_ms"), F.col("composition.state").alias("composition_state"), numbered_.alias("segments"))


def sup_of(sets: DataFrame) -> DataFrame:
    """Adds ``sup``: the set's segments with PG headers."""
    return sets.withColumn("sup", C.joined(F.transform("segments", lambda s: C.sup_bytes(s["pts"], s["dts"], s["segment_type"], s["payload"]))))


def edit_payloads(sets: DataFrame, segment_type: str, change: Callable[[Column], Column]) -> DataFrame:
    """The sets with ``change`` applied to the payload of each segment of a type; null leaves it as it is.

    Times and the composition state follow the edited PCS, as if it had been read so.
    """
    edited = F.transform("segments", lambda s: s.withField("payload", F.when(s["segment_type"] == segment_type, F.coalesce(change(s["payload"]), s["payload"])).otherwise(s["payload"])))
    out = sets.withColumn("segments", edited)
    return out.withColumn("composition_state", C.state(F.col("segments")[0]["payload"])) if segment_type == "PCS" else out


def with_epoch(sets: DataFrame) -> DataFrame:
    """Adds ``epoch``: how many epochs of its track have started up to this set."""
    w = Window.partitionBy(*TRACK).orderBy("set_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sets.withColumn("epoch", F.sum((F.col("composition_state") == "epoch_start").cast("long")).over(w))
