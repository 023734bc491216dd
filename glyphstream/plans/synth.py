"""Subtitle bytes made of the driver's tables, so that SQL over those tables can check what is read from the bytes.

An event is a display set of track ``1 + user_id % 4`` at ``event_id * 3600`` ticks; its type
gives the state, an error has no END. Everything is written as .sup bytes of one file a
track, and read back by the same code that reads files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import columns as C
from . import assemble as A

TICKS = 3600
TRACKS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rem(value: Column, by: int) -> Column:
    return F.pmod(value, F.lit(by).cast("long"))


def parts(events: DataFrame) -> DataFrame:
    """composition, windows, palettes and objects of each event, and whether its set is closed."""
    e, kind = F.col("event_id"), F.col("event_type")
    state = F.when(kind == "signup", "epoch_start").when(kind == "view", "acquisition_point").otherwise("normal")
    crop = F.when(_rem(e, 3) == 0, F.struct(*[F.lit(v).cast("int").alias(n) for n, v in (("x", 1), ("y", 2), ("width", 3), ("height", 4))]))
    placement = F.struct(
        _rem(e, 5).cast("int").alias("object_id"), F.lit(0).cast("short").alias("window_id"), _rem(F.col("user_id"), 1920).cast("int").alias("x"), _rem(e * 7, 1080).cast("int").alias("y"),
        crop.cast(S.CROP).alias("crop"),
    )
    none = F.array().cast(T.ArrayType(S.PLACEMENT))
    composition = F.struct(
        _rem(e, 65536).cast("int").alias("number"), state.alias("state"), F.lit(1920).alias("video_width"), F.lit(1080).alias("video_height"), (kind == "click").alias("palette_only"),
        _rem(e, 256).cast("short").alias("palette_id"), F.when(kind == "purchase", none).otherwise(F.array(placement)).alias("objects"),
    )
    window = F.struct(F.lit(0).cast("short").alias("id"), *[_rem(e * k, m).cast("int").alias(n) for n, k, m in (("x", 1, 1900), ("y", 3, 1000), ("width", 5, 700), ("height", 7, 90))])
    entry = lambda i: F.struct(
        i.cast("short").alias("id"), *[_rem(e * k + i * 40, 256).cast("short").alias(n) for n, k in (("luminance", 1), ("cr", 3), ("cb", 5))], F.when(i % 3 == 0, 0).otherwise(255).cast("short").alias("alpha")
    )
    palette = F.struct(_rem(e, 256).cast("short").alias("id"), _rem(e, 7).cast("short").alias("version"), F.transform(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")), entry).alias("entries"))
    return events.select(
        F.lit("events.sup").alias("file"), (1 + _rem(F.col("user_id"), TRACKS)).alias("track_id"), e.alias("set_seq"), (e * TICKS).alias("pts"), F.lit(0).cast("long").alias("dts"),
        composition.alias("composition"), F.array(window).alias("windows"), F.array(palette).alias("palettes"), (kind != "error").alias("closed"),
    )


def event_segments(events: DataFrame) -> DataFrame:
    """schema.SEGMENTS of the events, serialised by Catalyst: PCS, WDS, PDS and, for closed sets, END."""
    p = parts(events)
    made = F.array(
        F.struct(F.lit("PCS").alias("k"), C.write_pcs(F.col("composition")).alias("v")), F.struct(F.lit("WDS").alias("k"), C.write_wds(F.col("windows")).alias("v")),
        F.struct(F.lit("PDS").alias("k"), C.write_pds(F.col("palettes")[0]).alias("v")), F.struct(F.lit("END").alias("k"), F.lit(b"").alias("v")),
    )
    kept = F.when(F.col("closed"), made).otherwise(F.slice(made, 1, 3))
    listed = p.select("file", "track_id", "set_seq", "pts", "dts", F.posexplode(kept).alias("place", "s"))
    return listed.select("file", "track_id", (F.col("set_seq") * 8 + F.col("place")).alias("seg_seq"), "pts", "dts", F.col("s.k").alias("segment_type"), F.col("s.v").alias("payload"))


def event_blocks(events: DataFrame) -> DataFrame:
    """The segments as blocks of .sup bytes, one each, as the reader of a file gives them."""
    s = event_segments(events)
    data = C.sup_bytes(F.col("pts"), F.col("dts"), F.col("segment_type"), F.col("payload"))
    return s.select("file", "track_id", F.col("seg_seq").alias("block_seq"), "pts", "dts", F.lit("sup").alias("framing"), data.alias("data"), F.lit(None).cast("string").alias("error"))


def read_segments(events: DataFrame) -> DataFrame:
    """The events' segments, read back from their bytes; blocks have whole times, headers 32 bits of them."""
    return A.segments(event_blocks(events), whole_times=True)


def event_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display sets read back from the bytes, and numbered."""
    return A.numbered(A.assemble(read_segments(table(spark, sf_dir, "events"))))


def order_bitmaps(lineitem: DataFrame) -> DataFrame:
    """A bitmap of each order: a row of eight pixels for each line, one value by flag and status, zero for A."""
    value = F.when(F.col("l_returnflag") == "A", 0).otherwise(F.ascii("l_returnflag")).cast("long")
    run = (F.pmod(F.col("l_quantity").cast("long"), F.lit(8).cast("long"))).cast("int")
    row = F.concat(F.repeat(F.lpad(F.hex(value), F.lit(2), F.lit("0")), run), F.repeat(F.hex(F.ascii("l_linestatus").cast("long")), 8 - run))
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", row.alias("row"))))
    grouped = lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(rows, lambda r: r["row"]), "").alias("code"), F.count(F.lit(1)).cast("int").alias("height"))
    return grouped.select("l_orderkey", F.lit(8).alias("width"), "height", F.unhex("code").alias("pixels"))
