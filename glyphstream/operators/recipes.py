"""Analyses of structured display sets (plans.assemble.project), as the NDJSON consumer would write them."""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import columns as C

KEY = ("file", "track_id", "index")


def timing(sets: DataFrame) -> DataFrame:
    return sets.select(*KEY, "pts", "pts_ms", F.col("composition_state").alias("state"))


def placements(sets: DataFrame) -> DataFrame:
    """A row for each object that a composition places."""
    return sets.select(*KEY, F.explode("composition.objects").alias("o")).select(*KEY, "o.object_id", "o.window_id", "o.x", "o.y", "o.crop")


def sets_per_track(sets: DataFrame) -> DataFrame:
    return sets.groupBy("file", "track_id").agg(F.count(F.lit(1)).alias("display_sets"))


def epoch_starts(sets: DataFrame) -> DataFrame:
    return sets.filter(F.col("composition_state") == "epoch_start")


def visible_entries(sets: DataFrame) -> DataFrame:
    """Palette entries that aren't wholly transparent."""
    palettes = sets.select(*KEY, F.explode("palettes").alias("p"))
    return palettes.select(*KEY, F.col("p.id").alias("palette_id"), F.explode("p.entries").alias("e")).filter("e.alpha > 0").select(*KEY, "palette_id", "e.*")


def clear_events(sets: DataFrame) -> DataFrame:
    """Normal sets without placements: the screen is cleared."""
    return sets.filter((F.col("composition_state") == "normal") & (F.size("composition.objects") == 0))


def summary(sets: DataFrame) -> DataFrame:
    """Sets, segments by type and in all, first and last time of each track."""
    count = lambda kind: F.sum(F.size(F.filter("segments", lambda s: s["segment_type"] == kind))).alias(f"n_{kind.lower()}")
    return sets.groupBy("file", "track_id").agg(
        F.count(F.lit(1)).alias("display_sets"), F.sum(F.size("segments")).alias("segments"), F.min("pts").alias("first_pts"), F.max("pts").alias("last_pts"), *map(count, S.SEGMENT_CODES)
    )


def progress(sets: DataFrame, tracks: DataFrame) -> DataFrame:
    """How far each set is in its track, where the container says how many there are."""
    totals = tracks.select("file", "track_id", "display_set_count")
    return sets.join(totals, ["file", "track_id"], "left").withColumn("progress", (F.col("index") + 1) / F.col("display_set_count"))


def brighten(sets: DataFrame, by: int) -> DataFrame:
    """Luminance of all palette entries, up by ``by``, at most 255."""
    entry = lambda e: e.withField("luminance", F.least(F.lit(255), F.greatest(F.lit(0), e["luminance"] + by)).cast("short"))
    return sets.withColumn("palettes", F.transform("palettes", lambda p: p.withField("entries", F.transform(p["entries"], entry))))


def resolved(sets: DataFrame) -> DataFrame:
    """Each placement with the object, window and palette that its ids name in the set, null where there is none."""
    found = sets.select(*KEY, "objects", "windows", "palettes", F.col("composition.palette_id").alias("palette_id"), F.explode("composition.objects").alias("placement"))
    first = lambda items, value: F.get(F.filter(items, lambda x: x["id"] == value), F.lit(0))
    return found.select(
        *KEY, "placement", first("objects", F.col("placement.object_id")).alias("object"), first("windows", F.col("placement.window_id")).alias("window"), first("palettes", F.col("palette_id")).alias("palette")
    )


def pixels(sets: DataFrame) -> DataFrame:
    """A row for each pixel of each decoded object, in colours of the set's first palette.

    The palette is used by position, as the rendering recipe does; a pixel beyond it is clear black.
    """
    entries = F.coalesce(F.get("palettes", F.lit(0))["entries"], F.array().cast(T.ArrayType(S.ENTRY)))
    table = sets.select(*KEY, F.transform(entries, C.rgba).alias("colours"), F.explode(F.filter("objects", lambda o: o["bitmap"].isNotNull())).alias("o"))
    code = F.regexp_extract_all(F.hex("o.bitmap"), F.lit("(..)"))
    listed = table.select(*KEY, F.col("o.id").alias("object_id"), F.col("o.width").alias("width"), "colours", F.posexplode(code).alias("at", "code"))
    clear = C.record(**{n: F.lit(0).cast("short") for n in "rgba"})
    colour = F.coalesce(F.get("colours", F.conv("code", 16, 10).cast("int")), clear)
    return listed.select(*KEY, "object_id", (F.col("at") % F.col("width")).alias("x"), F.floor(F.col("at") / F.col("width")).cast("int").alias("y"), F.conv("code", 16, 10).cast("int").alias("value"), colour.alias("rgba"))


RENDERED = T.StructType().add("object_id", T.IntegerType()).add("width", T.IntegerType()).add("height", T.IntegerType()).add("rgba", T.BinaryType())


@C.listwise(T.ArrayType(RENDERED))
def render(objects, colours):
    """RGBA images of a set's decoded objects; ``colours`` is an array of (r, g, b, a)."""
    lookup = np.zeros((256, 4), dtype=np.uint8)
    for i, c in enumerate((colours or [])[:256]):
        lookup[i] = [c["r"], c["g"], c["b"], c["a"]]
    return [{"object_id": o["id"], "width": o["width"], "height": o["height"], "rgba": lookup[np.frombuffer(o["bitmap"], dtype=np.uint8)].tobytes()} for o in objects or [] if o["bitmap"] is not None]


def images(sets: DataFrame) -> DataFrame:
    """An RGBA image for each decoded object, in one row."""
    entries = F.coalesce(F.get("palettes", F.lit(0))["entries"], F.array().cast(T.ArrayType(S.ENTRY)))
    plain = F.transform("objects", lambda o: C.record(**{n: o[n] for n in ("id", "width", "height", "bitmap")}))
    return sets.select(*KEY, F.explode(render(plain, F.transform(entries, C.rgba))).alias("image")).select(*KEY, "image.*")


def histogram(sets: DataFrame) -> DataFrame:
    """How often each pixel value occurs in each object."""
    found = sets.select(*KEY, F.explode("objects").alias("o")).select(*KEY, F.col("o.id").alias("object_id"), F.explode(F.regexp_extract_all(F.hex("o.bitmap"), F.lit("(..)"))).alias("code"))
    return found.groupBy(*KEY, "object_id", F.conv("code", 16, 10).cast("int").alias("value")).agg(F.count(F.lit(1)).alias("pixels"))




@C.listwise(T.ArrayType(S.BITMAP))
def doubled(objects):
    """Decoded objects at twice the size, by nearest neighbour; others are left out."""
    out = []
    for o in objects or []:
        if o["bitmap"] is not None:
            grid = np.frombuffer(o["bitmap"], dtype=np.uint8).reshape(o["height"], o["width"])
            out.append({"id": o["id"], "version": o["version"], "width": 2 * o["width"], "height": 2 * o["height"], "pixels": grid.repeat(2, 0).repeat(2, 1).tobytes()})
    return out


def enlarge(sets: DataFrame) -> DataFrame:
    """Twice the size within the frame, colours swapped and lightness inverted: a transform to re-encode.

    Adds dts, and objects as plans.assemble.built_sets takes them.
    """
    frame_w, frame_h = F.col("composition.video_width"), F.col("composition.video_height")

    def place(x, most, size=F.lit(0)):  # noqa: ANN001, ANN202
        return F.greatest(F.lit(0), F.least(x * 2, most - size)).cast("int")

    own_size = lambda object_id, n: F.coalesce(F.get(F.filter("objects", lambda o: o["id"] == object_id), F.lit(0))[n] * 2, F.lit(0))
    placed = F.transform(
        "composition.objects",
        lambda p: p.withField("x", place(p["x"], frame_w, own_size(p["object_id"], "width"))).withField("y", place(p["y"], frame_h, own_size(p["object_id"], "height"))),
    )
    window = lambda w: C.record(
        id=w["id"], x=place(w["x"], frame_w), y=place(w["y"], frame_h),
        width=F.least(w["width"] * 2, frame_w - place(w["x"], frame_w)).cast("int"), height=F.least(w["height"] * 2, frame_h - place(w["y"], frame_h)).cast("int"),
    )
    entry = lambda e: C.record(id=e["id"], luminance=(255 - e["luminance"]).cast("short"), cr=e["cb"], cb=e["cr"], alpha=e["alpha"])
    palette = lambda p: C.record(id=p["id"], version=p["version"], entries=F.transform(p["entries"], entry))
    return sets.select(
        "file", "track_id", "set_seq", "pts", F.lit(0).cast("long").alias("dts"), F.col("composition").withField("objects", placed).alias("composition"), F.transform("windows", window).alias("windows"),
        F.transform("palettes", palette).alias("palettes"), doubled(F.transform("objects", lambda o: C.record(**{n: o[n] for n in ("id", "version", "width", "height", "bitmap")}))).alias("objects"),
    )


def durations(sets: DataFrame) -> DataFrame:
    """How long each set stands until the next of its track; null for the last."""
    w = Window.partitionBy("file", "track_id").orderBy("set_seq")
    return sets.select(*KEY, "pts", (F.lead("pts").over(w) - F.col("pts")).alias("ticks"))


