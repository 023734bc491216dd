"""Newline-delimited JSON: structured display sets out, and back in."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..errors import EncodingError
from ..functions import columns as C
from ..plans import assemble as A

JSON_OPTIONS = {"ignoreNullFields": "false"}


def _item(value: Column, names: list[str], raw: bool) -> Column:
    fields = [value[n].alias(n) for n in names]
    return F.struct(*fields, *([C.base64(value["payload"]).alias("payload")] if raw else []))


def tracks_line(tracks: DataFrame) -> DataFrame:
    """One row, ``value``: the header with all tracks in the order in which they are listed."""
    names = ["track_id", "language", "container", "name", "is_default", "is_forced", "display_set_count", "indexed"]
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("file", "ordinal", *names))), lambda t: F.struct(*[t[n].alias(n) for n in names]))
    return tracks.agg(ordered.alias("tracks")).select(F.to_json(F.struct(F.lit("tracks").alias("type"), "tracks"), JSON_OPTIONS).alias("value"))


def to_json_lines(structured: DataFrame, *, raw: bool = False) -> DataFrame:
    """file, set_seq, track_id and ``value``: a line for each structured set."""
    c = F.col("composition")
    composition = F.when(c.isNotNull(), _item(c, S.COMPOSITION.fieldNames(), raw))
    if raw:  # a composition that can't be parsed is its payload alone
        composition_json = F.when(c["state"].isNull() & c.isNotNull(), F.to_json(F.struct(C.base64(c["payload"]).alias("payload")))).otherwise(F.coalesce(F.to_json(composition, JSON_OPTIONS), F.lit("null")))
    else:
        composition_json = F.coalesce(F.to_json(composition, JSON_OPTIONS), F.lit("null"))
    windows = F.transform("windows", lambda w: _item(w, S.WINDOW.fieldNames(), raw))
    palettes = F.transform("palettes", lambda p: _item(p, S.PALETTE.fieldNames(), raw))
    objects = F.transform(
        "objects",
        lambda o: F.struct(*[o[n].alias(n) for n in ("id", "version", "sequence", "data_length", "width", "height")], C.base64(o["bitmap"]).alias("bitmap"), *([C.base64(o["payload"]).alias("payload")] if raw else [])),
    )
    # Sizes that aren't known are left out; no text value can hold this sequence, as quotes are escaped.
    objects_json = F.replace(F.to_json(objects, JSON_OPTIONS), F.lit('"width":null,"height":null,'), F.lit(""))
    line = F.concat(
        F.lit('{"type":"display_set","track_id":'), F.col("track_id").cast("string"), F.lit(',"index":'), F.col("index").cast("string"), F.lit(',"pts":'), F.col("pts").cast("string"),
        F.format_string(',"pts_ms":%.4f', "pts_ms"), F.lit(',"composition":'), composition_json, F.lit(',"windows":'), F.to_json(windows, JSON_OPTIONS), F.lit(',"palettes":'), F.to_json(palettes, JSON_OPTIONS),
        F.lit(',"objects":'), objects_json, F.lit("}"),
    )
    return structured.select("file", "set_seq", "track_id", line.alias("value"))


def write_json_lines(tracks: DataFrame, structured: DataFrame, path: str, *, raw: bool = False) -> None:
    """Text files under path; the header is the first line of the first file."""
    header = tracks_line(tracks).select(F.lit("").alias("file"), F.lit(-1).cast("long").alias("set_seq"), F.lit(-1).cast("long").alias("track_id"), "value")
    header.unionByName(to_json_lines(structured, raw=raw)).orderBy("file", "set_seq", "track_id").select("value").write.text(path)


# Back in

SETS = T.StructType([T.StructField("line", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("track_id", T.LongType()), T.StructField("pts", T.LongType())])
SETS = SETS.add("composition", S.COMPOSITION).add("windows", T.ArrayType(S.WINDOW)).add("palettes", T.ArrayType(S.PALETTE)).add("objects", T.ArrayType(S.BITMAP)).add("error", T.StringType())


def whole_number(value: object, most: int) -> int | None:
    """A JSON number cut towards zero and clipped to 0..most; None for anything else."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    if isinstance(value, float) and not math.isfinite(value):
        return 0 if math.isnan(value) or value < 0 else most
    return max(0, min(most, int(value)))


class Bad(Exception):
    pass


def _need(value: object, key: str) -> object:
    if not isinstance(value, dict) or key not in value:
        raise Bad(f"missing field '{key}'")
    return value[key]


def _number(value: object, key: str, most: int) -> int:
    found = whole_number(_need(value, key), most)
    if found is None:
        raise Bad(f"field '{key}' is not a number")
    return found


def _numbers(value: object, **most: int) -> dict[str, int]:
    return {k: _number(value, k, m) for k, m in most.items()}


BYTE, WORD = 0xFF, 0xFFFF


def _composition(value: object) -> dict:
    name = _need(value, "state")
    if not isinstance(name, str):
        raise Bad("'state' is not a string")
    if name not in S.STATE_CODES:
        raise Bad(f"unknown composition state '{name}'")
    placements = []
    for p in value["objects"] if isinstance(value.get("objects"), list) else []:
        crop = p.get("crop") if isinstance(p, dict) else None
        placements.append(
            {"crop": _numbers(crop, x=WORD, y=WORD, width=WORD, height=WORD) if crop is not None else None} | _numbers(p, object_id=WORD, window_id=BYTE, x=WORD, y=WORD)
        )
    out = _numbers(value, video_width=WORD, video_height=WORD, number=WORD)
    if not isinstance(_need(value, "palette_only"), bool):
        raise Bad("'palette_only' is not a boolean")
    return out | {"state": name, "palette_only": value["palette_only"], "objects": placements} | _numbers(value, palette_id=BYTE)


def _palette(value: object) -> dict:
    entries = _need(value, "entries")
    if not isinstance(entries, list):
        raise Bad("'entries' is not an array")
    listed = [_numbers(e, id=BYTE, luminance=BYTE, cr=BYTE, cb=BYTE, alpha=BYTE) for e in entries]
    return _numbers(value, id=BYTE, version=BYTE) | {"entries": listed}


def _bitmap(value: object) -> dict:
    out = _numbers(value, id=WORD, version=BYTE, width=WORD, height=WORD)
    text = _need(value, "bitmap")
    if text is None:
        raise Bad(f"object {out['id']} has null bitmap, cannot encode")
    if not isinstance(text, str):
        raise Bad("'bitmap' is not a string")
    pixels = C.decode_base64(text)
    if pixels is None:
        raise Bad(f"object {out['id']} bitmap decode failed")
    if len(pixels) != out["width"] * out["height"]:
        raise Bad(f"object {out['id']} bitmap size mismatch: got {len(pixels)} bytes, expected {out['width'] * out['height']} ({out['width']}x{out['height']})")
    return out | {"pixels": pixels}


def parse_line(text: str) -> dict:
    """kind: set, skipped (another type or no composition), tracks, blank or error; and the set's parts."""
    out: dict = dict.fromkeys(("track_id", "pts", "composition", "windows", "palettes", "objects", "error"))
    if not text.strip():
        return out | {"kind": "blank"}
    try:
        try:
            value = json.loads(text)
        except ValueError as e:
            raise Bad(f"invalid JSON: {e}") from None
        kind = value.get("type") if isinstance(value, dict) else None
        if not isinstance(kind, str):
            raise Bad("missing 'type' field")
        if kind != "display_set":
            return out | {"kind": "tracks" if kind == "tracks" else "unknown", "error": None if kind == "tracks" else f"skipping unknown type '{kind}'"}
        if "pts" in value:
            out["pts"] = whole_number(value["pts"], (1 << 63) - 1)
            if out["pts"] is None:
                raise Bad("'pts' is not a number")
        elif "pts_ms" in value:
            ms = value["pts_ms"]
            if isinstance(ms, bool) or not isinstance(ms, (int, float)):
                raise Bad("'pts_ms' is not a number")
            out["pts"] = whole_number(math.floor(ms * 90.0 + 0.5) if math.isfinite(ms) else ms, (1 << 63) - 1)
        else:
            raise Bad("missing 'pts' or 'pts_ms'")
        out["track_id"] = whole_number(value.get("track_id"), (1 << 63) - 1) or 0
        if value.get("composition") is None:
            return out | {"kind": "skipped"}
        out["composition"] = _composition(value["composition"])
        lists = {k: value[k] if isinstance(value.get(k), list) else [] for k in ("windows", "palettes", "objects")}
        out["windows"] = [_numbers(w, id=BYTE, x=WORD, y=WORD, width=WORD, height=WORD) for w in lists["windows"]]
        out["palettes"] = [_palette(p) for p in lists["palettes"]]
        out["objects"] = [_bitmap(o) for o in lists["objects"]]
        return out | {"kind": "set"}
    except Bad as e:
        return dict.fromkeys(out) | {"kind": "error", "error": str(e)}


def parse_lines(lines: DataFrame) -> DataFrame:
    """``SETS`` rows of lines (line, value); numbers of lines count from one."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [{"line": n} | parse_line(v if isinstance(v, str) else "") for n, v in zip(part["line"], part["value"], strict=True)]
            frame = pd.DataFrame({f: pd.Series([r[f] for r in rows], dtype=object) for f in SETS.fieldNames()})
            yield frame.astype({"line": "int64"})

    return lines.select(F.col("line").cast("long"), "value").mapInPandas(run, SETS)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of one text file, numbered in its order, however many tasks read it.

    Splits of a file are read in order, so a count of each one's lines numbers them all.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    counts = lines.groupBy(F.shiftright("at", 33).alias("part")).count().orderBy("part").collect()
    before, total = [], 1
    for r in counts:
        before += [F.lit(r.part), F.lit(total)]
        total += r["count"]
    first = F.element_at(F.create_map(*before), F.shiftright("at", 33)) if before else F.lit(1)
    return lines.select((first + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("line"), "value")


def raise_errors(parsed: DataFrame) -> None:
    """The error of the lowest line that has one."""
    first = parsed.filter("kind = 'error'").orderBy("line").select("line", "error").first()
    if first is not None:
        raise EncodingError(f"line {first.line}: {first.error}")


def encoded(parsed: DataFrame) -> DataFrame:
    """Display sets of parsed lines, in the order of the lines within each track."""
    sets = parsed.filter("kind = 'set'").select(F.lit("ndjson").alias("file"), "track_id", F.col("line").alias("set_seq"), "pts", F.lit(0).cast("long").alias("dts"), "composition", "windows", "palettes", "objects")
    return A.built_sets(sets)


__all__ = ["encoded", "parse_line", "parse_lines", "raise_errors", "read_lines", "to_json_lines", "tracks_line", "write_json_lines"]
