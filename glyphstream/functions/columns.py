"""Spark columns for the format's bytes.

What has a fixed layout is plain Catalyst (windows, palettes, objects, times, colours,
serialisation); what walks variable-length bytes (placements, run lengths, raw segments)
is an Arrow UDF over the decoders in ``functions.codec``.
"""

from __future__ import annotations

import base64 as b64
import zlib
from collections.abc import Callable
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .. import schema as S
from . import codec


def listwise(kind: T.DataType) -> Callable:
    """An Arrow UDF out of a function of one row's values; its result has the type ``kind``."""

    def wrap(one: Callable) -> Callable:
        @arrow_udf(kind)
        def run(*columns: pa.Array) -> pa.Array:
            from pyspark.sql.pandas.types import to_arrow_type

            return pa.array([one(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], type=to_arrow_type(kind))

        # Else the optimiser may move the call into the lambda of a function over arrays, where it can't run.
        return run.asNondeterministic()

    return wrap


def record(**fields: Column) -> Column:
    """A struct whose names hold inside of lambdas too, where aliases may be lost."""
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def be(payload: Column | str, at: int | Column, size: int) -> Column:
    """The big-endian unsigned integer of ``size`` bytes at byte ``at`` (from zero)."""
    column = F.col(payload) if isinstance(payload, str) else payload
    begin = at + 1 if isinstance(at, Column) else F.lit(at + 1)
    return F.conv(F.hex(F.substr(column, begin, F.lit(size))), 16, 10).cast("long")


def to_be(value: Column, size: int) -> Column:
    """The low ``size`` bytes of an integer, big-endian."""
    return F.unhex(F.right(F.lpad(F.hex(value.cast("long")), F.lit(16), F.lit("0")), F.lit(2 * size)))


def named(code: Column, names: dict[int, str]) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(names.items()))), code.cast("int"))


def code_of(name: Column, names: dict[int, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in names.items() for x in (v, k)]), name)


def joined(parts: Column) -> Column:
    """All binary values of an array, one after the other; empty for none."""
    return F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p)), ""))


# Times


def pts_ms(pts: Column | str) -> Column:
    return (F.col(pts) if isinstance(pts, str) else pts) / F.lit(90.0)


def minus_offset(pts: Column, offset: Column) -> Column:
    return F.greatest(pts - offset, F.lit(0).cast("long"))


def since(start: Column, pts: Column, bits: int) -> Column:
    """The first time from ``start`` on that a clock of so many bits shows as ``pts``."""
    return start + F.pmod(pts - start, F.lit(1 << bits))


def pes_time(five: Column) -> Column:
    """The 33-bit time in the five bytes of a PES header."""
    part = lambda at, mask: be(five, at, 1).bitwiseAND(F.lit(mask))
    return (
        F.shiftleft(F.shiftright(part(0, 0x0E), 1), 30)
        + F.shiftleft(part(1, 0xFF), 22)
        + F.shiftleft(F.shiftright(part(2, 0xFE), 1), 15)
        + F.shiftleft(part(3, 0xFF), 7)
        + F.shiftright(part(4, 0xFE), 1)
    )


# Payloads


def wds(payload: Column) -> Column:
    """The windows of a WDS payload; null where it is cut off."""
    count = be(payload, 0, 1)
    numbers = F.slice(F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long")), F.lit(1), count.cast("int"))
    at = lambda i, o: i * 9 + 1 + o
    window = lambda i: F.struct(
        be(payload, at(i, 0), 1).cast("short").alias("id"), *[be(payload, at(i, 1 + 2 * k), 2).cast("int").alias(n) for k, n in enumerate(("x", "y", "width", "height"))]
    )
    return F.when((F.octet_length(payload) > 0) & (F.octet_length(payload) >= 1 + 9 * count), F.transform(numbers, window))


def pds(payload: Column) -> Column:
    """id, version and entries of a PDS payload; null where bytes are left over or missing."""
    size = F.octet_length(payload)
    numbers = F.slice(F.sequence(F.lit(0).cast("long"), F.lit(13106).cast("long")), F.lit(1), ((size - 2) / 5).cast("int"))
    entry = lambda i: F.struct(*[be(payload, i * 5 + 2 + k, 1).cast("short").alias(n) for k, n in enumerate(("id", "luminance", "cr", "cb", "alpha"))])
    found = F.struct(be(payload, 0, 1).cast("short").alias("id"), be(payload, 1, 1).cast("short").alias("version"), F.transform(numbers, entry).alias("entries"))
    return F.when((size >= 2) & ((size - 2) % 5 == 0), found)


def ods(payload: Column) -> Column:
    """The fields and run lengths of an ODS payload; null where it is too short or its flag unknown."""
    size, flag = F.octet_length(payload), named(be(payload, 3, 1), S.SEQUENCES)
    full = flag.isin("complete", "first")
    found = F.struct(
        be(payload, 0, 2).cast("int").alias("id"),
        be(payload, 2, 1).cast("short").alias("version"),
        flag.alias("sequence"),
        F.when(full, be(payload, 4, 3)).otherwise(0).cast("int").alias("data_length"),
        F.when(full, be(payload, 7, 2)).cast("int").alias("width"),
        F.when(full, be(payload, 9, 2)).cast("int").alias("height"),
        F.when(full, F.substr(payload, F.lit(12))).otherwise(F.substr(payload, F.lit(5))).alias("rle"),
    )
    return F.when((size >= 4) & flag.isNotNull() & (~full | (size >= 11)), found)


def state(payload: Column) -> Column:
    """The composition state of a PCS payload of at least eight bytes, else null."""
    return F.when(F.octet_length(payload) >= 8, named(be(payload, 7, 1), S.STATES))


@listwise(S.COMPOSITION)
def pcs(payload):
    """The composition in a PCS payload; null where it can't be parsed."""
    return codec.parse_pcs(payload) if payload is not None else None


@listwise(T.BinaryType())
def rle_decode(rle, width, height):
    """Pixels of run lengths, null where they can't be decoded or the size isn't known."""
    return None if rle is None or width is None or height is None else codec.decode_rle(rle, width, height)


@listwise(T.BinaryType())
def rle_encode(pixels, width, height):
    """Run lengths of pixels, null where they don't fill the size."""
    return None if pixels is None or width is None or height is None else codec.encode_rle(pixels, width, height)


@listwise(T.ArrayType(T.BinaryType()))
def bitmaps(objects):
    """Decoded pixels of each object of a set (rle, width, height)."""
    if objects is None:
        return None
    return [None if None in (o["rle"], o["width"], o["height"]) else codec.decode_rle(o["rle"], o["width"], o["height"]) for o in objects]


@listwise(S.BUILT)
def built(composition, windows, palettes, objects):
    """The segments of a display set from its parts; windows null or empty: no WDS."""
    if composition is None:
        return None
    parts = codec.build_display_set(composition, windows or None, [p | {"entries": p["entries"] or []} for p in palettes or []], objects)
    return [{"segment_type": kind, "payload": payload} for kind, payload in parts]


def write_wds(windows: Column) -> Column:
    one = lambda w: F.concat(to_be(w["id"], 1), *[to_be(w[n], 2) for n in ("x", "y", "width", "height")])
    return F.concat(to_be(F.size(windows), 1), joined(F.transform(windows, one)))


def write_pds(palette: Column) -> Column:
    one = lambda e: F.concat(*[to_be(e[n], 1) for n in ("id", "luminance", "cr", "cb", "alpha")])
    return F.concat(to_be(palette["id"], 1), to_be(palette["version"], 1), joined(F.transform(palette["entries"], one)))


def write_pcs(c: Column) -> Column:
    def one(p: Column) -> Column:
        crop = F.concat(*[to_be(p["crop"][n], 2) for n in ("x", "y", "width", "height")])
        head = F.concat(to_be(p["object_id"], 2), to_be(p["window_id"], 1), F.when(p["crop"].isNotNull(), F.unhex(F.lit("80"))).otherwise(F.unhex(F.lit("00"))), to_be(p["x"], 2), to_be(p["y"], 2))
        return F.when(p["crop"].isNotNull(), F.concat(head, crop)).otherwise(head)

    placements = F.coalesce(c["objects"], F.array().cast(T.ArrayType(S.PLACEMENT)))
    return F.concat(
        to_be(c["video_width"], 2), to_be(c["video_height"], 2), F.unhex(F.lit("10")), to_be(c["number"], 2), to_be(code_of(c["state"], S.STATES), 1),
        F.when(c["palette_only"], F.unhex(F.lit("80"))).otherwise(F.unhex(F.lit("00"))), to_be(c["palette_id"], 1), to_be(F.size(placements), 1), joined(F.transform(placements, one)),
    )


def write_ods(o: Column) -> Column:
    head = F.concat(to_be(o["id"], 2), to_be(o["version"], 1), to_be(code_of(o["sequence"], S.SEQUENCES), 1))
    size = F.concat(to_be(o["data_length"], 3), to_be(F.coalesce(o["width"], F.lit(0)), 2), to_be(F.coalesce(o["height"], F.lit(0)), 2))
    return F.when(o["sequence"].isin("complete", "first"), F.concat(head, size, o["rle"])).otherwise(F.concat(head, o["rle"]))


def sup_bytes(pts: Column, dts: Column, segment_type: Column, payload: Column) -> Column:
    """A segment with its 13-byte header: times cut to 32 bits, the length to 16."""
    return F.concat(F.lit(b"PG"), to_be(pts, 4), to_be(dts, 4), to_be(code_of(segment_type, S.SEGMENT_TYPES), 1), to_be(F.octet_length(payload), 2), payload)


# Text


def base64(data: Column) -> Column:
    """Standard base 64 in one line, whatever the session says about line breaks."""
    return F.translate(F.base64(data), "\r\n", "")


@listwise(T.BinaryType())
def unbase64(text):
    """Bytes of base 64 with or without padding; null for other characters."""
    return decode_base64(text) if text is not None else None


def decode_base64(text: str) -> bytes | None:
    """As unbase64; a last character that stands alone makes one byte of its six bits."""
    plain = text.replace("=", "")
    lone = plain[-1:] if len(plain) % 4 == 1 else ""
    try:
        out = b64.b64decode(plain[: len(plain) - len(lone)] + "=" * (-(len(plain) - len(lone)) % 4), validate=True)
        return out + bytes([b64.b64decode(lone + "A==", validate=True)[0]]) if lone else out
    except ValueError:
        return None


# Colours


def rgba(entry: Column) -> Column:
    """Red, green, blue and alpha of a palette entry: cut towards zero, clipped to a byte."""
    y, cr, cb = (entry[n].cast("double") for n in ("luminance", "cr", "cb"))
    clip = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), v.cast("int"))).cast("short")
    return record(r=clip(y + 1.402 * (cr - 128)), g=clip(y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128)), b=clip(y + 1.772 * (cb - 128)), a=entry["alpha"])


# Blocks


@listwise(T.BinaryType())
def inflate(data):
    """zlib's inverse; null where the stream is broken."""
    return inflated(data) if data is not None else None


def inflated(data: bytes) -> bytes | None:
    try:
        return zlib.decompress(data)
    except zlib.error:
        return None
