"""Schemas of the tables, and the names that stand for the formats' codes."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    ShortType,
    StringType,
    StructField,
    StructType,
)

# Fixed values of the formats.
SEGMENT_TYPES = {0x16: "PCS", 0x17: "WDS", 0x14: "PDS", 0x15: "ODS", 0x80: "END"}
SEGMENT_CODES = {name: code for code, name in SEGMENT_TYPES.items()}
STATES = {0x00: "normal", 0x40: "acquisition_point", 0x80: "epoch_start"}
STATE_CODES = {name: code for code, name in STATES.items()}
SEQUENCES = {0xC0: "complete", 0x80: "first", 0x40: "last", 0x00: "continuation"}
SEQUENCE_CODES = {name: code for code, name in SEQUENCES.items()}
CONTAINERS = ("Matroska", "M2TS", "TransportStream", "SUP")


def struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


LONG, INT, SHORT, TEXT, BYTES, FLAG, REAL = LongType(), IntegerType(), ShortType(), StringType(), BinaryType(), BooleanType(), DoubleType()

TRACKS = struct(file=TEXT, ordinal=INT, track_id=LONG, language=TEXT, container=TEXT, name=TEXT, is_default=FLAG, is_forced=FLAG, display_set_count=LONG, indexed=FLAG)
BLOCKS = struct(file=TEXT, track_id=LONG, block_seq=LONG, pts=LONG, dts=LONG, framing=TEXT, data=BYTES, error=TEXT)
PACKETS = struct(file=TEXT, track_id=LONG, packet_seq=LONG, starts=FLAG, payload=BYTES, pts_offset=LONG)
SEGMENTS = struct(file=TEXT, track_id=LONG, seg_seq=LONG, pts=LONG, dts=LONG, segment_type=TEXT, payload=BYTES)
STATS = struct(file=TEXT, container=TEXT, file_size=LONG, bytes_read=LONG)

CROP = struct(x=INT, y=INT, width=INT, height=INT)
PLACEMENT = struct(object_id=INT, window_id=SHORT, x=INT, y=INT, crop=CROP)
COMPOSITION = struct(number=INT, state=TEXT, video_width=INT, video_height=INT, palette_only=FLAG, palette_id=SHORT, objects=ArrayType(PLACEMENT))
WINDOW = struct(id=SHORT, x=INT, y=INT, width=INT, height=INT)
ENTRY = struct(id=SHORT, luminance=SHORT, cr=SHORT, cb=SHORT, alpha=SHORT)
PALETTE = struct(id=SHORT, version=SHORT, entries=ArrayType(ENTRY))
FRAGMENT = struct(id=INT, version=SHORT, sequence=TEXT, data_length=INT, width=INT, height=INT, rle=BYTES)
BITMAP = struct(id=INT, version=SHORT, width=INT, height=INT, pixels=BYTES)
SEGMENT = struct(seg_seq=LONG, pts=LONG, dts=LONG, segment_type=TEXT, payload=BYTES)
BUILT = ArrayType(struct(segment_type=TEXT, payload=BYTES))
