"""Bytes to values and back, one at a time: segment framing, payloads, run lengths, display sets.

``functions.columns`` has the same as Spark columns.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np

from ..errors import EncodingError, InvalidPgs
from ..schema import SEGMENT_CODES, SEGMENT_TYPES, SEQUENCE_CODES, SEQUENCES, STATE_CODES, STATES

# Fixed values of the format.
MAGIC = b"PG"
HEADER = struct.Struct(">2sIIBH")
RAW_HEADER = struct.Struct(">BH")
MAX_PAYLOAD = 65535
FIRST_HEADER = 11
NEXT_HEADER = 4
MAX_RUN = 16383
# Zeros, or three and more of a colour; other pixels stand for themselves.
CODED = re.compile(rb"\0+|([^\0])\1\1+", re.DOTALL)
FRAME_RATE = 0x10


def parse_segment(data: bytes, at: int = 0) -> tuple[int, int, str, bytes, int]:
    """(pts, dts, type, payload, end) of the segment with a 13-byte header at ``at``."""
    if len(data) - at < HEADER.size:
        raise InvalidPgs(f"segment header needs {HEADER.size} bytes, {len(data) - at} left")
    magic, pts, dts, code, size = HEADER.unpack_from(data, at)
    if magic != MAGIC:
        raise InvalidPgs(f"segment begins with {magic.hex()}, not PG")
    if code not in SEGMENT_TYPES:
        raise InvalidPgs(f"unknown segment type 0x{code:02X}")
    end = at + HEADER.size + size
    if end > len(data):
        raise InvalidPgs(f"segment payload needs {size} bytes, {len(data) - at - HEADER.size} left")
    return pts, dts, SEGMENT_TYPES[code], bytes(data[at + HEADER.size : end]), end


def write_segment(pts: int, dts: int, segment_type: str, payload: bytes) -> bytes:
    """The segment with its header; times are cut to 32 bits, the length to 16."""
    return HEADER.pack(MAGIC, pts & 0xFFFFFFFF, dts & 0xFFFFFFFF, SEGMENT_CODES[segment_type], len(payload) & 0xFFFF) + payload


def split_raw(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(type, payload) of segments without PG header; unknown types are skipped, a cut tail is dropped."""
    at = 0
    while at + RAW_HEADER.size <= len(data):
        code, size = RAW_HEADER.unpack_from(data, at)
        at += RAW_HEADER.size
        if at + size > len(data):
            return
        if code in SEGMENT_TYPES:
            yield SEGMENT_TYPES[code], bytes(data[at : at + size])
        at += size


def split_block(data: bytes, pts: int, dts: int) -> Iterator[tuple[int, int, str, bytes]]:
    """(pts, dts, type, payload) of a container's block, in either framing.

    With PG headers, the times are the segments' own, and the first bad segment ends the block.
    """
    if data[:2] != MAGIC:
        for kind, payload in split_raw(data):
            yield pts, dts, kind, payload
        return
    at = 0
    while at < len(data):
        try:
            own_pts, own_dts, kind, payload, at = parse_segment(data, at)
        except InvalidPgs:
            return
        yield own_pts, own_dts, kind, payload


def nearest(low: int, known: int, bits: int = 32) -> int:
    """The time next to ``known`` that agrees with ``low`` in its last bits, where that isn't below zero."""
    half = 1 << bits - 1
    found = known + (low - known + half) % (2 * half) - half
    return found if found >= 0 else low


def state_of(payload: bytes) -> str | None:
    """The composition state of a PCS payload, which needs eight bytes for it."""
    return STATES.get(payload[7]) if len(payload) >= 8 else None


def parse_pcs(payload: bytes) -> dict | None:
    if len(payload) < 11 or payload[7] not in STATES:
        return None
    width, height, _, number, state, flag, palette, count = struct.unpack_from(">HHBHBBBB", payload)
    placements, at = [], 11
    for _ in range(count):
        if at + 8 > len(payload):
            return None
        object_id, window_id, cropped, x, y = struct.unpack_from(">HBBHH", payload, at)
        at += 8
        crop = None
        if cropped & 0x80:
            if at + 8 > len(payload):
                return None
            crop = dict(zip(("x", "y", "width", "height"), struct.unpack_from(">HHHH", payload, at), strict=True))
            at += 8
        placements.append({"object_id": object_id, "window_id": window_id, "x": x, "y": y, "crop": crop})
    return {"number": number, "state": STATES[state], "video_width": width, "video_height": height, "palette_only": flag == 0x80, "palette_id": palette, "objects": placements}


def write_pcs(c: dict) -> bytes:
    placements = c.get("objects") or []
    head = struct.pack(">HHBHBBBB", c["video_width"], c["video_height"], FRAME_RATE, c["number"], STATE_CODES[c["state"]], 0x80 if c["palette_only"] else 0, c["palette_id"], len(placements) & 0xFF)
    parts = [head]
    for p in placements:
        crop = p.get("crop")
        parts.append(struct.pack(">HBBHH", p["object_id"], p["window_id"], 0x80 if crop else 0, p["x"], p["y"]))
        if crop:
            parts.append(struct.pack(">HHHH", crop["x"], crop["y"], crop["width"], crop["height"]))
    return b"".join(parts)


def parse_wds(payload: bytes) -> list[dict] | None:
    if not payload or len(payload) < 1 + 9 * payload[0]:
        return None
    return [dict(zip(("id", "x", "y", "width", "height"), v, strict=True)) for v in struct.iter_unpack(">BHHHH", payload[1 : 1 + 9 * payload[0]])]


def write_wds(windows: list[dict]) -> bytes:
    return bytes([len(windows) & 0xFF]) + b"".join(struct.pack(">BHHHH", w["id"], w["x"], w["y"], w["width"], w["height"]) for w in windows)


def parse_pds(payload: bytes) -> dict | None:
    if len(payload) < 2 or (len(payload) - 2) % 5:
        return None
    entries = [dict(zip(("id", "luminance", "cr", "cb", "alpha"), v, strict=True)) for v in struct.iter_unpack(">BBBBB", payload[2:])]
    return {"id": payload[0], "version": payload[1], "entries": entries}


def write_pds(palette: dict) -> bytes:
    return bytes([palette["id"], palette["version"]]) + b"".join(bytes([e["id"], e["luminance"], e["cr"], e["cb"], e["alpha"]]) for e in palette["entries"])


def parse_ods(payload: bytes) -> dict | None:
    if len(payload) < NEXT_HEADER or payload[3] not in SEQUENCES:
        return None
    object_id, version, flag = struct.unpack_from(">HBB", payload)
    out = {"id": object_id, "version": version, "sequence": SEQUENCES[flag], "data_length": 0, "width": None, "height": None, "rle": payload[NEXT_HEADER:]}
    if flag & 0x80:
        if len(payload) < FIRST_HEADER:
            return None
        width, height = struct.unpack_from(">HH", payload, 7)
        out |= {"data_length": int.from_bytes(payload[4:7], "big"), "width": width, "height": height, "rle": payload[FIRST_HEADER:]}
    return out


def write_ods(o: dict) -> bytes:
    flag = SEQUENCE_CODES[o["sequence"]]
    head = struct.pack(">HBB", o["id"], o["version"], flag)
    if flag & 0x80:
        head += (o["data_length"] & 0xFFFFFF).to_bytes(3, "big") + struct.pack(">HH", o["width"] or 0, o["height"] or 0)
    return head + o["rle"]


def decode_rle(rle: bytes, width: int, height: int) -> bytes | None:
    """Palette indices, row by row; None where a run lacks an operand.

    Two zeros end a line and fill it up; a line that is full without them doesn't restart the
    count, so an end of line that comes later fills nothing. Runs may cross lines, what goes
    beyond the last pixel is ignored and what is missing is zero.
    """
    total = width * height
    out = np.zeros(total, dtype=np.uint8)
    at, done, column, size = 0, 0, 0, len(rle)
    while at < size and done < total:
        colour = rle[at]
        if colour:  # up to the next zero, bytes stand for themselves
            zero = rle.find(0, at)
            run = (size if zero < 0 else zero) - at
            out[done : done + run] = np.frombuffer(rle, np.uint8, min(run, total - done), at)
            at += run
        else:
            at += 1
            if at >= size:
                break
            mark, at = rle[at], at + 1
            if not mark:
                done += max(0, width - column)
                column = 0
                continue
            run = mark & 0x3F
            if mark & 0x40:
                if at >= size:
                    return None
                run, at = run << 8 | rle[at], at + 1
            if mark & 0x80:
                if at >= size:
                    return None
                colour, at = rle[at], at + 1
            out[done : done + run] = colour
        done += run
        column += run
    return out.tobytes()


def _coded(found: re.Match) -> bytes:
    """The codes of a run; its last one or two pixels may stand for themselves."""
    colour, run, out = found[0][0], found.end() - found.start(), b""
    while run:
        part = min(run, MAX_RUN)
        run -= part
        if colour and part <= 2:
            out += bytes([colour]) * part
        else:
            out += bytes([0, (0x80 if colour else 0) | part]) if part < 64 else bytes([0, (0xC0 if colour else 0x40) | part >> 8, part & 0xFF])
            out += bytes([colour]) if colour else b""
    return out


def encode_rle(pixels: bytes, width: int, height: int) -> bytes | None:
    """The run lengths of each row, each closed by two zeros; nothing for no pixels, None if the size doesn't fit."""
    if len(pixels) != width * height:
        return None
    return b"".join(CODED.sub(_coded, pixels[at : at + width]) + b"\0\0" for at in range(0, len(pixels), width or 1))


def fragments(object_id: int, version: int, width: int, height: int, rle: bytes) -> Iterator[dict]:
    """The ODS of an object: one, or a first, continuations and a last that fit their payloads."""
    whole = {"id": object_id, "version": version, "data_length": len(rle) + 4, "width": width, "height": height}
    room = MAX_PAYLOAD - FIRST_HEADER
    if len(rle) <= room:
        yield whole | {"sequence": "complete", "rle": rle}
        return
    yield whole | {"sequence": "first", "rle": rle[:room]}
    step = MAX_PAYLOAD - NEXT_HEADER
    for at in range(room, len(rle), step):
        yield {"id": object_id, "version": version, "sequence": "last" if at + step >= len(rle) else "continuation", "rle": rle[at : at + step]}


def build_display_set(composition: dict | None, windows: list[dict] | None = None, palettes: list[dict] | None = None, bitmaps: list[dict] | None = None) -> list[tuple[str, bytes]]:
    """(type, payload) of the set's segments: PCS, WDS if there are windows, PDS, ODS, END."""
    if composition is None:
        raise EncodingError("a display set needs a composition")
    out = [("PCS", write_pcs(composition))]
    if windows is not None:
        out.append(("WDS", write_wds(windows)))
    out += [("PDS", write_pds(p)) for p in palettes or []]
    for b in bitmaps or []:
        rle = encode_rle(b["pixels"], b["width"], b["height"])
        if rle is None:
            raise EncodingError(f"object {b['id']}: {len(b['pixels'])} pixels don't fill {b['width']}x{b['height']}")
        out += [("ODS", write_ods(o)) for o in fragments(b["id"], b["version"], b["width"], b["height"], rle)]
    return [*out, ("END", b"")]


class Assembler:
    """Display sets of one track, from its segments in order; a row-wise twin of plans.assemble."""

    def __init__(self) -> None:
        self.open: list[tuple[int, int, str, bytes]] = []

    def push(self, pts: int, dts: int, segment_type: str, payload: bytes) -> list[tuple[int, int, str, bytes]] | None:
        """The segments of the set that this one completes, if it does."""
        if segment_type == "PCS":
            self.open = [(pts, dts, segment_type, payload)]
        elif self.open:
            self.open.append((pts, dts, segment_type, payload))
        if segment_type != "END" or not self.open:
            return None
        done, self.open = self.open, []
        return done if state_of(done[0][3]) is not None else None

    def reset(self) -> None:
        self.open = []


def parse_timestamp(text: str) -> float | None:
    """Milliseconds of H:M:S, M:S or S, each with a fraction if it likes."""
    parts = text.split(":")
    if len(parts) > 3:
        return None
    try:
        values = [float(p) if p == p.strip() and "_" not in p else float("x") for p in parts]
    except ValueError:
        return None
    seconds = 0.0
    for scale, value in zip((3600.0, 60.0, 1.0)[3 - len(values) :], values, strict=True):
        seconds += value * scale
    return seconds * 1000.0


def parse_track_ids(text: str) -> list[int]:
    """The numbers of a comma-separated list; what isn't a number is left out."""
    return [int(p) for p in (x.strip() for x in text.split(",")) if p.isascii() and p.isdigit()]


def align_to_packet(position: int, size: int) -> int:
    """position, rounded up to a multiple of size."""
    return -(-position // size) * size
