"""Clip information beside a Blu-ray stream: languages by PID, and presentation times."""

from __future__ import annotations

import os
import struct

# Fixed values of the format.
MAGIC = b"HDMV"
SEQUENCE_AT, PROGRAM_AT = 8, 12
CODINGS = (0x90, 0x91)
SMALLEST = 40


def clip_path(stream: str) -> str | None:
    """BDMV/STREAM/x.m2ts to BDMV/CLIPINF/x.clpi, where that exists."""
    folder, name = os.path.split(os.path.abspath(stream))
    if os.path.basename(folder).upper() != "STREAM":
        return None
    tried = (os.path.join(os.path.dirname(folder), d, f"{os.path.splitext(name)[0]}.clpi") for d in ("CLIPINF", "clipinf"))
    return next((p for p in tried if os.path.exists(p)), None)


def _section(data: bytes, at: int) -> bytes | None:
    if len(data) < SMALLEST or data[:4] != MAGIC:
        return None
    offset = int.from_bytes(data[at : at + 4], "big")
    return data[offset:] if 0 < offset < len(data) else None


def presentation_times(data: bytes) -> tuple[int, int] | None:
    """Start and end, in ticks, of the first sequence of the first clip."""
    s = _section(data, SEQUENCE_AT)
    if s is None or len(s) < 26 or not s[5] or not s[10]:
        return None
    return struct.unpack_from(">II", s, 18)


def _streams(section: bytes, at: int) -> dict[int, str] | None:
    if at >= len(section) or not 0 < section[at] <= 100:
        return None
    found: dict[int, str] = {}
    count, at = section[at], at + 1
    for _ in range(count):
        if at + 8 > len(section):
            return None
        streams, groups = section[at + 6], section[at + 7]
        at += 8
        for _ in range(streams):
            if at + 3 > len(section):
                return None
            pid, size = struct.unpack_from(">HB", section, at)
            at += 3
            if at + size > len(section):
                return None
            if size >= 4 and section[at] in CODINGS:
                try:
                    language = section[at + 1 : at + 4].decode().rstrip("\0")
                except UnicodeDecodeError:
                    language = ""
                if language not in ("", "und"):
                    found.setdefault(pid, language)
            at += size
        for _ in range(groups):
            if at + 3 > len(section):
                break
            at += 3 + int.from_bytes(section[at + 1 : at + 3], "big")
    return found or None


def languages(data: bytes) -> dict[int, str]:
    """Language by PID, as written; the count of programmes stands at byte 5 or, in some files, 4."""
    section = _section(data, PROGRAM_AT)
    if section is None or len(section) < 6:
        return {}
    return _streams(section, 5) or _streams(section, 4) or {}
