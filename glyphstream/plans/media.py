"""Bytes of containers out of logical display sets, for the queries that read files and for tests."""

from __future__ import annotations

import struct
import zlib

from ..functions import codec
from ..sources import mkv


def composition(number, state="epoch_start", objects=(), palette_id=0):
    return {"number": number, "state": state, "video_width": 1920, "video_height": 1080, "palette_only": False, "palette_id": palette_id, "objects": list(objects)}


def display_set(number, state="epoch_start", pixels=b"\1\2\2\0\3\3", width=3, height=2):
    placed = [{"object_id": 7, "window_id": 1, "x": (100 + number) % 65536, "y": 900, "crop": {"x": 1, "y": 0, "width": 2, "height": 2} if number % 2 else None}]
    if state == "normal":
        return codec.build_display_set(composition(number, state))
    palette = {"id": 0, "version": number % 5, "entries": [{"id": i, "luminance": 40 * i + number % 7, "cr": 128, "cb": 120, "alpha": 0 if i == 0 else 255} for i in range(5)]}
    windows = [{"id": 1, "x": 100, "y": 900, "width": 400, "height": 80}]
    return codec.build_display_set(composition(number, state, placed), windows, [palette], [{"id": 7, "version": 0, "width": width, "height": height, "pixels": pixels}])


def movie_sets(count=12, step=90000, first=90000):
    """(pts, segments) of a track."""
    return [(first + i * step, display_set(i, ("epoch_start", "normal", "acquisition_point")[i % 3])) for i in range(count)]


def sup(sets):
    return b"".join(codec.write_segment(pts, 0, kind, payload) for pts, parts in sets for kind, payload in parts)


def raw(parts):
    return b"".join(codec.RAW_HEADER.pack(codec.SEGMENT_CODES[kind], len(payload)) + payload for kind, payload in parts)


# Transport streams


def pes_time(value, mark=0x20):
    return bytes([mark | (value >> 30 & 7) << 1 | 1, value >> 22 & 0xFF, (value >> 15 & 0x7F) << 1 | 1, value >> 7 & 0xFF, (value & 0x7F) << 1 | 1])


def pes(pts, data):
    return b"\0\0\1\xbd\0\0\x84\x80\5" + pes_time(pts) + data


def ts_packet(pid, starts, payload, counter=0):
    room = 184 - len(payload)
    field = b"" if not room else bytes([room - 1]) + (b"\0" + b"\xff" * (room - 2) if room > 1 else b"")
    return bytes([0x47, (0x40 if starts else 0) | pid >> 8, pid & 0xFF, (0x30 if room else 0x10) | counter & 15]) + field + payload


def pat(pmt_pid):
    body = b"\0\0" + b"\xe0\x10" + b"\0\1" + struct.pack(">H", 0xE000 | pmt_pid)
    return b"\0" + b"\0" + struct.pack(">H", 0xB000 | len(body) + 9) + b"\0\1\xc1\0\0" + body + b"\0" * 4


def pmt(streams):
    body = b"".join(bytes([kind]) + struct.pack(">HH", 0xE000 | pid, 0xF000 | (6 if lang else 0)) + (b"\x0a\4" + lang.encode() + b"\0" if lang else b"") for kind, pid, lang in streams)
    return b"\0" + b"\2" + struct.pack(">H", 0xB000 | len(body) + 13) + b"\0\1\xc1\0\0\xe1\0\xf0\0" + body + b"\0" * 4


def transport(tracks, *, m2ts=True, junk=None):
    """tracks: {pid: (language, sets)}; a video stream 0x1011 lies between."""
    packets = [ts_packet(0, True, pat(0x100)), ts_packet(0x100, True, pmt([(0x1B, 0x1011, None), *[(0x90, pid, lang) for pid, (lang, _) in tracks.items()]]))]
    events = sorted(((pts, pid, parts) for pid, (_, sets) in tracks.items() for pts, parts in sets), key=lambda e: e[:2])
    for pts, pid, parts in events:
        data = pes(pts, raw(parts))
        for at in range(0, len(data), 184):
            packets.append(ts_packet(pid, at == 0, data[at : at + 184]))
            packets.append(ts_packet(0x1011, False, b"v" * 184))
    out = [b"\0\0\0\0" * m2ts + p for p in packets]
    if junk is not None:
        out.insert(len(out) // 2, junk)
    out += [b"\0\0\0\0" * m2ts + ts_packet(0x1FFF, False, b"\xff" * 184)] * 4
    return b"".join(out)


def clip_info(languages, start=0, end=0):
    streams = b"".join(struct.pack(">HB", pid, 5) + b"\x90" + lang.encode().ljust(4, b"\0") for pid, lang in languages.items())
    program = b"\0\0\0\0\0\1" + b"\0\0\0\0\1\0" + bytes([len(languages), 0]) + streams
    sequence = b"\0\0\0\0\0\1" + b"\0\0\0\0\1\0" + b"\x10\x01\0\0\0\0" + struct.pack(">II", start, end)
    return b"HDMV0200" + struct.pack(">II", 40, 40 + len(sequence)) + b"\0" * 24 + sequence + program


# Matroska


def size_bytes(n):
    return struct.pack(">Q", 1 << 56 | n)


def el(kind, data, unknown=False):
    if isinstance(data, int):
        data = data.to_bytes(max(1, (data.bit_length() + 7) // 8), "big")
    if isinstance(data, str):
        data = data.encode()
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + (b"\x01" + b"\xff" * 7 if unknown else size_bytes(len(data))) + data


def track_entry(number, uid, language=None, name=None, default=None, forced=None, bcp47=None, compression=None):
    parts = el(mkv.TRACK_NUMBER, number) + el(mkv.TRACK_UID, uid) + el(mkv.TRACK_TYPE, 0x11) + el(mkv.CODEC_ID, "S_HDMV/PGS")
    for kind, value in ((mkv.LANGUAGE, language), (mkv.LANGUAGE_BCP47, bcp47), (mkv.TRACK_NAME, name), (mkv.FLAG_DEFAULT, default), (mkv.FLAG_FORCED, forced)):
        parts += el(kind, value) if value is not None else b""
    if compression is not None:
        algorithm, settings = compression
        inner = (el(mkv.COMP_ALGO, algorithm) if algorithm else b"") + (el(mkv.COMP_SETTINGS, settings) if settings else b"")
        parts += el(mkv.ENCODINGS, el(mkv.ENCODING, el(mkv.COMPRESSION, inner)))
    return el(mkv.TRACK_ENTRY, parts)


def matroska(tracks, *, cues=True, tags=True, relative=True, unknown=False, per_cluster=4, group=True):
    """tracks: {number: (entry keywords, sets)}; blocks of a video track 1 lie between."""
    entries = el(mkv.TRACK_ENTRY, el(mkv.TRACK_NUMBER, 1) + el(mkv.TRACK_UID, 99) + el(mkv.TRACK_TYPE, 1) + el(mkv.CODEC_ID, "V_MPEG4/ISO/AVC"))
    entries += b"".join(track_entry(n, n * 10, **kw) for n, (kw, _) in tracks.items())
    head = el(mkv.INFO, el(mkv.TIMESTAMP_SCALE, 1_000_000)) + el(mkv.TRACKS, entries)
    events = sorted(((pts, n, parts) for n, (_, sets) in tracks.items() for pts, parts in sets), key=lambda e: e[:2])
    clusters, points = [], []
    seek_size = len(el(mkv.SEEK_HEAD, b"".join(el(mkv.SEEK, el(mkv.SEEK_ID, i.to_bytes(4, "big")) + el(mkv.SEEK_POSITION, b"\0" * 8)) for i in (mkv.CUES, mkv.TAGS))))
    at = seek_size + len(head)
    for begin in range(0, len(events), per_cluster):
        time = events[begin][0] // 90
        body = el(mkv.TIMESTAMP, time) + el(mkv.SIMPLE_BLOCK, b"\x81\0\0\x80" + b"v" * 300)
        for i, (pts, number, parts) in enumerate(events[begin : begin + per_cluster]):
            data, kw = raw(parts), tracks[number][0]
            algorithm, settings = kw.get("compression") or (None, b"")
            data = zlib.compress(data) if algorithm == 0 else data[len(settings) :] if algorithm == 3 else data
            block = bytes([0x80 | number]) + struct.pack(">hB", pts // 90 - time, 0) + data
            points.append((pts // 90, number, at, len(body)))
            body += el(mkv.BLOCK_GROUP, el(mkv.BLOCK, block)) if group and i % 2 else el(mkv.SIMPLE_BLOCK, block)
            body += el(mkv.SIMPLE_BLOCK, b"\x81\0\0\x80" + b"v" * 200)
        clusters.append(el(mkv.CLUSTER, body, unknown))
        at += len(clusters[-1])
    tail, places = b"", []
    for kind, wanted in ((mkv.CUES, cues), (mkv.TAGS, tags)):
        if wanted and kind == mkv.CUES:
            data = b"".join(
                el(mkv.CUE_POINT, el(mkv.CUE_TIME, t) + el(mkv.CUE_POSITIONS, el(mkv.CUE_TRACK, n) + el(mkv.CUE_CLUSTER, c) + (el(mkv.CUE_RELATIVE, r) if relative else b""))) for t, n, c, r in points
            )
        elif wanted:
            data = b"".join(el(mkv.TAG, el(mkv.TARGETS, el(mkv.TAG_UID, n * 10)) + el(mkv.SIMPLE_TAG, el(mkv.TAG_NAME, "NUMBER_OF_FRAMES") + el(mkv.TAG_STRING, str(len(s))))) for n, (_, s) in tracks.items())
        if wanted:
            places.append((kind, at + len(tail)))
            tail += el(kind, data)
    seeks = b"".join(el(mkv.SEEK, el(mkv.SEEK_ID, k.to_bytes(4, "big")) + el(mkv.SEEK_POSITION, p.to_bytes(8, "big"))) for k, p in places)
    seek_head = el(mkv.SEEK_HEAD, seeks)
    void = seek_size - len(seek_head)
    if void:
        seek_head = el(mkv.SEEK_HEAD, seeks + el(0xEC, b"\0" * (void - 9)))
    assert len(seek_head) == seek_size
    return el(mkv.EBML, el(mkv.DOC_TYPE, "matroska")) + el(mkv.SEGMENT, seek_head + head + b"".join(clusters) + tail)
