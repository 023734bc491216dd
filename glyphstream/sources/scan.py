"""Rows of the source tables out of one file or a byte range of it, whatever the container."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from ..errors import PgsError
from . import mkv, sup, ts
from .detect import detect
from .reader import Reader

Range = tuple[int, int | None]
WHOLE: tuple[Range, ...] = ((0, None),)


@dataclass(frozen=True)
class Wanted:
    """What a scan is asked for."""

    strategy: str = "auto"
    track_ids: frozenset[int] | None = None
    low: int | None = None  # ticks, inclusive
    high: int | None = None

    def has(self, track_id: int) -> bool:
        return self.track_ids is None or track_id in self.track_ids


def open_reader(path: str) -> Reader:
    reader = Reader(path)
    container = detect(reader)
    if container == "SUP":
        return reader
    reader.file.close()
    return Reader(path, buffering=ts.SCAN if container in ("M2TS", "TransportStream") else 1 << 16)


def track_rows(reader: Reader, name: str) -> Iterator[tuple]:
    """Rows of schema.TRACKS; languages as the container writes them."""
    container = detect(reader)
    if container == "Matroska":
        found = mkv.read_movie(reader).infos()
    elif container == "SUP":
        found = sup.tracks()
    else:
        found = ts.tracks(reader, ts.detect_layout(reader))
    for i, t in enumerate(found):
        yield name, i, t["track_id"], t["language"], container, t["name"], t["is_default"], t["is_forced"], t["display_set_count"], t["indexed"]


def block_rows(reader: Reader, name: str, wanted: Wanted, ranges: Sequence[Range] = WHOLE) -> Iterator[tuple]:
    """Rows of schema.BLOCKS: of .sup files and Matroska; an error is the last row of a range, or the only one where it's the file's head."""
    container = detect(reader)
    if container not in ("SUP", "Matroska"):
        return
    movie = None
    for begin, end in ranges:
        try:
            if container == "SUP":
                if wanted.has(0):
                    for at, pts, dts, data in sup.segments(reader, begin, end):
                        if (wanted.low is None or pts >= wanted.low) and (wanted.high is None or pts <= wanted.high):
                            yield name, 0, at, pts, dts, "sup", data, None
            else:
                movie = movie or mkv.read_movie(reader)
                for at, track, pts, data in mkv.blocks(reader, movie, None if wanted.track_ids is None else set(wanted.track_ids), begin, end, wanted.strategy, (wanted.low, wanted.high)):
                    yield name, track, at, pts, 0, "sup" if data[:2] == b"PG" else "raw", data, None
        except PgsError as e:
            yield name, None, reader.position, None, None, None, None, str(e)
            if container == "Matroska" and movie is None:
                return


def packet_rows(reader: Reader, name: str, wanted: Wanted, ranges: Sequence[Range] = WHOLE) -> Iterator[tuple]:
    """Rows of schema.PACKETS, of transport streams."""
    container = detect(reader)
    if container not in ("M2TS", "TransportStream"):
        return
    layout = ts.detect_layout(reader)
    pids = {t["track_id"] for t in ts.tracks(reader, layout) if wanted.has(t["track_id"])}
    if not pids:
        return
    offset = ts.pts_offset(reader)
    for begin, end in ranges:
        for at, pid, starts, payload in ts.packets(reader, layout, pids, begin, end):
            yield name, pid, at, starts, payload, offset


def stats_rows(reader: Reader, name: str, wanted: Wanted) -> Iterator[tuple]:
    """A row of schema.STATS: what reading all wanted blocks of the file consumes."""
    container = detect(reader)
    rows = block_rows if container in ("SUP", "Matroska") else packet_rows
    for _ in rows(reader, name, wanted):
        pass
    yield name, container, reader.size, reader.consumed
