"""Raw .sup streams: segments with PG headers, one after the other."""

from __future__ import annotations

from collections.abc import Iterator

from ..errors import InvalidPgs
from ..functions.codec import HEADER, parse_segment
from .reader import Reader


def tracks() -> list[dict]:
    return [{"track_id": 0, "language": None, "name": None, "is_default": None, "is_forced": None, "display_set_count": None, "indexed": None}]


def segments(reader: Reader, begin: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int, bytes]]:
    """(position, pts, dts, bytes with header) of the segments that start in [begin, end).

    Headers are followed from the start of the file, as PG may also stand inside a payload;
    payloads before ``begin`` are skipped. A bad segment is an error.
    """
    end = reader.size if end is None else min(end, reader.size)
    position = 0
    while position < end:
        reader.seek(position)
        head = reader.upto(HEADER.size)
        size = HEADER.size + (int.from_bytes(head[11:13], "big") if len(head) == HEADER.size else 0)
        if position >= begin:
            data = head + reader.upto(size - HEADER.size)
            try:
                pts, dts, _, _, _ = parse_segment(data)
            except InvalidPgs as e:
                raise InvalidPgs(f"at byte {position}: {e}") from None
            yield position, pts, dts, data
        elif len(head) < HEADER.size or head[:2] != b"PG":
            return  # the range that holds the bad segment reports it
        position += size
