"""MPEG transport streams, plain (188 bytes) and with time codes (192)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from ..errors import InvalidTs
from . import clpi
from .reader import Reader

# Fixed values of the format.
SYNC = 0x47
PACKET = 188
PGS_STREAM = 0x90
LANGUAGE_TAG = 0x0A
PAT_PACKETS, PMT_PACKETS = 1000, 2000
SCAN = 2 * 1024 * 1024
RESYNC = 256 * 1024
LOOK_BACK = 1024 * 1024  # bytes before a split from which its packets are followed


@dataclass(frozen=True)
class Layout:
    container: str
    size: int
    sync: int  # where the sync byte stands in a packet


LAYOUTS = (Layout("M2TS", 192, 4), Layout("TransportStream", 188, 0))


def detect_layout(reader: Reader) -> Layout | None:
    """The layout of which five sync bytes in a row are found; 1152 bytes are needed."""
    reader.seek(0)
    head = reader.upto(1152)
    reader.seek(0)
    if len(head) < 1152:
        return None
    return next((x for x in LAYOUTS if all(head[x.sync + i * x.size] == SYNC for i in range(5))), None)


def packet_payload(packet: bytes) -> tuple[int, bool, bytes]:
    """(PID, whether a unit starts, payload) of 188 bytes."""
    if packet[0] != SYNC:
        raise InvalidTs(f"sync byte 0x47 expected, found 0x{packet[0]:02X}")
    pid, starts, control = (packet[1] & 0x1F) << 8 | packet[2], bool(packet[1] & 0x40), packet[3] >> 4 & 3
    at = 4
    if control & 2:
        at += 1 + packet[4]
        if at > PACKET:
            raise InvalidTs("adaptation field is longer than its packet")
    return pid, starts, packet[at:] if control & 1 else b""


def _packets(reader: Reader, layout: Layout, most: int) -> Iterator[tuple[int, bool, bytes]]:
    reader.seek(0)
    for _ in range(most):
        packet = reader.upto(layout.size)
        if len(packet) < layout.size:
            return
        yield packet_payload(packet[layout.sync : layout.sync + PACKET])


def _section(reader: Reader, layout: Layout, pid: int, most: int, name: str) -> bytes:
    for own, starts, payload in _packets(reader, layout, most):
        if own == pid and starts and payload and 1 + payload[0] < len(payload):
            return payload[1 + payload[0] :]
    raise InvalidTs(f"{name} not found")


def parse_pat(data: bytes) -> list[int]:
    """PIDs of the programme map tables; programme 0 is the network's."""
    if len(data) < 8 or data[0] != 0:
        raise InvalidTs("PAT section is too short or has another table id")
    end = 3 + max(0, ((data[1] & 0x0F) << 8 | data[2]) - 4)
    if not 8 <= end <= len(data):
        raise InvalidTs("PAT section length doesn't fit")
    rows = [data[i : i + 4] for i in range(8, end - 3, 4)]
    return [(r[2] & 0x1F) << 8 | r[3] for r in rows if r[:2] != b"\0\0"]


def parse_pmt(data: bytes) -> list[tuple[int, int, str | None]]:
    """(stream type, PID, language as written) of a programme's streams."""
    if len(data) < 12 or data[0] != 2:
        raise InvalidTs("PMT section is too short or has another table id")
    at, end = 12 + ((data[10] & 0x0F) << 8 | data[11]), max(0, 3 + ((data[1] & 0x0F) << 8 | data[2]) - 4)
    if at > len(data) or end > len(data):
        raise InvalidTs("PMT section length doesn't fit")
    out = []
    while at + 5 <= end:
        stop = min(end, at + 5 + ((data[at + 3] & 0x0F) << 8 | data[at + 4]))
        out.append((data[at], (data[at + 1] & 0x1F) << 8 | data[at + 2], _language(data[at + 5 : stop])))
        at = stop
    return out


def _language(descriptors: bytes) -> str | None:
    at = 0
    while at + 2 <= len(descriptors) and at + 2 + descriptors[at + 1] <= len(descriptors):
        size = descriptors[at + 1]
        if descriptors[at] == LANGUAGE_TAG and size >= 3:
            found = descriptors[at + 2 : at + 5].decode("utf-8", "replace").rstrip("\0")
            if found not in ("", "und"):
                return found
        at += 2 + size
    return None


def _clip(path: str) -> bytes:
    found = clpi.clip_path(path) if path else None
    if found is None:
        return b""
    with open(found, "rb") as f:
        return f.read()


def tracks(reader: Reader, layout: Layout, clip: bytes | None = None) -> list[dict]:
    """One for each PGS stream of any programme; the clip's language where the map has none.

    ``clip`` is the clip information; by default that beside the file, if there is any.
    """
    out, beside = [], clpi.languages(_clip(reader.path) if clip is None else clip)
    for pmt in parse_pat(_section(reader, layout, 0, PAT_PACKETS, "PAT")):
        for kind, pid, language in parse_pmt(_section(reader, layout, pmt, PMT_PACKETS, "PMT")):
            if kind == PGS_STREAM:
                out.append({"track_id": pid, "language": language or beside.get(pid), "name": None, "is_default": None, "is_forced": None, "display_set_count": None, "indexed": None})
    return out


def pts_offset(reader: Reader, clip: bytes | None = None) -> int:
    """Where the clip's presentation starts; times count from there."""
    times = clpi.presentation_times(_clip(reader.path) if clip is None else clip)
    return times[0] if times else 0


def _aligned(data: np.ndarray, layout: Layout, most: int, syncs: int = 2) -> int | None:
    """The first place where ``syncs`` sync bytes stand a packet apart."""
    last = min(most, len(data) - layout.sync - (syncs - 1) * layout.size)
    if last <= 0:
        return None
    steps = (data[layout.sync + i * layout.size :][:last] == SYNC for i in range(syncs))
    hits = np.flatnonzero(np.logical_and.reduce(list(steps)))
    return int(hits[0]) if len(hits) else None


def _followed(reader: Reader, layout: Layout, begin: int) -> int:
    """Where to start following packets so that those from ``begin`` on are the ones of a scan of the whole file.

    That is the file's beginning, or a place LOOK_BACK before ``begin`` where five packets line
    up; whatever is found there, loss of sync before ``begin`` leads back to the file's packets.
    """
    if begin <= LOOK_BACK:
        return 0
    reader.seek(begin - LOOK_BACK)
    found = _aligned(np.frombuffer(reader.upto(LOOK_BACK), dtype=np.uint8), layout, LOOK_BACK, 5)
    return begin if found is None else begin - LOOK_BACK + found


def packets(reader: Reader, layout: Layout, pids: set[int], begin: int = 0, end: int | None = None) -> Iterator[tuple[int, int, bool, bytes]]:
    """(position, PID, whether a unit starts, payload) of the wanted packets that start in [begin, end).

    Blocks are tested as arrays. Where sync is lost it is searched for, at most RESYNC bytes
    on; if it isn't found, the scan ends.
    """
    end = reader.size if end is None else min(end, reader.size)
    wanted = np.zeros(1 << 13, dtype=bool)
    wanted[list(pids)] = True
    position = _followed(reader, layout, begin)
    while position < end:
        reader.seek(position)
        data = np.frombuffer(reader.upto(min(SCAN, max(layout.size, end - position + layout.size))), dtype=np.uint8)
        count = len(data) // layout.size
        if not count:
            return
        grid = data[: count * layout.size].reshape(count, layout.size)
        bad = np.flatnonzero(grid[:, layout.sync] != SYNC)
        good = int(bad[0]) if len(bad) else count
        first, upto = max(0, -(-(begin - position) // layout.size)), min(good, -(-(end - position) // layout.size))
        pid = (grid[first:upto, layout.sync + 1].astype(np.int32) & 0x1F) << 8 | grid[first:upto, layout.sync + 2]
        for i in (first + np.flatnonzero(wanted[pid])).tolist():
            try:
                own, starts, payload = packet_payload(grid[i, layout.sync : layout.sync + PACKET].tobytes())
            except InvalidTs:
                continue
            if payload:
                yield position + i * layout.size, own, starts, payload
        position += good * layout.size
        if good < count and position < end:
            reader.seek(position)
            found = _aligned(np.frombuffer(reader.upto(RESYNC + 2 * layout.size), dtype=np.uint8), layout, RESYNC)
            if found is None:
                return
            position += found


def pes_times(data: bytes) -> tuple[int, int, int] | None:
    """(pts, dts, where the payload begins) of a PES packet; None if it isn't one."""
    if len(data) < 9 or data[:3] != b"\0\0\1" or 9 + data[8] > len(data):
        return None
    flags, size = data[7] >> 6, data[8]

    def time(at: int) -> int:
        return (data[at] >> 1 & 7) << 30 | data[at + 1] << 22 | (data[at + 2] >> 1) << 15 | data[at + 3] << 7 | data[at + 4] >> 1

    return time(9) if flags >= 2 and size >= 5 else 0, time(14) if flags == 3 and size >= 10 else 0, 9 + size


def last_pts(reader: Reader, layout: Layout) -> int | None:
    """The last PES time of any PID in the last two megabytes."""
    begin, found = max(0, reader.size - SCAN), None
    for _, _, starts, payload in packets(reader, layout, set(range(1 << 13)), begin):
        if starts and (times := pes_times(payload)) is not None and payload[7] >> 6 >= 2:
            found = times[0]
    return found
