"""Matroska: tracks, cues, tags, clusters and blocks."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..errors import InvalidEbml, InvalidMkv, InvalidVint, NoPgsTracks, PgsError
from ..functions.columns import inflated
from .reader import Reader

# Element ids of the format.
EBML, SEGMENT, DOC_TYPE = 0x1A45DFA3, 0x18538067, 0x4282
SEEK_HEAD, INFO, TRACKS, CUES, CLUSTER, TAGS = 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1C53BB6B, 0x1F43B675, 0x1254C367
SEEK, SEEK_ID, SEEK_POSITION = 0x4DBB, 0x53AB, 0x53AC
TIMESTAMP_SCALE, DURATION = 0x2AD7B1, 0x4489
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, TRACK_NAME = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x536E
FLAG_DEFAULT, FLAG_FORCED, LANGUAGE, LANGUAGE_BCP47 = 0x88, 0x55AA, 0x22B59C, 0x22B59D
ENCODINGS, ENCODING, COMPRESSION, COMP_ALGO, COMP_SETTINGS = 0x6D80, 0x6240, 0x5034, 0x4254, 0x4255
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
TAG, TARGETS, TAG_UID, SIMPLE_TAG, TAG_NAME, TAG_STRING = 0x7373, 0x63C0, 0x63C5, 0x67C8, 0x45A3, 0x4487
SUBTITLE, PGS_CODEC, FRAMES = 0x11, "S_HDMV/PGS", "NUMBER_OF_FRAMES"
UNKNOWN = (1 << 64) - 1


def vint(reader: Reader, longest: int, keep_marker: bool) -> tuple[int, int]:
    """(value, bytes) of a variable-length integer; a size of all ones is UNKNOWN."""
    first = reader.uint(1)
    size = 9 - first.bit_length()
    if not first or size > longest:
        raise InvalidVint(f"first byte 0x{first:02X} at {reader.position - 1}")
    value = first << 8 * (size - 1) | (reader.uint(size - 1) if size > 1 else 0)
    if keep_marker:
        return value, size
    value &= (1 << 7 * size) - 1
    return (UNKNOWN if value == (1 << 7 * size) - 1 else value), size


def element(reader: Reader) -> tuple[int, int]:
    """(id, size) of the element that begins here."""
    return vint(reader, 4, True)[0], vint(reader, 8, False)[0]


def children(reader: Reader, size: int) -> Iterator[tuple[int, int]]:
    """(id, size) of each child; what the caller leaves unread is skipped."""
    end = reader.position + size
    while reader.position < end:
        kind, own = element(reader)
        after = reader.position + own
        yield kind, own
        reader.seek(after)


def text(reader: Reader, size: int) -> str:
    return reader.exact(size).decode("utf-8", "replace").rstrip("\0")


@dataclass
class Track:
    number: int
    uid: int | None
    language: str | None
    name: str | None
    is_default: bool | None
    is_forced: bool | None
    algorithm: int | None = None  # 0: zlib, 3: header stripping, else none
    prefix: bytes = b""

    def decode(self, data: bytes) -> bytes | None:
        """The block's data, None if it can't be decompressed."""
        return inflated(data) if self.algorithm == 0 else self.prefix + data if self.algorithm == 3 else data


@dataclass(frozen=True, order=True)
class Cue:
    cluster: int
    relative: int  # in the cluster's data, -1 if not given
    time: int
    track: int


@dataclass
class Movie:
    data_begin: int
    data_end: int
    tracks: list[Track]
    scale: int = 1_000_000
    duration: float | None = None
    cues: list[Cue] = field(default_factory=list)
    frames: dict[int, int] = field(default_factory=dict)
    first_cluster: int | None = None

    def pts(self, time: int) -> int:
        return max(0, time * self.scale * 9 // 100000)

    def infos(self) -> list[dict]:
        indexed = {c.track for c in self.cues}
        return [
            {"track_id": t.number & 0xFFFFFFFF, "language": t.language, "name": t.name, "is_default": t.is_default, "is_forced": t.is_forced, "display_set_count": self.frames.get(t.uid), "indexed": t.number in indexed}
            for t in self.tracks
        ]


def _compression(reader: Reader, size: int) -> tuple[int, bytes] | None:
    """The first encoding that is a compression: (algorithm, settings)."""
    for kind, own in children(reader, size):
        if kind == ENCODING:
            for inner, inner_size in children(reader, own):
                if inner == COMPRESSION:
                    algorithm, settings = 0, b""
                    for leaf, leaf_size in children(reader, inner_size):
                        if leaf == COMP_ALGO:
                            algorithm = reader.uint(leaf_size)
                        elif leaf == COMP_SETTINGS:
                            settings = reader.exact(leaf_size)
                    if algorithm in (0, 3):
                        return algorithm, settings
                    break
    return None


def _track(reader: Reader, size: int) -> Track | None:
    values: dict[int, object] = {}
    for kind, own in children(reader, size):
        if kind in (TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_DEFAULT, FLAG_FORCED):
            values[kind] = reader.uint(own)
        elif kind in (CODEC_ID, TRACK_NAME):
            values[kind] = text(reader, own)
        elif kind in (LANGUAGE, LANGUAGE_BCP47):
            values[LANGUAGE] = text(reader, own)  # the last of both
        elif kind == ENCODINGS:
            values[ENCODINGS] = _compression(reader, own)
    if values.get(TRACK_TYPE) != SUBTITLE or values.get(CODEC_ID) != PGS_CODEC:
        return None
    if TRACK_NUMBER not in values:
        raise InvalidMkv("a PGS track has no number")
    language = values.get(LANGUAGE)
    flag = lambda k: values[k] == 1 if k in values else None
    algorithm, prefix = values.get(ENCODINGS) or (None, b"")
    return Track(values[TRACK_NUMBER], values.get(TRACK_UID), None if language == "und" else language, values.get(TRACK_NAME), flag(FLAG_DEFAULT), flag(FLAG_FORCED), algorithm, prefix)


def _cues(reader: Reader, size: int, begin: int, numbers: set[int]) -> list[Cue]:
    out = []
    for kind, own in children(reader, size):
        if kind != CUE_POINT:
            continue
        time, found = 0, []
        for inner, inner_size in children(reader, own):
            if inner == CUE_TIME:
                time = reader.uint(inner_size)
            elif inner == CUE_POSITIONS:
                values = {CUE_TRACK: 0, CUE_CLUSTER: 0, CUE_RELATIVE: -1}
                for leaf, leaf_size in children(reader, inner_size):
                    if leaf in values:
                        values[leaf] = reader.uint(leaf_size)
                found.append(values)
        out += [Cue(begin + v[CUE_CLUSTER], v[CUE_RELATIVE], time, v[CUE_TRACK]) for v in found if v[CUE_TRACK] in numbers]
    return out


def _frames(reader: Reader, size: int, uids: set[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for kind, own in children(reader, size):
        if kind != TAG:
            continue
        targets, count = [], None
        for inner, inner_size in children(reader, own):
            if inner == TARGETS:
                targets += [reader.uint(n) for leaf, n in children(reader, inner_size) if leaf == TAG_UID]
            elif inner == SIMPLE_TAG:
                pair = {leaf: text(reader, n) for leaf, n in children(reader, inner_size) if leaf in (TAG_NAME, TAG_STRING)}
                value = pair.get(TAG_STRING, "")
                if pair.get(TAG_NAME) == FRAMES and value.isascii() and value.isdigit():
                    count = int(value)
        out |= {uid: count for uid in targets if count is not None and uid in uids}
    return out


def read_movie(reader: Reader) -> Movie:
    """What stands outside of the clusters; an error without tracks, or without PGS tracks."""
    reader.seek(0)
    kind, size = element(reader)
    if kind != EBML:
        raise InvalidEbml(f"EBML header expected, found 0x{kind:X}")
    kinds = [text(reader, own) for child, own in children(reader, size) if child == DOC_TYPE]
    if not kinds or kinds[-1] not in ("matroska", "webm"):
        raise InvalidEbml(f"unsupported document type {kinds[-1:]}")
    kind, size = element(reader)
    if kind != SEGMENT:
        raise InvalidMkv("no Segment after the EBML header")
    begin = reader.position
    end = reader.size if size == UNKNOWN else min(reader.size, begin + size)
    places, first = {}, None
    while reader.position < end:
        at = reader.position
        try:
            kind, size = element(reader)
        except PgsError:
            break
        if kind == CLUSTER:
            first = at
            break
        if kind in (INFO, TRACKS, CUES, TAGS):
            places.setdefault(kind, at)
        if size == UNKNOWN:
            break
        after = reader.position + size
        if kind == SEEK_HEAD:
            for child, own in children(reader, size):
                if child == SEEK:
                    values = {leaf: reader.uint(n) for leaf, n in children(reader, own) if leaf in (SEEK_ID, SEEK_POSITION)}
                    if {SEEK_ID, SEEK_POSITION} <= values.keys():
                        places.setdefault(values[SEEK_ID], begin + values[SEEK_POSITION])
        reader.seek(after)

    def inside(wanted: int) -> int | None:
        if wanted not in places:
            return None
        reader.seek(places[wanted])
        kind, size = element(reader)
        return size if kind == wanted else None

    size = inside(TRACKS)
    if size is None:
        raise InvalidMkv("Tracks element not found")
    found = [t for kind, own in children(reader, size) if kind == TRACK_ENTRY and (t := _track(reader, own)) is not None]
    if not found:
        raise NoPgsTracks(reader.path)
    movie = Movie(begin, end, found, first_cluster=first)
    if (size := inside(INFO)) is not None:
        for kind, own in children(reader, size):
            if kind == TIMESTAMP_SCALE:
                movie.scale = reader.uint(own)
            elif kind == DURATION and own in (4, 8):
                (movie.duration,) = struct.unpack(">f" if own == 4 else ">d", reader.exact(own))
    if (size := inside(CUES)) is not None:
        movie.cues = _cues(reader, size, begin, {t.number for t in found})
    uids = {t.uid for t in found if t.uid is not None}
    if uids and TAGS in places:
        try:
            if (size := inside(TAGS)) is not None:
                movie.frames = _frames(reader, size, uids)
        except PgsError:
            movie.frames = {}
    return movie


def _block(reader: Reader, size: int, wanted: dict[int, Track], drain: bool) -> tuple[Track, int, bytes] | None:
    """(track, relative time, data as stored) of a block of a wanted track."""
    end = reader.position + size
    number, _ = vint(reader, 8, False)
    track = wanted.get(number)
    if track is None:
        if drain:
            reader.exact(max(0, end - reader.position))
        return None
    (relative,) = struct.unpack(">h", reader.exact(2))
    reader.skip(1)
    return track, relative, reader.exact(end - reader.position)


def cluster_blocks(reader: Reader, position: int, wanted: dict[int, Track], drain: bool = False) -> Iterator[tuple[int, Track, int, bytes]]:
    """(position, track, time, data as stored) of a cluster's wanted blocks; bad EBML ends the cluster."""
    reader.seek(position)
    kind, size = element(reader)
    if kind != CLUSTER:
        return
    end = reader.size if size == UNKNOWN else min(reader.size, reader.position + size)
    time = 0
    try:
        while reader.position < end:
            at = reader.position
            kind, own = element(reader)
            if size == UNKNOWN and kind in (CLUSTER, CUES, TAGS, INFO, TRACKS, SEEK_HEAD):
                return
            after = reader.position + own
            if kind == TIMESTAMP:
                time = reader.uint(own)
            elif kind == SIMPLE_BLOCK:
                if (found := _block(reader, own, wanted, drain)) is not None:
                    yield at, found[0], time + found[1], found[2]
            elif kind == BLOCK_GROUP:
                for child, child_size in children(reader, own):
                    if child == BLOCK and (found := _block(reader, child_size, wanted, drain)) is not None:
                        yield at, found[0], time + found[1], found[2]
            elif drain:
                reader.exact(own)
            reader.seek(after)
    except PgsError:
        return


def clusters(reader: Reader, movie: Movie, begin: int, end: int) -> Iterator[int]:
    """Positions of the clusters that start in [begin, end); only element headers are read."""
    position = movie.first_cluster if movie.first_cluster is not None else movie.data_begin
    while position < min(end, movie.data_end):
        reader.seek(position)
        try:
            kind, size = element(reader)
        except PgsError:
            return
        if size == UNKNOWN and kind != CLUSTER:
            return
        after = _unknown_end(reader, movie.data_end) if size == UNKNOWN else reader.position + size
        if kind == CLUSTER and position >= begin:
            yield position
        position = after


def _unknown_end(reader: Reader, end: int) -> int:
    while reader.position < end:
        at = reader.position
        try:
            kind, size = element(reader)
        except PgsError:
            return end
        if kind in (CLUSTER, CUES, TAGS, INFO, TRACKS, SEEK_HEAD):
            return at
        reader.skip(size)
    return end


def cue_blocks(reader: Reader, movie: Movie, cues: list[Cue], wanted: dict[int, Track]) -> Iterator[tuple[int, Track, int, bytes]]:
    """The blocks that cues point to, each once, with the cue's time; whole clusters for cues without a place."""
    seen_blocks, scanned, data_at = set(), set(), {}
    for cue in sorted(cues):
        if cue.cluster in scanned:
            continue
        if cue.relative < 0:
            scanned.add(cue.cluster)
            for at, track, time, data in cluster_blocks(reader, cue.cluster, wanted):
                if at not in seen_blocks:
                    seen_blocks.add(at)
                    yield at, track, time, data
            continue
        try:
            if cue.cluster not in data_at:
                reader.seek(cue.cluster)
                kind, _ = element(reader)
                data_at[cue.cluster] = reader.position if kind == CLUSTER else None
            if data_at[cue.cluster] is None:
                continue
            at = data_at[cue.cluster] + cue.relative
            if at in seen_blocks:
                continue
            reader.seek(at)
            kind, size = element(reader)
            found = None
            if kind == SIMPLE_BLOCK:
                found = _block(reader, size, wanted, False)
            elif kind == BLOCK_GROUP:
                for child, own in children(reader, size):
                    if child == BLOCK:
                        found = _block(reader, own, wanted, False)
                        break
        except PgsError:
            continue
        if found is not None:
            seen_blocks.add(at)
            yield at, found[0], cue.time, found[2]


def blocks(reader: Reader, movie: Movie, numbers: set[int] | None = None, begin: int = 0, end: int | None = None, strategy: str = "auto", times: tuple[int | None, int | None] = (None, None)) -> Iterator[tuple[int, int, int, bytes]]:
    """(position, track, pts, decoded data) of PGS blocks whose cluster starts in [begin, end).

    With ``auto`` and cues for the wanted tracks, only what they point to is read, within
    ``times`` (ticks); otherwise, or where no cue is left, every cluster is. Blocks that can't be inflated are left out.
    """
    wanted = {t.number: t for t in movie.tracks if numbers is None or t.number & 0xFFFFFFFF in numbers}
    end = reader.size if end is None else end
    cues = [c for c in movie.cues if c.track in wanted] if strategy == "auto" else []
    low, high = times
    cues = [c for c in cues if (low is None or movie.pts(c.time) >= low) and (high is None or movie.pts(c.time) <= high)]
    if cues:
        found = cue_blocks(reader, movie, [c for c in cues if begin <= c.cluster < end], wanted)
    else:
        found = (b for p in clusters(reader, movie, begin, end) for b in cluster_blocks(reader, p, wanted, strategy == "sequential"))
    for at, track, time, data in found:
        plain = track.decode(data)
        if plain is not None:
            yield at, track.number & 0xFFFFFFFF, movie.pts(time), plain
