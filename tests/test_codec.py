"""Fixed vectors of the format, and the Spark columns against the decoders."""

import itertools
import os
import random
import timeit

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphstream.errors import EncodingError, InvalidPgs
from glyphstream.functions import codec
from glyphstream.functions import columns as C
from glyphstream.functions.language import language_table, normalize_language
from glyphstream.operators import ndjson
from glyphstream.sources.mkv import Movie


def test_segment_header():
    data = bytes.fromhex("5047 0004C11C 00000000 80 0000")
    assert codec.parse_segment(data) == (311580, 0, "END", b"", 13)
    assert codec.write_segment(311580, 0, "END", b"") == data
    assert codec.write_segment((1 << 33) - 1, 0, "END", b"")[2:6] == b"\xff" * 4
    for bad in (data[:12], b"XX" + data[2:], data[:10] + b"\x99" + data[11:], data[:11] + b"\0\5"):
        with pytest.raises(InvalidPgs):
            codec.parse_segment(bad)


def test_raw_and_headed_blocks():
    raw = b"\x80\0\0" + b"\x99\0\1x" + b"\x17\0\1\0" + b"\x16\0\5ab"
    assert list(codec.split_block(raw, 7, 8)) == [(7, 8, "END", b""), (7, 8, "WDS", b"\0")]
    headed = codec.write_segment(1, 2, "END", b"") + b"PG junk"
    assert list(codec.split_block(headed, 7, 8)) == [(1, 2, "END", b"")]


PCS = bytes.fromhex("0780 0438 10 0001 80 00 00 00")


def test_pcs_vectors():
    c = codec.parse_pcs(PCS)
    assert (c["video_width"], c["video_height"], c["number"], c["state"], c["objects"]) == (1920, 1080, 1, "epoch_start", [])
    one = codec.parse_pcs(PCS[:-1] + bytes.fromhex("01 0000 00 00 0305 006C"))
    assert one["objects"] == [{"object_id": 0, "window_id": 0, "x": 773, "y": 108, "crop": None}]
    crop = codec.parse_pcs(PCS[:-1] + bytes.fromhex("01 0000 00 80 0305 006C 000A 0014 0050 0028"))
    assert crop["objects"][0]["crop"] == {"x": 10, "y": 20, "width": 80, "height": 40}
    flag = codec.parse_pcs(PCS[:8] + b"\x80\3\0")
    assert flag["palette_only"] and flag["palette_id"] == 3
    assert codec.parse_pcs(PCS[:10]) is None and codec.parse_pcs(PCS[:7] + b"\x33" + PCS[8:]) is None and codec.parse_pcs(PCS[:-1] + b"\1\0") is None
    for c in (one, crop, flag):
        assert codec.parse_pcs(codec.write_pcs(c)) == c


def test_wds_pds_ods_vectors():
    two = bytes.fromhex("02 00 0305 006C 0179 002B 01 02E3 03A0 01D8 002B")
    assert [tuple(w.values()) for w in codec.parse_wds(two)] == [(0, 773, 108, 377, 43), (1, 739, 928, 472, 43)]
    assert codec.write_wds(codec.parse_wds(two)) == two and codec.parse_wds(b"\0") == [] and codec.parse_wds(two[:-1]) is None and codec.parse_wds(b"") is None
    three = bytes.fromhex("0000 00 10 80 80 00 01 EB 80 80 FF 02 10 80 80 FF")
    assert len(codec.parse_pds(three)["entries"]) == 3 and codec.parse_pds(b"\0\0")["entries"] == [] and codec.parse_pds(b"\0\0abc") is None
    assert codec.write_pds(codec.parse_pds(three)) == three
    whole = bytes.fromhex("0000 00 C0 0021BB 0179 002B 01 02")
    o = codec.parse_ods(whole)
    assert (o["width"], o["height"], o["data_length"], o["rle"]) == (377, 43, 8635, b"\1\2") and codec.write_ods(o) == whole
    rest = codec.parse_ods(bytes.fromhex("0001 00 00 0102"))
    assert (rest["sequence"], rest["width"], rest["data_length"], rest["rle"]) == ("continuation", None, 0, b"\1\2")
    assert codec.parse_ods(b"\0\0\0\x20") is None and codec.parse_ods(whole[:10]) is None and codec.parse_ods(b"\0\0\0\x40")["sequence"] == "last"


def test_rle_vectors():
    h = bytes.fromhex
    assert codec.decode_rle(h("01 02 0000 03 04 05 06"), 4, 2) == bytes([1, 2, 0, 0, 3, 4, 5, 6])
    assert codec.decode_rle(h("0A 0002 0000 008314"), 3, 2) == bytes([10, 0, 0, 20, 20, 20])
    assert [codec.decode_rle(h(x), 9, 9) for x in ("0041", "0083", "00C100")] == [None] * 3
    assert codec.decode_rle(h("00FFFF2A"), 16383, 1) == bytes([42]) * 16383
    assert codec.decode_rle(b"", 0, 5) == b"" and codec.decode_rle(b"\1\0", 2, 1) == b"\1\0" and codec.decode_rle(b"\1" * 9, 2, 2) == b"\1" * 4
    assert codec.encode_rle(b"\5\5", 2, 1) == h("05 05 00 00") and codec.encode_rle(b"\5", 2, 1) is None
    for pixels, w, k in ((b"\0" * 20000, 20000, 1), (b"\x63" * 20000, 20000, 1), (b"\0" * 64, 64, 1), (b"\x2a" * 16383, 16383, 1)):
        assert codec.decode_rle(codec.encode_rle(pixels, w, k), w, k) == pixels


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 70), st.integers(1, 6), st.integers(0, 2**32))
def test_rle_round_trip(width, height, seed):
    rng = np.random.default_rng(seed)
    pixels = np.repeat(rng.integers(0, 4, width * height), rng.integers(1, 70, width * height))[: width * height].astype(np.uint8).tobytes()
    assert codec.decode_rle(codec.encode_rle(pixels, width, height), width, height) == pixels


def test_fragments():
    pixels = bytes((i % 254) + 1 for i in range(1920 * 200))
    parts = codec.build_display_set(codec.parse_pcs(PCS), None, [], [{"id": 1, "version": 0, "width": 1920, "height": 200, "pixels": pixels}])
    objects = [codec.parse_ods(p) for k, p in parts if k == "ODS"]
    assert [o["sequence"] for o in objects] == ["first", *["continuation"] * (len(objects) - 2), "last"] and all(len(p) <= 65535 for _, p in parts)
    assert codec.decode_rle(b"".join(o["rle"] for o in objects), 1920, 200) == pixels
    with pytest.raises(EncodingError):
        codec.build_display_set(None)


def test_assembler():
    a = codec.Assembler()
    assert a.push(1, 0, "END", b"") is None
    for kind in ("PCS", "WDS", "PDS", "ODS"):
        assert a.push(1, 0, kind, PCS) is None
    assert len(a.push(1, 0, "END", b"")) == 5
    a.push(1, 0, "PCS", PCS)
    a.push(1, 0, "WDS", b"")
    a.push(2, 0, "PCS", PCS)
    assert [s[0] for s in a.push(2, 0, "END", b"")] == [2, 2]
    a.push(3, 0, "PCS", PCS[:7] + b"\1")
    assert a.push(3, 0, "END", b"") is None


def test_texts():
    assert [codec.parse_timestamp(t) for t in ("90", "1:30", "1:30:00.5", "x", "1:2:3:4", "1.5:30")] == [90000.0, 90000.0, 5400500.0, None, None, 120000.0]
    assert codec.parse_track_ids("3, 5,x,-1") == [3, 5] and codec.align_to_packet(189, 188) == 376
    assert C.decode_base64("AQID") == b"\1\2\3" and C.decode_base64("AQ=") == b"\1" and C.decode_base64("A!") is None and C.decode_base64("AQIDB") == b"\1\2\3\4"


@pytest.fixture(scope="module")
def payloads():
    rng = np.random.default_rng(1)
    out = [b"", b"\0", PCS, PCS[:9], bytes.fromhex("02 00 0305 006C 0179 002B 01 02E3 03A0 01D8 002B"), b"\0\0", bytes.fromhex("0000 00 C0 0021BB 0179 002B 01 02"), bytes.fromhex("0001 07 40 0102"), b"\xff" * 30]
    return out + [rng.integers(0, 256, rng.integers(0, 40), dtype=np.uint8).tobytes() for _ in range(60)] + [os.urandom(0)]


def plain(value):
    return {k: plain(v) for k, v in value.asDict().items()} if hasattr(value, "asDict") else [plain(v) for v in value] if isinstance(value, list) else bytes(value) if isinstance(value, bytearray) else value


def test_columns_as_decoders(spark, payloads):
    df = spark.createDataFrame([(p,) for p in payloads], "p binary")
    rows = df.select("p", C.wds(F.col("p")).alias("wds"), C.pds(F.col("p")).alias("pds"), C.ods(F.col("p")).alias("ods"), C.state(F.col("p")).alias("state"), C.pcs(F.col("p")).alias("pcs")).collect()
    for r in rows:
        p = bytes(r.p)
        assert plain(r.wds) == codec.parse_wds(p) and plain(r.pds) == codec.parse_pds(p), p
        assert plain(r.ods) == codec.parse_ods(p) and r.state == codec.state_of(p) and plain(r.pcs) == codec.parse_pcs(p), p
    again = df.select("p", C.pcs(F.col("p")).alias("pcs"), C.wds(F.col("p")).alias("wds"), C.pds(F.col("p")).alias("pds"), C.ods(F.col("p")).alias("ods"))
    written = again.select("*", C.write_pcs(F.col("pcs")).alias("a"), C.write_wds(F.col("wds")).alias("b"), C.write_pds(F.col("pds")).alias("c"), C.write_ods(F.col("ods")).alias("d"), C.sup_bytes(F.lit(5), F.lit(6), F.lit("ODS"), F.col("p")).alias("e"))
    for r in written.collect():
        for got, value, write in ((r.a, r.pcs, codec.write_pcs), (r.b, r.wds, codec.write_wds), (r.c, r.pds, codec.write_pds), (r.d, r.ods, codec.write_ods)):
            assert (bytes(got) if got is not None else None) == (write(plain(value)) if value is not None else None)
        assert bytes(r.e) == codec.write_segment(5, 6, "ODS", bytes(r.p))


def test_scalar_columns(spark):
    one = spark.range(1)
    got = one.select(
        C.pes_time(F.unhex(F.lit("210005BF21"))), C.pes_time(F.unhex(F.lit("0FFFFFFFFF"))),
        C.minus_offset(F.lit(5), F.lit(9)), C.base64(F.lit(b"a" * 100)), C.pts_ms(F.lit(311580)),
    ).first()
    assert got[:3] == (90000, 8589934591, 0)
    assert "\n" not in got[3] and len(got[3]) == 136 and got[4] == 3462.0
    assert Movie(0, 0, []).pts(1000) == 90000 and Movie(0, 0, []).pts(-5) == 0
    assert [codec.parse_timestamp(t) for t in ("1:30:00.5", "1:2:3:4", "a")] == [5400500.0, None, None]
    assert [ndjson.whole_number(v, 255) for v in (300.9, -1.0, 7.9)] == [255, 0, 7]
    assert codec.encode_rle(b"", 0, 3) == b""
    rgb = one.select(C.rgba(F.struct(*[F.lit(v).alias(n) for n, v in (("luminance", 235), ("cr", 255), ("cb", 0), ("alpha", 9))]))).first()[0]
    assert tuple(rgb) == (255, 188, 8, 9)


def test_languages(spark):
    codes = {"eng": "en", "chi": "zh", "zho-Hans": "zh-Hans", "qaa": "qaa", "ENG": "en", "en": "en", "fre-CA": "fr-CA", "hbs": "sh", "": ""}
    rows = spark.createDataFrame([(c,) for c in codes], "c string").select("c", normalize_language(F.col("c"), spark).alias("n")).collect()
    assert {r.c: r.n for r in rows} == codes
    table = language_table(spark)
    assert len(table) == 202 or 200 <= len(table) <= 206, len(table)
    assert table["deu"] == "de" and table["heb"] == "he" and table["ind"] == "id" and table["yid"] == "yi" and table["nob"] == "nb" and "bih" not in table


def test_public_names():
    import glyphstream

    assert all(getattr(glyphstream, name) is not None for name in glyphstream.__all__)
    with pytest.raises(AttributeError):
        glyphstream.nothing


def plain_rle(pixels, width):
    """Run by run, as the format says."""
    out = b""
    for at in range(0, len(pixels), width):
        for colour, run in ((c, len(list(g))) for c, g in itertools.groupby(pixels[at : at + width])):
            while run:
                part = min(run, 16383)
                run -= part
                if colour and part <= 2:
                    out += bytes([colour]) * part
                else:
                    mark = (0x80 if colour else 0) | (0x40 if part > 63 else 0)
                    out += bytes([0, mark | part >> 8, part & 0xFF] if part > 63 else [0, mark | part]) + bytes([colour] if colour else [])
        out += b"\0\0"
    return out


@pytest.mark.parametrize("width", [1, 2, 7, 64, 251, 16384, 40000])
def test_rle_run_by_run(width):
    rng = random.Random(width)
    for stay in (0.0, 0.5, 0.9, 1.0):
        pixels = bytearray()
        while len(pixels) < 3 * width:
            pixels.append(pixels[-1] if pixels and rng.random() < stay else rng.randrange(4))
        assert codec.encode_rle(bytes(pixels), width, 3) == plain_rle(bytes(pixels), width)


def test_rle_time_without_runs():
    """Bitmaps without runs are copied, not walked pixel by pixel."""
    pixels = bytes(1 + i % 3 for i in range(251)) * 1299
    rle = codec.encode_rle(pixels, 251, 1299)
    walk = min(timeit.repeat(lambda: [v + 1 for v in pixels if v], number=1, repeat=5))
    assert min(timeit.repeat(lambda: codec.encode_rle(pixels, 251, 1299), number=1, repeat=5)) < 6 * walk
    assert min(timeit.repeat(lambda: codec.decode_rle(rle, 251, 1299), number=1, repeat=5)) < 3 * walk
