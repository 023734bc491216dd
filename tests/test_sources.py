"""Containers of the same content give the same display sets."""

import io
import json
import os

import pytest
from pyspark.sql import functions as F

from glyphstream import cli
from glyphstream.errors import EncodingError, InvalidEbml, InvalidPgs, InvalidVint, NoPgsTracks, PgsError, UnknownFormat
from glyphstream.functions import codec
from glyphstream.functions import columns as C
from glyphstream.operators import ndjson, recipes
from glyphstream.operators.extractor import Extractor, extract, list_tracks, track_path, write_sup, write_sup_tables
from glyphstream.plans import assemble as A
from glyphstream.plans import media as B
from glyphstream.sources import binary, clpi, mkv, scan, ts
from glyphstream.sources.detect import detect
from glyphstream.sources.reader import EndOfInput, Reader

ONE, TWO = B.movie_sets(12), B.movie_sets(9, first=135000)


@pytest.fixture(scope="module")
def media(tmp_path_factory):
    folder = tmp_path_factory.mktemp("media")
    stream = folder / "BDMV" / "STREAM"
    stream.mkdir(parents=True)
    (folder / "BDMV" / "CLIPINF").mkdir()
    kw = {"language": "eng", "name": "English", "default": 1, "forced": 0}
    files = {
        "a.sup": B.sup(ONE),
        "cues.mkv": B.matroska({3: (kw | {"compression": (0, b"")}, ONE), 5: ({"bcp47": "zho-Hans", "compression": (3, b"\x16\0")}, TWO)}),
        "plain.mkv": B.matroska({3: (kw, ONE)}, cues=False, tags=False),
        "clusters.mkv": B.matroska({3: (kw, ONE)}, relative=False),
        "unknown.mkv": B.matroska({3: (kw, ONE)}, cues=False, unknown=True),
        "a.m2ts": B.transport({0x1200: ("eng", ONE)}),
        "a.ts": B.transport({0x1200: (None, ONE), 0x1201: ("und", TWO)}, m2ts=False),
        "junk.ts": B.transport({0x1200: ("fre", ONE)}, m2ts=False, junk=b"x" * 777),
    }
    for name, data in files.items():
        (folder / name).write_bytes(data)
    (stream / "00001.m2ts").write_bytes(B.transport({0x1200: (None, ONE)}))
    (folder / "BDMV" / "CLIPINF" / "00001.clpi").write_bytes(B.clip_info({0x1200: "deu", 0x1201: "und"}, 45000, 90000000))
    return folder


def content(df, offset=0):
    rows = df.orderBy("track_id", "index").collect()
    return [(r["index"], r.pts + offset, [(s.segment_type, bytes(s.payload)) for s in r.segments]) for r in rows]


WANT = [(i, pts, parts) for i, (pts, parts) in enumerate(ONE)]


def test_every_container_has_the_same_sets(spark, media):
    for name, track in (("a.sup", 0), ("cues.mkv", 3), ("plain.mkv", 3), ("clusters.mkv", 3), ("unknown.mkv", 3), ("a.m2ts", 0x1200), ("a.ts", 0x1200)):
        opened = Extractor.open(spark, str(media / name), split_bytes=1500).with_tracks(track)
        assert content(opened.display_sets()) == WANT, name
        if name.endswith("mkv"):
            assert content(opened.with_strategy("sequential").display_sets()) == WANT, name
    assert content(Extractor.open(spark, str(media / "cues.mkv")).with_tracks(5).display_sets()) == [(i, p, s) for i, (p, s) in enumerate(TWO)]
    clip = Extractor.open(spark, str(media / "BDMV/STREAM/00001.m2ts"))
    assert content(clip.display_sets(), 45000) == WANT
    assert content(Extractor.open(spark, str(media / "junk.ts"), split_bytes=1999).display_sets()) == WANT


def test_splits_own_every_packet_once():
    """Clean streams and those with junk give the whole scan's packets in splits of any size."""
    for m2ts in (True, False):
        for junk in (None, b"x" * 77, b"x" * 777, b"G" * 400):
            data = B.transport({0x1200: ("eng", ONE), 0x1201: (None, TWO)}, m2ts=m2ts, junk=junk)
            reader = Reader(data)
            layout, pids = ts.detect_layout(reader), {0x1200, 0x1201, 0x1011}
            whole = list(ts.packets(reader, layout, pids))
            for split in range(1000, 6000, 97):
                parts = [p for a in range(0, len(data), split) for p in ts.packets(reader, layout, pids, a, a + split)]
                assert parts == whole, (m2ts, junk and len(junk), split)


def test_splits_far_into_a_file(monkeypatch):
    """Where a split doesn't begin near the file's, packets are found from a little before it."""
    monkeypatch.setattr(ts, "LOOK_BACK", 3000)
    data = B.transport({0x1200: ("eng", B.movie_sets(60))}, m2ts=False, junk=b"x" * 333)
    reader = Reader(data)
    layout, pids = ts.detect_layout(reader), {0x1200, 0x1011}
    whole = list(ts.packets(reader, layout, pids))
    for split in (1500, 2300, 4001, 9000):
        assert [p for a in range(0, len(data), split) for p in ts.packets(reader, layout, pids, a, a + split)] == whole


def test_tracks(spark, media):
    got = {r.file.rsplit("/", 1)[1]: r for r in list_tracks(spark, [str(media / n) for n in ("a.sup", "plain.mkv", "a.m2ts", "junk.ts")]).collect()}
    assert [(n, r.track_id, r.language, r.container) for n, r in sorted(got.items())] == [
        ("a.m2ts", 0x1200, "en", "M2TS"), ("a.sup", 0, None, "SUP"), ("junk.ts", 0x1200, "fr", "TransportStream"), ("plain.mkv", 3, "en", "Matroska"),
    ]
    two = list_tracks(spark, str(media / "cues.mkv")).orderBy("ordinal").collect()
    assert [(t.track_id, t.language, t.name, t.is_default, t.is_forced, t.display_set_count, t.indexed) for t in two] == [(3, "en", "English", True, False, 12, True), (5, "zh-Hans", None, None, None, 9, True)]
    assert got["plain.mkv"].indexed is False and got["plain.mkv"].display_set_count is None
    assert list_tracks(spark, str(media / "BDMV/STREAM/00001.m2ts")).first().language == "de"


def test_filters_reach_the_source(spark, media):
    path = str(media / "cues.mkv")
    opened = Extractor.open(spark, path)
    plan = opened.with_tracks(5)._only(opened._load("blocks"))
    assert opened.with_tracks(404).display_sets().count() == 0 and opened.with_tracks().display_sets().count() == 21
    assert {r.track_id for r in opened.with_tracks(5).blocks().collect()} == {5} and plan.columns
    ranged = opened.with_time_range(2000.0, 4000.0).with_tracks(3)
    assert [(r["index"], r.pts_ms) for r in ranged.display_sets().orderBy("index").collect()] == [(0, 2000.0), (1, 3000.0), (2, 4000.0)]
    assert opened.with_time_range(10**9, None).display_sets().count() == 0
    auto, whole = (opened.with_tracks(3).with_strategy(s).stats().first() for s in ("auto", "sequential"))
    assert auto.bytes_read < whole.bytes_read <= whole.file_size * 1.1 and auto.file_size == os.path.getsize(path)


def test_iteration_and_history(spark, media):
    opened = Extractor.open(spark, str(media / "cues.mkv"))
    rows = list(opened)
    assert [r.track_id for r in rows[:4]] == [3, 5, 3, 5] and len(opened.history) == 21 and len(opened.history_for_track(5)) == 9
    assert [r.pts for r in opened.take(2)] == [90000, 135000]
    assert len(opened.drain_history()) == 21 and opened.history == []
    grouped = opened.collect_by_track()
    assert [(t.track_id, len(s)) for t, s in grouped] == [(3, 12), (5, 9)]
    assert extract(spark, str(media / "cues.mkv")).select("track_id").distinct().collect()[0][0] == 3
    assert opened.bench()["tracks"][0][1].segments == sum(len(p) for _, p in ONE)


def test_broken_files(spark, tmp_path):
    cut = tmp_path / "cut.sup"
    cut.write_bytes(B.sup(ONE[:2]) + b"PG\0\0")
    opened = Extractor.open(spark, str(cut))
    assert opened.display_sets().count() == 2
    with pytest.raises(InvalidPgs):
        list(opened)
    with pytest.raises(UnknownFormat):
        detect(Reader(b"hello world"))
    with pytest.raises(EndOfInput):
        detect(Reader(b""))
    with pytest.raises(NoPgsTracks):
        mkv.read_movie(Reader(B.matroska({})))
    (tmp_path / "video.ts").write_bytes(B.transport({}, m2ts=False) * 2)
    assert list(scan.track_rows(Reader(str(tmp_path / "video.ts")), "x")) == []
    with pytest.raises(NoPgsTracks):
        Extractor.open(spark, str(tmp_path / "video.ts"))
    bad = B.matroska({3: ({"compression": (0, b"")}, ONE)}, cues=False)
    wrong = bad.replace(b"\x78\x9c", b"\0\0", 1)
    assert len(list(scan.block_rows(Reader(wrong), "x", scan.Wanted()))) == len(ONE) - 1
    with pytest.raises(InvalidEbml):
        mkv.read_movie(Reader(bad.replace(b"matroska", b"matroskb")))


def test_vints_and_packets():
    one = lambda data, longest=8, keep=False: mkv.vint(Reader(bytes.fromhex(data)), longest, keep)[0]
    assert (one("A3", 4, True), one("53AB", 4, True), one("18538067", 4, True)) == (0xA3, 0x53AB, 0x18538067)
    assert (one("85"), one("40C8"), one("FF"), one("81")) == (5, 200, mkv.UNKNOWN, 1)
    for bad in ("00", "08000000"):
        with pytest.raises(InvalidVint):
            one(bad, 4, True)
    assert ts.parse_pat(B.pat(0x100)[1:]) == [0x100]
    assert ts.parse_pmt(B.pmt([(0x90, 0x1200, "eng"), (0x1B, 0x1011, None), (0x90, 0x1201, "und")])[1:]) == [(0x90, 0x1200, "eng"), (0x1B, 0x1011, None), (0x90, 0x1201, None)]
    with pytest.raises(PgsError):
        ts.parse_pat(b"\1" * 20)
    assert ts.pes_times(B.pes(90000, b"x")) == (90000, 0, 14) and ts.pes_times(b"\0\0\2" + b"\0" * 9) is None
    assert ts.packet_payload(B.ts_packet(5, True, b"x" * 184)) == (5, True, b"x" * 184) and ts.packet_payload(B.ts_packet(5, False, b"ab"))[2] == b"ab"
    info = B.clip_info({0x1200: "eng", 0x1201: "und", 0x1202: "fra"}, 54000000, 594000000)
    assert clpi.languages(info) == {0x1200: "eng", 0x1202: "fra"} and clpi.presentation_times(info) == (54000000, 594000000)
    assert clpi.languages(b"x" * 60) == {} and clpi.presentation_times(info[:45]) is None
    data = B.transport({0x1200: (None, ONE)}, m2ts=False)
    assert ts.last_pts(Reader(data), ts.LAYOUTS[1]) == ONE[-1][0]


def test_files_that_only_spark_reads(spark, media):
    files = spark.read.format("binaryFile").load(str(media / "*.*"))
    blocks = binary.from_contents(files.filter("path like '%.sup' or path like '%plain.mkv'"), "blocks")
    sets = A.numbered(A.assemble(A.segments(blocks)))
    assert sets.groupBy("file").count().select("count").distinct().collect()[0][0] == len(ONE)
    packets = binary.from_contents(files.filter("path like '%a.m2ts'"), "packets")
    assert A.assemble(A.segments(A.reassemble_pes(packets))).count() == len(ONE)
    assert binary.from_contents(files.filter("path like '%a.ts'"), "tracks").count() == 2


def test_structured_and_json(spark, media):
    opened = Extractor.open(spark, str(media / "a.sup"))
    for raw in (False, True):
        sets = opened.structured(raw=raw)
        lines = [json.loads(r.value) for r in ndjson.to_json_lines(sets, raw=raw).orderBy("set_seq").collect()]
        first, clear = lines[0], lines[1]
        assert list(first)[:8] == ["type", "track_id", "index", "pts", "pts_ms", "composition", "windows", "palettes"] and first["pts_ms"] == 1000.0
        assert first["composition"]["objects"][0]["object_id"] == 7 and first["composition"]["objects"][0]["crop"] is None
        assert lines[3]["composition"]["objects"][0]["crop"] == {"x": 1, "y": 0, "width": 2, "height": 2}
        assert (first["objects"][0]["sequence"], first["objects"][0]["width"], first["objects"][0]["bitmap"]) == ("complete", 3, "AQICAAMD")
        assert clear["objects"] == clear["windows"] == clear["palettes"] == [] and clear["composition"]["state"] == "normal"
        assert ("payload" in first["windows"][0]) == ("payload" in first["composition"]) == ("payload" in first["objects"][0]) == raw
    header = json.loads(ndjson.tracks_line(opened.tracks()).first().value)
    assert header["type"] == "tracks" and header["tracks"][0]["container"] == "SUP" and header["tracks"][0]["language"] is None


def test_fragments_and_malformed_payloads(spark):
    big = bytes((i % 254) + 1 for i in range(1920 * 100))
    parts = B.display_set(0, pixels=big, width=1920, height=100)
    odd = [parts[0], ("WDS", b"\2\0"), ("PDS", b"\0"), ("ODS", b"\0"), ("ODS", b"\0\5\0\x40abc"), ("END", b"")]
    cut = [("PCS", parts[0][1][:11] + b"\0"), ("END", b"")]
    cut[0] = ("PCS", parts[0][1][:10] + b"\5" + parts[0][1][11:])
    data = B.sup([(90, parts), (180, odd), (270, cut)])
    files = spark.createDataFrame([("f", bytearray(data))], "path string, content binary")
    sets = A.numbered(A.assemble(A.segments(binary.from_contents(files, "blocks"))))
    rows = A.project(sets, raw=True).orderBy("set_seq").collect()
    assert rows[0].objects[0].sequence == "reassembled" and bytes(rows[0].objects[0].bitmap) == big and rows[0].objects[0].width == 1920
    assert rows[1].windows == rows[1].palettes == [] and [(o.id, o.sequence, o.width, o.bitmap) for o in rows[1].objects] == [(5, "last", None, None)]
    assert rows[2].composition.state is None and bytes(rows[2].composition.payload) == cut[0][1]
    lines = [json.loads(r.value) for r in ndjson.to_json_lines(A.project(sets)).orderBy("set_seq").collect()]
    assert lines[2]["composition"] is None and "width" not in lines[1]["objects"][0] and lines[1]["objects"][0]["bitmap"] is None
    raw = [json.loads(r.value) for r in ndjson.to_json_lines(A.project(sets, raw=True), raw=True).orderBy("set_seq").collect()]
    assert list(raw[2]["composition"]) == ["payload"]


def run(spark, *argv, source=""):
    out = io.StringIO()
    return cli.main(list(map(str, argv)), spark, out, io.StringIO(source)), out.getvalue()


def test_command_line(spark, media, tmp_path, capsys):
    code, text = run(spark, "tracks", media / "cues.mkv")
    assert code == 0 and '  Track 3: language=en, format=Matroska, name="English", default, display_sets=12, has_cues=true' in text
    assert run(spark, "extract", media / "a.sup", "-o", tmp_path / "same.sup")[0] == 0
    assert (tmp_path / "same.sup").read_bytes() == (media / "a.sup").read_bytes()
    run(spark, "extract", media / "cues.mkv", "-o", tmp_path / "out.sup", "--start", "0:02", "--end", "4")
    assert sorted(p.name for p in tmp_path.glob("out*")) == ["out_track3.sup", "out_track5.sup"] and track_path("a/b", 3) == "a/b_track3.sup"
    code, text = run(spark, "stream", media / "a.sup", "-t", "0,9")
    lines = text.splitlines()
    assert code == 0 and len(lines) == 13 and json.loads(lines[0])["type"] == "tracks" and '"pts_ms":1000.0000,' in lines[1]
    code, _ = run(spark, "encode", "-o", tmp_path / "again.sup", source=text)
    assert code == 0 and (tmp_path / "again.sup").read_bytes() == (media / "a.sup").read_bytes()
    assert "display sets" in run(spark, "bench", media / "a.sup")[1]
    assert run(spark, "encode", "-o", tmp_path / "none.sup", source="\n" + lines[0])[0] == 0 and not (tmp_path / "none.sup").exists()
    assert run(spark, "encode", "-o", tmp_path / "none.sup", source=lines[1] + '\n{"type":"display_set"}\n{}')[0] == 1
    assert "line 2: missing 'pts' or 'pts_ms'" in capsys.readouterr().err
    assert run(spark, "tracks", tmp_path / "missing")[0] == 1


def test_encode_lines(spark):
    good = json.loads('{"type":"display_set","pts_ms":1.5,"composition":{"state":"normal","video_width":70000,"video_height":-3,"number":1.9,"palette_only":false,"palette_id":0}}')
    assert ndjson.parse_line(json.dumps(good))["pts"] == 135 and ndjson.parse_line(json.dumps(good))["composition"]["video_width"] == 65535
    cases = {
        "missing 'type' field": {}, "'pts' is not a number": good | {"pts": None}, "missing 'pts' or 'pts_ms'": {"type": "display_set"}, "'pts_ms' is not a number": good | {"pts_ms": "1"},
        "missing field 'state'": good | {"composition": {}}, "unknown composition state 'x'": good | {"composition": {"state": "x"}}, "missing field 'y'": good | {"windows": [{"id": 1, "x": 1}]},
        "field 'id' is not a number": good | {"windows": [{"id": "1"}]}, "missing field 'entries'": good | {"palettes": [{}]}, "'entries' is not an array": good | {"palettes": [{"entries": 1}]},
        "object 1 has null bitmap, cannot encode": good | {"objects": [{"id": 1, "version": 0, "width": 1, "height": 1, "bitmap": None}]},
        "object 1 bitmap size mismatch: got 3 bytes, expected 1 (1x1)": good | {"objects": [{"id": 1, "version": 0, "width": 1, "height": 1, "bitmap": "AQID"}]},
    }
    for error, value in cases.items():
        assert ndjson.parse_line(json.dumps(value))["error"] == error
    kinds = [ndjson.parse_line(t)["kind"] for t in (" ", '{"type":"tracks"}', '{"type":"x"}', json.dumps(good | {"composition": None}), "[", json.dumps(good | {"windows": 3}))]
    assert kinds == ["blank", "tracks", "unknown", "skipped", "error", "set"]
    lines = spark.createDataFrame([(4, "x"), (2, "{}"), (1, json.dumps(good))], "line long, value string").repartition(3)
    with pytest.raises(EncodingError, match="line 2: missing 'type' field"):
        ndjson.raise_errors(ndjson.parse_lines(lines))


def test_recipes(spark, media, tmp_path):
    sets = Extractor.open(spark, str(media / "a.sup")).structured().persist()
    assert recipes.placements(sets).count() == 8 and recipes.clear_events(sets).count() == 4 and recipes.epoch_starts(sets).count() == 4
    assert recipes.visible_entries(sets).count() == 8 * 4
    row = recipes.summary(sets).first()
    assert (row.display_sets, row.n_pcs, row.n_end, row.first_pts, row.last_pts) == (12, 12, 12, 90000, 90000 * 12)
    assert recipes.resolved(sets).filter("object.id = 7 and window.id = 1 and palette.id = 0").count() == 8
    px = recipes.pixels(sets).filter("index = 0").orderBy("y", "x").collect()
    image = recipes.images(sets).filter("index = 0").first()
    assert [p.value for p in px] == [1, 2, 2, 0, 3, 3] and bytes(image.rgba) == bytes(v for p in px for v in p.rgba)
    assert {(r.value, r.pixels) for r in recipes.histogram(sets).filter("index = 0").collect()} == {(0, 1), (1, 1), (2, 2), (3, 2)}
    bright = recipes.brighten(sets, 100).orderBy("index").first().palettes[0].entries
    assert [e.luminance for e in bright] == [100, 140, 180, 220, 255]
    assert recipes.durations(sets).orderBy("index").first().ticks == 90000
    big = A.built_sets(recipes.enlarge(sets))
    out = write_sup(big, str(tmp_path / "big.sup"))
    again = Extractor.open(spark, out[0][0]).structured().orderBy("index").collect()
    assert out[0][1] == 12 and (again[0].objects[0].width, bytes(again[0].objects[0].bitmap)) == (6, b"\1\1\2\2\2\2" * 2 + b"\0\0\3\3\3\3" * 2)
    assert (again[0].palettes[0].entries[1].luminance, again[0].palettes[0].entries[1].cr) == (215, 120)
    dimmed = A.edit_payloads(sets, "PDS", lambda p: C.write_pds(C.pds(p).withField("version", F.lit(9).cast("short"))))
    assert {p.version for r in A.project(dimmed).collect() for p in r.palettes} == {9}
    write_sup_tables(sets, str(tmp_path / "tables"))
    assert b"".join(bytes(r.sup) for r in spark.read.parquet(str(tmp_path / "tables")).orderBy("set_seq").collect()) == (media / "a.sup").read_bytes()
    progress = recipes.progress(sets, Extractor.open(spark, str(media / "a.sup")).tracks().withColumn("display_set_count", F.lit(12)))
    assert progress.agg(F.max("progress")).first()[0] == 1.0


def test_live_assembly(spark, media, tmp_path):
    from glyphstream.streaming import live

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.sup").write_bytes((media / "a.sup").read_bytes())
    def drain():
        sets = live.assemble_stream(live.arriving_segments(spark, str(folder)))
        query = sets.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        try:
            assert query.awaitTermination(90)
        finally:
            query.stop()
        return spark.read.parquet(str(tmp_path / "out")).orderBy("file", "set_seq").collect()

    assert len(drain()) == 12
    (folder / "b.sup").write_bytes(B.sup(TWO))
    rows = drain()
    assert [(r["index"], r.pts, [(s.segment_type, bytes(s.payload)) for s in r.segments]) for r in rows[:12]] == WANT and len(rows) == 21


def test_set_cut_between_batches():
    from glyphstream.streaming.live import _push
    import pandas as pd

    class State:
        exists, hasTimedOut, get = False, False, None

        def update(self, value):
            self.exists, self.get = True, value

        def setTimeoutDuration(self, _):
            pass

    state, parts = State(), [("f", 0, i, 90, 0, k, p) for i, (k, p) in enumerate(B.display_set(0) + B.display_set(1, "normal"))]
    names = ["file", "track_id", "seg_seq", "pts", "dts", "segment_type", "payload"]
    out = [row for p in parts for frame in _push(("f", 0), iter([pd.DataFrame([p], columns=names)]), state) for row in frame.itertuples()]
    assert [(r.index, len(r.segments)) for r in [type("R", (), {"index": o[4], "segments": o[8]}) for o in out]] == [(0, 5), (1, 2)]
    assert codec.state_of(out[0][8][0]["payload"]) == "epoch_start"


def test_matroska_scans_clusters_where_no_cue_is_left(media):
    reader = Reader((media / "cues.mkv").read_bytes())
    movie = mkv.read_movie(reader)
    every = list(mkv.blocks(reader, movie, strategy="sequential"))
    cue = min(movie.cues)
    movie.cues = [cue]
    low, half = movie.pts(cue.time) + 1, every[len(every) // 2][0]
    assert [b[:3] for b in mkv.blocks(reader, movie, times=(None, low))] == [every[0][:3]]
    assert list(mkv.blocks(reader, movie, times=(low, None))) == every
    # Splits agree: a cue that lies in another split still is one.
    parts = [list(mkv.blocks(reader, movie, begin=a, end=b, times=(low, None))) for a, b in ((0, half), (half, None))]
    assert sorted(x for part in parts for x in part) == sorted(every)
    assert list(mkv.blocks(reader, movie, begin=cue.cluster + 1)) == []
