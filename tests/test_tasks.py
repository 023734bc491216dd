"""Into how many tasks the data source cuts files, and that tasks read what their ranges hold."""

import duckdb
import pytest

from glyphstream.plans import containers
from glyphstream.plans import media as B
from glyphstream.sources import datasource

SETS = B.movie_sets(40)


def reader(folder, table, split):
    return datasource.PgsReader(datasource.TABLES[table], {"path": str(folder), "table": table, "split_bytes": str(split)})


def ranges(folder, split):
    """What every range of the files is, in order."""
    files = sorted(folder.iterdir())
    return [(str(f), a, min(f.stat().st_size, a + split)) for f in files for a in range(0, f.stat().st_size, split)]


def rows(source, *partitions):
    return [r for p in partitions for b in source.read(p) for r in b.to_pylist()]


def make(folder, extension, data, count=150):
    for i in range(count):
        (folder / f"{i:03}.{extension}").write_bytes(data)


def checked(folder, table, split):
    """Few tasks for many ranges, none left out or joined, and each read as if it were alone."""
    source, want = reader(folder, table, split), ranges(folder, split)
    found = source.partitions()
    assert [i for p in found for i in p.items] == want and len(want) > 2 * datasource.TASKS >= 2 * len(found)
    got = rows(source, *found)
    assert got == rows(source, *(datasource.Ranges((i,)) for i in want))
    return got


@pytest.mark.parametrize("cues", [True, False])
def test_matroska_ranges_share_tasks(tmp_path, cues):
    make(tmp_path, "mkv", B.matroska({3: ({"language": "eng"}, SETS)}, cues=cues), 40)
    assert len(checked(tmp_path, "blocks", 2_000)) == 40 * len(SETS)


def test_m2ts_ranges_share_tasks(tmp_path):
    make(tmp_path, "m2ts", B.transport({0x1200: ("eng", SETS)}), 40)
    assert sum(r["starts"] for r in checked(tmp_path, "packets", 2_000)) == 40 * len(SETS)


def test_track_lists_share_tasks(tmp_path):
    make(tmp_path, "m2ts", B.transport({0x1200: ("eng", SETS)}))
    source = reader(tmp_path, "tracks", 50_000)
    found = source.partitions()
    assert len(found) <= datasource.TASKS < len(rows(source, *found)) == 150
    assert len(reader(tmp_path, "stats", 50_000).partitions()) <= datasource.TASKS


def test_large_ranges_have_tasks_of_their_own(tmp_path, monkeypatch):
    """A task's share is bounded, however much there is, and ranges of split_bytes aren't put together beyond it."""
    monkeypatch.setattr(datasource, "SPLIT_BYTES", 5_000)
    make(tmp_path, "sup", b"PG" * 10_000, 100)
    assert len(reader(tmp_path, "blocks", 5_000).partitions()) == 400
    assert len(reader(tmp_path, "blocks", 1_000).partitions()) == 400


def test_a_broken_head_is_one_error_in_a_task(tmp_path):
    data = B.matroska({3: ({"language": "eng"}, SETS)})
    (tmp_path / "a.mkv").write_bytes(data.replace(b"S_HDMV/PGS", b"S_TEXT/SSA"))
    source = reader(tmp_path, "blocks", 1_000)
    alone = rows(source, datasource.Ranges(tuple(ranges(tmp_path, 1_000)[:1])))
    assert [r["data"] for r in alone] == [None] and alone[0]["error"]
    assert rows(source, datasource.Ranges(tuple(ranges(tmp_path, 1_000)))) == alone


def test_sup_ranges_share_tasks(tmp_path):
    data = B.sup(SETS)
    make(tmp_path, "sup", data)
    (tmp_path / "099.sup").write_bytes(data[:3000] + b"no segment" + data[3000:])  # its range's error leaves the others whole
    got = checked(tmp_path, "blocks", 2_000)
    assert len([r for r in got if r["error"]]) == 1 and len([r for r in got if r["data"]]) > 149 * sum(len(parts) for _, parts in SETS)


def test_sup_files_are_built_in_one_go(spark, tmp_path, monkeypatch):
    """All tracks of a file come of one reading of its events."""
    calls = []
    monkeypatch.setattr(containers, "written", lambda files, folder, f=containers.written: calls.append(folder) or f(files, folder))
    with duckdb.connect() as db:
        db.execute(f"COPY (SELECT range AS event_id, range // 3 AS user_id, 'view' AS event_type FROM range(3200)) TO '{tmp_path}/events.parquet'")
    assert containers.sup_files(spark, str(tmp_path)).count() == 3200 and len(calls) == 1


@pytest.mark.parametrize("junk", [b"x" * 77, b"G" * 400])
def test_ts_ranges_share_tasks(tmp_path, junk):
    make(tmp_path, "ts", B.transport({0x1200: (None, SETS)}, m2ts=False, junk=junk), 40)
    assert sum(r["starts"] for r in checked(tmp_path, "packets", 2_000)) == 40 * len(SETS)
