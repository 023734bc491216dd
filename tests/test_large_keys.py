"""Queries on tables whose keys are larger than those of the small tables."""

import duckdb
import pytest

from glyphstream.plans.queries import ORACLES, QUERIES

KINDS = ("signup", "error", "click", "view", "purchase")
# Numbers of 16 bits end at 65535.
OVER_16_BITS = [
    "bytes_read",
    "m2ts_sets",
    "mkv_track_list",
    "transport_track_list",
    "every_container",
    "mkv_cued_sets",
    "pushed_filters",
    "ts_junk_sets",
    "mkv_sequential_sets",
    "sup_files",
]


def events(folder, ranges):
    """events.parquet with the ids of the ranges, of all types and tracks."""
    ids = [e for r in ranges for e in r]
    with duckdb.connect() as db:
        db.execute("CREATE TABLE events (event_id BIGINT, user_id BIGINT, event_type VARCHAR)")
        db.executemany("INSERT INTO events VALUES (?, ?, ?)", [(e, e // 3, KINDS[e * 7 // 5 % 5]) for e in ids])
        db.execute(f"COPY events TO '{folder}/events.parquet'")


def plain(value):
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def agrees(spark, folder, name, table="events"):
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    got = sorted(str([plain(v) for v in r]) for r in df.select(*columns).collect())
    listed = ", ".join(f'"{c}"' for c in columns)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
        want = sorted(str([plain(v) for v in r]) for r in db.execute(f"SELECT {listed} FROM ({ORACLES[name]})").fetchall())
    return got == want and bool(got)


@pytest.mark.parametrize("name", OVER_16_BITS)
def test_ids_over_16_bits(spark, tmp_path, name):
    events(tmp_path, [range(0, 40), range(65400, 65600), range(99000, 99100)])
    assert agrees(spark, tmp_path, name)


# Times of 32 bits end at event 1193046, those of 33 bits at 2386092.
OVER_32_BITS = [
    "clear_events",
    "epoch_starts",
    "track_summary",
    "big_endian",
    "ndjson_roundtrip",
    "pes_reassembly",
    "set_durations",
    "set_timing",
    "time_slice",
    "track_filter",
]


@pytest.mark.parametrize("name", OVER_32_BITS)
def test_times_over_32_bits(spark, tmp_path, name):
    events(tmp_path, [range(90, 140), range(1193030, 1193190), range(2386050, 2386230), range(5999900, 6000000)])
    assert agrees(spark, tmp_path, name)
