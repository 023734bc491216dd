"""Every registered query of the package itself against its oracle, on the smallest tables."""

import os

import duckdb
import pytest

from glyphstream.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    with duckdb.connect() as db:
        for name in os.listdir(SF):
            db.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
        yield db


def plain(value):
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str([plain(v) for v in r]) for r in df.select(*columns).collect())
    listed = ", ".join(f'"{c}"' for c in columns)
    want = sorted(str([plain(v) for v in r]) for r in tables.execute(f"SELECT {listed} FROM ({ORACLES[name]})").fetchall())
    assert got == want and got


def test_the_rest_stands_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    shutil.copytree(repo / "glyphstream", tmp_path / "glyphstream", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'sets_per_track' in q and set(o) == set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q if n != 'objects' and n != 'object_positions')"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
