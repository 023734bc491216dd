import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphstream.llm import components as cc
from glyphstream.llm import jaccard_join as jj
from glyphstream.llm.components import components


def shingles(text, n=4):
    words = (text or "").encode().lower().split()
    return frozenset([tuple(words)] if 0 < len(words) < n else (tuple(words[i : i + n]) for i in range(len(words) - n + 1)))


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(key, least.get(find(i), key))
    return {(key, len(sets[i]), least[find(i)]) for i, (key, _) in enumerate(rows)}


def corpus(seed, base_words, copies, edits):
    rng = np.random.default_rng(seed)
    texts = [None, "", "One two", "one TWO", "one two three", "É é", "a a a a a a", "x" * 30000]
    for size in base_words:
        base = [f"w{x}" for x in rng.integers(0, 5000, size)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.integers(0, edits + 1)):
                at = rng.integers(0, len(words))
                words[at : at + rng.integers(0, 2)] = [f"v{rng.integers(0, 5000)}"]
            texts.append(" ".join(words))
    return [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]


@pytest.mark.parametrize(("leaf", "region_shingles"), [(64, None), (3, None), (3, 0)])
def test_components_as_brute_force(spark, monkeypatch, leaf, region_shingles):
    for name, value in (("LEAF", leaf), ("CHUNK_SHINGLES", 400), ("PIVOTS", 2), ("PIVOTS_AT_ONCE", 4)):
        monkeypatch.setattr(jj, name, value)
    rows = corpus(leaf, [6, 9, 14, 25, 40, 80, 150, 3000], 12, 5)
    rows += [(1000, rows[20][1]), (1000, rows[20][1])]
    docs = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, point int").repartition(3)
    got = jj.join(docs, region_shingles=region_shingles).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(rows)


def test_whole_table_as_brute_force(spark):
    found = {tuple(r) for r in jj.query(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert found == brute([tuple(r) for r in docs])


def test_voronoi_cells_solve_a_region(monkeypatch):
    """Clusters apart from each other: cells take over, and find what all pairs would."""
    monkeypatch.setattr(jj, "LEAF", 4)
    rng, sets = np.random.default_rng(3), []
    for _ in range(12):
        base = rng.integers(0, 2**50, 90, dtype=np.uint64)
        for _ in range(15):
            sets.append(np.unique(np.concatenate((rng.choice(base, 74, replace=False), rng.integers(0, 2**50, 2, dtype=np.uint64)))))
            sets.append(np.unique(np.concatenate((sets[-1][:-3], rng.integers(0, 2**50, 3, dtype=np.uint64)))))
    measured, count = [], jj.Region.distances

    def watch(self, members, to):
        measured.append(len(members))
        return count(self, members, to)

    monkeypatch.setattr(jj.Region, "distances", watch)
    got, want = jj.Roots(), jj.Roots()
    for a, b in jj.Region(sets, 85).solve(0):
        got.join(a, b)
    for i, x in enumerate(sets):
        for j in range(i):
            common = len(np.intersect1d(x, sets[j]))
            if jj.linked(common, len(x), len(sets[j]), 85):
                want.join(i, j)
    parts = lambda roots: {frozenset(j for j in range(len(sets)) if roots.find(j) == roots.find(i)) for i in range(len(sets))}
    assert parts(got) == parts(want) and sum(measured) < 0.5 * len(sets) ** 2


def test_keep_one_and_no_rows(spark):
    docs = spark.createDataFrame([(2, "a b c d e"), (1, "A b c d e"), (3, None), (None, "z")], "doc_id long, text string")
    assert {r.doc_id for r in jj.keep_one(docs).collect()} == {1, 3, None}
    assert jj.join(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shrink", [0.5, 1.0])
def test_regions_that_windows_do_not_prune(spark, monkeypatch, shrink):
    for name, value in (("PIVOTS", 4), ("PIVOTS_AT_ONCE", 4), ("CHUNK_SHINGLES", 200), ("SHRINK", shrink)):
        monkeypatch.setattr(jj, name, value)
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**50, 100, dtype=np.uint64)
    sets = [np.sort(np.concatenate((base[: rng.integers(76, 80)], rng.integers(0, 2**50, 20, dtype=np.uint64)))) for _ in range(30)]
    sets += [np.delete(s, 3) for s in sets[:3]]
    total = sum(map(len, sets))
    rows = [(0, i, total, len(s), jj.pack_sorted(s)) for i, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "region long, point long, shingles long, n long, data binary")
    write, rounds = jj.materialise, []

    def watch(df, label, size=0):
        df = write(df, label, size)
        if label == "opened":
            rounds.append(1)
            assert len(rounds) <= (2 if shrink < 1 else 10)
        if label == "regions":
            assert (df.filter("open").groupBy("point").count().agg({"count": "max"}).first()[0] or 0) <= 1
        return df

    monkeypatch.setattr(jj, "materialise", watch)
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in jj._join_large(members, 85, 0).collect()}
    assert found == {(0, 30), (1, 31), (2, 32)}
    links = jj.Region(sets, 85).solve(0)
    assert {(min(x), max(x)) for x in links} == found


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.integers(0, 10**6))
def test_linked_sets_share_a_cell(size, lose, gain, seed):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 2**52, size, dtype=np.uint64))
    y = np.unique(np.concatenate((x[: max(1, len(x) - lose)], rng.integers(0, 2**52, gain, dtype=np.uint64))))
    common = len(np.intersect1d(x, y))
    if 100 * common >= 85 * (len(x) + len(y) - common) and len(np.setxor1d(x, y)):
        names, owner = jj.cells(np.concatenate((x, y)), np.array([len(x), len(y)]), 85)
        assert len(np.intersect1d(names[owner == 0], names[owner == 1]))


@pytest.mark.parametrize("one_task", [0, 40, 10**6])
def test_graph_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(cc, "ONE_TASK", one_task)
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000, 1000 + i) for i in range(50)] + [(i, i + 1) for i in range(2000, 2040)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {(n, find(n)) for a, b in edges if a != b for n in (a, b)}
    assert {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


@pytest.mark.parametrize("region_shingles", [None, 0])
def test_regions_without_sketches_as_brute_force(spark, monkeypatch, region_shingles):
    monkeypatch.setattr(jj, "SKETCHED", 4)
    rows = corpus(5, [9, 25, 80, 400], 10, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in jj.join(docs, region_shingles=region_shingles).collect()} == brute(rows)


@pytest.mark.parametrize("percent", [80, 85])
def test_sketches_leave_out_no_link(percent):
    rng = np.random.default_rng(percent)
    for size in (1, 2, 7, 60, 500):
        base = np.unique(rng.integers(0, 1 << 52, size, dtype=np.uint64))
        sets = [np.unique(np.concatenate((rng.choice(base, len(base) - k), rng.integers(0, 1 << 52, k, dtype=np.uint64)))) for k in rng.integers(0, 1 + size // 6, 12)] + [base, base[: -(size // 10) or None]]
        sets += [np.unique(rng.integers(0, 1 << 52, size, dtype=np.uint64)) for _ in range(8)]
        kept = jj.near([jj.sketch(s) for s in sets], np.array([len(s) for s in sets]), percent)
        for i, a in enumerate(sets):
            links = [100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)) for j, b in enumerate(sets) if j != i]
            assert kept[i] or not any(links)
        assert size < 60 or not kept[-8:].any()


def test_sets_move_where_links_may_be(spark, monkeypatch):
    rows, kept = {"placed": 0, "members": 0}, jj.materialise

    def watch(df, label, size=0):
        out = kept(df, label, size)
        if label in rows:
            rows[label] += out.count()
        return out

    monkeypatch.setattr(jj, "materialise", watch)
    jj.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), shingle=5, percent=80)
    assert 0 < 2 * rows["members"] < rows["placed"]
