import hashlib

import numpy as np

from glyphstream.llm import exact_dedup
from glyphstream.llm.exact_dedup import MAX_BITS, drop_copies, filter_bits, mark_copies, query


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def test_marks_as_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), ["Abc", "aBC", "É", "é", None, "", "x" * 70000, f"t{i}"][rng.integers(8)]) for i in rng.permutation(400)]
    docs = spark.createDataFrame([(i, t, "in") for i, t in rows], "doc_id long, text string, kept string")
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    want = {(i, max(g := groups[low(t)]), len(g), i == max(g), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows}
    for bits in (64, 1 << 16):  # a filter that is full passes every row to the shuffle
        got = mark_copies(docs, max_bits=bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(rows)
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {max(g) for g in groups.values()}
    assert {r.kept for r in kept.collect()} == {"in"}


def test_null_ids_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (1, "A"), (1, "a"), (None, "n")], "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in mark_copies(docs).collect()), key=str)
    assert got == [("1", 1, 3, True), ("1", 1, 3, True), ("None", 1, 3, False), ("None", None, 1, True)]
    assert mark_copies(docs.limit(0)).count() == 0


def test_filter_is_bounded():
    assert filter_bits(0) == 1024
    assert filter_bits(10**12) == MAX_BITS


def test_unique_rows_do_not_shuffle(spark, monkeypatch):
    """Slots in several ranges and messages; of rows that are all unique, few are asked about twice."""
    monkeypatch.setattr(exact_dedup, "RANGE_BITS", 1 << 12)
    monkeypatch.setattr(exact_dedup, "TASK_ROWS", 300)
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id % 3990) AS text").repartition(4)
    bits = filter_bits(4000)
    found = exact_dedup.asked(docs, "text", ["doc_id"], exact_dedup.repeated_filter(docs, "text", bits), bits)
    maybe = {r.doc_id for r in found.filter("__gs_maybe").collect()}
    assert maybe >= {*range(10), *range(3990, 4000)} and len(maybe) < 100


def test_query_as_brute_force(spark):
    got = {tuple(r) for r in query(spark, "/root/testdata/sf0.001").collect()}
    groups, rows = {}, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    assert got == {(i, max(g := groups[low(t)]), len(g), i == max(g), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows}
