"""Decontamination, licences, the archive and the classifier against plain Python."""

import base64
import hashlib
import re
import textwrap
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException

from glyphstream.llm import decontamination, licenses, quality, warc

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def contaminated(text, items, size):
    words = WORDS.findall(low(text))
    hit, found = set(), set()
    for key, item in items:
        own = WORDS.findall(low(item))
        for i in range(max(1, len(own) - size + 1)) if own else ():
            window = own[i : i + size]
            for j in range(len(words) - len(window) + 1):
                if words[j : j + len(window)] == window:
                    hit.update(range(j, j + len(window)))
                    found.add(str(key))
    return len(words), len(hit), sorted(found), [words[i] for i in sorted(hit)]


def test_decontamination(spark):
    rng = np.random.default_rng(2)
    word = lambda n: " ".join(rng.choice(["a", "B", "é", "x1", "fin", "ﬁ"], n))
    items = [(1, word(9)), (2, "Only three, words!"), (3, None), (4, "..."), (10, word(6)), (10, "again"), (None, "a b"), (5, "a a a")]
    texts = [word(60), f"{word(5)},{items[0][1].upper() if items[0][1].isascii() else items[0][1]}; {word(3)}", "only-THREE  words again", None, "", "é " * 3000 + items[4][1], "aa a a ab", "a a a a", "a  a\ta"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[2], 1)], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1, 10**6):
        got = {r.doc_id: r for r in decontamination.scan(docs, bench, size=4, block_chars=block).collect()}
        for i, text in enumerate(texts):
            n, hit, ids, words = contaminated(text, [x for x in items if x[0] is not None], 4)
            assert (got[i].n_words, got[i].n_hit, got[i].item_ids) == (n, hit, ids), i
            assert [w for s in got[i].spans for w in WORDS.findall(low(text[s.start : s.end]))] == words
    clean = decontamination.drop_contaminated(docs, bench, size=4)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, t in enumerate(texts) if not contaminated(t, items, 4)[1]}
    assert decontamination.scan(docs.limit(0), bench).count() == 0 and decontamination.scan(docs, bench.limit(0)).agg({"n_hit": "sum"}).first()[0] == 0


def test_licenses(spark):
    mit = licenses.TEMPLATES["mit"]
    texts = ["x\nReleased under the MIT license\ny z", None, "", "word", f"{mit}\n{mit}", "Released under\nthe MIT License.", "All rights reserved", "É " * 40000, licenses.TEMPLATES["mit-notice"].upper()]
    wrapped = lambda text: "\n".join(textwrap.wrap(text, 60))
    texts += ["# " + wrapped(licenses.WHOLE["mit-text"]) + "\n" + "code and words " * 50, "word " * 301 + wrapped(licenses.TEMPLATES["gpl-3.0-notice"]) + " more" * 200]
    texts += [f"Copyright 2020 Somebody {licenses.WHOLE['isc-text']}", "Permission is hereby granted to no one, " * 8]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)] + [(None, mit, "q")], "doc_id long, text string, unit string")
    got = sorted((tuple(r) for r in licenses.scan(docs).collect()), key=str)
    with duckdb.connect() as db:
        db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?)", [[i, t] for i, t in enumerate(texts)] + [[None, mit]])
        want = sorted(db.execute(licenses.oracle()).fetchall(), key=str)
    assert got == want and {g[:3] for g in got} >= {(0, 2, "mit"), (5, 0, "mit"), (6, 1, "all-rights-reserved"), (8, 1, "mit-notice")}
    assert {(9, "mit-text"), (10, "gpl-3.0-notice"), (11, "isc-text")} <= {(g[0], g[2]) for g in got if g[1] < 0} and 12 not in {g[0] for g in got}
    assert licenses.scan(docs.limit(0)).count() == 0
    plan = licenses.scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_archive(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y", "<p>É"), (2, None, "<p>É"), (3, "u", None), (4, "u", ""), (5, "u", "z" * 100000), (5, "u", "z" * 100000), (None, "n", "<p>É")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")
    path = str(tmp_path / "a")
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    back = warc.read_archive(spark, path).collect()
    assert len(back) == len(rows)
    for r in back:
        html = {1: "<p>É", 2: "<p>É", None: "<p>É", 3: "", 4: "", 5: "z" * 100000}[r.key].encode()
        first = {1: 2, None: 2, 3: 4}.get(r.key)
        sha = base64.b32encode(hashlib.sha1(html).digest()).decode()
        assert (r.payload_digest, r.payload_bytes, r.record_type, r.refers_to) == (sha, len(html), "revisit" if first else "response", first)
        ((fields, block),) = warc.parse_records(bytes(r.record))
        assert fields["WARC-Payload-Digest"] == f"sha1:{sha}" and block.partition(b"\r\n\r\n")[2] == (b"" if first else html)
        assert fields["WARC-Type"] == r.record_type and "X" not in fields
    parsed = warc.read_records(spark, path)
    columns = ["key", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    assert sorted(map(str, parsed.select(columns).collect())) == sorted(map(str, spark.createDataFrame(back).select(columns).collect()))
    assert "record" in str(parsed._jdf.queryExecution().analyzed())
    warc.write_archive(pages, str(tmp_path / "b"), min_revisit_bytes=1)
    assert {r.key for r in warc.read_archive(spark, str(tmp_path / "b")).collect() if r.record_type == "revisit"} == {1, None}
    spark.read.parquet(f"{path}/payloads").selectExpr("digest", "cast('other' as binary) payload").write.parquet(str(tmp_path / "c/payloads"))
    with pytest.raises(PySparkException):
        warc.read_payloads(spark, str(tmp_path / "c")).collect()
    warc.write_archive(pages.limit(0), str(tmp_path / "d"))
    assert warc.read_archive(spark, str(tmp_path / "d")).count() == 0


def test_classifier_on_rows_it_has_not_seen(spark):
    rng = np.random.default_rng(4)
    good = lambda: " ".join("".join(rng.choice(["an", "the", "er", "io", "st"], rng.integers(1, 4))) for _ in range(30))
    rows = [(i, good() if i % 3 else good().upper() + "!!", i % 3 and 1) for i in range(240)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (None, "the", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(bool(q))) for i, _, q in rows] + [(None, 1), (900, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert got[900].score == got[901].score
    held = [(i, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert np.mean([got[i].predicted == bool(q) for i, q in held]) > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.predicted}
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_word_scores_add_up_to_the_model():
    import pyarrow as pa

    weights = np.random.default_rng(0).normal(size=quality.BUCKETS)
    texts = ["a b b c", "", "É x", "one", None]
    want = []
    for t in texts:
        buckets, share = quality.document_features((t or "").encode())
        want.append(1 / (1 + np.exp(-(0.5 + (share @ weights[buckets] if len(buckets) else 0)))))
    assert np.allclose(quality.Scores(weights, 0.5)(pa.array(texts)), want)
