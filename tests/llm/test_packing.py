import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphstream.llm.packing import BETWEEN, LETTERS, WordCache, best_fit_decreasing, pack, query, tokenizer_file


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_equals_scanning_all_windows(lengths):
    free, brute = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [f for f in free if f >= lengths[i]]
        if fits:
            free[free.index(min(fits))] -= lengths[i]
        else:
            free.append(64 - lengths[i])
        brute.append(i)
    groups = best_fit_decreasing(lengths, 64)
    assert sorted(i for g in groups for i in g) == sorted(brute)
    assert Counter(64 - sum(lengths[i] for i in g) for g in groups) == Counter(free)


def test_pieces_cover_every_document_once(spark):
    from tokenizers import Tokenizer

    texts = {1: "Hello  world\n\tÉcole 's <|endoftext|>x", 2: None, 3: "", 4: "word two " * 9000, 5: "á ẛ̣ 　 Σας", 6: "word two " * 3000, 7: "x", 8: "x", 9: "~^`| a~ b^ c`. d| <|ENDOFTEXT|>. İ. ÀB, 3. 4, ..", 10: BETWEEN, 11: " ".join(f"{m}w" for m in BETWEEN)}
    docs = spark.createDataFrame([(k, v, 0) for k, v in texts.items()] + [(8, "x", 1), (None, "y", 2)], "doc_id long, text string, start int")
    rows = pack(docs, tokenizer_file(), window=256, partitions=1).collect()
    tok = Tokenizer.from_file(tokenizer_file())
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for key, text in texts.items():
        want = np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes()
        want = want * 2 if key == 8 else want
        got = sorted(by[key], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in got) == want, key
        assert all(r.length * 4 == len(r.ids) for r in got)
    assert len(by[None]) == 1
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert pack(docs.limit(0), tokenizer_file()).count() == 0
    assert zlib.crc32(b"") == 0


def test_words_as_the_tokenizer():
    import pyarrow.dataset as ds
    from tokenizers import Tokenizer

    tok, cache, rng = Tokenizer.from_file(tokenizer_file()), WordCache(tokenizer_file()), np.random.default_rng(1)
    letters = [chr(c) for c in range(0x41, 0x460) if LETTERS.fullmatch(chr(c))]
    words = ["".join(rng.choice(letters, rng.integers(1, 14))) for _ in range(3000)] + ["a" * n for n in range(1, 40)] + ["nana" * n for n in range(1, 9)] + letters
    words += {w for t in ds.dataset("/root/testdata/sf0.001/documents.parquet").to_table()["text"].to_pylist() for w in (t or "").split()}
    for word, got in zip(words, cache.encode(words), strict=True):
        assert got == np.array(tok.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes(), word
    text = "Straße ΣΑΣ ǅ ŉ ﬁ x\u0301 e\u0301. \u0130 don't I'LL 12.5,3 <|startoftext|>a"
    assert next(cache.encode([text])) == np.array(tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_query_digests_and_padding(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file())
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = {k: np.array(tok.encode(t, add_special_tokens=False).ids + [2], dtype="<u4") for k, t in docs.items()}
    rows, covered, used = query(spark, "/root/testdata/sf0.001").collect(), Counter(), Counter()
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert (len(piece), zlib.crc32(piece.tobytes()), len(ids[r.doc_id])) == (r.length, r.ids_crc32, r.doc_tokens)
        covered[r.doc_id] += r.length
        used[r.sequence_id] += r.length
    assert covered == {k: len(v) for k, v in ids.items()} and max(used.values()) <= 4096
    assert sum(used.values()) > 0.97 * 4096 * len(used)
