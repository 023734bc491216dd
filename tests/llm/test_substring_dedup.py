import hashlib
from collections import Counter

import numpy as np

from glyphstream.llm._blocks import BASE, pack_sorted, rolling, unpack_sorted
from glyphstream.llm.substring_dedup import cut_repeats


def test_rolling_is_the_polynomial():
    x = np.random.default_rng(0).integers(0, 2**64, 90, dtype=np.uint64)
    for n in (1, 2, 4, 35, 90):
        want = [sum(int(v) * pow(int(BASE), n - 1 - j, 2**64) for j, v in enumerate(x[i : i + n])) % 2**64 for i in range(91 - n)]
        assert rolling(x, n).tolist() == want
    assert len(rolling(x[:3], 35)) == 0
    s = np.sort(x)
    assert (unpack_sorted(pack_sorted(s)) == s).all()


def brute(rows, size):
    split = [(k, (t or "").encode().split()) for k, t in rows]
    starts = Counter(tuple(w[i : i + size]) for _, w in split for i in range(len(w) - size + 1))
    for key, words in split:
        gone = set()
        for i in range(len(words) - size + 1):
            if starts[tuple(words[i : i + size])] > 1:
                gone.update(range(i, i + size))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        yield key, len(words), len(gone), hashlib.sha256(kept).hexdigest()


def test_cuts_as_brute_force(spark):
    rng = np.random.default_rng(1)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 400, n))
    shared, loop = word(12), "a b c " * 20
    texts = [word(40) + " " + shared + "\n" + word(9), shared, None, "", loop, word(5), word(60), "x\t\x0b" + shared + " É", shared.upper(), "q " * 7, "longword" * 9000]
    texts += [texts[6], word(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[1])]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, kept int").repartition(3)
    got = {(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in cut_repeats(docs, size=7).collect()}
    assert got == set(brute(rows, 7))
    assert cut_repeats(docs.limit(0), size=7).count() == 0
