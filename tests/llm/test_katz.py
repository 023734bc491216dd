import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from glyphstream.llm.katz import KATZ_MAX, discounts, score


class Plain:
    """The same model over dictionaries, by recursion."""

    def __init__(self, texts):
        self.c = {1: Counter(), 2: Counter(), 3: Counter()}
        for words in texts:
            line = ["<s>", *words]
            for i in range(1, len(line)):
                for n in (1, 2, 3):
                    if i + 1 >= n:
                        self.c[n][tuple(line[i + 1 - n : i + 1])] += 1
        self.after = defaultdict(dict)
        for n in (1, 2, 3):
            for gram, c in self.c[n].items():
                self.after[gram[:-1]][gram[-1]] = c
        self.d = {n: discounts([sum(c == r for c in counts.values()) for r in range(1, KATZ_MAX + 2)]) for n, counts in self.c.items()}
        self.memo = {}

    def cut(self, c, n):
        return c * (self.d[n][c] if c <= KATZ_MAX else 1)

    def history(self, h):
        """(divisor, what unseen words get for each part of the lower order)."""
        if h not in self.memo:
            after, n = self.after[h], len(h) + 1
            z = sum(after.values()) + (not any(c <= KATZ_MAX for c in after.values()))
            free = z - sum(self.cut(c, n) for c in after.values())
            self.memo[h] = z, free / z / ((1 - sum(self.p(h[1:], w) for w in after)) if h else 1)
        return self.memo[h]

    def p(self, h, w):
        if h not in self.after:
            return self.p(h[1:], w)
        z, back = self.history(h)
        if w in self.after[h]:
            return self.cut(self.after[h][w], len(h) + 1) / z
        return back * (self.p(h[1:], w) if h else 1)


@pytest.mark.parametrize(("many", "parts"), [(60, 16), (6, 16), (60, 3), (200, 40)])
def test_scores_as_dictionaries_and_sums_to_one(spark, many, parts):
    rng = np.random.default_rng(many)
    words = [f"w{i}" for i in range(30)] + ["É", "é"]
    weights = 1 / np.arange(1, len(words) + 1)
    texts = [(i, " ".join(rng.choice(words, rng.integers(0, 40), p=weights / weights.sum()))) for i in range(many)]
    texts += [(many, None), (many + 1, "The THE the\tnew \x0b" + "w0 w1 " * 30), (many + 2, "w0 w1 " * 200), (many + 3, "solo " + "long " * 20_000)]
    texts += [(many + 2, "w0 w1 " * 200), (None, "w0 rare"), (many + 4, "x" * 300_000 + " w1"), (many + 5, "")]
    low = lambda t: [*(t or "").encode().lower().split(), "</s>"]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 1
    model = Plain([low(t) for k, t in texts if not held(k)])
    vocabulary = [w for (w,) in model.c[1]] + ["unknown"]
    for h in [(), ("unknown",), ("unknown", vocabulary[0]), *list(model.after)[:300]]:
        assert math.isclose(sum(model.p(h, w) for w in vocabulary), 1, rel_tol=1e-9)
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts], "doc_id long, text string, score int").repartition(4)
    got = score(docs, parts=parts).collect()
    total, types = sum(model.c[1].values()), len(model.c[1])
    assert sorted(str(r.doc_id) for r in got) == sorted(str(k) for k, _ in texts)
    of = {r.doc_id: r for r in got}
    for key, text in texts:
        tokens, r = low(text), of[key]
        line = ["<s>", *tokens]
        base = sum(math.log10((model.c[1][w,] + 0.5) / (total + 0.5 * (types + 1))) for w in tokens)
        want = sum(math.log10(model.p(tuple(line[max(0, i - 2) : i]), line[i])) for i in range(1, len(line)))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(key), len(tokens), sum((w,) in model.c[1] for w in tokens), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, want, rel_tol=1e-9), (key, r, want)


def test_discounted_counts_rise():
    for counts in ([100, 40, 20, 12, 8, 5], [10, 0, 3, 0, 1, 0], [5, 0, 0, 0, 0, 0], [0] * 6, [3, 9, 4, 2, 8, 1]):
        d = discounts(counts)
        kept = [r * d[r] for r in range(1, KATZ_MAX + 1)]
        assert all(0 < x < 1 for x in d[1:]) and kept == sorted(kept)


def test_nothing_to_train_on(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    docs = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    (row,) = score(docs).collect()
    assert row.train_tokens == 0 and math.isclose(row.score, 3 * math.log10(0.5))
    assert score(docs.limit(0)).count() == 0
