"""Quality classifier: averaged vectors of hashed word and character n-grams, softmax output.

A word's features are the word, its byte n-grams of 3 to 5 with marks at both ends, and the
pair that it makes with the word before (a word that repeats the one before is a pair of its
own kind). Each feature hashes to one of BUCKETS learned vectors; a document is the mean of
all its features' vectors. Training is numpy stochastic gradient descent on the driver over
a sample of labelled rows, bounded by ``max_rows`` and chosen by hash; scoring covers every
row. As the output is linear in the mean, scoring folds the vectors to one number a bucket
(1 MB broadcast), and each task remembers that number for the words it has met.

Null and empty texts get the score of the bias alone. Rows without a label, with a null id
or held out (crc32 of the id as text, mod 5, is 0) never train; if no row is left, every score
is 0.5. Labels that contradict each other for one id are all used. Only the text is an input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ._scratch import bound_batches, held_out, table, utf8_values

BUCKETS = 1 << 18
DIMENSIONS = 8
EPOCHS = 4
RATE = 0.4
MAX_ROWS = 2000
CUT = 0.3
CACHE_WORDS = 300_000
SHAPES = (3, 4, 5)
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x100000001B3)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M2
    return x ^ (x >> np.uint64(29))


def _bucket(x: np.ndarray) -> np.ndarray:
    return (_mix(x) % np.uint64(BUCKETS)).astype(np.int64)


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, buckets of all features, where each word's begin; one more at the end)."""
    data = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(data), dtype=np.int64) - begins[owner]
    power = M3 ** (place % 64).astype(np.uint64) * (place // 64 + 1).astype(np.uint64)
    hashes = _mix(np.add.reduceat(_mix(data * M1) * power, begins)) if words else np.zeros(0, np.uint64)
    parts, owners = [_bucket(hashes)], [np.arange(len(words))]
    rolled = np.zeros(len(data), dtype=np.uint64)
    for n in range(1, max(SHAPES) + 1):
        shifted = np.zeros_like(rolled)
        shifted[: len(data) - n + 1] = data[n - 1 :]
        rolled = rolled * M3 + shifted * M1
        if n in SHAPES:
            inside = np.flatnonzero(place + n <= sizes[owner])
            parts.append(_bucket(rolled[inside] + np.uint64(n)))
            owners.append(owner[inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return hashes, np.concatenate(parts)[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


def pair_buckets(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return np.where(before == after, 0, _bucket(before * M3 + after + M1))


def document_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets, share of each among the document's features)."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    distinct = list(dict.fromkeys(words))
    code = {w: i for i, w in enumerate(distinct)}
    codes = np.fromiter(map(code.__getitem__, words), dtype=np.int64, count=len(words))
    hashes, buckets, begins = word_features(distinct)
    weights = np.repeat(np.bincount(codes, minlength=len(distinct)), np.diff(begins))
    pairs = pair_buckets(hashes[codes[:-1]], hashes[codes[1:]])
    buckets = np.concatenate((buckets, pairs))
    weights = np.concatenate((weights, np.ones(len(pairs))))
    found, at = np.unique(buckets, return_inverse=True)
    total = np.bincount(at, weights=weights)
    return found, total / total.sum()


def train(texts: list[str | None], labels: list[int], *, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, float]:
    """(number of each bucket, bias): the log-odds of label 1 are bias + the mean over the features."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dimensions, 1 / dimensions, (BUCKETS, dimensions))
    output, bias = np.zeros((2, dimensions)), np.zeros(2)
    docs = [document_features((t or "").encode()) for t in texts]
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            buckets, share = docs[i]
            step = rate * (1 - done / steps)
            done += 1
            mean = share @ vectors[buckets] if len(buckets) else np.zeros(dimensions)
            logits = output @ mean + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[labels[i]] -= 1
            back = error @ output
            output -= step * np.outer(error, mean)
            bias -= 0.1 * step * error
            if len(buckets):
                # Shares are small numbers; their largest sets the scale, as if each feature came once.
                vectors[buckets] -= step * (share / share.max())[:, None] * back
    return vectors @ (output[1] - output[0]), float(bias[1] - bias[0])


class Scores:
    """Scores texts; remembers each word's sum and number of features."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias
        self._forget()

    def _forget(self) -> None:
        self.code: dict[bytes, int] = {}
        self.sums, self.counts, self.hashes = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def _learn(self, new: list[bytes]) -> None:
        hashes, buckets, begins = word_features(new)
        at = len(self.code)
        self.code.update(zip(new, range(at, at + len(new)), strict=True))
        self.sums = np.concatenate((self.sums, np.add.reduceat(self.weights[buckets], begins[:-1])))
        self.counts = np.concatenate((self.counts, np.diff(begins)))
        self.hashes = np.concatenate((self.hashes, hashes))

    def __call__(self, column: pa.Array) -> np.ndarray:
        data, at = utf8_values(column.fill_null(""))
        out = []
        for begin in range(0, len(column), 256):
            edges = at[begin : begin + 257]
            words = [data[a:b].split() for a, b in zip(edges, edges[1:], strict=False)]
            if len(self.code) > CACHE_WORDS:
                self._forget()
            known = self.code
            if new := list({w for part in words for w in part if w not in known}):
                self._learn(new)
            sizes = np.array([len(part) for part in words])
            codes = np.fromiter((known[w] for part in words for w in part), dtype=np.int64, count=int(sizes.sum()))
            doc = np.repeat(np.arange(len(words)), sizes)
            total = np.bincount(doc, weights=self.sums[codes], minlength=len(words))
            number = np.bincount(doc, weights=self.counts[codes], minlength=len(words))
            hashes = self.hashes[codes]
            inner = doc[1:] == doc[:-1]
            pairs = self.weights[pair_buckets(hashes[:-1], hashes[1:])]
            total += np.bincount(doc[1:][inner], weights=pairs[inner], minlength=len(words)) if len(doc) else 0
            number += np.maximum(sizes - 1, 0)
            out.append(self.bias + total / np.maximum(number, 1))
        odds = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def training_rows(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, max_rows: int) -> tuple[list, list]:
    """A sample of labelled rows that aren't held out, the least by hash; max_rows labels at most, and as many rows.

    Where ids repeat, the rows are ordered by id, label and text before the bound is applied.
    """
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), 0))
    chosen = usable.select(F.col(id_col).alias("__gs_id"), F.col(label_col).alias("__gs_label")).orderBy(F.xxhash64("__gs_id"), "__gs_id", "__gs_label").limit(max_rows)
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), F.col(id_col) == F.col("__gs_id")).select("__gs_id", text_col, "__gs_label")
    found: pd.DataFrame = rows.orderBy(F.xxhash64("__gs_id"), "__gs_id", "__gs_label", text_col).limit(max_rows).toPandas()
    return found[text_col].tolist(), found["__gs_label"].astype(int).tolist()


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS):
    """A function from a text column to the column of scores."""
    texts, marks = training_rows(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, max_rows=max_rows)
    bound_batches(docs.sparkSession)
    weights, bias = train(texts, marks) if texts else (np.zeros(BUCKETS), 0.0)
    model = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))

    @arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scores = Scores(*model.value)
        for column in batches:
            yield pa.array(scores(column), type=pa.float64())

    return score


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT, **options) -> DataFrame:
    """All rows and columns of docs with held_out, score and predicted (replacing columns so named)."""
    score = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    scored = docs.withColumn("score", score(F.col(text_col)))
    return scored.withColumn("held_out", held_out(F.col(id_col), 0)).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", cut: float = CUT, **options) -> DataFrame:
    """The rows of docs that score at least cut, with the columns of docs."""
    score: Column = fit(docs, labels, text_col=text_col, **options)(F.col(text_col))
    return docs.filter(score >= cut)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the quality score of every document."""
    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")
