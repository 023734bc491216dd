"""Packing tokenised documents into fixed windows by best-fit decreasing.

A document longer than the window is first cut into full windows, which are sequences of
their own. What is left is placed, longest first, into the open window whose free space is
the smallest that suffices; a segment tree over the free space finds it in O(log window).

Every input partition is tokenised and packed where it is read, in blocks of at most
``block_tokens`` tokens: no shuffle, memory bounded by the block, and a lost task packs the
same rows again. Only the last windows of a block are loosely filled, so small partitions are
merged, again without a shuffle, until they are PARTITION_BYTES of files, some 250 windows.

Null texts count as empty: such a document is the end token alone. Rows that repeat are
packed as often as they occur, ties in length go in reading order, null ids are carried
along, and other columns stay behind. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._scratch import input_bytes, keep, table, texts

WINDOW = 4096
END_ID = 2
CACHE_WORDS = 300_000
BETWEEN = "~^`|★☆■▪●◆►▶♥♦♪"  # marks that are one token each
PARTITION_BYTES = 4 << 20


class OpenWindows:
    """Open windows by free space: a binary tree whose leaves are the sizes 0..window."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, free: int, by: int) -> None:
        node = free + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, free: int, window: int) -> None:
        self.open[free].append(window)
        self._add(free, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take out the window with the least free space of at least length."""
        count, node = self.count, length + self.size
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        free = node - self.size
        self._add(free, -1)
        return free, self.open[free].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """Groups of indices; the lengths of a group sum to at most window. Lengths are 1..window."""
    tree, groups = OpenWindows(window), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.tightest(lengths[i])
        free, at = found if found else (window, len(groups))
        if found is None:
            groups.append([])
        groups[at].append(i)
        if free > lengths[i]:
            tree.put(free - lengths[i], at)
    return groups


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


class Merges:
    """Byte-pair merges of many words at once, by the merges of a tokenizer's file.

    In each round every word merges its pair of the least rank, at all of its places from the
    left, until no word has a pair that can be merged.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, suffix, letters = model["vocab"], model["end_of_word_suffix"], byte_letters()
        self.inner = np.array([vocabulary[c] for c in letters])
        self.last = np.array([vocabulary[c + suffix] for c in letters])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.none = len(pairs)
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], dtype=np.uint64)
        self.made = np.array([vocabulary[a + b] for a, b in pairs])
        # Open addressing: a pair lies at its hash or at one of the next places.
        self.bits = max(10, (4 * len(pairs)).bit_length())
        self.keys, self.rank, left = np.full(1 << self.bits, np.uint64((1 << 64) - 1)), np.full(1 << self.bits, self.none), np.arange(len(pairs))
        at = self._place(keys)
        while len(left):
            free = left[self.keys[at[left]] == np.uint64((1 << 64) - 1)]
            _, first = np.unique(at[free], return_index=True)
            self.keys[at[free[first]]], self.rank[at[free[first]]] = keys[free[first]], free[first]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (1 << self.bits) - 1

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``none`` for those that don't merge."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at = self._place(keys)
        found, out = self.keys[at], self.rank[at]
        left = np.flatnonzero((found != keys) & (out != self.none))
        out[left] = self.none
        while len(left):
            at[left] = (at[left] + 1) & (1 << self.bits) - 1
            found, rank = self.keys[at[left]], self.rank[at[left]]
            out[left[found == keys[left]]] = rank[found == keys[left]]
            left = left[(found != keys[left]) & (rank != self.none)]
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has); no word may be empty."""
        raw, sizes = np.frombuffer(b"".join(words), dtype=np.uint8), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbol, word = self.inner[raw], np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes) - 1
        symbol[ends] = self.last[raw[ends]]
        rank = np.append(self.ranks(symbol[:-1], symbol[1:]), self.none)
        rank[ends] = self.none
        done_ids, done_words = [], []
        while len(symbol):
            begins = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.repeat(np.minimum.reduceat(rank, begins), np.diff(np.append(begins, len(symbol))))
            ended = least == self.none
            if ended.any():
                done_ids.append(symbol[ended])
                done_words.append(word[ended])
                symbol, word, rank, least = symbol[~ended], word[~ended], rank[~ended], least[~ended]
                if not len(symbol):
                    break
            merge = rank == least
            if (merge[1:] & merge[:-1]).any():  # a run of places that overlap: every other one
                place = np.arange(len(merge))
                before = np.maximum.accumulate(np.where(merge, -1, place))
                merge &= (place - before) % 2 == 1
            at = np.flatnonzero(merge)
            symbol[at] = self.made[rank[at]]
            keep = np.ones(len(symbol), dtype=bool)
            keep[at + 1] = False
            at -= np.arange(len(at))
            symbol, word = symbol[keep], word[keep]
            rank = rank[keep]
            for near in (at, at[at > 0] - 1):
                after = np.minimum(near + 1, len(symbol) - 1)
                rank[near] = np.where((word[after] == word[near]) & (after > near), self.ranks(symbol[near], symbol[after]), self.none)
        ids, of = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(of, kind="stable")
        return ids[order].astype("<u4"), np.bincount(of, minlength=len(words))


class WordCache:
    """Token ids of a text, as little-endian unsigned 32-bit integers.

    For byte-level tokenizers with word ends that lower-case and whose pieces are runs of
    letters, single digits, or runs of what is neither: each word is encoded once and
    remembered by all tasks of a Python worker. Words of plain letters are merged here, many
    at once; others go to the tokenizer. Words are forgotten that haven't been met while
    CACHE_WORDS others were.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.merges = Tokenizer.from_file(path), Merges(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks = self._encoded([".", ","])

    @classmethod
    def of(cls, path: str) -> WordCache:
        return keep(f"words of {path}", lambda: cls(path))

    def _encoded(self, words: list[str]) -> dict[str, bytes]:
        """Encode the words in one text, a line for each, with lines between them of a mark that none has."""
        if len(words) > 20_000:
            return {k: v for begin in range(0, len(words), 20_000) for k, v in self._encoded(words[begin : begin + 20_000]).items()}
        everything = "".join(words)
        mark = next((m for m in BETWEEN if m not in everything), None)
        if mark is None and len(words) > 1:
            return self._encoded(words[: len(words) // 2]) | self._encoded(words[len(words) // 2 :])
        ids = self._ids(f"\n{mark}\n".join(words))
        ends = [*(4 * np.flatnonzero(ids == self._ids(mark)[0])).tolist(), 4 * len(ids)] if mark else [4 * len(ids)]
        data = ids.tobytes()
        return dict(zip(words, [data[a:b] for a, b in zip([0, *[e + 4 for e in ends]], ends, strict=False)], strict=bool(words)))

    def _merged(self, stems: list[str]) -> dict[str, bytes]:
        if not stems:
            return {}
        ids, sizes = self.merges.encode([stem.lower().encode() for stem in stems])
        data, edges = ids.tobytes(), np.concatenate(([0], 4 * np.cumsum(sizes))).tolist()
        return dict(zip(stems, [data[a:b] for a, b in zip(edges, edges[1:], strict=False)], strict=True))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode(self, batch: list[str]) -> Iterator[bytes]:
        split = [text.replace("\n", " ").split(" ") for text in batch]
        wanted = set().union(*split)
        wanted.discard("")
        young, old = self.young, self.old
        fresh = wanted - young.keys()
        again = fresh & old.keys()
        young.update((word, old[word]) for word in again)
        self._learn(fresh - again)
        known = young
        known[""] = b""
        for words in split:
            yield b"".join(map(known.__getitem__, words))
        if len(young) > CACHE_WORDS:
            self.young, self.old = {}, young

    def _learn(self, words: set[str]) -> None:
        plain, marked = [], []
        for word in words:
            (marked if word[-1] in ".," and word[-2:-1] in PLAIN else plain).append(word)
        # Plain ASCII is lower-cased here, as the tokenizer would; a special token's name has marks in it.
        low = lambda word: word.lower() if word.isascii() and "<" not in word else word
        stems = {word: low(word) for word in plain}
        stems |= {word: low(word[:-1]) for word in marked}
        found = dict.fromkeys(stems.values())
        for known in (self.old, self.young):
            found |= {stem: known[stem] for stem in found.keys() & known.keys()}
        new = [stem for stem, ids in found.items() if ids is None]
        found |= self._merged([stem for stem in new if LETTERS.fullmatch(stem)])
        found |= self._encoded([stem for stem in new if found[stem] is None])
        self.young.update((word, found[stems[word]]) for word in plain)
        self.young.update((word, found[stems[word]] + self.marks[word[-1]]) for word in marked)


# Letters that are composed, and one letter in lower case: of Latin, Greek and Cyrillic.
LETTERS = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f\u0391-\u03a1\u03a4-\u03a9\u03b1-\u03c1\u03c3-\u03c9\u0410-\u044f]+")
# Letters and digits that are one character in lower case too; "" isn't one.
PLAIN = frozenset(c for c in map(chr, range(0x250)) if c.isalnum() and (c.isalpha() or c.isdecimal()) and len(c.lower()) == 1)


def _rows(ids: list, tokens: list[bytes], window: int, sequence: int) -> Iterator[tuple]:
    """The pieces of one block; sequence is the first free sequence number."""
    rest: list[tuple[int, int, int]] = []
    for doc, data in enumerate(tokens):
        total = len(data) // 4
        full = total - total % window
        for start in range(0, full, window):
            yield ids[doc], start, window, data[4 * start : 4 * (start + window)], total, sequence, 0
            sequence += 1
        if total > full:
            rest.append((doc, full, total))
    for group in best_fit_decreasing([total - start for _, start, total in rest], window):
        offset = 0
        for doc, start, total in (rest[i] for i in group):
            yield ids[doc], start, total - start, tokens[doc][4 * start :], total, sequence, offset
            offset += total - start
        sequence += 1


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, 512)):
        columns = list(zip(*part, strict=True))
        yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    block_tokens: int = 4_000_000,
    partitions: int | None = None,
) -> DataFrame:
    """One row for each piece: id, start, length, ids (little-endian u32), doc_tokens, sequence_id, offset."""
    source = texts(docs, id_col, text_col).coalesce(partitions or max(1, input_bytes(docs) // PARTITION_BYTES))
    out_id = source.schema["id"].dataType
    schema = T.StructType(
        [T.StructField(id_col, out_id), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())]
        + [T.StructField(c, T.LongType()) for c in ("doc_tokens", "sequence_id", "offset")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, cache, end = to_arrow_schema(schema), None, np.array([end_id], dtype="<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        ids, tokens, held = [], [], 0
        for batch in batches:
            cache = cache or WordCache.of(tokenizer_path)
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                for key, data in zip(part.column(0).to_pylist(), cache.encode(part.column(1).to_pylist()), strict=True):
                    ids.append(key)
                    tokens.append(data + end)
                    held += len(data) // 4 + 1
                if held >= block_tokens:
                    yield from _batches(_rows(ids, tokens, window, sequence), arrow)
                    sequence += held  # no block has more windows than tokens
                    ids, tokens, held = [], [], 0
        if ids:
            yield from _batches(_rows(ids, tokens, window, sequence), arrow)

    return source.mapInArrow(run, schema)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every piece with the digest of its ids."""
    packed = pack(table(spark, sf_dir, "documents"), tokenizer_file())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
