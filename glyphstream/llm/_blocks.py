"""Blocks of documents, and the exchange of packed keys between blocks and key ranges.

Operators that count keys over the whole corpus would shuffle a row for each word. Instead
the documents are written once as blocks: of compressed text, or of coded words (the block's
sorted vocabulary of word hashes, and a number into it for each word). Each block sends its
distinct keys, sorted and packed, to the ranges that own them, and each range answers every
block in the block's own order. So a key that a third of the corpus shares travels once a
block. Ranges are as many as the input's size asks for, so that a range's keys fit a task; a
message has at least one key, so there are never more rows than distinct keys of blocks.

Words are what stands between ASCII white space. A word's hash is a polynomial over random
64-bit numbers, one for each byte, computed for all words of a block in a few array passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._scratch import bucketed, input_bytes, release, texts, utf8_values

BLOCK_BYTES = 4_000_000
MESSAGE_BYTES = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
PIECE = 1 << 17  # bytes hashed at once
OWNER_BITS = 12  # a block has at most 2**12 documents


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n - 1), modulo 2**64."""
    out, done = np.ones(n, dtype=np.uint64), 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


UP, DOWN = powers(PIECE + 1, int(BASE)), powers(PIECE + 1, pow(int(BASE), -1, 1 << 64))
VALUES = mix(np.arange(1, 257, dtype=np.uint64))
INSIDE = np.ones(256, dtype=bool)
INSIDE[[9, 10, 11, 12, 13, 32]] = False


def word_hashes(data: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, words of each text) of the texts data[at[i]:at[i + 1]]."""
    raw, at = np.frombuffer(data, dtype=np.uint8), np.asarray(at, dtype=np.int64)
    inside = INSIDE[raw]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < len(raw))]
    begin[edge], end[edge - 1] = inside[edge], inside[edge - 1]
    begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    out, done = np.empty(len(begins), dtype=np.uint64), 0
    while done < len(begins):
        first = int(begins[done])
        upto = int(np.searchsorted(ends, first + PIECE, side="right"))
        if upto == done:  # a word longer than a piece
            out[done] = xxhash.xxh64_intdigest(data[first : ends[done]])
            done += 1
            continue
        part = raw[first : ends[upto - 1]]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(VALUES[part] * UP[: len(part)], out=total[1:])
        a, b = begins[done:upto] - first, ends[done:upto] - first
        out[done:upto] = mix((total[b] - total[a]) * DOWN[a] + (b - a).astype(np.uint64))
        done = upto
    return out, np.diff(np.searchsorted(begins, at))


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp: the polynomial hash, modulo 2**64, of the n values from each place on.

    Windows double: that of a + b values is that of a, times base**b, plus that of b. The
    last n - 1 places have no window.
    """
    done, covered, power = None, 0, [hashes, 1, BASE]
    out_n = n
    while n:
        piece, size, factor = power
        if n & 1:
            if done is None:
                done, covered = piece, size
            else:
                keep = len(done) - size
                done = done[:keep] * factor + piece[covered : covered + keep]
                covered += size
        n >>= 1
        if n:
            keep = max(0, len(piece) - size)
            power = [piece[:keep] * factor + piece[size : size + keep], 2 * size, np.uint64(int(factor) ** 2 & (1 << 64) - 1)]
    return done[: max(0, len(hashes) - out_n + 1)]


def places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, place within it) of every word."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def ranges_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of 64-bit keys begins in the sorted keys, and the end."""
    edges = np.array([(i << 64) // parts for i in range(parts)], dtype=np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


# Packing


def pack_bytes(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack_bytes(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31) if data else b""


def pack_ints(values: np.ndarray) -> bytes:
    """Non-negative integers, as planes of bytes that compress well; as many planes as the largest needs."""
    values = np.ascontiguousarray(values, dtype="<u8")
    planes = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    rows = values.view(np.uint8).reshape(-1, 8)[:, :planes].T
    return bytes([planes]) + pack_bytes(np.ascontiguousarray(rows).tobytes())


def unpack_ints(data: bytes) -> np.ndarray:
    planes = data[0]
    rows = np.frombuffer(unpack_bytes(data[1:]), dtype=np.uint8).reshape(planes, -1)
    out = np.zeros((rows.shape[1], 8), dtype=np.uint8)
    out[:, :planes] = rows.T
    return out.view("<u8").reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack_ints(np.diff(values, prepend=np.zeros(1, dtype=values.dtype)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(data), dtype=np.uint64)


def pack_parts(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unpack_parts(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    return out


# Blocks

BLOCK = ("task", "block", "ids", "sizes", "data")
MAX_BUCKETS = 50_000
WRITE_BYTES = 16 << 20  # of documents for a task that writes blocks, which it sorts by bucket in memory


def _write(docs: DataFrame, id_col: str, text_col: str, label: str, make: Callable[[bytes, np.ndarray], tuple[np.ndarray, bytes]]) -> DataFrame:
    """(task, block, ids, sizes, data): ``make`` turns a block's bytes and offsets into sizes and data.

    The table is bucketed by the task that wrote a block, the upper half of its number. So each
    task writes one file, and blocks meet their answers without a shuffle of their own.
    """
    source, size = texts(docs, id_col, text_col), input_bytes(docs)
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // WRITE_BYTES))
    source = source.coalesce(tasks)
    kinds = [T.LongType(), T.LongType(), T.ArrayType(source.schema["id"].dataType), T.BinaryType(), T.BinaryType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(BLOCK, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        release()
        arrow, block = to_arrow_schema(schema), TaskContext.get().partitionId() << 32
        ids, sizes, parts, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            at = np.concatenate(([0], np.cumsum(sizes)))
            found, data = make(b"".join(parts), at)
            values = [[block >> 32], [block], [ids], [pack_ints(found)], [data]]
            return pa.record_batch([pa.array(v, type=f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for begin in range(0, batch.num_rows, 128):
                part = batch.slice(begin, 128)
                data, at = utf8_values(part.column(1))
                ids += part.column(0).to_pylist()
                sizes += np.diff(at).tolist()
                parts.append(data[at[0] : at[-1]])
                held += at[-1] - at[0]
                if held >= BLOCK_BYTES or len(ids) > (1 << OWNER_BITS) - 128:
                    yield row()
                    ids, sizes, parts, held, block = [], [], [], 0, block + 1
        if ids:
            yield row()

    return bucketed(source.mapInArrow(run, schema), label, "task", min(MAX_BUCKETS, 4 * tasks))


def write_blocks(docs: DataFrame, id_col: str, text_col: str, label: str) -> DataFrame:
    """The documents as blocks of compressed text."""
    return _write(docs, id_col, text_col, label, lambda data, at: (np.diff(at), pack_bytes(data)))


def write_coded(docs: DataFrame, id_col: str, text_col: str, label: str) -> DataFrame:
    """The documents as blocks of coded words, A-Z lower-cased; sizes count words."""

    def make(data: bytes, at: np.ndarray) -> tuple[np.ndarray, bytes]:
        hashes, sizes = word_hashes(data.lower(), at)
        vocabulary, codes = np.unique(hashes, return_inverse=True)
        return sizes, pack_parts(pack_sorted(vocabulary), pack_ints(codes))

    return _write(docs, id_col, text_col, label, make)


def block_texts(row: dict) -> tuple[bytes, np.ndarray]:
    """(the texts of a block in UTF-8, one after the other; where each begins, and the end)."""
    return unpack_bytes(row["data"]), np.concatenate(([0], np.cumsum(unpack_ints(row["sizes"])))).astype(np.int64)


def block_words(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vocabulary, number into it of each word, words of each text) of a coded block."""
    vocabulary, codes = unpack_parts(row["data"])
    return unpack_sorted(vocabulary), unpack_ints(codes).astype(np.int64), unpack_ints(row["sizes"]).astype(np.int64)


# The exchange

EXCHANGE = T.StructType().add("part", T.IntegerType()).add("block", T.LongType()).add("payload", T.BinaryType())


def send(blocks: DataFrame, make: Callable[[dict], Iterator[tuple]], schema: T.StructType = EXCHANGE) -> DataFrame:
    """Rows of schema, (part, block, payload), that ``make`` yields for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        release()
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _batches(make(batch.slice(i, 1).to_pylist()[0]), arrow)

    return blocks.mapInArrow(run, schema)


def _batches(rows: Iterator[tuple], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, bytes))
        if size >= MESSAGE_BYTES:
            yield _batch(held, arrow)
            held, size = [], 0
    if held:
        yield _batch(held, arrow)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def answer(sent: DataFrame, schema: T.StructType, reply: Callable[[int, list[dict]], Iterator[tuple]]) -> DataFrame:
    """Bring each range's rows together; ``reply`` makes rows of schema out of (part, rows by block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        release()
        rows = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: -1 if r["block"] is None else r["block"])
        yield from _batches(reply(rows[0]["part"], rows), to_arrow_schema(schema))

    return sent.groupBy("part").applyInArrow(run, schema)


def finish(blocks: DataFrame, answers: DataFrame, schema: T.StructType, make: Callable[[dict, list[dict]], Iterator[tuple]]) -> DataFrame:
    """Give each block its answers (in no order); ``make`` yields rows of schema."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, rows = to_arrow_schema(schema), right.to_pylist()
        batches = [b for block in left.to_pylist() for b in _batches(make(block, rows), arrow)]
        return pa.Table.from_batches(batches, schema=arrow)

    dealt = answers.withColumn("task", F.shiftright("block", 32))
    return blocks.groupBy("task", "block").cogroup(dealt.groupBy("task", "block")).applyInArrow(run, schema)
