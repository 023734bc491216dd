"""Exact deduplication by two-pass Bloom filtering.

Pass one adds every text's digest to a Bloom filter whose slots count to two. Each task fills
its own share of the filter and sends, for each range of slots, those that it met, packed; a
range merges what all tasks sent into bitmaps. No row is sent. Pass two asks the filter about
each row: rows that hit a slot met once only are certainly unique and pass straight through;
the others, true copies and a few false alarms, shuffle by their SHA-256, which alone decides.

The filter has BITS_PER_ROW bits for each row up to MAX_BITS, the bound of the broadcast
(64 MB). Beyond 32 million rows it fills up and lets more false alarms through: 5 % of the
rows that are unique at 70 million rows, half at 280 million. The result stays the same.

Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal
texts the row with the largest id stays. Null ids sort below all others. Rows that agree in
text and id are one document: they stay or go together. Columns of the input that are named
like a result column are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._blocks import pack_bytes, pack_parts, pack_sorted, unpack_bytes, unpack_parts, unpack_sorted
from ._scratch import bound_batches, input_bytes, materialise, table, utf8_values, width

MAX_BITS = 1 << 29
RANGE_BITS = 1 << 22
BITS_PER_ROW = 16
HASHES = 3
TASK_ROWS = 500_000
RESULT = ("keep_id", "group_size", "kept", "text_sha256")
MET = T.StructType().add("part", T.IntegerType()).add("payload", T.BinaryType())


def digests(column: pa.Array) -> list[bytes]:
    """SHA-256 of each text in UTF-8, A-Z lower-cased."""
    data, at = utf8_values(pc.ascii_lower(pc.fill_null(column, "")))
    view = memoryview(data)
    return [hashlib.sha256(view[a:b]).digest() for a, b in zip(at, at[1:], strict=False)]


def filter_bits(rows: int, max_bits: int = MAX_BITS) -> int:
    """The next power of two of BITS_PER_ROW bits a row, at least 1024 and at most max_bits."""
    return min(max_bits, 1 << max(10, (BITS_PER_ROW * max(1, rows) - 1).bit_length()))


def slots(found: list[bytes], bits: int) -> np.ndarray:
    """The slots of each digest, a row for each of HASHES."""
    words = np.frombuffer(b"".join(found), dtype=">u8").reshape(-1, 4)[:, :HASHES]
    return (words & np.uint64(bits - 1)).astype(np.uint64).T


def _met(met: np.ndarray, range_bits: int) -> Iterator[tuple[int, bytes]]:
    """(range, its slots and which of them were met more than once)."""
    found, count = np.unique(met, return_counts=True)
    part = (found // np.uint64(range_bits)).astype(np.int64)
    for own in np.unique(part).tolist():
        mine = slice(*np.searchsorted(part, (own, own + 1)))
        yield own, pack_parts(pack_sorted(found[mine] % np.uint64(range_bits)), pack_bytes(np.packbits(count[mine] > 1).tobytes()))


def _merged(payloads: Iterator[bytes], range_bits: int) -> np.ndarray:
    """The bitmap of a range: slots met at least twice."""
    once, twice = np.zeros((2, range_bits), dtype=bool)
    for payload in payloads:
        found, more = unpack_parts(payload)
        found = unpack_sorted(found).astype(np.int64)
        twice[found] |= once[found] | np.unpackbits(np.frombuffer(unpack_bytes(more), dtype=np.uint8), count=len(found)).astype(bool)
        once[found] = True
    return np.packbits(twice)


def repeated_filter(docs: DataFrame, text_col: str, bits: int) -> np.ndarray:
    """The bitmap, eight slots a byte, of slots that are met at least twice."""
    range_bits = min(bits, RANGE_BITS)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def sent() -> pa.RecordBatch:
            parts, payloads = zip(*_met(np.concatenate(held, axis=None), range_bits), strict=True)
            return pa.record_batch([pa.array(parts, type=pa.int32()), pa.array(payloads, type=pa.binary())], names=MET.fieldNames())

        for batch in batches:
            if batch.num_rows:
                held.append(slots(digests(batch.column(0)), bits))
                rows += batch.num_rows
            if rows >= TASK_ROWS:
                yield sent()
                held, rows = [], 0
        if held:
            yield sent()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None

        def payloads() -> Iterator[bytes]:
            nonlocal part
            for batch in batches:
                part = batch.column(0)[0].as_py()
                yield from batch.column(1).to_pylist()

        bitmap = _merged(payloads(), range_bits).tobytes()
        yield pa.record_batch([pa.array([part], type=pa.int32()), pa.array([bitmap], type=pa.binary())], names=MET.fieldNames())

    met = docs.select(text_col).mapInArrow(meet, MET)
    bitmap = np.zeros(bits // 8, dtype=np.uint8)
    for row in met.groupBy("part").applyInArrow(merge, MET).toLocalIterator():
        begin = row.part * range_bits // 8
        bitmap[begin : begin + range_bits // 8] = np.frombuffer(row.payload, dtype=np.uint8)
    return bitmap


def asked(docs: DataFrame, text_col: str, columns: list[str], bitmap: np.ndarray, bits: int) -> DataFrame:
    """``columns`` of docs with __gs_sha, the digest, and __gs_maybe: whether all of its slots are set."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    schema = T.StructType([docs.schema[c] for c in columns]).add("__gs_sha", T.BinaryType()).add("__gs_maybe", T.BooleanType())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, words = to_arrow_schema(schema), shared.value
        for batch in batches:
            found = digests(batch.column(0))
            hit = np.ones(len(found), dtype=bool)
            for slot in slots(found, bits) if found else ():
                hit &= (words[slot >> np.uint64(3)] << (slot & np.uint64(7)).astype(np.uint8)) & 0x80 != 0
            yield pa.record_batch([*batch.columns[1:], pa.array(found, type=pa.binary()), pa.array(hit)], schema=arrow)

    return docs.select(F.col(text_col).alias("__gs_text"), *columns).mapInArrow(probe, schema)


def mark_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, columns: list[str] | None = None) -> DataFrame:
    """The rows of docs with keep_id, group_size, kept and text_sha256.

    ``columns`` are carried along, all by default. Where the text isn't among them, pass two
    writes them once with their digests, and the rest reads that small table.
    """
    bound_batches(docs.sparkSession)
    carried = [c for c in columns or docs.columns if c not in RESULT]
    bits, size = filter_bits(docs.count(), max_bits), input_bytes(docs)
    found = asked(docs, text_col, list(dict.fromkeys([*carried, id_col])), repeated_filter(docs, text_col, bits), bits)
    if text_col not in carried:
        found = materialise(found, "digests", size)
    sha = F.lower(F.hex("__gs_sha")).alias("text_sha256")
    alone = found.filter(~F.col("__gs_maybe")).select(*carried, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    maybe = found.filter("__gs_maybe").drop("__gs_maybe")
    groups = materialise(maybe.groupBy("__gs_sha").agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "copies", size)
    resolved = maybe.join(groups, "__gs_sha").select(*carried, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), sha)
    return alone.unionByName(resolved).coalesce(2 * width(docs.sparkSession, size))


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows that stay, with the columns of docs; those named like result columns are set aside meanwhile."""
    clash = {c: f"__gs_in_{c}" for c in docs.columns if c in RESULT}
    kept = mark_copies(docs.withColumnsRenamed(clash), **options).filter("kept")
    return kept.select(*[F.col(clash.get(c, c)).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document with the row that stays for it."""
    docs = table(spark, sf_dir, "documents")
    return mark_copies(docs, columns=["doc_id"]).select("doc_id", *RESULT)


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
"""
