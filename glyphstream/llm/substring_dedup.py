"""Substring deduplication: repeated windows of ``size`` words are cut out.

Rabin-Karp hashes of all windows are counted over the whole corpus. Each block of documents
sends its distinct hashes, sorted and packed, to the ranges of hashes; a range answers which
of them start more than once. Overlapping and touching windows then merge into maximal
intervals of words to remove. All starts count, those in the same text and all copies too;
windows are judged on the input, not on what is left.

Words are what stands between ASCII white space, unchanged. Hashes have 64 bits, random for
each word: windows that differ in one word never collide, others with odds of 2**-64 a pair.
A null text has no words; texts with fewer words than a window lose nothing; repeated rows
repeat all their windows; null ids are carried along; other columns stay behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._blocks import EXCHANGE, answer, block_texts, finish, pack_bytes, pack_sorted, places, ranges_of, rolling, send, unpack_bytes, unpack_sorted, word_hashes, write_blocks
from ._scratch import exchange_ranges, input_bytes, materialise, table, width

SIZE = 35


def _windows(data: bytes, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all windows, the words where they start, words of each text)."""
    words, sizes = word_hashes(data, at)
    owner, place = places(sizes)
    starts = np.flatnonzero(place + size <= sizes[owner]) if len(words) else np.zeros(0, np.int64)
    return rolling(words, size)[starts] if len(starts) else np.zeros(0, np.uint64), starts, sizes


def _keys(row: dict, size: int, parts: int) -> Iterator[tuple[int, int, bytes]]:
    hashes, _, _ = _windows(*block_texts(row), size)
    keys, count = np.unique(hashes, return_counts=True)
    at = ranges_of(keys, parts)
    for part in np.flatnonzero(np.diff(at)).tolist():
        own = slice(at[part], at[part + 1])
        payload = pack_sorted(keys[own])
        yield part, row["block"], len(payload).to_bytes(8, "little") + payload + pack_bytes(np.packbits(count[own] > 1).tobytes())


def _repeated(part: int, rows: list[dict]) -> Iterator[tuple[int, int, bytes]]:
    keys, twice = [], []
    for row in rows:
        size = int.from_bytes(row["payload"][:8], "little")
        keys.append(unpack_sorted(row["payload"][8 : 8 + size]))
        twice.append(np.unpackbits(np.frombuffer(unpack_bytes(row["payload"][8 + size :]), dtype=np.uint8))[: len(keys[-1])])
    joined = np.concatenate(keys)
    order = np.argsort(joined)
    ordered = joined[order]
    same = ordered[1:] == ordered[:-1]
    group = np.concatenate(([0], np.cumsum(~same)))
    flag = np.concatenate(twice)[order].astype(bool)
    flag[1:] |= same
    flag[:-1] |= same
    found = np.empty(len(joined), dtype=bool)
    found[order] = (np.bincount(group, weights=flag) > 0)[group]
    at = 0
    for row, own in zip(rows, keys, strict=True):
        yield part, row["block"], pack_bytes(np.packbits(found[at : at + len(own)]).tobytes())
        at += len(own)


def _cut(block: dict, answers: list[dict], size: int, parts: int) -> Iterator[tuple]:
    data, texts_at = block_texts(block)
    hashes, starts, sizes = _windows(data, texts_at, size)
    keys, at_key = np.unique(hashes, return_inverse=True)
    at = ranges_of(keys, parts)
    repeated = np.zeros(len(keys), dtype=bool)
    for row in answers:
        own = slice(at[row["part"]], at[row["part"] + 1])
        bits = np.unpackbits(np.frombuffer(unpack_bytes(row["payload"]), dtype=np.uint8))
        repeated[own] = bits[: own.stop - own.start].astype(bool)
    hit = starts[repeated[at_key]]
    step = np.bincount(hit, minlength=int(sizes.sum()) + 1) - np.bincount(hit + size, minlength=int(sizes.sum()) + 1)
    removed = np.cumsum(step[:-1]) > 0
    begin = 0
    for key, a, b in zip(block["ids"], texts_at.tolist(), texts_at[1:].tolist(), strict=False):
        words = data[a:b].split()
        mask = removed[begin : begin + len(words)]
        begin += len(words)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
        spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
        kept = words if not spans else [w for w, gone in zip(words, mask.tolist(), strict=True) if not gone]
        yield key, len(words), len(words) - len(kept), b" ".join(kept), spans


def cut_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """id, n_words, n_removed, kept (words joined by one space, UTF-8), removed (word intervals)."""
    total, blocks = input_bytes(docs), write_blocks(docs, id_col, text_col, "substrings")
    parts = exchange_ranges(total)
    answers = materialise(answer(send(blocks, lambda row: _keys(row, size, parts)), EXCHANGE, _repeated), "repeats", total)
    id_type = blocks.schema["ids"].dataType.elementType
    schema = T.StructType().add(id_col, id_type).add("n_words", T.LongType()).add("n_removed", T.LongType()).add("kept", T.BinaryType())
    schema = schema.add("removed", T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType())))
    return finish(blocks, answers, schema, lambda block, rows: _cut(block, rows, size, parts)).coalesce(width(docs.sparkSession, total))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: what is left of every document."""
    cut = cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     windows AS (SELECT doc_id, i, array_to_string(w[i:i + {SIZE - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SIZE - 2})) AS i FROM d)),
     repeated AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
     gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {SIZE})) AS p FROM windows JOIN repeated USING (s)),
     words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
     kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
