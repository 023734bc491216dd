"""Benchmark decontamination by one Aho-Corasick automaton.

Texts are lower-cased in A-Z and cut into words of digits, letters a-z and characters beyond
ASCII. Each run of ``size`` consecutive words of a test item is a window (an item with fewer
words, but not none, is one window). All windows go into one automaton, each text is scanned
once, and matches are mapped back to words and to code points of the original text.

The items are the query set: they are few and don't grow with the documents. The driver
reads them and refuses more than MAX_CHARS characters of them (2 GB in UTF-8 at most) before
it does. They reach the executors by broadcast; beyond ``block_chars`` characters of distinct windows they are cut
into blocks, each with an automaton of its own that is built for a batch of documents and
dropped again, so that memory stays bounded. The documents are not shuffled.

Null texts have no words, so nothing of them is hit and a null item has no window. Repeated
rows are scanned as often as they occur, an item_id that repeats counts once, items without
an id are left out. Other columns stay behind in ``scan``; ``drop_contaminated`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._scratch import bound_batches, table, texts, utf8_values

SIZE = 10
BLOCK_CHARS = 20_000_000
MAX_CHARS = 500_000_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def windows(text: str | None, size: int) -> set[str]:
    """The windows of an item, bytes as Latin-1 characters, a space around each word."""
    words = (text or "").encode().translate(LOWER).decode("latin-1").split(" ")
    words = [w for w in words if w]
    runs = [words[i : i + size] for i in range(max(1, len(words) - size + 1))] if words else []
    return {f" {' '.join(run)} " for run in runs}


def blocks_of(items: list[tuple[str, str | None]], size: int, block_chars: int) -> list[list[tuple[str, list[str]]]]:
    """Blocks of (window, ids of the items that have it)."""
    owners: dict[str, set[str]] = {}
    for key, text in items:
        for window in windows(text, size):
            owners.setdefault(window, set()).add(key)
    out, held = [[]], 0
    for window in sorted(owners):
        if held > block_chars:
            out.append([])
            held = 0
        out[-1].append((window, sorted(owners[window])))
        held += len(window)
    return [b for b in out if b]


def automaton_of(block: list[tuple[str, list[str]]]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for window, keys in block:
        automaton.add_word(window, (window.count(" ") - 1, keys))
    automaton.make_automaton()
    return automaton


class Scanner:
    def __init__(self, blocks: list[list[tuple[str, list[str]]]]) -> None:
        self.blocks = blocks
        self.only = automaton_of(blocks[0]) if len(blocks) == 1 else None

    def scan(self, column: pa.Array) -> list[tuple[int, int, list[str], list[tuple[int, int]]]]:
        """(words, words hit, item ids, spans hit in code points) for each text."""
        data, at = utf8_values(column.fill_null(""))
        plain = [data[a:b] for a, b in zip(at, at[1:], strict=False)]
        words, joined, found = [], [], [[] for _ in plain]
        for text in plain:
            parts = text.translate(LOWER).split()
            words.append(len(parts))
            joined.append(f" {b' '.join(parts).decode('latin-1')} " if parts else "")
        for block in self.blocks:
            automaton = self.only or automaton_of(block)
            for i, text in enumerate(joined):
                found[i].extend(automaton.iter(text))
        return [self._result(plain[i], joined[i], words[i], found[i]) if found[i] else (words[i], 0, [], []) for i in range(len(plain))]

    def _result(self, plain: bytes, joined: str, words: int, found: list) -> tuple:
        spaces = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), dtype=np.uint8) == 32)
        step, keys = np.zeros(words + 1, dtype=np.int64), set()
        for end, (length, owners) in found:
            after = int(np.searchsorted(spaces, end))
            step[after - length] += 1
            step[after] -= 1
            keys.update(owners)
        hit = np.cumsum(step[:-1]) > 0
        is_word = np.frombuffer(plain.translate(LOWER), dtype=np.uint8) != 32
        edge = np.diff(np.concatenate(([0], is_word.view(np.int8), [0])))
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        chars = np.concatenate(([0], np.cumsum((np.frombuffer(plain, dtype=np.uint8) & 0xC0) != 0x80)))
        run = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
        first, last = np.flatnonzero(run == 1), np.flatnonzero(run == -1) - 1
        spans = [(int(chars[begins[a]]), int(chars[ends[b]])) for a, b in zip(first, last, strict=True)]
        return words, int(hit.sum()), sorted(keys), spans


def _broadcast(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, size: int, block_chars: int):
    bound_batches(docs.sparkSession)
    known = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).filter("item is not null")
    chars = known.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > MAX_CHARS:
        raise ValueError(f"a benchmark of {chars} characters; at most {MAX_CHARS} are a query set")
    rows = known.collect()
    return docs.sparkSession.sparkContext.broadcast(blocks_of([(r[0], r[1]) for r in rows], size, block_chars))


def scan(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = SIZE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """One row for each document: id, n_words, n_hit, item_ids (as sorted strings), spans (start, end in code points)."""
    shared = _broadcast(docs, benchmark, item_col, item_text_col, size, block_chars)
    source = texts(docs, id_col, text_col)
    schema = T.StructType([T.StructField(id_col, source.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType())])
    schema = schema.add("item_ids", T.ArrayType(T.StringType())).add("spans", T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, scanner = to_arrow_schema(schema), None
        for batch in batches:
            scanner = scanner or Scanner(shared.value)
            got = scanner.scan(batch.column(1))
            spans = [[{"start": a, "end": b} for a, b in g[3]] for g in got]
            columns = [[g[0] for g in got], [g[1] for g in got], [g[2] for g in got], spans]
            yield pa.record_batch([batch.column(0).cast(arrow[0].type), *[pa.array(c, type=f.type) for c, f in zip(columns, list(arrow)[1:], strict=True)]], schema=arrow)

    return source.mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = SIZE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, all columns, of which no word is hit."""
    shared = _broadcast(docs, benchmark, item_col, item_text_col, size, block_chars)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = None
        for batch in batches:
            scanner = scanner or Scanner(shared.value)
            yield batch.filter(pa.array([hit == 0 for _, hit, _, _ in scanner.scan(batch.column(at))], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: what each document shares with the benchmark."""
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM benchmark WHERE item_id IS NOT NULL),
     items AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
               FROM (SELECT item_id, w, least({SIZE}, len(w)) AS n, unnest(range(1, len(w) - least({SIZE}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
     windows AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
                 FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM items) WHERE len(w) >= n)),
     hits AS (SELECT doc_id, i, n, item_id FROM windows JOIN items USING (n, s)),
     hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
     found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""
