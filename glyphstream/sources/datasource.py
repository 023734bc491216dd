"""The ``pgs`` data source: tables of subtitle containers.

Options: ``path`` (a file, a folder or a glob; several in ``paths``, one a line), ``table``
(tracks, blocks, packets or stats), ``strategy`` (auto or sequential, for Matroska),
``split_bytes``. Large files are cut into byte ranges that readers align themselves: the
driver only lists files and sizes. Small files share a partition, and so do small ranges: there
are about ``TASKS`` tasks, more where each would hold over 128 MB. Filters on ``track_id`` and
``pts`` reach the readers, and Spark applies them again.

Needs ``spark.sql.python.filterPushdown.enabled``, which ``register`` sets.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import groupby

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .. import schema as S
from . import scan

TABLES = {"tracks": S.TRACKS, "blocks": S.BLOCKS, "packets": S.PACKETS, "stats": S.STATS}
SPLIT_BYTES = 128 * 1024 * 1024
TASKS, TASK_FILES = 64, 1024
BATCH_ROWS, BATCH_BYTES = 4096, 8 * 1024 * 1024


@dataclass
class Ranges(InputPartition):
    """(file, begin, end) of what one task reads."""

    items: tuple[tuple[str, int, int | None], ...]


def files_of(options: dict) -> list[str]:
    """All files named, in order of name; folders give the files they hold."""
    named = [p for p in [options.get("path"), *options.get("paths", "").split("\n")] if p]
    out: list[str] = []
    for p in named:
        p = p.removeprefix("file://")
        found = sorted(glob.glob(p)) if glob.has_magic(p) else [p]
        if not found:
            raise FileNotFoundError(p)
        for f in found:
            out += sorted(e.path for e in os.scandir(f) if e.is_file() and not e.name.startswith((".", "_"))) if os.path.isdir(f) else [f]
    return list(dict.fromkeys(out))


class PgsReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.options = schema, options
        self.table = options.get("table", "blocks")
        self.wanted = scan.Wanted(strategy=options.get("strategy", "auto"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        ids, low, high = None, None, None
        for f in filters:
            name = getattr(f, "attribute", ())
            if name == ("track_id",) and isinstance(f, (EqualTo, In)):
                own = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                ids = own if ids is None else ids & own
            elif name == ("pts",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                low = max(f.value, f.value if low is None else low)
            elif name == ("pts",) and isinstance(f, (LessThan, LessThanOrEqual)):
                high = min(f.value, f.value if high is None else high)
            elif name == ("pts",) and isinstance(f, EqualTo):
                low, high = f.value, f.value
            yield f
        self.wanted = replace(self.wanted, track_ids=ids, low=low, high=high)

    def partitions(self) -> list[Ranges]:
        """Ranges dealt to tasks in the files' order. A task begins a file or goes on anywhere in it; each of its ranges is still read as such."""
        most = int(self.options.get("split_bytes", SPLIT_BYTES))
        files = [(f, os.path.getsize(f)) for f in files_of(self.options)]
        share = -(-sum(own for _, own in files) // TASKS)
        if self.table == "tracks":  # what lists a file's tracks doesn't grow with its size
            full, weighed = min(TASK_FILES, -(-len(files) // TASKS)), [((f, 0, None), 1) for f, _ in files]
        elif self.table == "stats":
            full, weighed = min(SPLIT_BYTES, share), [((f, 0, None), own) for f, own in files]
        else:
            full = max(most, min(SPLIT_BYTES, share))
            weighed = [x for f, own in files for x in (_cut(f, own, most) if own > most else [((f, 0, None), own)])]
        out, held, size = [], [], 0
        for item, own in weighed:
            held.append(item)
            size += own
            if size >= full:
                out.append(Ranges(tuple(held)))
                held, size = [], 0
        return out + ([Ranges(tuple(held))] if held else [])

    def rows(self, name: str, ranges: list[tuple[int, int | None]]) -> Iterator[tuple]:
        with scan.open_reader(name) as reader:
            if self.table == "tracks":
                yield from scan.track_rows(reader, name)
            elif self.table == "stats":
                yield from scan.stats_rows(reader, name, self.wanted)
            else:
                rows = scan.block_rows if self.table == "blocks" else scan.packet_rows
                yield from rows(reader, name, self.wanted, ranges)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        files = groupby(partition.items, lambda item: item[0])
        yield from batches((r for name, items in files for r in self.rows(name, [item[1:] for item in items])), self.schema)


def _cut(name: str, size: int, most: int) -> list[tuple[tuple[str, int, int], int]]:
    """The ranges of a file, with their sizes."""
    return [((name, a, min(size, a + most)), min(size, a + most) - a) for a in range(0, size, most)]


def batches(rows: Iterator[tuple], schema: StructType) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded size."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, held, size = to_arrow_schema(schema), [], 0

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


class PgsDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pgs"

    def schema(self) -> StructType:
        table = self.options.get("table", "blocks")
        if table not in TABLES:
            raise ValueError(f"unknown table {table!r}; there are {', '.join(TABLES)}")
        return TABLES[table]

    def reader(self, schema: StructType) -> PgsReader:
        return PgsReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PgsDataSource)


def load(spark: SparkSession, path: str | list[str], table: str, **options: str):
    """A table of the files at path."""
    register(spark)
    reader = spark.read.format("pgs").option("table", table).options(**{k: str(v) for k, v in options.items()})
    return reader.option("path", path).load() if isinstance(path, str) else reader.option("paths", "\n".join(path)).load()
