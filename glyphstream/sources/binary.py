"""Files that only Spark can open: tables out of the rows of ``binaryFile``, or of any (file, content)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import scan
from .datasource import TABLES, batches
from .reader import Reader


def from_contents(files: DataFrame, table: str, *, name_col: str = "path", content_col: str = "content", strategy: str = "auto") -> DataFrame:
    """A source table of whole files held in a column; each must fit a task's memory. Null contents give nothing."""
    schema = TABLES[table]
    wanted = scan.Wanted(strategy=strategy)

    def rows(name: str, content: bytes) -> Iterator[tuple]:
        reader = Reader(content)
        if table == "tracks":
            return scan.track_rows(reader, name)
        if table == "stats":
            return scan.stats_rows(reader, name, wanted)
        return (scan.block_rows if table == "blocks" else scan.packet_rows)(reader, name, wanted)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                content = part.column(1)[i].as_py()
                if content is not None:
                    yield from batches(rows(part.column(0)[i].as_py(), content), schema)

    return files.select(name_col, content_col).mapInArrow(run, schema)
