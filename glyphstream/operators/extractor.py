"""The programming surface: open files, list tracks, extract display sets, write them."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidPgs, NoPgsTracks
from ..functions.language import normalize_language
from ..plans import assemble as A
from ..sources import datasource

# Blocks this far outside of a time range are still read, so that sets at its edges are whole.
MARGIN_MS = 60_000.0


def list_tracks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """schema.TRACKS of the files: nothing for a transport stream without PGS, an error for Matroska."""
    found = datasource.load(spark, path, "tracks")
    return found.withColumn("language", normalize_language(F.col("language"), spark))


@dataclass(frozen=True)
class Extractor:
    """Settings of an extraction; each ``with_`` method gives another one, in any order.

    DataFrames are lazy: nothing is read before an action.
    """

    spark: SparkSession
    path: str | list[str]
    strategy: str = "auto"
    track_ids: tuple[int, ...] = ()
    start_ms: float | None = None
    end_ms: float | None = None
    split_bytes: int = datasource.SPLIT_BYTES
    history: list[Row] | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str | list[str], **options) -> Extractor:
        """Fails where a file's container is unknown or has no PGS tracks."""
        out = cls(spark, path, history=[], **options)
        if not list_tracks(spark, path).take(1):
            raise NoPgsTracks(str(path))
        return out

    def with_strategy(self, strategy: str) -> Extractor:
        """auto (what cues point to, where there are cues) or sequential; only Matroska has a choice."""
        return replace(self, strategy=strategy)

    def with_tracks(self, *track_ids: int) -> Extractor:
        """Only these tracks; none given: all. Unknown ids give nothing."""
        return replace(self, track_ids=tuple(track_ids))

    def with_time_range(self, start_ms: float | None, end_ms: float | None) -> Extractor:
        return replace(self, start_ms=start_ms, end_ms=end_ms)

    def _only(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col("track_id").isin(*self.track_ids)) if self.track_ids else df

    def tracks(self) -> DataFrame:
        return self._only(list_tracks(self.spark, self.path))

    def _load(self, table: str) -> DataFrame:
        return datasource.load(self.spark, self.path, table, strategy=self.strategy, split_bytes=self.split_bytes)

    def blocks(self, *, errors: bool = False) -> DataFrame:
        """Blocks of the wanted tracks; the time range, with a margin, is pushed to the reader."""
        found = self._load("blocks")
        broken = found.filter("error is not null")
        found = self._only(found.filter("data is not null"))
        pes = A.reassemble_pes(self._only(self._load("packets")))
        found = found.unionByName(pes)
        if self.start_ms is not None:
            found = found.filter(F.col("pts") >= int((self.start_ms - MARGIN_MS) * 90))
        if self.end_ms is not None:
            found = found.filter(F.col("pts") <= int((self.end_ms + MARGIN_MS) * 90) + 1)
        return found.unionByName(broken) if errors else found

    def errors(self) -> DataFrame:
        """(file, position, error) of files that broke off."""
        return self._load("blocks").filter("error is not null").select("file", F.col("block_seq").alias("position"), "error")

    def segments(self) -> DataFrame:
        return A.segments(self.blocks())

    def display_sets(self) -> DataFrame:
        """Sets in the time range, numbered from zero in each track, with language and container."""
        sets = A.numbered(A.in_time(A.assemble(self.segments()), self.start_ms, self.end_ms))
        known = self.tracks().select("file", "track_id", "language", "container", F.col("ordinal"))
        # The catalogue has a row a track; Spark broadcasts it while it is small.
        return sets.join(known, ["file", "track_id"])

    def structured(self, *, raw: bool = False, decode: bool = True) -> DataFrame:
        return A.project(self.display_sets(), raw=raw, decode=decode)

    def in_order(self) -> DataFrame:
        """All tracks of a file interleaved, as its blocks stand."""
        return self.display_sets().orderBy("file", "set_seq", "track_id")

    def __iter__(self) -> Iterator[Row]:
        """Rows in the files' order, remembered in ``history``; an error of a source comes last."""
        for row in self.in_order().toLocalIterator():
            if self.history is not None:
                self.history.append(row)
            yield row
        broken = self.errors().first()
        if broken is not None:
            raise InvalidPgs(f"{broken.file}: {broken.error}")

    def take(self, n: int) -> list[Row]:
        return self.in_order().limit(n).collect()

    def history_for_track(self, track_id: int) -> list[Row]:
        return [r for r in self.history or [] if r.track_id == track_id]

    def drain_history(self) -> list[Row]:
        out = list(self.history or [])
        self.clear_history()
        return out

    def clear_history(self) -> None:
        if self.history is not None:
            self.history.clear()

    def collect_by_track(self) -> list[tuple[Row, list[Row]]]:
        """(track, its sets in order) in the order in which tracks are listed; tracks without sets are left out."""
        sets: dict[tuple, list[Row]] = {}
        for row in self.display_sets().orderBy("file", "track_id", "index").collect():
            sets.setdefault((row.file, row.track_id), []).append(row)
        listed = self.tracks().orderBy("file", "ordinal").collect()
        return [(t, sets[t.file, t.track_id]) for t in listed if (t.file, t.track_id) in sets]

    def stats(self) -> DataFrame:
        """schema.STATS: file size and the bytes that reading the wanted blocks consumes."""
        return self._only_stats(self._load("stats"))

    def _only_stats(self, df: DataFrame) -> DataFrame:
        return df.withColumn("read_percent", F.when(F.col("file_size") > 0, F.col("bytes_read") / F.col("file_size") * 100.0).otherwise(0.0))

    def counts(self) -> DataFrame:
        """Display sets and segments of each track."""
        return self.display_sets().groupBy("file", "track_id").agg(F.count(F.lit(1)).alias("display_sets"), F.sum(F.size("segments")).alias("segments"))

    def bench(self) -> dict:
        """What the bench report has."""
        began = time.perf_counter()
        counts = {(r.file, r.track_id): r for r in self.counts().collect()}
        stats = self.stats().collect()
        return {
            "strategy": self.strategy,
            "file_size": sum(r.file_size for r in stats),
            "bytes_read": sum(r.bytes_read for r in stats),
            "tracks": [(t, counts.get((t.file, t.track_id))) for t in self.tracks().orderBy("file", "ordinal").collect()],
            "seconds": time.perf_counter() - began,
        }


def extract_all(spark: SparkSession, path: str) -> list[tuple[Row, list[Row]]]:
    return Extractor.open(spark, path).collect_by_track()


def extract(spark: SparkSession, path: str, track_id: int | None = None) -> DataFrame:
    """The sets of one track; by default of the first that the container lists."""
    opened = Extractor.open(spark, path)
    chosen = opened.tracks().orderBy("file", "ordinal").first().track_id if track_id is None else track_id
    return opened.with_tracks(chosen).display_sets()


def track_path(output: str, track_id: int) -> str:
    """out.sup to out_track3.sup."""
    stem, extension = os.path.splitext(output)
    return f"{stem}_track{track_id}{extension or '.sup'}"


def write_sup(sets: DataFrame, output: str) -> dict[int, tuple[str, int, int]]:
    """Write each track's sets in order: to output if there is one track, else a file for each.

    A file is written on the driver as its rows arrive, one partition at a time. Gives the
    path, sets and bytes by track; without any set nothing is written.
    """
    rows = A.sup_of(sets).select("track_id", "set_seq", "sup", *([F.col("file")] if "file" in sets.columns else []))
    order = [c for c in ("track_id", "file", "set_seq") if c in rows.columns]
    tracks = [r.track_id for r in rows.select("track_id").distinct().orderBy("track_id").collect()]
    paths = {t: output if len(tracks) == 1 else track_path(output, t) for t in tracks}
    out, at, handle = {}, None, None
    try:
        for row in rows.orderBy(*order).toLocalIterator():
            if row.track_id != at:
                if handle is not None:
                    handle.close()
                at, handle = row.track_id, open(paths[row.track_id], "wb")
                out[at] = (paths[at], 0, 0)
            handle.write(row.sup)
            out[at] = (paths[at], out[at][1] + 1, out[at][2] + len(row.sup))
    finally:
        if handle is not None:
            handle.close()
    return out


def write_sup_tables(sets: DataFrame, path: str) -> None:
    """The same at scale: (track_id, set_seq, sup) as Parquet, partitioned by track and sorted within files."""
    rows = A.sup_of(sets).select("file", "track_id", "set_seq", "sup")
    rows.repartition("file", "track_id").sortWithinPartitions("file", "track_id", "set_seq").write.partitionBy("track_id").parquet(path)
