"""Structured Streaming: files that arrive, assembled as their segments come in."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schema as S
from ..functions import codec
from ..plans import assemble as A
from ..sources import binary

FILES = T.StructType().add("path", T.StringType()).add("modificationTime", T.TimestampType()).add("length", T.LongType()).add("content", T.BinaryType())
ONE = T.StructType().add("seg_seq", T.LongType()).add("pts", T.LongType()).add("dts", T.LongType()).add("segment_type", T.StringType()).add("payload", T.BinaryType())
SETS = T.StructType().add("file", T.StringType()).add("track_id", T.LongType()).add("set_seq", T.LongType()).add("index", T.LongType()).add("pts", T.LongType()).add("pts_ms", T.DoubleType())
SETS = SETS.add("composition_state", T.StringType()).add("segments", T.ArrayType(ONE))
STATE = T.StructType().add("emitted", T.LongType()).add("open", T.ArrayType(ONE))


def arriving_segments(spark: SparkSession, folder: str, *, glob: str = "*.sup") -> DataFrame:
    """A stream of the segments of files that appear in a folder; each file is read once."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).schema(FILES).load(folder)
    return A.segments(binary.from_contents(files, "blocks"))


def _push(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState, forget_after_ms: int | None = None) -> Iterator[pd.DataFrame]:
    """Assemble one track's new segments, in order of their numbers, after what is still open."""
    emitted, open_ = state.get if state.exists else (0, [])
    assembler = codec.Assembler()
    held = [tuple(s) for s in open_ or []]
    rows = pd.concat(list(parts)).sort_values("seg_seq", kind="stable") if not state.hasTimedOut else pd.DataFrame(columns=S.SEGMENTS.fieldNames())
    arrived = held + [(int(r.seg_seq), int(r.pts), int(r.dts), r.segment_type, r.payload) for r in rows.itertuples()]
    out, since = [], []
    for seq, pts, dts, kind, payload in arrived:
        since = [] if kind == "PCS" else since
        since.append((seq, pts, dts, kind, payload))
        done = assembler.push(pts, dts, kind, payload)
        if done is not None:
            listed = [dict(zip(ONE.fieldNames(), s, strict=True)) for s in since]
            out.append((*key, since[0][0], emitted, done[0][0], done[0][0] / 90.0, codec.state_of(done[0][3]), listed))
            emitted += 1
    if state.hasTimedOut:
        state.remove()
    else:
        # What is open waits for its END; the next PCS of the track discards it.
        state.update((emitted, [s for s in since if assembler.open]))
        if forget_after_ms is not None:
            state.setTimeoutDuration(forget_after_ms)
    if out:
        yield pd.DataFrame(out, columns=SETS.fieldNames())


def assemble_stream(segments: DataFrame, forget_after_ms: int | None = None) -> DataFrame:
    """Display sets of a stream of segments, emitted as soon as they are complete.

    State is the open set of each track and its count of sets. ``forget_after_ms`` drops it so
    long after a track's last segment; the query then runs batches all the time, as Spark does
    for processing-time timeouts.
    """
    timeout = GroupStateTimeout.NoTimeout if forget_after_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return segments.groupBy("file", "track_id").applyInPandasWithState(partial(_push, forget_after_ms=forget_after_ms), SETS, STATE, "append", timeout)


def counts_by_track(sets: DataFrame) -> DataFrame:
    """A running count of each track's sets."""
    return sets.groupBy("file", "track_id").agg(F.count(F.lit(1)).alias("display_sets"), F.max("pts").alias("last_pts"))
