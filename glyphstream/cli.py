"""Command line: tracks, extract, stream, encode, bench."""

from __future__ import annotations

import argparse
import os
import re
import sys
import tempfile
from collections.abc import Sequence
from typing import TextIO

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import PgsError
from .functions.codec import parse_timestamp, parse_track_ids
from .operators import ndjson
from .operators.extractor import Extractor, list_tracks, write_sup

MIB = 1024 * 1024


def _milliseconds(text: str) -> float:
    found = parse_timestamp(text)
    if found is None:
        raise argparse.ArgumentTypeError(f"invalid timestamp {text!r}")
    return found


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="glyphstream", description="Bitmap subtitles in Matroska, M2TS, transport streams and .sup files.")
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb, text in (("tracks", "list the PGS tracks"), ("extract", "write tracks as .sup files"), ("stream", "print display sets as JSON lines"), ("bench", "report how much of the file is read")):
        sub = verbs.add_parser(verb, help=text)
        sub.add_argument("file")
        if verb in ("extract", "stream"):
            sub.add_argument("-t", "--track", action="append", default=[], metavar="ID[,ID]")
            sub.add_argument("--start", type=_milliseconds)
            sub.add_argument("--end", type=_milliseconds)
        if verb == "extract":
            sub.add_argument("-o", "--output", required=True)
        if verb == "stream":
            sub.add_argument("--raw-payloads", action="store_true")
        if verb == "bench":
            sub.add_argument("-s", "--strategy", choices=("auto", "sequential"), default="auto")
    verbs.add_parser("encode", help="JSON lines on standard input to .sup files").add_argument("-o", "--output", required=True)
    return top


def _describe(t) -> str:  # noqa: ANN001
    extras = [f'name="{t.name}"'] if t.name is not None else []
    extras += ["default"] * (t.is_default is True) + ["forced"] * (t.is_forced is True)
    extras += [f"display_sets={t.display_set_count}"] if t.display_set_count is not None else []
    extras += [f"has_cues={str(t.indexed).lower()}"] if t.indexed is not None else []
    return ", ".join([f"  Track {t.track_id}: language={t.language or 'unknown'}, format={t.container}", *extras])


def tracks(spark: SparkSession, args: argparse.Namespace, out: TextIO) -> None:
    found = list_tracks(spark, args.file).orderBy("ordinal").collect()
    print("PGS tracks found:" if found else "No PGS tracks found.", *map(_describe, found), sep="\n", file=out)


def _opened(spark: SparkSession, args: argparse.Namespace) -> Extractor:
    ids = [i for text in args.track for i in parse_track_ids(text)]
    return Extractor.open(spark, args.file).with_tracks(*ids).with_time_range(args.start, args.end)


def _written(found: dict[int, tuple[str, int, int]]) -> str:
    return "\n".join(f"Track {t}: {n} display sets, {size} bytes, {path}" for t, (path, n, size) in found.items())


def extract(spark: SparkSession, args: argparse.Namespace, out: TextIO) -> None:
    found = write_sup(_opened(spark, args).display_sets(), args.output)
    print(_written(found) or "No display sets found.", file=out)


def stream(spark: SparkSession, args: argparse.Namespace, out: TextIO) -> None:
    opened = _opened(spark, args)
    try:
        print(ndjson.tracks_line(opened.tracks()).first().value, file=out, flush=True)
        lines = ndjson.to_json_lines(opened.structured(raw=args.raw_payloads), raw=args.raw_payloads)
        for row in lines.orderBy("set_seq", "track_id").toLocalIterator():
            print(row.value, file=out, flush=True)
    except BrokenPipeError:
        return  # the consumer has had enough
    broken = opened.errors().first()
    if broken is not None:
        raise PgsError(broken.error)


def encode(spark: SparkSession, args: argparse.Namespace, out: TextIO, source: TextIO = sys.stdin) -> None:
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "lines.ndjson")
        with open(path, "w") as f:
            f.writelines(source)
        parsed = ndjson.parse_lines(ndjson.read_lines(spark, path)).persist()
        try:
            ndjson.raise_errors(parsed)
            found = write_sup(ndjson.encoded(parsed), args.output)
            print(_written(found) or "No display sets found in input.", file=out)
            for row in parsed.filter("kind = 'unknown'").orderBy("line").toLocalIterator():
                print(f"line {row.line}: {row.error}", file=sys.stderr)
            skipped = parsed.agg(F.count_if(F.col("kind") == "skipped")).first()[0]
            if skipped:
                print(f"Skipped {skipped} display sets with null composition", file=sys.stderr)
        finally:
            parsed.unpersist()


def bench(spark: SparkSession, args: argparse.Namespace, out: TextIO) -> None:
    found = Extractor.open(spark, args.file).with_strategy(args.strategy).bench()
    size, read = found["file_size"], found["bytes_read"]
    lines = [f"File:          {args.file}", f"Strategy:      {args.strategy}", f"File size:     {size} ({size / MIB:.2f} MB)", f"Bytes read:    {read} ({read / MIB:.2f} MB)"]
    lines += [f"Read ratio:    {100 * read / size if size else 0:.2f}%", f"Tracks:        {len(found['tracks'])}"]
    lines += [f"  Track {t.track_id} ({t.language or 'unknown'}): {c.display_sets} display sets, {c.segments} segments" for t, c in found["tracks"] if c]
    lines.append(f"Total:         {sum(c.display_sets for _, c in found['tracks'] if c)} display sets, {sum(c.segments for _, c in found['tracks'] if c)} segments")
    print(*lines, f"Time:          {found['seconds']:.3f}s", sep="\n", file=out)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, out: TextIO | None = None, source: TextIO | None = None) -> int:
    args, out = parser().parse_args(argv), out or sys.stdout
    spark = spark or SparkSession.builder.appName("glyphstream").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        if args.verb == "encode":
            encode(spark, args, out, source or sys.stdin)
        else:
            {"tracks": tracks, "extract": extract, "stream": stream, "bench": bench}[args.verb](spark, args, out)
    except (PgsError, OSError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    except PySparkException as e:
        # A reader's own error is the last line of its trace that names one.
        named = [x.strip() for x in str(e).splitlines() if re.match(r"\s*[\w.]*(Error|errors\.\w+|Pgs\w*): ", x)]
        print(f"Error: {named[-1] if named else str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
