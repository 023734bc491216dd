"""Which container a file is."""

from __future__ import annotations

from ..errors import UnknownFormat
from . import ts
from .reader import Reader

EBML_MAGIC = bytes.fromhex("1A45DFA3")


def detect(reader: Reader) -> str:
    """Matroska, M2TS, TransportStream or SUP; needs five bytes."""
    reader.seek(0)
    magic = reader.exact(5)
    reader.seek(0)
    if magic[:4] == EBML_MAGIC:
        return "Matroska"
    if ts.SYNC in (magic[0], magic[4]) and (layout := ts.detect_layout(reader)) is not None:
        return layout.container
    if magic[:2] == b"PG":
        return "SUP"
    raise UnknownFormat(reader.path)
