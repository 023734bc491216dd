"""Bitmap subtitles (PGS) as Spark DataFrames."""

from __future__ import annotations

from importlib import import_module

__version__ = "0.2.0"

# Loaded when asked for, so that Spark's Python workers import what they use only.
_HOME = {
    "Extractor": "operators.extractor", "list_tracks": "operators.extractor", "extract": "operators.extractor", "extract_all": "operators.extractor",
    "write_sup": "operators.extractor", "write_sup_tables": "operators.extractor", "register": "sources.datasource", "load": "sources.datasource",
    "from_contents": "sources.binary", "Assembler": "functions.codec", "build_display_set": "functions.codec", "decode_rle": "functions.codec",
    "encode_rle": "functions.codec", "parse_pcs": "functions.codec", "parse_wds": "functions.codec", "parse_pds": "functions.codec", "parse_ods": "functions.codec",
    "write_pcs": "functions.codec", "write_wds": "functions.codec", "write_pds": "functions.codec", "write_ods": "functions.codec", "PgsError": "errors",
}
__all__ = sorted(_HOME)


def __getattr__(name: str) -> object:
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f".{_HOME[name]}", __name__), name)
