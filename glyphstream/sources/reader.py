"""A seekable input that counts the bytes it hands out."""

from __future__ import annotations

import io
import os
from typing import BinaryIO

from ..errors import PgsError


class EndOfInput(PgsError):
    label = "unexpected end of input"


class Reader:
    """Reads, skips and seeks; ``consumed`` has the bytes read, not those skipped or buffered."""

    def __init__(self, source: str | bytes | BinaryIO, buffering: int = 1 << 16) -> None:
        self.path = source if isinstance(source, str) else ""
        self.file: BinaryIO = open(source, "rb", buffering=buffering) if isinstance(source, str) else io.BytesIO(source) if isinstance(source, bytes) else source
        self.size = self.file.seek(0, os.SEEK_END)
        self.file.seek(0)
        self.position = 0
        self.consumed = 0

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def seek(self, position: int) -> None:
        if position != self.position:
            self.file.seek(position)
            self.position = position

    def skip(self, size: int) -> None:
        self.seek(self.position + size)

    def upto(self, size: int) -> bytes:
        """At most size bytes; fewer at the end."""
        data = self.file.read(size)
        self.position += len(data)
        self.consumed += len(data)
        return data

    def exact(self, size: int) -> bytes:
        if size > self.size - self.position:
            raise EndOfInput(f"{size} bytes wanted at {self.position} of {self.size}")
        return self.upto(size)

    def uint(self, size: int) -> int:
        """A big-endian unsigned integer; zero for no bytes."""
        return int.from_bytes(self.exact(size), "big")
