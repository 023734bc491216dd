"""Errors of sources, decoders and encoders."""


class PgsError(Exception):
    """Base of all errors that this package raises about its input."""

    label = "error"

    def __str__(self) -> str:
        detail = super().__str__()
        return f"{self.label}: {detail}" if detail else self.label


class InvalidEbml(PgsError):
    label = "invalid EBML"


class InvalidVint(InvalidEbml):
    label = "invalid variable-length integer"


class InvalidMkv(PgsError):
    label = "invalid Matroska"


class InvalidTs(PgsError):
    label = "invalid transport stream"


class InvalidPgs(PgsError):
    label = "invalid PGS data"


class NoPgsTracks(PgsError):
    label = "no PGS tracks found"


class UnknownFormat(PgsError):
    label = "unknown container format"


class EncodingError(PgsError):
    label = "encoding error"
