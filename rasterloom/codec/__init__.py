"""Kernels for what is sequential by nature: byte formats, entropy coding, closed-loop prediction. They know nothing
of Spark; operators and sources call them once for each image or tile."""

from __future__ import annotations

# What can be wrong with an input.
ERRORS = (
    "InvalidMagic", "InvalidVersion", "InvalidHeader", "InvalidChunkType", "InvalidChunkSize", "InvalidBitDepth", "InvalidParameter",
    "TruncatedInput", "UnsupportedFeature", "DecodeFailed", "PredictionError", "RansError", "MetaError", "TypeMismatch", "IoError",
)


class CodecError(ValueError):
    """code is one of ERRORS."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


class Reader:
    """Little-endian numbers from bytes, with a check of the length at each step."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = bytes(data), at
        self.end = len(self.data)

    def take(self, n: int) -> bytes:
        at, end = self.at, self.at + n
        if n < 0 or end > self.end:
            raise CodecError("TruncatedInput", f"{n} bytes at {at} of {self.end}")
        self.at = end
        return self.data[at:end]

    def number(self, n: int, signed: bool = False) -> int:
        at, end = self.at, self.at + n
        if end > self.end:
            raise CodecError("TruncatedInput", f"{n} bytes at {at} of {self.end}")
        self.at = end
        return int.from_bytes(self.data[at:end], "little", signed=signed)

    @property
    def left(self) -> int:
        return self.end - self.at
