"""Failures of extraction; each kind is what the error column shows."""

from __future__ import annotations


class ExtractionError(Exception):
    kind = "extraction"

    def __init__(self, message: str = "", *, cause: BaseException | None = None):
        super().__init__(message or self.kind)
        self.__cause__ = cause


class UnsupportedFormat(ExtractionError):
    kind = "unsupported_format"


class LegacyParsing(ExtractionError):
    kind = "legacy_parsing"


class Encrypted(ExtractionError):
    kind = "encrypted"


class ZipBomb(ExtractionError):
    kind = "zip_bomb"


class Failed(ExtractionError):
    kind = "failed"


class TooLarge(ExtractionError):
    kind = "too_large"

    def __init__(self, actual: int, allowed: int):
        super().__init__(f"{actual} bytes are more than the {allowed} allowed")
        self.actual, self.allowed = actual, allowed
