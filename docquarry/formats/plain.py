"""Text as it is: only its encoding is found out."""

from __future__ import annotations

from collections.abc import Iterator

from .record import Document, Unit


def detect(data: bytes) -> tuple[str, str]:
    """Text and the name of its encoding."""
    if not data:
        return "", "utf-8"
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        from_bytes = None
    best = from_bytes(data).best() if from_bytes else None
    if best is not None:
        return str(best), best.encoding
    try:
        text = data.decode("ascii")
        return text, "ascii"
    except UnicodeDecodeError:
        return data.decode("utf-8", "replace"), "utf-8"


def read(data: bytes, path: str | None = None) -> Iterator[Document]:
    text, encoding = detect(data)
    yield Document("plain", text.strip(), [Unit(1, text.strip())], detected_encoding=encoding)
