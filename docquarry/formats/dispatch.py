"""From a type key to its reader, and whole files to documents."""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable, Iterator

from ..errors import Encrypted, ExtractionError, Failed, TooLarge, UnsupportedFormat
from ..routing import READERS, file_type
from .record import Document

MAX_FILE_SIZE = 100 << 20

_WHERE = {
    "docx": "word.read", "xlsx": "sheets.read", "pptx": "slides.read",
    "doc": "word_binary.read", "xls": "sheets_binary.read", "ppt": "slides_binary.read", "rtf": "rtf.read",
    "odt": "opendocument.read_odt", "ods": "opendocument.read_ods", "odp": "opendocument.read_odp", "odg": "opendocument.read_odg", "odf": "opendocument.read_odf",
    "eml": "mail.read_eml", "mbox": "mail.read_mbox", "mhtml": "mail.read_mhtml", "msg": "mail_binary.read",
    "plain": "plain.read", "pdf": "pdf.read", "html": "html.read", "epub": "epub.read", "archive": "archive.read",
}

_OWN: dict[str, "Reader"] = {}

Reader = Callable[[bytes, "str | None"], Iterator[Document]]


def reader(kind: str | None) -> Reader:
    """The reader of a type key; its module is loaded at its first use."""
    if kind in _OWN:
        return _OWN[kind]
    if kind not in READERS:
        raise UnsupportedFormat(f"no reader for {kind}")
    module, _, name = _WHERE[READERS[kind]].partition(".")
    return getattr(importlib.import_module(f".{module}", __package__), name)


def read_as(kind: str | None, data: bytes, path: str | None = None) -> Iterator[Document]:
    """Documents of a file of known type; whatever goes wrong is an ExtractionError."""
    read = reader(kind)
    try:
        for doc in read(data, path):
            doc.path = doc.path or path
            yield doc
    except ExtractionError:
        raise
    except Exception as error:
        raise Failed(f"{type(error).__name__}: {error}", cause=error) from error


def _named(kind: str) -> Reader:
    def read(data: bytes, path: str | None = None) -> Iterator[Document]:
        return read_as(kind, data, path)

    read.__name__ = read.__qualname__ = f"read_{kind}"
    read.__doc__ = f"Documents of a {kind} file's bytes, whatever its name."
    return read


#: read_docx, read_xlsx, ...: a reader by name for every type key.
BY_NAME: dict[str, Reader] = {f"read_{kind}": _named(kind) for kind in READERS}


def __getattr__(name: str) -> Reader:
    try:
        return BY_NAME[name]
    except KeyError:
        raise AttributeError(name) from None


def register_reader(name: str, read: Reader, suffixes: str) -> None:
    """A reader of one's own, for this process, under a type key and for suffixes (divided by
    blanks). Workers have it where the module that registers it is imported by them."""
    from .. import routing

    routing.add_type(name, suffixes.split())
    _OWN[name] = read


def get_extractor(path: str) -> Reader:
    kind = file_type(path)
    if kind is None:
        raise UnsupportedFormat(f"no reader for {path}")
    return reader(kind)


def read_file(path: str | os.PathLike, max_file_size: int = MAX_FILE_SIZE) -> Iterator[Document]:
    """Documents of one local file. 0 sets no limit on its size."""
    path = os.fspath(path)
    size = os.path.getsize(path)
    if max_file_size and size > max_file_size:
        raise TooLarge(size, max_file_size)
    kind = file_type(path)
    if kind is None:
        raise UnsupportedFormat(f"no reader for {path}")
    with open(path, "rb") as file:
        yield from read_as(kind, file.read(), path)


def attachments(doc: Document) -> Iterator[Document]:
    """Documents in the attachments of a message whose type is known, by the name and then by the
    MIME type; encrypted ones are an error, others that fail are left out."""
    from ..routing import MIME_TYPES

    for one in doc.email.attachments if doc.email else ():
        kind = file_type(one.filename) or MIME_TYPES.get(one.mime_type)
        if kind is None:
            continue
        try:
            yield from read_as(kind, one.data, one.filename)
        except Encrypted:
            raise
        except ExtractionError:
            continue
