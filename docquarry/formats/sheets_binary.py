"""Binary workbooks (BIFF8, and the cell records of BIFF5)."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import Any

from ..errors import Encrypted, LegacyParsing
from .blips import carved, pictures
from .ole import CompoundFile, shown
from .record import Document, Table, Unit
from .sheets import is_date_format

_DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48), *range(27, 37), *range(50, 59)])
_ERROR = object()


def _records(stream: bytes) -> Iterator[tuple[int, bytes, int]]:
    at = 0
    while at + 4 <= len(stream):
        kind, length = struct.unpack_from("<HH", stream, at)
        yield kind, stream[at + 4 : at + 4 + length], at
        at += 4 + length


class _Pieces:
    """Bytes of a record and its continuations; a text that goes on in the next piece begins
    there with a flag of its own."""

    def __init__(self, pieces: list[bytes]):
        self._pieces, self._k, self._at = pieces, 0, 0

    def _ready(self) -> bytes:
        while self._k < len(self._pieces) - 1 and self._at >= len(self._pieces[self._k]):
            self._k, self._at = self._k + 1, 0
        return self._pieces[self._k]

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            piece = self._ready()
            got = piece[self._at : self._at + n]
            if not got:
                raise LegacyParsing("a string table ends too early")
            out += got
            self._at += len(got)
            n -= len(got)
        return out

    def text(self) -> str:
        count, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = [], flags & 1
        while count:
            piece = self._pieces[self._k]
            if self._at >= len(piece):
                self._ready()
                wide = self.take(1)[0] & 1
                piece = self._pieces[self._k]
            size = 2 if wide else 1
            got = min(count, (len(piece) - self._at) // size)
            if not got:
                raise LegacyParsing("a string table ends too early")
            out.append(piece[self._at : self._at + got * size].decode("utf-16-le" if wide else "latin-1", "replace"))
            self._at += got * size
            count -= got
        self.take(4 * runs + extra)
        return "".join(out)


def _short_text(data: bytes, at: int, wide_length: bool, old: bool) -> str:
    count = struct.unpack_from("<H", data, at)[0] if wide_length else data[at]
    at += 2 if wide_length else 1
    if old:
        return data[at : at + count].decode("cp1252", "replace")
    flags = data[at]
    at += 1 + (2 if flags & 8 else 0) + (4 if flags & 4 else 0)
    return data[at : at + count * 2].decode("utf-16-le", "replace") if flags & 1 else data[at : at + count].decode("latin-1")


def _rk(raw: bytes) -> float:
    bits = struct.unpack("<I", raw)[0]
    number = float(struct.unpack("<i", raw)[0] >> 2) if bits & 2 else struct.unpack("<d", struct.pack("<Q", (bits & 0xFFFFFFFC) << 32))[0]
    return number / 100 if bits & 1 else number


class _Book:
    def __init__(self, stream: bytes):
        self.stream = stream
        self.sheets: list[tuple[str, int]] = []
        self.strings: list[str] = []
        self.formats: dict[int, str] = {}
        self.styles: list[int] = []
        self.from_1904 = self.old = False
        pieces: list[bytes] | None = None
        for kind, data, _ in _records(stream):
            if kind == 0x3C and pieces is not None:
                pieces.append(data)
                continue
            if pieces is not None:
                self._table(pieces)
                pieces = None
            if kind == 0x809 and len(data) >= 4:
                self.old = struct.unpack_from("<H", data)[0] < 0x600
            elif kind == 0x2F:
                raise Encrypted("the workbook is encrypted")
            elif kind == 0x85 and data[5] == 0:
                self.sheets.append((_short_text(data, 6, False, self.old), struct.unpack_from("<I", data)[0]))
            elif kind == 0xFC:
                pieces = [data]
            elif kind == 0x41E:
                self.formats[struct.unpack_from("<H", data)[0]] = _short_text(data, 2, not self.old, self.old)
            elif kind == 0xE0:
                self.styles.append(struct.unpack_from("<H", data, 2)[0])
            elif kind == 0x22:
                self.from_1904 = data[:2] == b"\1\0"
            elif kind == 0x0A:
                break

    def _table(self, pieces: list[bytes]) -> None:
        count = struct.unpack_from("<I", pieces[0], 4)[0]
        reader = _Pieces([pieces[0][8:], *pieces[1:]])
        self.strings = [reader.text() for _ in range(count)]

    def _number(self, value: float, style: int) -> Any:
        code = self.styles[style] if style < len(self.styles) else 0
        if code in _DATE_FORMATS or code in self.formats and is_date_format(self.formats[code]):
            if value >= 0:
                base = datetime(1904, 1, 1) if self.from_1904 else datetime(1899, 12, 30 if value >= 60 else 31)
                when = base + timedelta(seconds=round(value * 86400))
                day = "0000-00-00" if value < 1 and not self.from_1904 else f"{when:%Y-%m-%d}"
                return day if (when.hour, when.minute, when.second) == (0, 0, 0) else f"{day} {when:%H:%M:%S}"
        return int(value) if value == int(value) else value

    def cells(self, start: int) -> dict[tuple[int, int], Any]:
        found: dict[tuple[int, int], Any] = {}
        last: tuple[int, int] | None = None
        depth = 0
        for kind, d, _ in _records(self.stream[start:]):
            if kind == 0x809:
                depth += 1
            elif kind == 0x0A:
                depth -= 1
                if not depth:
                    break
            elif depth != 1:
                continue  # an embedded chart
            elif kind in (0xFD, 0x204, 0x203, 0x27E, 0x205, 0x06, 0x406):
                row, column, style = struct.unpack_from("<HHH", d)
                value: Any = None
                if kind == 0xFD:
                    value = self.strings[struct.unpack_from("<I", d, 6)[0]]
                elif kind == 0x204:
                    value = _short_text(d, 6, True, self.old)
                elif kind == 0x203:
                    value = self._number(struct.unpack_from("<d", d, 6)[0], style)
                elif kind == 0x27E:
                    value = self._number(_rk(d[6:10]), style)
                elif kind == 0x205:
                    value = _ERROR if d[7] else bool(d[6])
                elif d[12:14] == b"\xff\xff":
                    value = {0: "", 1: bool(d[8]), 2: _ERROR}.get(d[6])
                    last = (row, column)
                else:
                    value = self._number(struct.unpack_from("<d", d, 6)[0], style)
                found[row, column] = value
            elif kind == 0x207 and last:
                found[last] = _short_text(d, 0, True, self.old)
            elif kind == 0xBD:
                row, first = struct.unpack_from("<HH", d)
                for i in range((len(d) - 6) // 6):
                    found[row, first + i] = self._number(_rk(d[6 + 6 * i : 10 + 6 * i]), struct.unpack_from("<H", d, 4 + 6 * i)[0])
        return found


def _shown(value: Any) -> str:
    return "" if value is None else "#ERROR" if value is _ERROR else str(value)


def justified(rows: list[list[str]]) -> str:
    widths = [max(map(len, column)) for column in zip(*rows)]
    return "\n".join("  ".join(v.rjust(w) for v, w in zip(row, widths)) for row in rows)


def read(data: bytes, path: str | None = None) -> Iterator[Document]:
    ole = CompoundFile(data)
    stream = ole.stream("Workbook") or ole.stream("Book")
    if stream is None:
        raise LegacyParsing("no workbook in the file")
    book = _Book(stream)
    found = ole.properties()
    names = dict(title="title", author="author", subject="subject", company="company", last_saved_by="last_saved_by", create_time="created", last_saved_time="modified")
    doc = Document("xls", metadata={to: shown(found.get(k)) for k, to in names.items()})
    texts = []
    for number, (name, start) in enumerate(book.sheets, 1):
        cells = book.cells(start)
        height, width = (max((at[i] for at in cells), default=-1) + 1 for i in (0, 1))
        rows = [[cells.get((r, c)) for c in range(width)] for r in range(height)]
        shown_rows = [[_shown(v) for v in row] for row in rows]
        text = justified(shown_rows) if rows else ""
        texts.append(text)
        doc.units.append(Unit(number, text.strip(), name=name, location=[name]))
        # Columns with one and the same header count once, the last of them.
        headers = {h: i for i, h in enumerate(shown_rows[0])} if rows else {}
        body = [[None if row[i] is None or row[i] is _ERROR else _shown(row[i]) for i in headers.values()] for row in rows[1:]]
        doc.tables.append(Table([list(headers), *body] if body else [], number))
    doc.images = pictures(carved(stream))
    for image in doc.images:
        image.unit_number = 1
    doc.full_text = "\n\n".join(texts).strip()
    yield doc
