"""Compound files: storages and streams, and their summary properties."""

from __future__ import annotations

import struct
from datetime import datetime, timedelta

from ..errors import LegacyParsing
from .package import is_ole

_END, _FREE = 0xFFFFFFFE, 0xFFFFFFFF

_SUMMARY = {2: "title", 3: "subject", 4: "author", 5: "keywords", 6: "comments", 7: "template", 8: "last_saved_by", 9: "revision_number", 12: "create_time", 13: "last_saved_time", 14: "num_pages", 15: "num_words", 16: "num_chars", 18: "creating_application"}
_DOCUMENT = {2: "category", 7: "slides", 8: "notes", 9: "hidden_slides", 14: "manager", 15: "company"}


class CompoundFile:
    """Paths are joined by "/", compared without case."""

    def __init__(self, data: bytes):
        if not is_ole(data) or len(data) < 512:
            raise LegacyParsing("not a compound file")
        self._data = data
        head = struct.unpack_from("<HHHHH6xIIIIIIIIII", data, 24)
        self._size, self._small = 1 << head[3], 1 << head[4]
        fat_sectors, first_directory, _, self._cutoff, first_mini, _, difat_at, difat_count = head[6], head[7], head[8], head[9], head[10], head[11], head[12], head[13]
        places = list(struct.unpack_from("<109I", data, 76))
        while difat_count and difat_at < _END and len(places) < 109 + difat_count * self._size // 4:
            block = self._ints(self._sector(difat_at))
            places += block[:-1]
            difat_at = block[-1]
        self._fat: list[int] = []
        for place in places[: max(fat_sectors, 0)] if fat_sectors <= len(places) else places:
            if place < _END - 1:
                self._fat += self._ints(self._sector(place))
        self._mini_fat = self._ints(self._chain(first_mini)) if first_mini < _END else []
        self._entries = self._directory(self._chain(first_directory))
        root = next((e for e in self._entries.values() if e[0] == 5), None)
        self._mini = self._chain(root[1])[: root[2]] if root and root[1] < _END else b""

    @staticmethod
    def _ints(block: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(block) // 4}I", block[: len(block) // 4 * 4]))

    def _sector(self, number: int) -> bytes:
        at = (number + 1) * self._size
        return self._data[at : at + self._size]

    def _chain(self, start: int) -> bytes:
        out, seen = [], set()
        while start < len(self._fat) and start not in seen:
            seen.add(start)
            out.append(self._sector(start))
            start = self._fat[start]
        return b"".join(out)

    def _mini_chain(self, start: int) -> bytes:
        out, seen = [], set()
        while start < len(self._mini_fat) and start not in seen:
            seen.add(start)
            out.append(self._mini[start * self._small : (start + 1) * self._small])
            start = self._mini_fat[start]
        return b"".join(out)

    def _directory(self, block: bytes) -> dict[str, tuple[int, int, int]]:
        """Path -> (kind, first sector, size), in the order of the tree."""
        raw = []
        for at in range(0, len(block) - 127, 128):
            length = struct.unpack_from("<H", block, at + 64)[0]
            name = block[at : at + max(0, min(length, 64) - 2)].decode("utf-16-le", "replace")
            kind, left, right, child = block[at + 66], *struct.unpack_from("<III", block, at + 68)
            start, size = struct.unpack_from("<IQ", block, at + 116)
            raw.append((name, kind, left, right, child, start, size & 0xFFFFFFFF if self._size == 512 else size))
        found: dict[str, tuple[int, int, int]] = {}
        seen: set[int] = set()

        def walk(number: int, prefix: str) -> None:
            waiting, order = [number], []
            while waiting:
                n = waiting.pop()
                if n < len(raw) and n not in seen:
                    seen.add(n)
                    order.append(n)
                    waiting += [raw[n][2], raw[n][3]]
            for n in sorted(order):
                name, kind, _, _, child, start, size = raw[n]
                path = prefix + name
                found[path] = (kind, start, size)
                if kind in (1, 5):
                    walk(child, "" if kind == 5 else path + "/")

        if raw:
            walk(0, "")
        return found

    def _find(self, path: str) -> tuple[int, int, int] | None:
        lower = path.lower()
        return next((e for p, e in self._entries.items() if p.lower() == lower), None)

    def __contains__(self, path: str) -> bool:
        return self._find(path) is not None

    def paths(self) -> list[str]:
        return [p for p, e in self._entries.items() if e[0] != 5]

    def storages(self) -> list[str]:
        return [p for p, e in self._entries.items() if e[0] == 1]

    def stream(self, path: str) -> bytes | None:
        entry = self._find(path)
        if entry is None or entry[0] != 2:
            return None
        _, start, size = entry
        return (self._mini_chain(start) if size < self._cutoff else self._chain(start))[:size]

    def properties(self) -> dict[str, object]:
        """Summary properties by name: text, numbers and datetimes."""
        found: dict[str, object] = {}
        for name, fields in (("\x05SummaryInformation", _SUMMARY), ("\x05DocumentSummaryInformation", _DOCUMENT)):
            data = self.stream(name)
            if data and len(data) >= 48:
                try:
                    found |= _property_set(data, fields)
                except struct.error:
                    pass
        return found


def _property_set(data: bytes, fields: dict[int, str]) -> dict[str, object]:
    at = struct.unpack_from("<I", data, 44)[0]
    count = struct.unpack_from("<I", data, at + 4)[0]
    places = [struct.unpack_from("<II", data, at + 8 + 8 * i) for i in range(min(count, 1000))]
    page = next((struct.unpack_from("<H", data, at + p + 4)[0] for i, p in places if i == 1), 1252)
    found: dict[str, object] = {}
    for number, place in places:
        if number not in fields:
            continue
        kind, here = struct.unpack_from("<I", data, at + place)[0] & 0xFFFF, at + place + 4
        value: object = None
        if kind == 30:
            size = struct.unpack_from("<I", data, here)[0]
            text = data[here + 4 : here + 4 + size].split(b"\0")[0]
            try:
                value = text.decode("utf-8" if page in (0, 65001) else "utf-16-le" if page == 1200 else f"cp{page}", "replace")
            except LookupError:
                value = text.decode("cp1252", "replace")
        elif kind == 31:
            size = struct.unpack_from("<I", data, here)[0]
            value = data[here + 4 : here + 4 + 2 * size].decode("utf-16-le", "replace").rstrip("\0")
        elif kind in (3, 22):
            value = struct.unpack_from("<i", data, here)[0]
        elif kind == 2:
            value = struct.unpack_from("<h", data, here)[0]
        elif kind == 64:
            ticks = struct.unpack_from("<Q", data, here)[0]
            value = datetime(1601, 1, 1) + timedelta(microseconds=ticks // 10) if ticks else None
        if value is not None:
            found[fields[number]] = value
    return found


def shown(value: object) -> str:
    """A property as metadata shows it; "" where there is none."""
    if isinstance(value, datetime):
        return value.isoformat()
    return "" if value is None else str(value)


def has_encryption(ole: CompoundFile) -> bool:
    return any(name in ole for name in ("EncryptionInfo", "EncryptedPackage", "DataSpaces", "\x06DataSpaces"))
