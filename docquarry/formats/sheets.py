"""Spreadsheet packages: values only, formulas by their cached results."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import Any

from . import images
from .package import Element, Package, attribute, core_properties, find_all, local, refuse_encrypted_ooxml
from .record import Document, Image, Table, Unit, cell_text, joined

_DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])
_QUOTED = re.compile(r'"[^"]*"|\[[^\]]*\]|\\.')


def column_number(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def is_date_format(code: str) -> bool:
    return bool(re.search("[dmyhs]", _QUOTED.sub("", code).lower())) and "general" not in code.lower()


def serial_date(serial: float, from_1904: bool = False) -> str:
    """A serial number of days as ISO text: a time alone under one day."""
    base = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30 if serial >= 60 else 31)
    when = base + timedelta(seconds=round(serial * 86400))
    if 0 <= serial < 1:
        return when.time().isoformat()
    return when.isoformat()


def display(value: Any) -> str:
    whole = isinstance(value, float) and value.is_integer()
    return "" if value is None else str(int(value) if whole else value)


def blank(value: Any) -> bool:
    return value is None or isinstance(value, str) and not value.strip()


def trimmed(rows: list[list[Any]]) -> list[list[Any]]:
    """Without blank rows at the end and blank columns at the right; all rows equally long."""
    while rows and all(map(blank, rows[-1])):
        rows = rows[:-1]
    width = max((i + 1 for row in rows for i, v in enumerate(row) if not blank(v)), default=0)
    return [(row + [None] * width)[:width] for row in rows]


def headed(rows: list[list[Any]]) -> list[list[Any]]:
    """The first row as headers; blank ones are numbered."""
    return [[f"Unnamed: {i}" if blank(v) else str(v) for i, v in enumerate(rows[0])], *rows[1:]] if rows else []


def justified(rows: list[list[Any]], separator: str = " ") -> str:
    shown = [[display(v) for v in row] for row in rows]
    widths = [max(map(len, column)) for column in zip(*shown)]
    return "\n".join(separator.join(v.rjust(w) for v, w in zip(row, widths)) for row in shown)


def is_name_row(row: list[Any]) -> bool:
    """One value that says something, in a table of several columns."""
    return len(row) > 1 and sum(not blank(v) and not (isinstance(v, str) and v.startswith("Unnamed: ")) for v in row) == 1


def _strings(package: Package) -> list[str]:
    # Phonetic readings stand beside the text and aren't part of it.
    def text(item: Element) -> str:
        return "".join(t.text or "" for c in item if local(c) in ("t", "r") for t in ([c] if local(c) == "t" else c) if local(t) == "t")

    return [text(s) for s in find_all(package.root("xl/sharedStrings.xml"), "si")]


def _date_styles(package: Package) -> set[int]:
    root = package.root("xl/styles.xml")
    codes = {int(attribute(f, "numFmtId") or 0): attribute(f, "formatCode") or "" for f in find_all(root, "numFmt")}
    formats = next(iter(find_all(root, "cellXfs")), None)
    ids = [int(attribute(x, "numFmtId") or 0) for x in (formats if formats is not None else ())]
    return {i for i, f in enumerate(ids) if f in _DATE_FORMATS or f in codes and is_date_format(codes[f])}


def _cell(c: Element, strings: list[str], dates: set[int], from_1904: bool) -> Any:
    kind = c.get("t", "n")
    raw = next((e.text for e in c if local(e) == "v"), None)
    if kind == "inlineStr":
        return "".join(t.text or "" for t in find_all(c, "t"))
    if raw is None:
        return None
    if kind == "s":
        return strings[int(raw)]
    if kind in ("str", "e", "d"):
        return raw
    if kind == "b":
        return raw == "1"
    number = float(raw)
    if int(c.get("s", "0")) in dates:
        return serial_date(number, from_1904)
    return int(number) if re.fullmatch(r"-?\d+", raw) else number


def _grid(root: Element | None, *how) -> list[list[Any]]:
    rows: list[list[Any]] = []
    for r in find_all(root, "row"):
        at = int(r.get("r", len(rows) + 1)) - 1
        rows += [[] for _ in range(at + 1 - len(rows))]
        for c in r:
            if local(c) != "c":
                continue
            column = column_number(c.get("r", "")) if c.get("r") else len(rows[at])
            rows[at] += [None] * (column + 1 - len(rows[at]))
            rows[at][column] = _cell(c, *how)
    width = max(map(len, rows), default=0)
    return [row + [None] * (width - len(row)) for row in rows]


def _pictures(package: Package, member: str) -> Iterator[tuple[str, str, str]]:
    """(member, name, description) by way of the sheet's drawings."""
    for kind, drawing, _ in package.relationships(member).values():
        if kind != "drawing":
            continue
        targets = package.relationships(drawing)
        for picture in find_all(package.root(drawing), "pic"):
            shape = next(iter(find_all(picture, "cNvPr")), None)
            for blip in find_all(picture, "blip")[:1]:
                target = targets.get(attribute(blip, "embed") or "", ("", "", False))[1]
                if target in package:
                    yield target, shape.get("name", "") if shape is not None else "", shape.get("descr", "") if shape is not None else ""


def read(data: bytes, path: str | None = None) -> Iterator[Document]:
    refuse_encrypted_ooxml(data)
    package = Package(data)
    book = "xl/workbook.xml"
    links = package.relationships(book)
    settings = next(iter(find_all(package.root(book), "workbookPr")), None)
    how = (_strings(package), _date_styles(package), settings is not None and settings.get("date1904") in ("1", "true"))
    doc = Document("xlsx", metadata=core_properties(package))
    for number, sheet in enumerate(find_all(package.root(book), "sheet"), 1):
        name = sheet.get("name", "")
        member = links.get(attribute(sheet, "id") or "", ("", posixpath.join("xl", "worksheets", f"sheet{number}.xml"), False))[1]
        rows = headed(trimmed(_grid(package.root(member), *how)))
        text = justified(rows)
        shown = rows[1:] if rows and is_name_row(rows[0]) else rows
        doc.units.append(Unit(number, name + "\n" + text.strip(), name=name, location=[name]))
        doc.tables.append(Table([[cell_text(v) for v in row] for row in shown], number))
        for target, caption, description in _pictures(package, member):
            content = package.bytes(target)
            doc.images.append(Image(len(doc.images) + 1, images.content_type(content, target), content, None, *images.size(content), target.rpartition("/")[2], caption, description))
    doc.full_text = joined([u.text for u in doc.units])
    yield doc
