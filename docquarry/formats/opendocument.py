"""OpenDocument packages: text, spreadsheets, presentations, drawings and formulas."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from ..errors import Encrypted
from . import images
from .package import Element, Package, attribute, find_all, local
from .record import Document, Image, Part, Table, Unit, cell_text, joined

_LENGTH = re.compile(r"\s*(-?[\d.]+)\s*([a-z%]*)\s*$", re.I)
_PER_INCH = {"in": 1.0, "cm": 2.54, "mm": 25.4, "pt": 72.0, "pc": 6.0}
_META = {"title": "title", "description": "description", "subject": "subject", "creator": "creator", "keyword": "keywords", "initial-creator": "initial_creator", "creation-date": "creation_date", "date": "date", "language": "language", "editing-cycles": "editing_cycles", "editing-duration": "editing_duration", "generator": "generator"}


def pixels(length: str | None) -> float | None:
    """A length at 96 dots an inch; None for units that aren't known."""
    found = _LENGTH.match(length or "")
    if not found:
        return None
    unit = found[2].lower()
    if unit in ("", "px"):
        return float(found[1])
    return float(found[1]) / _PER_INCH[unit] * 96 if unit in _PER_INCH else None


def text_of(e: Element, silent: tuple[str, ...] = ("note", "annotation", "annotation-end")) -> str:
    """Text with its spaces, tabs and line breaks, without notes and annotations."""
    out = [e.text or ""]
    for c in e:
        kind = local(c)
        if kind == "s":
            count = attribute(c, "c") or "1"
            out.append(" " * (int(count) if count.isdigit() else 1))
        elif kind == "tab":
            out.append("\t")
        elif kind == "line-break":
            out.append("\n")
        elif kind not in silent:
            out.append(text_of(c, silent))
        out.append(c.tail or "")
    return "".join(out)


def _open(data: bytes, file_type: str) -> tuple[Package, Document, Element | None]:
    package = Package(data)
    if "META-INF/manifest.xml" in package and b"encryption-data" in package.bytes("META-INF/manifest.xml"):
        raise Encrypted("the document is encrypted")
    doc = Document(file_type, metadata=dict.fromkeys(_META.values(), ""))
    for e in (c for m in find_all(package.root("meta.xml"), "meta") for c in m):
        if local(e) in _META:
            doc.metadata[_META[local(e)]] = (e.text or "").strip()
    return package, doc, next(iter(find_all(package.root("content.xml"), "body")), None)


def _notes_of(e: Element) -> list[Part]:
    found = []
    for a in find_all(e, "annotation"):
        get = lambda name, a=a: next((c.text or "" for c in a if local(c) == name), "")
        found.append(Part("annotation", "\n".join(text_of(p) for p in find_all(a, "p")), attrs={"creator": get("creator"), "date": get("date")}))
    return found


def _picture(package: Package, frame: Element, number: int, unit: int | None) -> Image | None:
    image = next((c for c in frame if local(c) == "image"), None)
    href = attribute(image, "href") or "" if image is not None else ""
    if not href:
        return None
    member = href.removeprefix("./")
    content = package.bytes(member) if member in package else None
    size = [None if p is None else round(p) for p in (pixels(attribute(frame, "width")), pixels(attribute(frame, "height")))]
    described = lambda name: next((c.text or "" for c in frame if local(c) == name), "")
    return Image(number, images.content_type(content or b"", href), content, unit, size[0], size[1], attribute(frame, "name") or "", described("title"), described("desc"))


def _table(table: Element) -> list[list[str]]:
    rows = [["\n".join(text_of(p) for p in find_all(cell, "p")) for cell in row if local(cell) == "table-cell"] for row in find_all(table, "table-row")]
    return [r for r in rows if r]


def _flow(e: Element, out: list[str]) -> None:
    kind = local(e)
    if kind in ("p", "h"):
        out.append(text_of(e))
    elif kind == "table":
        out += [text_of(p) for row in find_all(e, "table-row") for cell in row if local(cell) == "table-cell" for p in find_all(cell, "p")]
    elif kind == "list":
        out += [text_of(p) for item in find_all(e, "list-item") for p in find_all(item, "p")]
    else:
        for c in e:
            _flow(c, out)


def _sections(doc: Document, body: Element) -> list[Unit]:
    """Sections under headings; paths begin with the title and don't repeat a step. Runs of
    paragraphs in a table's style stand for the next table."""
    title = doc.metadata["title"]
    base = [title] if title else []
    tables = iter(doc.tables)
    units: list[Unit] = []
    stack: list[tuple[int, str]] = []
    lines: list[str] = []
    mine: list[Table] = []
    pending: list[Table] = []
    level: int | None = None
    in_table = headed = False

    def close() -> None:
        nonlocal lines, mine
        text = "\n".join(lines).strip()
        if text or mine:
            path = list(base)
            for _, step in stack:
                if not path or path[-1] != step:
                    path.append(step)
            units.append(Unit(len(units) + 1, text, level, path))
            for t in mine:
                t.unit_number = len(units)
        lines, mine = [], []

    for p in (e for e in body.iter() if local(e) in ("p", "h")):
        text = text_of(p).strip()
        outline = attribute(p, "outline-level") if local(p) == "h" else None
        if outline and outline.isdigit():
            if text:
                headed = True
                close()
                while stack and stack[-1][0] >= int(outline):
                    stack.pop()
                stack.append((int(outline), text))
                level = int(outline)
                mine, pending = pending, []
            continue
        style = attribute(p, "style-name") or ""
        if style.startswith("Table") or "Table_" in style:
            if not in_table:
                pending += [t for t in [next(tables, None)] if t]
            in_table = True
            continue
        in_table = False
        if text:
            lines.append(text)
    mine += pending
    close()
    if headed:
        return units
    for thing in (*doc.tables, *doc.images):
        thing.unit_number = 1
    return [Unit(1, doc.full_text, 1 if base else None, base)]


def read_odt(data: bytes, path: str | None = None) -> Iterator[Document]:
    package, doc, body = _open(data, "odt")
    text = next(iter(find_all(body, "text")), None)
    if text is None:
        yield doc
        return
    out: list[str] = []
    _flow(text, out)
    doc.full_text = "\n".join(t for t in out if t.strip())
    doc.tables = [Table(rows) for t in find_all(text, "table") if (rows := _table(t))]
    for frame in find_all(text, "frame"):
        image = _picture(package, frame, len(doc.images) + 1, None)
        if image:
            doc.images.append(image)
    doc.units = _sections(doc, text)
    for image in doc.images:
        # By caption, then description; else with the last first-level section.
        needle = image.caption or image.description
        at = next((u.unit_number for u in doc.units if needle and needle in u.text), None)
        top = [u.unit_number for u in doc.units if u.heading_level == 1] or [u.unit_number for u in doc.units]
        image.unit_number = image.unit_number or at or (top[-1] if top else None)
    doc.parts += [Part("link", text_of(a), href) for a in find_all(text, "a") if (href := attribute(a, "href"))]
    for note in find_all(text, "note"):
        inner = next((c for c in note if local(c) == "note-body"), None)
        doc.parts.append(Part(attribute(note, "note-class") or "footnote", "\n".join(text_of(p) for p in find_all(inner, "p")), attribute(note, "id") or ""))
    doc.parts += _notes_of(text)
    doc.parts += [Part("bookmark", name) for kind in ("bookmark", "bookmark-start") for b in find_all(text, kind) if (name := attribute(b, "name"))]
    doc.parts += [Part("style", s) for s in sorted({attribute(e, "style-name") or "" for e in text.iter()} - {""})]
    for kind in ("header", "footer"):
        for e in find_all(package.root("styles.xml"), kind):
            if (found := "\n".join(t for p in find_all(e, "p") if (t := text_of(p)).strip())):
                doc.parts.append(Part(kind, found))
    yield doc


def cell_value(cell: Element) -> tuple[Any, str]:
    """A value in its type, and as it is shown."""
    kind = attribute(cell, "value-type") or ""
    name = {"float": "value", "currency": "value", "percentage": "value", "date": "date-value", "time": "time-value", "boolean": "boolean-value"}.get(kind)
    raw = attribute(cell, name) if name else None
    if raw:
        if name == "boolean-value":
            return raw.lower() == "true", raw
        if name != "value":
            return raw, raw
        try:
            number = float(raw)
            return (int(number) if number.is_integer() else number), raw
        except (ValueError, OverflowError):
            return raw, raw
    text = "\n".join(text_of(p) for p in find_all(cell, "p"))
    return (text, text) if text else (None, "")


def _sheet_rows(table: Element) -> list[list[tuple[Any, str]]]:
    """Cells with their repeats; a long run of empty ones counts once."""
    rows: list[list[tuple[Any, str]]] = []
    for r in (c for c in table if local(c) == "table-row"):
        row: list[tuple[Any, str]] = []
        for c in (c for c in r if local(c) == "table-cell"):
            times = int(attribute(c, "number-columns-repeated") or 1)
            found = cell_value(c)
            row += [found] * (1 if found[0] is None and times > 100 else times)
        times = int(attribute(r, "number-rows-repeated") or 1)
        rows += [row] * (1 if times > 100 and all(v is None for v, _ in row) else times)
    while rows and all(v is None for v, _ in rows[-1]):
        rows.pop()
    width = max((i + 1 for row in rows for i, (v, _) in enumerate(row) if v is not None), default=0)
    return [(row + [(None, "")] * width)[:width] for row in rows]


def read_ods(data: bytes, path: str | None = None) -> Iterator[Document]:
    package, doc, body = _open(data, "ods")
    for number, table in enumerate(find_all(body, "table"), 1):
        name = attribute(table, "name") or ""
        rows = _sheet_rows(table)
        lines = ["\t".join(shown for _, shown in row if shown) for row in rows]
        text = "\n".join(line for line in lines if line)
        doc.units.append(Unit(number, (name + "\n" + text.strip()).strip(), name=name))
        doc.tables.append(Table([[cell_text(v) for v, _ in row] for row in rows], number))
        for frame in find_all(table, "frame"):
            image = _picture(package, frame, len(doc.images) + 1, number)
            if image:
                doc.images.append(image)
        doc.parts += _notes_of(table)
    doc.full_text = joined([u.text for u in doc.units])
    yield doc


def read_odp(data: bytes, path: str | None = None) -> Iterator[Document]:
    package, doc, body = _open(data, "odp")
    for number, page in enumerate(find_all(body, "page"), 1):
        frames = sorted((c for c in page if local(c) == "frame"), key=lambda f: (pixels(attribute(f, "y")) or 0.0, pixels(attribute(f, "x")) or 0.0))
        title, bodies, others, tables = "", [], [], []
        for frame in frames:
            box = next((c for c in frame if local(c) == "text-box"), None)
            for p in find_all(box, "p"):
                text, style = text_of(p).strip(), attribute(p, "style-name") or ""
                if text and not title and "Title" in style:
                    title = text
                elif text:
                    (bodies if "Body" in style else others).append(text)
            if box is not None:
                doc.parts += _notes_of(box)
            for table in (c for c in frame if local(c) == "table"):
                rows = _table(table)
                if rows:
                    tables.append(rows)
                    doc.tables.append(Table(rows, number))
            image = _picture(package, frame, len(doc.images) + 1, number)
            if image:
                doc.images.append(image)
        for notes in (c for c in page if local(c) == "notes"):
            doc.parts += [Part("note", t, str(number)) for frame in find_all(notes, "frame") for p in find_all(frame, "p") if (t := text_of(p).strip())]
        text = "\n".join([*([title] if title else []), *bodies, *others])
        doc.units.append(Unit(number, text, location=[title] if title else [], name=attribute(page, "name")))
    doc.full_text = joined([u.text for u in doc.units])
    yield doc


def read_odg(data: bytes, path: str | None = None) -> Iterator[Document]:
    package, doc, body = _open(data, "odg")
    doc.full_text = "\n".join(t for e in (body.iter() if body is not None else ()) if local(e) in ("p", "h") and (t := text_of(e).strip()))
    doc.units = [Unit(1, doc.full_text)]
    hrefs: set[str] = set()
    for frame in find_all(body, "frame"):
        image = _picture(package, frame, len(doc.images) + 1, 1)
        href = next((attribute(c, "href") or "" for c in frame if local(c) == "image"), "")
        if image and href not in hrefs:
            hrefs.add(href)
            doc.images.append(image)
    yield doc


def _mathml(e: Element) -> str:
    kind, inner = local(e), list(e)
    if kind == "annotation":
        return ""
    if kind in ("mfrac", "msup", "msub") and len(inner) >= 2:
        return _mathml(inner[0]) + {"mfrac": "/", "msup": "^", "msub": "_"}[kind] + _mathml(inner[1])
    if kind == "msqrt":
        return f"sqrt({''.join(map(_mathml, inner))})"
    return (e.text or "").strip() + "".join(map(_mathml, inner))


def starmath(annotation: str) -> str:
    """The simple cases of the formula language: a over b, braces."""
    text = re.sub(r"\{\s*([^{}]+?)\s*\}\s*over\s*\{\s*([^{}]+?)\s*\}", r"\1/\2", annotation.strip())
    return re.sub(r"\s+over\s+", "/", text).strip()


def read_odf(data: bytes, path: str | None = None) -> Iterator[Document]:
    package, doc, _ = _open(data, "odf")
    root = package.root("content.xml")
    note = next((a.text for a in find_all(root, "annotation") if a.text and a.text.strip()), None)
    text = starmath(note) if note else ""
    if not text and root is not None:
        math = next(iter(find_all(root, "math")), None)
        text = _mathml(math) if math is not None else "\n".join(dict.fromkeys(t for e in root.iter() if local(e) in ("p", "h") and (t := text_of(e).strip())))
    doc.full_text = text.strip()
    doc.units = [Unit(1, doc.full_text)]
    yield doc
