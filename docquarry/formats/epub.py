"""E-books: chapters in spine order, tables, images and the table of contents."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote

from ..errors import Encrypted, Failed
from . import images
from .html import BLOCKS, DROPPED
from .package import Element, Package, attribute, find_all, local
from .record import Document, Image, Part, Table, Unit, joined, tidy

_NAV_LINK = re.compile(r"""<a[^>]+href=["']([^"']+)["'][^>]*>([^<]+)</a>""", re.I)


class _Chapter(HTMLParser):
    """Text without titles and table cells; the cells make tables. A table within another
    takes its place."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title = ""
        self.tables: list[list[list[str]]] = []
        self._dropping = 0
        self._in_title = False
        self._rows: list[list[str]] | None = None
        self._row: list[str] = []
        self._cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs) -> None:
        if self._dropping or tag in DROPPED:
            self._dropping += 1
        elif tag == "title":
            self._in_title = True
        elif tag == "table":
            self._rows = []
        else:
            if self._rows is not None and tag == "tr":
                self._row = []
            elif self._rows is not None and tag in ("td", "th"):
                self._cell = []
            self.out += ["\n"] * ((tag in BLOCKS) + (tag == "br"))

    def handle_endtag(self, tag: str) -> None:
        if self._dropping:
            self._dropping -= 1
        elif tag == "title":
            self._in_title = False
        elif tag == "table":
            if self._rows:
                self.tables.append(self._rows)
            self._rows = None
        else:
            if self._rows is not None and tag == "tr":
                if self._row:
                    self._rows.append(self._row)
                self._row = []
            elif self._rows is not None and tag in ("td", "th"):
                self._row.append(" ".join(" ".join(self._cell or []).split()))
                self._cell = None
            if tag in BLOCKS:
                self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if self._dropping:
            return
        if self._in_title:
            self.title += data
        elif self._cell is not None:
            self._cell.append(data)
        else:
            self.out.append(data)

    def text(self) -> str:
        text = re.sub(r" {2,}", " ", tidy("".join(self.out), blanks=False))
        return "\n".join(line.strip() for line in text.split("\n")).strip()


def _is_protected(book: Package) -> bool:
    if "META-INF/rights.xml" in book:
        return True
    return bool(find_all(book.root("META-INF/encryption.xml"), "EncryptedData"))


def _contents(book: Package, manifest: dict[str, tuple[str, str]]) -> list[Part]:
    for href, kind in manifest.values():
        if kind == "application/xhtml+xml" and re.search("nav|toc", href.lower()) and href in book:
            found = [Part("toc", title.strip(), to) for to, title in _NAV_LINK.findall(book.text(href)) if title.strip()]
            if found:
                return found
    for href, kind in manifest.values():
        if kind == "application/x-dtbncx+xml":
            found = []

            def points(parent: Element) -> None:
                for point in parent:
                    if local(point) != "navPoint":
                        continue
                    label = next((t.text or "" for l in point if local(l) == "navLabel" for t in l if local(t) == "text"), "").strip()
                    target = next((c.get("src", "") for c in point if local(c) == "content"), "")
                    if label:
                        found.append(Part("toc", label, target))
                    points(point)

            for root in find_all(book.root(href), "navMap")[:1]:
                points(root)
            if found:
                return found
    return []


def read(data: bytes, path: str | None = None) -> Iterator[Document]:
    book = Package(data)
    if _is_protected(book):
        raise Encrypted("the book has DRM")
    opf = next((unquote(attribute(e, "full-path") or "") for e in find_all(book.root("META-INF/container.xml"), "rootfile")), "")
    root = book.root(opf)
    if root is None:
        raise Failed("the book has no package document")
    folder = posixpath.dirname(opf)
    manifest = {e.get("id", ""): (posixpath.normpath(posixpath.join(folder, unquote(e.get("href", "")))), e.get("media-type", "")) for e in find_all(root, "item")}
    metadata: dict[str, str] = {}
    for section in find_all(root, "metadata")[:1]:
        for e in section:
            if e.text and e.text.strip():
                metadata.setdefault(local(e), e.text.strip())
    doc = Document("epub", metadata=metadata)
    # Entries that give no chapter are counted all the same.
    for number, item in enumerate(find_all(root, "itemref"), 1):
        href, kind = manifest.get(item.get("idref", ""), ("", ""))
        if href not in book or not (re.match("application/xhtml|text/html", kind) or re.search(r"\.x?html?$", href)):
            continue
        chapter = _Chapter()
        chapter.feed(book.text(href))
        text = chapter.text()
        first = next((line for line in text.splitlines() if line.strip()), "")
        title = chapter.title.strip() or (first if len(first) < 100 else "")
        doc.units.append(Unit(number, text, name=title, location=[href]))
        doc.tables += [Table(rows, number) for rows in chapter.tables]
    for href, kind in manifest.values():
        if kind.startswith("image/") and href in book:
            content = book.bytes(href)
            doc.images.append(Image(len(doc.images) + 1, kind, content, None, *images.size(content), name=href))
    doc.parts = _contents(book, manifest)
    doc.full_text = joined([u.text for u in doc.units])
    yield doc
