"""Presentation packages."""

from __future__ import annotations

import re
from collections.abc import Iterator

from . import images, omml
from .package import Element, Package, attribute, core_properties, find_all, local, refuse_encrypted_ooxml
from .record import Document, Image, Part, Table, Unit, joined

TITLES = frozenset(("title", "ctrTitle", "subTitle"))
BODIES = frozenset(("body", "obj", "tbl", "chart", "dgm", "media", "clipArt"))
FOOTERS = frozenset(("ftr",))
SKIPPED = frozenset(("dt", "sldNum"))
_LAST = 999_999_999


def _child(e: Element | None, *names: str) -> Element | None:
    for name in names:
        e = next((c for c in e if local(c) == name), None) if e is not None else None
    return e


def placeholder(shape: Element) -> Element | None:
    return _child(shape, "nvSpPr", "nvPr", "ph")


def position(shape: Element) -> tuple[int, int]:
    """(y, x); without one, titles come first, bodies by index, footers and the rest last."""
    offset = next((o for x in find_all(shape, "xfrm")[:1] for o in x if local(o) == "off"), None)
    if offset is not None:
        try:
            return int(offset.get("y", "0")), int(offset.get("x", "0"))
        except ValueError:
            return _LAST, _LAST
    ph = placeholder(shape)
    if ph is not None:
        kind, index = ph.get("type", ""), ph.get("idx", "")
        if kind in TITLES:
            return 0, 0
        if kind in BODIES or not kind and index:
            return 1 + (int(index) if index.isdigit() else 0), 0
        if kind in FOOTERS or kind == "sldNum":
            return _LAST - 1, 0
    return _LAST, _LAST


def paragraphs(e: Element) -> str:
    """Text of the paragraphs; a break within one is a vertical tab."""

    def line(p: Element) -> str:
        out = []
        for c in p:
            if local(c) in ("r", "fld"):
                out += [t.text or "" for t in c if local(t) == "t"][:1]
            elif local(c) == "br":
                out.append("\v")
            elif local(c) == "t":
                out.append(c.text or "")
        return "".join(out)

    return "\n".join(line(p) for p in find_all(e, "p") if "drawingml" in p.tag)


def table_of(frame: Element) -> list[list[str]] | None:
    table = next((t for g in find_all(frame, "graphicData")[:1] for t in g if local(t) == "tbl"), None)
    if table is None:
        return None
    cell = lambda c: paragraphs(b).strip() if (b := _child(c, "txBody")) is not None else ""
    return [[cell(c) for c in row if local(c) == "tc"] for row in table if local(row) == "tr"]


def classify(ph: Element | None) -> str:
    """title, footer, skip, content or other."""
    if ph is None:
        return "other"
    kind = ph.get("type", "")
    if kind in TITLES:
        return "title"
    if kind in FOOTERS:
        return "footer"
    if kind in SKIPPED:
        return "skip"
    return "content" if kind in BODIES or not kind and ph.get("idx", "") else "other"


def _slide_members(package: Package) -> list[str]:
    deck = "ppt/presentation.xml"
    links = package.relationships(deck)
    ordered = [links[i][1] for s in find_all(package.root(deck), "sldId") if (i := next((v for k, v in s.attrib.items() if "relationships" in k), "")) in links]
    found = [m for m in ordered if m in package]
    return found or sorted((n for n in package.names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))


def read(data: bytes, path: str | None = None) -> Iterator[Document]:
    refuse_encrypted_ooxml(data)
    package = Package(data)
    doc = Document("pptx", metadata=core_properties(package))
    doc.metadata["modified"] = doc.metadata.get("modified", "").removesuffix("Z")
    doc.metadata["created"] = doc.metadata.get("created", "").removesuffix("Z")
    for number, member in enumerate(_slide_members(package), 1):
        tree = next(iter(find_all(package.root(member), "spTree")), None)
        links = package.relationships(member)
        base: list[tuple[tuple[int, int], str]] = []
        shown: list[str] = []
        shapes = [(position(s), s) for kind in ("sp", "pic", "graphicFrame") for s in find_all(tree, kind)]
        for at, shape in sorted(shapes, key=lambda s: s[0]):
            if local(shape) == "pic":
                blip = next(iter(find_all(shape, "blip")), None)
                target = links.get(attribute(blip, "embed") or "", ("", "", False))[1] if blip is not None else ""
                if target in package:
                    content, named = package.bytes(target), next(iter(find_all(shape, "cNvPr")), None)
                    caption, description = (named.get("name", ""), named.get("descr", "")) if named is not None else ("", "")
                    doc.images.append(Image(len(doc.images) + 1, images.content_type(content, target), content, number, *images.size(content), target.rpartition("/")[2], caption, description))
                continue
            if local(shape) == "graphicFrame":
                rows = table_of(shape)
                if rows:
                    doc.tables.append(Table(rows, number))
                    text = "\n".join(map("\t".join, rows)).strip()
                    if text:
                        base.append((at, text))
                continue
            for latex, displayed in omml.formulas(shape):
                mark = "$$" if displayed else "$"
                shown.append(f"{mark}{latex}{mark}")
                doc.parts.append(Part("formula", latex, "display" if displayed else "inline", {"unit_number": str(number)}))
            body = _child(shape, "txBody")
            text = paragraphs(body).strip() if body is not None else ""
            if not text:
                continue
            kind = classify(placeholder(shape))
            if kind in ("title", "content", "other"):
                base.append((at, text))
            if kind != "skip":
                doc.parts.append(Part(kind, text, str(number)))
        notes = [t for _, t, _ in links.values() if "comments" in t]
        for target in notes or [f"ppt/comments/comment{number}.xml"]:
            for comment in find_all(package.root(target), "cm"):
                text = next((t.text or "" for t in comment.iter() if local(t) == "text"), "") or "".join(t.text or "" for t in find_all(comment, "t"))
                doc.parts.append(Part("comment", text, str(number), {"author": comment.get("authorId", ""), "date": comment.get("dt", "")}))
        title = next((p.text for p in doc.parts if p.kind == "title" and p.ref == str(number)), None)
        text = "\n".join(t for _, t in sorted(base, key=lambda b: b[0]))
        doc.units.append(Unit(number, "\n".join([*([text] if text else []), *shown]), name=title))
    doc.full_text = joined([u.text for u in doc.units])
    yield doc
