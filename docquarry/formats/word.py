"""Word-processing packages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from . import images, omml
from .package import Element, Package, attribute, core_properties, find_all, local, refuse_encrypted_ooxml
from .record import Document, Image, Part, Table, Unit

_HEADING = re.compile(r"heading\s*(\d+)\b", re.I)
_CAPTION = re.compile("caption|beschriftung|legende|figure|abbildung", re.I)


def children(e: Element, name: str) -> list[Element]:
    return [c for c in e if local(c) == name]


def child(e: Element | None, name: str) -> Element | None:
    return next((c for c in e if local(c) == name), None) if e is not None else None


def value(e: Element | None, name: str = "val") -> str | None:
    return None if e is None else attribute(e, name)


def raw_text(e: Element) -> str:
    return "".join(t.text or "" for t in e.iter() if local(t) == "t" and "math" not in t.tag)


def rich_text(e: Element, formulas: bool = True) -> str:
    """Runs in order, of alternatives the first, formulas in dollars."""
    kind = local(e)
    if kind == "AlternateContent":
        choice = child(e, "Choice")
        return "" if choice is None else "".join(rich_text(c, formulas) for c in choice)
    if kind == "Fallback":
        return ""
    if kind == "r" and "math" not in e.tag:
        return "".join((c.text or "") if local(c) == "t" else rich_text(c, formulas) if local(c) == "AlternateContent" else "" for c in e)
    if kind in ("oMath", "oMathPara"):
        inner = e if kind == "oMath" else child(e, "oMath")
        latex = omml.to_latex(inner) if formulas else ""
        mark = "$" if kind == "oMath" else "$$"
        return f"{mark}{latex}{mark}" if latex.strip() else ""
    return "".join(rich_text(c, formulas) for c in e)


def body_text(body: Element | None, formulas: bool = True) -> str:
    lines: list[str] = []
    for e in body if body is not None else ():
        if local(e) == "p":
            lines.append(rich_text(e, formulas))
        elif local(e) == "tbl":
            for row in find_all(e, "tr"):
                for cell in find_all(row, "tc"):
                    lines.append(" ".join(t for p in find_all(cell, "p") if (t := rich_text(p, formulas)).strip()))
    return "\n".join(line for line in lines if line.strip())


def _flag(e: Element | None) -> bool | None:
    return None if e is None else (value(e) or "1") not in ("0", "false")


@dataclass
class Paragraph:
    text: str
    style: str | None
    alignment: str | None
    page_break: bool
    runs: list[dict[str, str]]

    @property
    def level(self) -> int | None:
        found = _HEADING.match((self.style or "").strip())
        return int(found[1]) if found else None


def _run(r: Element) -> dict[str, str] | None:
    text = raw_text(r)
    if not text:
        return None
    props = child(r, "rPr")
    found: dict[str, str | None] = {"text": text}
    if props is not None:
        for key, name in (("bold", "b"), ("italic", "i")):
            flag = _flag(child(props, name))
            found[key] = None if flag is None else str(flag).lower()
        line = value(child(props, "u"))
        found["underline"] = None if child(props, "u") is None else str(bool(line) and line != "none").lower()
        fonts = child(props, "rFonts")
        found["font_name"] = next((f for n in ("ascii", "hAnsi", "cs") if (f := value(fonts, n))), None)
        size = value(child(props, "sz"))
        found["font_size"] = str(int(size) / 2) if size and size.isdigit() else None
        found["font_color"] = value(child(props, "color"))
    return {k: v for k, v in found.items() if v is not None}


def _paragraph(p: Element, styles: dict[str, str]) -> Paragraph:
    props = child(p, "pPr")
    style = value(child(props, "pStyle"))
    broken = any(local(e) == "lastRenderedPageBreak" or local(e) == "br" and attribute(e, "type") == "page" for e in p.iter())
    runs = [r for e in find_all(p, "r") if "math" not in e.tag and (r := _run(e))]
    return Paragraph("".join(r["text"] for r in runs), styles.get(style, style) if style else None, value(child(props, "jc")), broken, runs)


def sectioned(paragraphs: list[Paragraph], images_at: dict[int, list[Image]], tables_at: dict[int, list[Table]]) -> list[Unit]:
    """Heading sections; what stands before the first heading is in none. A section without
    anything yet also ends at a page break if the next heading's section has something. An
    empty section before a deeper heading is left out."""
    levels = [p.level for p in paragraphs]
    heads = [i for i, level in enumerate(levels) if level is not None]
    held = lambda i: bool(images_at.get(i) or tables_at.get(i))
    ends = dict(zip(heads, [*heads[1:], len(paragraphs)]))
    filled = {h: any(paragraphs[i].text.strip() or held(i) for i in range(h + 1, ends[h])) for h in heads}
    units: list[Unit] = []
    stack: list[tuple[int, str]] = []
    path: list[str] = []
    lines: list[str] = []
    start, level, payload = None, None, False

    def close(end: int, deeper: int | None = None) -> None:
        if not path or start is None:
            return
        text = "\n".join(lines).strip()
        things = [x for i in range(start, end + 1) for x in (*images_at.get(i, ()), *tables_at.get(i, ()))]
        if not text and not things and deeper is not None and deeper > level:
            return
        units.append(Unit(len(units) + 1, text, level, list(path), list(path)))
        for thing in things:
            thing.unit_number = thing.unit_number or len(units)

    for i, p in enumerate(paragraphs):
        if levels[i] is not None:
            close(i - 1, levels[i])
            while stack and stack[-1][0] >= levels[i]:
                stack.pop()
            stack.append((levels[i], p.text.strip()))
            level, path, lines, start, payload = levels[i], [t for _, t in stack if t], [], i, held(i)
            continue
        payload = payload or held(i)
        following = next((h for h in heads if h > i), None)
        if path and not payload and p.page_break and following is not None and filled[following]:
            close(i)
            start, lines, payload = i + 1, [], False
        elif p.text.strip():
            lines.append(p.text.strip())
            payload = True
    close(len(paragraphs) - 1)
    return units


def _notes(package: Package, member: str, tag: str, kind: str) -> list[Part]:
    return [Part(kind, raw_text(n), attribute(n, "id") or "") for n in find_all(package.root(member), tag) if attribute(n, "id") not in ("-1", "0")]


def read(data: bytes, path: str | None = None) -> Iterator[Document]:
    refuse_encrypted_ooxml(data)
    package = Package(data)
    root = package.root("word/document.xml")
    body = next(iter(find_all(root, "body")), None)
    links = package.relationships("word/document.xml")
    styles = {attribute(s, "styleId") or "": value(child(s, "name")) or "" for s in find_all(package.root("word/styles.xml"), "style")}
    elements = children(body, "p") if body is not None else []
    paragraphs = [_paragraph(p, styles) for p in elements]
    doc = Document("docx", body_text(body), metadata=core_properties(package))

    tables_at: dict[int, list[Table]] = {}
    seen = -1
    for e in body if body is not None else ():
        seen += local(e) == "p"
        for t in find_all(e, "tbl") if local(e) == "tbl" else ():
            table = Table([["\n".join(raw_text(p) for p in find_all(cell, "p")) for cell in children(row, "tc")] for row in children(t, "tr")])
            doc.tables.append(table)
            tables_at.setdefault(max(0, seen), []).append(table)

    captions: dict[str, tuple[str, str]] = {}
    anchors: dict[str, list[int]] = {}
    is_caption = lambda p: bool(_CAPTION.search(value(child(child(p, "pPr"), "pStyle")) or ""))
    for i, p in enumerate(elements):
        for drawing in find_all(p, "drawing"):
            shape = next((e for e in find_all(drawing, "cNvPr")), None)
            caption, description = (shape.get("name", ""), shape.get("descr", "")) if shape is not None else ("", "")
            caption = next((t for box in find_all(drawing, "txbx") if (t := raw_text(box))), caption)
            before, after = elements[i - 1] if i else None, elements[i + 1] if i + 1 < len(elements) else None
            if before is not None and is_caption(before) and _flag(child(child(before, "pPr"), "keepNext")) and raw_text(before):
                caption = raw_text(before)
            elif after is not None and is_caption(after) and raw_text(after):
                caption = raw_text(after)
            for blip in find_all(drawing, "blip")[:1]:
                if rel := attribute(blip, "embed"):
                    captions[rel] = (caption, description)
                    anchors.setdefault(rel, []).append(i)
    images_at: dict[int, list[Image]] = {}
    for rel, (kind, target, _) in links.items():
        if kind == "image" and target in package:
            content = package.bytes(target)
            caption, description = captions.get(rel, ("", ""))
            image = Image(len(doc.images) + 1, images.content_type(content, target), content, None, *images.size(content), target.rpartition("/")[2], caption, description)
            doc.images.append(image)
            for i in sorted(set(anchors.get(rel, []))):
                images_at.setdefault(i, []).append(image)

    doc.units = sectioned(paragraphs, images_at, tables_at)
    if not any(p.level is not None for p in paragraphs):
        title = doc.metadata.get("title", "")
        doc.units = [Unit(1, doc.full_text, location=[title] if title else [])]
        for thing in (*doc.images, *doc.tables):
            thing.unit_number = 1

    for p in paragraphs:
        doc.parts.append(Part("paragraph", p.text, p.style or "", {k: v for k, v in (("alignment", p.alignment), ("page_break", "true" if p.page_break else None)) if v}))
    doc.parts += [Part("run", r["text"], str(i), {k: v for k, v in r.items() if k != "text"}) for i, p in enumerate(paragraphs) for r in p.runs]
    doc.parts += [Part("style", s) for s in sorted({p.style for p in paragraphs if p.style})]
    for e in find_all(body, "hyperlink"):
        kind, target, _ = links.get(attribute(e, "id") or "", ("", "", False))
        if kind == "hyperlink":
            doc.parts.append(Part("link", raw_text(e), target))
    doc.parts += [Part("formula", latex, "display" if shown else "inline") for latex, shown in omml.formulas(body)]
    doc.parts += _notes(package, "word/footnotes.xml", "footnote", "footnote") + _notes(package, "word/endnotes.xml", "endnote", "endnote")
    doc.parts += [Part("comment", raw_text(c), attribute(c, "id") or "", {k: attribute(c, k) or "" for k in ("author", "date")}) for c in find_all(package.root("word/comments.xml"), "comment")]
    for kind, target, _ in links.values():
        if kind in ("header", "footer") and (part := package.root(target)) is not None and (text := "\n".join(t for p in find_all(part, "p") if (t := raw_text(p)).strip())):
            doc.parts.append(Part(kind, text, next((k for k in ("first", "even") if k in target.lower()), "default")))
    for section in find_all(body, "sectPr"):
        size, margins = child(section, "pgSz"), child(section, "pgMar")
        inches = {name: value(e, key) for name, e, key in (("width", size, "w"), ("height", size, "h"), ("left", margins, "left"), ("right", margins, "right"), ("top", margins, "top"), ("bottom", margins, "bottom"))}
        attrs = {k: str(int(v) / 1440) for k, v in inches.items() if v and v.lstrip("-").isdigit()}
        if (turn := value(size, "orient")) and turn != "portrait":
            attrs["orientation"] = turn
        doc.parts.append(Part("section", "", attrs=attrs))
    yield doc
