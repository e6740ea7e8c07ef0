"""Binary presentations: slide texts, notes, masters and pictures."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from ..errors import Encrypted, LegacyParsing
from .blips import pictures, records
from .ole import CompoundFile, has_encryption, shown
from .record import Document, Part, Unit

_HEADER, _CHARS, _BYTES, _STRING = 0x0F9F, 0x0FA0, 0x0FA8, 0x0FBA
_LIST, _PERSIST = 0x0FF0, 0x03F3
_SLIDE, _NOTES, _MASTER = 0x03EE, 0x03F0, 0x03F8
_TITLES, _BODIES, _NOTE = (0, 6), (1, 5, 7, 8), 2

_CONTROLS = {c: None for c in range(32) if c not in (9, 10)} | {13: "\n", 11: "\n", 12: "\n"}
_META = "title subject author keywords comments last_saved_by revision_number category company manager creating_application".split()

Block = tuple[str, int | None]


@dataclass
class Slide:
    body: list[str]
    other: list[str]
    notes: list[str]
    title: str | None = None

    @property
    def text(self) -> str:
        return "\n".join([*([self.title] if self.title else []), *self.body, *self.other])


def clean(text: str) -> str:
    """Lines with single blanks, without the prompts of slide masters."""
    lines = (" ".join(line.split()) for line in text.translate(_CONTROLS).split("\n"))
    return "\n".join(x for x in lines if x and x != "*" and not x.startswith(("___PPT", "Click to edit")) and not x.endswith("Outline Level"))


def _text(kind: int, content: bytes) -> str:
    try:
        return clean(content.decode("latin-1" if kind == _BYTES else "utf-16-le"))
    except UnicodeDecodeError:
        return ""


def _listed(data: bytes) -> list[list[Block]]:
    """Texts by slide from the slide lists. Slides without text count only until a text has come."""
    slides: list[list[Block]] = []
    for kind, instance, _, content, _, _ in records(data):
        if kind != _LIST or instance:
            continue
        current: list[Block] | None = None
        style: int | None = None
        found: list[list[Block]] = []
        seen = False
        for inner, _, _, piece, _, _ in records(content):
            if inner == _PERSIST:
                if current is not None and (current or not seen):
                    found.append(current)
                current = []
            elif inner == _HEADER and len(piece) >= 4:
                style = struct.unpack_from("<I", piece)[0]
            elif inner in (_CHARS, _BYTES) and (text := _text(inner, piece)):
                seen = True
                if current is not None:
                    current.append((text, style))
        if current is not None and (current or not seen):
            found.append(current)
        slides += found
    return slides


def _contained(data: bytes) -> dict[int, list[list[Block]]]:
    """Texts by slide, notes page and master from the containers."""
    found: dict[int, list[list[Block]]] = {_SLIDE: [], _NOTES: [], _MASTER: []}
    open_: list[tuple[int, int]] = []
    style: int | None = None
    for kind, _, container, content, start, end in records(data):
        while open_ and start >= open_[-1][1]:
            open_.pop()
        if container:
            open_.append((kind, end))
            if kind in found:
                found[kind].append([])
        elif kind == _HEADER and len(content) >= 4:
            style = struct.unpack_from("<I", content)[0]
        elif kind in (_CHARS, _BYTES, _STRING):
            inside = next((k for k, _ in reversed(open_) if k in found), None)
            if inside is not None and (text := _text(kind, content)):
                found[inside][-1].append((text, style))
    return {k: [blocks for blocks in groups if blocks] for k, groups in found.items()}


def _slide(blocks: list[Block]) -> Slide:
    slide = Slide([], [], [])
    for text, style in blocks:
        if style in _TITLES and not slide.title:
            slide.title = text
        elif style in _BODIES:
            slide.body.append(text)
        elif style == _NOTE:
            slide.notes.append(text)
        else:
            slide.other.append(text)
    return slide


def read(data: bytes, path: str | None = None) -> Iterator[Document]:
    ole = CompoundFile(data)
    if has_encryption(ole) or "EncryptedSummary" in ole or "EncryptedSummaryInformation" in ole:
        raise Encrypted("the presentation is encrypted")
    stream = ole.stream("PowerPoint Document")
    if stream is None:
        raise LegacyParsing("no presentation in the file")
    contained = _contained(stream)
    slides = [_slide(blocks) for blocks in _listed(stream) or contained[_SLIDE]]
    for slide, blocks in zip(slides, contained[_NOTES]):
        slide.notes += [t for t, _ in blocks if t not in slide.notes]
    if not any(s.title or s.body or s.other or s.notes for s in slides):
        raw = [t for kind, _, _, content, _, _ in records(stream) if kind in (_CHARS, _BYTES, _STRING) and (t := _text(kind, content))]
        if raw:
            slides.append(Slide([], raw, []))
    found = ole.properties()
    doc = Document("ppt", metadata={k: shown(found.get(k)) for k in _META})
    doc.metadata |= {"created": shown(found.get("create_time")), "modified": shown(found.get("last_saved_time")), **{f"num_{k}": str(found.get(k) or 0) for k in ("slides", "notes", "hidden_slides")}}
    doc.images = pictures((kind, instance, content) for kind, instance, _, content, _, _ in records(ole.stream("Pictures") or b""))
    if doc.images and not slides:
        slides.append(Slide([], [], []))
    for i, image in enumerate(doc.images):
        image.unit_number = i % len(slides) + 1
    doc.units = [Unit(i, s.text, name=s.title) for i, s in enumerate(slides, 1)]
    doc.parts = [Part("note", n, str(i)) for i, s in enumerate(slides, 1) for n in s.notes]
    doc.parts += [Part("master", t) for blocks in contained[_MASTER] for t, _ in blocks]
    doc.full_text = "\n".join(t for u in doc.units if (t := u.text.strip()))
    yield doc
