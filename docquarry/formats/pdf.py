"""PDF: text by page, tables and images."""

from __future__ import annotations

import re
import statistics
from collections.abc import Iterator
from dataclasses import dataclass

from . import pdf_tables, truetype
from .pdf_objects import IMAGE_FILTERS, Lexer, Name, Op, Pdf, Stream
from .record import Document, Image, Table, Unit, joined

_GLYPHS = dict(zip("space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash zero one two three four five six seven eight nine colon semicolon less equal greater question at".split(), map(chr, range(32, 65))))
_GLYPHS |= dict(zip("bracketleft backslash bracketright asciicircum underscore grave".split(), "[\\]^_`")) | dict(zip("braceleft bar braceright asciitilde".split(), "{|}~"))
_GLYPHS |= {c: c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"}
_GLYPHS |= dict(bullet="•", endash="–", emdash="—", quoteleft="‘", quoteright="’", quotedblleft="“", quotedblright="”", ellipsis="…", Euro="€", fi="fi", fl="fl", ff="ff", ffi="ffi", ffl="ffl", minus="−", degree="°", section="§", paragraph="¶", copyright="©", registered="®", trademark="™", germandbls="ß", nbspace="\xa0", periodcentered="·", dagger="†", daggerdbl="‡", guillemotleft="«", guillemotright="»", sterling="£", yen="¥", cent="¢", ae="æ", AE="Æ", oslash="ø", Oslash="Ø", dotlessi="ı", lslash="ł", Lslash="Ł")
_ACCENTS = dict(grave="̀", acute="́", circumflex="̂", tilde="̃", dieresis="̈", ring="̊", cedilla="̧", caron="̌")

_HYPHENS = frozenset("-–—")

Matrix = tuple[float, float, float, float, float, float]


def _times(a: Matrix, b: Matrix) -> Matrix:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def glyph_text(name: str) -> str:
    if name in _GLYPHS:
        return _GLYPHS[name]
    found = re.fullmatch(r"uni([0-9A-Fa-f]{4})+|u([0-9A-Fa-f]{4,6})", name)
    if found:
        return chr(int(found[2], 16)) if found[2] else "".join(chr(int(name[i : i + 4], 16)) for i in range(3, len(name), 4))
    for accent, mark in _ACCENTS.items():
        if name.endswith(accent) and len(name) == len(accent) + 1:
            import unicodedata

            return unicodedata.normalize("NFC", name[0] + mark)
    return _GLYPHS.get(name.partition(".")[0], "")


def text_string(value: object) -> str:
    if not isinstance(value, bytes):
        return str(value) if value is not None else ""
    if value.startswith(b"\xfe\xff"):
        return value[2:].decode("utf-16-be", "replace")
    if value.startswith(b"\xef\xbb\xbf"):
        return value[3:].decode("utf-8", "replace")
    return value.decode("cp1252", "replace")


def _unicode_map(data: bytes) -> dict[bytes, str]:
    """Codes to text by a ToUnicode map."""
    found: dict[bytes, str] = {}
    lexer, held = Lexer(data), []
    show = lambda b: b.decode("utf-16-be", "replace")
    while (item := lexer.next()) is not None:
        if not isinstance(item, Op):
            held.append(item)
            continue
        if item == "endbfchar":
            found |= {k: show(v) for k, v in zip(held[::2], held[1::2]) if isinstance(k, bytes) and isinstance(v, bytes)}
        elif item == "endbfrange":
            for low, high, to in zip(held[::3], held[1::3], held[2::3]):
                if not (isinstance(low, bytes) and isinstance(high, bytes)):
                    continue
                first, size = int.from_bytes(low, "big"), len(low)
                for i in range(min(int.from_bytes(high, "big") - first + 1, 65536)):
                    if isinstance(to, list):
                        text = show(to[i]) if i < len(to) and isinstance(to[i], bytes) else ""
                    else:
                        text = show(to[:-2] + (int.from_bytes(to[-2:], "big") + i & 0xFFFF).to_bytes(2, "big")) if isinstance(to, bytes) else ""
                    found[(first + i).to_bytes(size, "big")] = text
        held = []
    return found


class _Font:
    def __init__(self, pdf: Pdf, attrs: dict):
        get = pdf.get
        self.two_bytes = get(attrs.get("Subtype")) == "Type0"
        to_unicode = get(attrs.get("ToUnicode"))
        self.known = _unicode_map(pdf.decoded(to_unicode)) if isinstance(to_unicode, Stream) else {}
        self._tell_digits(pdf, attrs)
        self.sizes = sorted({len(k) for k in self.known}, reverse=True)
        encoding = get(attrs.get("Encoding"))
        base = get(encoding.get("BaseEncoding")) if isinstance(encoding, dict) else encoding
        self.codec = "mac_roman" if base == "MacRomanEncoding" else "cp1252"
        self.differences: dict[int, str] = {}
        if isinstance(encoding, dict):
            code = 0
            for item in get(encoding.get("Differences")) or []:
                item = get(item)
                if isinstance(item, Name):
                    self.differences[code] = glyph_text(item)
                    code += 1
                elif isinstance(item, int):
                    code = item
        self.widths: dict[int, float] = {}
        self.default = 500.0
        if self.two_bytes:
            inner = get((get(attrs.get("DescendantFonts")) or [{}])[0]) or {}
            self.default = float(get(inner.get("DW", 1000)) or 1000)
            items = [get(x) for x in get(inner.get("W")) or []]
            at = 0
            while at + 1 < len(items):
                if isinstance(items[at + 1], list):
                    self.widths |= {items[at] + i: float(get(w) or 0) for i, w in enumerate(items[at + 1])}
                    at += 2
                elif at + 2 < len(items):
                    self.widths |= dict.fromkeys(range(items[at], min(items[at + 1], items[at] + 65535) + 1), float(items[at + 2]))
                    at += 3
                else:
                    break
        else:
            first = get(attrs.get("FirstChar", 0)) or 0
            self.widths = {first + i: float(get(w) or 0) for i, w in enumerate(get(attrs.get("Widths")) or [])}

    def _tell_digits(self, pdf: Pdf, attrs: dict) -> None:
        """Codes that are mapped to NUL are digits, told by their glyphs."""
        lost = {int.from_bytes(code, "big"): code for code, text in self.known.items() if text == "\0"}
        if not lost:
            return
        inner = pdf.get((pdf.get(attrs.get("DescendantFonts")) or [None])[0])
        described = pdf.get(inner.get("FontDescriptor")) if isinstance(inner, dict) else None
        font = pdf.get(described.get("FontFile2")) if isinstance(described, dict) else None
        if isinstance(font, Stream):
            em, boxes = truetype.glyph_boxes(pdf.decoded(font), list(lost))
            self.known |= {lost[glyph]: str(digit) for glyph, digit in truetype.digits_of(boxes, em).items()}

    def decode(self, raw: bytes) -> tuple[str, float, int]:
        """Text, width in thousandths and the number of characters."""
        out, width, count, at = [], 0.0, 0, 0
        while at < len(raw):
            size = 2 if self.two_bytes else 1
            if self.sizes and not self.two_bytes:
                size = next((n for n in self.sizes if raw[at : at + n] in self.known), 1)
            code = raw[at : at + size]
            number = int.from_bytes(code, "big")
            if code in self.known:
                out.append(self.known[code])
            elif number in self.differences:
                out.append(self.differences[number])
            elif self.two_bytes:
                out.append(code.decode("utf-16-be", "replace") if not self.known else "")
            else:
                out.append(code.decode(self.codec, "replace"))
            width += self.widths.get(number, self.default)
            count += 1
            at += size
        return "".join(out), width, count


@dataclass
class Piece:
    x: float
    y: float
    text: str
    size: float
    end: float


class _Page:
    def __init__(self, pdf: Pdf, page: dict):
        self.pdf = pdf
        self.pieces: list[Piece] = []
        self.shown: list[tuple[str, Stream, int | None]] = []
        self.marks: list[int] = []
        self.mark_text: dict[int, str] = {}
        self._open: list[list] = []
        self._fonts: dict[int, _Font] = {}
        contents = pdf.get(page.get("Contents"))
        streams = [pdf.get(c) for c in contents] if isinstance(contents, list) else [contents]
        data = b"\n".join(pdf.decoded(s) for s in streams if isinstance(s, Stream))
        self.run(data, pdf.get(page.get("Resources")) or {}, (1, 0, 0, 1, 0, 0), 0)

    def font(self, resources: dict, name: str) -> _Font | None:
        attrs = self.pdf.get((self.pdf.get(resources.get("Font")) or {}).get(name))
        if not isinstance(attrs, dict):
            return None
        if id(attrs) not in self._fonts:
            self._fonts[id(attrs)] = _Font(self.pdf, attrs)
        return self._fonts[id(attrs)]

    def run(self, data: bytes, resources: dict, ctm: Matrix, depth: int) -> None:
        get, lexer = self.pdf.get, Lexer(data)
        held: list = []
        saved: list[tuple] = []
        tm = line = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
        font: _Font | None = None
        size, spacing, word_spacing, scale, leading, rise = 0.0, 0.0, 0.0, 1.0, 0.0, 0.0

        def show(items: list) -> None:
            nonlocal tm
            if font is None:
                return
            at = _times((1, 0, 0, 1, 0, rise), _times(tm, ctm))
            texts, moved = [], 0.0
            for item in items:
                if isinstance(item, (int, float)):
                    moved -= item / 1000 * size * scale
                    if item < -200 and texts and not texts[-1].endswith(" "):
                        texts.append(" ")
                elif isinstance(item, bytes):
                    text, width, count = font.decode(item)
                    texts.append(text)
                    moved += (width / 1000 * size + count * spacing + (item.count(b" ") * word_spacing if not font.two_bytes else 0)) * scale
            tm = _times((1, 0, 0, 1, moved, 0), tm)
            text = "".join(texts)
            if text:
                after = _times(tm, ctm)
                height = abs(size * (at[3] or at[1]))
                self.pieces.append(Piece(at[4], at[5], text, height, after[4]))
                mark = self._open[-1] if self._open else None
                if mark and mark[0] is not None:
                    if mark[1]:
                        text, mark[1] = mark[1], None
                    self.mark_text[mark[0]] = self.mark_text.get(mark[0], "") + text

        def shift(x: float, y: float) -> None:
            nonlocal tm, line
            tm = line = _times((1, 0, 0, 1, x, y), line)

        while (op := lexer.next()) is not None:
            if not isinstance(op, Op):
                held.append(op)
                continue
            try:
                if op == "q":
                    saved.append((ctm, font, size, spacing, word_spacing, scale, leading, rise))
                elif op == "Q" and saved:
                    ctm, font, size, spacing, word_spacing, scale, leading, rise = saved.pop()
                elif op == "cm":
                    ctm = _times(tuple(map(float, held[-6:])), ctm)
                elif op == "BT":
                    tm = line = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
                elif op == "Tf":
                    font, size = self.font(resources, held[-2]), float(held[-1])
                elif op == "Tc":
                    spacing = float(held[-1])
                elif op == "Tw":
                    word_spacing = float(held[-1])
                elif op == "Tz":
                    scale = held[-1] / 100
                elif op == "TL":
                    leading = float(held[-1])
                elif op == "Ts":
                    rise = float(held[-1])
                elif op in ("Td", "TD"):
                    if op == "TD":
                        leading = -float(held[-1])
                    shift(float(held[-2]), float(held[-1]))
                elif op == "Tm":
                    tm = line = tuple(map(float, held[-6:]))
                elif op == "T*":
                    shift(0, -leading)
                elif op == "Tj":
                    show(held[-1:])
                elif op == "TJ":
                    show(held[-1])
                elif op == "'":
                    shift(0, -leading)
                    show(held[-1:])
                elif op == '"':
                    word_spacing, spacing = float(held[-3]), float(held[-2])
                    shift(0, -leading)
                    show(held[-1:])
                elif op in ("BDC", "BMC"):
                    mark = [self._open[-1][0] if self._open else None, None]
                    props = held[-1] if op == "BDC" else None
                    if isinstance(props, Name):
                        props = get((get(resources.get("Properties")) or {}).get(props))
                    if isinstance(props, dict):
                        mark = [get(props.get("MCID", mark[0])), text_string(get(props.get("ActualText"))) or None]
                    self._open.append(mark)
                    if mark[0] is not None and mark[0] not in self.marks:
                        self.marks.append(mark[0])
                elif op == "EMC" and self._open:
                    self._open.pop()
                elif op == "BI":
                    end = re.compile(rb"[\s]EI(?=[\s]|$)").search(data, lexer.at)
                    lexer.at = end.end() if end else len(data)
                elif op == "Do":
                    what = get((get(resources.get("XObject")) or {}).get(held[-1]))
                    if isinstance(what, Stream):
                        kind = get(what.attrs.get("Subtype"))
                        if kind == "Image":
                            self.shown.append((held[-1], what, self._open[-1][0] if self._open else None))
                        elif kind == "Form" and depth < 12:
                            matrix = tuple(float(get(x)) for x in get(what.attrs.get("Matrix")) or (1, 0, 0, 1, 0, 0))
                            self.run(self.pdf.decoded(what), get(what.attrs.get("Resources")) or resources, _times(matrix, ctm), depth + 1)
            except (IndexError, TypeError, ValueError, AttributeError):
                pass  # an operator with operands that don't fit has no effect
            held = []

    def caption(self, mark: int | None) -> str:
        """Text of the same marked content, or of the next that has some."""
        if mark not in self.marks:
            return ""
        following = self.marks[self.marks.index(mark) :]
        return next((t for m in following if (t := self.mark_text.get(m, "").strip())), "")


def plain_text(pieces: list[Piece]) -> str:
    """Text in the order of the content; a new line where the base line moves, a blank where
    there is a gap."""
    out: list[str] = []
    last: Piece | None = None
    for p in pieces:
        if last is not None:
            tall = max(last.size, p.size, 1.0)
            if abs(p.y - last.y) > tall * 0.4:
                out.append("\n")
            elif p.x - last.end > tall * 0.15 and not out[-1].endswith((" ", "\n")) and not p.text.startswith(" "):
                out.append(" ")
        out.append(p.text)
        last = p
    return "\n".join(line.rstrip() for line in "".join(out).split("\n")).strip()


def spaced_lines(pieces: list[Piece], text: str) -> list[str]:
    """Lines by position, the topmost first; blank lines mark where a block of numbers ends."""
    raw = text.splitlines()
    sizes = [p.size for p in pieces if p.size > 0]
    usual = statistics.median(sizes) if sizes else 10.0
    near = max(1.0, usual * 0.5)
    ordered = sorted(pieces, key=lambda p: (-p.y, p.x))
    if not ordered or ordered[0].y - ordered[-1].y < near:
        return raw
    lines: list[list[Piece]] = []
    for p in ordered:
        if lines and abs(p.y - lines[-1][0].y) <= near:
            lines[-1].append(p)
        else:
            lines.append([p])
    texts = []
    for line in lines:
        out = ""
        last = None
        for p in sorted(line, key=lambda p: p.x):
            if last is not None and p.x - last > max(1.0, usual * 0.4) and out[-1:] not in _HYPHENS and p.text[:1] not in _HYPHENS:
                out += " "
            out += p.text
            last = p.x
        texts.append(" ".join(out.split()))
    if len(lines) < 2:
        return texts
    places = [line[0].y for line in lines]
    wide = max(1.8 * statistics.median(a - b for a, b in zip(places, places[1:])), 1.2 * usual)
    after: dict[int, int] = {}
    before = None
    for i, line in enumerate(texts):
        if not line:
            continue
        if before is not None and (gap := places[before] - places[i]) > wide:
            had, has = pdf_tables.count_numeric_tokens(texts[before]), pdf_tables.count_numeric_tokens(line)
            if had and not has or had >= 2 and has == 1 and gap > 1.6 * wide:
                after[before] = max(0, 4 - (i - before))
        before = i
    return [x for i, line in enumerate(texts) for x in (line, *[""] * after.get(i, 0))]


def _image(pdf: Pdf, name: str, stream: Stream, number: int, page: int, caption: str) -> Image:
    get = pdf.get
    filters = [f for f, _ in pdf.filters(stream)]
    kind = IMAGE_FILTERS.get(filters[-1] if filters else "", "image/png" if filters and filters[-1] == "FlateDecode" else "image/unknown")
    if not caption:
        caption = next((t for key in ("Alt", "Title", "Caption", "TU") if (t := text_string(get(stream.attrs.get(key))).strip())), "")
    width, height = (int(get(stream.attrs.get(k)) or 0) for k in ("Width", "Height"))
    return Image(number, kind, pdf.decoded(stream), page, width, height, name, caption)


def read(data: bytes, path: str | None = None) -> Iterator[Document]:
    pdf = Pdf(data)
    pages = pdf.pages()
    doc = Document("pdf", metadata={"total_pages": str(len(pages))})
    for number, attrs in enumerate(pages, 1):
        page = _Page(pdf, attrs)
        text = plain_text(page.pieces)
        doc.units.append(Unit(number, text))
        plain, spatial = pdf_tables.tables_in(text.splitlines()), pdf_tables.tables_in(spaced_lines(page.pieces, text))
        best = spatial if pdf_tables.score(spatial) > pdf_tables.score(plain) else plain
        doc.tables += [Table(rows, number) for rows in best]
        found = [(name, stream, page.caption(mark)) for name, stream, mark in page.shown]
        if not found:
            objects = pdf.get((pdf.get(attrs.get("Resources")) or {}).get("XObject")) or {}
            found = [(n, s, "") for n, r in objects.items() if isinstance(s := pdf.get(r), Stream) and pdf.get(s.attrs.get("Subtype")) == "Image"]
        doc.images += [_image(pdf, name, stream, i, number, caption) for i, (name, stream, caption) in enumerate(found, 1)]
    doc.full_text = joined([u.text for u in doc.units])
    yield doc
