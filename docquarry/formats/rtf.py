"""Rich text: paragraphs, pages, tables, pictures, links, fields and notes.

Two ways of taking the markup off stand side by side: `plain` for a piece (a cell, a link, a
note) and `Body` for the whole document, which follows groups and page breaks. In the body a
`\\u` that isn't followed by a number takes two characters only, so that `\\uc1` leaves "c1"
and `\\ul` leaves "l"; a destination within a skipped one ends the skipping when it closes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from . import images
from .record import Document, Image, Part, Table, Unit, joined, tidy

_SKIPPED = (
    "fonttbl colortbl stylesheet info pict object datafield fldinst ftnsep aftnsep header footer "
    "pnseclvl xmlnstbl rsidtbl mmathPr generator listtable listoverridetable revtbl"
).split()
_SYMBOLS = dict(par="\n", line="\n", tab="\t", lquote="'", rquote="'", ldblquote='"', rdblquote='"', bullet="•", endash="–", emdash="—", enspace="\u2002", emspace="\u2003", qmspace="\u2005")
_MARKS = {"~": "\xa0", "_": "\xad", "-": "\xad"}

_UNICODE = re.compile(r"\\u(-?\d+)\??")
_BYTE = re.compile(r"\\'([0-9a-fA-F]{2})")
_SYMBOL = re.compile(rf"\\({'|'.join(sorted(_SYMBOLS, key=len, reverse=True))}|[~_-])(?:\s+|(?=[\\{{}}])|$)")
_WORD = re.compile(r"\\[a-zA-Z]+(?:-?\d+)?\s?")
_BODY_WORD = re.compile(r"([^\W\d_]+)[\d-]*")
_SKIP = re.compile(rf"\\(?:\*|{'|'.join(_SKIPPED)})")
_IGNORED = re.compile(r"\{\\(?:pict|object|\*)", re.I)
_NO_BRACES = dict.fromkeys(map(ord, "{}"))
_QUOTED_LINK = re.compile(r'HYPERLINK\s+"([^"]+)"', re.I)


def group_end(text: str, start: int) -> int:
    """Just after the brace that closes the one at start."""
    depth = 0
    for found in re.compile("[{}]").finditer(text, start):
        depth += 1 if found[0] == "{" else -1
        if not depth:
            return found.end()
    return len(text)


def _without(text: str, opening: re.Pattern, shallow: int | None = None) -> str:
    """Without the groups that begin so; with shallow only those nested no deeper."""
    out, at = [], 0
    while found := opening.search(text, at):
        end = group_end(text, found.start())
        keep = False
        if shallow is not None:
            depth = most = 0
            for c in text[found.start() : end]:
                depth += (c == "{") - (c == "}")
                most = max(most, depth)
            keep = most > shallow or depth != 0
        out.append(text[at : found.start()])
        if keep:
            out.append(text[found.start() : found.end()])
            at = found.end()
        else:
            at = end
    out.append(text[at:])
    return "".join(out)


def plain(text: str) -> str:
    """A piece of markup as text."""
    text = _without(text, _IGNORED)
    text = _UNICODE.sub(lambda m: chr(int(m[1]) & 0xFFFF), text)
    text = _BYTE.sub(lambda m: chr(int(m[1], 16)), text)
    text = _SYMBOL.sub(lambda m: _SYMBOLS.get(m[1]) or _MARKS[m[1]], text)
    text = _WORD.sub("", text)
    return tidy(text.translate(_NO_BRACES)).strip()


class Body:
    """The text of the whole document, and its pages."""

    def __init__(self, text: str):
        self.out: list[str] = []
        self.pages: list[str] = []
        self._page: list[str] = []
        self._read(text)
        self._turn()

    def _add(self, piece: str) -> None:
        self.out.append(piece)
        self._page.append(piece)

    def _turn(self) -> None:
        page = tidy("".join(self._page).strip())
        if page:
            self.pages.append(page)
        self._page = []

    def _read(self, text: str) -> None:
        depth, skipping = 0, 0
        at, n = 0, len(text)
        special = re.compile(r"[\\{}]")
        while at < n:
            c = text[at]
            if c == "{":
                depth += 1
                if _SKIP.match(text, at + 1):
                    skipping = depth
                at += 1
            elif c == "}":
                if skipping == depth:
                    skipping = 0
                depth -= 1
                at += 1
            elif c == "\\" and not skipping:
                at = self._control(text, at)
            else:
                found = special.search(text, at + (c == "\\"))
                end = found.start() if found else n
                end = max(end, at + 1)
                if not skipping:
                    self._add(text[at:end].replace("\r", ""))
                at = end

    def _control(self, text: str, at: int) -> int:
        after = text[at + 1 : at + 2]
        if after and after in "\\{}":
            self._add(after)
            return at + 2
        if after == "u":
            found = _UNICODE.match(text, at)
            if found:
                self._add(chr(int(found[1]) & 0xFFFF))
            return found.end() if found else at + 2
        if after == "'":
            found = _BYTE.match(text, at)
            if found:
                self._add(chr(int(found[1], 16)))
            return at + 4
        word = _BODY_WORD.match(text, at + 1)
        if not word:
            if after in ("~", "_"):
                self._add(_MARKS[after])
            return at + 2
        if word[1] in ("page", "sbkpage"):
            self._turn()
        elif word[1] in _SYMBOLS:
            self._add(_SYMBOLS[word[1]])
        return word.end() + (text[word.end() : word.end() + 1] == " ")


def body_of(text: str) -> Body:
    for name, depth in (("fonttbl", 2), ("colortbl", 1), ("stylesheet", 2), ("info", 2)):
        text = _without(text, re.compile(r"\{\\" + name, re.I), depth)
    for name in ("header", "footer"):
        text = _without(text, re.compile(r"\{\\\*?\\?" + name + r"[lrf]?\s", re.I), 2)
    return Body(_without(text, re.compile(r"\{\\\*\\[a-z]", re.I), 2))


def _groups(text: str, word: str) -> Iterator[tuple[int, str]]:
    """Place and inside of every group that begins with a control word."""
    for found in re.finditer(r"\{\\" + word + r"(?![a-zA-Z])", text):
        yield found.start(), text[found.end() : group_end(text, found.start()) - 1]


def _inner(text: str) -> Iterator[str]:
    """The groups directly in a piece."""
    at = 0
    while (start := text.find("{", at)) >= 0:
        at = group_end(text, start)
        yield text[start:at]


def _number(text: str, word: str) -> int | None:
    found = re.search(rf"\\{word}(-?\d+)", text)
    return int(found[1]) if found else None


def iso_date(text: str) -> str:
    """Year, month and day, and the time to the minute; "" without a date."""
    parts = [_number(text, word) for word in ("yr", "mo", "dy", "hr", "min")]
    if None in parts[:3]:
        return ""
    return "{:04}-{:02}-{:02}T{:02}:{:02}:00".format(*(p or 0 for p in parts))


_INFO = dict(title="title", subject="subject", author="author", keywords="keywords", comment="comments", operator="operator", category="category", manager="manager", company="company", doccomm="doc_comment")
_COUNTS = dict(version="version", vern="revision", nofpages="num_pages", nofwords="num_words", nofchars="num_chars", nofcharsws="num_chars_with_spaces")


def info(text: str) -> dict[str, str]:
    found = dict.fromkeys([*_INFO.values(), "created", "modified"], "") | dict.fromkeys(_COUNTS.values(), "0")
    for _, inside in _groups(text, "info"):
        for group in _inner(inside):
            word = re.match(r"\{\\(?:\*\\)?([a-z]+)", group)
            if not word:
                continue
            if word[1] in _INFO:
                rest = _BYTE.sub(lambda m: chr(int(m[1], 16)), group[word.end() : -1]).replace("\\~", " ")
                found[_INFO[word[1]]] = re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+\d*\s*", "", rest)).strip()
            elif word[1] in _COUNTS:
                found[_COUNTS[word[1]]] = str(_number(group, word[1]) or 0)
            elif word[1] in ("creatim", "revtim"):
                found["created" if word[1] == "creatim" else "modified"] = iso_date(group)
        break
    return found


def _cells(row: str) -> list[str]:
    out = []
    for piece in re.split(r"\\cell\b", row)[:-1]:
        cell = re.sub("[0-9a-fA-F]{64,}", "", plain(piece))
        cell = re.sub(r" *\n *", "\n", re.sub(r"[ \t\f\v]+", " ", cell))
        out.append(tidy(cell, blanks=False).strip())
    return out


def tables(text: str, page_at: Callable[[int], int]) -> list[Table]:
    """Rows from every row definition to the next row's end. More than 100 characters of markup
    with more than 20 of text between two rows part two tables; rows are filled up."""
    ends = [m.end() for m in re.finditer(r"\\row\b", text)]
    found: list[tuple[int, list[list[str]]]] = []
    rows: list[list[str]] = []
    last, k = -1, 0
    for start in (m.start() for m in re.finditer(r"\\trowd\b", text)):
        while k < len(ends) and ends[k] <= start:
            k += 1
        if k == len(ends):
            break
        if rows and start - last > 100 and len(plain(text[last:start])) > 20:
            rows = []
        cells = _cells(text[start : ends[k]])
        if cells:
            if not rows:
                found.append((start, rows))
            rows.append(cells)
        last = ends[k]
    out = []
    for start, rows in found:
        width = max(map(len, rows))
        out.append(Table([row + [""] * (width - len(row)) for row in rows], page_at(start)))
    return out


_PICTURES = {"pngblip": "image/png", "jpegblip": "image/jpeg", "emfblip": "image/x-emf", "wmetafile": "image/x-wmf"}


def _pictures(text: str, page_at: Callable[[int], int]) -> list[Image]:
    found = []
    for start, inside in _groups(text, "pict"):
        kind = next((k for word, k in _PICTURES.items() if f"\\{word}" in inside), "application/octet-stream")
        runs = re.search("[0-9a-fA-F]{20,}", inside)
        data = bytes.fromhex(runs[0][: len(runs[0]) // 2 * 2]) if runs else None
        found.append(Image(len(found) + 1, kind if data is None else images.content_type(data) if kind == "application/octet-stream" else kind, data, page_at(start), _number(inside, "picw") or 0, _number(inside, "pich") or 0))
    return found


def _fields(text: str) -> Iterator[Part]:
    for _, inside in _groups(text, "field"):
        how = next((i for _, i in _groups(inside, r"fldinst")), None) or next((i for _, i in _groups(inside, r"\*\\fldinst")), "")
        shown = plain(next((i for _, i in _groups(inside, "fldrslt")), ""))
        link = _QUOTED_LINK.search(how)
        if link:
            yield Part("link", shown, link[1].strip())
        elif "HYPERLINK" not in how.upper():
            order = plain(how)
            kind = next((k.lower() for k in ("PAGE", "DATE", "TIME", "STYLEREF", "TOC") if k in order.upper()), "unknown")
            yield Part("field", shown, kind, {"instruction": order})


def _named(group: str) -> str:
    """The name at the end of an entry, without its control words and inner groups."""
    rest = re.sub(r"\{[^{}]*\}", " ", group[1:-1])
    return re.sub(r"\\[a-zA-Z*]+(?:-?\d+)? ?", "", rest.replace("\\*", "")).strip("; \r\n")


def _tables_of_the_header(text: str) -> Iterator[Part]:
    for _, inside in _groups(text, "fonttbl"):
        for font in _inner(inside):
            number, family = re.search(r"\\f(\d+)", font), re.search(r"\\f(nil|roman|swiss|modern|script|decor|tech|bidi)\b", re.sub(r"\\fbidi\b", "", font))
            name = _named(font)
            if number:
                yield Part("font", name, number[1], {"family": family[1] if family else "", "charset": str(_number(font, "fcharset") or 0), "pitch": str(_number(font, "fprq") or 0)})
    for _, inside in _groups(text, "colortbl"):
        for i, c in enumerate(m for m in inside.split(";") if "\\red" in m):
            yield Part("color", "#{:02x}{:02x}{:02x}".format(*(_number(c, w) or 0 for w in ("red", "green", "blue"))), str(i))
    for _, inside in _groups(text, "stylesheet"):
        for style in _inner(inside):
            number = re.search(r"\\(s|cs|ts|ds)(\d+)", style)
            name = _named(style)
            if name:
                kind = {"cs": "character", "ts": "table"}.get(number[1] if number else "", "paragraph")
                yield Part("style", name, number[2] if number else "0", {"type": kind, **{k: str(v) for k, w in (("based_on", "sbasedon"), ("next", "snext")) if (v := _number(style, w)) is not None}})


def _decoded(data: bytes) -> str:
    for name in ("utf-8", "cp1252"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1")


def read(data: bytes, path: str | None = None) -> Iterator[Document]:
    text = _decoded(data)
    doc = Document("rtf")
    if not text.startswith("{\\rtf"):
        doc.full_text = text
        doc.units = [Unit(1, text)] if text else []
        yield doc
        return
    breaks = [m.start() for m in re.finditer(r"\\page\b", text)]
    page_at = lambda place: 1 + sum(b < place for b in breaks)
    body = body_of(text)
    doc.metadata = info(text)
    paragraphs = [p.strip() for p in "".join(body.out).split("\n") if p.strip()]
    doc.full_text = "\n".join(paragraphs)
    doc.units = [Unit(i, page) for i, page in enumerate(body.pages, 1)] or ([Unit(1, doc.full_text)] if doc.full_text else [])
    doc.full_text = doc.full_text or joined([u.text for u in doc.units])
    doc.tables, doc.images = tables(text, page_at), _pictures(text, page_at)
    doc.parts = [Part("paragraph", p) for p in paragraphs]
    doc.parts += _tables_of_the_header(text)
    for kind in ("header", "footer"):
        for side in ("", "l", "r", "f"):
            doc.parts += [Part(kind, t, kind + side) for _, inside in _groups(text, kind + side) if (t := plain(inside))]
    doc.parts += _fields(text)
    doc.parts += [Part("footnote", t, str(i)) for i, (_, inside) in enumerate(_groups(text, "footnote"), 1) if (t := plain(inside))]
    yield doc
