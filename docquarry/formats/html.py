"""HTML to text, tables, headings, links and metadata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

from .record import Document, Part, Table, Unit, tidy

DROPPED = frozenset("script style noscript iframe object embed applet".split())
VOID = frozenset("br hr img input meta link area base col embed param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset("p div section article header footer nav aside main blockquote pre address figure figcaption form fieldset ul ol li dl dt dd table tr hr br".split())

_SPACE = re.compile(r"\s+")
_META_CHARSET = re.compile(rb"""<meta[^>]+charset=["']?([^"'\s>]+)""", re.I)
_CONTENT_CHARSET = re.compile(r"charset=([^\s;]+)", re.I)
_AMPERSAND = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


class Node:
    """Unclosed elements nest, so a tree may be as deep as its markup is long: nothing here recurses."""

    __slots__ = ("tag", "attrs", "children", "text", "tail", "_whole", "_begin", "_end")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs = tag, attrs
        self.children: list[Node] = []
        self.text: list[str] = []
        self.tail: list[str] = []
        self._whole = ""
        self._begin = self._end = 0

    def walk(self) -> Iterator["Node"]:
        waiting = [self]
        while waiting:
            node = waiting.pop()
            yield node
            waiting.extend(reversed(node.children))

    def measure(self) -> None:
        """Note for every node which part of the text of all is in it."""
        pieces: list[str] = []
        size = 0
        waiting = [(self, False)]
        while waiting:
            node, left = waiting.pop()
            if left:
                node._end = size
                more = "".join(node.tail)
            else:
                node._begin = size
                more = "".join(node.text)
                waiting.append((node, True))
                waiting.extend((child, False) for child in reversed(node.children))
            pieces.append(more)
            size += len(more)
        whole = "".join(pieces)
        for node in self.walk():
            node._whole = whole

    def all_text(self) -> str:
        """The text in it, without its own tail."""
        return self._whole[self._begin : self._end]


class TreeBuilder(HTMLParser):
    """An end tag closes only what is open last; text after a closed element is its tail. In
    an element that is dropped every start tag goes one deeper and every end tag one back."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("root", {})
        self._open = [self.root]
        self._closed: Node | None = None
        self._dropping = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self._dropping or tag in DROPPED:
            self._dropping += 1
            return
        node = Node(tag, {name: value for name, value in attrs if value is not None})
        self._open[-1].children.append(node)
        self._closed = node if tag in VOID else None
        if tag not in VOID:
            self._open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if self._dropping:
            self._dropping -= 1
        elif self._open[-1].tag == tag and len(self._open) > 1:
            self._closed = self._open.pop()

    def handle_data(self, data: str) -> None:
        if not self._dropping:
            (self._open[-1].text if self._closed is None else self._closed.tail).append(data)


def parse(markup: str) -> Node:
    builder = TreeBuilder()
    builder.feed(markup)
    builder.close()
    builder.root.measure()
    return builder.root


def only_terminated(markup: str) -> str:
    """The markup with every ampersand escaped that begins no whole reference: a known name or a
    number, and a semicolon. A reader then takes "&amp" as it is written, not for "&"."""
    return _AMPERSAND.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + m[0][1:], markup)


def decode(data: bytes) -> str:
    """By byte-order mark, then a charset among the first 8192 bytes, else UTF-8."""
    if data.startswith(b"\xef\xbb\xbf"):
        return data[3:].decode("utf-8", "replace")
    for mark, name in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    named = _META_CHARSET.search(data[:8192])
    try:
        return data.decode(named[1].decode("ascii", "ignore") if named else "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def _clean(text: str) -> str:
    return _SPACE.sub(" ", text.strip())


def table_rows(table: Node) -> list[list[str]]:
    """Rows of the table and of those within it; rows without cells are left out."""
    rows = ([_clean(cell.all_text()) for cell in row.children if cell.tag in ("th", "td")] for row in table.walk() if row.tag == "tr")
    return [row for row in rows if row]


def aligned(rows: list[list[str]]) -> str:
    columns = max(map(len, rows), default=0)
    widths = [max((len(row[i]) for row in rows if i < len(row)), default=0) for i in range(columns)]
    return "\n".join(" | ".join((row[i] if i < len(row) else "").ljust(w) for i, w in enumerate(widths)).rstrip() for row in rows)


class _Renderer:
    def __init__(self) -> None:
        self.tables: list[list[list[str]]] = []

    def leaf(self, node: Node) -> str | None:
        """The text of a node whose children aren't looked at one by one."""
        tag = node.tag
        if tag == "table":
            rows = table_rows(node)
            self.tables.append(rows)
            return f"\n{aligned(rows)}\n"
        if tag in HEADINGS:
            return f"\n{_clean(node.all_text())}\n"
        return {"br": "\n", "hr": "\n---\n"}.get(tag)

    @staticmethod
    def closed(node: Node, depth: int, pieces: list[str]) -> str:
        if node.tag == "li":
            return "  " * depth + "- " + _clean("".join(pieces)) + "\n"
        if node.tag not in BLOCKS:
            return "".join(pieces)
        if len(pieces) == 1 and len(node.children) == 1 and node.children[0].tag in BLOCKS - {"li", "br", "hr", "table"}:
            return pieces[0]  # a block in nothing but a block has its line breaks already
        return f"\n{''.join(pieces).strip()}\n"

    def render(self, top: Node) -> str:
        found = self.leaf(top)
        if found is not None:
            return found
        # What is open: a node, its depth in lists, its children that are left, and its text so far.
        stack = [(top, 0, iter(top.children), [t for t in ("".join(top.text),) if t])]
        while True:
            node, depth, children, pieces = stack[-1]
            child = next(children, None)
            if child is None:
                stack.pop()
                text = self.closed(node, depth, pieces)
                if not stack:
                    return text
                pieces, child = stack[-1][3], node
            else:
                text = self.leaf(child)
                if text is None:
                    stack.append((child, depth + (node.tag == "li"), iter(child.children), [t for t in ("".join(child.text),) if t]))
                    continue
            pieces.extend(t for t in (text, "".join(child.tail)) if t)


def page_metadata(nodes: list[Node]) -> dict[str, str]:
    found = dict.fromkeys(("title", "language", "charset", "description", "keywords", "author"), "")
    for node in nodes:
        if node.tag == "title":
            found["title"] = node.all_text().strip()
            break
    for node in nodes:
        if node.tag == "html":
            found["language"] = node.attrs.get("lang", "")
            break
    for node in nodes:
        if node.tag != "meta":
            continue
        get = node.attrs.get
        if "charset" in node.attrs:
            found["charset"] = node.attrs["charset"]
        named = _CONTENT_CHARSET.search(get("content", "")) if get("http-equiv", "").lower() == "content-type" else None
        if named:
            found["charset"] = named[1]
        name = get("name", "").lower()
        if name in ("description", "keywords", "author") and get("content"):
            found[name] = get("content")
    return found


def extract_markup(markup: str, file_type: str = "html", terminated: bool = False) -> Document:
    """References without their semicolon are read as browsers do, or with terminated as plain text."""
    root = parse(only_terminated(markup) if terminated else markup)
    nodes = list(root.walk())
    parts = []
    for node in nodes:
        if node.tag in HEADINGS and (text := _clean(node.all_text())):
            parts.append(Part("heading", text, node.tag))
    for node in nodes:
        if node.tag == "a" and node.attrs.get("href") and (text := _clean(node.all_text())):
            parts.append(Part("link", text, node.attrs["href"]))
    renderer = _Renderer()
    text = renderer.render(next((n for n in nodes if n.tag == "body"), root))
    text = tidy(text, blanks=False)
    text = "\n".join(line.strip() for line in text.split("\n")).strip()
    return Document(file_type, text, [Unit(1, text)], [Table(rows, 1) for rows in renderer.tables], parts=parts, metadata=page_metadata(nodes))


def read(data: bytes, path: str | None = None) -> Iterator[Document]:
    yield extract_markup(decode(data))
