"""Small files of every kind, made of a title and rows of two texts: the other way round from the
readers, so that what they find can be held against the rows. Used by the catalogue's file queries."""

from __future__ import annotations

import io
import lzma
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable
from xml.sax.saxutils import escape

Rows = list[tuple[str, str]]

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_R = f'xmlns:r="{_REL}"'
_SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_SLIDE = f'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" {_R}'
_ODF = 'xmlns:office="o" xmlns:text="t" xmlns:table="tb" xmlns:draw="d" xmlns:style="s" xmlns:dc="dc" xmlns:xlink="x" xmlns:presentation="p" xmlns:svg="v"'


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(width: int, height: int) -> bytes:
    raw = b"".join(b"\0" + bytes(width) for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw)) + _chunk(b"IEND", b"")


def packed(members: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in members.items():
            archive.writestr(zipfile.ZipInfo(name), content)
    return out.getvalue()


def _core(title: str) -> str:
    return f'<cp:coreProperties xmlns:cp="c" xmlns:dc="d" xmlns:t="t"><dc:title>{escape(title)}</dc:title><dc:creator>Ada</dc:creator><t:created>2024-01-02T03:04:05Z</t:created></cp:coreProperties>'


def _relations(*targets: tuple[str, str, str]) -> str:
    one = '<Relationship Id="{}" Type="' + _REL + '/{}" Target="{}"{}/>'
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(one.format(*t, " TargetMode=\'External\'" * (t[1] == "hyperlink")) for t in targets)}</Relationships>'


def _paragraph(text: str, style: str = "", inside: str = "") -> str:
    named = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{named}<w:r><w:t>{escape(text)}</w:t></w:r>{inside}</w:p>"


def docx(title: str, rows: Rows) -> bytes:
    cells = "".join(f"<w:tr>{''.join(f'<w:tc>{_paragraph(c)}</w:tc>' for c in row)}</w:tr>" for row in rows)
    formula = "<m:oMath><m:f><m:num><m:r><m:t>x</m:t></m:r></m:num><m:den><m:r><m:t>2</m:t></m:r></m:den></m:f></m:oMath>"
    link = '<w:hyperlink r:id="rId2"><w:r><w:t>site</w:t></w:r></w:hyperlink>'
    body = _paragraph(title, "H1") + _paragraph(f"All of {title}") + f"<w:tbl>{cells}</w:tbl>" + _paragraph("Last", "H2") + _paragraph(f"{len(rows)} in all") + f"<w:p>{formula}</w:p>" + f"<w:p>{link}</w:p>"
    note = lambda tag, text: f'<w:{tag}s {_W}><w:{tag} w:id="2" w:author="Bo" w:date="2024-01-01">{_paragraph(text)}</w:{tag}></w:{tag}s>'
    return packed(
        {
            "word/document.xml": f"<w:document {_W} {_R}><w:body>{body}<w:sectPr><w:pgSz w:w='12240' w:h='15840'/></w:sectPr></w:body></w:document>",
            "word/styles.xml": f'<w:styles {_W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>',
            "word/_rels/document.xml.rels": _relations(("rId1", "header", "header1.xml"), ("rId2", "hyperlink", "https://x.org/" + title)),
            "word/comments.xml": note("comment", f"why {title}?"),
            "word/footnotes.xml": note("footnote", f"see {title}"),
            "word/header1.xml": f"<w:hdr {_W}>{_paragraph('head of ' + title)}</w:hdr>",
            "docProps/core.xml": _core(title),
        }
    )


def xlsx(title: str, rows: Rows) -> bytes:
    shared = ["key", "name", *(name for _, name in rows)]
    cell = lambda ref, i: f'<c r="{ref}" t="s"><v>{i}</v></c>'
    lines = [f'<row r="1">{cell("A1", 0)}{cell("B1", 1)}</row>'] + [f'<row r="{r}"><c r="A{r}"><v>{key}</v></c>{cell(f"B{r}", r)}</row>' for r, (key, _) in enumerate(rows, 2)]
    return packed(
        {
            "xl/workbook.xml": f'<workbook {_SHEET} {_R}><sheets><sheet name="{escape(title)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": _relations(("rId1", "worksheet", "worksheets/sheet1.xml")),
            "xl/worksheets/sheet1.xml": f"<worksheet {_SHEET}><sheetData>{''.join(lines)}</sheetData></worksheet>",
            "xl/sharedStrings.xml": f"<sst {_SHEET}>{''.join(f'<si><t>{escape(s)}</t></si>' for s in shared)}</sst>",
            "docProps/core.xml": _core(title),
        }
    )


def pptx(title: str, rows: Rows) -> bytes:
    """A slide a row: the key is the title, the name the body; the footer stands in both."""
    shape = lambda kind, text: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}" idx="1"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{escape(text)}</a:t></a:r></a:p></p:txBody></p:sp>'
    slides = {f"ppt/slides/slide{i}.xml": f"<p:sld {_SLIDE}><p:cSld><p:spTree>{shape('body', name)}{shape('title', key)}{shape('ftr', title)}</p:spTree></p:cSld></p:sld>" for i, (key, name) in enumerate(rows, 1)}
    return packed(
        {
            "ppt/presentation.xml": f"<p:presentation {_SLIDE}><p:sldIdLst>{''.join(f'<p:sldId id="{255 + i}" r:id="rId{i}"/>' for i in range(1, len(rows) + 1))}</p:sldIdLst></p:presentation>",
            "ppt/_rels/presentation.xml.rels": _relations(*((f"rId{i}", "slide", f"slides/slide{i}.xml") for i in range(1, len(rows) + 1))),
            **slides,
            "docProps/core.xml": _core(title),
        }
    )


def _open_document(body: str, title: str) -> bytes:
    return packed({"content.xml": f"<office:document-content {_ODF}><office:body>{body}</office:body></office:document-content>", "meta.xml": f"<office:document-meta {_ODF}><office:meta><dc:title>{escape(title)}</dc:title></office:meta></office:document-meta>"})


def _odf_rows(rows: Rows) -> str:
    return "".join(f"<table:table-row>{''.join(f'<table:table-cell><text:p>{escape(c)}</text:p></table:table-cell>' for c in row)}</table:table-row>" for row in rows)


def odt(title: str, rows: Rows) -> bytes:
    text = f'<text:h text:outline-level="1">{escape(title)}</text:h><text:p>All of<text:s text:c="2"/>{escape(title)} <text:a xlink:href="https://x.org/{escape(title)}">site</text:a></text:p><table:table>{_odf_rows(rows)}</table:table>'
    return _open_document(f"<office:text>{text}</office:text>", title)


def ods(title: str, rows: Rows) -> bytes:
    cell = lambda text: f'<table:table-cell office:value-type="string"><text:p>{escape(text)}</text:p></table:table-cell>'
    number = lambda key: f'<table:table-cell office:value-type="float" office:value="{key}"><text:p>{key}</text:p></table:table-cell>'
    lines = [f"<table:table-row>{cell('key')}{cell('name')}</table:table-row>"] + [f"<table:table-row>{number(k)}{cell(n)}</table:table-row>" for k, n in rows]
    return _open_document(f'<office:spreadsheet><table:table table:name="{escape(title)}">{"".join(lines)}</table:table></office:spreadsheet>', title)


def odp(title: str, rows: Rows) -> bytes:
    frame = lambda kind, y, text: f'<draw:frame presentation:class="{kind}" svg:x="1cm" svg:y="{y}cm"><draw:text-box><text:p>{escape(text)}</text:p></draw:text-box></draw:frame>'
    pages = "".join(f'<draw:page draw:name="{escape(key)}">{frame("outline", 3, name)}{frame("title", 1, key)}</draw:page>' for key, name in rows)
    return _open_document(f"<office:presentation>{pages}</office:presentation>", title)


def odg(title: str, rows: Rows) -> bytes:
    shapes = "".join(f"<draw:frame><draw:text-box><text:p>{escape(name)}</text:p></draw:text-box></draw:frame>" for _, name in rows)
    return _open_document(f'<office:drawing><draw:page draw:name="one">{shapes}</draw:page></office:drawing>', title)


def odf(title: str, rows: Rows) -> bytes:
    """The keys as fractions of two."""
    terms = "".join(f"<mfrac><mi>{escape(key)}</mi><mn>2</mn></mfrac><mo>+</mo>" for key, _ in rows)
    return packed({"content.xml": f'<math xmlns="http://www.w3.org/1998/Math/MathML"><mrow>{terms}<mi>z</mi></mrow></math>', "meta.xml": f"<office:document-meta {_ODF}><office:meta><dc:title>{escape(title)}</dc:title></office:meta></office:document-meta>"})


def html(title: str, rows: Rows) -> bytes:
    cells = "".join(f"<tr>{''.join(f'<td>{escape(c)}</td>' for c in row)}</tr>" for row in rows)
    links = "".join(f'<li><a href="/{escape(key)}">{escape(name)}</a></li>' for key, name in rows)
    return f"<html lang=en><head><title>{escape(title)}</title><meta name=author content=Ada></head><body><h2>{escape(title)}</h2><p>All of it<br>here<script>no()</script></p><table>{cells}</table><ul>{links}</ul></body></html>".encode()


def mhtml(title: str, rows: Rows) -> bytes:
    import quopri

    return f"Subject: {title}\r\nMIME-Version: 1.0\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n".encode() + quopri.encodestring(html(title, rows))


def epub(title: str, rows: Rows) -> bytes:
    """A chapter a row, in the order of the spine, which the manifest has the other way round."""
    n = len(rows)
    items = "".join(f'<item id="c{i}" href="c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(n, 0, -1))
    spine = '<itemref idref="gone"/>' + "".join(f'<itemref idref="c{i}"/>' for i in range(1, n + 1))
    return packed(
        {
            "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>',
            "OPS/book.opf": f"<package><metadata><title>{escape(title)}</title></metadata><manifest>{items}</manifest><spine>{spine}</spine></package>",
            **{f"OPS/c{i}.xhtml": f"<html><head><title>{escape(key)}</title></head><body><p>{escape(name)}</p><table><tr><td>{escape(key)}</td></tr></table></body></html>" for i, (key, name) in enumerate(rows, 1)},
        }
    )


def eml(title: str, rows: Rows) -> bytes:
    to = ", ".join(f'"{name}" <s{key}@x.org>' for key, name in rows)
    body = "\r\n".join(f"{key} {name}" for key, name in rows)
    part = "--b\r\nContent-Type: {}\r\n\r\n{}\r\n"
    attached = '--b\r\nContent-Type: text/csv\r\nContent-Disposition: attachment; filename="list.csv"\r\n\r\nkey,name\r\n--b--\r\n'
    return f"From: Ada <ada@x.org>\r\nTo: {to}\r\nSubject: {title}\r\nMessage-ID: <{title}@x>\r\nDate: Mon, 01 Jan 2024 10:00:00 +0000\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n{part.format('text/plain; charset=utf-8', body)}{attached}".encode()


def mbox(title: str, rows: Rows) -> bytes:
    """A message a row."""
    return b"".join(f"From a@x.org Mon Jan  1 10:00:00 2024\nFrom: s{key} <s{key}@x.org>\nTo: b@x.org\nSubject: {title} {key}\nDate: Mon, 01 Jan 2024 10:00:00 +0000\nContent-Type: text/plain\n\n{name}\n\n".encode() for key, name in rows)


def plain(title: str, rows: Rows) -> bytes:
    return "\n".join([title, *(f"{key}\t{name}" for key, name in rows)]).encode()


def rtf(title: str, rows: Rows) -> bytes:
    cells = "".join(rf"\trowd\cellx1000\cellx2000 {key}\cell {name}\cell\row" for key, name in rows)
    return (rf"{{\rtf1\ansi{{\fonttbl{{\f0\froman Times;}}}}{{\info{{\title {title}}}{{\author Ada}}}}\pard {title}\par All of it{{\footnote see {title}}}\par {cells} {{\field{{\*\fldinst HYPERLINK " + f'"https://x.org/{title}"' + r"}{\fldrslt site}}\par}").encode("latin-1")


def pdf(title: str, rows: Rows) -> bytes:
    """A page for the title and one for every row."""
    shown = lambda text: text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("latin-1")
    pages = [b"BT /F1 12 Tf 72 700 Td (%s) Tj ET" % shown(title)] + [b"BT /F1 12 Tf 72 700 Td (%s) Tj 0 -20 Td (%s) Tj ET" % (shown(name), shown("number " + key)) for key, name in rows]
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages))), len(pages)), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    for i, content in enumerate(pages):
        data = zlib.compress(content)
        objects.append(b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (5 + 2 * i))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(data) + data + b"\nendstream")
    out, places = b"%PDF-1.4\n", []
    for i, one in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + one + b"\nendobj\n"
    return out + b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places) + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, len(out))


def zipped(title: str, rows: Rows) -> bytes:
    """A text file a row, and members that aren't read."""
    return packed({**{f"{title}/{key}.txt": name for key, name in rows}, ".hidden.txt": "no", "__MACOSX/c.txt": "no", "d.bin": "no", "nested.zip": packed({"x.txt": "no"})})


def tarred(title: str, rows: Rows) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as archive:
        for key, name in rows:
            info = tarfile.TarInfo(f"{title}/{key}.txt")
            info.size = len(name.encode())
            archive.addfile(info, io.BytesIO(name.encode()))
    return out.getvalue()


def _number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    size = (n.bit_length() + 7) // 8
    return bytes([0xFF << 8 - size & 0xFF]) + n.to_bytes(size, "little")


def seven_zip(title: str, rows: Rows) -> bytes:
    """All rows' text files in one LZMA2 folder."""
    contents = [name.encode() for _, name in rows]
    data = lzma.compress(b"".join(contents), lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 16}])
    names = b"\0" + "".join(f"{title}/{key}.txt\0" for key, _ in rows).encode("utf-16-le")
    streams = b"\x06" + _number(0) + _number(1) + b"\x09" + _number(len(data)) + b"\0"
    streams += b"\x07\x0b" + _number(1) + b"\0" + _number(1) + b"\x21\x21\x01" + bytes([10]) + b"\x0c" + _number(sum(map(len, contents))) + b"\0"
    streams += b"\x08\x0d" + _number(len(rows)) + (b"\x09" + b"".join(_number(len(c)) for c in contents[:-1]) if len(rows) > 1 else b"") + b"\0" + b"\0"
    header = b"\x01\x04" + streams + b"\x05" + _number(len(rows)) + b"\x11" + _number(len(names)) + names + b"\0" + b"\0"
    tail = struct.pack("<QQI", len(data), len(header), zlib.crc32(header))
    return b"7z\xbc\xaf\x27\x1c\0\4" + struct.pack("<I", zlib.crc32(tail)) + tail + data + header


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of streams, one storage deep at most, in sectors of 512 bytes."""
    blocks: list[bytes] = []
    chain: list[int] = []
    end, free = 0xFFFFFFFE, 0xFFFFFFFF

    def store(data: bytes) -> int:
        first = len(blocks)
        pieces = [data[i : i + 512].ljust(512, b"\0") for i in range(0, len(data), 512)]
        blocks.extend(pieces)
        chain.extend([*range(first + 1, first + len(pieces)), end])
        return first

    names: list[tuple[str, int, int, int]] = [("Root Entry", 5, end, 0)]
    held: dict[int, list[int]] = {0: []}
    folders: dict[str, int] = {}
    for path, data in streams.items():
        folder, _, name = path.rpartition("/")
        if folder and folder not in folders:
            folders[folder] = len(names)
            held[0].append(len(names))
            held[len(names)] = []
            names.append((folder, 1, 0, 0))
        held[folders.get(folder, 0)].append(len(names))
        whole = data.ljust(4096, b"\0")
        names.append((name, 2, store(whole), len(whole)))
    right, child = [free] * len(names), [free] * len(names)
    for i, inside in held.items():
        if inside:
            child[i] = inside[0]
        for a, b in zip(inside, inside[1:]):
            right[a] = b
    directory = b""
    for i, (name, kind, start, size) in enumerate(names):
        raw = name.encode("utf-16-le")
        directory += raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2, kind, 1, free, right[i], child[i]) + bytes(36) + struct.pack("<IQ", start, size)
    listed = store(directory)
    sectors = -(-len(chain) // 127)
    at = len(blocks)
    chain += [0xFFFFFFFD] * sectors
    table = struct.pack(f"<{len(chain)}I", *chain).ljust(512 * sectors, b"\xff")
    blocks += [table[i : i + 512] for i in range(0, len(table), 512)]
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH6xIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, sectors, listed, 0, 4096, end, 0, end, 0)
    places = [at + i for i in range(sectors)] + [free] * (109 - sectors)
    return (head + struct.pack("<109I", *places)).ljust(512, b"\0") + b"".join(blocks)


def doc(title: str, rows: Rows) -> bytes:
    raw = "\r".join([title, "These are all the suppliers of one nation, by key and by name", *(f"{key} {name}" for key, name in rows)]).encode("cp1252")
    word = bytearray(0x400 + max(len(raw), 64))
    struct.pack_into("<H", word, 0, 0xA5EC)
    struct.pack_into("<I", word, 0x4C, len(raw))
    word[0x400 : 0x400 + len(raw)] = raw
    return compound({"WordDocument": bytes(word)})


def ppt(title: str, rows: Rows) -> bytes:
    """A slide a row."""
    record = lambda kind, data, version=0: struct.pack("<HHI", version, kind, len(data)) + data
    text = lambda style, t: record(0x0F9F, struct.pack("<I", style)) + record(0x0FA0, t.encode("utf-16-le"))
    slides = b"".join(record(0x03F3, bytes(20)) + text(0, key) + text(1, name + "\rmore") for key, name in rows)
    return compound({"PowerPoint Document": record(0x0FF0, slides, 15)})


def xls(title: str, rows: Rows) -> bytes:
    record = lambda kind, data: struct.pack("<HH", kind, len(data)) + data
    text = lambda t: struct.pack("<HB", len(t), 0) + t.encode("latin-1")
    strings = ["key", "name", *(name for _, name in rows)]
    # A table of strings goes on in records of at most 8224 bytes, cut between strings.
    tables, piece = [], struct.pack("<II", len(strings), len(strings))
    for one in map(text, strings):
        if len(piece) + len(one) > 8000:
            tables.append(piece)
            piece = b""
        piece += one
    shared = b"".join(record(0x3C if i else 0xFC, p) for i, p in enumerate([*tables, piece]))
    styles = record(0xE0, struct.pack("<HH", 0, 0) + bytes(16))
    begin = lambda kind: record(0x809, struct.pack("<HH", 0x600, kind) + bytes(12))
    sheet = begin(16) + b"".join(record(0xFD, struct.pack("<HHHI", 0, c, 0, c)) for c in (0, 1))
    for r, (key, _) in enumerate(rows, 1):
        sheet += record(0x203, struct.pack("<HHHd", r, 0, 0, float(key))) + record(0xFD, struct.pack("<HHHI", r, 1, 0, r + 1))
    named = title.encode("latin-1")
    bound = lambda at: record(0x85, struct.pack("<IHBB", at, 0, len(named), 0) + named)
    head = begin(5) + styles
    return compound({"Workbook": head + bound(len(head) + len(bound(0)) + len(shared) + 4) + shared + record(0x0A, b"") + sheet + record(0x0A, b"")})


def msg(title: str, rows: Rows) -> bytes:
    """A mail whose recipients are the rows."""
    streams = {"__substg1.0_0037001F": title, "__substg1.0_1000001F": "\r\n".join(f"{key} {name}" for key, name in rows), "__substg1.0_0C1A001F": "Ada", "__substg1.0_5D01001F": "ada@x.org", "__substg1.0_1035001F": f"<{title}@x>", "__substg1.0_007D001F": "Date: Mon, 01 Jan 2024 10:00:00 +0000\n\n"}
    for i, (key, name) in enumerate(rows):
        streams |= {f"__recip_version1.0_#{i:08X}/__substg1.0_3001001F": name, f"__recip_version1.0_#{i:08X}/__substg1.0_39FE001F": f"s{key}@x.org"}
    return compound({path: text.encode("utf-16-le").ljust(4096, b"\0") for path, text in streams.items()})


MAKERS: dict[str, Callable[[str, Rows], bytes]] = {
    "docx": docx, "xlsx": xlsx, "pptx": pptx, "odt": odt, "ods": ods, "odp": odp, "odg": odg, "odf": odf, "html": html, "mhtml": mhtml, "epub": epub, "eml": eml, "mbox": mbox, "msg": msg,
    "txt": plain, "tsv": plain, "rtf": rtf, "pdf": pdf, "zip": zipped, "tar.gz": tarred, "7z": seven_zip, "doc": doc, "ppt": ppt, "xls": xls,
}
