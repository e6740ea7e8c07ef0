"""Small files of every kind, made from scratch."""

import io
import struct
import tarfile
import zipfile
import zlib

PNG = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in ((b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(b"\0\1\2\3\0\4\5\6")), (b"IEND", b"")))


def package(members: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(name, content)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
CORE = '<cp:coreProperties xmlns:cp="c" xmlns:dc="d" xmlns:t="t"><dc:title>A title</dc:title><dc:creator>Ada</dc:creator><t:created>2024-01-02T03:04:05Z</t:created></cp:coreProperties>'


def rels(*targets: tuple[str, str, str]) -> str:
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(f"""<Relationship Id="{i}" Type="{REL}/{kind}" Target="{t}"/>""" for i, kind, t in targets)}</Relationships>'


def paragraph(text: str, style: str = "") -> str:
    return f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'


def docx() -> bytes:
    cell = "<w:tc>{}</w:tc>".format
    table = f"<w:tbl><w:tr>{cell(paragraph('a'))}{cell(paragraph('b'))}</w:tr><w:tr>{cell(paragraph('c') + paragraph('d'))}{cell(paragraph('e'))}</w:tr></w:tbl>"
    formula = "<w:p><m:oMath><m:f><m:num><m:r><m:t>x</m:t></m:r></m:num><m:den><m:r><m:t>2</m:t></m:r></m:den></m:f></m:oMath></w:p>"
    body = paragraph("before") + paragraph("One", "H1") + paragraph("text one") + table + paragraph("Deeper", "H2") + paragraph("text two") + formula
    return package(
        {
            "word/document.xml": f"<w:document {W} {R}><w:body>{body}<w:sectPr><w:pgSz w:w='12240' w:h='15840'/></w:sectPr></w:body></w:document>",
            "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>',
            "word/_rels/document.xml.rels": rels(("rId1", "image", "media/image1.png")),
            "word/media/image1.png": PNG,
            "word/comments.xml": f'<w:comments {W}><w:comment w:id="1" w:author="Bo" w:date="2024-01-01">{paragraph("why?")}</w:comment></w:comments>',
            "docProps/core.xml": CORE,
        }
    )


def xlsx() -> bytes:
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" t="s"><v>2</v></c></row><row r="3"><c r="A3"><v>1</v></c><c r="B3"><v>2</v></c></row>'
    return package(
        {
            "xl/workbook.xml": f'<workbook {s} {R}><sheets><sheet name="Blatt 1" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": rels(("rId1", "worksheet", "worksheets/sheet1.xml")),
            "xl/worksheets/sheet1.xml": f"<worksheet {s}><sheetData>{rows}</sheetData></worksheet>",
            "xl/sharedStrings.xml": f"<sst {s}><si><t>Tabelle 1</t></si><si><t>ColA</t></si><si><t>ColB</t></si></sst>",
            "docProps/core.xml": CORE,
        }
    )


def pptx() -> bytes:
    ns = f'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" {R}'
    shape = lambda kind, text: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}" idx="1"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    return package(
        {
            "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId id="256" r:id="rId1"/></p:sldIdLst></p:presentation>',
            "ppt/_rels/presentation.xml.rels": rels(("rId1", "slide", "slides/slide1.xml")),
            "ppt/slides/slide1.xml": f"<p:sld {ns}><p:cSld><p:spTree>{shape('body', 'the body')}{shape('title', 'The title')}{shape('ftr', 'foot')}</p:spTree></p:cSld></p:sld>",
            "docProps/core.xml": CORE,
        }
    )


ODF = 'xmlns:office="o" xmlns:text="t" xmlns:table="tb" xmlns:draw="d" xmlns:style="s"'


def odt() -> bytes:
    body = '<text:p>lead</text:p><text:h text:outline-level="1">Top</text:h><text:p>a<text:s text:c="2"/>b</text:p><table:table><table:table-row><table:table-cell><text:p>x</text:p></table:table-cell></table:table-row></table:table>'
    return package({"content.xml": f"<office:document-content {ODF}><office:body><office:text>{body}</office:text></office:body></office:document-content>", "meta.xml": f'<office:document-meta {ODF} xmlns:dc="dc"><office:meta><dc:title>Title</dc:title></office:meta></office:document-meta>'})


def ods() -> bytes:
    cell = lambda v, kind="string": f'<table:table-cell office:value-type="{kind}"{f""" office:value="{v}" """ if kind == "float" else ""}><text:p>{v}</text:p></table:table-cell>'
    rows = "".join(f"<table:table-row>{a}{b}</table:table-row>" for a, b in ((cell("Name"), cell("Age")), (cell("A"), cell("25", "float"))))
    return package({"content.xml": f'<office:document-content {ODF}><office:body><office:spreadsheet><table:table table:name="Sheet1">{rows}</table:table></office:spreadsheet></office:body></office:document-content>'})


def epub() -> bytes:
    return package(
        {
            "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>',
            "OPS/book.opf": '<package><metadata><title>Book</title></metadata><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="gone"/><itemref idref="a"/></spine></package>',
            "OPS/a.xhtml": "<html><head><title>Chapter A</title></head><body><p>Some text.</p><table><tr><td>1</td></tr></table></body></html>",
        }
    )


def zipped() -> bytes:
    return package({"a.txt": "alpha", "sub/b.txt": "beta", ".hidden.txt": "no", "__MACOSX/c.txt": "no", "d.bin": "no", "nested.zip": package({"x.txt": "no"})})


def tarred(mode: str = "gz") -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=f"w:{mode}") as t:
        for name, content in (("a.txt", b"alpha"), ("sub/b.txt", b"beta")):
            info = tarfile.TarInfo(name)
            info.size = len(content)
            t.addfile(info, io.BytesIO(content))
    return out.getvalue()


def _number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    size = (n.bit_length() + 7) // 8
    return bytes([0xFF << 8 - size & 0xFF]) + n.to_bytes(size, "little")


def seven_zip(method: str = "lzma2", aes: bool = False) -> bytes:
    """A 7z archive of a.txt and sub/b.txt in one folder."""
    import lzma

    plain = b"alphabeta" * 1
    if method == "lzma2":
        packed = lzma.compress(plain, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 16}])
        coder = b"\x21\x21\x01" + bytes([10])
    else:
        packed, coder = plain, b"\x01\x00"
    if aes:
        coder = b"\x04\x06\xf1\x07\x01"
    names = b"\0" + "a.txt\0sub/b.txt\0".encode("utf-16-le")
    streams = b"\x06" + _number(0) + _number(1) + b"\x09" + _number(len(packed)) + b"\0"
    streams += b"\x07\x0b" + _number(1) + b"\0" + _number(1) + coder + b"\x0c" + _number(9) + b"\0"
    streams += b"\x08\x0d" + _number(2) + b"\x09" + _number(5) + b"\0" + b"\0"
    header = b"\x01\x04" + streams + b"\x05" + _number(2) + b"\x11" + _number(len(names)) + names + b"\0" + b"\0"
    tail = struct.pack("<QQI", len(packed), len(header), zlib.crc32(header))
    return b"7z\xbc\xaf\x27\x1c\0\4" + struct.pack("<I", zlib.crc32(tail)) + tail + packed + header


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of streams, one storage deep, each in sectors of 512 bytes."""
    blocks: list[bytes] = []
    fat: list[int] = []

    def store(data: bytes) -> int:
        if not data:
            return 0xFFFFFFFE
        first = len(blocks)
        pieces = [data[i : i + 512].ljust(512, b"\0") for i in range(0, len(data), 512)]
        blocks.extend(pieces)
        fat.extend([*range(first + 1, first + len(pieces)), 0xFFFFFFFE])
        return first

    nodes: list[list] = [["Root Entry", 5, [], 0xFFFFFFFE, 0]]
    storages: dict[str, int] = {}
    for path, data in streams.items():
        folder, _, name = path.rpartition("/")
        if folder and folder not in storages:
            storages[folder] = len(nodes)
            nodes[0][2].append(len(nodes))
            nodes.append([folder, 1, [], 0, 0])
        nodes[storages.get(folder, 0)][2].append(len(nodes))
        padded = data.ljust(4096, b"\0")
        nodes.append([name, 2, [], store(padded), len(padded)])
    entries = [[n, k, 0xFFFFFFFF, 0xFFFFFFFF, 0xFFFFFFFF, s, z] for n, k, _, s, z in nodes]
    for i, (_, _, kids, _, _) in enumerate(nodes):
        if kids:
            entries[i][4] = kids[0]
            for a, b in zip(kids, kids[1:]):
                entries[a][3] = b
    directory = b""
    for name, kind, left, right, child, start, size in entries:
        raw = name.encode("utf-16-le")
        directory += raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2, kind, 1, left, right, child) + bytes(36) + struct.pack("<IQ", start, size)
    first_directory = store(directory)
    sectors = 1
    while sectors * 128 < len(fat) + sectors:
        sectors += 1
    at = len(blocks)
    fat += [0xFFFFFFFD] * sectors
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(512 * sectors, b"\xff")
    blocks += [table[i : i + 512] for i in range(0, len(table), 512)]
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH6xIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, sectors, first_directory, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    places = [at + i for i in range(sectors)] + [0xFFFFFFFF] * (109 - sectors)
    return (head + struct.pack("<109I", *places)).ljust(512, b"\0") + b"".join(blocks)


def doc(text: str, flags: int = 0) -> bytes:
    raw = text.encode("cp1252")
    word = bytearray(0x400 + max(len(raw), 64))
    struct.pack_into("<H", word, 0, 0xA5EC)
    struct.pack_into("<H", word, 0x0A, flags)
    struct.pack_into("<I", word, 0x4C, len(raw))
    word[0x400 : 0x400 + len(raw)] = raw
    return compound({"WordDocument": bytes(word)})


def record(kind: int, data: bytes, version: int = 0, instance: int = 0) -> bytes:
    return struct.pack("<HHI", instance << 4 | version, kind, len(data)) + data


def ppt() -> bytes:
    text = lambda style, t: record(0x0F9F, struct.pack("<I", style)) + record(0x0FA0, t.encode("utf-16-le"))
    slides = record(0x03F3, bytes(20)) + text(0, "First title") + text(1, "Body\rmore") + record(0x03F3, bytes(20)) + text(0, "Second") + text(1, "Click to edit this")
    notes = record(0x03F0, text(2, "Say this"), 15)
    pictures = record(0xF01E, bytes(17) + PNG, 0, 0x6E0)
    return compound({"PowerPoint Document": record(0x0FF0, slides, 15) + notes, "Pictures": pictures})


def xls(password: bool = False) -> bytes:
    rec = lambda kind, data: struct.pack("<HH", kind, len(data)) + data
    text = lambda t: struct.pack("<HB", len(t), 0) + t.encode("latin-1")
    strings = ["colA", "colB"]
    sst = struct.pack("<II", 2, 2) + b"".join(map(text, strings))
    styles = rec(0xE0, struct.pack("<HH", 0, 0) + bytes(16)) + rec(0xE0, struct.pack("<HH", 0, 14) + bytes(16))
    bof = rec(0x809, struct.pack("<HH", 0x600, 5) + bytes(12))
    sheet = rec(0x809, struct.pack("<HH", 0x600, 16) + bytes(12))
    for c in (0, 1):
        sheet += rec(0xFD, struct.pack("<HHHI", 0, c, 0, c))
    sheet += rec(0x203, struct.pack("<HHHd", 1, 0, 0, 1.0)) + rec(0x27E, struct.pack("<HHH", 1, 1, 0) + struct.pack("<i", 2 << 2 | 2))
    sheet += rec(0x203, struct.pack("<HHHd", 2, 0, 1, 45000.0)) + rec(0x205, struct.pack("<HHHBB", 2, 1, 0, 1, 0)) + rec(0x0A, b"")
    bound = lambda at: rec(0x85, struct.pack("<IHBB", at, 0, 6, 0) + b"Sheet1")
    head = bof + (rec(0x2F, bytes(4)) if password else b"") + styles
    size = len(head) + len(bound(0)) + len(rec(0xFC, sst)) + 4
    return compound({"Workbook": head + bound(size) + rec(0xFC, sst) + rec(0x0A, b"") + sheet})


def msg() -> bytes:
    wide = lambda t: t.encode("utf-16-le")
    streams = {"__substg1.0_0037001F": "Subject!", "__substg1.0_1000001F": "Hello\r\nthere", "__substg1.0_0C1A001F": "Ada", "__substg1.0_5D01001F": "ada@x.org", "__substg1.0_1035001F": "<1@x>", "__recip_version1.0_#00000000/__substg1.0_3001001F": "Bo", "__recip_version1.0_#00000000/__substg1.0_39FE001F": "bo@y.org", "__substg1.0_007D001F": "Date: Mon, 01 Jan 2024 10:00:00 +0000\n\n", "__attach_version1.0_#00000000/__substg1.0_3707001F": "a.txt", "__attach_version1.0_#00000000/__substg1.0_370E001F": "text/plain"}
    raw = {k: wide(v).ljust(4096, b"\0") for k, v in streams.items()}
    raw["__attach_version1.0_#00000000/__substg1.0_37010102"] = b"attached".ljust(4096, b" ")
    return compound(raw)


def pdf(*pages: bytes, key: bytes | None = None) -> bytes:
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages))), len(pages)), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    for i, content in enumerate(pages):
        packed = zlib.compress(content)
        objects.append(b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (5 + 2 * i))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(packed) + packed + b"\nendstream")
    out, places = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + o + b"\nendobj\n"
    extra = b" /Encrypt << /Filter /Standard /V 1 /R 2 /O (%s) /U (%s) /P -4 >> /ID [(x) (x)]" % (b"o" * 32, b"u" * 32) if key else b""
    return out + b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places) + b"trailer << /Size %d /Root 1 0 R%s >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, extra, len(out))


def truetype(boxes: list[tuple[int, int]], em: int = 2048, wide: bool = False) -> bytes:
    """A font of glyphs without outlines, with these widths and heights."""
    glyphs = [struct.pack(">5h", 1, 0, 0, w, h) for w, h in boxes]
    starts = [10 * i for i in range(len(glyphs) + 1)]
    tables = {
        b"head": bytes(18) + struct.pack(">H", em) + bytes(30) + struct.pack(">h", wide) + bytes(2),
        b"maxp": struct.pack(">IH", 0x10000, len(glyphs)),
        b"loca": struct.pack(f">{len(starts)}{'I' if wide else 'H'}", *(x if wide else x // 2 for x in starts)),
        b"glyf": b"".join(glyphs),
    }
    out, body, at = struct.pack(">IHHHH", 0x10000, len(tables), 0, 0, 0), b"", 12 + 16 * len(tables)
    for tag, data in tables.items():
        out += struct.pack(">4sIII", tag, 0, at + len(body), len(data))
        body += data
    return out + body


def pdf_with_lost_digits(font: bytes, codes: list[int]) -> bytes:
    """A page that shows codes by a font that maps 2 to 11 to NUL and 1 to A."""
    chars = "".join(f"<{c:04X}> <0000>\n" for c in range(2, 12))
    cmap = f"1 begincodespacerange <0000> <FFFF> endcodespacerange 11 beginbfchar <0001> <0041>\n{chars}endbfchar".encode()
    page = b"BT /F1 12 Tf 72 700 Td <%s> Tj ET" % "".join(f"{c:04X}" for c in codes).encode()
    stream = lambda data: b"<< /Length %d >>\nstream\n" % len(data) + data + b"\nendstream"
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 4 0 R >> >> /Contents 8 0 R >>",
        b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /ToUnicode 7 0 R /DescendantFonts [5 0 R] >>", b"<< /Type /Font /Subtype /CIDFontType2 /DW 600 /FontDescriptor 6 0 R >>", b"<< /Type /FontDescriptor /FontFile2 9 0 R >>",
        stream(cmap), stream(page), stream(font),
    ]
    out, places = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + o + b"\nendobj\n"
    return out + b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places) + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, len(out))
