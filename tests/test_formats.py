import json

import pytest
import samples

from docquarry import cli, routing, serialization
from docquarry.errors import Encrypted, ExtractionError, Failed, TooLarge, UnsupportedFormat, ZipBomb
from docquarry.formats import aes, dispatch, html, package, pdf_tables, rtf
from docquarry.formats.package import Limits, Package


def one(kind, data):
    docs = list(dispatch.read_as(kind, data, f"x.{kind}"))
    assert len(docs) == 1
    return docs[0]


def test_docx_sections_tables_and_parts():
    doc = one("docx", samples.docx())
    assert [(u.text, u.heading_path) for u in doc.units] == [("text one", ["One"]), ("text two", ["One", "Deeper"])]
    assert doc.tables[0].data == [["a", "b"], ["c\nd", "e"]] and doc.tables[0].unit_number == 1
    assert doc.full_text.startswith("before\nOne\ntext one\na\nb\nc d\ne") and "$\\frac{x}{2}$" in doc.full_text
    assert doc.metadata["title"] == "A title" and doc.metadata["author"] == "Ada"
    assert (doc.images[0].width, doc.images[0].height, doc.images[0].content_type) == (3, 2, "image/png")
    assert [(c.text, c.attrs["author"]) for c in doc.parts_of("comment")] == [("why?", "Bo")]
    assert doc.parts_of("section")[0].attrs == {"width": "8.5", "height": "11.0"}


def test_xlsx_name_row_and_text():
    doc = one("xlsx", samples.xlsx())
    assert doc.full_text == "Blatt 1\nTabelle 1 Unnamed: 1\n     ColA       ColB\n        1          2"
    assert doc.tables[0].data == [["ColA", "ColB"], ["1", "2"]]


def test_pptx_order_and_roles():
    doc = one("pptx", samples.pptx())
    assert [u.text for u in doc.units] == ["The title\nthe body"]
    assert [p.text for p in doc.parts_of("footer")] == ["foot"]


def test_opendocument_text_and_sheets():
    doc = one("odt", samples.odt())
    assert doc.full_text == "lead\nTop\na  b\nx" and doc.tables[0].data == [["x"]]
    assert [(u.text, u.heading_path) for u in doc.units][-1][1] == ["Title", "Top"]
    sheet = one("ods", samples.ods())
    assert sheet.full_text == "Sheet1\nName\tAge\nA\t25" and sheet.tables[0].data == [["Name", "Age"], ["A", "25"]]


def test_epub_counts_missing_spine_items():
    doc = one("epub", samples.epub())
    assert [(u.unit_number, u.name, u.text) for u in doc.units] == [(2, "Chapter A", "Some text.")]
    assert doc.tables[0].data == [["1"]] and doc.metadata["title"] == "Book"


@pytest.mark.parametrize("kind, data", [("zip", samples.zipped()), ("tgz", samples.tarred()), ("tar", samples.tarred("")), ("7z", samples.seven_zip()), ("7z", samples.seven_zip("copy"))])
def test_archives(kind, data):
    docs = list(dispatch.read_as(kind, data, f"t.{kind}"))
    assert [(d.path, d.full_text) for d in docs] == [(f"t.{kind}!/a.txt", "alpha"), (f"t.{kind}!/sub/b.txt", "beta")]


def test_encrypted_files_are_refused():
    with pytest.raises(Encrypted):
        list(dispatch.read_as("7z", samples.seven_zip(aes=True), "t.7z"))
    with pytest.raises(Encrypted):
        one("docx", samples.compound({"EncryptedPackage": b"x"}))
    with pytest.raises(Encrypted):
        one("doc", samples.doc("x" * 100, flags=0x100))
    with pytest.raises(Encrypted):
        one("xls", samples.xls(password=True))
    with pytest.raises(Encrypted):
        one("pdf", samples.pdf(b"", key=b"k"))


def test_zip_bomb_limits():
    data = samples.package({"a.txt": "a" * 10_000})
    with pytest.raises(ZipBomb):
        Package(data, Limits(entry_ratio=5))
    with pytest.raises(ZipBomb):
        Package(samples.package({"a": "1", "b": "2"}), Limits(entries=1))
    with pytest.raises(Failed):
        package.parse_xml(b'<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>')


def test_doc_sections_and_line_tables():
    doc = one("doc", samples.doc("Title line of the document that is long enough to be found as text\rIntro\rhello\rA B C D 1 2 3 4\rChapter 1\rwords here\rSubsection in Chapter 1\rend"))
    assert [(u.text, u.heading_level) for u in doc.units][1:] == [("hello", 1), ("words here", 1), ("end", 2)]
    assert doc.tables[0].data == [["A", "B", "C", "D"], ["1", "2", "3", "4"]]


def test_ppt_slides_notes_and_pictures():
    doc = one("ppt", samples.ppt())
    assert [u.text for u in doc.units] == ["First title\nBody\nmore", "Second"]
    assert [(p.ref, p.text) for p in doc.parts_of("note")] == [("1", "Say this")]
    assert [(i.unit_number, i.content_type) for i in doc.images] == [(1, "image/png")]


def test_xls_values_and_text():
    doc = one("xls", samples.xls())
    assert doc.tables[0].data == [["colA", "colB"], ["1", "2"], ["2023-03-15", "True"]]
    assert doc.full_text.splitlines()[1].split() == ["1", "2"]


def test_xls_unit_begins_with_its_first_value():
    """A header narrower than what stands below it is padded, but not at the unit's begin."""
    from docquarry.formats.compose import xls

    doc = one("xls", xls("t", [("1000", "a"), ("12345", "b")]))
    assert doc.units[0].text == doc.full_text == "key  name\n 1000     a\n12345     b"


def test_msg_addresses_body_and_attachments():
    doc = one("msg", samples.msg())
    mail = doc.email
    assert (mail.subject, mail.from_email.name, mail.from_email.address) == ("Subject!", "Ada", "ada@x.org")
    assert [(a.name, a.address) for a in mail.to] == [("Bo", "bo@y.org")]
    assert mail.body_plain == "Hello\r\nthere" and mail.date == "2024-01-01T10:00:00+00:00"
    assert [a.filename for a in mail.attachments] == ["a.txt"] and [d.full_text for d in dispatch.attachments(doc)] == ["attached"]


def test_eml_mbox_and_mhtml():
    eml = b"From: Ada <a@x.org>\nTo: Bo <b@y.org>\nSubject: =?utf-8?q?H=C3=A9?=\nDate: Sat, 22 Nov 2008 15:04:59 +1100\n\nPlain email.\n"
    doc = one("eml", eml)
    assert doc.email.subject == "Hé" and doc.email.date == "2008-11-22T04:04:59+00:00" and doc.full_text == "Plain email."
    box = b"From a Mon Jan 01 10:00:00 2024\n" + eml + b"\nFrom b Mon Jan 01 10:00:00 2024\n" + eml
    assert len(list(dispatch.read_as("mbox", box, "x.mbox"))) == 2
    page = one("mhtml", b'Content-Type: text/html\nContent-Transfer-Encoding: quoted-printable\n\n<html><body><p>caf=C3=A9</p></body></html>')
    assert page.full_text == "café"


def test_rtf_body_tables_and_pages():
    text = r"{\rtf1\ansi\uc1{\fonttbl{\f0\froman\fcharset0\fprq2 Times New Roman;}}{\info{\title A title}{\creatim\yr2024\mo1\dy2}}First\par \trowd\intbl a\cell b\cell\row\page Second \u228?\'e4\par}"
    doc = one("rtf", text.encode())
    assert doc.full_text.startswith("c1First") and doc.full_text.endswith("Second ää")
    assert len(doc.units) == 2 and doc.tables[0].data == [["a", "b"]]
    assert doc.metadata["title"] == "A title" and doc.metadata["created"] == "2024-01-02T00:00:00"
    assert [f.text for f in doc.parts_of("font")] == ["Times New Roman"]
    assert rtf.plain(r"{\b bold} {\*\x gone}\tab end") == "bold end"


def test_pdf_text_and_tables():
    page = b"BT /F1 12 Tf 72 700 Td (Hello) Tj ( PDF) Tj 0 -20 Td (In millions 12/31/2024 12/31/2023) Tj 0 -14 Td (Revenue 1,234 1,100) Tj 0 -14 Td (Costs 900 850) Tj ET"
    data = samples.pdf(page, b"BT /F1 10 Tf 50 500 Td (Second) Tj ET")
    for variant in (data, data.replace(b"startxref", b"startxxxx")):
        doc = one("pdf", variant)
        assert [u.text.splitlines()[0] for u in doc.units] == ["Hello PDF", "Second"]
        assert doc.tables[0].data == [["In millions", "12/31/2024", "12/31/2023"], ["Revenue", "1,234", "1,100"], ["Costs", "900", "850"]]


def test_pdf_numbers():
    assert [pdf_tables.is_numeric_token(t) for t in ("1,234", "(5.0)", "–3%", "a1", "-", "")] == [True, True, True, False, False, False]
    assert pdf_tables.fitted(["1", "20", "30"], 2) == ["20", "30"] and pdf_tables.fitted(["1", "234", "5"], 2) == ["234", "5"]
    assert pdf_tables.token_runs(["a b", "c d", "", "x"]) == [[["a", "b"], ["c", "d"]]]


def test_aes_known_answer():
    key, block = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert aes.cbc_encrypt(key, bytes(16), block).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert aes.cbc_decrypt(bytes(range(32)), bytes(16), aes.cbc_encrypt(bytes(range(32)), bytes(16), block * 3)) == block * 3


def test_html_rules():
    doc = html.extract_markup("<html lang='en'><head><title>T</title><meta name=author content=Me></head><body><h2>Head</h2><p>a<br>b<script>x</script></p><ul><li>one<li>two</ul><table><tr><th>N<th>Long<tr><td>1<td>2</table><a href='/x'>go</a></body></html>")
    assert "Head\n" in doc.full_text and "x" not in doc.full_text.replace("/x", "")
    assert doc.metadata["author"] == "Me" and doc.metadata["language"] == "en"
    assert [(p.ref, p.text) for p in doc.parts_of("link")] == [("/x", "go")]


def test_plain_and_errors(tmp_path):
    assert one("txt", b" Hello World \n").full_text == "Hello World"
    with pytest.raises(UnsupportedFormat):
        dispatch.get_extractor("a.exe")
    with pytest.raises(ExtractionError):
        one("docx", b"no package")
    path = tmp_path / "a.txt"
    path.write_text("12345")
    with pytest.raises(TooLarge):
        list(dispatch.read_file(path, 4))
    assert next(dispatch.read_file(path, 0)).full_text == "12345"


def test_routing():
    assert routing.file_type("A.TAR.GZ") == "tgz" and routing.file_type("x.potm") == "pptm" and routing.file_type("y.exe") is None
    assert routing.is_supported_file("b.htm") and not routing.is_supported_mime_type("image/png")


def test_json_round_trip():
    for kind, data in (("docx", samples.docx()), ("msg", samples.msg()), ("ods", samples.ods())):
        doc = one(kind, data)
        assert serialization.from_json(json.loads(json.dumps(serialization.to_json(doc)))) == doc
    assert serialization.to_json(one("docx", samples.docx()), binary=False)["images"][0]["data"] is None
    with pytest.raises(ValueError):
        serialization.from_json({"a": 1})


def test_cli(tmp_path, capsys):
    path = tmp_path / "a.txt"
    path.write_text("hello")
    assert cli.main([str(path)]) == 0 and capsys.readouterr().out == "hello\n"
    assert cli.main([str(path), "--json"]) == 0 and json.loads(capsys.readouterr().out)["full_text"] == "hello"
    assert cli.main([str(path), "--json-unit"]) == 0 and json.loads(capsys.readouterr().out)[0]["text"] == "hello"
    assert cli.main([str(path), "--binary"]) == 1 and cli.main([str(tmp_path / "none")]) == 1 and cli.main([str(path), "--what"]) == 1


@pytest.mark.parametrize("tag", ["div", "p", "ul><li", "table><tr><td", "h1", "span", "a href=x", "blockquote"])
def test_deep_markup_is_read(tag):
    doc = html.extract_markup("<body>" + f"<{tag}>" * 20_000 + "deep down")
    assert "deep down" in doc.full_text


def test_nested_blocks_and_lists():
    doc = html.extract_markup("<body><div><div><p>one</p></div>two</div><ul><li>a<ul><li>b</li></ul></li><li>c</li></ul><div><div> x </div></div><span>y</span></body>")
    assert doc.full_text == "one\ntwo\n\n- a - b\n- c\n\nx\ny"


@pytest.mark.parametrize("em, wide", [(2048, False), (1000, True)])
def test_digits_that_are_mapped_to_nothing_are_told_by_their_glyphs(em, wide):
    from docquarry.formats import truetype

    sizes = list(zip(map(int, truetype._WIDE.split()), map(int, truetype._TALL.split())))
    # Glyph 2 is the digit 9, glyph 3 the digit 8 and so on.
    boxes = [(0, 0), (700, 700)] + [(round(w * em / 2048), round(h * em / 2048)) for w, h in reversed(sizes)]
    data = samples.pdf_with_lost_digits(samples.truetype(boxes, em, wide), [1, 11, 2, 10, 1])
    assert next(dispatch.read_as("pdf", data)).full_text == "A091A"
    assert next(dispatch.read_as("pdf", samples.pdf_with_lost_digits(b"no font", [1, 11, 1]))).full_text.replace("\0", "") == "AA"


def test_glyphs_and_digits_are_matched_one_to_one():
    from docquarry.formats import truetype

    # Two glyphs of a size take the two nearest digits, the lesser glyph the nearer one.
    assert truetype.digits_of({7: (540, 1472), 5: (540, 1472)}, 2048) == {5: 1, 7: 2}
    assert truetype.digits_of({}, 2048) == {} and truetype.glyph_boxes(b"", [1]) == (0, {})
    assert len(set(truetype.digits_of({g: (960, 1497) for g in range(12)}, 2048).values())) == 10
