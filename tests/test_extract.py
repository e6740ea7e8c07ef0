import pytest
import samples

from docquarry.operators import extract
from docquarry.sources import drive, files
from docquarry.operators.relational import FileFilter
from docquarry.streaming import sync

FILES = {"a.docx": samples.docx(), "sub/b.xlsx": samples.xlsx(), "c.zip": samples.zipped(), "d.msg": samples.msg(), "e.html": b"<h1>T</h1><a href='u'>l</a>", "bad.docx": b"nothing", "f.txt": b"plain", "skip.bin": b"x", "g.eml": b"From: a@b.org\nDate: Mon, 01 Jan 2024 10:00:00 +0000\n\nbody"}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    for name, content in FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(content)
    return root


@pytest.fixture(scope="module")
def docs(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("docs") / "t")
    files.read_documents(spark, str(folder), binary=True).write.parquet(out)
    return spark.read.parquet(out)


def named(rows):
    return [(r.path.rpartition("files")[2].partition("/")[2], *r[1:]) for r in rows]


def test_documents_and_errors(docs):
    found = {r.path.rpartition("/")[2] if "!" not in r.path else r.path.partition("!/")[2]: r for r in docs.collect()}
    assert set(found) == {"a.docx", "b.xlsx", "a.txt", "sub/b.txt", "d.msg", "e.html", "bad.docx", "f.txt", "g.eml"}
    assert found["bad.docx"].error.kind == "failed" and found["f.txt"].full_text == "plain"
    assert [r.kind for r in extract.errors(docs).collect()] == ["failed"]


def test_tables_of_the_parts(docs):
    assert {r.path.rpartition("/")[2]: (r.rows, r.columns) for r in extract.tables(docs).collect()} == {"a.docx": (2, 2), "b.xlsx": (2, 2)}
    assert extract.cells(docs).where("path LIKE '%b.xlsx' AND row = 1 AND column = 0").collect()[0].value == "1"
    assert [(r.text, r.href) for r in extract.links(docs).collect()] == [("l", "u")]
    assert [(r.level, r.text) for r in extract.headings(docs).collect()] == [("h1", "T")]
    assert {r.subject for r in extract.emails(docs).collect()} == {"Subject!", ""}
    assert [(r.filename, r.supported) for r in extract.attachments(docs).collect()] == [("a.txt", True)]
    images = extract.images(docs).collect()
    assert [(r.width, r.height, len(r.data)) for r in images] == [(3, 2, len(samples.PNG))]
    assert extract.parts(docs, "comment").collect()[0].attrs["author"] == "Bo"
    assert {r.unit_number for r in extract.units(docs).where("path LIKE '%a.docx'").collect()} == {1, 2}
    chunk = extract.chunks(docs).where("path LIKE '%a.docx'").orderBy("chunk_index").collect()[0]
    assert (chunk.title, chunk.author, chunk.text) == ("A title", "Ada", "text one")
    assert docs.where("path LIKE '%b.xlsx'").select(extract.full_text().alias("t")).collect()[0].t.startswith("Blatt 1")


def test_limits_filters_and_nulls(spark, folder):
    big = files.read_documents(spark, str(folder), max_file_size=40).collect()
    assert {r.path.rpartition("/")[2] for r in big if r.error and r.error.kind == "too_large"} >= {"a.docx", "c.zip"}
    some = files.read_documents(spark, str(folder), FileFilter(extensions=[".TXT"])).collect()
    assert [r.full_text for r in some] == ["plain"]
    rows = extract.documents(spark.createDataFrame([(None, b"x"), ("a.txt", None), ("b.txt", b""), ("z.exe", b"x")], "path string, content binary")).collect()
    assert {(r.path, r.error.kind if r.error else None) for r in rows} == {(None, "unsupported_format"), ("a.txt", "extraction"), ("b.txt", None), ("z.exe", "unsupported_format")}
    assert files.files(spark, str(folder), glob="*.docx").count() == 2


def test_attachments_become_documents(spark):
    rows = extract.documents(spark.createDataFrame([("m.msg", samples.msg())], "path string, content binary"), attachments=True).collect()
    assert [(r.path, r.doc_idx) for r in rows] == [("m.msg", 0), ("m.msg!/a.txt", 1)]


def test_sql_table_function(spark):
    extract.register(spark)
    spark.createDataFrame([("a.txt", b"hello"), ("b.html", b"<p>x</p>")], "path string, content binary").createOrReplaceTempView("some_files")
    found = spark.sql("SELECT e.path, e.full_text, size(e.units) AS n FROM some_files f, LATERAL extract(f.path, f.content) e").collect()
    assert {tuple(r) for r in found} == {("a.txt", "hello", 1), ("b.html", "x", 1)}


def test_stream_and_versions(spark, folder, tmp_path):
    stream = sync.extracted(files.file_stream(spark, str(folder))).select("path", "full_text", "error")
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "path string, modificationTime int, v string")
    new = spark.createDataFrame([("a", 2, "z"), ("a", 3, "w"), ("c", 1, "q")], "path string, modificationTime int, v string")
    assert {tuple(r) for r in sync.merged(old, sync.newest(new)).collect()} == {("b", 1, "y"), ("a", 3, "w"), ("c", 1, "q")}
    seen = []
    sync.upsert(lambda df, n: seen.append((n, df.count())))(new, 4)
    assert seen == [(4, 2)]


def test_windowed_counts_drop_late_files(spark, folder, tmp_path):
    counts = sync.counts_by_window(sync.once_a_version(files.file_stream(spark, str(folder)).drop("content")), delay=None)
    query = counts.writeStream.outputMode("append").format("memory").queryName("window_counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None and "n_files" in spark.table("window_counts").columns


PAGES = {
    "/sites/x.org:/teams/a": {"id": "site"},
    "/sites/site/drive/root/children": {"value": [{"name": "r.docx", "id": "1", "file": {"mimeType": "m"}, "size": 5, "createdDateTime": "2024-01-01T00:00:00Z", "lastModifiedDateTime": "2024-02-01T00:00:00.5Z", "listItem": {"fields": {"Title": "t", "Team": "blue", "Rank": 3, "@odata.etag": "e"}}}], "@odata.nextLink": drive.API + "/more"},
    "/more": {"value": [{"name": "Docs", "id": "f", "folder": {}}]},
    "/sites/site/drive/items/f/children": {"value": [{"name": "s.pdf", "id": "2", "file": {}, "lastModifiedDateTime": "2024-03-01T00:00:00Z"}]},
    "/sites/site/drive/root:/Docs": {"id": "f", "folder": {}},
}


class _Answer:
    status = 200

    def __init__(self, body):
        self._body = body

    def read(self):
        return self._body


def sender(request, timeout):
    import json
    from urllib.error import HTTPError

    if "oauth2" in request.full_url:
        return _Answer(b'{"access_token": "t"}')
    key = request.full_url.removeprefix(drive.API).partition("?")[0]
    if key.endswith("/content"):
        return _Answer(b"bytes of " + key.encode())
    if key not in PAGES:
        import io

        raise HTTPError(request.full_url, 404, "none", {}, io.BytesIO(b"gone"))
    return _Answer(json.dumps(PAGES[key]).encode())


def client():
    return drive.DriveClient("https://x.org/teams/a", drive.AppCredentials("t", "c", "s"), sender)


def test_drive_listing_and_filters():
    found = list(client().files())
    assert [(f.full_path, f.custom_fields) for f in found] == [("r.docx", {"Team": "blue", "Rank": 3}), ("Docs/s.pdf", None)]
    since = drive.parse_iso("2024-02-15T00:00:00Z")
    assert [f.name for f in client().files_modified_since(since)] == ["s.pdf"] and list(client().files_created_since(since)) == []
    assert [f.name for f in client().files(drive.DriveFilter(folder_paths=("Docs", "None", "Docs")))] == ["s.pdf", "s.pdf"]
    assert [f.name for f in client().files(drive.DriveFilter(path_patterns=("Docs/*",), extensions=(".PDF",)))] == ["s.pdf"]
    assert client().download("2").endswith(b"items/2/content") and [f.name for f in client().files_in_folder()] == ["r.docx"]
    with pytest.raises(drive.DriveRequestError) as error:
        client().drives()
    assert error.value.status == 404 and error.value.body == "gone"


def test_drive_as_a_source(spark):
    drive.register(spark)
    reader = spark.read.format("drive").option("site_url", "https://x.org/teams/a").option("sender", "test_extract.sender")
    import os

    before = os.environ.get("PYTHONPATH", "")
    rows = [tuple(r)[:2] for r in reader.load().collect()] if os.path.dirname(__file__) in before else None
    if rows is None:
        options = {"site_url": "https://x.org/teams/a", "sender": f"{__name__}.sender"}
        source = drive._data_source()(options)
        source_reader = source.reader(None)
        rows = [r[:2] for p in source_reader.partitions() for r in source_reader.read(p)]
        stream = source.streamReader(None)
        start = stream.initialOffset()
        assert [r[0] for p in stream.partitions(start, {"time": "2024-02-15T00:00:00Z"}) for r in stream.read(p)] == ["r.docx"]
        assert [r[0] for p in stream.partitions({"time": "2024-02-15T00:00:00Z"}, stream.latestOffset()) for r in stream.read(p)] == ["s.pdf"]
    assert rows == [("r.docx", "1"), ("s.pdf", "2")]


def test_suffixes_known_by_mime_type_alone_are_read(spark, tmp_path):
    from docquarry import routing
    from docquarry.sources.files import files, read_documents

    for name in ("a.xhtml", "b.srt", "c.TXT", "d.exe", "e.Text", "f.txt.br", "g"):
        (tmp_path / name).write_text("<p>text</p>")
    assert sorted(r.path.rpartition("/")[2] for r in read_documents(spark, str(tmp_path)).select("path").collect()) == ["a.xhtml", "b.srt", "c.TXT", "e.Text", "f.txt.br"]
    listed = files(spark, str(tmp_path), glob=routing.supported_glob())
    assert "d.exe" not in {r.path.rpartition("/")[2] for r in listed.select("path").collect()}
    names = spark.createDataFrame([(n,) for n in ("x.pdf", "y.XHTML", ".srt", "a/b.c/d", "p.docx.br", "t.tar.gz", "u.svgz", "w.nws")], "path string")
    for r in names.select("path", routing.file_type_column(names.path).alias("kind")).collect():
        assert r.kind == routing.file_type(r.path)


def test_readers_by_name_limits_and_own_readers(spark):
    from docquarry import routing
    from docquarry.formats import archive, compose, dispatch
    from docquarry.formats.record import Document, Unit
    from docquarry.operators import extract

    rows = [("1", "one"), ("2", "two " * 9)]
    assert next(dispatch.read_docx(compose.docx("T", rows))).metadata["title"] == "T"
    assert set(dispatch.BY_NAME) == {f"read_{k}" for k in routing.READERS} and not hasattr(dispatch, "read_nothing")
    files = spark.createDataFrame([("a.bin", bytearray(compose.zipped("T", rows)))], "path string, content binary")
    assert extract.documents(files, kind="zip", limits=archive.Limits(member=10)).count() == 1
    assert extract.documents(files, kind="zip").count() == 2
    extract.register(spark, kinds=True)
    files.createOrReplaceTempView("made_files")
    assert spark.sql("SELECT x.path FROM made_files f, LATERAL read_zip(f.path, f.content) x").count() == 2
    dispatch.register_reader("mine", lambda data, path=None: iter([Document("mine", data.decode(), [Unit(1, data.decode())])]), "mine .my2")
    try:
        assert [d.full_text for d in dispatch.read_as(routing.file_type("x.MY2"), b"hello")] == ["hello"]
    finally:
        for suffix in ("mine", "my2"):
            del routing._SUFFIXES[suffix]
