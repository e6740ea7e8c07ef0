"""From files to tables: documents, and what is in them, as rows.

`documents` turns rows of (path, content), as Spark's binary file source gives them, into one
row a document; a file that fails gives one row with its error. The other functions explode
that table, so any number of them can share one pass that was written out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema

from .. import routing
from ..formats.archive import Limits
from ..formats.dispatch import MAX_FILE_SIZE

_ADDRESS = "struct<name:string,address:string>"
SCHEMA = (
    "path string, doc_idx int, file_type string, full_text string, detected_encoding string, metadata map<string,string>, "
    "units array<struct<unit_number:int,text:string,heading_level:int,heading_path:array<string>,location:array<string>,name:string>>, "
    "tables array<struct<data:array<array<string>>,unit_number:int>>, "
    "images array<struct<image_number:int,content_type:string,data:binary,unit_number:int,width:int,height:int,name:string,caption:string,description:string,size_bytes:bigint>>, "
    "parts array<struct<kind:string,text:string,ref:string,attrs:map<string,string>>>, "
    f"email struct<from_email:{_ADDRESS},subject:string,to:array<{_ADDRESS}>,cc:array<{_ADDRESS}>,bcc:array<{_ADDRESS}>,reply_to:array<{_ADDRESS}>,in_reply_to:string,message_id:string,date:string,body_plain:string,body_html:string,"
    "attachments:array<struct<filename:string,mime_type:string,data:binary,supported:boolean>>>, "
    "error struct<kind:string,message:string>"
)


def _row(doc, path: str | None, index: int, binary: bool) -> dict:
    row = doc.row()
    row["path"], row["doc_idx"] = doc.path or path, index
    for image in row["images"]:
        image["size_bytes"] = len(image["data"] or b"")
        if not binary:
            image["data"] = None
    for part in row["parts"]:
        part["attrs"] = list(part["attrs"].items())
    if row["email"]:
        for one in row["email"]["attachments"]:
            one["supported"] = routing.is_supported_mime_type(one["mime_type"])
            if not binary:
                one["data"] = None
    row["metadata"] = [(k, None if v is None else str(v)) for k, v in row["metadata"].items()]
    row["error"] = None
    return row


def _failed(path: str | None, kind: str, message: str) -> dict:
    return {"path": path, "doc_idx": 0, "error": {"kind": kind, "message": message[:2000]}}


def rows_of(path: str | None, content: bytes | None, binary: bool = False, attachments: bool = False, most: int = MAX_FILE_SIZE, kind: str | None = None) -> Iterator[dict]:
    """Rows for one file. With attachments, documents in the attachments of its messages too; with
    kind the file is read as that, else as its name says."""
    from ..errors import ExtractionError, TooLarge
    from ..formats.dispatch import attachments as attached
    from ..formats.dispatch import read_as

    try:
        if content is None:
            raise ExtractionError("the file has no content")
        if most and len(content) > most:
            raise TooLarge(len(content), most)
        index = 0
        for doc in read_as(kind or routing.file_type(path or ""), content, path):
            yield _row(doc, path, index, binary)
            index += 1
            for inner in attached(doc) if attachments else ():
                inner.path = f"{path}!/{inner.path}"
                yield _row(inner, path, index, binary)
                index += 1
    except ExtractionError as error:
        yield _failed(path, error.kind, str(error))


def documents(files: DataFrame, binary: bool = False, attachments: bool = False, max_file_size: int = MAX_FILE_SIZE, path_col: str = "path", content_col: str = "content", kind: str | None = None, limits: Limits | None = None) -> DataFrame:
    """One row a document of files (path, content); columns as in SCHEMA. Image and attachment
    bytes are left out unless asked for. A NULL or too large content gives an error row. With
    kind, a type key, all files are read as that, whatever their names; limits are those of
    members of archives."""

    schema = to_arrow_schema(T.StructType.fromDDL(SCHEMA))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..formats import archive

        # A worker may have read for another query before.
        archive.configure(limits)
        for batch in batches:
            for path, content in zip(*batch.columns):
                rows = list(rows_of(path.as_py(), content.as_py(), binary, attachments, max_file_size, kind))
                for at in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows[at : at + 64]], schema=schema)

    return files.select(F.col(path_col).cast("string"), F.col(content_col).cast("binary")).mapInArrow(extract, SCHEMA)


def _exploded(docs: DataFrame, array: str, index: str) -> DataFrame:
    return docs.select("path", "doc_idx", F.posexplode(array).alias(index, "__x"))


def units(docs: DataFrame) -> DataFrame:
    return _exploded(docs, "units", "unit_idx").select("path", "doc_idx", "__x.*")


def tables(docs: DataFrame) -> DataFrame:
    found = _exploded(docs, "tables", "table_idx").select("path", "doc_idx", "table_idx", "__x.unit_number", "__x.data")
    return found.withColumn("rows", F.size("data")).withColumn("columns", F.coalesce(F.array_max(F.transform("data", F.size)), F.lit(0)))


def cells(docs: DataFrame) -> DataFrame:
    """(path, doc_idx, table_idx, row, column, value)."""
    rows = tables(docs).select("path", "doc_idx", "table_idx", F.posexplode("data").alias("row", "__r"))
    return rows.select("path", "doc_idx", "table_idx", "row", F.posexplode("__r").alias("column", "value"))


def images(docs: DataFrame) -> DataFrame:
    return _exploded(docs, "images", "image_idx").select("path", "doc_idx", "__x.*")


def parts(docs: DataFrame, kind: str) -> DataFrame:
    """Pieces of one kind (link, heading, comment, footnote, ...): (path, doc_idx, idx, text, ref, attrs)."""
    mine = docs.withColumn("__p", F.filter("parts", lambda p: p["kind"] == kind))
    return _exploded(mine, "__p", "idx").select("path", "doc_idx", "idx", "__x.text", "__x.ref", "__x.attrs")


def links(docs: DataFrame) -> DataFrame:
    return parts(docs, "link").select("path", "doc_idx", F.col("idx").alias("link_idx"), "text", F.col("ref").alias("href"))


def headings(docs: DataFrame) -> DataFrame:
    return parts(docs, "heading").select("path", "doc_idx", F.col("idx").alias("heading_idx"), F.col("ref").alias("level"), "text")


def emails(docs: DataFrame) -> DataFrame:
    return docs.where("email IS NOT NULL").select("path", "doc_idx", "email.*").drop("attachments")


def attachments(docs: DataFrame) -> DataFrame:
    return _exploded(docs.withColumn("__a", F.col("email.attachments")), "__a", "attachment_idx").select("path", "doc_idx", "attachment_idx", "__x.*")


def errors(docs: DataFrame) -> DataFrame:
    return docs.where("error IS NOT NULL").select("path", "error.kind", "error.message")


def chunks(docs: DataFrame) -> DataFrame:
    """Units that aren't blank, with their document's title and author, for retrieval. Blank
    units are counted by chunk_index all the same."""
    from ..functions.scalars import strip

    found = docs.select("path", "doc_idx", F.col("metadata")["title"].alias("title"), F.coalesce(F.col("metadata")["author"], F.col("metadata")["creator"]).alias("author"), F.posexplode("units").alias("chunk_index", "u"))
    return found.where(strip(F.col("u.text")) != "").select("path", "doc_idx", "chunk_index", "title", "author", F.col("u.unit_number").alias("unit_number"), F.col("u.text").alias("text"))


def full_text(column: Column | None = None) -> Column:
    """The texts of units (a column of that name), joined and stripped."""
    from ..functions.scalars import strip

    return strip(F.array_join(F.transform(F.col("units") if column is None else column, lambda u: u["text"]), "\n"))


def pieces(docs: DataFrame) -> DataFrame:
    """All that is in documents in long form: (path, doc_idx, kind, i, j, k, value).

    Kinds: text; unit, unit_name and heading_path by unit number; cell by table, row and column;
    every kind of part, as text|ref; meta, as name=value; from, to (by place), subject and
    attachment of mails. One pass: a document's pieces are made as one array before they are rows."""

    def piece(kind: Column | str, value: Column, i: Column | int = 0, j: Column | int = 0, k: Column | int = 0) -> Column:
        columns = [F.lit(x) if isinstance(x, (str, int)) else x for x in (kind, i, j, k)]
        return F.struct(columns[0].alias("kind"), *[c.cast("int").alias(n) for c, n in zip(columns[1:], "ijk")], value.alias("value"))

    def each(array: str, make: Callable[[Column, Column], Column]) -> Column:
        return F.transform(array, make)

    units = [
        each("units", lambda u, _: piece("unit", u["text"], u["unit_number"])),
        each("units", lambda u, _: piece("unit_name", u["name"], u["unit_number"])),
        each("units", lambda u, _: piece("heading_path", F.when(F.size(u["heading_path"]) > 0, F.array_join(u["heading_path"], " > ")), u["unit_number"])),
    ]
    cells = F.flatten(each("tables", lambda t, i: F.flatten(F.transform(t["data"], lambda row, j: F.transform(row, lambda v, k: piece("cell", v, i, j, k))))))
    parts = each("parts", lambda p, _: piece(p["kind"], F.concat_ws("|", p["text"], p["ref"])))
    meta = F.transform(F.map_entries("metadata"), lambda e: piece("meta", F.when(e["value"] != "", F.concat_ws("=", e["key"], e["value"]))))
    person = lambda a: F.format_string("%s <%s>", a["name"], a["address"])
    mail = [
        F.array(piece("from", F.when(F.col("email").isNotNull(), person(F.col("email.from_email")))), piece("subject", F.col("email.subject"))),
        each("email.to", lambda a, i: piece("to", person(a), i)),
        each("email.attachments", lambda a, i: piece("attachment", F.concat_ws("|", a["filename"], a["mime_type"], a["supported"].cast("string")), i)),
    ]
    nothing = F.array().cast("array<struct<kind:string,i:int,j:int,k:int,value:string>>")
    every = F.concat(F.array(piece("text", F.col("full_text"))), *[F.coalesce(a, nothing) for a in (*units, cells, parts, meta, *mail)])
    return docs.where("error IS NULL").select("path", "doc_idx", F.explode(every).alias("p")).select("path", "doc_idx", "p.*").where("value IS NOT NULL")


def _udtf(kind: str | None) -> type:
    class Extract:
        """extract(path, content) for LATERAL joins in SQL; without image and attachment bytes."""

        def eval(self, path: str, content: bytes):
            for row in rows_of(path, bytes(content) if content is not None else None, kind=kind):
                for part in row.get("parts") or ():
                    part["attrs"] = dict(part["attrs"])
                if "metadata" in row:
                    row["metadata"] = dict(row["metadata"])
                yield tuple(row.get(n) for n in _TOP)

    return Extract


_TOP = ("path", "doc_idx", "file_type", "full_text", "detected_encoding", "metadata", "units", "tables", "images", "parts", "email", "error")


def register(spark: SparkSession, kinds: bool = False) -> None:
    """Make extract(path, content) known to SQL, and with kinds also read_docx(path, content) and so
    on, for every type key, whatever the names of the files."""
    spark.udtf.register("extract", udtf(_udtf(None), returnType=SCHEMA))
    for kind in routing.READERS if kinds else ():
        spark.udtf.register(f"read_{kind}", udtf(_udtf(kind), returnType=SCHEMA))
