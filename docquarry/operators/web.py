"""HTML operators over a column of markup, for tables that hold pages as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("tables", T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))),
        T.StructField("headings", T.ArrayType(T.StructType([T.StructField("level", T.StringType()), T.StructField("text", T.StringType())]))),
        T.StructField("links", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("href", T.StringType())]))),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("error", T.StringType()),
    ]
)
_ARROW = pa.struct(
    [
        ("text", pa.string()),
        ("tables", pa.list_(pa.list_(pa.list_(pa.string())))),
        ("headings", pa.list_(pa.struct([("level", pa.string()), ("text", pa.string())]))),
        ("links", pa.list_(pa.struct([("text", pa.string()), ("href", pa.string())]))),
        ("metadata", pa.map_(pa.string(), pa.string())),
        ("error", pa.string()),
    ]
)


#: Pages that are Python objects at a time: so many, or so many characters of markup or one page.
_ROWS, _CHARACTERS = 256, 1 << 20


def _pages(batches: Iterator[pa.Array], terminated: bool) -> Iterator[pa.Array]:
    from ..formats.html import extract_markup

    def one(markup: str | None) -> dict | None:
        if markup is None:
            return None
        try:
            doc = extract_markup(markup, terminated=terminated)
        except Exception as error:  # one page's failure is that page's row
            return {"error": f"{type(error).__name__}: {error}"[:2000]}
        return {
            "text": doc.full_text,
            "tables": [t.data for t in doc.tables],
            "headings": [{"level": p.ref, "text": p.text} for p in doc.parts_of("heading")],
            "links": [{"text": p.text, "href": p.ref} for p in doc.parts_of("link")],
            "metadata": list(doc.metadata.items()),
        }

    for batch in batches:
        rows, held = [], 0
        for markup in batch:
            markup = markup.as_py()
            rows.append(one(markup))
            held += len(markup or "")
            if len(rows) == _ROWS or held >= _CHARACTERS:
                yield pa.array(rows, _ARROW)
                rows, held = [], 0
        # An empty batch has its answer too.
        if rows or not len(batch):
            yield pa.array(rows, _ARROW)
        batch = markup = rows = None


def parsed_pages(pages: DataFrame, html_col: str = "html", out: str = "page", terminated: bool = False) -> DataFrame:
    """pages with a struct of what its markup holds in place of the markup; NULL stays NULL, and
    of a page that can't be read there is only the error. References without their semicolon
    ("&amp" where a text was cut) are read as browsers do, or with terminated stay as written.

    The struct is computed once a row, whatever number of its fields is used later: it counts as
    nondeterministic, or the optimizer would compute it again in every filter on a field (explode
    brings one of its own), with workers beside those that compute it for the result. Rows should
    be filtered by other columns before, as such filters stay above it."""
    kept = [c for c in pages.columns if c != html_col]

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _pages(batches, terminated)

    return pages.select(*kept, F.arrow_udf(read, PAGE).asNondeterministic()(F.col(html_col)).alias(out))


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", terminated: bool = False) -> DataFrame:
    return parsed_pages(pages.select(id_col, html_col), html_col, terminated=terminated).select(id_col, F.posexplode("page.links").alias("link_idx", "l")).select(id_col, "link_idx", "l.text", "l.href")


def headings(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", terminated: bool = False) -> DataFrame:
    return parsed_pages(pages.select(id_col, html_col), html_col, terminated=terminated).select(id_col, F.posexplode("page.headings").alias("heading_idx", "h")).select(id_col, "heading_idx", "h.level", "h.text")


def tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", terminated: bool = False) -> DataFrame:
    found = parsed_pages(pages.select(id_col, html_col), html_col, terminated=terminated).select(id_col, F.posexplode("page.tables").alias("table_idx", "data"))
    return found.select(id_col, "table_idx", "data", F.size("data").alias("rows"), F.coalesce(F.array_max(F.transform("data", F.size)), F.lit(0)).alias("columns"))


def texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", terminated: bool = False) -> DataFrame:
    return parsed_pages(pages.select(id_col, html_col), html_col, terminated=terminated).select(id_col, F.col("page.text").alias("text"))


def metadata(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", terminated: bool = False) -> DataFrame:
    fields = ("title", "language", "charset", "description", "keywords", "author")
    return parsed_pages(pages.select(id_col, html_col), html_col, terminated=terminated).select(id_col, *[F.col("page.metadata")[f].alias(f) for f in fields])
