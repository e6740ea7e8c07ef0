"""Queries over files of every format, made of the rows of a table, and the SQL over those rows that
says what the readers must find. Files hold the suppliers of a nation, a thousand keys at most."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import extract

_ROWS = """
    r AS (SELECT n_name || '-' || (s_suppkey // 1000) AS title, CAST(s_suppkey AS VARCHAR) AS key, s_name AS name,
        row_number() OVER (PARTITION BY n_name, s_suppkey // 1000 ORDER BY s_suppkey) AS i FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    f AS (SELECT title, count(*) AS n, max(length(key)) AS w1, max(length(name)) AS w2 FROM r GROUP BY title)
"""


def composed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(path, content) of one file a nation."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .formats.compose import MAKERS

        for batch in batches:
            for title, rows in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array([f"{title}.{kind}"]), pa.array([MAKERS[kind](title, [(r["key"], r["name"]) for r in rows])], pa.binary())], names=["path", "content"])

    supplier, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation"))
    held = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("title", F.expr("concat(n_name, '-', s_suppkey div 1000)"))
    rows = held.groupBy("title").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("name")))).alias("rows"))
    return rows.mapInArrow(make, "path string, content binary")


def _piece(kind: str, value: str, of: str = "f", i: str = "0", j: str = "0", k: str = "0", doc: str = "0", path: str = "title || '.{kind}'") -> str:
    return f"SELECT {path} AS path, CAST({doc} AS INTEGER) AS doc_idx, '{kind}' AS kind, CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, CAST({k} AS INTEGER) AS k, {value} AS value FROM {of}"


def _lines(line: str, separator: str = "chr(10)") -> str:
    """The rows of a file as lines."""
    return f"(SELECT string_agg({line}, {separator} ORDER BY i) FROM r WHERE r.title = f.title)"


def _both(value: str, unit: str = "1") -> list[str]:
    return [_piece("text", value), _piece("unit", value, i=unit)]


def _each(kind: str, value: str, **where: str) -> str:
    return _piece(kind, value, "r", **where)


def _cells(header: int = 0) -> list[str]:
    named = [_piece("cell", "'key'"), _piece("cell", "'name'", k="1")] if header else []
    return [*named, _each("cell", "key", j=f"i - 1 + {header}"), _each("cell", "name", j=f"i - 1 + {header}", k="1")]


def _meta(**found: str) -> list[str]:
    return [_piece("meta", f"'{name}=' || {value}") for name, value in found.items()]


_NL = " || chr(10) || "
_OFFICE = _meta(title="title", author="'Ada'", created="'2024-01-02T03:04:05Z'")
_PAIRS = _lines("key || chr(10) || name")
_HTML = [
    *_both("title || chr(10) || chr(10) || 'All of it' || chr(10) || 'here' || chr(10) || chr(10) || " + _lines("rtrim(rpad(key, CAST(f.w1 AS INTEGER), ' ') || ' | ' || name)") + " || chr(10) || chr(10) || " + _lines("'- ' || name")),
    *_cells(), _piece("heading", "title || '|h2'"), _each("link", "name || '|/' || key"), *_meta(title="title", language="'en'", author="'Ada'"),
]
_MAIL = [*_both(_lines("key || ' ' || name", "chr(13) || chr(10)")), _piece("unit_name", "'plain'", i="1"), _piece("from", "'Ada <ada@x.org>'"), _piece("subject", "title"), _each("to", "name || ' <s' || key || '@x.org>'", i="i - 1"), *_meta(date="'2024-01-01T10:00:00+00:00'", message_id="'<' || title || '@x>'", subject="title", body_type="'plain'")]
_PLAIN = _both("title || chr(10) || " + _lines("key || chr(9) || name"))
_MEMBER = {"doc": "i - 1", "path": "title || '.{kind}!/' || title || '/' || key || '.txt'"}
_ARCHIVE = [_each("text", "name", **_MEMBER), _each("unit", "name", i="1", **_MEMBER)]
_GRID = _lines("lpad(key, CAST(greatest(3, f.w1) AS INTEGER), ' ') || '{s}' || lpad(name, CAST(f.w2 AS INTEGER), ' ')")
_HEADER = "'key' || '{s}' || lpad('name', CAST(f.w2 AS INTEGER), ' ')"

_FOUND: dict[str, list[str]] = {
    "docx": [
        _piece("text", f"title{_NL}'All of ' || title{_NL}{_PAIRS}{_NL}'Last'{_NL}n || ' in all'{_NL}'$\\frac{{x}}{{2}}$'{_NL}'site'"),
        _piece("unit", "'All of ' || title", i="1"), _piece("unit", f"n || ' in all'{_NL}'site'", i="2"), _piece("heading_path", "title", i="1"), _piece("heading_path", "title || ' > Last'", i="2"), *_cells(),
        *[_piece("paragraph", p) for p in ("title || '|heading 1'", "'All of ' || title || '|'", "'Last|heading 2'", "n || ' in all|'", "'|'", "'site|'")],
        *[_piece("run", p) for p in ("title || '|0'", "'All of ' || title || '|1'", "'Last|2'", "n || ' in all|3'", "'site|5'")],
        *[_piece(kind, value) for kind, value in (("style", "'heading 1|'"), ("style", "'heading 2|'"), ("link", "'site|https://x.org/' || title"), ("formula", "'\\frac{x}{2}|inline'"), ("footnote", "'see ' || title || '|2'"), ("comment", "'why ' || title || '?|2'"), ("header", "'head of ' || title || '|default'"), ("section", "'|'"))],
        *_OFFICE,
    ],
    "xlsx": [*_both((f"title{_NL}{_HEADER}{_NL}{_GRID}").replace("{s}", " ")), _piece("unit_name", "title", i="1"), *_cells(1), *_OFFICE],
    "pptx": [_piece("text", _PAIRS), _each("unit", "key || chr(10) || name", i="i"), _each("unit_name", "key", i="i"), _each("title", "key || '|' || i"), _each("content", "name || '|' || i"), _each("footer", "title || '|' || i"), *_meta(title="title", author="'Ada'", created="'2024-01-02T03:04:05'")],
    "odt": [_piece("text", f"title{_NL}'All of  ' || title || ' site'{_NL}{_PAIRS}"), _piece("unit", f"'All of  ' || title || ' site'{_NL}{_PAIRS}", i="1"), _piece("heading_path", "title", i="1"), *_cells(), _piece("link", "'site|https://x.org/' || title"), *_meta(title="title")],
    "ods": [*_both(f"title{_NL}'key' || chr(9) || 'name'{_NL}" + _lines("key || chr(9) || name")), _piece("unit_name", "title", i="1"), *_cells(1), *_meta(title="title")],
    "odp": [_piece("text", _PAIRS), _each("unit", "key || chr(10) || name", i="i"), _each("unit_name", "key", i="i"), *_meta(title="title")],
    "odg": [*_both(_lines("name")), *_meta(title="title")],
    "odf": [*_both(_lines("key || '/2+'", "''") + " || 'z'"), *_meta(title="title")],
    "html": _HTML,
    "mhtml": _HTML,
    "epub": [_piece("text", _lines("name")), _each("unit", "name", i="i + 1"), _each("unit_name", "key", i="i + 1"), _each("cell", "key", i="i - 1"), *_meta(title="title")],
    "eml": [*_MAIL, _piece("attachment", "'list.csv|text/csv|true'")],
    "msg": _MAIL,
    "mbox": [
        _each("text", "name", doc="i - 1"), _each("unit", "name", i="1", doc="i - 1"), _each("unit_name", "'plain'", i="1", doc="i - 1"), _each("from", "'s' || key || ' <s' || key || '@x.org>'", doc="i - 1"), _each("subject", "title || ' ' || key", doc="i - 1"), _each("to", "' <b@x.org>'", doc="i - 1"),
        _each("meta", "'date=2024-01-01T10:00:00+00:00'", doc="i - 1"), _each("meta", "'subject=' || title || ' ' || key", doc="i - 1"), _each("meta", "'body_type=plain'", doc="i - 1"),
    ],
    "txt": _PLAIN,
    "tsv": _PLAIN,
    "rtf": [
        *_both(f"title{_NL}'All of itsee ' || title{_NL}" + _lines("key || name", "''") + " || 'site'"), *_cells(), _piece("paragraph", "title || '|'"), _piece("paragraph", "'All of itsee ' || title || '|'"), _piece("paragraph", _lines("key || name", "''") + " || 'site|'"),
        _piece("font", "'Times|0'"), _piece("link", "'site|https://x.org/' || title"), _piece("footnote", "'see ' || title || '|1'"), *_meta(title="title", author="'Ada'", **{c: "'0'" for c in ("version", "revision", "num_pages", "num_words", "num_chars", "num_chars_with_spaces")}),
    ],
    "pdf": [_piece("text", f"title{_NL}" + _lines("name || chr(10) || 'number ' || key")), _piece("unit", "title", i="1"), _each("unit", "name || chr(10) || 'number ' || key", i="i + 1"), *_meta(total_pages="(n + 1)")],
    "zip": _ARCHIVE,
    "tar.gz": _ARCHIVE,
    "7z": _ARCHIVE,
    "doc": _both(f"title{_NL}'These are all the suppliers of one nation, by key and by name'{_NL}" + _lines("key || ' ' || name")),
    "ppt": [_piece("text", _lines("key || chr(10) || name || chr(10) || 'more'")), _each("unit", "key || chr(10) || name || chr(10) || 'more'", i="i"), _each("unit_name", "key", i="i"), *_meta(num_slides="'0'", num_notes="'0'", num_hidden_slides="'0'")],
    "xls": [*_both((f"{_HEADER}{_NL}{_GRID}").replace("{s}", "  ")), _piece("unit_name", "title", i="1"), *_cells(1)],
}


def _query(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return extract.pieces(extract.documents(composed(spark, sf_dir, kind)))

    run.__name__ = f"file_{kind.replace('.', '_')}"
    run.__doc__ = f"All that is read from {kind} files."
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in map(_query, _FOUND)}


def oracle_sql() -> dict[str, str]:
    return {f"file_{kind.replace('.', '_')}": f"WITH {_ROWS} " + " UNION ALL ".join(found).replace("{kind}", kind) for kind, found in _FOUND.items()}
