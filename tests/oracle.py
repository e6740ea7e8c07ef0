"""Comparing a DataFrame with what DuckDB gives for SQL over the same tables."""

import math
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        files = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    if hasattr(value, "isoformat"):
        return value.isoformat().removesuffix("+00:00")
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def same(df, sql, sf_dir):
    """Assert equal columns and rows, whatever their order."""
    found = connect(sf_dir).execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    expected, got = _rows(columns, found.fetchall()), _rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(expected)
    wrong = [(a, b) for a, b in zip(got, expected) if a != b]
    assert not wrong, wrong[:3]
