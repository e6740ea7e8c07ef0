"""Scalar functions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.strip() removes.
_WHITE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"

NUMERIC_TOKEN = r"^\(?[-‐-―−]?[0-9][0-9,.]*\)?%?$"


def strip(text: Column) -> Column:
    """White space, Unicode's too, off both ends."""
    return F.regexp_replace(text, f"^{_WHITE}+|{_WHITE}+$", "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"{_WHITE}+", " "))


def is_numeric_token(token: Column) -> Column:
    """Digits with , and ., maybe in brackets, behind a dash or before a percent sign."""
    return token.rlike(NUMERIC_TOKEN)


def count_numeric_tokens(line: Column) -> Column:
    return F.size(F.filter(F.split(line, r"\s+"), is_numeric_token))


def length_to_px(length: Column) -> Column:
    """'2.54cm' and the like at 96 dots an inch, half to even; NULL for other units."""
    parts = [F.regexp_extract(F.lower(strip(length)), r"^(-?[0-9]*\.?[0-9]+)\s*([a-z]*)$", i) for i in (1, 2)]
    number = F.when(parts[0] != "", parts[0]).cast("double")
    unit = parts[1]
    px = (
        F.when(unit.isin("", "px"), number)
        .when(unit == "in", number * 96)
        .when(unit == "cm", number / 2.54 * 96)
        .when(unit == "mm", number / 25.4 * 96)
        .when(unit == "pt", number / 72 * 96)
        .when(unit == "pc", number * 12 / 72 * 96)
    )
    return F.bround(px, 0).cast("int")


def twips_to_inches(twips: Column) -> Column:
    return twips / 1440


def emu_to_px(emu: Column) -> Column:
    return F.floor(emu / 9525).cast("int")


def display_value(value: Column) -> Column:
    """A number as a table shows it: NULL as '', whole numbers without a fraction."""
    return F.when(value.isNull(), "").when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))


def parse_iso(text: Column) -> Column:
    """An ISO date-time to the second, Z or an offset allowed; NULL where it can't be read."""
    return F.date_trunc("second", F.try_to_timestamp(F.regexp_replace(text, r"\.[0-9]+", "")))


def path_parts(path: Column) -> tuple[Column, Column, Column]:
    """Name, last suffix with its dot, and parent of a path."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    suffix = F.regexp_extract(name, r"[^.].*(\.[^.]+)$", 1)
    parent = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return name, suffix, parent


def full_path(parent: Column, name: Column) -> Column:
    return F.when(F.coalesce(parent, F.lit("")) == "", name).otherwise(F.concat_ws("/", parent, name))


def image_content_type(data: Column) -> Column:
    """By the first bytes; NULL for what isn't known."""
    head = F.hex(F.substring(data, 1, 8))
    return (
        F.when(head == "89504E470D0A1A0A", "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
        .when(head.startswith("424D"), "image/bmp")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "image/tiff")
    )


def table_dim(data: Column) -> Column:
    """struct(rows, columns) of an array of rows; the longest row counts."""
    return F.struct(F.size(data).alias("rows"), F.coalesce(F.array_max(F.transform(data, F.size)), F.lit(0)).alias("columns"))


def glob_to_regex(pattern: str) -> str:
    """A shell pattern over the whole path; * goes across slashes."""
    import fnmatch

    return fnmatch.translate(pattern).replace(r"\Z", r"\z")


def clean_lines(text: Column) -> Column:
    """Lines stripped, without place holders of slide masters, runs of blank lines as one."""
    lines = F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), strip)
    kept = F.filter(lines, lambda x: ~(x.startswith("___PPT") | x.startswith("Click to edit") | (x == "*") | x.rlike("^(Second|Third|Fourth|Fifth|Sixth|Seventh|Eighth|Ninth) (level|Outline Level)$")))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"))


def field_kind(instruction: Column) -> Column:
    """What a field shows, by the first of these words in its instruction."""
    upper = F.upper(instruction)
    out = F.lit("unknown")
    for kind in ("toc", "styleref", "time", "date", "page"):
        out = F.when(upper.contains(kind.upper()), kind).otherwise(out)
    return out


def one_of(value: Column, **kinds: list[str]) -> Column:
    """The first kind whose list holds the value, else 'other'; such as the roles of place holders."""
    out = F.lit("other")
    for kind, values in reversed(kinds.items()):
        out = F.when(value.isin(*values), kind).otherwise(out)
    return out


def header_kind(name: Column) -> Column:
    """Which pages a header or footer is for, by its part's name."""
    return F.when(F.lower(name).contains("first") | name.contains("1-"), "first").when(name.contains("2-"), "even").otherwise("default")


def custom_fields(fields: Column) -> Column:
    """Of a listing's map of columns those that its users made."""
    from ..sources.drive import BUILT_IN

    return F.map_filter(fields, lambda k, v: ~k.isin(*sorted(BUILT_IN)) & ~k.startswith("@odata"))


def record_json(kind: str, **fields: Column) -> Column:
    """A record as JSON, with its kind as _type before its fields; NULL fields are left out."""
    return F.to_json(F.struct(F.lit(kind).alias("_type"), *[c.alias(n) for n, c in fields.items()]))
