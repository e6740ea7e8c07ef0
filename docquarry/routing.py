"""From a path to the type of its content: as a Column for plans, and as a function."""

from __future__ import annotations

import mimetypes
import os

from pyspark.sql import Column
from pyspark.sql import functions as F

_TYPES = {
    "docx": "docx docm", "xlsx": "xlsx xlsm", "pptx": "pptx pptm",
    "doc": "doc", "xls": "xls", "ppt": "ppt", "rtf": "rtf",
    "odt": "odt", "ods": "ods", "odp": "odp", "odg": "odg", "odf": "odf",
    "eml": "eml", "msg": "msg", "mbox": "mbox",
    "plain": "txt md csv tsv json",
    "pdf": "pdf", "html": "html", "epub": "epub", "mhtml": "mhtml",
    "archive": "zip tar tgz tbz2 txz 7z",
}
#: Type key -> the reader that handles it.
READERS: dict[str, str] = {key: reader for reader, keys in _TYPES.items() for key in keys.split()}

_ALIASED = {"html": "htm", "mhtml": "mht", "doc": "dot", "docx": "dotx", "docm": "dotm", "xls": "xlt", "xlsx": "xltx", "xlsm": "xltm", "ppt": "pot pps", "pptx": "potx ppsx", "pptm": "potm ppsm", "odt": "ott", "ods": "ots", "odp": "otp", "tgz": "gz", "tbz2": "bz2", "txz": "xz"}
#: Other suffix -> type key.
ALIASES: dict[str, str] = {alias: key for key, names in _ALIASED.items() for alias in names.split()}

COMPOUND: dict[str, str] = {".tar.gz": "tgz", ".tar.bz2": "tbz2", ".tar.xz": "txz"}

_OOXML, _ODF, _MACRO = "application/vnd.openxmlformats-officedocument.", "application/vnd.oasis.opendocument.", ".macroEnabled.12"
MIME_TYPES: dict[str, str] = {
    **{f"{_OOXML}{kind}": key for kind, key in (("wordprocessingml.document", "docx"), ("spreadsheetml.sheet", "xlsx"), ("presentationml.presentation", "pptx"))},
    **{f"application/vnd.ms-{kind}{_MACRO}": key for kind, key in (("word.document", "docm"), ("excel.sheet", "xlsm"), ("powerpoint.presentation", "pptm"))},
    **{f"{_ODF}{kind}": key for kind, key in (("text", "odt"), ("spreadsheet", "ods"), ("presentation", "odp"), ("graphics", "odg"), ("formula", "odf"))},
    **{f"application/{kind}": key for kind, key in (("msword", "doc"), ("vnd.ms-excel", "xls"), ("vnd.ms-powerpoint", "ppt"), ("rtf", "rtf"), ("csv", "csv"), ("json", "json"), ("tab-separated-values", "tsv"), ("vnd.ms-outlook", "msg"), ("mbox", "mbox"), ("xhtml+xml", "html"), ("pdf", "pdf"), ("epub+zip", "epub"), ("zip", "zip"), ("x-zip-compressed", "zip"), ("x-tar", "tar"), ("gzip", "tgz"), ("x-gzip", "tgz"), ("x-bzip2", "tbz2"), ("x-xz", "txz"))},
    **{f"text/{kind}": key for kind, key in (("rtf", "rtf"), ("csv", "csv"), ("json", "json"), ("plain", "txt"), ("markdown", "md"), ("tab-separated-values", "tsv"), ("html", "html"))},
    "message/rfc822": "eml",
}

_SUFFIXES = {**{k: k for k in READERS}, **ALIASES}


# What Python and this machine know of suffixes, and what most machines do besides.
_MIMES = mimetypes.MimeTypes([f for f in mimetypes.knownfiles if os.path.isfile(f)])
for _mime, _names in {"application/xhtml+xml": "xhtml xht", "text/html": "html htm shtml", "text/plain": "txt text asc brf srt"}.items():
    for _name in _names.split():
        _MIMES.add_type(_mime, f".{_name}")
for _mime, _key in MIME_TYPES.items():
    if f".{_key}" not in _MIMES.types_map[True]:
        _MIMES.add_type(_mime, f".{_key}")
#: Suffix -> type key where only the MIME type that goes with the suffix tells it.
GUESSED: dict[str, str] = {
    suffix[1:]: MIME_TYPES[mime]
    for suffix in sorted({*_MIMES.types_map[True], *_MIMES.suffix_map})
    if suffix[1:] not in _SUFFIXES and (mime := _MIMES.guess_type("x" + suffix)[0]) in MIME_TYPES
}
#: Suffixes of encodings, before which the suffix counts; most are type keys by themselves.
ENCODINGS: list[str] = sorted(s[1:] for s in _MIMES.encodings_map if s.islower() and s[1:] not in _SUFFIXES)
_BY_MIME: dict[str, str] = {s: MIME_TYPES[mime] for s in {*_SUFFIXES, *GUESSED} if (mime := _MIMES.guess_type(f"x.{s}")[0]) in MIME_TYPES}


def type_of_suffix(path: str) -> str | None:
    """By compound suffix, then by the last suffix, its alias included."""
    lower = path.lower()
    for suffix, key in COMPOUND.items():
        if lower.endswith(suffix):
            return key
    return _SUFFIXES.get(os.path.splitext(lower)[1][1:])


def file_type(path: str) -> str | None:
    """The type key of a path; by MIME type where the suffix is unknown; None if unsupported."""
    return type_of_suffix(path) or MIME_TYPES.get(_MIMES.guess_type(path.lower())[0] or "")


def add_type(key: str, suffixes: list[str]) -> None:
    """Route suffixes to a type key of one's own, in this process; columns made later know it too."""
    _SUFFIXES.update({s.lower().lstrip("."): key for s in suffixes})


def is_supported_file(path: str) -> bool:
    return file_type(path) is not None


def is_supported_mime_type(mime_type: str | None) -> bool:
    return mime_type in MIME_TYPES


def suffix_column(path: Column) -> Column:
    """The last suffix, without its dot and in lower case; '' where there is none. A leading
    dot alone doesn't begin a suffix."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]*)$", 1))


def file_type_column(path: Column) -> Column:
    """file_type as an expression that stays in the plan; by MIME type too where the suffix is unknown."""
    lower, suffix = F.lower(path), suffix_column(path)
    known, inner = (F.create_map(*[F.lit(x) for pair in sorted(pairs.items()) for x in pair]) for pairs in ({**GUESSED, **_SUFFIXES}, _BY_MIME))
    encoded = F.try_element_at(inner, F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]*)\.[^./]*$", 1)))
    out = F.when(suffix.isin(*ENCODINGS), encoded).otherwise(F.try_element_at(known, suffix))
    for suffix, key in COMPOUND.items():
        out = F.when(lower.endswith(suffix), key).otherwise(out)
    return out


def supported_glob() -> str:
    """A glob over file names that holds all supported ones, in whatever case; for use at listing,
    before files are read. What it lets through is told apart by file_type_column."""
    return "*.{%s}" % ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix) for suffix in sorted({*_SUFFIXES, *GUESSED, *ENCODINGS}))


def mime_type_column(mime: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in sorted(MIME_TYPES.items()) for x in pair])
    return F.try_element_at(known, mime)
