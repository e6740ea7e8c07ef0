"""What extraction of one document gives, in one shape for all formats."""

from __future__ import annotations

import os
import re
from dataclasses import asdict, dataclass, field
from typing import Any


@dataclass
class Unit:
    unit_number: int
    text: str
    heading_level: int | None = None
    heading_path: list[str] = field(default_factory=list)
    location: list[str] = field(default_factory=list)
    name: str | None = None


@dataclass
class Table:
    data: list[list[str | None]]
    unit_number: int | None = None

    @property
    def dim(self) -> tuple[int, int]:
        return len(self.data), max(map(len, self.data), default=0)


@dataclass
class Image:
    image_number: int
    content_type: str
    data: bytes | None = None
    unit_number: int | None = None
    width: int | None = None
    height: int | None = None
    name: str = ""
    caption: str = ""
    description: str = ""


@dataclass
class Part:
    """A small piece of a kind: a link, heading, note, comment, header, style, formula, ..."""

    kind: str
    text: str
    ref: str = ""
    attrs: dict[str, str] = field(default_factory=dict)


@dataclass
class Address:
    name: str
    address: str


@dataclass
class Attachment:
    filename: str
    mime_type: str
    data: bytes


@dataclass
class Email:
    from_email: Address
    subject: str = ""
    to: list[Address] = field(default_factory=list)
    cc: list[Address] = field(default_factory=list)
    bcc: list[Address] = field(default_factory=list)
    reply_to: list[Address] = field(default_factory=list)
    in_reply_to: str = ""
    message_id: str = ""
    date: str = ""
    body_plain: str = ""
    body_html: str = ""
    attachments: list[Attachment] = field(default_factory=list)


@dataclass
class Document:
    file_type: str
    full_text: str = ""
    units: list[Unit] = field(default_factory=list)
    tables: list[Table] = field(default_factory=list)
    images: list[Image] = field(default_factory=list)
    parts: list[Part] = field(default_factory=list)
    metadata: dict[str, str] = field(default_factory=dict)
    email: Email | None = None
    path: str | None = None
    detected_encoding: str | None = None

    def parts_of(self, kind: str) -> list[Part]:
        return [p for p in self.parts if p.kind == kind]

    def row(self) -> dict[str, Any]:
        return asdict(self)


_BLANK_LINES = re.compile("\n\n\n+")
_BLANKS = re.compile("[ \t]+")


def tidy(text: str, blanks: bool = True) -> str:
    """Runs of blank lines as one; with blanks, runs of blanks and tabs as one blank too."""
    return _BLANK_LINES.sub("\n\n", _BLANKS.sub(" ", text) if blanks else text)


def joined(texts: list[str]) -> str:
    return "\n".join(texts).strip()


def path_metadata(path: str | None) -> dict[str, str]:
    if not path:
        return {}
    folder, name = os.path.split(path)
    return {"filename": name, "file_extension": os.path.splitext(name)[1], "file_path": path, "folder_path": folder}


def cell_text(value: Any) -> str | None:
    """A cell as text: whole floats without a fraction, booleans as in JSON."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)
