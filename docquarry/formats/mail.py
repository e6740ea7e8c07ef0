"""Internet mail: single messages, mail boxes and web archives."""

from __future__ import annotations

import base64
import quopri
import re
from collections.abc import Iterator
from datetime import timezone
from email import message_from_bytes
from email.header import decode_header
from email.message import Message
from email.utils import getaddresses, parseaddr, parsedate_to_datetime

from ..errors import Failed
from . import html
from .record import Address, Attachment, Document, Email, Unit

_SEPARATOR = re.compile(rb"^From \S+.*\d{4}\r?\n", re.M)


def header_text(value: object) -> str:
    """A header with its encoded words decoded."""
    if not value:
        return ""
    out = []
    for piece, charset in decode_header(str(value)):
        if isinstance(piece, str):
            out.append(piece)
            continue
        try:
            out.append(piece.decode(charset or "utf-8", "replace"))
        except LookupError:
            out.append(piece.decode("utf-8", "replace"))
    return "".join(out)


def address(value: object) -> Address:
    name, where = parseaddr(str(value)) if value else ("", "")
    return Address(header_text(name), where)


def addresses(values: list[object], keep_empty: bool = False) -> list[Address]:
    return [Address(header_text(name), where) for name, where in getaddresses([str(v) for v in values]) if where or keep_empty and name]


def _text(part: Message) -> str:
    data = part.get_payload(decode=True) or b""
    try:
        return data.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def _document(mail: Email, file_type: str) -> Document:
    kind = "plain" if mail.body_plain else "html" if mail.body_html else "empty"
    body = mail.body_plain or mail.body_html
    return Document(file_type, body, [Unit(1, body, name=kind)], email=mail, metadata={"date": mail.date, "message_id": mail.message_id, "subject": mail.subject, "body_type": kind})


def _base(message: Message, date: str) -> Email:
    get = message.get_all
    return Email(
        from_email=address(message.get("From")),
        subject=header_text(message.get("Subject")).strip(),
        to=addresses(get("To", [])),
        cc=addresses(get("Cc", [])),
        bcc=addresses(get("Bcc", [])),
        reply_to=addresses(get("Reply-To", [])),
        in_reply_to=header_text(message.get("In-Reply-To")),
        message_id=header_text(message.get("Message-ID")),
        date=date,
    )


def read_eml(data: bytes, path: str | None = None) -> Iterator[Document]:
    """One message. All inline plain parts are joined, and all HTML parts; what has a file name
    or is marked as an attachment is one."""
    message = message_from_bytes(data)
    if not message.get("From"):
        raise Failed("the message has no sender")
    date = ""
    if message.get("Date"):
        try:
            when = parsedate_to_datetime(header_text(message.get("Date")))
            date = (when if when.tzinfo else when.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).isoformat()
        except (TypeError, ValueError):
            date = ""
    mail = _base(message, date)
    mail.to = addresses(message.get_all("To", []), keep_empty=True)
    plain, markup = [], []
    for part in message.walk():
        if part.is_multipart():
            continue
        kind = part.get_content_type()
        if part.get_content_disposition() == "attachment" or part.get_filename() or kind not in ("text/plain", "text/html"):
            mail.attachments.append(Attachment(header_text(part.get_filename()) or "attachment", kind, part.get_payload(decode=True) or b""))
        else:
            (plain if kind == "text/plain" else markup).append(_text(part))
    mail.body_plain, mail.body_html = "\n".join(plain).strip(), "\n".join(markup)
    yield _document(mail, "eml")


def split_mbox(data: bytes) -> list[bytes]:
    """Messages between separator lines, without the line ends after them; empty ones go."""
    cuts = [(m.start(), m.end()) for m in _SEPARATOR.finditer(data)]
    ends = [start for start, _ in cuts[1:]] + [len(data)]
    return [m for (_, start), end in zip(cuts, ends) if (m := data[start:end].rstrip(b"\r\n"))]


def read_mbox(data: bytes, path: str | None = None) -> Iterator[Document]:
    """All messages of a box: the first plain and the first HTML part of each. A message
    without a readable date fails the box."""
    for raw in split_mbox(data):
        message = message_from_bytes(raw)
        try:
            date = parsedate_to_datetime(header_text(message.get("Date"))).isoformat()
        except (TypeError, ValueError) as error:
            raise Failed("a message has no readable date", cause=error) from error
        mail = _base(message, date)
        bodies = {"text/plain": "", "text/html": ""}
        if message.is_multipart():
            for part in message.walk():
                kind = part.get_content_type()
                if kind in bodies and not bodies[kind] and "attachment" not in str(part.get("Content-Disposition", "")):
                    bodies[kind] = _text(part)
        else:
            bodies["text/html" if message.get_content_type() == "text/html" else "text/plain"] = _text(message)
        mail.body_plain, mail.body_html = bodies["text/plain"].strip(), bodies["text/html"]
        yield _document(mail, "mbox")


def _markup_part(message: Message) -> bytes | None:
    parts = [p for p in message.walk() if p.get_content_type() == "text/html"]
    if not parts and not message.is_multipart():
        raw = message.get_payload(decode=True) or b""
        return raw if re.search(rb"<html|<!doctype html", raw[:4096].lower()) else None
    if not parts:
        return None
    payload = parts[0].get_payload()
    raw = payload.encode("utf-8", "replace") if isinstance(payload, str) else b""
    how = parts[0].get("Content-Transfer-Encoding", "").lower()
    if how == "quoted-printable":
        return quopri.decodestring(raw)
    if how == "base64":
        return base64.b64decode(re.sub(rb"\s+", b"", raw))
    return raw


def read_mhtml(data: bytes, path: str | None = None) -> Iterator[Document]:
    """The first HTML part of a web archive; an empty page where there is none."""
    found = _markup_part(message_from_bytes(data))
    if not found:
        bare = re.search(rb"<html[^>]*>.*</html>", data, re.I | re.S)
        found = bare[0] if bare else None
    page = html.extract_markup(html.decode(found)) if found else Document("html", "", [Unit(1, "")])
    page.file_type = "mhtml"
    yield page
