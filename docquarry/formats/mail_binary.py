"""Outlook messages: properties of a compound file."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from email.parser import HeaderParser
from email.utils import parsedate_to_datetime

from ..errors import Failed
from . import html
from .mail import header_text
from .ole import CompoundFile
from .record import Address, Attachment, Document, Email, Unit

_TAGS = re.compile(rf"<(?:{'|'.join('table tr td p br div span style script body head html'.split())})[\s>]", re.I)
_TO, _CC, _BCC = 1, 2, 3


def looks_like_html(text: str) -> bool:
    start = text.lstrip()[:9].lower()
    return start == "<!doctype" or bool(_TAGS.search(text))


def recipient(text: str) -> Address | None:
    """"Name <address>", an address or a name alone."""
    text = text.strip()
    if not text:
        return None
    found = re.search(r"<([^>]+)>$", text)
    if found:
        return Address(text[: found.start()].strip().strip("\"'"), found[1].strip())
    return Address("", text) if "@" in text and " " not in text else Address(text, "")


def recipients(text: str) -> list[Address]:
    return [a for piece in re.split("[;,]", text) if (a := recipient(piece))]


class _Properties:
    def __init__(self, ole: CompoundFile, storage: str = ""):
        self._ole, self._at = ole, f"{storage}/" if storage else ""

    def raw(self, number: str, kind: str) -> bytes | None:
        return self._ole.stream(f"{self._at}__substg1.0_{number}{kind}")

    def text(self, *numbers: str) -> str:
        for number in numbers:
            for kind, encoding in (("001F", "utf-16-le"), ("001E", "cp1252")):
                data = self.raw(number, kind)
                if data:
                    return data.decode(encoding, "ignore").rstrip("\0")
        return ""

    def fixed(self, number: int, head: int) -> bytes | None:
        """The eight bytes of a property that is kept in the property stream itself."""
        data = self._ole.stream(f"{self._at}__properties_version1.0") or b""
        for at in range(head, len(data) - 15, 16):
            if struct.unpack_from("<I", data, at)[0] >> 16 == number:
                return data[at + 8 : at + 16]
        return None


def _when(root: _Properties, headers) -> str:
    if headers.get("Date"):
        try:
            return parsedate_to_datetime(header_text(headers["Date"])).isoformat()
        except (TypeError, ValueError):
            pass
    for number in (0x0039, 0x0E06, 0x3007):
        raw = root.fixed(number, 32)
        if raw and any(raw):
            return (datetime(1601, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=struct.unpack("<Q", raw)[0] // 10)).replace(microsecond=0).isoformat()
    raise Failed("the message has no date")


def read(data: bytes, path: str | None = None) -> Iterator[Document]:
    ole = CompoundFile(data)
    root = _Properties(ole)
    headers = HeaderParser().parsestr(root.text("007D"))
    mail = Email(from_email=Address("", ""), date=_when(root, headers), message_id=root.text("1035") or (headers.get("Message-ID") or "").strip(), in_reply_to=root.text("1042"), subject=root.text("0037").strip())
    name, where = root.text("0C1A", "0042"), root.text("5D01", "5D02", "0C1F", "0065")
    from_header = recipients(header_text(headers.get("From")))
    mail.from_email = from_header[0] if from_header and "@" not in where else Address(name if name != where else "", where)
    for storage in sorted(s for s in ole.storages() if s.startswith("__recip_version1.0_")):
        one = _Properties(ole, storage)
        raw = one.fixed(0x0C15, 8)
        kind = struct.unpack_from("<I", raw)[0] & 15 if raw else _TO
        address = one.text("39FE") or one.text("3003")
        shown = one.text("3001")
        {_CC: mail.cc, _BCC: mail.bcc}.get(kind, mail.to).append(Address(shown if shown != address else "", address))
    if not (mail.to or mail.cc or mail.bcc):
        mail.to, mail.cc, mail.bcc = (recipients(header_text(headers.get(h)) or root.text(n)) for h, n in (("To", "0E04"), ("Cc", "0E03"), ("Bcc", "0E02")))
    mail.reply_to = recipients(header_text(headers.get("Reply-To")) or root.text("0050"))
    markup = root.raw("1013", "0102")
    body = root.text("1000") or (html.decode(markup) if markup else root.text("1013"))
    if looks_like_html(body):
        mail.body_html = body
        body = html.extract_markup(body).full_text.translate({0x200B: None, 0xFEFF: None})
    mail.body_plain = body.strip()
    for number, storage in enumerate(sorted(s for s in ole.storages() if s.startswith("__attach_version1.0_") and "/" not in s), 1):
        one = _Properties(ole, storage)
        content = one.raw("3701", "0102")
        if content is not None:
            mail.attachments.append(Attachment(one.text("3707", "3704") or f"attachment-{number}", one.text("370E") or "application/octet-stream", content))
    kind = "plain" if mail.body_plain else "html" if mail.body_html else "empty"
    text = mail.body_plain or mail.body_html
    yield Document("msg", text, [Unit(1, text, name=kind)], email=mail, metadata={"date": mail.date, "message_id": mail.message_id, "subject": mail.subject, "body_type": kind})
