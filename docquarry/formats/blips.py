"""Pictures in the drawing records of old office files."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

from . import images
from .record import Image

_EMF, _WMF, _DIB = 0xF01A, 0xF01B, 0xF01F
_KINDS = frozenset((_EMF, _WMF, 0xF01C, 0xF01D, 0xF01E, _DIB, 0xF029, 0xF02A))
#: Instances of records that hold a second identifier of 16 bytes.
_TWO_IDS = frozenset((0x6E1, 0x46B, 0x6E3))


def records(data: bytes, step_in: bool = True) -> Iterator[tuple[int, int, bool, bytes, int, int]]:
    """(type, instance, container, content, start, end); containers are stepped into. Where a
    length can't be right, reading goes on one byte further."""
    at = 0
    while at + 8 <= len(data):
        head, kind, length = struct.unpack_from("<HHI", data, at)
        if length > len(data) - at - 8:
            at += 1
            continue
        end = at + 8 + length
        container = head & 15 == 15
        yield kind, head >> 4, container, data[at + 8 : end], at, end
        at = at + 8 if container and step_in else end


def carved(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(type, instance, content) of picture records anywhere in a stream."""
    at = 0
    while at + 8 <= len(data):
        head, kind, length = struct.unpack_from("<HHI", data, at)
        if kind in _KINDS and 0 < length <= len(data) - at - 8:
            yield kind, head >> 4, data[at + 8 : at + 8 + length]
            at += 8 + length
        else:
            at += 1


def pictures(found: Iterator[tuple[int, int, bytes]]) -> list[Image]:
    """Different images in order; bitmaps get a file header."""
    out: list[Image] = []
    seen: set[bytes] = set()
    for kind, instance, content in found:
        data: bytes | None = content[33 if instance in _TWO_IDS else 17 :]
        if kind not in _KINDS or not data:
            continue
        what = images.content_type(data)
        if what == "application/octet-stream":
            what = {_EMF: "image/x-emf", _WMF: "image/x-wmf", _DIB: "image/bmp"}.get(kind, "")
            if kind == _DIB:
                data = images.dib_to_bmp(data)
        digest = hashlib.sha1(data or b"").digest()
        if not data or not what or digest in seen:
            continue
        seen.add(digest)
        out.append(Image(len(out) + 1, what, data, None, *images.size(data)))
    return out
