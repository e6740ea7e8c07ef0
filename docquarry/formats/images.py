"""Kinds and sizes of images by their first bytes."""

from __future__ import annotations

import struct

_MAGIC = ((b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"BM", "image/bmp"), (b"II*\0", "image/tiff"), (b"MM\0*", "image/tiff"))

BY_SUFFIX = {suffix: f"image/{kind}" for kind, names in (("png", "png"), ("jpeg", "jpg jpeg"), ("gif", "gif"), ("bmp", "bmp"), ("tiff", "tif tiff"), ("x-emf", "emf"), ("x-wmf", "wmf"), ("svg+xml", "svg"), ("webp", "webp")) for suffix in names.split()}


def content_type(data: bytes, name: str = "") -> str:
    for magic, kind in _MAGIC:
        if data.startswith(magic):
            return kind
    return BY_SUFFIX.get(name.rpartition(".")[2].lower(), "application/octet-stream")


def _jpeg_size(data: bytes) -> tuple[int | None, int | None]:
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            return None, None
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 if marker == 1 or 0xD0 <= marker <= 0xD9 else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None, None


def size(data: bytes) -> tuple[int | None, int | None]:
    """Width and height in pixels, or two None."""
    kind = content_type(data)
    if kind == "image/png" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if kind == "image/gif" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if kind == "image/bmp" and len(data) >= 26:
        width, height = struct.unpack("<ii", data[18:26])
        return width, abs(height)
    return _jpeg_size(data) if kind == "image/jpeg" else (None, None)


def dib_to_bmp(dib: bytes) -> bytes | None:
    """A device-independent bitmap with the file header put before it."""
    if len(dib) < 40:
        return None
    header, _, _, _, bits, compression, _, _, _, used, _ = struct.unpack("<IiiHHIIiiII", dib[:40])
    if header < 40 or bits not in (1, 4, 8, 16, 24, 32):
        return None
    palette = 4 * (used or 1 << bits) if bits <= 8 else 12 if compression == 3 and header == 40 else 0
    return b"BM" + struct.pack("<IHHI", 14 + len(dib), 0, 0, 14 + header + palette) + dib
