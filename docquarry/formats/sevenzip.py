"""7z archives: headers, folders of coders and their files."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from dataclasses import dataclass

from ..errors import Encrypted, Failed

SIGNATURE = b"7z\xbc\xaf\x27\x1c"
_AES = b"\x06\xf1\x07\x01"
_FILTERS = {b"\x03": lzma.FILTER_DELTA, b"\x03\x03\x01\x03": lzma.FILTER_X86, b"\x04": lzma.FILTER_X86, b"\x03\x03\x02\x05": lzma.FILTER_POWERPC, b"\x03\x03\x05\x01": lzma.FILTER_ARM, b"\x03\x03\x07\x01": lzma.FILTER_ARMTHUMB, b"\x03\x03\x08\x05": lzma.FILTER_SPARC}


@dataclass
class Member:
    name: str
    size: int
    is_directory: bool
    folder: int | None = None
    offset: int = 0


@dataclass
class _Folder:
    coders: list[tuple[bytes, bytes]]
    bonds: list[tuple[int, int]]
    packed: int
    sizes: list[int]
    files: int = 1


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        got = self.data[self.at : self.at + n]
        if len(got) < n:
            raise Failed("the 7z header ends too early")
        self.at += n
        return got

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        """As many bytes follow the first as it has leading ones; its other bits are the highest."""
        first = self.byte()
        extra = 0
        while extra < 8 and first & 0x80 >> extra:
            extra += 1
        low = int.from_bytes(self.take(extra), "little")
        return low | (first & 0x7F >> extra) << 8 * extra if extra < 8 else low

    def bits(self, n: int) -> list[bool]:
        raw = self.take((n + 7) // 8)
        return [bool(raw[i // 8] & 0x80 >> i % 8) for i in range(n)]

    def maybe_bits(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.bits(n)


class SevenZip:
    def __init__(self, data: bytes, most: int = 1 << 30):
        if data[:6] != SIGNATURE or len(data) < 32:
            raise Failed("not a 7z archive")
        self._data, self._most = data, most
        offset, size = struct.unpack_from("<QQ", data, 12)
        self.members: list[Member] = []
        self._folders: list[_Folder] = []
        self._packs: list[tuple[int, int]] = []
        self._done: dict[int, bytes] = {}
        if not size:
            return
        header = data[32 + offset : 32 + offset + size]
        while True:
            reader = _Reader(header)
            kind = reader.byte()
            if kind != 0x17:
                break
            self._streams(reader)
            header = self._unpacked(0)
            self._done = {}
        if kind != 1:
            raise Failed("unknown 7z header")
        self._header(reader)

    def _streams(self, r: _Reader) -> list[int]:
        """Packed streams and folders; the sizes of the files in them."""
        self._folders, self._packs = [], []
        sizes: list[int] | None = None
        while (kind := r.byte()) != 0:
            if kind == 6:
                at, count = 32 + r.number(), r.number()
                while (inner := r.byte()) != 0:
                    if inner == 9:
                        for _ in range(count):
                            n = r.number()
                            self._packs.append((at, n))
                            at += n
                    else:
                        for there in r.maybe_bits(count):
                            if there:
                                r.take(4)
            elif kind == 7:
                r.byte()
                count = r.number()
                r.byte()
                self._folders = [self._folder(r) for _ in range(count)]
                while (inner := r.byte()) != 0:
                    if inner == 12:
                        for f in self._folders:
                            f.sizes = [r.number() for _ in f.coders]
                    else:
                        for there in r.maybe_bits(count):
                            if there:
                                r.take(4)
            elif kind == 8:
                sizes = self._parts(r)
            else:
                raise Failed("unknown part of a 7z header")
        return sizes if sizes is not None else [f.sizes[self._main(f)] for f in self._folders]

    @staticmethod
    def _folder(r: _Reader) -> _Folder:
        coders, inputs, outputs = [], 0, 0
        for _ in range(r.number()):
            flags = r.byte()
            method = r.take(flags & 15)
            ins, outs = (r.number(), r.number()) if flags & 0x10 else (1, 1)
            coders.append((method, r.take(r.number()) if flags & 0x20 else b""))
            inputs, outputs = inputs + ins, outputs + outs
        bonds = [(r.number(), r.number()) for _ in range(outputs - 1)]
        packed = inputs - len(bonds)
        if packed > 1:
            for _ in range(packed):
                r.number()
        return _Folder(coders, bonds, packed, [])

    @staticmethod
    def _main(f: _Folder) -> int:
        """The coder whose output isn't another's input."""
        bound = {out for _, out in f.bonds}
        return next(i for i in range(len(f.coders)) if i not in bound)

    def _parts(self, r: _Reader) -> list[int]:
        kind = r.byte()
        if kind == 13:
            for f in self._folders:
                f.files = r.number()
            kind = r.byte()
        sizes: list[int] = []
        for f in self._folders:
            total = f.sizes[self._main(f)]
            if not f.files:
                continue
            given = [r.number() for _ in range(f.files - 1)] if kind == 9 else []
            sizes += [*given, total - sum(given)]
        if kind == 9:
            kind = r.byte()
        while kind:
            # Checksums of the files: one for each of unknown sum.
            for there in r.maybe_bits(len(sizes)):
                if there:
                    r.take(4)
            kind = r.byte()
        return sizes

    def _header(self, r: _Reader) -> None:
        sizes: list[int] = []
        while (kind := r.byte()) != 0:
            if kind == 4:
                sizes = self._streams(r)
            elif kind == 5:
                self._files(r, sizes)
            elif kind == 2:
                while r.byte():
                    r.take(r.number())
            else:
                raise Failed("unknown part of a 7z header")

    def _files(self, r: _Reader, sizes: list[int]) -> None:
        count = r.number()
        names: list[str] = [""] * count
        empty, plain_empty = [False] * count, []
        while (kind := r.byte()) != 0:
            block = _Reader(r.take(r.number()))
            if kind == 17:
                block.byte()
                names = block.data[1:].decode("utf-16-le").split("\0")[:count]
            elif kind == 14:
                empty = block.bits(count)
            elif kind == 15:
                plain_empty = block.bits(sum(empty))
        places = [(i, f) for i, f in enumerate(self._folders) for _ in range(f.files)]
        at = {i: 0 for i in range(len(self._folders))}
        k = e = 0
        for i in range(count):
            if empty[i]:
                file = e < len(plain_empty) and plain_empty[e]
                e += 1
                self.members.append(Member(names[i], 0, not file))
                continue
            folder = places[k][0]
            self.members.append(Member(names[i], sizes[k], False, folder, at[folder]))
            at[folder] += sizes[k]
            k += 1

    @property
    def encrypted(self) -> bool:
        return any(method == _AES for f in self._folders for method, _ in f.coders)

    def _unpacked(self, number: int) -> bytes:
        if number in self._done:
            return self._done[number]
        f = self._folders[number]
        if any(method == _AES for method, _ in f.coders):
            raise Encrypted("the archive is encrypted")
        if f.packed != 1:
            raise Failed("a 7z folder with several packed streams isn't supported")
        total = f.sizes[self._main(f)]
        if total > self._most:
            raise Failed("a 7z folder is too large")
        at, size = self._packs[sum(x.packed for x in self._folders[:number])]
        data = self._data[at : at + size]
        # From the coder that reads the packed stream to the one that gives the result.
        feeds = {out: inner for inner, out in f.bonds}
        bound = {inner for inner, _ in f.bonds}
        coder = next(i for i in range(len(f.coders)) if i not in bound)
        while True:
            data = self._decode(*f.coders[coder], data, f.sizes[coder])
            if coder not in feeds:
                break
            coder = feeds[coder]
        self._done = {number: data}
        return data

    @staticmethod
    def _decode(method: bytes, props: bytes, data: bytes, size: int) -> bytes:
        def raw(*filters: dict) -> bytes:
            return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=list(filters)).decompress(data, size)

        if method == b"\0":
            return data[:size]
        if method == b"\x03\x01\x01":
            rest, lc = divmod(props[0], 9)
            pb, lp = divmod(rest, 5)
            return raw({"id": lzma.FILTER_LZMA1, "dict_size": max(4096, struct.unpack_from("<I", props, 1)[0]), "lc": lc, "lp": lp, "pb": pb})
        if method == b"\x21":
            bits = props[0]
            return raw({"id": lzma.FILTER_LZMA2, "dict_size": 0xFFFFFFFF if bits == 40 else (2 | bits & 1) << bits // 2 + 11})
        if method == b"\x04\x01\x08":
            return zlib.decompressobj(-15).decompress(data, size)
        if method == b"\x04\x02\x02":
            return bz2.decompress(data)[:size]
        if method in _FILTERS:
            # A filter has no raw format by itself, so the data passes as stored chunks.
            first = {"id": _FILTERS[method], **({"dist": props[0] + 1} if method == b"\x03" else {})}
            chunks = b"".join((b"\1" if i == 0 else b"\2") + struct.pack(">H", len(data[i : i + 65536]) - 1) + data[i : i + 65536] for i in range(0, len(data), 65536))
            return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[first, {"id": lzma.FILTER_LZMA2, "dict_size": 1 << 16}]).decompress(chunks + b"\0", size)
        raise Failed(f"unknown 7z method {method.hex()}")

    def read(self, member: Member) -> bytes:
        if member.folder is None:
            return b""
        return self._unpacked(member.folder)[member.offset : member.offset + member.size]
