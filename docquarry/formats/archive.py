"""Archives: the documents of their members. Hidden members, archives within archives, members
of unknown type and those over a size are left out; a member that fails is too. The sizes are
those of `limits`, which configure changes for this process."""

from __future__ import annotations

import io
import posixpath
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from ..errors import Encrypted, ExtractionError, Failed, TooLarge
from ..routing import file_type
from .record import Document
from .sevenzip import SIGNATURE, SevenZip



@dataclass(frozen=True)
class Limits:
    """Bytes that a member may have, and a whole 7z archive, which is read at once."""

    member: int = 10 << 20
    seven_zip: int = 100 << 20


limits = Limits()


def configure(new: Limits | None = None) -> None:
    """Set the limits of this process; None: the usual ones."""
    global limits
    limits = new or Limits()


_NESTED = (".zip", ".tar", ".tgz", ".tar.gz", ".tbz2", ".tar.bz2", ".txz", ".tar.xz", ".7z")
_MAGIC = ((b"PK\3\4", "zip"), (b"PK\5\6", "zip"), (SIGNATURE, "7z"), (b"\x1f\x8b", "tar"), (b"BZh", "tar"), (b"\xfd7zXZ\0", "tar"))


def kind_of(data: bytes) -> str | None:
    for magic, kind in _MAGIC:
        if data.startswith(magic):
            return kind
    return "tar" if data[257:262] == b"ustar" else None


def wanted(name: str) -> bool:
    base = posixpath.basename(name)
    return not (base.startswith(".") or name.startswith("__MACOSX/") or base.lower().endswith(_NESTED)) and file_type(base) is not None


def members(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, content) of the members that are wanted."""
    kind = kind_of(data)
    if kind == "zip":
        try:
            archive = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as error:
            raise Failed("not a ZIP archive", cause=error) from error
        with archive:
            infos = [i for i in archive.infolist() if not i.is_dir()]
            if any(i.flag_bits & 1 for i in infos):
                raise Encrypted("the archive is encrypted")
            for info in infos:
                if wanted(info.filename) and info.file_size <= limits.member:
                    yield info.filename, archive.read(info)
    elif kind == "tar":
        try:
            with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as archive:
                for info in archive:
                    if info.isreg() and wanted(info.name) and info.size <= limits.member:
                        content = archive.extractfile(info)
                        if content is not None:
                            yield info.name, content.read()
        except tarfile.TarError as error:
            raise Failed("not a TAR archive", cause=error) from error
    elif kind == "7z":
        if len(data) > limits.seven_zip:
            raise TooLarge(len(data), limits.seven_zip)
        archive = SevenZip(data)
        if archive.encrypted:
            raise Encrypted("the archive is encrypted")
        for member in archive.members:
            if not member.is_directory and wanted(member.name) and member.size <= limits.member:
                yield member.name, archive.read(member)
    else:
        raise Failed("unknown kind of archive")


def read(data: bytes, path: str | None = None) -> Iterator[Document]:
    from .dispatch import read_as

    for name, content in members(data):
        full = f"{path}!/{name}" if path else name
        try:
            for doc in read_as(file_type(posixpath.basename(name)), content, full):
                doc.path = full
                yield doc
        except ExtractionError:
            continue
