"""ZIP packages: guarded opening, and XML without document type definitions."""

from __future__ import annotations

import io
import posixpath
import zipfile
from dataclasses import dataclass
from xml.etree import ElementTree as ET

from ..errors import Encrypted, Failed, ZipBomb

Element = ET.Element


@dataclass(frozen=True)
class Limits:
    entries: int = 50_000
    total: int = 4 << 30
    single: int = 1 << 30
    ratio: float = 200.0
    entry_ratio: float = 500.0


LIMITS = Limits()


def guard(archive: zipfile.ZipFile, limits: Limits = LIMITS) -> None:
    """Refuse what would unpack to far more than it takes."""
    infos = archive.infolist()
    if len(infos) > limits.entries:
        raise ZipBomb(f"{len(infos)} entries")
    packed = unpacked = 0
    for info in infos:
        if info.is_dir():
            continue
        if info.file_size > limits.single:
            raise ZipBomb(f"{info.filename} has {info.file_size} bytes")
        if info.file_size and not info.compress_size:
            raise ZipBomb(f"{info.filename} is packed to nothing")
        if info.file_size and info.file_size > limits.entry_ratio * info.compress_size:
            raise ZipBomb(f"{info.filename} is packed too well")
        packed += info.compress_size
        unpacked += info.file_size
    if unpacked > limits.total or packed and unpacked > limits.ratio * packed:
        raise ZipBomb(f"{unpacked} bytes in {packed}")


def parse_xml(data: bytes) -> Element:
    """An XML root; declarations of entities are refused."""
    if b"<!ENTITY" in data or b"<!DOCTYPE" in data[:4096] and b"[" in data[:4096].partition(b"<!DOCTYPE")[2].partition(b">")[0]:
        raise Failed("the XML declares entities")
    return ET.fromstring(data)


class Package:
    """Members of a ZIP-based document."""

    def __init__(self, data: bytes, limits: Limits = LIMITS):
        try:
            self._zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as error:
            raise Failed("not a ZIP package", cause=error) from error
        guard(self._zip, limits)
        self.names = self._zip.namelist()
        self._known = set(self.names)
        self._roots: dict[str, Element | None] = {}

    def __contains__(self, name: str) -> bool:
        return name in self._known

    def bytes(self, name: str) -> bytes:
        return self._zip.read(name)

    def text(self, name: str) -> str:
        return self.bytes(name).decode("utf-8", "replace")

    def root(self, name: str) -> Element | None:
        """The member's XML root, parsed once; None where there is none or it's broken."""
        if name not in self._roots:
            try:
                self._roots[name] = parse_xml(self.bytes(name)) if name in self else None
            except ET.ParseError:
                self._roots[name] = None
        return self._roots[name]

    def relationships(self, part: str) -> dict[str, tuple[str, str, bool]]:
        """Id -> (type's last word, target as a member's name or address, external)."""
        folder, name = posixpath.split(part)
        root = self.root(posixpath.join(folder, "_rels", f"{name}.rels"))
        found = {}
        for r in root if root is not None else ():
            target, external = r.get("Target", ""), r.get("TargetMode") == "External"
            if not external:
                target = resolve(folder, target)
            found[r.get("Id", "")] = (r.get("Type", "").rpartition("/")[2], target, external)
        return found


def resolve(folder: str, target: str) -> str:
    """A relative or absolute member name, .. included."""
    return posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(folder, target))


def local(element: Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def find_all(element: Element | None, name: str) -> list[Element]:
    return [] if element is None else [e for e in element.iter() if local(e) == name]


def attribute(element: Element, name: str) -> str | None:
    """An attribute by its local name."""
    for key, value in element.attrib.items():
        if key.rpartition("}")[2] == name:
            return value
    return None


def is_ole(data: bytes) -> bool:
    return data[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"


def refuse_encrypted_ooxml(data: bytes) -> None:
    """Encrypted Office packages are compound files that hold an EncryptedPackage."""
    if is_ole(data):
        raise Encrypted("the package is encrypted")


CORE_FIELDS = {"title": "title", "creator": "author", "subject": "subject", "keywords": "keywords", "category": "category", "description": "comments", "created": "created", "modified": "modified", "lastModifiedBy": "last_modified_by", "revision": "revision", "language": "language"}


def core_properties(package: Package) -> dict[str, str]:
    root = package.root("docProps/core.xml")
    found = dict.fromkeys(CORE_FIELDS.values(), "")
    for e in root if root is not None else ():
        if local(e) in CORE_FIELDS:
            found[CORE_FIELDS[local(e)]] = (e.text or "").strip()
    return found
