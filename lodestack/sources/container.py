"""Packages: members of ZIP files, nested split packages, and what each member is."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from .chunks import ChunkError, binary_xml

#: Bounds of a container: entries, bytes of one nested package, of all, and of its metadata.
ENTRIES_MOST, NESTED_MOST, TOTAL_MOST, METADATA_MOST = 200_000, 2 << 30, 4 << 30, 32 << 20
PREVIEW_MOST = 8 << 20
_DEX = re.compile(r"classes([2-9]|[1-9][0-9]+)?\.dex")


class ContainerError(ValueError):
    """A container that cannot be opened as a whole; nothing of it is loaded."""

    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")
        self.code = code


@dataclass(frozen=True)
class Entry:
    """A member: the nested package it is in, its path there, its path in the union, and its bytes' reader."""

    source: str
    member: str
    path: str
    size: int
    is_package_member: bool


def is_dex(name: str) -> bool:
    found = _DEX.fullmatch(name)
    return found is not None and (found[1] is None or int(found[1]) < 1 << 32)


def check_names(names: list[str]) -> None:
    """Relative, plain, and distinct where case does not count."""
    folded: set[str] = set()
    for name in names:
        parts = name.rstrip("/").split("/")
        if not name or name.startswith("/") or "\\" in name or "\0" in name or len(name.encode()) > 4096 or any(p in ("", ".", "..") for p in parts):
            raise ContainerError("UNSAFE_NAME", repr(name[:80]))
        if name.lower() in folded:
            raise ContainerError("DUPLICATE_NAME", name)
        folded.add(name.lower())


class Package:
    """One ZIP file, its directory checked before anything is read."""

    def __init__(self, data: bytes, name: str = ""):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError) as error:
            raise ContainerError("NOT_A_ZIP", f"{name}: {error}") from error
        self.name = name
        infos = self.zip.infolist()
        if len(infos) > ENTRIES_MOST or sum(len(i.filename) + len(i.extra) + len(i.comment) for i in infos) > METADATA_MOST:
            raise ContainerError("DIRECTORY_TOO_LARGE", name)
        check_names([i.filename for i in infos])
        if sum(i.file_size for i in infos) > TOTAL_MOST:
            raise ContainerError("TOO_LARGE", name)
        self.files = {i.filename: i for i in infos if not i.is_dir()}

    def read(self, member: str, most: int = NESTED_MOST) -> bytes:
        info = self.files.get(member)
        if info is None:
            raise ContainerError("NO_MEMBER", member)
        if info.file_size > most:
            raise ContainerError("MEMBER_TOO_LARGE", member)
        return self.zip.read(info)

    def prefix(self, member: str, size: int) -> bytes:
        with self.zip.open(self.files[member]) as stream:
            return stream.read(size)

    def manifest(self) -> dict[str, str | None]:
        """package, versionCode and split of the manifest."""
        raw = self.read("AndroidManifest.xml", METADATA_MOST)
        try:
            text = binary_xml(raw) if not raw.lstrip().startswith(b"<") else raw.decode()
        except (ChunkError, UnicodeDecodeError) as error:
            raise ContainerError("BAD_MANIFEST", f"{self.name}: {error}") from error
        head = re.search(r"<manifest\b[^>]*>", text)
        get = lambda n: (m := re.search(rf'\b{n}="([^"]*)"', head[0])) and m[1]
        return {"package": get("package"), "version": get("(?:android:)?versionCode"), "split": get("split")} if head else {}


class Container:
    """A package, or a bundle of one base and its splits, as one union of entries."""

    def __init__(self, data: bytes, name: str):
        outer = Package(data, name)
        kind = name.rpartition(".")[2].lower()
        nested = sorted(n for n in outer.files if n.endswith(".apk"))
        self.packages: list[tuple[str | None, Package]] = []
        self.outer = None
        if kind == "apk" or not nested:
            self.packages = [(None, outer)]
        else:
            self.outer = outer
            if kind == "xapk":
                self._references(outer)
            opened = [Package(outer.read(n), n) for n in nested]
            self.packages = self._union(opened)

    @staticmethod
    def _references(outer: Package) -> None:
        if "manifest.json" not in outer.files:
            return
        try:
            listed = json.loads(outer.read("manifest.json", METADATA_MOST)).get("split_apks", [])
        except (ValueError, AttributeError) as error:
            raise ContainerError("BAD_BUNDLE", str(error)) from error
        for one in listed:
            if one.get("file") not in outer.files:
                raise ContainerError("MISSING_SPLIT", str(one.get("file")))

    @staticmethod
    def _union(opened: list[Package]) -> list[tuple[str | None, Package]]:
        heads = [p.manifest() for p in opened]
        bases = [k for k, h in enumerate(heads) if not h.get("split")]
        if len(bases) != 1:
            raise ContainerError("BASE", f"{len(bases)} packages without a split name")
        if len({(h.get("package"), h.get("version")) for h in heads}) != 1:
            raise ContainerError("MIXED_PACKAGES", "members differ in package or version")
        splits = [h["split"] for h in heads if h.get("split")]
        if len(set(splits)) != len(splits):
            raise ContainerError("DUPLICATE_SPLIT", ", ".join(sorted(splits)))
        for s in splits:
            parent, mark, _ = s.partition(".config.")
            if mark and parent not in splits:
                raise ContainerError("ORPHAN_SPLIT", s)
        order = [bases[0], *sorted((k for k in range(len(opened)) if k != bases[0]), key=lambda k: heads[k]["split"])]
        return [(heads[k].get("split"), opened[k]) for k in order]

    def entries(self) -> Iterator[tuple[Entry, Package]]:
        for split, package in self.packages:
            for member, info in sorted(package.files.items()):
                path = member if split is None else f"splits/{split}/{member}"
                yield Entry(package.name, member, path, info.file_size, True), package
        if self.outer is not None:
            for member, info in sorted(self.outer.files.items()):
                if not member.endswith(".apk"):
                    yield Entry(self.outer.name, member, f"container/{member}", info.file_size, False), self.outer


# Leading bytes of image formats.
IMAGES = ((b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpeg"), (b"GIF8", "gif"), (b"RIFF", "webp"), (b"BM", "bmp"))


def preview(data: bytes) -> tuple[str, str | None]:
    """(`text`, `image`, `binary` or `too_large`; the text, or the image's format)."""
    if len(data) > PREVIEW_MOST:
        return "too_large", None
    for head, name in IMAGES:
        if data.startswith(head) and (name != "webp" or data[8:12] == b"WEBP"):
            return "image", name
    if data[:4] == b"\x03\x00\x08\x00":
        try:
            return "text", binary_xml(data)
        except ChunkError:
            return "binary", None
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return "binary", None
    return ("binary", None) if "\0" in text else ("text", text)
