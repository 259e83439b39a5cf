"""Office packages: a reader of ZIP files with limits, and of XML without entities."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.parsers import expat

#: Limits of a package (fixed values).
LIMITS = {
    "file_bytes": 256 << 20, "entries": 4096, "compressed_bytes": 256 << 20, "uncompressed_bytes": 768 << 20, "entry_bytes": 128 << 20, "ratio": 200, "xml_bytes": 64 << 20, "xml_depth": 128, "text_chars": 8 << 20,
}


class PackageError(ValueError):
    """A package that can't be read safely; ``code`` tells why."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


#: What each code means for the file (fixed values); other codes are ``failed``.
STATUS = {"OOXML_ABORTED": "cancelled", "OOXML_UNSUPPORTED": "unsupported", "OOXML_ENCRYPTED": "unsupported", "OOXML_LIMIT_EXCEEDED": "limits_exceeded"}


def safe_name(name: str) -> str:
    """The name with forward slashes; one that leaves the package is an error."""
    name = name.replace("\\", "/")
    if not name or name.startswith("/") or re.match(r"[A-Za-z]:", name) or ".." in name.split("/") or "\0" in name:
        raise PackageError("OOXML_PATH_TRAVERSAL", "Unsafe ZIP entry path")
    return name


class Package:
    """Entries of a ZIP file in memory. The central directory decides; sizes are checked before anything is inflated."""

    def __init__(self, data: bytes, limits: dict | None = None):
        self.limits = LIMITS | (limits or {})
        if len(data) > self.limits["file_bytes"]:
            raise PackageError("OOXML_LIMIT_EXCEEDED", "file exceeds byte limit")
        if len(data) < 22 or data[:4] != b"PK\x03\x04":
            raise PackageError("OOXML_INVALID_ZIP", "Missing ZIP local header")
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError, OverflowError) as e:
            raise PackageError("OOXML_INVALID_ZIP", str(e)) from e
        infos = self.zip.infolist()
        if len(infos) > self.limits["entries"]:
            raise PackageError("OOXML_LIMIT_EXCEEDED", "ZIP entry count exceeds limit")
        self.entries: dict[str, zipfile.ZipInfo] = {}
        for i in infos:
            name = safe_name(i.orig_filename)
            if i.flag_bits & 1:
                raise PackageError("OOXML_ENCRYPTED", "Encrypted packages are unsupported")
            if i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or i.extract_version >= 45 and i.file_size >= 0xFFFFFFFF:
                raise PackageError("OOXML_UNSUPPORTED", "compression method or ZIP64 is unsupported")
            if name in self.entries:
                raise PackageError("OOXML_INVALID_ZIP", "Duplicate ZIP entry")
            if i.file_size > self.limits["entry_bytes"] or i.file_size > self.limits["ratio"] * i.compress_size:
                raise PackageError("OOXML_LIMIT_EXCEEDED", "ZIP decompression limits exceeded")
            self.entries[name] = i
        if sum(i.compress_size for i in infos) > self.limits["compressed_bytes"] or sum(i.file_size for i in infos) > self.limits["uncompressed_bytes"]:
            raise PackageError("OOXML_LIMIT_EXCEEDED", "ZIP decompression limits exceeded")

    def read(self, name: str) -> bytes | None:
        """The entry's bytes, checked by size and CRC; null if there is none."""
        if name not in self.entries:
            return None
        try:
            data = self.zip.read(self.entries[name])
        except (zipfile.BadZipFile, zlib.error, EOFError, ValueError, NotImplementedError) as e:
            raise PackageError("OOXML_INVALID_ZIP", f"{name}: {e}") from e
        if len(data) != self.entries[name].file_size:
            raise PackageError("OOXML_INVALID_ZIP", "ZIP entry size mismatch")
        return data

    def ending_with(self, suffix: str) -> bytes | None:
        """The first entry by name that ends so; names may be of any of several encodings."""
        for raw in sorted(self.entries):
            info = self.entries[raw]
            names = {raw}
            if not info.flag_bits & 0x800:
                for code in ("utf-8", "gbk"):
                    try:
                        names.add(raw.encode("cp437").decode(code))
                    except (UnicodeDecodeError, UnicodeEncodeError):
                        continue
            if any(n.endswith(suffix) for n in names):
                return self.read(raw)
        return None

    def events(self, name: str) -> Iterator[tuple[str, str, dict]]:
        """('start', tag, attributes), ('text', text, {}) and ('end', tag, {}) of an XML entry, without prefixes."""
        data = self.read(name)
        if data is None:
            return
        if len(data) > self.limits["xml_bytes"]:
            raise PackageError("OOXML_LIMIT_EXCEEDED", "XML entry exceeds size limit")
        if re.search(rb"(?i)<!DOCTYPE|<!ENTITY", data):
            raise PackageError("OOXML_UNSUPPORTED", "DTD and XML entities are unsupported")
        out: list[tuple[str, str, dict]] = []
        depth = chars = 0
        local = lambda tag: tag.rpartition(":")[2]
        parser = expat.ParserCreate()
        parser.buffer_text = True

        def start(tag: str, given: dict) -> None:
            nonlocal depth
            depth += 1
            if depth > self.limits["xml_depth"]:
                raise PackageError("OOXML_LIMIT_EXCEEDED", "XML nesting exceeds limit")
            out.append(("start", local(tag), {**{local(k): v for k, v in given.items()}, **given}))

        def end(tag: str) -> None:
            nonlocal depth
            depth -= 1
            out.append(("end", local(tag), {}))

        def text(data: str) -> None:
            nonlocal chars
            chars += len(data)
            if chars > self.limits["text_chars"]:
                raise PackageError("OOXML_LIMIT_EXCEEDED", "XML text exceeds limit")
            out.append(("text", data, {}))

        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
        try:
            for at in range(0, len(data), 1 << 16):
                parser.Parse(data[at : at + (1 << 16)], False)
                yield from out
                out.clear()
            parser.Parse(b"", True)
        except expat.ExpatError as e:
            raise PackageError("OOXML_MALFORMED_XML", f"{name}: {e}") from e
        yield from out

    def relations(self, part: str) -> dict[str, dict]:
        """Relationships of a part: id to type, target (a part, or a URL if external)."""
        folder, _, file = part.rpartition("/")
        found = {}
        for kind, tag, given in self.events(f"{folder}/_rels/{file}.rels" if folder else f"_rels/{file}.rels"):
            if kind == "start" and tag == "Relationship":
                outside = given.get("TargetMode") == "External"
                target = given.get("Target", "")
                found[given.get("Id", "")] = {"type": given.get("Type", ""), "external": outside, "target": target if outside else resolve(part, target)}
        return found


def resolve(part: str, target: str) -> str:
    """The part that a relationship's target names; one outside the package is an error."""
    path = posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(posixpath.dirname(part), target))
    if path.startswith("..") or re.match(r"[A-Za-z]+:", path):
        raise PackageError("OOXML_MALFORMED_RELATIONSHIP", "Relationship escapes the package")
    return path
