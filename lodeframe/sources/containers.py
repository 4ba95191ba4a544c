"""Containers: what a file is, what stands in an archive, dex images inside other images, keep rules and R.txt."""

from __future__ import annotations

import io
import re
import struct
import zipfile

DEX_NAME = re.compile(r"classes(\d*)\.dex")
NATIVE = re.compile(r"(?:lib|jni)/([^/]+)/([^/]+\.so)")


def sniff(head: bytes, name: str = "", members: frozenset[str] | set[str] = frozenset()) -> str:
    """apk, aar, jar, dex, odex, vdex or unknown, by magic, extension and, for other archives, members."""
    if head[:4] == b"PK\x03\x04":
        ext = name.rpartition(".")[2].lower()
        if ext in ("apk", "apks", "aar", "jar"):
            return "apk" if ext == "apks" else ext
        if "AndroidManifest.xml" in members and any(DEX_NAME.fullmatch(m) for m in members):
            return "apk"
        return "aar" if "classes.jar" in members else "jar"
    return {b"dex": "dex", b"dey": "odex", b"vde": "vdex"}.get(head[:3], "unknown")


def dex_members(names: list[str]) -> list[str]:
    return sorted((n for n in names if DEX_NAME.fullmatch(n)), key=lambda n: int(DEX_NAME.fullmatch(n)[1] or 1))


#: Fixed values of the DEX header: bytes of one entry of each table (strings, types, prototypes, fields, methods, classes).
TABLE_WIDTHS = (4, 4, 12, 8, 8, 32)
DEX_MAGIC = re.compile(rb"dex\n[0-9]{3}\0")


def dex_size(data: memoryview) -> int:
    """Bytes of the whole dex image that data begins with; 0 if the header, or a table that it names, doesn't fit."""
    if len(data) < 0x70:
        return 0
    size, header, order, *words = struct.unpack_from("<20I", data, 32)
    tables = list(zip(words[3:15:2], words[4:15:2], strict=True))
    if header != 0x70 or order != 0x12345678 or not 0x70 < size <= len(data):
        return 0
    inside = all(not n or (0x70 <= at and at + n * width <= size) for (n, at), width in zip(tables, TABLE_WIDTHS, strict=True))
    return size if inside else 0


def carve(data: bytes) -> list[bytes]:
    """Whole dex images inside another image, each content once. An image inside an image belongs to the outer one."""
    view, images, end = memoryview(data), {}, 0
    for m in DEX_MAGIC.finditer(data):
        if m.start() >= end and (size := dex_size(view[m.start() :])):
            end = m.start() + size
            images.setdefault(bytes(view[m.start() : end]))
    return list(images)


def zip_facts(archive: zipfile.ZipFile) -> dict:
    """Members by what they tell: services, versions, Kotlin modules, signatures, native libraries, resource table."""
    names = archive.namelist()
    libs = [{"abi": m[1], "name": m[2], "size": archive.getinfo(n).file_size} for n in names if (m := NATIVE.fullmatch(n))]
    meta = [n for n in names if n.startswith("META-INF/")]
    return {
        "libs": libs,
        "services": sum(n.startswith("META-INF/services/") for n in meta),
        "versions": sum(n.endswith(".version") for n in meta),
        "kotlin_modules": sum(n.endswith(".kotlin_module") for n in meta),
        "signing_files": sum(n.endswith((".RSA", ".DSA", ".EC", ".SF")) for n in meta),
        "coroutines": any("coroutines" in n for n in meta),
        "resource_table": "resources.arsc" in names,
        "assets": [n for n in names if n.startswith(("assets/", "res/raw/"))],
    }


def class_entries(archive: zipfile.ZipFile) -> list[str]:
    return [n for n in archive.namelist() if n.endswith(".class") and not n.endswith("module-info.class")]


def open_zip(data: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(data))


def keep_rules(text: str) -> list[str]:
    """-keep... directives, each on one line; a directive goes on to the brace that closes it."""
    out, rule, depth = [], "", 0
    for line in re.sub(r"#.*", "", text).splitlines():
        line = line.strip()
        if not line:
            continue
        if depth == 0 and line.startswith("-"):
            if rule:
                out.append(rule)
            rule = line if line.startswith("-keep") else ""
        elif rule:
            rule += " " + line
        depth += line.count("{") - line.count("}")
    return [re.sub(r"\s+", " ", r) for r in [*out, rule] if r]


#: A literal class name in a keep rule, dotted.
KEPT_NAME = r"\b(?:class|interface|enum)\s+([A-Za-z_][\w.$]*)(?=[\s{]|$)"
