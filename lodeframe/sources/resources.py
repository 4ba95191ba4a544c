"""Binary XML and resource tables (published chunk formats), and manifests from either kind of XML."""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET

from lodeframe.sources.dex import clean

ANDROID = "http://schemas.android.com/apk/res/android"
#: Component tags and the kind that each counts as.
COMPONENTS = {"activity": "activity", "activity-alias": "activity", "service": "service", "receiver": "receiver", "provider": "provider"}
#: Attribute names by resource id, for manifests of which the names are stripped.
ATTRIBUTES = {0x01010000: "theme", 0x01010001: "label", 0x01010002: "icon", 0x01010003: "name", 0x01010006: "permission", 0x0101000E: "enabled", 0x01010010: "exported", 0x01010011: "process", 0x01010018: "authorities", 0x01010024: "value", 0x01010025: "resource", 0x0101020C: "minSdkVersion", 0x0101021B: "versionCode", 0x0101021C: "versionName", 0x01010270: "targetSdkVersion"}


class ChunkError(ValueError):
    pass


def string_pool(data: bytes, at: int) -> list[str]:
    kind, head, _, n, _, flags, strings_at, _ = struct.unpack_from("<HHIIIIII", data, at)
    if kind != 0x0001:
        raise ChunkError("no string pool")
    out = []
    for offset in struct.unpack_from(f"<{n}I", data, at + head):
        p = at + strings_at + offset
        if flags & 0x100:
            for _ in range(2):  # characters, then bytes
                size = data[p]
                p += 1
                if size & 0x80:
                    size = (size & 0x7F) << 8 | data[p]
                    p += 1
            out.append(clean(data[p : p + size].decode("utf-8", "replace")))
        else:
            size = struct.unpack_from("<H", data, p)[0]
            p += 2
            if size & 0x8000:
                size = (size & 0x7FFF) << 16 | struct.unpack_from("<H", data, p)[0]
                p += 2
            out.append(clean(data[p : p + 2 * size].decode("utf-16-le", "replace")))
    return out


def _value(kind: int, value: int, pool: list[str]):
    if kind == 0x03:
        return pool[value] if value < len(pool) else None
    if kind == 0x12:
        return value != 0
    if kind == 0x04:
        return struct.unpack("<f", struct.pack("<I", value))[0]
    if kind == 0x01:
        return f"@{value:#010x}"
    if kind == 0x02:
        return f"?{value:#010x}"
    return struct.unpack("<i", struct.pack("<I", value))[0] if kind in (0x10, 0x11) else value


def parse_axml(data: bytes) -> dict:
    """The root element: {tag, attrs, children}."""
    if len(data) < 8 or struct.unpack_from("<H", data)[0] != 0x0003:
        raise ChunkError("not binary XML")
    pool, ids, at = [], [], struct.unpack_from("<H", data, 2)[0]
    root: dict = {"tag": "", "attrs": {}, "children": []}
    stack = [root]
    while at + 8 <= len(data):
        kind, head, size = struct.unpack_from("<HHI", data, at)
        if size < 8:
            raise ChunkError("empty chunk")
        if kind == 0x0001:
            pool = string_pool(data, at)
        elif kind == 0x0180:
            ids = list(struct.unpack_from(f"<{(size - head) // 4}I", data, at + head))
        elif kind == 0x0102:
            _, name, first, each, n = struct.unpack_from("<IIHHH", data, at + head)
            attrs = {}
            for k in range(n):
                _, key, raw, _, _, what, value = struct.unpack_from("<IIIHBBI", data, at + head + first + k * each)
                label = pool[key] or (ATTRIBUTES.get(ids[key], "") if key < len(ids) else "")
                attrs[label] = pool[raw] if what == 0x03 and raw != 0xFFFFFFFF else _value(what, value, pool)
            node = {"tag": pool[name], "attrs": attrs, "children": []}
            stack[-1]["children"].append(node)
            stack.append(node)
        elif kind == 0x0103 and len(stack) > 1:
            stack.pop()
        at += size
    if not root["children"]:
        raise ChunkError("no element")
    return root["children"][0]


def parse_text_xml(text: str) -> dict:
    def node(e: ET.Element) -> dict:
        words = {"true": True, "false": False}
        return {"tag": e.tag, "attrs": {k.rpartition("}")[2]: words.get(v, v) for k, v in e.attrib.items()}, "children": [node(c) for c in e]}

    return node(ET.fromstring(text))


def _int(value) -> int | None:
    try:
        return int(str(value), 0)
    except ValueError:
        return None


def manifest_of(root: dict) -> dict:
    """The manifest summary and its components. exported stays null where it is not said."""
    out = {"package": root["attrs"].get("package"), "version_name": None, "version_code": _int(root["attrs"].get("versionCode")), "min_sdk": None, "target_sdk": None, "application": None, "uses_permissions": [], "permissions": [], "features": [], "meta_data": {}, "components": []}
    name = root["attrs"].get("versionName")
    out["version_name"] = None if name is None else str(name)
    for child in root["children"]:
        attrs = child["attrs"]
        if child["tag"] == "uses-sdk":
            out["min_sdk"], out["target_sdk"] = _int(attrs.get("minSdkVersion")), _int(attrs.get("targetSdkVersion"))
        for tag, key in (("uses-permission", "uses_permissions"), ("permission", "permissions"), ("uses-feature", "features")):
            if child["tag"] == tag and attrs.get("name"):
                out[key].append(str(attrs["name"]))
        if child["tag"] == "application":
            out["application"] = attrs.get("name")
            for c in child["children"]:
                a = c["attrs"]
                if c["tag"] == "meta-data" and a.get("name"):
                    out["meta_data"][str(a["name"])] = str(a.get("value", a.get("resource", "")))
                elif c["tag"] in COMPONENTS:
                    said = a.get("exported")
                    out["components"].append({"type": COMPONENTS[c["tag"]], "name": str(a.get("name", "")), "exported": said if isinstance(said, bool) else None, "permission": a.get("permission"), "process": a.get("process"), "enabled": a.get("enabled") if isinstance(a.get("enabled"), bool) else None})
    return out


def read_manifest(data: bytes) -> dict:
    return manifest_of(parse_axml(data) if data[:2] == b"\x03\x00" else parse_text_xml(data.decode("utf-8")))


def parse_arsc(data: bytes) -> tuple[list[dict], list[str]]:
    """Entries (of the first configuration of each type) and notes on what could not be read."""
    entries: list[dict] = []
    notes: list[str] = []
    try:
        kind, head, size, _ = struct.unpack_from("<HHII", data)
        if kind != 0x0002:
            raise ChunkError("not a resource table")
        at = head
        while at + 8 <= min(size, len(data)):
            kind, _, step = struct.unpack_from("<HHI", data, at)
            if step < 8:
                raise ChunkError("empty chunk")
            if kind == 0x0200:
                _package(data, at, entries)
            at += step
    except (ChunkError, IndexError, struct.error) as e:
        notes.append(str(e) or "cut short")
    return entries, notes


def _package(data: bytes, start: int, entries: list[dict]) -> None:
    _, head, size, number = struct.unpack_from("<HHII", data, start)
    name = data[start + 12 : start + 268].decode("utf-16-le", "replace").split("\0")[0]
    types_at, _, keys_at, _ = struct.unpack_from("<4I", data, start + 268)
    types, keys = string_pool(data, start + types_at), string_pool(data, start + keys_at)
    seen, at = set(), start + head
    while at + 8 <= start + size:
        kind, own_head, step = struct.unpack_from("<HHI", data, at)
        if step < 8:
            raise ChunkError("empty chunk")
        if kind == 0x0201:
            type_id, _, _, n, first = struct.unpack_from("<BBHII", data, at + 8)
            if type_id not in seen and 0 < type_id <= len(types):
                seen.add(type_id)
                for k, offset in enumerate(struct.unpack_from(f"<{n}I", data, at + own_head)):
                    if offset != 0xFFFFFFFF:
                        key = struct.unpack_from("<I", data, at + first + offset + 4)[0]
                        entries.append({"pkg": name, "type": types[type_id - 1], "name": keys[key], "type_id": type_id, "entry_id": k, "id": f"0x{number << 24 | type_id << 16 | k:08x}"})
        at += step
