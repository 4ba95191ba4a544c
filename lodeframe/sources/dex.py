"""The DEX format (published specification): classes, members, annotations and what each method refers to.

A broken method never ends a file: it is marked partial and noted. Text is decoded from modified UTF-8; lone surrogates become U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections import Counter
from itertools import islice

NO_INDEX = 0xFFFFFFFF

#: Names of reference kinds by code.
KINDS = {1: "invoke-virtual", 2: "invoke-super", 3: "invoke-direct", 4: "invoke-static", 5: "invoke-interface", 6: "invoke-dynamic", 7: "invoke-polymorphic", 8: "invoke-custom", 9: "const-class", 10: "iput", 11: "iget", 12: "sput", 13: "sget", 14: "check-cast", 15: "instance-of", 16: "new-instance", 17: "new-array"}
CODES = {name: code for code, name in KINDS.items()}

#: Fixed values: (first opcode, last opcode, 16-bit units) of the instruction formats; all others take one unit.
WIDTHS = (
    (0x02, 0x02, 2), (0x03, 0x03, 3), (0x05, 0x05, 2), (0x06, 0x06, 3), (0x08, 0x08, 2), (0x09, 0x09, 3),
    (0x13, 0x13, 2), (0x14, 0x14, 3), (0x15, 0x16, 2), (0x17, 0x17, 3), (0x18, 0x18, 5), (0x19, 0x1A, 2),
    (0x1B, 0x1B, 3), (0x1C, 0x1C, 2), (0x1F, 0x20, 2), (0x22, 0x23, 2), (0x24, 0x26, 3), (0x29, 0x29, 2),
    (0x2A, 0x2C, 3), (0x2D, 0x3D, 2), (0x44, 0x6D, 2), (0x6E, 0x72, 3), (0x74, 0x78, 3), (0x90, 0xAF, 2),
    (0xD0, 0xE2, 2), (0xFA, 0xFB, 4), (0xFC, 0xFD, 3), (0xFE, 0xFF, 2),
)
UNITS = [next((n for a, b, n in WIDTHS if a <= op <= b), 1) for op in range(256)]
_INVOKES = {0x6E: 1, 0x6F: 2, 0x70: 3, 0x71: 4, 0x72: 5, 0x74: 1, 0x75: 2, 0x76: 3, 0x77: 4, 0x78: 5, 0xFA: 7, 0xFB: 7}
_TYPES = {0x1C: 9, 0x1F: 14, 0x20: 15, 0x22: 16, 0x23: 17, 0x24: 17, 0x25: 17}


class DexError(ValueError):
    pass


def clean(text: str) -> str:
    """Lone surrogates can't be stored as UTF-8."""
    return re.sub("[\ud800-\udfff]", "�", text)


def mutf8(raw: bytes) -> str:
    """Modified UTF-8: C0 80 is NUL, supplementary characters are pairs of encoded surrogates."""
    return clean(raw.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16", "replace"))


class Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, fmt: str):
        out = struct.unpack_from("<" + fmt, self.data, self.at)
        self.at += struct.calcsize("<" + fmt)
        return out if len(out) > 1 else out[0]

    def uleb(self) -> int:
        out = shift = 0
        while True:
            byte = self.data[self.at]
            self.at += 1
            out |= (byte & 0x7F) << shift
            if byte < 0x80:
                return out
            shift += 7


#: What an annotation may hold before it is summed up (characters of JSON, of a text and of a name, elements, names, levels).
JSON_CHARS, TEXT_CHARS, NAME_CHARS, ELEMENTS, NAMES, LEVELS = 4096, 200, 64, 64, 32, 4
#: Control characters but tab, line feed and carriage return.
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
_DEEP = '{"_depth": true}'


def _digest(text: str) -> dict | None:
    """What stands for a text that is too long, or of whose first characters more than a third are control characters."""
    head = text[:64]
    if len(text) <= TEXT_CHARS and 3 * len(_CONTROL.findall(head)) <= len(head):
        return None
    return {"_blob": len(text), "_sha1": hashlib.sha1(text.encode("utf-8", "replace")).hexdigest()[:12]}


def _spelled(value, level: int):
    """The JSON of an annotation value, token by token."""
    if isinstance(value, (list, dict)) and level == LEVELS:
        yield _DEEP
    elif isinstance(value, dict):
        comma = "{"
        for key, inner in islice(value.items(), ELEMENTS):
            yield f"{comma}{json.dumps(clean(str(key)[:NAME_CHARS]), ensure_ascii=False)}: "
            yield from _spelled(inner, level + 1)
            comma = ", "
        yield "}" if comma != "{" else "{}"
    elif isinstance(value, list):
        comma = "["
        for inner in islice(value, ELEMENTS):
            yield comma
            yield from _spelled(inner, level + 1)
            comma = ", "
        yield "]" if comma != "[" else "[]"
    else:
        yield json.dumps((_digest(value) or clean(value)) if isinstance(value, str) else value, ensure_ascii=False)


def args_json(args: dict) -> str:
    """The values of an annotation, if they take JSON_CHARS at most; else how long they are, and some names. Tokens beyond are counted, not
    kept."""
    size, out = 0, []
    for token in _spelled(args, 0):
        size += len(token)
        if size <= JSON_CHARS:
            out.append(token)
    if size > JSON_CHARS:
        return json.dumps({"_truncated": size, "keys": [str(k)[:NAME_CHARS] for k in islice(args, NAMES)]}, ensure_ascii=False)
    return "".join(out)


class Dex:
    def __init__(self, data: bytes):
        if len(data) < 0x70 or data[:4] != b"dex\n":
            raise DexError("not a dex file")
        self.data, self.version = data, data[4:7].decode("ascii", "replace")
        h = struct.unpack_from("<20I", data, 32)
        if h[1] < 0x70 or h[2] != 0x12345678:
            raise DexError("bad header or byte order")
        (self.n_strings, self.strings_at, self.n_types, self.types_at, self.n_protos, self.protos_at, self.n_fields, self.fields_at, self.n_methods, self.methods_at, self.n_classes, self.classes_at) = h[6:18]
        self.notes: list[str] = []
        self._strings: dict[int, str] = {}

    def counts(self) -> dict[str, int]:
        return {"strings": self.n_strings, "types": self.n_types, "protos": self.n_protos, "fields": self.n_fields, "methods": self.n_methods, "classes": self.n_classes}

    def string(self, i: int) -> str:
        if i not in self._strings:
            if i >= self.n_strings:
                raise DexError(f"string {i} of {self.n_strings}")
            r = Reader(self.data, struct.unpack_from("<I", self.data, self.strings_at + 4 * i)[0])
            r.uleb()
            self._strings[i] = mutf8(self.data[r.at : self.data.index(b"\0", r.at)])
        return self._strings[i]

    def type(self, i: int) -> str:
        if i >= self.n_types:
            raise DexError(f"type {i} of {self.n_types}")
        name = self.string(struct.unpack_from("<I", self.data, self.types_at + 4 * i)[0])
        return name if re.fullmatch(r"\[*(L.+;|[VZBCSIJFD])", name, re.S) else f"L{name};"

    def type_list(self, at: int) -> list[str]:
        if not at:
            return []
        n = struct.unpack_from("<I", self.data, at)[0]
        return [self.type(i) for i in struct.unpack_from(f"<{n}H", self.data, at + 4)]

    def proto(self, i: int) -> tuple[str, str, str]:
        short, ret, params = struct.unpack_from("<3I", self.data, self.protos_at + 12 * i)
        return self.string(short), f"({''.join(self.type_list(params))})", self.type(ret)

    def field(self, i: int) -> tuple[str, str, str]:
        if i >= self.n_fields:
            raise DexError(f"field {i} of {self.n_fields}")
        owner, kind, name = struct.unpack_from("<HHI", self.data, self.fields_at + 8 * i)
        return self.type(owner), self.string(name), self.type(kind)

    def method(self, i: int) -> tuple[str, str, str, str, str]:
        """owner, name, params, return, shorty"""
        if i >= self.n_methods:
            raise DexError(f"method {i} of {self.n_methods}")
        owner, proto, name = struct.unpack_from("<HHI", self.data, self.methods_at + 8 * i)
        short, params, ret = self.proto(proto)
        return self.type(owner), self.string(name), params, ret, short

    # -------------------------------------------------------------- annotations

    def value(self, r: Reader, depth: int = 0):
        head = r.take("B")
        kind, arg = head & 0x1F, head >> 5
        if depth > 6:
            raise DexError("annotation too deep")
        if kind in (0x1C, 0x1D):
            if kind == 0x1D:
                return self.annotation(r, depth + 1)
            return [self.value(r, depth + 1) for _ in range(min(r.uleb(), 4096))]
        if kind == 0x1E:
            return None
        if kind == 0x1F:
            return bool(arg)
        raw = self.data[r.at : r.at + arg + 1]
        r.at += arg + 1
        if kind in (0x00, 0x02, 0x04, 0x06):
            return int.from_bytes(raw, "little", signed=True)
        number = int.from_bytes(raw, "little")
        if kind == 0x03:
            return clean(chr(number))
        if kind in (0x10, 0x11):
            size, fmt = (4, "<f") if kind == 0x10 else (8, "<d")
            return struct.unpack(fmt, raw.rjust(size, b"\0"))[0]
        if kind == 0x17:
            return self.string(number)
        if kind == 0x18:
            return self.type(number)
        if kind in (0x19, 0x1B):
            owner, name, _ = self.field(number)
            return f"{owner}->{name}"
        if kind == 0x1A:
            owner, name, params, ret, _ = self.method(number)
            return f"{owner}->{name}{params}{ret}"
        if kind == 0x15:
            return self.proto(number)[1:]
        raise DexError(f"value of kind {kind:#x}")

    def annotation(self, r: Reader, depth: int = 0) -> dict:
        kind = self.type(r.uleb())
        return {"@type": kind} | {self.string(r.uleb()): self.value(r, depth + 1) for _ in range(r.uleb())}

    def annotation_set(self, at: int) -> list[dict]:
        out = []
        if at:
            for (item,) in struct.iter_unpack("<I", self.data[at + 4 : at + 4 + 4 * struct.unpack_from("<I", self.data, at)[0]]):
                try:
                    r = Reader(self.data, item)
                    visibility = r.take("B")
                    found = self.annotation(r)
                    kind = found.pop("@type")
                    if visibility > 2 or not kind.startswith("L"):
                        raise DexError(f"annotation {kind} of visibility {visibility}")
                    out.append({"descriptor": kind, "visibility": visibility, "args": args_json(found)})
                except (DexError, IndexError, struct.error, ValueError) as e:
                    self.notes.append(f"annotation: {e}")
        return out

    def constants(self, at: int) -> list[str]:
        """Strings that static fields begin with, each once."""
        out: list[str] = []
        if at:
            try:
                r = Reader(self.data, at)
                for _ in range(r.uleb()):
                    kind, value = self.data[r.at] & 0x1F, self.value(r)
                    if kind == 0x17:
                        out.append(value)
            except (DexError, IndexError, struct.error, ValueError) as e:
                self.notes.append(f"static values: {e}")
        return list(dict.fromkeys(out))

    # -------------------------------------------------------------- code

    def code(self, at: int) -> dict:
        regs, ins, _, _, _, n = struct.unpack_from("<4H2I", self.data, at)
        units = struct.unpack_from(f"<{n}H", self.data, at + 16)
        strings, refs, i = [], Counter(), 0
        while i < n:
            op = units[i] & 0xFF
            if op == 0 and units[i] in (0x0100, 0x0200, 0x0300):
                size = units[i + 1]
                if units[i] == 0x0100:
                    i += size * 2 + 4
                elif units[i] == 0x0200:
                    i += size * 4 + 2
                else:
                    i += ((units[i + 2] | units[i + 3] << 16) * size + 1) // 2 + 4
                continue
            width = UNITS[op]
            if i + width > n:
                raise DexError(f"instruction {op:#x} runs over the end")
            index = units[i + 1] if width > 1 else 0
            if op == 0x1A:
                strings.append(self.string(index))
            elif op == 0x1B:
                strings.append(self.string(index | units[i + 2] << 16))
            elif op in _TYPES:
                refs[_TYPES[op], self.type(index), "", "", ""] += 1
            elif 0x52 <= op <= 0x6D:
                kind = CODES[("iget", "iput", "sget", "sput")[(op - 0x52) // 7]]
                owner, name, of = self.field(index)
                refs[kind, owner, name, "", of] += 1
            elif op in _INVOKES:
                owner, name, params, ret, _ = self.method(index)
                refs[_INVOKES[op], owner, name, params, ret] += 1
            elif op in (0xFC, 0xFD):
                refs[8, "", f"call_site_{index}", "", ""] += 1
            i += width
        return {"regs": regs, "ins": ins, "units": n, "strings": list(dict.fromkeys(strings)), "refs": [[*k, v] for k, v in refs.items()]}

    # -------------------------------------------------------------- classes

    def classes(self):
        for i in range(self.n_classes):
            kind, flags, parent, interfaces, source, notes, data, values = struct.unpack_from("<8I", self.data, self.classes_at + 32 * i)
            try:
                yield self._class(self.type(kind), flags, parent, interfaces, source, notes, data, values)
            except (DexError, IndexError, struct.error, ValueError) as e:
                self.notes.append(f"class {i}: {e}")

    def _class(self, desc: str, flags: int, parent: int, interfaces: int, source: int, notes_at: int, data_at: int, values_at: int) -> dict:
        out = {"descriptor": desc, "access_flags": flags, "super_descriptor": None if parent == NO_INDEX else self.type(parent), "interfaces": self.type_list(interfaces), "source_file": None if source == NO_INDEX else self.string(source), "fields": [], "methods": [], "annotations": [], "constants": self.constants(values_at)}
        if data_at:
            r = Reader(self.data, data_at)
            sizes = [r.uleb() for _ in range(4)]
            for k, size in enumerate(sizes[:2]):
                index = 0
                for _ in range(size):
                    index += r.uleb()
                    access = r.uleb()
                    _, name, kind = self.field(index)
                    out["fields"].append({"name": name, "type_descriptor": kind, "access_flags": access, "is_static": k == 0})
            for size in sizes[2:]:
                index = 0
                for _ in range(size):
                    index += r.uleb()
                    access, code_at = r.uleb(), r.uleb()
                    _, name, params, ret, short = self.method(index)
                    body, partial = {"regs": 0, "ins": 0, "units": 0, "strings": [], "refs": []}, False
                    if code_at:
                        try:
                            body = self.code(code_at)
                        except (DexError, IndexError, struct.error, ValueError) as e:
                            partial = True
                            self.notes.append(f"{desc}->{name}: {e}")
                    out["methods"].append({"name": name, "params_descriptor": params, "return_descriptor": ret, "access_flags": access, "shorty": short, "partial": partial} | body)
        if notes_at:
            on_class, n_fields, n_methods, _ = struct.unpack_from("<4I", self.data, notes_at)
            out["annotations"] += [a | {"method": None} for a in self.annotation_set(on_class)]
            for k in range(n_methods):
                index, at = struct.unpack_from("<2I", self.data, notes_at + 16 + 8 * (n_fields + k))
                owner, name, params, ret, _ = self.method(index)
                out["annotations"] += [a | {"method": f"{owner}->{name}{params}{ret}"} for a in self.annotation_set(at)]
        return out
