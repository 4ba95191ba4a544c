"""The class file format (published specification), in the record shape of the DEX parser."""

from __future__ import annotations

import re
import struct
from collections import Counter

from lodeframe.sources.dex import CODES, clean, mutf8


class ClassError(ValueError):
    pass


#: Fixed values: (first opcode, last opcode, bytes) of instructions; all others take one byte.
SIZES = (
    (0x10, 0x10, 2), (0x11, 0x11, 3), (0x12, 0x12, 2), (0x13, 0x14, 3), (0x15, 0x19, 2), (0x36, 0x3A, 2), (0x84, 0x84, 3),
    (0x99, 0xA8, 3), (0xA9, 0xA9, 2), (0xB2, 0xB8, 3), (0xB9, 0xBA, 5), (0xBB, 0xBB, 3), (0xBC, 0xBC, 2), (0xBD, 0xBD, 3),
    (0xC0, 0xC1, 3), (0xC5, 0xC5, 4), (0xC6, 0xC7, 3), (0xC8, 0xC9, 5),
)
_SIZE = [next((n for a, b, n in SIZES if a <= op <= b), 1) for op in range(256)]
_FIELDS = {0xB2: "sget", 0xB3: "sput", 0xB4: "iget", 0xB5: "iput"}
_CALLS = {0xB6: "invoke-virtual", 0xB7: "invoke-direct", 0xB8: "invoke-static", 0xB9: "invoke-interface"}
_TYPES = {0xBB: "new-instance", 0xBD: "new-array", 0xC0: "check-cast", 0xC1: "instance-of", 0xC5: "new-array"}


def _pool(data: bytes, at: int) -> tuple[list, int]:
    n = struct.unpack_from(">H", data, at)[0]
    at += 2
    pool: list = [None] * n
    k = 1
    while k < n:
        tag = data[at]
        if tag == 1:
            size = struct.unpack_from(">H", data, at + 1)[0]
            pool[k] = (tag, mutf8(data[at + 3 : at + 3 + size]))
            at += 3 + size
        elif tag in (3, 4, 9, 10, 11, 12, 17, 18):
            pool[k] = (tag, *struct.unpack_from(">HH", data, at + 1))
            at += 5
        elif tag in (5, 6):
            pool[k] = (tag,)
            at += 9
            k += 1
        elif tag in (7, 8, 16, 19, 20):
            pool[k] = (tag, struct.unpack_from(">H", data, at + 1)[0])
            at += 3
        elif tag == 15:
            pool[k] = (tag, *struct.unpack_from(">BH", data, at + 1))
            at += 4
        else:
            raise ClassError(f"constant of tag {tag}")
        k += 1
    return pool, at


def _desc(name: str) -> str:
    return name if name.startswith("[") else f"L{name};"


def parse_class(data: bytes) -> dict:
    """One class. Raises ClassError, IndexError or struct.error for what is not a class file."""
    if data[:4] != b"\xca\xfe\xba\xbe":
        raise ClassError("not a class file")
    pool, at = _pool(data, 8)
    text = lambda i: pool[i][1]
    named = lambda i: text(pool[i][1])
    flags, own, parent, n = struct.unpack_from(">4H", data, at)
    interfaces = [_desc(named(i)) for i in struct.unpack_from(f">{n}H", data, at + 8)]
    at += 8 + 2 * n
    desc = _desc(named(own))
    out = {"descriptor": desc, "access_flags": flags & ~0x20, "super_descriptor": _desc(named(parent)) if parent else None, "interfaces": interfaces, "source_file": None, "fields": [], "methods": [], "annotations": []}
    out["constants"] = list(dict.fromkeys(text(entry[1]) for entry in pool if entry and entry[0] == 8))

    def member(ref: int) -> tuple[str, str, str]:
        owner, nt = pool[ref][1:]
        return _desc(named(owner)), text(pool[nt][1]), text(pool[nt][2])

    def code(start: int, end: int) -> dict:
        stack, local, size = struct.unpack_from(">HHI", data, start)
        base, strings, refs, i = start + 8, [], Counter(), 0
        if base + size > end:
            raise ClassError("code runs over its attribute")
        while i < size:
            op = data[base + i]
            if op in (0xAA, 0xAB):
                k = i + 4 - i % 4
                if op == 0xAA:
                    low, high = struct.unpack_from(">ii", data, base + k + 4)
                    i = k + 12 + 4 * (high - low + 1)
                else:
                    i = k + 8 + 8 * struct.unpack_from(">i", data, base + k + 4)[0]
                continue
            if op == 0xC4:
                i += 6 if data[base + i + 1] == 0x84 else 4
                continue
            index = data[base + i + 1] if op == 0x12 else struct.unpack_from(">H", data, base + i + 1)[0] if _SIZE[op] >= 3 else 0
            if op in (0x12, 0x13):
                if pool[index][0] == 8:
                    strings.append(named(index))
                elif pool[index][0] == 7:
                    refs[CODES["const-class"], _desc(named(index)), "", "", ""] += 1
            elif op in _FIELDS:
                owner, name, kind = member(index)
                refs[CODES[_FIELDS[op]], owner, name, "", kind] += 1
            elif op in _CALLS:
                owner, name, kind = member(index)
                m = re.fullmatch(r"(\([^)]*\))(.+)", kind)
                refs[CODES[_CALLS[op]], owner, name, m[1], m[2]] += 1
            elif op == 0xBA:
                nt = pool[index][2]
                m = re.fullmatch(r"(\([^)]*\))(.+)", text(pool[nt][2]))
                refs[CODES["invoke-dynamic"], "", text(pool[nt][1]), m[1], m[2]] += 1
            elif op in _TYPES:
                refs[CODES[_TYPES[op]], _desc(named(index)), "", "", ""] += 1
            i += _SIZE[op]
        return {"regs": stack + local, "ins": local, "units": size, "strings": list(dict.fromkeys(strings)), "refs": [[*k, v] for k, v in refs.items()]}

    for what in ("fields", "methods"):
        n = struct.unpack_from(">H", data, at)[0]
        at += 2
        for _ in range(n):
            access, name, kind, attributes = struct.unpack_from(">4H", data, at)
            at += 8
            body, partial = {"regs": 0, "ins": 0, "units": 0, "strings": [], "refs": []}, False
            for _ in range(attributes):
                label, size = struct.unpack_from(">HI", data, at)
                if what == "methods" and text(label) == "Code":
                    try:
                        body = code(at + 6, at + 6 + size)
                    except (ClassError, IndexError, TypeError, struct.error):
                        partial = True
                at += 6 + size
            if what == "fields":
                out["fields"].append({"name": clean(text(name)), "type_descriptor": text(kind), "access_flags": access, "is_static": bool(access & 8)})
            else:
                m = re.fullmatch(r"(\([^)]*\))(.+)", text(kind))
                types = re.findall(r"\[*(?:[VZBCSIJFD]|L[^;]+;)", m[1])
                short = "".join(t if t in "VZBCSIJFD" else "L" for t in [m[2], *types])
                out["methods"].append({"name": clean(text(name)), "params_descriptor": m[1], "return_descriptor": m[2], "access_flags": access, "shorty": short, "partial": partial} | body)
    for _ in range(struct.unpack_from(">H", data, at)[0]):
        label, size = struct.unpack_from(">HI", data, at + 2)
        if text(label) == "SourceFile":
            out["source_file"] = text(struct.unpack_from(">H", data, at + 8)[0])
        at += 6 + size
    return out
