"""Writers of small artifacts for tests: dex images, class files, binary XML, resource tables and packages."""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
import zlib

STR, OBJ = "Ljava/lang/String;", "Ljava/lang/Object;"
CALLS = {"virtual": 0x6E, "super": 0x6F, "direct": 0x70, "static": 0x71, "interface": 0x72}


def uleb(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def types_of(params: str) -> list[str]:
    import re

    return re.findall(r"\[*(?:[VZBCSIJFD]|L[^;]+;)", params)


def cls(desc, *, flags=1, parent=OBJ, faces=(), fields=(), methods=(), notes=(), constants=()):
    """fields: (name, type, flags); methods: (name, params, ret, flags, ops or None); notes: (type, visibility, {name: text}); constants: what
    static fields begin with, in order."""
    return {"desc": desc, "flags": flags, "parent": parent, "faces": list(faces), "fields": list(fields), "methods": list(methods), "notes": list(notes), "constants": list(constants)}


def dex(classes: list[dict], source: str = "A.java", tail: bytes = b"") -> bytes:
    """ops: ("str", text), ("call", kind, owner, name, params, ret), ("get" | "put" | "sget" | "sput", owner, name, type),
    ("new" | "const" | "cast", type), ("raw", units...)."""
    strings, types, protos, fields, methods = {source}, set(), set(), set(), set()

    def add_type(t):
        types.add(t)
        strings.add(t)

    def add_method(owner, name, params, ret):
        add_type(owner)
        strings.add(name)
        for t in [ret, *types_of(params)]:
            add_type(t)
        short = "".join(t if len(t) == 1 else "L" for t in [ret, *types_of(params)])
        strings.add(short)
        protos.add((short, ret, params))
        methods.add((owner, name, params, ret))

    def add_field(owner, name, kind):
        add_type(owner)
        add_type(kind)
        strings.add(name)
        fields.add((owner, name, kind))

    for c in classes:
        for t in [c["desc"], *([c["parent"]] if c["parent"] else []), *c["faces"]]:
            add_type(t)
        for name, kind, _ in c["fields"]:
            add_field(c["desc"], name, kind)
        for name, params, ret, _, ops in c["methods"]:
            add_method(c["desc"], name, params, ret)
            for op in ops or []:
                if op[0] == "str":
                    strings.add(op[1])
                elif op[0] == "call":
                    add_method(*op[2:])
                elif op[0] in ("get", "put", "sget", "sput"):
                    add_field(*op[1:])
                elif op[0] in ("new", "const", "cast"):
                    add_type(op[1])
        strings.update(c["constants"])
        for kind, _, values in c["notes"]:
            add_type(kind)
            for k, v in values.items():
                strings.update([k, v])
    s_list = sorted(strings, key=lambda s: s.encode("utf-16-be", "surrogatepass"))
    s_at = {s: k for k, s in enumerate(s_list)}
    t_list = sorted(types, key=s_at.get)
    t_at = {t: k for k, t in enumerate(t_list)}
    p_list = sorted(protos, key=lambda p: (t_at[p[1]], [t_at[t] for t in types_of(p[2])]))
    p_at = {(p[1], p[2]): k for k, p in enumerate(p_list)}
    f_list = sorted(fields, key=lambda f: (t_at[f[0]], s_at[f[1]], t_at[f[2]]))
    f_at = {f: k for k, f in enumerate(f_list)}
    m_list = sorted(methods, key=lambda m: (t_at[m[0]], s_at[m[1]], p_at[m[3], m[2]]))
    m_at = {m: k for k, m in enumerate(m_list)}
    heads = 0x70 + 4 * len(s_list) + 4 * len(t_list) + 12 * len(p_list) + 8 * len(f_list) + 8 * len(m_list) + 32 * len(classes)
    data = bytearray()

    def place(blob: bytes, align: int = 4) -> int:
        while (heads + len(data)) % align:
            data.append(0)
        at = heads + len(data)
        data.extend(blob)
        return at

    def type_list(ts) -> int:
        return place(struct.pack(f"<I{len(ts)}H", len(ts), *[t_at[t] for t in ts])) if ts else 0

    def code(ops, n_args) -> int:
        units = []
        for op in ops:
            if op[0] == "str":
                units += [0x1A | 1 << 8, s_at[op[1]]]
            elif op[0] == "call":
                units += [CALLS[op[1]] | 1 << 12, m_at[op[2:]], 0]
            elif op[0] in ("get", "put"):
                units += [(0x54 if op[0] == "get" else 0x5B) | 1 << 8, f_at[op[1:]]]
            elif op[0] in ("sget", "sput"):
                units += [0x62 if op[0] == "sget" else 0x69, f_at[op[1:]]]
            elif op[0] in ("new", "const", "cast"):
                units += [{"new": 0x22, "const": 0x1C, "cast": 0x1F}[op[0]], t_at[op[1]]]
            else:
                units += op[1:]
        units.append(0x0E)
        return place(struct.pack("<4H2I", 4 + n_args, n_args, 4, 0, 0, len(units)) + struct.pack(f"<{len(units)}H", *units))

    defs = b""
    proto_rows = [(s_at[p[0]], t_at[p[1]], type_list(types_of(p[2]))) for p in p_list]
    for c in classes:
        members = [[], [], [], []]
        for name, kind, flags in c["fields"]:
            members[0 if flags & 8 else 1].append((f_at[c["desc"], name, kind], flags))
        for name, params, ret, flags, ops in c["methods"]:
            direct = name.startswith("<") or flags & 0xA
            at = code(ops, len(types_of(params)) + (not flags & 8)) if ops is not None else 0
            members[2 if direct else 3].append((m_at[c["desc"], name, params, ret], flags | (0x10000 if name.startswith("<") else 0), at))
        blob = b"".join(uleb(len(m)) for m in members)
        for group in members:
            last = 0
            for row in sorted(group):
                blob += uleb(row[0] - last) + b"".join(uleb(x) for x in row[1:])
                last = row[0]
        class_data = place(blob, 1) if any(members) else 0
        notes = 0
        if c["notes"]:
            items = []
            for kind, visibility, values in c["notes"]:
                body = bytes([visibility]) + uleb(t_at[kind]) + uleb(len(values))
                for k, v in values.items():
                    body += uleb(s_at[k]) + bytes([0x17 | 3 << 5]) + struct.pack("<I", s_at[v])
                items.append(place(body, 1))
            own = place(struct.pack(f"<I{len(items)}I", len(items), *items))
            notes = place(struct.pack("<4I", own, 0, 0, 0))
        values = place(uleb(len(c["constants"])) + b"".join(bytes([0x17 | 3 << 5]) + struct.pack("<I", s_at[s]) for s in c["constants"]), 1) if c["constants"] else 0
        defs += struct.pack("<8I", t_at[c["desc"]], c["flags"], t_at[c["parent"]] if c["parent"] else 0xFFFFFFFF, type_list(c["faces"]), s_at[source], notes, class_data, values)
    text_at = [place(uleb(len(s)) + s.encode("utf-8", "surrogatepass").replace(b"\0", b"\xc0\x80") + b"\0", 1) for s in s_list]
    at = 0x70
    tables = []
    for n, size in ((len(s_list), 4), (len(t_list), 4), (len(p_list), 12), (len(f_list), 8), (len(m_list), 8), (len(classes), 32)):
        tables += [n, at]
        at += n * size
    body = struct.pack(f"<{len(s_list)}I", *text_at) + struct.pack(f"<{len(t_list)}I", *[s_at[t] for t in t_list]) + b"".join(struct.pack("<3I", *r) for r in proto_rows)
    body += b"".join(struct.pack("<HHI", t_at[o], t_at[k], s_at[n]) for o, n, k in f_list) + b"".join(struct.pack("<HHI", t_at[o], p_at[r, p], s_at[n]) for o, n, p, r in m_list) + defs + bytes(data) + tail
    total = 0x70 + len(body)
    rest = struct.pack("<20I", total, 0x70, 0x12345678, 0, 0, 0, *tables, len(data), heads)
    signed = hashlib.sha1(rest + body).digest()
    return b"dex\n035\0" + struct.pack("<I", zlib.adler32(signed + rest + body)) + signed + rest + body


# ---------------------------------------------------------------- XML and resources


def pool(strings: list[str], utf8: bool = False) -> bytes:
    at, blob = [], b""
    for s in strings:
        at.append(len(blob))
        raw = s.encode() if utf8 else s.encode("utf-16-le")
        blob += bytes([len(s), len(raw)]) + raw + b"\0" if utf8 else struct.pack("<H", len(s)) + raw + b"\0\0"
    blob += b"\0" * (-len(blob) % 4)
    head = 28 + 4 * len(strings)
    return struct.pack("<HHIIIIII", 1, 28, head + len(blob), len(strings), 0, 0x100 if utf8 else 0, head, 0) + struct.pack(f"<{len(at)}I", *at) + blob


def axml(tree: tuple) -> bytes:
    """tree: (tag, {name: text, int or bool}, [children])."""
    strings: list[str] = []

    def at(s: str) -> int:
        if s not in strings:
            strings.append(s)
        return strings.index(s)

    def node(tag, attrs, children) -> bytes:
        rows = b""
        for k, v in attrs.items():
            if isinstance(v, bool):
                rows += struct.pack("<IIIHBBI", 0xFFFFFFFF, at(k), 0xFFFFFFFF, 8, 0, 0x12, 0xFFFFFFFF if v else 0)
            elif isinstance(v, int):
                rows += struct.pack("<IIIHBBI", 0xFFFFFFFF, at(k), 0xFFFFFFFF, 8, 0, 0x10, v)
            else:
                rows += struct.pack("<IIIHBBI", 0xFFFFFFFF, at(k), at(v), 8, 0, 0x03, at(v))
        out = struct.pack("<HHIIIIIHHHHHH", 0x0102, 16, 36 + len(rows), 1, 0xFFFFFFFF, 0xFFFFFFFF, at(tag), 20, 20, len(attrs), 0, 0, 0) + rows
        for c in children:
            out += node(*c)
        return out + struct.pack("<HHIIIII", 0x0103, 16, 24, 1, 0xFFFFFFFF, 0xFFFFFFFF, at(tag))

    body = node(*tree)
    texts = pool(strings)
    return struct.pack("<HHI", 3, 8, 8 + len(texts) + len(body)) + texts + body


def arsc(package: str, types: dict[str, list[str]]) -> bytes:
    keys = [k for names in types.values() for k in names]
    t_pool, k_pool = pool(list(types)), pool(keys, True)
    chunks = b""
    for t, (name, names) in enumerate(types.items(), 1):
        offsets = struct.pack(f"<{len(names)}I", *[16 * k for k in range(len(names))])
        entries = b"".join(struct.pack("<HHI", 8, 0, keys.index(n)) + struct.pack("<HBBI", 8, 0, 0x10, 1) for n in names)
        config = struct.pack("<I", 28) + b"\0" * 24
        head = 20 + len(config)
        chunks += struct.pack("<HHI", 0x0202, 16, 16) + struct.pack("<BBHI", t, 0, 0, 0)
        for _ in range(2):  # a second configuration of the same type counts once
            chunks += struct.pack("<HHIBBHII", 0x0201, head, head + len(offsets) + len(entries), t, 0, 0, len(names), head + len(offsets)) + config + offsets + entries
    head = 288
    body = struct.pack("<HHII", 0x0200, head, head + len(t_pool) + len(k_pool) + len(chunks), 0x7F) + package.encode("utf-16-le").ljust(256, b"\0") + struct.pack("<5I", head, len(types), head + len(t_pool), len(keys), 0) + t_pool + k_pool + chunks
    first = pool([])
    return struct.pack("<HHII", 2, 12, 12 + len(first) + len(body), 1) + first + body


def archive(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, blob in members.items():
            z.writestr(zipfile.ZipInfo(name), blob)
    return out.getvalue()


# ---------------------------------------------------------------- class files


def java_class(name: str, *, parent="java/lang/Object", faces=(), methods=(), flags=0x21, constants=()) -> bytes:
    """methods: (name, descriptor, flags, ops or None); ops: ("str", text), ("const", class), ("get" | "put" | "sget" | "sput", owner, name,
    type), ("call", kind, owner, name, descriptor). constants: strings of the pool."""
    entries: list[bytes] = []

    def add(blob: bytes) -> int:
        if blob not in entries:
            entries.append(blob)
        return entries.index(blob) + 1

    utf = lambda s: add(b"\x01" + struct.pack(">H", len(s.encode())) + s.encode())
    kind = lambda s: add(b"\x07" + struct.pack(">H", utf(s)))
    pair = lambda n, t: add(b"\x0c" + struct.pack(">HH", utf(n), utf(t)))
    ref = lambda tag, o, n, t: add(bytes([tag]) + struct.pack(">HH", kind(o), pair(n, t)))
    for text in constants:
        add(b"\x08" + struct.pack(">H", utf(text)))
    body = b""
    for n, t, f, ops in methods:
        attrs = b""
        if ops is not None:
            code = b""
            for op in ops:
                if op[0] == "str":
                    code += b"\x13" + struct.pack(">H", add(b"\x08" + struct.pack(">H", utf(op[1]))))
                elif op[0] == "const":
                    code += b"\x13" + struct.pack(">H", kind(op[1]))
                elif op[0] == "call":
                    code += {"virtual": b"\xb6", "special": b"\xb7", "static": b"\xb8", "interface": b"\xb9"}[op[1]] + struct.pack(">H", ref(11 if op[1] == "interface" else 10, *op[2:])) + (b"\x01\x00" if op[1] == "interface" else b"")
                else:
                    code += {"sget": b"\xb2", "sput": b"\xb3", "get": b"\xb4", "put": b"\xb5"}[op[0]] + struct.pack(">H", ref(9, *op[1:]))
            code += b"\xb1"
            blob = struct.pack(">HHI", 2, 2, len(code)) + code + struct.pack(">HH", 0, 0)
            attrs = struct.pack(">HI", utf("Code"), len(blob)) + blob
        body += struct.pack(">4H", f, utf(n), utf(t), 1 if attrs else 0) + attrs
    this, up, source = kind(name), kind(parent), struct.pack(">HIH", utf("SourceFile"), 2, utf("A.java"))
    ids = [kind(x) for x in faces]
    return b"\xca\xfe\xba\xbe" + struct.pack(">HHH", 0, 52, len(entries) + 1) + b"".join(entries) + struct.pack(f">4H{len(ids)}H", flags, this, up, len(ids), *ids) + struct.pack(">HH", 0, len(methods)) + body + struct.pack(">H", 1) + source


# ---------------------------------------------------------------- the demo packages

D = "Lcom/example/demo/"
GREET = f"({STR})"
INIT = ("call", "direct", OBJ, "<init>", "()", "V")
CONCAT = ("call", "static", f"{D}Strings;", "concat", f"({STR}{STR})", STR)
GET_NAME = ("call", "virtual", f"{D}User;", "getName", "()", STR)


def log(level: str) -> tuple:
    return ("call", "static", "Landroid/util/Log;", level, f"({STR}{STR})", "I")


def user(desc: str, fields: list[str], names: list[str], notes=()) -> dict:
    token, (get, put, describe, create) = (desc, fields[0], STR), names
    return cls(desc, flags=0x21, notes=notes, fields=[(fields[0], STR, 2), (fields[1], STR, 0x18), (fields[2], "I", 1)], methods=[
        ("<init>", "()", "V", 1, [INIT]), (get, "()", STR, 1, [("get", *token)]), (put, GREET, "V", 1, [("put", *token)]),
        (describe, GREET, STR, 1, [("str", "user-describe:"), ("call", "static", desc, create, GREET, desc), ("call", "virtual", desc, get, "()", STR)]),
        (create, GREET, desc, 9, [("new", desc), INIT]),
    ])


def greeter(desc: str, face: str, greet: str, hello: list, name: str, **more) -> dict:
    return cls(desc, faces=[face], methods=[("<init>", "()", "V", 1, [INIT]), (greet, GREET, STR, 1, hello), ("name", "()", STR, 1, [("str", name)]), *more.pop("methods", [])], **more)


def demo_v1() -> list[list[dict]]:
    adapter_user = (f"{D}UserAdapter;", "user", f"{D}User;")
    one = [
        user(f"{D}User;", ["mToken", "sTag", "age"], ["getName", "setToken", "describe", "create"], [("Ldemo/Keep;", 1, {"value": "com.example.demo.User"})]),
        cls(f"{D}Greeter;", flags=0x601, parent=None, methods=[("greet", GREET, STR, 0x401, None), ("name", "()", STR, 0x401, None)]),
        greeter(f"{D}JavaGreeter;", f"{D}Greeter;", "greet", [("str", "Hello, "), CONCAT], "java-greeter", flags=0x21),
        cls(f"{D}Strings;", methods=[("concat", f"({STR}{STR})", STR, 9, [CONCAT])]),
        cls(f"{D}BuildConfig;", fields=[("APPLICATION_ID", STR, 0x19), ("VERSION_CODE", "I", 0x19)]),
        greeter(f"{D}UserAdapter;", f"{D}Greeter;", "greet", [("get", *adapter_user), GET_NAME], "adapter", fields=[("user", f"{D}User;", 2)], methods=[("bind", f"({D}User;)", "V", 1, [("put", *adapter_user), ("str", "adapter-bind"), ("call", "static", f"{D}Trace;", "beginSection", GREET, "V")])]),
    ]
    main, act = f"{D}MainActivity;", "Landroid/app/Activity;"
    two = [
        cls(main, flags=0x21, parent=act, fields=[("adapter", f"{D}UserAdapter;", 2), ("token", STR, 2)], methods=[
            ("<init>", "()", "V", 1, [("call", "direct", act, "<init>", "()", "V")]),
            ("onCreate", "(Landroid/os/Bundle;)", "V", 1, [("call", "super", act, "onCreate", "(Landroid/os/Bundle;)", "V"), ("str", "DemoTag"), ("str", "sign_in_clicked"), log("d"), ("new", f"{D}User;"), ("call", "direct", f"{D}User;", "<init>", "()", "V"), ("put", main, "adapter", f"{D}UserAdapter;"), GET_NAME, ("put", main, "token", STR), ("str", "shared_prefs_demo"), ("call", "static", f"{D}Prefs;", "key", GREET, "V")]),
            ("onClick", "(Landroid/view/View;)", "V", 1, [("str", "clicked-user"), ("call", "virtual", main, "getNameForLog", "()", STR), log("e")]),
            ("getNameForLog", "()", STR, 1, [("str", "MainActivity")]),
        ]),
        greeter(f"{D}MainActivity$$ExternalSyntheticLambda0;", f"{D}Greeter;", "greet", [("str", "lambda")], "lambda-name", flags=0x11),
    ]
    three = [cls(f"{D}DemoApp;", parent="Landroid/app/Application;", methods=[("<init>", "()", "V", 1, [("call", "direct", "Landroid/app/Application;", "<init>", "()", "V")])])]
    return [one, two, three]


def demo_v2() -> list[list[dict]]:
    act = "Landroid/app/Activity;"
    one = [
        user("La/b/c;", ["a", "b", "c"], ["a", "b", "c", "d"]),
        cls("La/b/d;", flags=0x601, parent=None, methods=[("a", GREET, STR, 0x401, None), ("name", "()", STR, 0x401, None)]),
        greeter("La/b/e;", "La/b/d;", "a", [("str", "Hello, "), CONCAT], "java-greeter"),
        cls("La/b/g;", methods=[("a", "()", "V", 1, [("str", "brand-new-in-v2")])]),
        cls(f"{D}Strings;", methods=[("concat", f"({STR}{STR})", STR, 9, [])]),
    ]
    two = [cls("La/b/f;", parent=act, fields=[("a", f"{D}UserAdapter;", 2)], methods=[
        ("<init>", "()", "V", 1, [("call", "direct", act, "<init>", "()", "V")]),
        ("onCreate", "(Landroid/os/Bundle;)", "V", 1, [("str", "DemoTag"), ("str", "sign_in_clicked"), log("d"), ("new", "La/b/c;"), ("call", "virtual", "La/b/c;", "a", "()", STR)]),
        ("onClick", "(Landroid/view/View;)", "V", 1, [("str", "clicked-user"), log("e")]),
    ])]
    return [one, two]


def manifest(package: str, code: int, name: str, app: str | None = None) -> tuple:
    parts = [("activity", {"name": ".MainActivity", "exported": True}, [("intent-filter", {}, [])]), ("service", {"name": ".DemoService"}, []), ("provider", {"name": ".DemoProvider", "authorities": f"{package}.provider"}, []), ("meta-data", {"name": "demo.channel", "value": "mcp"}, [])]
    return ("manifest", {"versionCode": code, "versionName": name, "package": package}, [("uses-sdk", {"minSdkVersion": 24, "targetSdkVersion": 34}, []), ("uses-permission", {"name": "android.permission.INTERNET"}, []), ("application", {"label": "Demo"} | ({"name": app} if app else {}), parts)])


def package(dexes: list[bytes], root: tuple, extra: dict[str, bytes] | None = None, resources: bytes | None = None) -> bytes:
    members = {"AndroidManifest.xml": axml(root)} | {f"classes{k or ''}.dex".replace("classes1.dex", "classes2.dex") if k < 2 else f"classes{k + 1}.dex": b for k, b in enumerate(dexes)}
    return archive(members | {"resources.arsc": resources if resources is not None else b"\x02\x00\x0c\x00broken", "META-INF/CERT.RSA": b"x"} | (extra or {}))
