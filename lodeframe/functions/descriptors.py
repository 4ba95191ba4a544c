"""Type descriptors and member spellings, as column expressions; arguments of callers are parsed on the driver."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeframe.errors import bad_argument

#: Primitive types of the class file format.
PRIMITIVES = {"V": "void", "Z": "boolean", "B": "byte", "C": "char", "S": "short", "I": "int", "J": "long", "F": "float", "D": "double"}

#: Access flags by what they are set on, in the order in which they are named.
CLASS_FLAGS = {0x1: "public", 0x2: "private", 0x4: "protected", 0x8: "static", 0x10: "final", 0x200: "interface", 0x400: "abstract", 0x2000: "annotation", 0x4000: "enum", 0x20: "super-deprecated"}
FIELD_FLAGS = {0x1: "public", 0x2: "private", 0x4: "protected", 0x8: "static", 0x10: "final", 0x40: "volatile", 0x80: "transient", 0x4000: "enum"}
METHOD_FLAGS = {0x1: "public", 0x2: "private", 0x4: "protected", 0x8: "static", 0x10: "final", 0x20: "synchronized", 0x40: "bridge", 0x80: "varargs", 0x100: "native", 0x400: "abstract", 0x800: "strictfp", 0x10000: "constructor", 0x20000: "declared-synchronized"}
MODIFIERS = {name: bit for bit, name in METHOD_FLAGS.items() if name != "constructor"}


def _dims(desc: Column) -> Column:
    return F.length(F.regexp_extract(desc, r"^\[*", 0))


def _choose(value: Column, table: dict, otherwise: Column) -> Column:
    return reduce(lambda out, kv: F.when(value == kv[0], F.lit(kv[1])).otherwise(out), table.items(), otherwise)


def normalize_desc(spelling: Column) -> Column:
    """A descriptor from any spelling: a.b.C, a/b/C, La/b/C;, int[], [I."""
    s = F.trim(spelling)
    base = F.regexp_replace(s, r"(\s*\[\s*\])+$", "")
    dims = ((F.length(s) - F.length(F.regexp_replace(s, r"\[\s*\]", ""))) / 2).cast("int")
    named = F.concat(F.lit("L"), F.translate(base, ".", "/"), F.lit(";"))
    plain = _choose(base, {v: k for k, v in PRIMITIVES.items()}, F.when(base.rlike(r"^\[*(L[^;]+;|[VZBCSIJFD])$"), base).otherwise(named))
    return F.when(s.startswith("["), F.translate(s, ".", "/")).otherwise(F.concat(F.repeat(F.lit("["), dims), plain))


def _plain_name(core: Column) -> Column:
    """The binary name of what isn't an array. Patterns cost much in a row, so what is spelled as usual goes without them."""
    usual = core.startswith("L") & core.endswith(";")
    named = F.replace(F.when(usual, F.substr(core, F.lit(2), F.length(core) - 2)).otherwise(F.regexp_replace(core, "^L|;$", "")), F.lit("/"), F.lit("."))
    return F.when(usual, named).otherwise(_choose(core, PRIMITIVES, named))


def binary_name(desc: Column) -> Column:
    """La/b/C; -> a.b.C, [[I -> int[][]."""
    core = F.ltrim(desc, F.lit("["))
    array = F.concat(_plain_name(core), F.repeat(F.lit("[]"), F.length(desc) - F.length(core)))
    return F.when(desc.startswith("["), array).otherwise(_plain_name(desc))


def internal_name(desc: Column) -> Column:
    """Like binary_name, but arrays keep their bracket form with dots."""
    return F.when(desc.startswith("["), F.translate(desc, "/", ".")).otherwise(binary_name(desc))


def java_type(desc: Column, simple: bool = False) -> Column:
    name = binary_name(desc)
    return F.substring_index(name, ".", -1) if simple else name


def split_params(params: Column) -> Column:
    found = F.regexp_extract_all(params, F.lit(r"\[*(?:[VZBCSIJFD]|L[^;]+;)"), 0)
    return F.when(params == "()", F.array().cast("array<string>")).otherwise(found)


def join_params(types: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(types, ""), F.lit(")"))


def shorty(types: Column, ret: Column) -> Column:
    letter = lambda t: F.when(t.rlike(r"^[\[L]"), F.lit("L")).otherwise(t)
    return F.concat(letter(ret), F.array_join(F.transform(types, letter), ""))


def smali_method(owner: Column, name: Column, params: Column, ret: Column) -> Column:
    return F.concat(owner, F.lit("->"), name, params, ret)


def smali_field(owner: Column, name: Column, kind: Column) -> Column:
    return F.concat(owner, F.lit("->"), name, F.lit(":"), kind)


def reflector_method(owner: Column, name: Column, params: Column, ret: Column) -> Column:
    return smali_method(internal_name(owner), name, params, ret)


def reflector_field(owner: Column, name: Column, kind: Column) -> Column:
    return smali_field(internal_name(owner), name, kind)


def _visible(flags: Column, table: dict) -> Column:
    return F.concat_ws(" ", *[F.when(flags.bitwiseAND(bit) != 0, F.lit(word)) for bit, word in table.items() if word in ("public", "protected", "private", "static", "final")])


def java_method(owner: Column, name: Column, params: Column, ret: Column, flags: Column, simple: bool = False) -> Column:
    args = F.concat(F.lit("("), F.array_join(F.transform(split_params(params), lambda p: java_type(p, simple)), ", "), F.lit(")"))
    head = F.when(name == "<init>", java_type(owner, simple)).otherwise(F.concat(java_type(ret, simple), F.lit(" "), name))
    return F.trim(F.concat(_visible(flags, METHOD_FLAGS), F.lit(" "), head, args))


def java_field(name: Column, kind: Column, flags: Column, simple: bool = False) -> Column:
    return F.trim(F.concat(_visible(flags, FIELD_FLAGS), F.lit(" "), java_type(kind, simple), F.lit(" "), name))


def class_for_name(desc: Column, loader: bool = False) -> Column:
    return F.concat(F.lit('Class.forName("'), binary_name(desc), F.lit('", true, classLoader)' if loader else '")'))


def flag_names(flags: Column, table: dict) -> Column:
    return F.filter(F.array(*[F.when(flags.bitwiseAND(bit) != 0, F.lit(word)) for bit, word in table.items()]), lambda w: w.isNotNull())


def method_flag_names(flags: Column, name: Column) -> Column:
    """The constructor bit is read by the method's name: <clinit> is a static initializer, other names than <init> don't carry it."""
    words = flag_names(flags, METHOD_FLAGS)
    without = F.filter(words, lambda w: w != "constructor")
    has = F.array_contains(words, "constructor")
    return F.when(has & (name == "<clinit>"), F.concat(without, F.array(F.lit("static-initializer")))).when(has & (name != "<init>"), without).otherwise(words)


def class_kind(flags: Column) -> Column:
    bit = lambda b: flags.bitwiseAND(b) != 0
    return F.when(bit(0x200), "interface").when(bit(0x2000), "annotation").when(bit(0x4000), "enum").when(bit(0x400), "abstract").otherwise("class")


def simple_name(desc: Column) -> Column:
    return F.substring_index(F.regexp_replace(desc, r"^\[*L|;$", ""), "/", -1)


def package_of(desc: Column) -> Column:
    """In slash form; empty for the root package."""
    return F.regexp_extract(F.regexp_replace(desc, r"^\[*L|;$", ""), "^(.*)/[^/]*$", 1)


def method_forms(owner: Column, name: Column, params: Column, ret: Column, flags: Column) -> Column:
    types = split_params(params)
    return F.struct(
        F.lit("method").alias("kind"), binary_name(owner).alias("owner"), name.alias("name"), smali_method(owner, name, params, ret).alias("smali"), reflector_method(owner, name, params, ret).alias("reflector"),
        java_method(owner, name, params, ret, flags).alias("java"), java_method(owner, name, params, ret, flags, True).alias("javaSimple"), types.alias("params"), params.alias("paramsDescriptor"), ret.alias("returnDescriptor"),
        binary_name(ret).alias("returnType"), F.size(types).alias("paramCount"), shorty(types, ret).alias("shorty"),
    )


def field_forms(owner: Column, name: Column, kind: Column, flags: Column) -> Column:
    return F.struct(F.lit("field").alias("kind"), binary_name(owner).alias("owner"), name.alias("name"), smali_field(owner, name, kind).alias("smali"), reflector_field(owner, name, kind).alias("reflector"), java_field(name, kind, flags).alias("java"), java_field(name, kind, flags, True).alias("javaSimple"), kind.alias("typeDescriptor"), binary_name(kind).alias("type"))


# ---------------------------------------------------------------- arguments, on the driver


def to_desc(text: str) -> str:
    """normalize_desc for one argument."""
    s = text.strip()
    if not s:
        raise bad_argument("a type is missing")
    if s.startswith("["):
        return s.replace(".", "/")
    base = re.sub(r"(\s*\[\s*\])+$", "", s)
    dims = (len(s) - len(re.sub(r"\[\s*\]", "", s))) // 2 if base != s else 0
    back = {v: k for k, v in PRIMITIVES.items()}
    if base in back:
        plain = back[base]
    elif re.fullmatch(r"L[^;]+;|[VZBCSIJFD]", base):
        plain = base
    else:
        plain = f"L{base.replace('.', '/')};"
    return "[" * dims + plain


def parse_method_ref(text: str) -> tuple[str | None, str, list[str] | None, str | None]:
    """(owner, name, parameter types or None, return type or None) of owner->name(params)ret, owner#name, owner.name(A, B): R or name."""
    s = text.strip()
    m = re.fullmatch(r"(?:(?P<owner>.+?)(?:->|#))?(?P<name><init>|<clinit>|[\w$-]+)(?:\((?P<args>[^)]*)\)\s*:?\s*(?P<ret>\S+)?)?", s)
    if not m:
        m = re.fullmatch(r"(?:(?P<owner>[\w$./\[\];]+)\.)?(?P<name><init>|<clinit>|[\w$-]+)(?:\((?P<args>[^)]*)\)\s*:?\s*(?P<ret>\S+)?)?", s)
    if not m:
        raise bad_argument(f"not a method reference: {text!r}", "write owner->name(params)ret, owner#name or name")
    owner = to_desc(m["owner"]) if m["owner"] else None
    args = None
    if m["args"] is not None:
        raw = m["args"].strip()
        if raw and re.fullmatch(r"(?:\[*(?:[VZBCSIJFD]|L[^;,\s]+;))+", raw):
            args = re.findall(r"\[*(?:[VZBCSIJFD]|L[^;]+;)", raw)
        else:
            args = [to_desc(a) for a in raw.split(",") if a.strip()]
    return owner, m["name"], args, to_desc(m["ret"]) if m["ret"] else None


def parse_field_ref(text: str) -> tuple[str | None, str, str | None]:
    """(owner, name, type or None) of owner->name:type, owner#name, owner.name or name."""
    s = text.strip()
    m = re.fullmatch(r"(?:(?P<owner>.+?)(?:->|#))?(?P<name>[\w$]+)(?:\s*:\s*(?P<type>\S+))?", s) or re.fullmatch(r"(?P<owner>[\w$./]+)\.(?P<name>[\w$]+)(?:\s*:\s*(?P<type>\S+))?", s)
    if not m:
        raise bad_argument(f"not a field reference: {text!r}", "write owner->name:type, owner#name or name")
    return (to_desc(m["owner"]) if m["owner"] else None), m["name"], to_desc(m["type"]) if m["type"] else None
