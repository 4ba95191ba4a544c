"""Code that a caller can paste: text from templates, for the few rows that are shown."""

from __future__ import annotations

import re

from lodeframe.functions.descriptors import PRIMITIVES

_ESCAPES = {"\\": "\\\\", '"': '\\"', "$": "\\$", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def kotlin_string(text: str) -> str:
    return '"' + "".join(_ESCAPES.get(c, c) for c in text or "") + '"'


def java_name(desc: str) -> str:
    core = desc.lstrip("[")
    return PRIMITIVES.get(core, core.removeprefix("L").removesuffix(";").replace("/", ".")) + "[]" * (len(desc) - len(core))


def type_expression(desc: str) -> str:
    if desc == "V":
        return "Void.TYPE"
    if desc in PRIMITIVES:
        return f"{PRIMITIVES[desc].capitalize()}::class.javaPrimitiveType!!"
    return f"loader.type({kotlin_string(java_name(desc))})"


def method_snippet(owner: str, name: str, params: list[str], ret: str, strings=()) -> str:
    """A lookup of one method by its structure. A static initializer can't be looked up."""
    if name == "<clinit>":
        return f"// {java_name(owner)}: a static initializer runs with the class and can't be looked up as a method\n"
    lines = [f"// {java_name(owner)}#{name}", f"loader.type({kotlin_string(java_name(owner))})"]
    block = "constructor" if name == "<init>" else f"method({kotlin_string(name)})"
    lines.append(f"    .{block} {{")
    lines.append(f"        parameters({', '.join(type_expression(p) for p in params)})")
    if name != "<init>":
        lines.append(f"        returns({type_expression(ret)})")
    lines += [f"        refersTo({kotlin_string(s)})" for s in list(strings)[:6]]
    return "\n".join([*lines, "    }"]) + "\n"


def field_snippet(owner: str, name: str, kind: str) -> str:
    return f"loader.type({kotlin_string(java_name(owner))}).field({kotlin_string(name)}, {type_expression(kind)})\n"


def class_snippet(owner: str) -> str:
    return f"val type = loader.type({kotlin_string(java_name(owner))})\n"


def check_balance(code: str) -> list[str]:
    """Brackets and quotes that don't close, after strings and comments are taken out."""
    bare = re.sub(r'"(?:\\.|[^"\\\n])*"', "", code)
    bare = re.sub(r"//[^\n]*|/\*.*?\*/", "", bare, flags=re.S)
    problems = ["quote"] if '"' in bare else []
    stack = []
    for c in bare:
        if c in "([{":
            stack.append(c)
        elif c in ")]}" and (not stack or "([{".index(stack.pop()) != ")]}".index(c)):
            return [*problems, f"bracket {c}"]
    return problems + [f"bracket {c}" for c in stack]
