"""Results for a caller: items within a budget of bytes, totals, and failures with their code."""

from __future__ import annotations

import json

from lodeframe.errors import EngineError

ITEM_BYTES, RESPONSE_BYTES = 2048, 32 * 1024
#: What a cut item keeps first.
PROTECTED = ("descriptor", "binaryName", "class", "name", "smali", "reflector", "java", "string", "from", "to", "type", "score", "kind")


def size_of(value) -> int:
    return len(json.dumps(value, ensure_ascii=False, default=str).encode())


def shorten(item: dict, most: int = ITEM_BYTES) -> dict:
    """The item within its budget: long lists and texts are cut, then all but the names goes."""
    if size_of(item) <= most:
        return item
    cut = {k: (v[:5] if isinstance(v, list) else v[:200] if isinstance(v, str) and k not in PROTECTED else v) for k, v in item.items()} | {"clipped": True}
    return cut if size_of(cut) <= most else {k: v for k, v in cut.items() if k in PROTECTED} | {"clipped": True}


def ok(items: list[dict], total: int | None = None, session_id: str = "", hint: str = "", max_bytes: int = RESPONSE_BYTES, **more) -> dict:
    """{ok, sessionId, total, items, truncated, hint, ...} of max_bytes at most. A single item is not shortened."""
    total = len(items) if total is None else total
    out = {"ok": True, "sessionId": session_id, "total": total, "items": [], "truncated": False, "hint": hint} | more
    used, kept = size_of(out) + 64, []
    for item in items:
        item = shorten(item) if len(items) > 1 else item
        used += size_of(item) + 2
        if kept and used > max_bytes:
            break
        kept.append(item)
    if len(kept) == 1 and used > max_bytes:
        kept = [shorten(kept[0], max(256, max_bytes - size_of(out) - 128))]
    return out | {"items": kept, "truncated": len(kept) < total}


def fail(error: EngineError) -> dict:
    return {"ok": False, "code": error.code, "message": error.message, "suggestion": error.suggestion}
