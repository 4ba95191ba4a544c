"""Failures that a caller can act on: each has a code, a message and a suggestion."""

from __future__ import annotations

#: The codes of the contract.
CODES = ("SESSION_NOT_FOUND", "PACKED_TARGET", "UNSUPPORTED_FORMAT", "INVALID_PATH", "INDEX_STALE", "ADB_UNAVAILABLE", "DECOMPILER_UNAVAILABLE", "BACKEND_UNAVAILABLE", "APK_TOO_LARGE", "NOT_FOUND", "BAD_ARGUMENT", "PARSE_FAILED", "INTERNAL")


class EngineError(Exception):
    def __init__(self, code: str, message: str, suggestion: str = ""):
        if code not in CODES:
            raise ValueError(f"unknown code {code}")
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.suggestion = code, message, suggestion


def bad_argument(message: str, suggestion: str = "") -> EngineError:
    return EngineError("BAD_ARGUMENT", message, suggestion)
