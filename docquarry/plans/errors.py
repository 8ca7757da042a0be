"""Errors with the codes that callers act on."""

from __future__ import annotations

# The error codes of the interface.
CODES = (
    "INVALID_ARGUMENT", "INDEX_REQUIRED", "RESOURCE_EXHAUSTED", "CURSOR_EXPIRED", "NOT_FOUND", "UNAVAILABLE", "CORRUPTION",
    "CONFLICT", "SCHEMA_VIOLATION", "UNIQUE_VIOLATION", "FORBIDDEN", "UNAUTHENTICATED", "QUOTA_EXCEEDED", "UNKNOWN_OUTCOME", "SUSPENDED", "INTERNAL",
)


class EngineError(Exception):
    def __init__(self, code: str, message: str):
        assert code in CODES, code
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message


def invalid(message: str) -> EngineError:
    return EngineError("INVALID_ARGUMENT", message)
