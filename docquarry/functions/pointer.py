"""JSON Pointers, as tokens, as variant paths and as resolvers."""

from __future__ import annotations

from typing import Any

from ..plans.errors import invalid

MAX_BYTES = 1024
MISSING = object()


def tokens(path: str) -> list[str]:
    if not isinstance(path, str) or not path.startswith("/"):
        raise invalid(f"field paths begin with `/`: write `/{path}`")
    if len(path.encode()) > MAX_BYTES:
        raise invalid(f"a field path has at most {MAX_BYTES} bytes")
    out = []
    for part in path[1:].split("/"):
        plain, at = [], 0
        while at < len(part):
            if part[at] == "~":
                if part[at : at + 2] not in ("~0", "~1"):
                    raise invalid(f"`~` in `{path}` must be written `~0`")
                plain.append("~" if part[at + 1] == "0" else "/")
                at += 2
            else:
                plain.append(part[at])
                at += 1
        out.append("".join(plain))
    return out


def variant_path(parts: list[str]) -> str:
    """Members by name only."""
    return "$" + "".join('["' + p.replace("\\", "\\\\").replace('"', '\\"') + '"]' for p in parts)


def is_index(part: str) -> bool:
    return part == "0" or (part.isascii() and part.isdigit() and part[0] != "0" and len(part) < 10)


def resolve(body: Any, parts: list[str], arrays: bool = True) -> Any:
    """The value at a path, MISSING if absent; through arrays only where `arrays`."""
    for part in parts:
        if isinstance(body, dict) and part in body:
            body = body[part]
        elif arrays and isinstance(body, list) and is_index(part) and int(part) < len(body):
            body = body[int(part)]
        else:
            return MISSING
    return body
