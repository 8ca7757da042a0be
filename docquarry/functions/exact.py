"""Exact JSON: numbers stay decimal from text to text, duplicate members are errors."""

from __future__ import annotations

import json
import re
from decimal import ROUND_HALF_EVEN, Context, Decimal
from typing import Any

from ..plans.errors import invalid

#: Wide enough for sums and quotients of numbers within the limits.
CONTEXT = Context(prec=6000, Emax=999_999, Emin=-999_999, rounding=ROUND_HALF_EVEN)
MAX_TEXT, MAX_DIGITS, MAX_EXPONENT = 256, 100, 1000
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")


class Number(Decimal):
    """A JSON number that remembers how it was written."""

    text: str

    def __new__(cls, text: str):
        made = super().__new__(cls, text)
        made.text = text
        return made


def number(value: Any) -> Decimal:
    """The normalised value of a JSON number or decimal text within the limits."""
    text = value.text if isinstance(value, Number) else str(value)
    if len(text.encode()) > MAX_TEXT or not _NUMBER.fullmatch(text if not isinstance(value, Decimal) or isinstance(value, Number) else _plain_or_sci(value)):
        raise invalid(f"`{text[:40]}` is not a decimal number of at most {MAX_TEXT} bytes")
    exact = Decimal(text)
    if exact == 0:
        return Decimal(0)
    exact = exact.normalize(CONTEXT)
    if len(exact.as_tuple().digits) > MAX_DIGITS or abs(exact.adjusted()) > MAX_EXPONENT:
        raise invalid(f"numbers have at most {MAX_DIGITS} digits and exponents of at most {MAX_EXPONENT}")
    return exact


def _plain_or_sci(value: Decimal) -> str:
    return str(value).replace("E+", "e").replace("E", "e")


def plain(value: Decimal) -> str:
    """Normalised text without exponent."""
    value = value.normalize(CONTEXT) if value else Decimal(0)
    return format(value, "f")


def key_of(value: Decimal) -> str:
    """Text that orders as the number does: sign, exponent, digits; complemented below zero."""
    if value == 0:
        return "1"
    sign, digits, _ = value.normalize(CONTEXT).as_tuple()
    body = f"{value.adjusted() + 500_000:06d}{''.join(map(str, digits))}"
    if not sign:
        return "2" + body
    return "0" + body.translate(_COMPLEMENT) + "~"


_COMPLEMENT = str.maketrans("0123456789", "9876543210")


def average(total: Decimal, count: int, scale: int) -> Decimal | None:
    """total / count, rounded half-even once at `scale` places."""
    if not count:
        return None
    whole = CONTEXT.multiply(total, Decimal(1).scaleb(scale))
    tail = max(0, -whole.as_tuple().exponent)
    n, d = int(whole.scaleb(tail, CONTEXT)), count * 10**tail
    q, r = divmod(abs(n), d)
    q += 2 * r > d or (2 * r == d and q % 2 == 1)
    return Decimal(-q if n < 0 else q).scaleb(-scale, CONTEXT)


def _members(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for name, value in pairs:
        if name in out:
            raise invalid(f"`{name}` may appear only once")
        out[name] = value
    return out


def _constant(name: str) -> Any:
    raise invalid(f"`{name}` is not JSON")


def loads(text: str) -> Any:
    try:
        return json.loads(text, object_pairs_hook=_members, parse_float=Number, parse_int=Number, parse_constant=_constant)
    except json.JSONDecodeError as bad:
        raise invalid(f"not JSON: {bad}") from bad


def dumps(value: Any, sort: bool = False) -> str:
    """Compact JSON; numbers as written or normalised, members sorted if asked."""
    if value is None or isinstance(value, (bool, str)):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, Number):
        return value.text
    if isinstance(value, Decimal):
        return plain(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return json.dumps(value)
    if isinstance(value, dict):
        items = sorted(value.items()) if sort else value.items()
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dumps(v, sort)}" for k, v in items) + "}"
    return "[" + ",".join(dumps(v, sort) for v in value) + "]"
