"""Filters bound to columns: type checks first, then two-valued predicates."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import exact
from ..operators import collection as c
from .errors import invalid
from .query import Filter

Lookup = Callable[[str], c.Access]
Wrap = Callable[[Column], Column]


def _true(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def scalar(a: c.Access, value: Any) -> tuple[int, Any]:
    """Tag and value of a literal, checked against the field's type."""
    if value is None:
        return c.NULL, None
    if isinstance(value, (dict, list)):
        raise invalid(f"`{a.path}` compares with a scalar, not an object or array")
    kind = {"string_array": "string", "number_array": "number"}.get(a.kind, a.kind)
    if isinstance(value, bool):
        if kind not in ("boolean", "any"):
            raise invalid(f"`{a.path}` is a {kind}, not a boolean")
        return (c.TRUE if value else c.FALSE), None
    if isinstance(value, str):
        if kind == "decimal":
            return c.NUMBER, exact.number(value)
        if kind not in ("string", "any"):
            raise invalid(f"`{a.path}` is a {kind}, not a string")
        return c.STRING, value
    if kind not in ("number", "any"):
        raise invalid(f"`{a.path}` is a {kind}" + (", written as a string" if kind == "decimal" else ", not a number"))
    return c.NUMBER, exact.number(value)


def _grid(value: Decimal, a: c.Access, rounding: str) -> Decimal:
    return value.quantize(Decimal(1).scaleb(-a.scale), rounding=rounding, context=exact.CONTEXT)


def _beyond(value: Decimal, a: c.Access) -> int:
    """-1, 0 or 1: below, within or above what the column can hold."""
    limit = Decimal(10) ** (38 - a.scale)
    return (value >= limit) - (value <= -limit)


def _number(a: c.Access, op: str, value: Decimal) -> Column:
    """a.num op value, exactly, though the column holds a grid of values only."""
    if a.wide:
        key = F.lit(exact.key_of(value))
        return {"eq": a.num == key, "gt": a.num > key, "gte": a.num >= key, "lt": a.num < key, "lte": a.num <= key}[op]
    if out := _beyond(value, a):
        return F.lit(op != "eq" and (op in ("lt", "lte")) == (out > 0))
    low, high = _grid(value, a, ROUND_FLOOR), _grid(value, a, ROUND_CEILING)
    if op == "eq":
        return a.num == c.literal(value, a.scale) if low == high else F.lit(False)
    bound = {"gt": low, "lte": low, "gte": high, "lt": high}[op]
    if _beyond(bound, a):
        return F.lit(op in ("lt", "lte"))
    at = c.literal(bound, a.scale)
    return {"gt": a.num > at, "gte": a.num >= at, "lt": a.num < at, "lte": a.num <= at}[op]


def _equals(a: c.Access, value: Any, true: Wrap = _true) -> Column:
    tag, v = scalar(a, value)
    if a.is_array and tag != c.NULL:
        raise invalid(f"`{a.path}` is an array; use `contains`")
    if tag in (c.NULL, c.FALSE, c.TRUE):
        return a.tag == tag
    return true((a.tag == tag) & (_number(a, "eq", v) if tag == c.NUMBER else a.txt == v))


def _among(a: c.Access, values: list, true: Wrap = _true) -> Column:
    found = [scalar(a, v) for v in values]
    if a.is_array and any(t != c.NULL for t, _ in found):
        raise invalid(f"`{a.path}` is an array; use `contains`")
    parts = [a.tag == t for t in sorted({t for t, _ in found if t <= c.TRUE})]
    texts = sorted({v for t, v in found if t == c.STRING})
    if texts:
        parts.append(true((a.tag == c.STRING) & a.txt.isin(texts)))
    numbers = sorted({v for t, v in found if t == c.NUMBER})
    if numbers and a.wide:
        parts.append(true((a.tag == c.NUMBER) & a.num.isin([exact.key_of(v) for v in numbers])))
    elif numbers:
        held = [c.literal(v, a.scale) for v in numbers if not _beyond(v, a) and _grid(v, a, ROUND_FLOOR) == v]
        if held:
            parts.append(true((a.tag == c.NUMBER) & a.num.isin(held)))
    return reduce(lambda x, y: x | y, parts) if parts else F.lit(False)


def _range(a: c.Access, bounds: dict[str, Any], true: Wrap = _true) -> Column:
    if a.is_array:
        raise invalid(f"`{a.path}` is an array; use `contains`")
    found = {op: scalar(a, v) for op, v in bounds.items()}
    kinds = {"boolean" if t in (c.FALSE, c.TRUE) else t for t, _ in found.values()}
    if c.NULL in kinds or len(kinds) > 1:
        raise invalid(f"a range of `{a.path}` needs bounds of one type, and not null")
    parts = []
    for op, (tag, v) in found.items():
        if tag in (c.FALSE, c.TRUE):
            parts.append({"gt": a.tag > tag, "gte": a.tag >= tag, "lt": a.tag < tag, "lte": a.tag <= tag}[op] & a.tag.isin(c.FALSE, c.TRUE))
        elif tag == c.NUMBER:
            parts.append((a.tag == c.NUMBER) & _number(a, op, v))
        else:
            parts.append((a.tag == c.STRING) & {"gt": a.txt > v, "gte": a.txt >= v, "lt": a.txt < v, "lte": a.txt <= v}[op])
    return true(reduce(lambda x, y: x & y, parts))


def _contains(a: c.Access, value: Any, true: Wrap = _true) -> Column:
    if not a.is_array and a.kind != "any":
        raise invalid(f"`contains` needs an array; `{a.path}` is a {a.kind}")
    tag, v = scalar(a, value)
    if tag == c.NULL:
        raise invalid("`contains` takes a value that is not null")
    if a.kind == "any":
        same = lambda item: _equals(c.Access(a.path, "any", c.kind_of(item), F.when(c.kind_of(item) == c.NUMBER, c.scan_number(item)), F.when(c.kind_of(item) == c.STRING, F.try_variant_get(item, "$", "string")), scale=c.SCAN_SCALE), value)
        return true((a.tag == c.ARRAY) & F.exists(a.arr, same))
    if tag == c.NUMBER:
        if _beyond(v, a) or _grid(v, a, ROUND_FLOOR) != v:
            return F.lit(False)
        return true(F.array_contains(a.arr, c.literal(v, a.scale)))
    return true(F.array_contains(a.arr, F.lit(v)))


def leaf(a: c.Access, ops: dict[str, Any], filters: bool = False) -> Column:
    """Conditions on one path.

    With `filters` the result may be null for false, which a WHERE clause does
    not tell apart: plain comparisons are then left bare and reach the scan.
    """
    true: Wrap = (lambda p: p) if filters else _true
    parts = []
    for op, value in ops.items():
        if op == "eq":
            parts.append(_equals(a, value, true))
        elif op == "ne":
            parts.append(~_equals(a, value))
        elif op == "in":
            parts.append(_among(a, value, true))
        elif op == "nin":
            parts.append(~_among(a, value))
        elif op == "exists":
            parts.append(a.tag > c.MISSING if value else a.tag == c.MISSING)
        elif op == "contains":
            parts.append(_contains(a, value, true))
    bounds = {op: ops[op] for op in ("gt", "gte", "lt", "lte") if op in ops}
    if bounds:
        parts.append(_range(a, bounds, true))
    return reduce(lambda x, y: x & y, parts)


def predicate(where: Filter, lookup: Lookup, filters: bool = False) -> Column:
    """The filter as one column that is never null; with `filters` null may stand for false."""
    parts = [leaf(lookup(path), ops, filters) for path, ops in where.fields.items()]
    parts += [predicate(f, lookup, filters) for f in where.conjuncts]
    if where.alternatives is not None:
        parts.append(reduce(lambda x, y: x | y, [predicate(f, lookup, filters) for f in where.alternatives]))
    if where.negated is not None:
        parts.append(F.lit(False) if where.negated.is_all() else ~predicate(where.negated, lookup))
    return reduce(lambda x, y: x & y, parts) if parts else F.lit(True)


def order_columns(a: c.Access, descending: bool) -> list[Column]:
    """Sort columns of a path: absent, null, booleans, numbers, strings."""
    if a.is_array:
        raise invalid(f"`{a.path}` is an array and cannot be a sort or group key")
    tag = a.tag
    if a.kind == "any":
        bad = F.raise_error(F.lit(f"`{a.path}` holds an object or array and cannot be a sort or group key")).cast("tinyint")
        tag = F.when(a.tag >= c.ARRAY, bad).otherwise(a.tag)
    columns = [tag, *[x for x in (a.num, a.txt) if x is not None]]
    return [x.desc() for x in columns] if descending else [x.asc() for x in columns]
