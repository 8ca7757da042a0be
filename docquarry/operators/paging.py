"""Pages: snapshot cursors with a byte bound, and stateless seek walks.

Both continue with a keyset predicate (rows after the last row in sort order),
so a page is a filter and a top-k, never a skip over earlier pages.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exact
from ..plans.bind import leaf
from ..plans.errors import EngineError, invalid
from ..plans.query import DEFAULT_LIMIT, QueryRequest, check_shape
from . import collection as c
from . import execute as ex

MAX_RESULT_BYTES = 8 << 20
CURSOR_TTL_MS = 60_000


@dataclass
class Page:
    rows: list[dict[str, Any]]
    cursor: str | None
    revision: int

    @property
    def more(self) -> bool:
        return self.cursor is not None


@dataclass
class Caller:
    """Whom and what a cursor is bound to."""

    principal: str = "local"
    policy_epoch: int = 0
    clock: Any = field(default=lambda: int(time.time() * 1000))


def digest(request: QueryRequest, *more: Any) -> str:
    """Of the query without its cursor."""
    plain = request.to_json()
    plain.pop("cursor", None)
    return hashlib.sha256(exact.dumps([plain, *more], sort=True).encode()).hexdigest()


def _token(content: dict) -> str:
    return exact.dumps(content, sort=True).encode().hex()


def _content(token: str) -> dict:
    try:
        return exact.loads(bytes.fromhex(token).decode())
    except ValueError as bad:
        raise invalid("the cursor is not one of ours") from bad


def _after(columns: list[tuple[Column, bool, str]], last: list[Any]) -> Column:
    """Rows after `last` in the order of columns (column, descending, type); absent values are equal to absent ones."""
    steps = []
    same = F.lit(True)
    for (column, descending, kind), value in zip(columns, last, strict=True):
        if value is None:  # sorts before all values
            beyond = F.lit(False) if descending else column.isNotNull()
            equal = column.isNull()
        else:
            at = F.lit(value).cast(kind)
            beyond = F.coalesce(column < at, F.lit(True)) if descending else F.coalesce(column > at, F.lit(False))
            equal = F.coalesce(column == at, F.lit(False))
        steps.append(same & beyond)
        same = same & equal
    return reduce(lambda x, y: x | y, steps)


def _keys(b: ex.Bound) -> tuple[DataFrame, list[tuple[str, bool]]]:
    """The sort keys of a query as columns k0, k1, ... ending with the id, and their directions."""
    named: list[tuple[Column, bool]] = []
    for s in b.request.order:
        a = b.source.access(s.path, b.request.scans)
        named += [(x, s.descending) for x in (a.tag, a.num, a.txt) if x is not None]
    if not b.request.order and b.request.text is not None:
        named.append((F.col("score"), True))
    named.append((F.col("id"), False))
    df = b.df.withColumns({f"k{i}": x for i, (x, _) in enumerate(named)})
    return df, [(f"k{i}", d) for i, (_, d) in enumerate(named)]


def page(source: c.Collection, request: QueryRequest, caller: Caller | None = None, max_bytes: int = MAX_RESULT_BYTES) -> Page:
    """One page of a row query; pass the collection at the cursor's revision for the next."""
    if request.paging_mode == "seek":
        return seek(source, request, caller)
    caller = caller or Caller()
    own = digest(request, caller.principal)
    b = ex.bound(source, request)
    if request.aggregates:
        raise invalid("an aggregate query has no pages")
    df, keys = _keys(b)
    if request.at is not None:
        held = _content(request.at)
        late = caller.clock() - int(held.get("issued", 0)) > CURSOR_TTL_MS
        if held.get("query") != own:
            raise invalid("the cursor belongs to another query or caller")
        if late or int(held["policy"]) != caller.policy_epoch or int(held["revision"]) != source.revision:
            raise EngineError("CURSOR_EXPIRED", "run the query again")
        kinds = {f.name: f.dataType.simpleString() for f in df.schema}
        df = df.where(_after([(F.col(k), d, kinds[k]) for k, d in keys], [_value(v) for v in held["last"]]))
    order = [F.col(k).desc() if d else F.col(k).asc() for k, d in keys]
    limit = request.page_limit or DEFAULT_LIMIT
    top = df.orderBy(*order).limit(limit + 1)
    body = ex.selected(request.selected) if request.selected else F.col("body")
    found = top.select("id", "version", body.alias("body"), "score", *[k for k, _ in keys]).toLocalIterator()
    rows: list[dict[str, Any]] = []
    size, last, more = 0, None, False
    for r in found:
        row = {"id": r["id"], "version": r["version"], "body": exact.loads(r["body"]), "score": r["score"]}
        n = len(exact.dumps(row).encode()) + 1
        if len(rows) == limit or (rows and size + n > max_bytes):
            more = True
            break
        if size + n > max_bytes:
            raise EngineError("RESOURCE_EXHAUSTED", "one row exceeds the result size; select fewer fields")
        size += n
        rows.append(row)
        last = [r[k] for k, _ in keys]
    cursor = None
    if more:
        shown = [str(v) if isinstance(v, (Decimal, float)) else v for v in last or []]
        cursor = _token({"query": own, "policy": caller.policy_epoch, "revision": source.revision, "issued": caller.clock(), "last": shown})
    return Page(rows, cursor, source.revision)


def _value(v: Any) -> Any:
    return int(v) if isinstance(v, Decimal) else v


# ---------------------------------------------------------------------- seek


@dataclass
class Walk:
    """A query as a walk of one unique index."""

    paths: list[str]  # the index's fields
    fixed: int
    descending: bool


def walk_of(source: c.Collection, request: QueryRequest) -> Walk:
    f = request.where
    rule = "seek paging fixes the leading fields of a unique index, may bound the next, and sorts by the rest"
    if request.text or request.aggregates or request.groups:
        raise invalid("seek paging takes no search and no aggregates")
    if f.conjuncts or f.alternatives is not None or f.negated is not None:
        raise invalid(rule)
    equal = {p for p, ops in f.fields.items() if set(ops) == {"eq"}}
    ranged = [p for p in f.fields if p not in equal]
    if len(ranged) > 1 or any(not set(f.fields[p]) <= {"gt", "gte", "lt", "lte"} for p in ranged):
        raise invalid(rule)
    for index in source.definition.indexes:
        paths = [x.path for x in index.fields]
        n = len(equal)
        if not index.unique or set(paths[:n]) != equal or (ranged and paths[n : n + 1] != ranged):
            continue
        order = [s for s in request.order]
        while order and order[0].path in equal and [s.path for s in order] != paths[n:]:
            order = order[1:]
        if [s.path for s in order] == paths[n:] and len({s.descending for s in request.order}) <= 1:
            return Walk(paths, n, bool(request.order and request.order[0].descending))
    raise EngineError("INDEX_REQUIRED", rule)


def seek_rows(source: c.Collection, request: QueryRequest, after: list[Any] | None = None, extra: int = 1) -> DataFrame:
    """The next limit + extra rows of a walk, with the typed key columns; documents missing an indexed field are left out."""
    check_shape(request)
    w = walk_of(source, request)
    access = {p: source.access(p, False) for p in w.paths}
    df = source.df
    for p in w.paths:
        df = df.where(access[p].tag > c.MISSING)
    for p, ops in request.where.fields.items():
        df = df.where(leaf(access[p], ops, filters=True))
    keys = [x for p in w.paths[w.fixed :] for x in (access[p].tag, access[p].num, access[p].txt) if x is not None]
    named = df.withColumns({f"k{i}": x for i, x in enumerate(keys)}).withColumn("score", F.lit(None).cast("double"))
    if after is not None:
        kinds = {f.name: f.dataType.simpleString() for f in named.schema}
        named = named.where(_after([(F.col(f"k{i}"), w.descending, kinds[f"k{i}"]) for i in range(len(keys))], after))
    order = [F.col(f"k{i}").desc() if w.descending else F.col(f"k{i}").asc() for i in range(len(keys))]
    return named.orderBy(*order, F.asc("id")).limit((request.page_limit or DEFAULT_LIMIT) + extra)


def seek(source: c.Collection, request: QueryRequest, caller: Caller | None = None) -> Page:
    """One page of a walk; its cursor never times out but ends with any change of data, policy or definition."""
    caller = caller or Caller()
    own = digest(request, caller.principal, caller.policy_epoch, source.revision, source.definition.to_json())
    after = None
    if request.at is not None:
        held = _content(request.at)
        if held.get("query") != own:
            raise EngineError("CURSOR_EXPIRED", "the collection, its definition or the policy has changed, or the query is another")
        after = [_value(v) for v in held["after"]]
    limit = request.page_limit or DEFAULT_LIMIT
    df = seek_rows(source, request, after)
    keys = [f.name for f in df.schema if f.name.startswith("k") and f.name[1:].isdigit()]
    body = ex.selected(request.selected) if request.selected else F.col("body")
    found = df.select("id", "version", body.alias("body"), "score", *keys).collect()
    rows = [{"id": r["id"], "version": r["version"], "body": exact.loads(r["body"]), "score": None} for r in found[:limit]]
    cursor = None
    if len(found) > limit:
        last = found[limit - 1]
        cursor = _token({"query": own, "after": [str(last[k]) if isinstance(last[k], Decimal) else last[k] for k in keys]})
    return Page(rows, cursor, source.revision)


def query_all(source: c.Collection, request: QueryRequest, caller: Caller | None = None) -> Iterator[dict[str, Any]]:
    """All rows, following cursors."""
    while True:
        got = page(source, request, caller)
        yield from got.rows
        if got.cursor is None:
            return
        request = request.cursor(got.cursor)
