"""Query requests: a fluent builder and a strict JSON form of the same thing."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field
from typing import Any

from ..functions import exact, pointer
from .errors import invalid

# The closed vocabulary and limits of the query language.
OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "nin", "exists", "contains")
COMBINATORS = ("and", "or", "not")
FUNCTIONS = ("count", "sum", "min", "max", "avg")
MODES = ("terms", "phrase", "prefix", "fuzzy")
MEMBERS = ("collection", "filter", "search", "sort", "select", "group_by", "aggregate", "limit", "cursor", "paging", "allow_scan")
MAX_IN, MAX_DEPTH, MAX_NODES = 256, 16, 256
MAX_SORT, MAX_SELECT, MAX_AGGREGATES, MAX_GROUP_BY, MAX_SCALE = 8, 64, 16, 8, 1000
DEFAULT_LIMIT, MAX_PAGE = 100, 1000
#: Operators that bound the same side; a field takes one of each.
_SIDES = {"gt": ("gt", "gte"), "gte": ("gt", "gte"), "lt": ("lt", "lte"), "lte": ("lt", "lte")}


@dataclass
class Filter:
    """Conditions that must all hold. Empty: everything."""

    fields: dict[str, dict[str, Any]] = field(default_factory=dict)
    conjuncts: list[Filter] = field(default_factory=list)
    alternatives: list[Filter] | None = None
    negated: Filter | None = None

    # -- building: each step returns a new filter

    def _with(self, path: str, op: str, value: Any) -> Filter:
        out = copy.deepcopy(self)
        own = out.fields.setdefault(path, {})
        if any(o in own for o in _SIDES.get(op, (op,))):
            out.conjuncts.append(Filter({path: {op: value}}))
        else:
            own[op] = value
        return out

    def eq(self, path: str, value: Any) -> Filter:
        return self._with(path, "eq", value)

    def ne(self, path: str, value: Any) -> Filter:
        return self._with(path, "ne", value)

    def gt(self, path: str, value: Any) -> Filter:
        return self._with(path, "gt", value)

    def gte(self, path: str, value: Any) -> Filter:
        return self._with(path, "gte", value)

    def lt(self, path: str, value: Any) -> Filter:
        return self._with(path, "lt", value)

    def lte(self, path: str, value: Any) -> Filter:
        return self._with(path, "lte", value)

    def is_in(self, path: str, values: list) -> Filter:
        return self._with(path, "in", list(values))

    def not_in(self, path: str, values: list) -> Filter:
        return self._with(path, "nin", list(values))

    def exists(self, path: str) -> Filter:
        return self._with(path, "exists", True)

    def missing(self, path: str) -> Filter:
        return self._with(path, "exists", False)

    def contains(self, path: str, value: Any) -> Filter:
        return self._with(path, "contains", value)

    def is_all(self) -> bool:
        return not self.fields and not self.conjuncts and self.alternatives is None and self.negated is None

    def and_(self, other: Filter) -> Filter:
        """Both; conditions merge where neither side's meaning changes."""
        out = copy.deepcopy(self)
        rest = copy.deepcopy(other)
        for path, ops in rest.fields.items():
            for op, value in ops.items():
                out = out._with(path, op, value)
        out.conjuncts += rest.conjuncts
        if rest.alternatives is not None:
            if out.alternatives is None:
                out.alternatives = rest.alternatives
            else:
                out.conjuncts.append(Filter(alternatives=rest.alternatives))
        if rest.negated is not None:
            if out.negated is None:
                out.negated = rest.negated
            else:
                out.conjuncts.append(Filter(negated=rest.negated))
        return out

    __and__ = and_

    def __invert__(self) -> Filter:
        return Filter(negated=copy.deepcopy(self))

    @staticmethod
    def or_(filters: list[Filter]) -> Filter:
        """At least one; of none, nothing matches."""
        filters = list(filters)
        return Filter(alternatives=filters) if filters else Filter(negated=Filter())

    def __or__(self, other: Filter) -> Filter:
        return Filter.or_([self, other])

    # -- JSON

    def to_json(self) -> dict:
        out: dict[str, Any] = {}
        for path, ops in sorted(self.fields.items()):
            only = ops.get("eq")
            out[path] = only if set(ops) == {"eq"} and not isinstance(only, (dict, list)) else {o: ops[o] for o in OPERATORS if o in ops}
        if self.conjuncts:
            out["and"] = [f.to_json() for f in self.conjuncts]
        if self.alternatives is not None:
            out["or"] = [f.to_json() for f in self.alternatives]
        if self.negated is not None:
            out["not"] = self.negated.to_json()
        return out

    @staticmethod
    def from_json(value: Any) -> Filter:
        if not isinstance(value, dict):
            raise invalid("a filter must be an object")
        out = Filter()
        for name, entry in value.items():
            if name.startswith("/"):
                pointer.tokens(name)
                out.fields[name] = _condition(name, entry)
            elif name in ("and", "or"):
                if not isinstance(entry, list) or not entry:
                    raise invalid(f"`{name}` needs a list with at least one filter")
                made = [Filter.from_json(f) for f in entry]
                if name == "and":
                    out.conjuncts = made
                else:
                    out.alternatives = made
            elif name == "not":
                out.negated = Filter.from_json(entry)
            elif name.startswith("$"):
                raise invalid(f"write `{name[1:]}` without `$`")
            elif name in OPERATORS:
                raise invalid(f"`{name}` belongs inside a field condition, as in {{\"/field\": {{\"{name}\": ...}}}}")
            else:
                raise invalid(f"unknown filter member `{name}`; a field is written `/{name}`")
        return out


def _condition(path: str, entry: Any) -> dict[str, Any]:
    if isinstance(entry, list):
        raise invalid(f"the condition of `{path}` cannot be an array; use {{\"eq\": ...}} or {{\"in\": [...]}}")
    if not isinstance(entry, dict):
        return {"eq": entry}
    if not entry:
        raise invalid(f"the condition of `{path}` needs at least one operator")
    for op, value in entry.items():
        if op not in OPERATORS:
            raise invalid(f"unknown filter operator `{op}`; use one of {', '.join(OPERATORS)}" + (f" (write `{op[1:]}` without `$`)" if op.startswith("$") else ""))
        if op in ("in", "nin") and not isinstance(value, list):
            raise invalid(f"`{op}` requires an array")
        if op == "exists" and not isinstance(value, bool):
            raise invalid(f"`exists` on `{path}` takes true or false only")
    return dict(entry)


@dataclass
class Sort:
    path: str
    descending: bool = False

    @staticmethod
    def from_json(text: Any) -> Sort:
        if not isinstance(text, str) or not text.removeprefix("-").startswith("/"):
            raise invalid(f"a sort key is a path such as `/amount` or `-/amount`, not `{text}`")
        pointer.tokens(text.removeprefix("-"))
        return Sort(text.removeprefix("-"), text.startswith("-"))

    def to_json(self) -> str:
        return "-" * self.descending + self.path


@dataclass
class Aggregation:
    function: str
    path: str | None = None  # None: count of documents
    scale: int | None = None

    @staticmethod
    def count() -> Aggregation:
        return Aggregation("count")

    @staticmethod
    def count_of(path: str) -> Aggregation:
        return Aggregation("count", path)

    @staticmethod
    def sum(path: str) -> Aggregation:
        return Aggregation("sum", path)

    @staticmethod
    def min(path: str) -> Aggregation:
        return Aggregation("min", path)

    @staticmethod
    def max(path: str) -> Aggregation:
        return Aggregation("max", path)

    @staticmethod
    def avg(path: str, scale: int) -> Aggregation:
        return Aggregation("avg", path, scale)

    def to_json(self) -> dict:
        out: dict[str, Any] = {self.function: self.path or "*"}
        if self.scale is not None:
            out["scale"] = self.scale
        return out

    @staticmethod
    def from_json(value: Any) -> Aggregation:
        if not isinstance(value, dict):
            raise invalid('an aggregate is an object such as {"sum": "/amount"}')
        names = [n for n in value if n != "scale"]
        if len(names) != 1 or names[0] not in FUNCTIONS:
            raise invalid(f"an aggregate has exactly one of {', '.join(FUNCTIONS)}")
        name, path = names[0], value[names[0]]
        if path == "*" and name == "count":
            path = None
        else:
            pointer.tokens(path)
        scale = value.get("scale")
        if scale is not None:
            scale = _whole(scale, "scale")
        return Aggregation(name, path, scale)


@dataclass
class TextSearch:
    index: str
    query: str
    mode: str = "terms"
    distance: int | None = None

    def phrase(self) -> TextSearch:
        return TextSearch(self.index, self.query, "phrase")

    def prefix(self) -> TextSearch:
        return TextSearch(self.index, self.query, "prefix")

    def fuzzy(self, distance: int | None = None) -> TextSearch:
        return TextSearch(self.index, self.query, "fuzzy", distance)

    @property
    def fuzzy_distance(self) -> int:
        return 1 if self.distance is None else self.distance

    def to_json(self) -> dict:
        out: dict[str, Any] = {"index": self.index, "query": self.query}
        if self.mode != "terms":
            out["mode"] = self.mode
        if self.distance is not None:
            out["distance"] = self.distance
        return out

    @staticmethod
    def from_json(value: Any) -> TextSearch:
        _only(value, ("index", "query", "mode", "distance"), "search")
        if not isinstance(value.get("index"), str) or not isinstance(value.get("query"), str):
            raise invalid("search needs `index` and `query`")
        if value.get("mode", "terms") not in MODES:
            raise invalid(f"`mode` is one of {', '.join(MODES)}")
        distance = value.get("distance")
        return TextSearch(value["index"], value["query"], value.get("mode", "terms"), None if distance is None else _whole(distance, "distance"))


def _whole(value: Any, what: str) -> int:
    text = value.text if isinstance(value, exact.Number) else str(value)
    if isinstance(value, bool) or not text.isascii() or not text.isdigit():
        raise invalid(f"`{what}` must be a whole number")
    return int(text)


def _only(value: Any, known: tuple[str, ...], what: str) -> None:
    if not isinstance(value, dict):
        raise invalid(f"{what} must be an object")
    for name in value:
        if name not in known:
            raise invalid(f"unknown member `{name}` of {what}; known are {', '.join(known)}")


@dataclass
class QueryRequest:
    collection: str
    where: Filter = field(default_factory=Filter)
    text: TextSearch | None = None
    order: list[Sort] = field(default_factory=list)
    selected: list[str] = field(default_factory=list)
    groups: list[str] = field(default_factory=list)
    aggregates: dict[str, Aggregation] = field(default_factory=dict)
    page_limit: int | None = None
    at: str | None = None
    paging_mode: str = "snapshot"
    scans: bool = False

    def _set(self, **changes: Any) -> QueryRequest:
        out = copy.deepcopy(self)
        for name, value in changes.items():
            setattr(out, name, value)
        return out

    def filter(self, where: Filter) -> QueryRequest:
        return self._set(where=self.where & where)

    def search(self, text: TextSearch) -> QueryRequest:
        return self._set(text=text)

    def sort_asc(self, path: str) -> QueryRequest:
        return self._set(order=[*self.order, Sort(path)])

    def sort_desc(self, path: str) -> QueryRequest:
        return self._set(order=[*self.order, Sort(path, True)])

    def select(self, paths: list[str]) -> QueryRequest:
        return self._set(selected=list(paths))

    def group_by(self, paths: list[str]) -> QueryRequest:
        return self._set(groups=list(paths))

    def aggregate(self, alias: str, what: Aggregation) -> QueryRequest:
        return self._set(aggregates=self.aggregates | {alias: what})

    def limit(self, n: int) -> QueryRequest:
        return self._set(page_limit=n)

    def cursor(self, token: str) -> QueryRequest:
        return self._set(at=token)

    def paging(self, mode: str) -> QueryRequest:
        return self._set(paging_mode=mode)

    def allow_scan(self, allowed: bool = True) -> QueryRequest:
        return self._set(scans=allowed)

    def to_json(self) -> dict:
        out: dict[str, Any] = {"collection": self.collection}
        if not self.where.is_all():
            out["filter"] = self.where.to_json()
        if self.text:
            out["search"] = self.text.to_json()
        if self.order:
            out["sort"] = [s.to_json() for s in self.order]
        if self.selected:
            out["select"] = self.selected
        if self.groups:
            out["group_by"] = self.groups
        if self.aggregates:
            out["aggregate"] = {a: g.to_json() for a, g in sorted(self.aggregates.items())}
        if self.page_limit is not None:
            out["limit"] = self.page_limit
        if self.at is not None:
            out["cursor"] = self.at
        if self.paging_mode != "snapshot":
            out["paging"] = self.paging_mode
        if self.scans:
            out["allow_scan"] = True
        return out

    def encode(self) -> str:
        return exact.dumps(self.to_json())

    @staticmethod
    def decode(text: str) -> QueryRequest:
        return QueryRequest.from_json(exact.loads(text))

    @staticmethod
    def from_json(value: Any) -> QueryRequest:
        _only(value, MEMBERS, "a query")
        if not isinstance(value.get("collection"), str):
            raise invalid("a query needs `collection`")
        out = QueryRequest(value["collection"])
        if "filter" in value:
            out.where = Filter.from_json(value["filter"])
        if value.get("search") is not None:
            out.text = TextSearch.from_json(value["search"])
        for name in ("sort", "select", "group_by"):
            if not isinstance(value.get(name, []), list):
                raise invalid(f"`{name}` must be a list")
        out.order = [Sort.from_json(s) for s in value.get("sort", [])]
        out.selected = list(value.get("select", []))
        out.groups = list(value.get("group_by", []))
        for path in out.selected + out.groups:
            pointer.tokens(path)
        if not isinstance(value.get("aggregate", {}), dict):
            raise invalid("`aggregate` must be an object of named aggregates")
        out.aggregates = {a: Aggregation.from_json(g) for a, g in value.get("aggregate", {}).items()}
        if value.get("limit") is not None:
            out.page_limit = _whole(value["limit"], "limit")
        if value.get("cursor") is not None:
            if not isinstance(value["cursor"], str):
                raise invalid("`cursor` must be a string")
            out.at = value["cursor"]
        if value.get("paging", "snapshot") not in ("snapshot", "seek"):
            raise invalid("`paging` is snapshot or seek")
        out.paging_mode = value.get("paging", "snapshot")
        if not isinstance(value.get("allow_scan", False), bool):
            raise invalid("`allow_scan` must be true or false")
        out.scans = value.get("allow_scan", False)
        return out


def check_shape(request: QueryRequest, max_page: int = MAX_PAGE) -> None:
    """Limits that need no definition."""
    for what, n, most in (("sort", len(request.order), MAX_SORT), ("select", len(request.selected), MAX_SELECT), ("aggregate", len(request.aggregates), MAX_AGGREGATES), ("group_by", len(request.groups), MAX_GROUP_BY)):
        if n > most:
            raise invalid(f"`{what}` has at most {most} entries")
    if request.aggregates and (request.order or request.selected or request.page_limit is not None or request.at is not None):
        raise invalid("`sort`, `select`, `limit` and `cursor` do not apply to aggregates")
    if request.groups and not request.aggregates:
        raise invalid("`group_by` needs `aggregate`")
    if request.page_limit is not None and not 1 <= request.page_limit <= max_page:
        raise invalid(f"`limit` is from 1 to {max_page}")
    if request.text and request.text.distance is not None and request.text.mode != "fuzzy":
        raise invalid("`distance` applies to fuzzy search only")
    if request.text and not 0 <= request.text.fuzzy_distance <= 2:
        raise invalid("`distance` is from 0 to 2")
    nodes = 0

    def walk(f: Filter, depth: int) -> None:
        nonlocal nodes
        nodes += 1 + len(f.fields)
        if depth > MAX_DEPTH:
            raise invalid(f"filters nest at most {MAX_DEPTH} levels")
        if nodes > MAX_NODES:
            raise invalid(f"a filter has at most {MAX_NODES} conditions")
        for path, ops in f.fields.items():
            for side in (("gt", "gte"), ("lt", "lte")):
                if all(o in ops for o in side):
                    raise invalid(f"`{path}` takes either `{side[0]}` or `{side[1]}`")
            for op in ("in", "nin"):
                if len(ops.get(op, ())) > MAX_IN:
                    raise invalid(f"`{op}` takes at most {MAX_IN} values")
        for inner in [*f.conjuncts, *(f.alternatives or []), *([f.negated] if f.negated else [])]:
            walk(inner, depth + 1)

    walk(request.where, 1)
    for a in request.aggregates.values():
        if (a.function == "avg") != (a.scale is not None):
            raise invalid("`scale` is required by `avg` and applies to nothing else")
        if a.scale is not None and a.scale > MAX_SCALE:
            raise invalid(f"`scale` is from 0 to {MAX_SCALE}")
    parts = sorted(pointer.tokens(p) for p in request.selected)
    for x, y in zip(parts, parts[1:], strict=False):
        if y[: len(x)] == x:
            raise invalid("`select` paths may not repeat or contain one another")
