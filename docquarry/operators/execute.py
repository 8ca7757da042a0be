"""Bound queries as DataFrames: rows, groups, and their JSON envelopes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from decimal import Decimal
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import exact, pointer
from ..plans import bind
from ..plans.errors import EngineError, invalid
from ..plans.query import DEFAULT_LIMIT, Aggregation, Filter, QueryRequest, check_shape
from . import collection as c

MAX_GROUPS = 10_000
MAX_GROUP_BYTES = 8 << 20


@dataclass
class Bound:
    """A checked query over one collection."""

    request: QueryRequest
    source: c.Collection
    df: DataFrame  # matching documents, with `score`


def bound(source: c.Collection, request: QueryRequest) -> Bound:
    """Checks everything that needs no data, then plans; only a search, or a budget of candidates, runs jobs."""
    max_candidates = source.max_candidates
    check_shape(request)
    undeclared = sorted(p for p in _paths(request) if p not in source.definition.fields) if request.scans else []
    early, late = request.where, Filter()
    if undeclared:
        # conditions on declared paths stay below the parsing of bodies
        early = Filter({p: ops for p, ops in request.where.fields.items() if p not in undeclared})
        late = replace(request.where, fields={p: ops for p, ops in request.where.fields.items() if p in undeclared})
        first = bind.predicate(early, lambda path: source.access(path, False), filters=True)
        narrowed = c.Collection(source.definition, source.df.where(first), source.revision, source.texts, source.archived)
        scanned, kept = c.with_scans(narrowed, undeclared)
    else:
        scanned, kept = source, None
    lookup = lambda path: scanned.access(path, request.scans)
    where = bind.predicate(late if undeclared else early, lookup, filters=True)
    for s in request.order:
        bind.order_columns(lookup(s.path), s.descending)
    for path in request.groups:
        bind.order_columns(lookup(path), False)
    for alias, a in request.aggregates.items():
        _check(alias, a, lookup)
    df = scanned.df
    if request.text is not None:
        from .search import matches

        if source.archived:
            raise EngineError("INDEX_REQUIRED", "archived documents are not in text indexes")
        df = df.join(matches(source, request.text, max_candidates), "id")
    else:
        df = df.withColumn("score", F.lit(None).cast("double"))
    if kept is not None:
        where = where & kept
    elif request.where.is_all():
        if max_candidates is not None and request.text is not None:
            within_budget(df, max_candidates)
        return Bound(request, scanned, df)
    df = df.where(where)
    return Bound(request, scanned, df if max_candidates is None else within_budget(df, max_candidates))


def _paths(request: QueryRequest) -> set[str]:
    """All paths that a query filters, sorts, groups or aggregates by."""

    def of(f: Filter) -> set[str]:
        return set(f.fields).union(*map(of, [*f.conjuncts, *(f.alternatives or []), *([f.negated] if f.negated else [])]))

    return of(request.where) | {s.path for s in request.order} | set(request.groups) | {a.path for a in request.aggregates.values() if a.path}


def _check(alias: str, a: Aggregation, lookup: bind.Lookup) -> None:
    from ..plans.definition import check_name

    check_name(alias, "aggregate")
    if a.path is None:
        return
    access = lookup(a.path)
    if a.function != "count" and access.kind not in ("number", "decimal", "any"):
        raise invalid(f"`{a.function}` needs a numeric field; `{a.path}` is a {access.kind}")


# ---------------------------------------------------------------------- rows


def ordering(b: Bound) -> list[Column]:
    """Sort columns of the query, ending with the id."""
    out: list[Column] = []
    for s in b.request.order:
        out += bind.order_columns(b.source.access(s.path, b.request.scans), s.descending)
    if not b.request.order and b.request.text is not None:
        out.append(F.desc("score"))
    return [*out, F.asc("id")]


def selected(paths: list[str]) -> Column:
    """Body text with the listed members only, nested as they were; through arrays nothing is found."""
    tree: dict = {}
    for path in paths:
        parts = pointer.tokens(path)
        at = tree
        for p in parts[:-1]:
            at = at.setdefault(p, {})
        at[parts[-1]] = parts
    body = F.try_parse_json(F.col("body"))

    def text(node: dict) -> Column:
        members = []
        for name, inner in sorted(node.items()):
            key = F.lit(exact.dumps(name) + ":")
            if isinstance(inner, dict):
                part = text(inner)
                members.append(F.when(part != "", F.concat(key, F.lit("{"), part, F.lit("}"))))
            else:
                v = F.try_variant_get(body, pointer.variant_path(inner), "variant")
                members.append(F.concat(key, F.when(F.is_variant_null(v), "null").otherwise(F.to_json(v))))
        return F.concat_ws(",", *members)

    return F.concat(F.lit("{"), text(tree), F.lit("}"))


def rows(source: c.Collection, request: QueryRequest) -> DataFrame:
    """(id, version, body, score), ordered and limited; ordering and limit become one top-k."""
    if request.aggregates:
        raise invalid("an aggregate query has groups, not rows")
    b = bound(source, request)
    df = b.df.orderBy(*ordering(b)).limit(request.page_limit or DEFAULT_LIMIT)
    return projected(df, request)


def projected(df: DataFrame, request: QueryRequest) -> DataFrame:
    body = selected(request.selected) if request.selected else F.col("body")
    return df.select("id", "version", body.alias("body"), "score")


def all_rows(source: c.Collection, request: QueryRequest) -> DataFrame:
    """All matching documents with their typed columns, in no order."""
    return bound(source, request).df


def ids(source: c.Collection, request: QueryRequest) -> DataFrame:
    """Ids only; no body is read."""
    return bound(source, request).df.select("id")


def ids_after(source: c.Collection, after: str | None, limit: int) -> DataFrame:
    """The next ids in order."""
    if not 1 <= limit <= 1001:
        raise invalid("`limit` is from 1 to 1001")
    df = source.df.select("id")
    return (df if after is None else df.where(F.col("id") > after)).orderBy("id").limit(limit)


def get(source: c.Collection, id: str) -> DataFrame:
    """A document by id; the equality reaches the scan."""
    return source.df.where(F.col("id") == id).select("id", "version", "body")


def decoded(df: DataFrame, ddl: str) -> DataFrame:
    """Rows with their bodies as typed columns under `doc`; absent members are null."""
    return df.select("id", "version", F.from_json("body", ddl).alias("doc"), *[c for c in ("score",) if c in df.columns])


def within_budget(df: DataFrame, candidates: int) -> DataFrame:
    """df, if it has at most so many rows: a budget fails, it never shortens an answer. Counts one row more at most."""
    if df.select(F.lit(1)).limit(candidates + 1).count() > candidates:
        raise EngineError("RESOURCE_EXHAUSTED", f"the query has more than {candidates} candidates")
    return df


def envelopes(df: DataFrame) -> Iterator[dict[str, Any]]:
    for r in df.toLocalIterator():
        yield {"id": r["id"], "version": r["version"], "body": exact.loads(r["body"]), "score": r["score"]}


# ---------------------------------------------------------------- aggregates


def _half_even(total: Column, count: Column, s: int, scale: int) -> Column:
    """total (DECIMAL(38, s)) / count at `scale` places, half-even, rounded once.

    Quotient and remainder of whole numbers; division only of exact multiples.
    """
    whole = "decimal(38,0)"
    n = (total * F.lit(10**s).cast("decimal(38,0)") if s else total).cast(whole)
    d = count.cast(whole)
    if scale >= s:
        n = (n * F.lit(Decimal(10 ** (scale - s)))).cast(whole)
    else:
        d = (d * F.lit(Decimal(10 ** (s - scale)))).cast(whole)
    r = n % d
    q = ((n - r) / d).cast(whole)
    twice = F.abs(r) * 2
    away = (twice > d) | ((twice == d) & (F.abs(q) % 2 == 1))
    q = q + F.when(away, F.signum(n).cast("int")).otherwise(0)
    return (q.cast(whole) / F.lit(Decimal(10**scale)).cast("decimal(38,0)")).cast(f"decimal(38,{min(scale, 18)})") if scale else q.cast(whole)


#: Rows whose wide numbers are added in one go.
FOLD_ROWS = 16


@F.pandas_udf(StringType())
def _fold(texts: pd.Series) -> str:
    """Exact sum of decimal texts."""
    total = Decimal(0)
    for t in texts:
        if t is not None:
            total = exact.CONTEXT.add(total, Decimal(t))
    return exact.plain(total)


def _wide_sums(df: DataFrame, keys: list[Column], names: list[str], texts: dict[str, Column]) -> DataFrame:
    """Exact sums of wide numbers by group, in two steps: no step sees more than 2**FOLD_ROWS rows, or partial sums, of a partition."""
    salt = F.shiftright(F.monotonically_increasing_id(), FOLD_ROWS).alias("salt")
    parts = df.select(*keys, salt, *[t.alias(a) for a, t in texts.items()]).groupBy(*names, "salt").agg(*[_fold(F.col(a)).alias(a) for a in texts])
    return parts.groupBy(*names).agg(*[_fold(F.col(a)).alias(a) for a in texts])


def groups(source: c.Collection, request: QueryRequest, max_groups: int | None = MAX_GROUPS) -> DataFrame:
    """One row per group, in group order: for each group path `<path>#tag` and `<path>`; for each aggregate its alias.

    Numbers are DECIMAL, or text where the field is wide or an average has too
    many places.  More than max_groups groups are an error, not a short answer.
    """
    if not request.aggregates:
        raise invalid("a query without `aggregate` has rows, not groups")
    b = bound(source, request)
    lookup = lambda path: b.source.access(path, request.scans)
    keys: list[Column] = []
    shown: list[Column] = []
    order: list[Column] = []
    key_names: list[str] = []
    for i, path in enumerate(request.groups):
        a = lookup(path)
        tag, *rest = bind.order_columns(a, False)
        names = [f"g{i}t", *[f"g{i}v{j}" for j in range(len(rest))]]
        sources = [F.when(a.tag >= c.ARRAY, F.raise_error(F.lit(f"`{path}` holds an object or array")).cast("tinyint")).otherwise(a.tag) if a.kind == "any" else a.tag]
        sources += [x for x in (a.num, a.txt) if x is not None]
        keys += [x.alias(n) for x, n in zip(sources, names, strict=True)]
        order += [F.asc(n) for n in names]
        shown.append(F.col(names[0]).alias(f"{path}#tag"))
        key_names += names
        if a.wide:
            keys.append(a.wide_text.alias(f"g{i}w"))
            key_names.append(f"g{i}w")
            value = F.col(f"g{i}w")
        elif a.kind == "any":
            value = F.coalesce(F.col(f"g{i}v1"), F.rtrim(F.rtrim(F.col(f"g{i}v0").cast("string"), F.lit("0")), F.lit(".")), F.when(F.col(names[0]) == c.TRUE, "true").when(F.col(names[0]) == c.FALSE, "false"))
        elif a.kind == "boolean":
            value = F.when(F.col(names[0]) > c.NULL, F.col(names[0]) == c.TRUE)
        else:
            value = F.col(names[1])
        shown.append(value.alias(path))
    sums: list[Column] = []
    late: list[tuple[str, int]] = []
    wide: dict[str, Column] = {}
    for j, (alias, a) in enumerate(request.aggregates.items()):
        if a.path is None:
            sums.append(F.count(F.lit(1)).alias(f"a{j}"))
            shown.append(F.col(f"a{j}").alias(alias))
            continue
        x = lookup(a.path)
        if a.function == "count":
            sums.append(F.coalesce(F.sum(F.when(x.tag > c.NULL, 1).otherwise(0)), F.lit(0)).alias(f"a{j}"))
            shown.append(F.col(f"a{j}").alias(alias))
            continue
        bad = F.raise_error(F.lit(f"`{a.path}` holds a value that is not a number"))
        if x.wide:
            n = F.when(x.tag == c.NUMBER, 1)
            ranked = F.struct(x.num.alias("key"), x.wide_text.alias("text"))
            if a.function in ("min", "max"):
                total = {"min": F.min, "max": F.max}[a.function](F.when(x.tag == c.NUMBER, ranked))["text"]
            else:
                wide[f"a{j}"] = x.wide_text
                total = None
        else:
            value = x.num
            if x.kind == "any":
                value = F.when(x.tag > c.NUMBER, bad.cast(f"decimal(38,{x.scale})")).when(x.tag.isin(c.FALSE, c.TRUE), bad.cast(f"decimal(38,{x.scale})")).otherwise(value)
            n = value
            total = {"sum": F.sum, "avg": F.sum, "min": F.min, "max": F.max}[a.function](value)
            if a.function == "sum":
                total = F.coalesce(total, F.lit(0).cast(f"decimal(38,{x.scale})"))
        if total is not None:
            sums.append(total.alias(f"a{j}"))
        if a.function != "avg":
            shown.append(F.col(f"a{j}").alias(alias))
            continue
        sums.append(F.count(n).alias(f"n{j}"))
        if x.wide or a.scale > 18 or a.scale + x.scale > 28:
            late.append((alias, a.scale))
            shown.append(F.concat_ws("/", F.coalesce(F.col(f"a{j}").cast("string"), F.lit("0")), F.col(f"n{j}")).alias(alias))
        else:
            shown.append(F.when(F.col(f"n{j}") > 0, _half_even(F.col(f"a{j}"), F.col(f"n{j}"), x.scale, a.scale)).alias(alias))
    names = key_names
    grouped = b.df.groupBy(*keys).agg(*(sums or [F.count(F.lit(1)).alias("_rows")])) if keys else b.df.agg(*(sums or [F.count(F.lit(1)).alias("_rows")]))
    if wide:
        added = _wide_sums(b.df, keys, names, wide)
        for n in names:
            added = added.withColumnRenamed(n, f"w_{n}")
        same = [F.col(n).eqNullSafe(F.col(f"w_{n}")) for n in names] or [F.lit(True)]
        grouped = grouped.join(added, same, "left").withColumns({a: F.coalesce(a, F.lit("0")) for a in wide})
    if max_groups is not None and keys:
        grouped = grouped.orderBy(*order).limit(max_groups + 1)
        over = F.raise_error(F.lit(f"RESOURCE_EXHAUSTED: more than {max_groups} groups")).cast("boolean")
        grouped = grouped.withColumn("_n", F.monotonically_increasing_id()).where(F.when(F.col("_n") < max_groups, True).otherwise(over)).drop("_n")
    elif keys:
        grouped = grouped.orderBy(*order)
    out = grouped.select(*shown)
    return _averaged(out, late) if late else out


def _averaged(df: DataFrame, late: list[tuple[str, int]]) -> DataFrame:
    """sum/count texts of a few groups to exact averages."""
    scales = dict(late)
    schema = ", ".join(f"`{f.name}` {'string' if f.name in scales else f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = []
            for name in batch.schema.names:
                column = batch.column(name)
                if name in scales:
                    made = []
                    for text in column.to_pylist():
                        total, n = text.split("/")
                        value = exact.average(Decimal(total), int(n), scales[name])
                        made.append(None if value is None else exact.plain(value))
                    column = pa.array(made, pa.string())
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, schema)


def group_envelopes(source: c.Collection, request: QueryRequest) -> list[dict[str, Any]]:
    """{"group": {...}, "values": {...}} in group order; numbers exact, decimals as text."""
    out, size = [], 0
    for r in groups(source, request).collect():
        group: dict[str, Any] = {}
        for path in request.groups:
            tag, value = r[f"{path}#tag"], r[path]
            if tag == c.MISSING:
                continue
            at = group
            *outer, last = pointer.tokens(path)
            for p in outer:
                at = at.setdefault(p, {})
            kind = source.access(path, request.scans).kind
            if tag == c.NUMBER:
                number = exact.number(str(value) if not isinstance(value, Decimal) else Decimal(exact.plain(value)))
                value = exact.plain(number) if kind == "decimal" else number
            elif tag in (c.TRUE, c.FALSE):
                value = tag == c.TRUE
            at[last] = None if tag == c.NULL else value
        values: dict[str, Any] = {}
        for alias, a in request.aggregates.items():
            v = r[alias]
            if a.function != "count" and v is not None:
                number = Decimal(str(v)) if not isinstance(v, Decimal) else v
                text = exact.plain(number)
                v = text if source.access(a.path, request.scans).kind == "decimal" else exact.Number(text)
            values[alias] = v
        out.append({"group": group, "values": values})
        size += len(exact.dumps(out[-1]).encode())
        if size > MAX_GROUP_BYTES:
            raise EngineError("RESOURCE_EXHAUSTED", f"the groups take more than {MAX_GROUP_BYTES} bytes")
    return out
