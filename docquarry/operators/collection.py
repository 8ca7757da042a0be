"""A collection as a DataFrame: envelope, body text, typed columns of declared paths.

For a declared path with prefix f there are f_tag (tinyint) and, by type,
f_num DECIMAL(38, scale), or f_key and f_txt for wide numbers, f_str, f_arr.
Tags order as the values do and keep absent apart from null; they stand in for
NULL, so predicates are two-valued and sorting needs no NULLS rule.  With the
values in plain Parquet columns, filters on them are pushed into the scan, and
only columns that a query names are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exact, pointer
from ..plans.definition import MAX_ARRAY, CollectionDefinition, IndexField
from ..plans.errors import EngineError, invalid

# The order of kinds of values.
MISSING, NULL, FALSE, TRUE, NUMBER, STRING, ARRAY, OBJECT = range(8)
SCAN_SCALE = 18


@dataclass
class Access:
    """How to read one path."""

    path: str
    kind: str  # a declared type, or "any" on a scan
    tag: Column
    num: Column | None = None  # DECIMAL(38, scale), or the ordered key if wide
    txt: Column | None = None
    arr: Column | None = None
    scale: int = 0
    wide: bool = False
    wide_text: Column | None = None

    @property
    def is_array(self) -> bool:
        return self.kind.endswith("_array")


@dataclass
class Collection:
    """df has id, version, body and the columns of the definition; `texts` the token tables of text indexes."""

    definition: CollectionDefinition
    df: DataFrame
    revision: int = 0
    texts: dict[str, DataFrame] | None = None
    archived: bool = False
    scans: dict[str, Access] | None = None  # undeclared paths that df already has columns for
    max_candidates: int | None = None  # of a query with a filter or a search; more is an error

    def access(self, path: str, scan: bool) -> Access:
        f = self.definition.fields.get(path)
        if f is not None:
            return declared(f, self.definition.columns()[path])
        if self.scans and path in self.scans:
            return self.scans[path]
        if not scan:
            raise EngineError("INDEX_REQUIRED", f"`{path}` has no declared index; declare one or set allow_scan")
        return scanned(path)


def declared(f: IndexField, prefix: str) -> Access:
    tag = F.col(f"{prefix}_tag")
    if f.type in ("number", "decimal"):
        if f.wide:
            return Access(f.path, f.type, tag, num=F.col(f"{prefix}_key"), wide=True, wide_text=F.col(f"{prefix}_txt"))
        return Access(f.path, f.type, tag, num=F.col(f"{prefix}_num"), scale=f.scale)
    if f.type == "string":
        return Access(f.path, f.type, tag, txt=F.col(f"{prefix}_str"))
    if f.type == "boolean":
        return Access(f.path, f.type, tag)
    return Access(f.path, f.type, tag, arr=F.col(f"{prefix}_arr"), scale=f.scale)


def value_at(body: Column, path: str, arrays: bool = True) -> Column:
    """The variant at a path of a variant; SQL NULL if absent."""
    parts = pointer.tokens(path)
    if not arrays or not any(map(pointer.is_index, parts)):
        return F.try_variant_get(body, pointer.variant_path(parts), "variant")
    for part in parts:
        named = F.try_variant_get(body, pointer.variant_path([part]), "variant")
        if pointer.is_index(part):
            named = F.coalesce(named, F.try_variant_get(body, f"$[{part}]", "variant"))
        body = named
    return body


#: The tag behind the first letters of a variant's type; numbers for all others.
_KINDS = f"--{NUMBER}VO{NULL}BO{FALSE}ST{STRING}AR{ARRAY}OB{OBJECT}"


def kind_of(v: Column) -> Column:
    """The tag of a variant, written with few mentions of v so that generated code stays small."""
    start = F.substring(F.schema_of_variant(v), 1, 2)
    base = F.substr(F.lit(_KINDS), F.greatest(F.position(start, F.lit(_KINDS)), F.lit(1)) + 2, F.lit(1)).cast("tinyint")
    yes = F.when(base == FALSE, F.try_variant_get(v, "$", "boolean").cast("tinyint")).otherwise(0)
    return F.when(v.isNull(), MISSING).otherwise(base + yes).cast("tinyint")


def scan_number(v: Column) -> Column:
    """A variant number as DECIMAL(38, 18), exactly, or an error: never a rounded value."""
    kind = f"decimal(38,{SCAN_SCALE})"
    text = F.try_variant_get(v, "$", "string")
    value = text.try_cast(kind)
    same = text.rlike(r"^-?[0-9]{1,20}(\.[0-9]{1,18})?$") | (value.cast("double") == text.try_cast("double")) & text.contains("E")
    failed = F.raise_error(F.lit("a scanned number has too many digits; declare a wide index")).cast(kind)
    return F.when(same, value).otherwise(failed)


def scanned(path: str, body: Column | None = None) -> Access:
    """Reads an undeclared path of the body."""
    v = value_at(F.try_parse_json(F.col("body")) if body is None else body, path)
    tag = kind_of(v)
    num = F.when(tag == NUMBER, scan_number(v))
    txt = F.when(tag == STRING, F.try_variant_get(v, "$", "string"))
    arr = F.when(tag == ARRAY, F.try_variant_get(v, "$", "array<variant>"))
    return Access(path, "any", tag, num=num, txt=txt, arr=arr, scale=SCAN_SCALE)


def with_scans(source: Collection, paths: list[str]) -> tuple[Collection, Column]:
    """The collection with columns for undeclared paths, and a condition to add to any filter on them.

    A body is parsed once a row, in a projection below the filter.  Catalyst
    would otherwise copy the parsing into every mention of a path; it does not
    move a filter through a projection with a column that depends on the row's
    place, which is what the condition keeps alive.
    """
    df = source.df.withColumn("__body", F.try_parse_json(F.col("body")))
    df = df.withColumns({f"__s{i}": value_at(F.col("__body"), p) for i, p in enumerate(paths)})
    df = df.withColumns({f"__s{i}_tag": kind_of(F.col(f"__s{i}")) for i in range(len(paths))})
    made: dict[str, Column] = {}
    scans: dict[str, Access] = {}
    for i, path in enumerate(paths):
        v, tag = F.col(f"__s{i}"), F.col(f"__s{i}_tag")
        made |= {f"__s{i}_num": F.when(tag == NUMBER, scan_number(v)), f"__s{i}_str": F.when(tag == STRING, F.try_variant_get(v, "$", "string")), f"__s{i}_arr": F.when(tag == ARRAY, F.try_variant_get(v, "$", "array<variant>"))}
        scans[path] = Access(path, "any", tag, F.col(f"__s{i}_num"), F.col(f"__s{i}_str"), F.col(f"__s{i}_arr"), SCAN_SCALE)
    df = df.withColumns(made | {"__place": F.monotonically_increasing_id()})
    return Collection(source.definition, df, source.revision, source.texts, source.archived, scans), F.col("__place") >= 0


# ------------------------------------------------- columns from parsed bodies


def _decimal(value: Any, scale: int) -> Decimal:
    exactly = exact.number(value)
    fixed = exactly.quantize(Decimal(1).scaleb(-scale), context=exact.CONTEXT)
    if fixed != exactly or abs(fixed) >= Decimal(10) ** (38 - scale):
        raise EngineError("SCHEMA_VIOLATION", f"{exact.plain(exactly)} does not fit DECIMAL(38,{scale}); declare the field wide")
    return fixed


def cell(f: IndexField, body: Any) -> tuple[int, Any]:
    """Tag and value of a declared path in a parsed body; an error if the type differs."""
    value = pointer.resolve(body, pointer.tokens(f.path))
    if value is pointer.MISSING:
        return MISSING, None
    if value is None:
        return NULL, None
    wrong = EngineError("SCHEMA_VIOLATION", f"`{f.path}` must be a {f.type}")
    if f.type == "boolean":
        if not isinstance(value, bool):
            raise wrong
        return (TRUE if value else FALSE), None
    if f.type == "string":
        if not isinstance(value, str):
            raise wrong
        return STRING, value
    if f.type in ("number", "decimal"):
        if isinstance(value, bool) or not isinstance(value, str if f.type == "decimal" else (Decimal, int)):
            raise wrong
        return NUMBER, exact.number(value) if f.wide else _decimal(value, f.scale)
    if not isinstance(value, list) or len(value) > MAX_ARRAY:
        raise wrong
    out = []
    for item in value:
        if f.type == "string_array" and isinstance(item, str):
            out.append(item)
        elif f.type == "number_array" and not isinstance(item, bool) and isinstance(item, (Decimal, int)):
            out.append(_decimal(item, f.scale))
        else:
            raise wrong
    return ARRAY, out


def _fields(definition: CollectionDefinition) -> list[tuple[str, str, pa.DataType, IndexField]]:
    """(column, DDL, arrow type, field) of the value columns."""
    out = []
    for path, prefix in definition.columns().items():
        f = definition.fields[path]
        dec, ddl = pa.decimal128(38, f.scale), f"decimal(38,{f.scale})"
        if f.type in ("number", "decimal"):
            out += [(f"{prefix}_key", "string", pa.string(), f), (f"{prefix}_txt", "string", pa.string(), f)] if f.wide else [(f"{prefix}_num", ddl, dec, f)]
        elif f.type == "string":
            out.append((f"{prefix}_str", "string", pa.string(), f))
        elif f.type == "string_array":
            out.append((f"{prefix}_arr", "array<string>", pa.list_(pa.string()), f))
        elif f.type == "number_array":
            out.append((f"{prefix}_arr", f"array<{ddl}>", pa.list_(dec), f))
    return out


def schema_of(definition: CollectionDefinition) -> str:
    """The DDL of a collection's DataFrame."""
    tags = [f"{p}_tag tinyint" for p in definition.columns().values()]
    return ", ".join(["id string", "version bigint", "body string", *tags, *(f"{c} {ddl}" for c, ddl, _, _ in _fields(definition))])


def records(definition: CollectionDefinition, rows: list[tuple[str, int, Any]]) -> pa.RecordBatch:
    """Rows of (id, version, parsed body) as the collection's columns."""
    columns: dict[str, pa.Array] = {
        "id": pa.array([r[0] for r in rows], pa.string()),
        "version": pa.array([r[1] for r in rows], pa.int64()),
        "body": pa.array([exact.dumps(r[2], sort=True) for r in rows], pa.string()),
    }
    prefixes = definition.columns()
    cells = {p: [cell(definition.fields[p], r[2]) for r in rows] for p in prefixes}
    for p, prefix in prefixes.items():
        columns[f"{prefix}_tag"] = pa.array([t for t, _ in cells[p]], pa.int8())
    for name, _, kind, f in _fields(definition):
        own = [v for _, v in cells[f.path]]
        if name.endswith("_key"):
            own = [None if v is None else exact.key_of(v) for v in own]
        elif name.endswith("_txt"):
            own = [None if v is None else exact.plain(v) for v in own]
        columns[name] = pa.array(own, kind)
    return pa.RecordBatch.from_pydict(columns)


def from_json(definition: CollectionDefinition, df: DataFrame) -> Collection:
    """A collection of (id, version, body text); bodies are parsed once, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, v, text in zip(batch.column("id").to_pylist(), batch.column("version").to_pylist(), batch.column("body").to_pylist(), strict=True):
                body = exact.loads(text)
                if not isinstance(body, dict):
                    raise EngineError("SCHEMA_VIOLATION", "a body must be an object")
                rows.append((i, v, body))
            yield records(definition, rows)

    return Collection(definition, df.select("id", F.col("version").cast("long").alias("version"), "body").mapInArrow(run, schema_of(definition)))


def literal(value: Decimal, scale: int) -> Column:
    return F.lit(exact.plain(value)).cast(f"decimal(38,{scale})")


def check_text(value: Any, what: str) -> str:
    if not isinstance(value, str):
        raise invalid(f"{what} must be a string")
    return value
