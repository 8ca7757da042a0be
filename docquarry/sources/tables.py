"""Columnar tables as collections, without leaving the JVM.

Members are columns at pointer paths.  Declared paths take their typed columns
straight from them, so filters on a collection reach the Parquet scan of the
table; the body text is an expression that is only evaluated if it is read.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pointer
from ..operators import collection as c
from ..plans.definition import CollectionDefinition


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def fixed_width(key: str, width: int = 12) -> Column:
    """Ids order as text."""
    return F.lpad(F.col(key).cast("string"), width, "0")


def iso(ts: str) -> Column:
    """A timestamp as ISO-8601 text with microseconds."""
    return F.date_format(F.col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def money(amount: str, scale: int = 2) -> Column:
    return F.col(amount).cast(f"decimal(18,{scale})")


def _json(value: Column, kind: str) -> Column:
    if kind == "string":
        return F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2)
    if kind.startswith("array"):
        return F.to_json(value)
    return value.cast("string")


def _object(members: dict, kinds: Mapping[str, str]) -> Column:
    parts = []
    for name, inner in sorted(members.items()):
        text = _object(inner, kinds) if isinstance(inner, dict) else inner
        key = '"' + name.replace("\\", "\\\\").replace('"', '\\"') + '":'
        parts.append(F.concat(F.lit(key), text))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def collection(definition: CollectionDefinition, df: DataFrame, id: Column, members: Mapping[str, Column], present: Mapping[str, Column] | None = None, raw: tuple[str, ...] = (), version: int = 1) -> c.Collection:
    """A collection over df; members in `raw` are JSON text already.  A NULL member is an explicit null, unless present[path] is false: then it is absent."""
    present = present or {}
    paths = list(members)
    df = df.select(id.alias("id"), *[members[p].alias(f"m{i}") for i, p in enumerate(paths)], *[present[p].alias(f"p{i}") for i, p in enumerate(paths) if p in present])
    kinds = {f"m{i}": df.schema[f"m{i}"].dataType.simpleString() for i in range(len(paths))}
    nested: dict = {}
    columns = []
    prefixes = definition.columns()
    for i, path in enumerate(paths):
        value, here = F.col(f"m{i}"), F.col(f"p{i}") if path in present else F.lit(True)
        parts = pointer.tokens(path)
        inner = reduce(lambda d, k: d.setdefault(k, {}), parts[:-1], nested)
        inner[parts[-1]] = F.when(here, F.coalesce(value if path in raw else _json(value, kinds[f"m{i}"]), F.lit("null")))
        if path not in prefixes:
            continue
        f, prefix = definition.fields[path], prefixes[path]
        kind = {"string": c.STRING, "boolean": c.TRUE}.get(f.type, c.ARRAY if f.type.endswith("_array") else c.NUMBER)
        full = F.when(value, c.TRUE).otherwise(c.FALSE) if f.type == "boolean" else F.lit(kind)
        columns.append(F.when(~here, c.MISSING).when(value.isNull(), c.NULL).otherwise(full).cast("tinyint").alias(f"{prefix}_tag"))
        kept = F.when(here, value) if path in present else value
        if f.type in ("number", "decimal"):
            columns.append(kept.cast(f"decimal(38,{f.scale})").alias(f"{prefix}_num"))
        elif f.type != "boolean":
            columns.append(kept.alias(f"{prefix}_{'arr' if f.type.endswith('_array') else 'str'}"))
    for path, prefix in prefixes.items():
        if path not in members:
            columns.append(F.lit(c.MISSING).cast("tinyint").alias(f"{prefix}_tag"))
            columns += [F.lit(None).cast(ddl).alias(name) for name, ddl, _, f in c._fields(definition) if f.path == path]
    out = df.select("id", F.lit(version).cast("long").alias("version"), _object(nested, kinds).alias("body"), *columns)
    return c.Collection(definition, out, version)
