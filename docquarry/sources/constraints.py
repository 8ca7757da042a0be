"""Compound unique indexes: sparse on absent fields, null being a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.collection import MISSING, Collection
from ..plans.definition import Index


def _keys(source: Collection, index: Index) -> list[tuple[str, list[Column]]]:
    out = []
    for f in index.fields:
        a = source.access(f.path, False)
        out.append((f.path, [x for x in (a.tag, a.num, a.txt) if x is not None]))
    return out


def shared_keys(source: Collection, other: Collection, index: Index) -> DataFrame:
    """Keys that documents of both hold."""

    def keyed(s: Collection) -> DataFrame:
        df, keys = s.df, _keys(s, index)
        for _, columns in keys:
            df = df.where(columns[0] > MISSING)
        return df.select(*[x.alias(f"u{i}_{j}") for i, (_, columns) in enumerate(keys) for j, x in enumerate(columns)])

    return keyed(source).intersect(keyed(other))


def violations(source: Collection, index: Index) -> DataFrame:
    """Keys that more than one document holds: their values by path, and n."""
    df = source.df
    keys = _keys(source, index)
    for _, columns in keys:
        df = df.where(columns[0] > MISSING)
    named = {f"u{i}_{j}": c for i, (_, columns) in enumerate(keys) for j, c in enumerate(columns)}
    many = df.groupBy(*[c.alias(n) for n, c in named.items()]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shown = [F.col(f"u{i}_{len(columns) - 1}").alias(path) for i, (path, columns) in enumerate(keys)]
    return many.select(*shown, "n")
