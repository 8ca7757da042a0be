"""Ranked full-text search over token tables.

A text index is a table of postings (field, kind, term, id, version, tf, places,
size), kind telling stems from surface words, and a row without a term for each
text; a query reads only the terms it names and the rows without one.  Where no
index is stored, one pass over the texts keeps the postings of the terms that
the query could mean, and all further steps read those.
Frequencies and lengths are of the whole index.  BM25 with k1 = 1.2, b = 0.75,
idf = ln(1 + (N - df + 1/2) / (df + 1/2)).  Clauses of a field add up, all must
hold in that field; expansions of a clause and fields combine by maximum.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import text as tx
from ..plans.definition import Index
from ..plans.errors import EngineError, invalid
from ..plans.query import TextSearch
from ..sources.scratch import shared_folder
from .collection import ARRAY, STRING, Collection

K1, B = 1.2, 0.75
MAX_TERM_EXPANSION, MAX_EXPANSION = 64, 256
#: Postings that a search may read for each candidate of its budget.
POSTINGS_A_CANDIDATE = 8
#: Between the elements of an array no phrase matches.
GAP = 100
POSTINGS = "field int, kind string, term string, id string, version long, tf int, places array<int>, size int"


def _texts(source: Collection, index: Index) -> tuple[DataFrame, int]:
    """id and, for each field of the index, its texts as an array t0, t1, ..."""
    columns = source.definition.columns()
    given: list[Column] = []
    for f in index.fields:
        prefix = columns[f.path]
        tag = F.col(f"{prefix}_tag")
        value = F.array(F.col(f"{prefix}_str")) if f.type == "string" else F.col(f"{prefix}_arr")
        given.append(F.when(tag == (STRING if f.type == "string" else ARRAY), value))
    if index.text == "japanese_v1":
        tx.analyse(index.text, "")
    return source.df.select("id", "version", *[g.alias(f"t{i}") for i, g in enumerate(given)]), len(given)


def postings(source: Collection, index: Index) -> DataFrame:
    """The token table of a text index; narrow."""
    df, n = _texts(source, index)
    analyzer = index.text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out: list[tuple] = []
                keys = list(zip(part.column("id").to_pylist(), part.column("version").to_pylist(), strict=True))
                for field in range(n):
                    for (doc, version), texts in zip(keys, part.column(f"t{field}").to_pylist(), strict=True):
                        for kind, found in _terms(analyzer, texts):
                            size = sum(map(len, found.values()))
                            out += [(field, kind, term, doc, version, len(places), places, size) for term, places in found.items()]
                            out.append((field, kind, None, doc, version, 0, [], size))
                yield _batch(out)

    return df.mapInArrow(run, POSTINGS)


_SCHEMA = pa.schema([("field", pa.int32()), ("kind", pa.string()), ("term", pa.string()), ("id", pa.string()), ("version", pa.int64()), ("tf", pa.int32()), ("places", pa.list_(pa.int32())), ("size", pa.int32())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _terms(analyzer: str, texts: list | None) -> Iterator[tuple[str, dict[str, list[int]]]]:
    ranked: dict[str, list[int]] = {}
    surface: dict[str, list[int]] = {}
    at = 0
    for text in texts or []:
        if text is None:
            continue
        stems, plain = tx.analyse(analyzer, text)
        for i, (s, p) in enumerate(zip(stems, plain, strict=True)):
            ranked.setdefault(s, []).append(at + i)
            surface.setdefault(p, []).append(at + i)
        at += len(plain) + GAP
    if ranked:
        yield "ranked", ranked
        yield "surface", surface


def scanned(source: Collection, index: Index, kind: str, keep: Callable[[str], bool]) -> DataFrame:
    """Postings of an index that is not stored: those of the terms to keep, and the row without a term of each text."""
    df, n = _texts(source, index)
    analyzer = index.text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in batches:
            out: list[tuple] = []
            keys = list(zip(batch.column("id").to_pylist(), batch.column("version").to_pylist(), strict=True))
            for field in range(n):
                for (doc, version), texts in zip(keys, batch.column(f"t{field}").to_pylist(), strict=True):
                    found: dict[str, list[int]] = {}
                    size = at = 0
                    for text in texts or []:
                        if text is None:
                            continue
                        words = tx.tokens(analyzer, text, kind == "surface")
                        for w in set(words):
                            if w not in known:
                                known[w] = keep(w)
                        for i, w in enumerate(words):
                            if known[w]:
                                found.setdefault(w, []).append(at + i)
                        size += len(words)
                        at += len(words) + GAP
                    if len(known) > 1 << 17:
                        known.clear()
                    out += [(field, kind, w, doc, version, len(places), places, size) for w, places in found.items()]
                    if size:
                        out.append((field, kind, None, doc, version, 0, [], size))
            yield _batch(out)

    return df.mapInArrow(run, POSTINGS)


def build_text_index(source: Collection, name: str, path: str) -> Collection:
    """The collection with a stored token table, in order of term: a search then reads only the files of its terms."""
    index = source.definition.text_index(name)
    if index is None:
        raise EngineError("INDEX_REQUIRED", f"there is no text index `{name}`")
    in_order(postings(source, index)).write.parquet(path)
    made = source.df.sparkSession.read.schema(POSTINGS).parquet(path)
    return replace(source, texts=(source.texts or {}) | {name: made})


def in_order(table: DataFrame) -> DataFrame:
    """Postings as they are stored: the files and row groups of a term are few."""
    return table.repartitionByRange("kind", "term").sortWithinPartitions("kind", "term", "id")


def _expanded(terms: DataFrame, budget: int) -> list[str]:
    found = [r["term"] for r in terms.limit(min(MAX_TERM_EXPANSION, budget) + 1).collect()]
    if len(found) > min(MAX_TERM_EXPANSION, budget):
        raise EngineError("RESOURCE_EXHAUSTED", "a search term expands to too many words; make it longer")
    return found


def _meant(token: str, mode: str, most: int) -> Callable[[str], bool]:
    """Whether a word of a text can be meant by a token of the query."""
    if mode == "prefix":
        return lambda w: w.startswith(token)
    if mode == "fuzzy":
        return lambda w: tx.distance(token, w, most) <= most
    return lambda w: w == token


def matches(source: Collection, search: TextSearch, max_candidates: int | None = None) -> DataFrame:
    """(id, score) of the matching documents; with a budget of candidates, the postings are bounded too."""
    index = source.definition.text_index(search.index)
    if index is None:
        raise EngineError("INDEX_REQUIRED", f"there is no text index `{search.index}`")
    surface = search.mode in ("prefix", "fuzzy")
    tokens = tx.query_tokens(index.text, search.query, surface)
    if search.mode == "fuzzy" and search.fuzzy_distance and any(len(t) < 3 for t in tokens):
        raise invalid("a fuzzy term has at least three characters")
    kind = "surface" if surface else "ranked"
    most = search.fuzzy_distance or 0
    modes = ["fuzzy" if search.mode == "fuzzy" and most else "prefix" if search.mode == "prefix" and i == len(tokens) - 1 else "word" for i in range(len(tokens))]
    table = (source.texts or {}).get(index.name)
    if table is None:
        tests = [_meant(t, m, most) for t, m in zip(tokens, modes, strict=True)]
        path = shared_folder(source.df.sparkSession, "postings")
        scanned(source, index, kind, lambda w: any(test(w) for test in tests)).write.parquet(path)
        table = source.df.sparkSession.read.schema(POSTINGS).parquet(path)
    table = table.where(F.col("kind") == kind)
    weights: list[tuple[int, str, float]] = []
    for i, (token, mode) in enumerate(zip(tokens, modes, strict=True)):
        left = MAX_EXPANSION - len(weights)
        if mode == "prefix":
            weights += [(i, t, 1.0) for t in _expanded(table.where(F.col("term").startswith(token)).select("term").distinct(), left)]
        elif mode == "fuzzy":
            near = F.levenshtein(F.col("term"), F.lit(token), 2 * most) >= 0  # a transposition is two plain edits
            terms = table.where(near).select("term").distinct().where(_within(token, most)(F.col("term")))
            weights += [(i, t, 1.0 / (1 + tx.distance(token, t, most))) for t in _expanded(terms, left)]
        else:
            weights.append((i, token, 1.0))
    if {i for i, _, _ in weights} != set(range(len(tokens))):
        return source.df.select("id", F.lit(0.0).alias("score")).limit(0)
    wanted = sorted({t for _, t, _ in weights})
    hit = table.where(F.col("term").isin(wanted))
    # one pass for all statistics: a row for each field and wanted term, and one for the texts of a field
    stats = table.where(F.col("term").isNull() | F.col("term").isin(wanted)).groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("size").alias("words")).collect()
    found = {(r["field"], r["term"]): r["df"] for r in stats if r["term"] is not None}
    if max_candidates is not None and sum(found.values()) > POSTINGS_A_CANDIDATE * max_candidates:
        raise EngineError("RESOURCE_EXHAUSTED", f"the search reads more than {POSTINGS_A_CANDIDATE * max_candidates} postings")
    words = {r["field"]: r["words"] for r in stats if r["term"] is None}
    docs = source.df.count()
    clauses = []
    for i, term, weight in weights:
        for (field, known), df in found.items():
            if known == term:
                idf = math.log(1 + (docs - df + 0.5) / (df + 0.5))
                clauses.append((i, term, field, weight, idf, words[field] / docs))
    if not clauses:
        return source.df.select("id", F.lit(0.0).alias("score")).limit(0)
    # at most MAX_EXPANSION terms and MAX_QUERY_TOKENS, by field
    small = source.df.sparkSession.createDataFrame(clauses, "clause int, term string, field int, weight double, idf double, mean double")
    joined = hit.join(F.broadcast(small), ["term", "field"]).withColumn("norm", K1 * (1 - B + B * F.col("size") / F.col("mean")))
    if search.mode == "phrase" and len(tokens) > 1:
        whole = joined.groupBy("id", "field").agg(
            F.collect_list(F.struct("clause", "places")).alias("parts"), F.sum("idf").alias("idf"), F.max("norm").alias("norm"), F.count(F.lit(1)).alias("n")
        )
        at = lambda k: F.filter("parts", lambda p: p["clause"] == k)[0]["places"]
        begins = F.filter(at(0), lambda p: _all([F.array_contains(at(k), (p + k).cast("int")) for k in range(1, len(tokens))]))
        found = whole.where(F.col("n") == len(tokens)).withColumn("tf", F.size(begins)).where("tf > 0")
        return found.select("id", (F.col("idf") * (K1 + 1) * F.col("tf") / (F.col("tf") + F.col("norm"))).alias("s")).groupBy("id").agg(F.max("s").alias("score"))
    one = F.col("weight") * F.col("idf") * (K1 + 1) * F.col("tf") / (F.col("tf") + F.col("norm"))
    best = joined.groupBy("id", "field", "clause").agg(F.max(one).alias("s"))
    whole = best.groupBy("id", "field").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(tokens))
    return whole.groupBy("id").agg(F.max("s").alias("score"))


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def _within(token: str, most: int):
    def near(terms: pd.Series) -> pd.Series:
        return terms.map(lambda t: tx.distance(token, t, most) <= most).astype(bool)

    return F.pandas_udf(near, BooleanType())
