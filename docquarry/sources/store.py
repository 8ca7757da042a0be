"""A tenant on a shared file system: manifests, copy-on-write data, receipts, feed, archive.

Every commit writes its own Parquet files and then one manifest that names all
files of the new revision; a reader that holds a manifest reads that revision
for as long as its files are kept.  A collection is a base and a few deltas of
at most MAX_OPERATIONS rows each: reading subtracts the ids of the deltas and
adds their newest rows.  MAX_DELTAS deltas, or one change of more rows, are
folded into the base, so what a read broadcasts is at most their product.  Each
text index is a base and deltas of postings alike, written by every commit.
One writer at a time holds the tenant's lock file.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exact, pointer
from ..functions import text as tx
from ..functions.schema import check_body, check_schema
from ..operators import collection as c
from ..operators import execute as ex
from ..operators.paging import Caller, Page, _content, _token, page
from ..operators.search import POSTINGS, in_order, postings
from ..plans.definition import CollectionDefinition
from ..plans.errors import EngineError, invalid
from ..plans.query import MAX_PAGE, QueryRequest
from .constraints import shared_keys, violations

# Limits of batches, reads, feed and archive.
MAX_OPERATIONS, MAX_READ_SET, MAX_CHUNKS, MAX_DELTAS = 256, 512, 512, 32
MAX_DOCUMENT_BYTES, MAX_BATCH_BYTES = 1 << 20, 8 << 20
MAX_KEYS, MAX_QUERIES = 256, 16
MAX_CANDIDATES = 100_000
LEASE_MS = 300_000
ARCHIVE_DOCUMENTS, ARCHIVE_BYTES = 100_000, 4096 * (8 << 20)
FEED_EVENTS, FEED_BYTES, FEED_SCAN = 100_000, 128 << 20, 1000
RIGHTS = ("read", "write", "admin", "audit")
FEED = "sequence long, revision long, ordinal long, commit_event_count long, collection string, id string, version long, document string"
RECEIPTS = "principal string, key string, digest string, revision long, outcome string"
AUDIT = "ordinal long, revision long, at_ms long, principal string, action string, detail string"


def digest() -> Column:
    """Of an archived document."""
    return F.xxhash64("id", "version", "body")


class Files:
    """The file system behind a root path, by Spark's own connectors."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = spark.sparkContext._jvm

    def at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        path = self.at(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str, overwrite: bool = False) -> None:
        stream = self.fs.create(self.at(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Appears whole or not at all, and never over another."""
        temp = f"{name}.{uuid.uuid4().hex}"
        self.create(temp, text)
        if self.fs.exists(self.at(name)) or not self.fs.rename(self.at(temp), self.at(name)):
            self.fs.delete(self.at(temp), False)
            raise EngineError("CONFLICT", "another writer has committed")

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


@dataclass
class Batch:
    """A mutation batch: operations that apply together or not at all."""

    key: str = field(default_factory=lambda: uuid.uuid4().hex)
    operations: list[dict[str, Any]] = field(default_factory=list)
    read_set: list[dict[str, Any]] = field(default_factory=list)

    def _add(self, **op: Any) -> Batch:
        return Batch(self.key, [*self.operations, op], self.read_set)

    def put(self, collection: str, id: str, body: dict, expected: Any = "any") -> Batch:
        return self._add(op="put", collection=collection, id=id, body=body, expected=expected)

    def insert(self, collection: str, id: str, body: dict) -> Batch:
        return self.put(collection, id, body, "absent")

    def replace(self, collection: str, id: str, body: dict, version: int) -> Batch:
        return self.put(collection, id, body, {"version": version})

    def patch(self, collection: str, id: str, patch: dict, expected: Any = "any") -> Batch:
        return self._add(op="patch", collection=collection, id=id, patch=patch, expected=expected)

    def delete(self, collection: str, id: str, expected: Any = "any") -> Batch:
        return self._add(op="delete", collection=collection, id=id, expected=expected)

    def given(self, assertions: list[dict[str, Any]]) -> Batch:
        return Batch(self.key, self.operations, [*self.read_set, *assertions])

    def digest(self) -> str:
        return hashlib.sha256(exact.dumps({"key": self.key, "operations": self.operations, "read_set": self.read_set}, sort=True).encode()).hexdigest()


def merge_patch(body: Any, patch: Any, depth: int = 0) -> Any:
    """RFC 7396."""
    if depth > 64:
        raise invalid("a patch nests at most 64 levels")
    if not isinstance(patch, dict):
        return patch
    out = dict(body) if isinstance(body, dict) else {}
    for name, value in patch.items():
        if value is None:
            out.pop(name, None)
        else:
            out[name] = merge_patch(out.get(name), value, depth + 1)
    return out


class Tenant:
    def __init__(self, spark: SparkSession, root: str, clock: Any = None, feed_events: int = FEED_EVENTS, feed_bytes: int = FEED_BYTES):
        self.spark, self.files = spark, Files(spark, root)
        self.clock = clock or (lambda: int(time.time() * 1000))
        self.feed_events, self.feed_bytes = feed_events, feed_bytes
        self.max_candidates: int | None = MAX_CANDIDATES
        self.archive_documents, self.archive_bytes = ARCHIVE_DOCUMENTS, ARCHIVE_BYTES
        self.files.fs.mkdirs(self.files.at("manifests"))
        if not self.files.names("manifests"):
            empty = {
                "revision": 0, "incarnation": uuid.uuid4().hex, "policy_epoch": 0, "schema_epoch": 0, "collections": {}, "grants": {"admin": {"*": list(RIGHTS)}}, "suspended": False,
                "feed": {"next": 1, "first": 1, "segments": []}, "receipts": [], "audit": {"next": 1, "parts": []}, "leases": {}, "archives": {}, "staged": {},
            }
            self.files.publish(self._manifest(0), exact.dumps(empty))

    # ------------------------------------------------------------ manifests

    @staticmethod
    def _manifest(revision: int) -> str:
        return f"manifests/{revision:012d}.json"

    def manifest(self, revision: int | None = None) -> dict[str, Any]:
        import json

        if revision is None:
            revision = max(int(n.split(".")[0]) for n in self.files.names("manifests") if n.count(".") == 1)
        try:
            return json.loads(self.files.read(self._manifest(revision)))
        except Exception as lost:
            raise EngineError("NOT_FOUND", f"revision {revision} is not kept") from lost

    def _commit(self, old: dict, new: dict) -> None:
        new["revision"] = old["revision"] + 1
        self.files.publish(self._manifest(new["revision"]), exact.dumps(new))

    def _locked(self):
        files = self.files

        class Lock:
            def __enter__(self) -> None:
                try:
                    files.create("lock", "held")
                except Exception as held:
                    raise EngineError("UNAVAILABLE", "another writer holds the tenant's lock") from held

            def __exit__(self, *_: Any) -> None:
                files.delete("lock")

        return Lock()

    def _allow(self, m: dict, principal: str, collection: str, right: str) -> None:
        if m["suspended"] and right != "admin":
            raise EngineError("SUSPENDED", "the tenant is suspended")
        own = m["grants"].get(principal, {})
        if right not in own.get(collection, []) and right not in own.get("*", []):
            raise EngineError("FORBIDDEN", f"{principal} may not {right} `{collection}`")

    # -------------------------------------------------------------- reading

    def _frame(self, paths: list[str], schema: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.files.root}/{p}" for p in paths])

    def collection(self, name: str, revision: int | None = None, principal: str = "admin", archived: bool = False) -> c.Collection:
        """A collection as of a revision; with `archived` its cold documents too."""
        m = self.manifest(revision)
        self._allow(m, principal, name, "read")
        return self._open(m, name, archived)

    def _open(self, m: dict, name: str, archived: bool = False) -> c.Collection:
        if name not in m["collections"]:
            raise EngineError("NOT_FOUND", f"there is no collection `{name}`")
        held = m["collections"][name]
        definition = CollectionDefinition.from_json(held["definition"])
        schema = c.schema_of(definition)
        df = self._frame(held["base"], schema)
        if held["deltas"]:
            # at most MAX_DELTAS times MAX_OPERATIONS rows: safe to broadcast
            deltas = self._frame(held["deltas"], schema + ", gone boolean")
            changed = F.broadcast(deltas.select("id").distinct())
            newest = deltas.groupBy("id").agg(F.max_by(F.struct(*deltas.columns), "version").alias("r")).select("r.*").where(~F.col("gone")).drop("gone")
            df = df.join(changed, "id", "left_anti").unionByName(newest)
        texts = {}
        for index, paths in held.get("texts", {}).items():
            texts[index] = self._frame(paths["base"], POSTINGS)
            if held["deltas"]:
                fresh = self._frame(paths["deltas"], POSTINGS).join(F.broadcast(newest.select("id", "version")), ["id", "version"], "left_semi")
                texts[index] = texts[index].join(changed, "id", "left_anti").unionByName(fresh)
        if archived and held["cold"]:
            # every file by its name, so that a lost one is an error; every row against its digest
            cold = self._frame(held["cold"], schema + ", digest bigint")
            lost = F.raise_error(F.lit(f"CORRUPTED: an archived document of `{name}` is not what was archived")).cast("boolean")
            df = df.unionByName(cold.where(F.when(F.col("digest") == digest(), True).otherwise(lost)).drop("digest"))
        return c.Collection(definition, df, m["revision"], texts, archived)

    def collections(self, principal: str = "admin") -> list[CollectionDefinition]:
        m = self.manifest()
        out = []
        for name, held in sorted(m["collections"].items()):
            try:
                self._allow(m, principal, name, "read")
            except EngineError:
                continue
            out.append(CollectionDefinition.from_json(held["definition"]))
        return out

    def query(self, request: QueryRequest, principal: str = "admin") -> Page | list[dict[str, Any]]:
        """A page of rows (at the cursor's revision), or the groups."""
        revision = None
        if request.at is not None and request.paging_mode == "snapshot":
            revision = int(_content(request.at)["revision"])
        current = self.manifest()
        source = self.collection(request.collection, revision, principal)
        source.max_candidates = self.max_candidates
        if source.definition.strict_read_audit:
            self._read_audited(principal, request.collection)
        if request.aggregates:
            return ex.group_envelopes(source, request)
        if request.paging_mode == "seek":
            source.revision = current["collections"][request.collection]["data_epoch"]
        return page(source, request, Caller(principal, current["policy_epoch"], self.clock))

    def _read_audited(self, principal: str, name: str) -> None:
        """Record a read before its rows are released; documents and revision-bound cursors are not touched by it."""
        with self._locked():
            old = self.manifest()
            new = exact_copy(old)
            self._audit(new, principal, "read", name, old["revision"] + 1)
            self._commit(old, new)

    def documents(self, name: str, ids: list[str], m: dict | None = None) -> dict[str, tuple[int, dict]]:
        """A few documents by id; the ids reach the scan as a filter."""
        if not ids:
            return {}
        df = self._open(m or self.manifest(), name).df
        if len(ids) > MAX_OPERATIONS:  # a staged transaction
            df = df.join(self.spark.createDataFrame(pa.table({"id": pa.array(ids, pa.string())})), "id", "left_semi")
        else:
            df = df.where(F.col("id").isin(ids))
        df = df.select("id", "version", "body")
        return {r["id"]: (r["version"], exact.loads(r["body"])) for r in df.collect()}

    def read_snapshot(self, keys: list[tuple[str, str]], queries: list[QueryRequest], principal: str = "admin", bounds: tuple[int, int] | None = None) -> dict[str, Any]:
        """Documents and complete queries of one revision, and the assertions that say so."""
        if not 1 <= len(keys) + len(queries) or len(set(keys)) != len(keys) or len(keys) > MAX_KEYS or len(queries) > MAX_QUERIES:
            raise invalid(f"a snapshot read has up to {MAX_KEYS} distinct keys and {MAX_QUERIES} queries")
        m = self.manifest()
        now = self.clock()
        if bounds and not bounds[0] <= now <= bounds[1]:
            raise EngineError("CONFLICT", "the time is outside the bounds")
        out: dict[str, Any] = {"revision": m["revision"], "incarnation": m["incarnation"], "policy_epoch": m["policy_epoch"], "schema_epoch": m["schema_epoch"], "documents": [], "queries": [], "collection_epochs": {}}
        out["trusted_leader_time_ms"] = now if bounds else None
        found: dict[str, dict] = {}
        for name in sorted({k[0] for k in keys}):
            self._allow(m, principal, name, "read")
            found[name] = self.documents(name, [i for n, i in keys if n == name], m)
        for name, id in keys:
            out["documents"].append({"key": {"collection": name, "id": id}, "document": found[name].get(id)})
        for q in queries:
            if q.at is not None or q.paging_mode == "seek":
                raise invalid("snapshot reads take no cursors and no seek paging")
            self._allow(m, principal, q.collection, "read")
            source = self._open(m, q.collection)
            if q.aggregates:
                out["queries"].append(ex.group_envelopes(source, q))
            else:
                got = page(source, q)
                if got.more:
                    raise EngineError("RESOURCE_EXHAUSTED", "a query of a snapshot read has more rows than its limit")
                out["queries"].append(got.rows)
            out["collection_epochs"][q.collection] = m["collections"][q.collection]["data_epoch"]
        return out

    @staticmethod
    def read_assertions(read: dict[str, Any]) -> list[dict[str, Any]]:
        out: list[dict[str, Any]] = [{"kind": "snapshot", "incarnation": read["incarnation"], "policy_epoch": read["policy_epoch"], "schema_epoch": read["schema_epoch"]}]
        for d in read["documents"]:
            out.append({"kind": "document", **d["key"], "expected": {"version": d["document"][0]} if d["document"] else "absent"})
        return out + [{"kind": "collection", "collection": n, "data_epoch": e} for n, e in read["collection_epochs"].items()]

    # -------------------------------------------------------------- writing

    def mutate(self, batch: Batch, principal: str = "admin", limit: int = MAX_OPERATIONS) -> dict[str, Any]:
        """Apply a batch once: the outcome, or the recorded outcome of the same batch; a recorded rejection raises again."""
        if len(batch.operations) > limit or len(batch.read_set) > MAX_READ_SET:
            raise invalid(f"a batch has at most {limit} operations and {MAX_READ_SET} assertions")
        if len(exact.dumps(batch.operations).encode()) > MAX_BATCH_BYTES * max(1, limit // MAX_OPERATIONS):
            raise EngineError("RESOURCE_EXHAUSTED", "the batch is too large")
        with self._locked():
            old = self.manifest()
            for op in batch.operations:
                self._allow(old, principal, op["collection"], "write")
            known = self._receipt(old, principal, batch.key)
            if known:
                if known["digest"] != batch.digest():
                    raise EngineError("CONFLICT", "the idempotency key belongs to another batch")
                outcome = exact.loads(known["outcome"])
                if "error" in outcome:
                    raise EngineError(outcome["error"]["code"], outcome["error"]["message"])
                return {"revision": known["revision"], "versions": {k: int(v) for k, v in outcome["versions"].items()}}
            new = exact_copy(old)
            revision = old["revision"] + 1
            try:
                changed = self._apply(old, batch, principal, revision)
            except EngineError as rejected:
                if rejected.code in ("CONFLICT", "SCHEMA_VIOLATION", "UNIQUE_VIOLATION", "NOT_FOUND", "FORBIDDEN"):
                    self._record(new, principal, batch, revision, {"error": {"code": rejected.code, "message": rejected.message}})
                    self._commit(old, new)
                raise
            self._store(new, changed, revision)
            versions = {f"{n}/{i}": revision for n, docs in changed.items() for i, (_, body) in docs.items() if body is not None}
            self._record(new, principal, batch, revision, {"versions": versions})
            self._commit(old, new)
            return {"revision": revision, "versions": versions}

    def admit(self, batch: Batch, principal: str = "admin") -> int:
        """A dry run: how many documents the batch would change; nothing is written or recorded."""
        m = self.manifest()
        for op in batch.operations:
            self._allow(m, principal, op["collection"], "write")
        return sum(map(len, self._apply(m, batch, principal, m["revision"] + 1).values()))

    def limits(self) -> dict[str, int]:
        return {
            "max_batch_operations": MAX_OPERATIONS, "max_batch_bytes": MAX_BATCH_BYTES, "max_document_bytes": MAX_DOCUMENT_BYTES, "max_feed_events": self.feed_events, "max_feed_bytes": self.feed_bytes,
            "max_page_size": MAX_PAGE, "max_query_groups": ex.MAX_GROUPS, "max_query_candidates": self.max_candidates, "max_group_bytes": ex.MAX_GROUP_BYTES,
        }

    def _receipt(self, m: dict, principal: str, key: str):
        return self._frame(m["receipts"], RECEIPTS).where((F.col("principal") == principal) & (F.col("key") == key)).first()

    def receipt(self, principal: str, key: str, digest: str | None = None) -> dict[str, Any] | None:
        """The recorded outcome of a batch, if its digest is the given one."""
        r = self._receipt(self.manifest(), principal, key)
        if r is not None and digest not in (None, r["digest"]):
            raise EngineError("CONFLICT", "the key belongs to another batch")
        return None if r is None else {"revision": r["revision"], "digest": r["digest"], "outcome": exact.loads(r["outcome"])}

    def _assert(self, m: dict, assertions: list[dict[str, Any]]) -> None:
        now = self.clock()
        wanted: dict[str, list[str]] = {}
        for a in assertions:
            if a["kind"] == "document":
                wanted.setdefault(a["collection"], []).append(a["id"])
        found = {n: self.documents(n, ids, m) for n, ids in wanted.items()}
        for a in assertions:
            kind = a["kind"]
            if kind == "snapshot":
                good = all(a[k] == m[k] for k in ("incarnation", "policy_epoch", "schema_epoch"))
            elif kind == "document":
                good = matches(a["expected"], found[a["collection"]].get(a["id"]))
            elif kind == "collection":
                good = m["collections"].get(a["collection"], {}).get("data_epoch") == a["data_epoch"]
            elif kind == "before":
                good = now <= a["not_after_ms"]
            elif kind == "not_before":
                good = now >= a["not_before_ms"]
            else:
                raise invalid(f"unknown assertion `{kind}`")
            if not good:
                raise EngineError("CONFLICT", f"the {kind} assertion does not hold")

    def _apply(self, m: dict, batch: Batch, principal: str, revision: int) -> dict[str, dict[str, tuple[int | None, dict | None]]]:
        """For each collection the net changes: id to (version before, body after or None)."""
        self._assert(m, batch.read_set)
        ids: dict[str, list[str]] = {}
        for op in batch.operations:
            if op["collection"] not in m["collections"]:
                raise EngineError("NOT_FOUND", f"there is no collection `{op['collection']}`")
            ids.setdefault(op["collection"], []).append(op["id"])
        before = {n: self.documents(n, sorted(set(i)), m) for n, i in ids.items()}
        state: dict[str, dict[str, tuple[int, dict] | None]] = {n: {i: before[n].get(i) for i in own} for n, own in ids.items()}
        for op in batch.operations:
            name, id, held = op["collection"], op["id"], state[op["collection"]][op["id"]]
            definition = CollectionDefinition.from_json(m["collections"][name]["definition"])
            expected = op.get("expected", "any")
            if definition.write_mode == "append_only" and (op["op"] != "put" or expected != "absent"):
                raise EngineError("FORBIDDEN", f"`{name}` is append-only")
            if op["op"] == "patch" and held is None:
                raise EngineError("NOT_FOUND", f"`{name}/{id}` does not exist")
            if not matches(expected, held):
                raise EngineError("CONFLICT", f"`{name}/{id}` is not as expected")
            if op["op"] == "delete":
                state[name][id] = None
                continue
            if op["op"] == "patch" and not isinstance(op["patch"], dict):
                raise invalid("a patch is an object")
            body = op["body"] if op["op"] == "put" else merge_patch(held[1], op["patch"])
            check_body(body, definition.schema)
            if len(exact.dumps(body).encode()) > MAX_DOCUMENT_BYTES:
                raise EngineError("QUOTA_EXCEEDED", "a document has at most 1 MiB")
            for f in definition.fields.values():
                c.cell(f, body)
            check_texts(definition, body)
            state[name][id] = (revision, body)
        out: dict[str, dict[str, tuple[int | None, dict | None]]] = {}
        for name, docs in state.items():
            for id, now in docs.items():
                was = before[name].get(id)
                if now is not was and not (now is None and was is None):
                    out.setdefault(name, {})[id] = (was[0] if was else None, now[1] if now else None)
        for name, docs in out.items():
            self._unique(m, name, docs)
        return out

    def _unique(self, m: dict, name: str, docs: dict[str, tuple[int | None, dict | None]]) -> None:
        """Unique indexes in the final state: among the changes, and against all other documents."""
        source = self._open(m, name)
        for index in (i for i in source.definition.indexes if i.unique):
            keys: dict[tuple, str] = {}
            for id, (_, body) in docs.items():
                cells = [c.cell(f, body) for f in index.fields] if body is not None else []
                if not cells or any(t == c.MISSING for t, _ in cells):
                    continue
                if (key := tuple(cells)) in keys:
                    raise EngineError("UNIQUE_VIOLATION", f"`{index.name}` has two documents with one key")
                keys[key] = id
            if not keys:
                continue
            if len(docs) > MAX_OPERATIONS:
                others = source.df.join(self.spark.createDataFrame(pa.table({"id": pa.array(list(docs), pa.string())})), "id", "left_anti")
                rows = pa.Table.from_batches([c.records(source.definition, [(i, 0, docs[i][1]) for i in keys.values()])])
                own = c.Collection(source.definition, self.spark.createDataFrame(rows))
                if not shared_keys(c.Collection(source.definition, others), own, index).limit(1).isEmpty():
                    raise EngineError("UNIQUE_VIOLATION", f"`{index.name}` already has a document with that key")
                continue
            others = source.df.where(~F.col("id").isin(list(docs)))
            tests = []
            for key in keys:
                test = F.lit(True)
                for f, (tag, value) in zip(index.fields, key, strict=True):
                    a = source.access(f.path, False)
                    test = test & (a.tag == tag)
                    if tag == c.STRING:
                        test = test & (a.txt == value)
                    elif tag == c.NUMBER:
                        test = test & (a.num == (F.lit(exact.key_of(value)) if a.wide else c.literal(value, a.scale)))
                tests.append(test)
            if not others.where(reduce(lambda x, y: x | y, tests)).limit(1).isEmpty():
                raise EngineError("UNIQUE_VIOLATION", f"`{index.name}` already has a document with that key")

    def _write(self, rows: pa.Table | DataFrame, folder: str) -> str:
        path = f"{folder}/{uuid.uuid4().hex}"
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows)
        (df if isinstance(rows, DataFrame) else df.coalesce(1)).write.parquet(f"{self.files.root}/{path}")
        return path

    def _store(self, new: dict, changed: dict, revision: int) -> None:
        events: list[tuple] = []
        for name in sorted(changed):
            docs = changed[name]
            held = new["collections"][name]
            definition = CollectionDefinition.from_json(held["definition"])
            rows = [(i, revision, body if body is not None else {}) for i, (_, body) in sorted(docs.items())]
            batch = c.records(definition, rows)
            gone = pa.array([docs[i][1] is None for i, _, _ in rows], pa.bool_())
            table = pa.Table.from_batches([batch]).append_column("gone", gone)
            held["deltas"].append(self._write(table, f"data/{name}"))
            for index in searched(definition):
                held.setdefault("texts", {}).setdefault(index.name, {"base": [], "deltas": []})
                kept = c.records(definition, [r for r, g in zip(rows, gone.to_pylist(), strict=True) if not g])
                made = postings(c.Collection(definition, self.spark.createDataFrame(pa.Table.from_batches([kept]))), index)
                held["texts"][index.name]["deltas"].append(self._write(made.coalesce(1), f"texts/{name}"))
            held["data_epoch"] += 1
            events += [(name, i, revision, None if docs[i][1] is None else exact.dumps(docs[i][1], sort=True)) for i, _, _ in rows]
            if len(held["deltas"]) >= MAX_DELTAS or len(rows) > MAX_OPERATIONS:
                whole = self._open(new, name)
                texts = {index: {"base": [self._write(in_order(df), f"texts/{name}")], "deltas": []} for index, df in whole.texts.items()}
                held |= {"base": [self._write(whole.df, f"data/{name}")], "deltas": [], "texts": texts}
        self._feed(new, events, revision)

    def _feed(self, new: dict, events: list[tuple], revision: int) -> None:
        if not events:
            return
        feed, n = new["feed"], len(events)
        columns = list(zip(*[(feed["next"] + k, revision, k, n, *e) for k, e in enumerate(events)], strict=True))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        names = [f.split()[0] for f in FEED.split(", ")]
        table = pa.Table.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=names)
        size = sum(len(e[3] or "") + len(e[1]) for e in events)
        feed["segments"].append({"path": self._write(table, "feed"), "first": feed["next"], "count": n, "bytes": size})
        feed["next"] += n
        self._trim(feed)

    def _trim(self, feed: dict) -> None:
        while len(feed["segments"]) > 1 and (sum(s["count"] for s in feed["segments"]) > self.feed_events or sum(s["bytes"] for s in feed["segments"]) > self.feed_bytes):
            feed["segments"].pop(0)  # whole commits only
        feed["first"] = feed["segments"][0]["first"]

    def _feed_load(self, new: dict, name: str, docs: DataFrame, revision: int) -> None:
        """The events of a bulk load, in order of id, as one segment; numbered without bringing them together."""
        feed = new["feed"]
        n, size = docs.agg(F.count(F.lit(1)), F.sum(F.length("body") + F.length("id"))).first()
        if not n:
            return
        dealt = docs.select("id", "body").repartitionByRange("id").withColumn("part", F.spark_partition_id())
        held = self._frame([self._write(dealt, "feed-order")], "id string, body string, part int")
        counts = held.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
        starts = counts.select("part", F.coalesce(F.sum("k").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
        place = F.col("start") + F.row_number().over(W.partitionBy("part").orderBy("id")) - 1
        numbered = held.join(F.broadcast(starts), "part").withColumn("ordinal", place)
        events = numbered.select(
            (F.lit(feed["next"]) + F.col("ordinal")).alias("sequence"), F.lit(revision).cast("long").alias("revision"), F.col("ordinal").cast("long").alias("ordinal"), F.lit(n).cast("long").alias("commit_event_count"),
            F.lit(name).alias("collection"), "id", F.lit(revision).cast("long").alias("version"), F.col("body").alias("document"),
        )
        feed["segments"].append({"path": self._write(events, "feed"), "first": feed["next"], "count": n, "bytes": size})
        feed["next"] += n
        self._trim(feed)

    def _record(self, new: dict, principal: str, batch: Batch, revision: int, outcome: dict) -> None:
        row = pa.table({"principal": [principal], "key": [batch.key], "digest": [batch.digest()], "revision": pa.array([revision], pa.int64()), "outcome": [exact.dumps(outcome)]})
        new["receipts"].append(self._write(row, "receipts"))
        self._audit(new, principal, "mutate", batch.key, revision)
        if len(new["receipts"]) > MAX_DELTAS:
            new["receipts"] = [self._write(self._frame(new["receipts"], RECEIPTS).coalesce(4), "receipts")]

    def _audit(self, new: dict, principal: str, action: str, detail: str, revision: int) -> None:
        audit = new["audit"]
        row = pa.table({"ordinal": pa.array([audit["next"]], pa.int64()), "revision": pa.array([revision], pa.int64()), "at_ms": pa.array([self.clock()], pa.int64()), "principal": [principal], "action": [action], "detail": [detail]})
        audit["parts"].append(self._write(row, "audit"))
        audit["next"] += 1
        if len(audit["parts"]) > MAX_DELTAS:
            audit["parts"] = [self._write(self._frame(audit["parts"], AUDIT).coalesce(4), "audit")]

    def audit(self, after: int = 0, limit: int = 100, principal: str = "admin") -> DataFrame:
        """The next audit events by ordinal."""
        m = self.manifest()
        self._allow(m, principal, "*", "audit")
        return self._frame(m["audit"]["parts"], AUDIT).where(F.col("ordinal") > after).orderBy("ordinal").limit(limit)

    def audit_page(self, cursor: str | None = None, limit: int = 100, principal: str = "admin") -> tuple[list[dict[str, Any]], str]:
        """The next audit events, and the cursor behind them, which holds for this tenant and caller only."""
        bound = {"incarnation": self.manifest()["incarnation"], "audit": principal}
        held = _content(cursor) if cursor else bound | {"after": 0}
        if any(held.get(k) != v for k, v in bound.items()):
            raise invalid("the cursor belongs to another tenant or caller")
        rows = [r.asDict() for r in self.audit(int(held["after"]), limit, principal).collect()]
        return rows, _token(bound | {"after": rows[-1]["ordinal"] if rows else int(held["after"])})

    # ---------------------------------------------------- definitions, policy

    def activate(self, definitions: list[CollectionDefinition], principal: str = "admin") -> int:
        """Create or replace collections, all or none; every kept document is checked anew and its columns rebuilt."""
        if not 1 <= len(definitions) <= 128:
            raise invalid("a change has 1 to 128 collections")
        with self._locked():
            old = self.manifest()
            new = exact_copy(old)
            revision = old["revision"] + 1
            for d in definitions:
                self._allow(old, principal, d.name, "admin")
                if d.schema is not None:
                    check_schema(d.schema)
                held = new["collections"].get(d.name)
                if held is None:
                    new["collections"][d.name] = {"definition": d.to_json(), "data_epoch": 0, "base": [], "deltas": [], "cold": []}
                    continue
                was = held["definition"]
                if was["write_mode"] == "append_only" and d.write_mode != "append_only" or was["retention_class"] != d.retention_class or held["cold"]:
                    raise EngineError("FORBIDDEN", f"`{d.name}`: append-only, retention class and archived collections stay as they are")
                schema = d.schema

                def check(batches: Iterator[pa.RecordBatch], schema=schema) -> Iterator[pa.RecordBatch]:
                    for batch in batches:
                        for text in batch.column("body").to_pylist():
                            check_body(exact.loads(text), schema)
                        yield batch

                docs = self._open(old, d.name).df.select("id", "version", "body")
                checked = docs.mapInArrow(check, "id string, version long, body string")
                made = c.from_json(d, checked)
                try:
                    base = self._write(made.df, f"data/{d.name}")
                except Exception as bad:
                    raise EngineError("SCHEMA_VIOLATION", f"a document of `{d.name}` does not fit: {str(bad)[:300]}") from bad
                held |= {"definition": d.to_json(), "base": [base], "deltas": [], "texts": {}}
                self._constrained(self._open(new, d.name))
                held["texts"] = self._indexed(self._open(new, d.name))
            new["schema_epoch"] += 1
            self._audit(new, principal, "activate", ",".join(d.name for d in definitions), revision)
            self._commit(old, new)
            return new["revision"]

    def _constrained(self, source: c.Collection) -> None:
        """Every unique index holds over the whole collection."""
        for index in (i for i in source.definition.indexes if i.unique):
            if not violations(source, index).limit(1).isEmpty():
                raise EngineError("UNIQUE_VIOLATION", f"`{source.definition.name}` has documents with equal `{index.name}`")

    def _indexed(self, source: c.Collection) -> dict[str, dict[str, list[str]]]:
        """The postings of a collection's text indexes, written anew."""
        name = source.definition.name
        return {i.name: {"base": [self._write(in_order(postings(source, i)), f"texts/{name}")], "deltas": []} for i in searched(source.definition)}

    def schema(self) -> dict[str, Any]:
        m = self.manifest()
        return {"revision": m["revision"], "schema_epoch": m["schema_epoch"], "collections": {n: h["definition"] for n, h in m["collections"].items()}}

    def policy(self) -> dict[str, Any]:
        m = self.manifest()
        return {"revision": m["revision"], "policy_epoch": m["policy_epoch"], "grants": m["grants"], "suspended": m["suspended"]}

    def grant(self, principal: str, collection: str, rights: list[str], by: str = "admin") -> None:
        if not set(rights) <= set(RIGHTS):
            raise invalid(f"rights are {', '.join(RIGHTS)}")
        self._policy(by, lambda m: m["grants"].setdefault(principal, {}).__setitem__(collection, rights))

    def suspend(self, on: bool = True, by: str = "admin") -> None:
        self._policy(by, lambda m: m.__setitem__("suspended", on))

    def _policy(self, by: str, change: Any) -> None:
        with self._locked():
            old = self.manifest()
            self._allow(old, by, "*", "admin")
            new = exact_copy(old)
            change(new)
            new["policy_epoch"] += 1
            self._audit(new, by, "policy", "", old["revision"] + 1)
            self._commit(old, new)

    def load(self, name: str, df: DataFrame, principal: str = "admin") -> int:
        """Bulk load of (id, body text) into a new or empty collection, as one commit; distributed."""
        with self._locked():
            old = self.manifest()
            self._allow(old, principal, name, "write")
            held = old["collections"].get(name)
            if held is None or held["base"] or held["deltas"]:
                raise EngineError("CONFLICT", "bulk loads go into empty collections")
            new = exact_copy(old)
            revision = old["revision"] + 1
            definition = CollectionDefinition.from_json(held["definition"])


            def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for id, text in zip(batch.column("id").to_pylist(), batch.column("body").to_pylist(), strict=True):
                        if id is None or text is None:
                            raise EngineError("INVALID_ARGUMENT", "a document needs an id and a body")
                        if len(text.encode()) > MAX_DOCUMENT_BYTES:
                            raise EngineError("QUOTA_EXCEEDED", "a document has at most 1 MiB")
                        body = exact.loads(text)
                        check_body(body, definition.schema)
                        check_texts(definition, body)
                    yield batch

            given = df.select(F.col("id").cast("string").alias("id"), F.lit(revision).cast("long").alias("version"), F.col("body").cast("string").alias("body"))
            made = c.from_json(definition, given.mapInArrow(check, "id string, version long, body string"))
            base = f"data/{name}/{uuid.uuid4().hex}"
            try:
                try:
                    made.df.write.parquet(f"{self.files.root}/{base}")
                except Exception as bad:
                    code = next((k for k in ("QUOTA_EXCEEDED", "INVALID_ARGUMENT") if k in str(bad)), "SCHEMA_VIOLATION")
                    raise EngineError(code, f"a document of `{name}` does not fit: {str(bad)[:300]}") from bad
                loaded = c.Collection(definition, self._frame([base], c.schema_of(definition)))
                if not loaded.df.groupBy("id").count().where("count > 1").limit(1).isEmpty():
                    raise EngineError("CONFLICT", "a bulk load has each id once")
                self._constrained(loaded)
            except EngineError:
                self.files.delete(base)
                raise
            new["collections"][name] |= {"base": [base], "texts": self._indexed(loaded)}
            new["collections"][name]["data_epoch"] += 1
            self._feed_load(new, name, self._frame([base], c.schema_of(definition)), revision)
            self._audit(new, principal, "load", name, revision)
            self._commit(old, new)
            return revision

    # ---------------------------------------------------- staged transactions

    def begin(self, principal: str = "admin") -> str:
        name = uuid.uuid4().hex
        self.files.create(f"staged/{name}/begin.json", exact.dumps({"principal": principal}))
        return name

    def append(self, transaction: str, chunk: int, operations: list[dict[str, Any]]) -> None:
        """A chunk of a staged transaction; invisible until it is finalized. The same chunk again is the same chunk."""
        if not 0 <= chunk < MAX_CHUNKS or len(operations) > MAX_OPERATIONS:
            raise invalid(f"a staged transaction has up to {MAX_CHUNKS} chunks of {MAX_OPERATIONS} operations")
        if "begin.json" not in self.files.names(f"staged/{transaction}"):
            raise EngineError("NOT_FOUND", "there is no such staged transaction")
        self.files.create(f"staged/{transaction}/{chunk:06d}.json", exact.dumps(operations), overwrite=True)

    def finalize(self, transaction: str, principal: str = "admin") -> dict[str, Any]:
        names = self.files.names(f"staged/{transaction}")
        if "begin.json" not in names:
            raise EngineError("NOT_FOUND", "there is no such staged transaction")
        ops = [op for n in names if n[0].isdigit() for op in exact.loads(self.files.read(f"staged/{transaction}/{n}"))]
        done = self.mutate(Batch(f"staged-{transaction}", ops), principal, limit=MAX_CHUNKS * MAX_OPERATIONS)
        self.stop(transaction)
        return done

    def stop(self, transaction: str) -> None:
        self.files.delete(f"staged/{transaction}")

    # ------------------------------------------------------------ leases

    def lease(self, principal: str = "admin", ttl_ms: int = LEASE_MS) -> str:
        """Pins the current revision for reads by key or in id order, for a time."""
        name = uuid.uuid4().hex
        held = {"revision": self.manifest()["revision"], "principal": principal, "expires_ms": self.clock() + ttl_ms}
        self.files.create(f"leases/{name}.json", exact.dumps(held))
        return name

    def _leased(self, lease: str) -> int:
        try:
            held = exact.loads(self.files.read(f"leases/{lease}.json"))
        except Exception as lost:
            raise EngineError("NOT_FOUND", "there is no such lease") from lost
        if self.clock() > int(held["expires_ms"]):
            self.close(lease)
            raise EngineError("NOT_FOUND", "the lease has expired")
        return int(held["revision"])

    def lease_frame(self, lease: str, name: str) -> DataFrame:
        """(id, version, body) of a collection at the lease's revision, as a table."""
        return self._open(self.manifest(self._leased(lease)), name).df.select("id", "version", "body")

    def lease_read(self, lease: str, name: str, id: str) -> tuple[int, dict] | None:
        return self.documents(name, [id], self.manifest(self._leased(lease))).get(id)

    def lease_scan(self, lease: str, name: str, after: str | None = None, limit: int = 1000) -> dict[str, Any]:
        m = self.manifest(self._leased(lease))
        df = self._open(m, name).df.select("id", "version", "body")
        rows = (df if after is None else df.where(F.col("id") > after)).orderBy("id").limit(limit + 1).collect()
        docs = [{"id": r["id"], "version": r["version"], "body": exact.loads(r["body"])} for r in rows[:limit]]
        return {"documents": docs, "next_after_id": docs[-1]["id"] if len(rows) > limit else None, "data_epoch": m["collections"][name]["data_epoch"]}

    def close(self, lease: str) -> None:
        self.files.delete(f"leases/{lease}.json")

    # ------------------------------------------------------------ archive

    def archive(self, archive_id: str, name: str, cutoff: int, principal: str = "admin") -> int:
        """Move documents of an append-only archivable collection up to a revision into cold files; how many."""
        with self._locked():
            old = self.manifest()
            self._allow(old, principal, name, "admin")
            if archive_id in old["archives"]:
                return old["archives"][archive_id]
            held = old["collections"].get(name)
            if held is None or held["definition"]["write_mode"] != "append_only" or not held["definition"]["archivable"]:
                raise EngineError("FORBIDDEN", f"`{name}` is not an append-only archivable collection")
            new = exact_copy(old)
            df = self._open(old, name).df
            cold = self._write(df.where(F.col("version") <= cutoff).withColumn("digest", digest()), f"cold/{name}")
            parts = [f"{cold}/{p}" for p in self.files.names(cold) if p.startswith("part-")]
            n, size = self._frame(parts, "id string, body string").agg(F.count(F.lit(1)), F.sum(F.octet_length("body") + F.octet_length("id"))).first()
            if n > self.archive_documents or (size or 0) > self.archive_bytes:
                self.files.delete(cold)
                raise EngineError("RESOURCE_EXHAUSTED", f"an archive has at most {self.archive_documents} documents and {self.archive_bytes} bytes")
            hot = self._write(df.where(F.col("version") > cutoff), f"data/{name}")
            kept = self._frame([hot], c.schema_of(CollectionDefinition.from_json(held["definition"])))
            texts = {i: {"base": [self._write(in_order(p.join(kept.select("id"), "id", "left_semi")), f"texts/{name}")], "deltas": []} for i, p in self._open(old, name).texts.items()}
            new["collections"][name] |= {"base": [hot], "deltas": [], "cold": [*held["cold"], *parts], "texts": texts}
            new["archives"][archive_id] = n
            self._audit(new, principal, "archive", archive_id, old["revision"] + 1)
            self._commit(old, new)
            return n


def searched(definition: CollectionDefinition) -> list:
    """The text indexes that can be built."""
    return [i for i in definition.indexes if i.text and i.text != "japanese_v1"]


def check_texts(definition: CollectionDefinition, body: dict) -> None:
    """Limits of searchable texts."""
    for index in definition.indexes:
        for f in index.fields if index.text and index.text != "japanese_v1" else ():
            value = pointer.resolve(body, pointer.tokens(f.path))
            words = [w for t in (value if isinstance(value, list) else [value]) if isinstance(t, str) for w in tx.words(t)]
            if len(words) > tx.MAX_DOCUMENT_TOKENS or any(len(w.encode()) > tx.MAX_TOKEN_BYTES for w in words):
                raise EngineError("SCHEMA_VIOLATION", f"`{f.path}` has too many or too long words to be searched")


def exact_copy(m: dict) -> dict:
    import copy

    return copy.deepcopy(m)


def matches(expected: Any, held: tuple[int, dict] | None) -> bool:
    if expected == "any":
        return True
    if expected == "absent":
        return held is None
    return held is not None and held[0] == int(expected["version"])
