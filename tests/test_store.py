import pytest

from docquarry.functions import exact
from docquarry.operators.paging import Page
from docquarry.plans.definition import CollectionDefinition, Index, IndexField
from docquarry.plans.errors import EngineError
from docquarry.plans.query import Aggregation, Filter, QueryRequest
from docquarry.sources import feed
from docquarry.sources.store import Batch, Tenant, merge_patch
from docquarry.streaming.feed import register

PEOPLE = CollectionDefinition(
    "people",
    [Index("email", (IndexField("/email"),), unique=True), Index("age", (IndexField("/age", "number", 0),)), Index("bio", (IndexField("/bio"),), text="english_v1")],
    schema={"type": "object", "required": ["email"], "properties": {"email": {"type": "string"}, "age": {"type": "integer"}}},
)
LOG = CollectionDefinition("log", [Index("n", (IndexField("/n", "number", 0),))], write_mode="append_only", archivable=True)


@pytest.fixture()
def tenant(spark, tmp_path):
    t = Tenant(spark, f"file://{tmp_path}/tenant", clock=lambda: 1000)
    t.activate([PEOPLE, LOG])
    return t


def ids(t, **kw):
    return sorted(r.id for r in t.collection("people", **kw).df.collect())


def test_writes_receipts_and_conditions(tenant):
    t = tenant
    b = Batch("k1").insert("people", "a", {"email": "a@x", "age": 3}).insert("people", "b", {"email": "b@x"})
    first = t.mutate(b)
    assert t.mutate(b) == first and ids(t) == ["a", "b"]
    with pytest.raises(EngineError, match="CONFLICT"):
        t.mutate(Batch("k1").delete("people", "a"))
    rev = first["revision"]
    for bad, code in [
        (Batch("k2").insert("people", "a", {"email": "z@x"}), "CONFLICT"),
        (Batch("k3").replace("people", "a", {"email": "z@x"}, rev + 7), "CONFLICT"),
        (Batch("k4").put("people", "c", {"email": 5}), "SCHEMA_VIOLATION"),
        (Batch("k5").put("people", "c", {"email": "a@x"}), "UNIQUE_VIOLATION"),
        (Batch("k6").put("people", "c", {"email": "q"}).put("people", "d", {"email": "q"}), "UNIQUE_VIOLATION"),
        (Batch("k7").patch("people", "nobody", {"age": 1}), "NOT_FOUND"),
        (Batch("k8").put("log", "l", {"n": 1}), "FORBIDDEN"),
    ]:
        for _ in range(2):  # a recorded rejection is replayed
            with pytest.raises(EngineError, match=code):
                t.mutate(bad)
    assert ids(t) == ["a", "b"]
    # keys may swap within one batch
    t.mutate(Batch("k9").put("people", "a", {"email": "b@x"}).put("people", "b", {"email": "a@x"}))
    t.mutate(Batch("k10").patch("people", "a", {"age": None, "x": {"y": 1}}).delete("people", "b"))
    assert t.documents("people", ["a"])["a"][1] == {"email": "b@x", "x": {"y": exact.Number("1")}}
    assert ids(t) == ["a"] and ids(t, revision=rev) == ["a", "b"]
    assert t.receipt("admin", "k1", b.digest())["revision"] == rev and t.receipt("admin", "none") is None
    assert merge_patch({"a": {"b": 1, "c": 2}, "d": [1]}, {"a": {"b": None}, "d": [2]}) == {"a": {"c": 2}, "d": [2]}


def test_snapshot_reads_and_assertions(tenant):
    t = tenant
    t.mutate(Batch("1").insert("people", "a", {"email": "a@x", "age": 3}))
    read = t.read_snapshot([("people", "a"), ("people", "zz")], [QueryRequest("people").filter(Filter().gte("/age", 1))])
    assert read["documents"][1]["document"] is None and [r["id"] for r in read["queries"][0]] == ["a"]
    given = t.read_assertions(read)
    t.mutate(Batch("2").insert("people", "b", {"email": "b@x"}).given(given))
    with pytest.raises(EngineError, match="CONFLICT"):  # a phantom
        t.mutate(Batch("3").insert("people", "c", {"email": "c@x"}).given(given))
    with pytest.raises(EngineError, match="CONFLICT"):
        t.mutate(Batch("4").given([{"kind": "before", "not_after_ms": 999}]))
    t.mutate(Batch("5").given([{"kind": "before", "not_after_ms": 1000}, {"kind": "not_before", "not_before_ms": 1000}]))


def test_pages_keep_their_revision_and_deltas_fold(tenant, monkeypatch):
    from docquarry.sources import store

    monkeypatch.setattr(store, "MAX_DELTAS", 3)
    t = tenant
    for k in range(5):
        t.mutate(Batch(f"b{k}").put("people", f"{k}", {"email": f"{k}@x", "age": k}))
    q = QueryRequest("people").sort_desc("/age").limit(2)
    page = t.query(q)
    t.mutate(Batch("later").put("people", "9", {"email": "9@x", "age": 9}).delete("people", "0"))
    rest = t.query(q.cursor(page.cursor))
    assert isinstance(rest, Page) and [r["id"] for r in page.rows + rest.rows] == ["4", "3", "2", "1"]
    assert exact.dumps(t.query(QueryRequest("people").aggregate("n", Aggregation.count()).aggregate("s", Aggregation.sum("/age")))) == '[{"group":{},"values":{"n":5,"s":19}}]'
    m = t.manifest()["collections"]["people"]
    assert m["base"] and len(m["deltas"]) < 3


def test_feed_scope_gap_and_stream(spark, tenant, tmp_path):
    t = tenant
    t.mutate(Batch("1").insert("people", "a", {"email": "a@x"}).insert("log", "1", {"n": 1}))
    t.mutate(Batch("2").insert("log", "2", {"n": 2}))
    t.mutate(Batch("3").delete("people", "a"))
    got = feed.read(t, ["people"], limit=1)
    assert [(e["id"], e["commit_event_count"]) for e in got.events] == [("a", 2)] and not got.caught_up
    rest = feed.read(t, ["people"], got.cursor)
    assert [e["document"] for e in rest.events] == [None] and rest.caught_up
    assert feed.read(t, ["people"], "now").events == []
    with pytest.raises(EngineError):
        feed.read(t, ["log"], got.cursor)
    register(spark)
    assert spark.read.format("docquarry_feed").option("path", t.files.root).option("collections", "log").load().count() == 2
    stream = spark.readStream.format("docquarry_feed").option("path", t.files.root).option("collections", "people").load()
    run = lambda: stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    run()
    t.mutate(Batch("4").insert("people", "z", {"email": "z@x"}))
    run()
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/out").orderBy("sequence").collect()] == ["a", "a", "z"]
    t.feed_events = 1
    t.mutate(Batch("5").insert("log", "3", {"n": 3}))
    assert isinstance(feed.read(t, ["people"], got.cursor), feed.RetentionGap)


def test_definitions_policy_leases_staging_archive_audit(spark, tenant):
    t = tenant
    t.load("log", spark.range(40).selectExpr("lpad(id, 3, '0') as id", "concat('{\"n\":', id, '}') as body"))
    loaded = feed.table(t).orderBy("sequence").collect()
    assert [(e.sequence, e.ordinal, e.id, e.commit_event_count) for e in loaded] == [(k + 1, k, f"{k:03d}", 40) for k in range(40)]
    lease = t.lease()
    tx = t.begin()
    t.append(tx, 0, Batch().insert("log", "900", {"n": 900}).operations)
    t.append(tx, 1, Batch().insert("log", "901", {"n": 901}).operations)
    assert t.collection("log").df.count() == 40
    done = t.finalize(tx)
    assert t.collection("log").df.count() == 42
    page = t.lease_scan(lease, "log", None, 30)
    more = t.lease_scan(lease, "log", page["next_after_id"], 30)
    assert len(page["documents"]) == 30 and len(more["documents"]) == 10 and more["next_after_id"] is None
    assert t.lease_read(lease, "log", "900") is None
    t.close(lease)
    with pytest.raises(EngineError, match="NOT_FOUND"):
        t.lease_scan(lease, "log")
    assert t.archive("arc", "log", done["revision"] - 1) == 40 and t.archive("arc", "log", 99) == 40
    assert t.collection("log").df.count() == 2 and t.collection("log", archived=True).df.count() == 42
    with pytest.raises(EngineError, match="FORBIDDEN"):
        t.archive("x", "people", 1)
    t.mutate(Batch("p").insert("people", "a", {"email": "a@x", "bio": "running"}))
    with pytest.raises(EngineError, match="SCHEMA_VIOLATION"):
        t.activate([CollectionDefinition("people", PEOPLE.indexes, schema={"required": ["age"]})])
    t.activate([CollectionDefinition("people", [*PEOPLE.indexes, Index("x", (IndexField("/x"),))])])
    assert t.query(QueryRequest("people").filter(Filter().missing("/x"))).rows[0]["id"] == "a"
    with pytest.raises(EngineError, match="FORBIDDEN"):
        t.collection("people", principal="bob")
    t.grant("bob", "people", ["read"])
    assert t.collection("people", principal="bob").df.count() == 1 and [d.name for d in t.collections("bob")] == ["people"]
    with pytest.raises(EngineError, match="FORBIDDEN"):
        t.mutate(Batch("no").delete("people", "a"), "bob")
    t.suspend()
    with pytest.raises(EngineError, match="SUSPENDED"):
        t.collection("people")
    t.suspend(False)
    events = t.audit(limit=100).collect()
    assert [e.ordinal for e in events] == list(range(1, len(events) + 1)) and {"activate", "load", "mutate", "archive", "policy"} == {e.action for e in events}
    assert t.schema()["schema_epoch"] == 2 and t.policy()["policy_epoch"] == 3


def test_dry_runs_limits_decoding_and_strict_audit(spark, tenant):
    from docquarry.operators import execute as ex

    t = tenant
    b = Batch("d").insert("people", "a", {"email": "a@x", "age": 3})
    before = t.manifest()["revision"]
    assert t.admit(b) == 1 and t.manifest()["revision"] == before
    with pytest.raises(EngineError, match="SCHEMA_VIOLATION"):
        t.admit(Batch("l").insert("people", "z", {"email": "z", "bio": "w" * 300}))
    t.mutate(b)
    rows = ex.rows(t.collection("people"), QueryRequest("people"))
    assert ex.decoded(rows, "email string, age int, nope string").first().doc.asDict() == {"email": "a@x", "age": 3, "nope": None}
    assert ex.within_budget(rows, 1).count() == 1
    with pytest.raises(EngineError, match="RESOURCE_EXHAUSTED"):
        ex.within_budget(rows, 0)
    assert t.limits()["max_batch_operations"] == 256
    t.activate([CollectionDefinition("secret", strict_read_audit=True)])
    t.query(QueryRequest("secret"))
    assert [e.detail for e in t.audit().where("action = 'read'").collect()] == ["secret"]


def test_loads_keep_constraints(spark, tenant):
    t = tenant
    for rows, code in [
        ([("a", '{"email":"x"}'), ("b", '{"email":"y"}'), ("b", '{"email":"z"}')], "CONFLICT"),
        ([("a", '{"email":"x"}'), ("b", '{"email":"x"}')], "UNIQUE_VIOLATION"),
        ([("a", '{"email":"x"}'), ("b", '{"age":4}')], "SCHEMA_VIOLATION"),
        ([("a", '{"email":"x"}'), ("b", '["email"]')], "SCHEMA_VIOLATION"),
        ([("a", '{"email":"x","bio":"' + "w" * 300 + '"}')], "SCHEMA_VIOLATION"),
        ([("a", '{"email":"' + "w" * (1 << 20) + '"}')], "QUOTA_EXCEEDED"),
        ([(None, '{"email":"x"}')], "INVALID_ARGUMENT"),
    ]:
        with pytest.raises(EngineError, match=code):
            t.load("people", spark.createDataFrame(rows, "id string, body string").repartition(2))
    assert ids(t) == [] and t.manifest()["revision"] == 1
    t.load("people", spark.createDataFrame([("a", '{"email":"x"}'), ("b", '{"email":"y"}')], "id string, body string"))
    assert ids(t) == ["a", "b"]


def test_large_staged_transactions_fold_and_keep_constraints(tenant):
    t = tenant
    tx = t.begin()
    for k in range(3):
        t.append(tx, k, Batch().operations + [{"op": "put", "collection": "people", "id": f"{k}-{i}", "body": {"email": f"{k}-{i}@x", "age": i}, "expected": "absent"} for i in range(100)])
    t.finalize(tx)
    held = t.manifest()["collections"]["people"]
    assert held["deltas"] == [] and len(held["base"]) == 1 and len(ids(t)) == 300
    clash = t.begin()
    for k in range(3):
        t.append(clash, k, [{"op": "put", "collection": "people", "id": f"n{k}-{i}", "body": {"email": "1-7@x" if k == 2 and i == 50 else f"n{k}-{i}@x"}, "expected": "any"} for i in range(100)])
    with pytest.raises(EngineError, match="UNIQUE_VIOLATION"):
        t.finalize(clash)
    swap = t.begin()
    for k in range(3):
        t.append(swap, k, [{"op": "patch", "collection": "people", "id": f"{k}-{i}", "patch": {"email": f"{(k + 1) % 3}-{i}@x"}, "expected": "any"} for i in range(100)])
    t.finalize(swap)
    assert t.documents("people", ["0-5"])["0-5"][1]["email"] == "1-5@x"


def test_writes_keep_text_indexes(spark, tenant, monkeypatch):
    from docquarry.operators import search
    from docquarry.operators.search import build_text_index
    from docquarry.plans.query import TextSearch
    from docquarry.sources import store

    monkeypatch.setattr(store, "MAX_DELTAS", 3)
    monkeypatch.setattr(search, "scanned", None)  # nothing may read the texts again
    t = tenant
    t.load("people", spark.createDataFrame([(f"{i}", '{"email":"%d@x","bio":"%s"}' % (i, ["baked bread", "bakes cakes", "sells fish"][i % 3])) for i in range(9)], "id string, body string"))
    find = lambda q, **kw: [r["id"] for r in t.query(QueryRequest("people").search(q)).rows]
    assert sorted(find(TextSearch("bio", "bake"))) == ["0", "1", "3", "4", "6", "7"]
    t.mutate(Batch("1").patch("people", "0", {"bio": "swims"}).delete("people", "1").put("people", "x", {"email": "x@x", "bio": "baking again, bake and bake"}))
    assert sorted(find(TextSearch("bio", "bake"))) == ["3", "4", "6", "7", "x"] and find(TextSearch("bio", "swimming")) == ["0"]
    t.mutate(Batch("2").patch("people", "x", {"bio": "rests"}))
    assert sorted(find(TextSearch("bio", "bake"))) == ["3", "4", "6", "7"]
    t.mutate(Batch("3").patch("people", "0", {"bio": None}))  # folds
    assert t.manifest()["collections"]["people"]["deltas"] == [] and find(TextSearch("bio", "swim")) == []
    assert sorted(find(TextSearch("bio", "bre").prefix())) == ["3", "6"] and sorted(find(TextSearch("bio", "caeks").fuzzy(1))) == ["4", "7"]
    kept = t.collection("people")
    fresh = build_text_index(kept, "bio", f"{t.files.root}/fresh")
    ranked = lambda s: [(r.id, round(r.score, 9)) for r in store.ex.rows(s, QueryRequest("people").search(TextSearch("bio", "bake bread"))).collect()]
    assert ranked(kept) == ranked(fresh) != []
    t.max_candidates = 3
    with pytest.raises(EngineError, match="RESOURCE_EXHAUSTED"):
        t.query(QueryRequest("people").search(TextSearch("bio", "bake")))
    with pytest.raises(EngineError, match="RESOURCE_EXHAUSTED"):
        t.query(QueryRequest("people").filter(Filter().exists("/email")))
    monkeypatch.setattr(search, "POSTINGS_A_CANDIDATE", 1)
    with pytest.raises(EngineError, match="postings"):
        t.query(QueryRequest("people").search(TextSearch("bio", "bake")))


def test_leases_expire_and_audit_pages_are_bound(spark, tmp_path):
    now = [1000]
    t = Tenant(spark, f"file://{tmp_path}/tenant", clock=lambda: now[0])
    t.activate([LOG])
    t.load("log", spark.createDataFrame([("a", '{"n":1}')], "id string, body string"))
    lease = t.lease(ttl_ms=50)
    frame = t.lease_frame(lease, "log")
    t.mutate(Batch("1").insert("log", "b", {"n": 2}))
    assert [r.id for r in frame.collect()] == ["a"] and t.lease_read(lease, "log", "a")[0] == 2
    now[0] = 1051
    for _ in range(2):
        with pytest.raises(EngineError, match="NOT_FOUND"):
            t.lease_scan(lease, "log")
    first, cursor = t.audit_page(limit=2)
    rest, end = t.audit_page(cursor, limit=2)
    assert [e["action"] for e in first + rest] == ["activate", "load", "mutate"] and t.audit_page(end)[0] == []
    t.grant("eve", "*", ["audit"])
    with pytest.raises(EngineError, match="INVALID"):
        t.audit_page(cursor, principal="eve")


def test_streams_read_a_file_at_a_time(spark, tenant, monkeypatch, request):
    from docquarry.streaming import feed as stream

    t = tenant
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    t.load("log", spark.range(500).repartition(5).selectExpr("lpad(id, 5, '0') as id", "concat('{\"n\":', id, '}') as body"))
    kept = stream._feed(t.files.root)
    assert len(stream._parts(t.files.root, kept, 0, kept["next"] - 1)) > 1
    register(spark)
    got = spark.read.format("docquarry_feed").option("path", t.files.root).option("startingSequence", 100).load()
    assert got.count() == 400 and dict(got.dtypes)["ordinal"] == "bigint"
    assert feed.frame(t, ["log"], 450).count() == 50


def test_group_bytes_are_bounded(spark, tenant, monkeypatch):
    from docquarry.sources import store

    t = tenant
    t.load("log", spark.range(30).selectExpr("lpad(id, 5, '0') as id", "concat('{\"n\":', id, '}') as body"))
    q = QueryRequest("log").group_by(["/n"]).aggregate("c", Aggregation.count())
    assert len(t.query(q)) == 30
    monkeypatch.setattr(store.ex, "MAX_GROUP_BYTES", 500)
    with pytest.raises(EngineError, match="RESOURCE_EXHAUSTED"):
        t.query(q)


def test_archives_are_bounded_and_verified(spark, tenant):
    import pyarrow.parquet as pq

    t = tenant
    revision = t.load("log", spark.range(60).selectExpr("lpad(id, 5, '0') as id", "concat('{\"n\":', id, '}') as body"))
    t.archive_documents = 59
    with pytest.raises(EngineError, match="RESOURCE_EXHAUSTED"):
        t.archive("a", "log", revision)
    assert t.collection("log").df.count() == 60 and t.files.names("cold/log") == []
    t.archive_documents = 60
    assert t.archive("a", "log", revision) == 60
    assert t.collection("log", archived=True).df.count() == 60 and t.collection("log").df.count() == 0
    parts = t.manifest()["collections"]["log"]["cold"]
    part = f"{t.files.root}/{parts[0]}".removeprefix("file://")
    whole = pq.read_table(part)
    changed = whole.set_column(whole.schema.get_field_index("body"), "body", [['{"n":0}'] * len(whole)])
    pq.write_table(changed, part)
    t.files.delete(f"{parts[0].rsplit('/', 1)[0]}/.{parts[0].rsplit('/', 1)[1]}.crc")
    with pytest.raises(Exception, match="CORRUPTED"):
        t.collection("log", archived=True).df.collect()
    t.files.delete(parts[0])
    with pytest.raises(Exception, match="(?i)not.*exist|not_found"):
        t.collection("log", archived=True).df.collect()
