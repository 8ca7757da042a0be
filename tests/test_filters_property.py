"""Random filters against plain evaluation, in one job: every filter is a column of the same collection."""

from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquarry.functions import exact, pointer
from docquarry.operators import collection as c
from docquarry.plans import bind
from docquarry.plans.definition import CollectionDefinition, Index, IndexField
from docquarry.plans.query import Filter, QueryRequest, check_shape

NUMBERS = [0, 1, 2, 10, -3, Decimal("1.5"), Decimal("1.50"), Decimal("-0.25"), Decimal("123456.789012")]
STRINGS = ["", "a", "b", "ab", "B", "\u00e9"]
DOCS = []
for i in range(60):
    body = {"n": [None, *NUMBERS][i % 10], "s": [None, *STRINGS][i % 7], "b": [None, True, False][i % 3], "t": [STRINGS[j] for j in range(6) if i >> j & 1], "d": str(NUMBERS[i % 9])}
    for k, name in enumerate("nsbtd"):
        if (i * 7 + k) % 6 == 0:
            del body[name]
        elif (i * 5 + k) % 11 == 0:
            body[name] = None
    DOCS.append(body)

PLACES = {"/n": NUMBERS, "/s": STRINGS, "/b": [True, False], "/d": [str(n) for n in NUMBERS]}


def leaf():
    def ops(path):
        value = st.sampled_from(PLACES[path])
        whole = st.fixed_dictionaries({}, optional={"gt": value, "lte": value}).filter(bool)
        one = st.one_of(
            value.map(lambda v: {"eq": v}), st.just({"eq": None}), value.map(lambda v: {"ne": v}), st.lists(st.one_of(value, st.none()), max_size=3).map(lambda v: {"in": v}),
            st.lists(value, max_size=3).map(lambda v: {"nin": v}), st.booleans().map(lambda v: {"exists": v}), whole,
        )
        return one.map(lambda o: Filter({path: o}))

    array = st.sampled_from(STRINGS).map(lambda v: Filter({"/t": {"contains": v}}))
    return st.one_of(st.sampled_from(sorted(PLACES)).flatmap(ops), array)


def filters():
    return st.recursive(
        leaf(),
        lambda inner: st.one_of(inner.map(lambda f: ~f), st.lists(inner, max_size=3).map(Filter.or_), st.tuples(inner, inner).map(lambda p: p[0] & p[1])),
        max_leaves=6,
    )


def plain(v, decimal):
    return None if v is None else v if isinstance(v, bool) else Decimal(v) if decimal or not isinstance(v, str) else v


def holds(f, body):
    def test(path, op, want):
        v = pointer.resolve(body, pointer.tokens(path))
        here, dec = v is not pointer.MISSING, path == "/d"
        if op == "exists":
            return here == want
        if op == "contains":
            return here and isinstance(v, list) and want in v
        if op in ("eq", "in"):
            return here and any(type(plain(v, dec)) is type(plain(w, dec)) and plain(v, dec) == plain(w, dec) for w in (want if op == "in" else [want]))
        if op in ("ne", "nin"):
            return not test(path, "in" if op == "nin" else "eq", want)
        if not here or v is None:
            return False
        x, y = plain(v, dec), plain(want, dec)
        return x > y if op == "gt" else x <= y

    return (
        all(test(p, op, w) for p, ops in f.fields.items() for op, w in ops.items())
        and all(holds(g, body) for g in f.conjuncts)
        and (f.alternatives is None or any(holds(g, body) for g in f.alternatives))
        and (f.negated is None or not holds(f.negated, body))
    )


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(filters(), min_size=10, max_size=10))
def test_random_filters(spark, wheres):
    fields = (IndexField("/n", "number"), IndexField("/s"), IndexField("/b", "boolean"), IndexField("/t", "string_array"), IndexField("/d", "decimal"))
    d = CollectionDefinition("docs", [Index(f.path, (f,)) for f in fields])
    rows = [(f"{i:02d}", 1, exact.dumps(b)) for i, b in enumerate(DOCS)]
    s = c.from_json(d, spark.createDataFrame(rows, "id string, version long, body string"))
    for w in wheres:
        check_shape(QueryRequest("docs", where=w))
        assert Filter.from_json(exact.loads(exact.dumps(w.to_json()))).to_json() is not None
    strict = [bind.predicate(w, lambda p: s.access(p, False)).alias(f"w{k}") for k, w in enumerate(wheres)]
    loose = [F.coalesce(bind.predicate(w, lambda p: s.access(p, False), filters=True), F.lit(False)).alias(f"v{k}") for k, w in enumerate(wheres)]
    for r in s.df.select("id", *strict, *loose).collect():
        want = [holds(w, DOCS[int(r.id)]) for w in wheres]
        assert [r[f"w{k}"] for k in range(len(wheres))] == want
        assert [r[f"v{k}"] for k in range(len(wheres))] == want
