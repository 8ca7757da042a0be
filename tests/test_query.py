import json
import random
from decimal import Decimal, localcontext
from fractions import Fraction

import pytest

from docquarry.functions import exact, pointer
from docquarry.operators import collection as c
from docquarry.operators import execute as ex
from docquarry.plans.definition import CollectionDefinition, Index, IndexField
from docquarry.plans.errors import EngineError
from docquarry.plans.query import Aggregation, Filter, QueryRequest, TextSearch


def col(spark, docs, *fields, ids=None):
    d = CollectionDefinition("docs", [Index(f"i{k}", (f,)) for k, f in enumerate(fields)])
    rows = [(ids[i] if ids else f"{i:03d}", 1, t if isinstance(t, str) else exact.dumps(t)) for i, t in enumerate(docs)]
    return c.from_json(d, spark.createDataFrame(rows, "id string, version long, body string"))


def hits(source, where, scan=False):
    return [r.id for r in ex.rows(source, QueryRequest("docs").filter(where).limit(1000).allow_scan(scan)).collect()]


def test_grammar_round_trips_and_messages():
    text = '{"collection":"parcels","filter":{"/code":-0.5e-40,"/weight":{"lte":72057594037927937.25}},"aggregate":{"mean":{"avg":"/weight","scale":5}}}'
    assert QueryRequest.decode(text).encode() == text
    for bad, message in [
        ({"depot": "north"}, "`/depot`"), ({"$and": [{"/a": 1}]}, "without `$`"), ({"lt": 8}, "inside a field condition"), ({"/weight": {"above": 2}}, "unknown filter operator `above`"),
        ({"/depot": {"nin": "north"}}, "`nin` requires an array"), ({"/depot": {"exists": 1}}, "true or false"), ({"/depot": ["north"]}, "cannot be an array"),
        ({"/depot": {}}, "at least one operator"), ({"and": []}, "at least one filter"), (["/depot"], "must be an object"),
    ]:
        with pytest.raises(EngineError, match="INVALID_ARGUMENT") as e:
            QueryRequest.decode(json.dumps({"collection": "parcels", "filter": bad}))
        assert message in str(e.value)
    for text in [
        '{"collection":"parcels","filter":{"/depot":"n","/depot":"s"}}', '{"collection":"parcels","sort":["weight"]}', '{"collection":"parcels","colour":1}',
        '{"collection":"parcels","aggregate":{"w":{"max":"*"}}}', '{"collection":"parcels",}',
    ]:
        with pytest.raises(EngineError):
            QueryRequest.decode(text)
    f = Filter().lte("/weight", 30).gte("/weight", 2).gt("/weight", 4).lt("/weight", 25)
    assert f.fields["/weight"] == {"lte": 30, "gte": 2} and [g.fields["/weight"] for g in f.conjuncts] == [{"gt": 4}, {"lt": 25}]
    assert (Filter().gt("/weight", 4) & Filter().lte("/weight", 30)).to_json() == {"/weight": {"gt": 4, "lte": 30}}
    assert Filter.or_([]).to_json() == {"not": {}}
    q = QueryRequest("parcels").search(TextSearch("label", "fragile").fuzzy(1)).group_by(["/depot"]).aggregate("parcels", Aggregation.count()).aggregate("mean", Aggregation.avg("/weight", 3))
    assert QueryRequest.decode(q.encode()) == QueryRequest.decode(QueryRequest.decode(q.encode()).encode())


def test_random_filters_against_plain_evaluation(spark):
    rng = random.Random(41)
    docs = []
    for _ in range(130):
        doc = {"depot": rng.choice(["north", "south", "quay"]), "weight": rng.randrange(-9, 60), "marks": rng.sample(["fragile", "cold", "return", "heavy"], rng.randrange(4))}
        if rng.random() < 0.75:
            doc["floor"] = rng.choice([None, 0, 1, 2, 17])
        docs.append(doc)
    s = col(spark, docs, IndexField("/weight", "number"), IndexField("/depot"), IndexField("/marks", "string_array"), IndexField("/floor", "number"))
    leaves = [
        (Filter().eq("/depot", "quay"), lambda d: d["depot"] == "quay"),
        (Filter().gt("/weight", -2).lte("/weight", 33), lambda d: -2 < d["weight"] <= 33),
        (Filter().contains("/marks", "cold"), lambda d: "cold" in d["marks"]),
        (Filter().eq("/floor", None), lambda d: "floor" in d and d["floor"] is None),
        (Filter().ne("/floor", 2), lambda d: d.get("floor") != 2),
        (Filter().missing("/floor"), lambda d: "floor" not in d),
        (Filter().not_in("/weight", [0, Decimal("14.00"), 51]), lambda d: d["weight"] not in (0, 14, 51)),
        (Filter().is_in("/floor", [17, None]), lambda d: "floor" in d and d["floor"] in (17, None)),
        (Filter().gte("/floor", Decimal("0.75")), lambda d: d.get("floor") is not None and d["floor"] >= 0.75),
    ]
    for _ in range(12):
        (f, p), (g, q), (h, r) = rng.sample(leaves, 3)
        for where, want in [(~f & g, lambda d: not p(d) and q(d)), (Filter.or_([f, ~g, h]), lambda d: p(d) or not q(d) or r(d)), (f & ~(g | h), lambda d: p(d) and not (q(d) or r(d)))]:
            assert hits(s, where) == [f"{i:03d}" for i, d in enumerate(docs) if want(d)]
    for where, want in leaves[:6]:
        bare = c.Collection(CollectionDefinition("docs"), s.df.select("id", "version", "body"))
        assert hits(bare, where, scan=True) == hits(s, where) == [f"{i:03d}" for i, d in enumerate(docs) if want(d)]


def test_absent_null_and_empty_members_and_types(spark):
    bodies = ['{"seal":"red","marks":["cold","cold"]}', '{"seal":null}', '{"marks":[]}', '{"seal":"","marks":null}', '{"other":0}', '{"seal":"blue","marks":["heavy"]}']
    s = col(spark, bodies, IndexField("/seal"), IndexField("/marks", "string_array"))
    assert hits(s, Filter().eq("/seal", None)) == ["001"]
    assert hits(s, Filter().missing("/seal")) == ["002", "004"]
    assert hits(s, Filter().exists("/marks")) == ["000", "002", "003", "005"]
    assert hits(s, Filter().ne("/seal", "red")) == ["001", "002", "003", "004", "005"]
    assert hits(s, Filter().gt("/seal", "")) == ["000", "005"] and hits(s, Filter().eq("/seal", "")) == ["003"]
    assert hits(s, Filter().eq("/marks", None)) == ["003"] and hits(s, Filter().contains("/marks", "cold")) == ["000"]
    empty = col(spark, [], IndexField("/weight", "number"))
    for where in (Filter().eq("/weight", "heavy"), Filter().lte("/weight", None), Filter().gt("/weight", 3).lte("/weight", False), Filter().contains("/weight", 3), Filter().eq("/weight", {"kg": 1}), Filter().is_in("/weight", [1, "one"])):
        with pytest.raises(EngineError, match="INVALID_ARGUMENT"):
            hits(empty, where)
    with pytest.raises(EngineError, match="INDEX_REQUIRED"):
        hits(empty, Filter().eq("/depot", "quay"))
    got = ex.group_envelopes(empty, QueryRequest("docs").aggregate("rows", Aggregation.count()).aggregate("most", Aggregation.max("/weight")).aggregate("all", Aggregation.sum("/weight")))
    assert exact.dumps(got) == '[{"group":{},"values":{"rows":0,"most":null,"all":0}}]'
    assert ex.group_envelopes(empty, QueryRequest("docs").group_by(["/weight"]).aggregate("rows", Aggregation.count())) == []


def test_exact_numbers_wide_and_fixed(spark):
    texts = ["31415926535897932384626433832.75", "31415926535897932384626433833", "-2e-45", "7e-800", "12.50", "12.5"]
    s = col(spark, [f'{{"n":{t},"d":"{t}"}}' for t in texts], IndexField("/n", "number", wide=True), IndexField("/d", "decimal", wide=True))
    order = [r.id for r in ex.rows(s, QueryRequest("docs").sort_desc("/n")).collect()]
    assert order == [f"{i:03d}" for i in sorted(range(6), key=lambda i: (Decimal(texts[i]).copy_negate(), i))]
    assert hits(s, Filter().eq("/d", "12.5000")) == ["004", "005"]
    assert hits(s, Filter().lte("/n", Decimal("7.0e-800"))) == ["002", "003"]
    got = ex.group_envelopes(s, QueryRequest("docs").filter(Filter().gte("/n", 100)).aggregate("n", Aggregation.sum("/n")).aggregate("d", Aggregation.sum("/d")).aggregate("mean", Aggregation.avg("/n", 6)))
    with localcontext(prec=60):
        total = sum(map(Decimal, texts[:2]))
        mean = exact.plain(total / 2)
    assert exact.dumps(got) == f'[{{"group":{{}},"values":{{"n":{total},"d":"{total}","mean":{mean}}}}}]'
    with pytest.raises(Exception, match="wide"):
        ex.rows(col(spark, ['{"n":4e-35}'], IndexField("/n", "number")), QueryRequest("docs")).collect()


def half_even(total, n, scale):
    """By exact fractions: the nearest multiple of 10**-scale, of two the even one."""
    at = Fraction(total) / n * 10**scale
    low = at.numerator // at.denominator
    rest = at - low
    up = rest > Fraction(1, 2) or rest == Fraction(1, 2) and low % 2
    return Decimal(low + bool(up)).scaleb(-scale)


@pytest.mark.parametrize("scale", [0, 1, 3])
def test_half_even_averages(spark, scale):
    rng = random.Random(scale)
    for _ in range(12):
        n = rng.choice([2, 4, 8, 3])
        values = [Decimal(rng.randrange(-4000, 4000)).scaleb(-rng.randrange(5)) for _ in range(n - 1)]
        values.append(half_even(sum(values), 1, scale) + Decimal(n * (2 * rng.randrange(9) + 1)).scaleb(-scale) / 2 - sum(values))  # the mean ends in a half
        s = col(spark, [f'{{"n":{exact.plain(v)}}}' for v in values], IndexField("/n", "number"))
        got = ex.group_envelopes(s, QueryRequest("docs").aggregate("a", Aggregation.avg("/n", scale)))
        assert Decimal(exact.dumps(got[0]["values"]["a"])) == half_even(sum(values), n, scale), values


def test_groups_sort_select(spark):
    bodies = ['{"depot":"quay","n":-1}', '{"n":40}', '{"depot":"north"}', '{"depot":null,"n":2}', '{"depot":"quay","n":6}', '{"depot":"north","n":null}', '{"depot":"quay","n":6}']
    s = col(spark, bodies, IndexField("/depot"), IndexField("/n", "number"))
    q = QueryRequest("docs").group_by(["/depot"]).aggregate("rows", Aggregation.count()).aggregate("has", Aggregation.count_of("/n")).aggregate("all", Aggregation.sum("/n")).aggregate("least", Aggregation.min("/n"))
    got = {exact.dumps(g["group"]): exact.dumps(g["values"]) for g in ex.group_envelopes(s, q)}
    assert got == {
        "{}": '{"rows":1,"has":1,"all":40,"least":40}',
        '{"depot":null}': '{"rows":1,"has":1,"all":2,"least":2}',
        '{"depot":"north"}': '{"rows":2,"has":0,"all":0,"least":null}',
        '{"depot":"quay"}': '{"rows":3,"has":3,"all":11,"least":-1}',
    }
    assert [r.id for r in ex.rows(s, QueryRequest("docs").sort_desc("/n")).collect()] == ["001", "004", "006", "003", "000", "005", "002"]
    assert [r.id for r in ex.rows(s, QueryRequest("docs").sort_asc("/depot").limit(4)).collect()] == ["001", "003", "002", "005"]
    body = '{"route":{"from":"quay","via":null,"legs":[{"km":3},{"km":8}],"van":{"plate":"X 1","driver":{"id":77}}},"km/h":{"a~b":false},"notes":{},"paid":12.40}'
    one = col(spark, [body])
    q = QueryRequest("docs").select(["/route/van/driver", "/route/via", "/route/legs/1/km", "/km~1h/a~0b", "/notes/first", "/paid/cents", "/gone"])
    assert json.loads(ex.rows(one, q).first().body) == {"route": {"van": {"driver": {"id": 77}}, "via": None}, "km/h": {"a~b": False}}
    with pytest.raises(EngineError):
        ex.rows(one, QueryRequest("docs").select(["/route/van/plate", "/route/van"]))
    assert hits(one, Filter().eq("/route/legs/1/km", 8), scan=True) == ["000"]
    assert pointer.resolve(json.loads(body), ["route", "legs", "0"], arrays=False) is pointer.MISSING
    with pytest.raises(Exception, match="RESOURCE_EXHAUSTED"):
        ex.groups(s, QueryRequest("docs").group_by(["/n"]).aggregate("rows", Aggregation.count()), max_groups=3).collect()
