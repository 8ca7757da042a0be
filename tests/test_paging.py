import random

import pytest

from docquarry.functions import exact
from docquarry.operators import collection as c
from docquarry.operators import execute as ex
from docquarry.operators import paging as pg
from docquarry.plans.definition import CollectionDefinition, Index, IndexField
from docquarry.plans.errors import EngineError
from docquarry.plans.query import Aggregation, Filter, QueryRequest


@pytest.fixture(scope="module")
def source(spark):
    rng = random.Random(3)
    d = CollectionDefinition("docs", [Index("walk", (IndexField("/scope"), IndexField("/at"), IndexField("/no", "number")), unique=True), Index("v", (IndexField("/v", "number"),))])
    docs = []
    for i in range(120):
        body = {"scope": "ab"[i % 2], "at": f"2024-{i % 7:02d}", "no": i, "v": rng.choice([None, 1, 2, 3])}
        if i % 11 == 0:
            del body["at"]
        if i % 13 == 0:
            body["at"] = None
        docs.append((f"{i:04d}", 1, exact.dumps(body)))
    s = c.from_json(d, spark.createDataFrame(docs, "id string, version long, body string").repartition(3))
    s.df = s.df.cache()
    return s


@pytest.mark.parametrize("descending", [False, True])
def test_pages_together_equal_the_whole(source, descending):
    q = QueryRequest("docs").filter(Filter().ne("/scope", "c"))
    q = q.sort_desc("/v") if descending else q.sort_asc("/v").sort_desc("/at")
    whole = [r.id for r in ex.rows(source, q.limit(1000)).collect()]
    assert [r["id"] for r in pg.query_all(source, q.limit(17))] == whole and len(whole) == 120
    small = pg.page(source, q.limit(1000), max_bytes=900)
    assert 1 < len(small.rows) < 30 and small.more
    with pytest.raises(EngineError, match="RESOURCE_EXHAUSTED"):
        pg.page(source, q, max_bytes=10)


def test_cursor_binding(source):
    q = QueryRequest("docs").limit(5)
    token = pg.page(source, q).cursor
    with pytest.raises(EngineError, match="INVALID_ARGUMENT"):
        pg.page(source, q.sort_asc("/v").cursor(token))
    with pytest.raises(EngineError, match="INVALID_ARGUMENT"):
        pg.page(source, q.cursor(token), pg.Caller("other"))
    with pytest.raises(EngineError, match="CURSOR_EXPIRED"):
        pg.page(source, q.cursor(token), pg.Caller(policy_epoch=1))
    with pytest.raises(EngineError, match="CURSOR_EXPIRED"):
        pg.page(source, q.cursor(token), pg.Caller(clock=lambda: 10**15))
    with pytest.raises(EngineError, match="INVALID_ARGUMENT"):
        pg.page(source, q.cursor("zz"))


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("bounds", [{}, {"gte": "2024-01", "lt": "2024-05"}])
def test_seek_walks(source, descending, bounds):
    f = Filter().eq("/scope", "a")
    for op, v in bounds.items():
        f = f._with("/at", op, v)
    q = QueryRequest("docs").filter(f).paging("seek").limit(7)
    for p in ("/at", "/no"):
        q = q.sort_desc(p) if descending else q.sort_asc(p)
    got = [r["id"] for r in pg.query_all(source, q)]
    rows = [exact.loads(r.body) | {"id": r.id} for r in source.df.collect()]
    want = [r for r in rows if r["scope"] == "a" and "at" in r and (not bounds or (r["at"] is not None and "2024-01" <= r["at"] < "2024-05"))]
    want.sort(key=lambda r: (r["at"] is not None, r["at"] or "", r["no"]), reverse=descending)
    assert got == [r["id"] for r in want]


def test_seek_shapes_and_expiry(source):
    good = QueryRequest("docs").filter(Filter().eq("/scope", "a")).sort_asc("/at").sort_asc("/no").paging("seek").limit(3)
    for bad in (good.sort_desc("/scope"), good.filter(Filter().eq("/v", 1)), QueryRequest("docs").sort_asc("/at").paging("seek")):
        with pytest.raises(EngineError, match="INDEX_REQUIRED|INVALID_ARGUMENT"):
            pg.page(source, bad)
    for bad in (good.filter(Filter.or_([Filter(), Filter()])), good.filter(Filter().contains("/no", 1))):
        with pytest.raises(EngineError, match="INVALID_ARGUMENT"):
            pg.page(source, bad)
    token = pg.page(source, good).cursor
    later = c.Collection(source.definition, source.df, source.revision + 1)
    with pytest.raises(EngineError, match="CURSOR_EXPIRED"):
        pg.page(later, good.cursor(token))
    with pytest.raises(EngineError):
        pg.page(source, QueryRequest("docs").aggregate("n", Aggregation.count()))
