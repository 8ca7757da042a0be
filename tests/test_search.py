import math

import pytest

from docquarry.functions import exact
from docquarry.functions import text as tx
from docquarry.operators import collection as c
from docquarry.operators import execute as ex
from docquarry.plans.definition import CollectionDefinition, Index, IndexField
from docquarry.plans.errors import EngineError
from docquarry.plans.query import Aggregation, Filter, QueryRequest, TextSearch


def col(spark, texts, analyzer, *more):
    d = CollectionDefinition("docs", [Index("t", (IndexField("/text"), *more), text=analyzer), Index("n", (IndexField("/n", "number"),))])
    rows = [(f"{i:03d}", 1, exact.dumps(t if isinstance(t, dict) else {"text": t, "n": i})) for i, t in enumerate(texts)]
    s = c.from_json(d, spark.createDataFrame(rows, "id string, version long, body string"))
    s.df = s.df.cache()
    return s


def hits(s, search, **changes):
    return [r.id for r in ex.rows(s, QueryRequest("docs").search(search)).collect()]


def test_stems():
    for word, want in {
        "running": "run", "runners": "runner", "ships": "ship", "shipping": "ship", "generously": "generous", "consistency": "consist", "relational": "relat", "hopping": "hop", "hoping": "hope",
        "knightly": "knight", "dying": "die", "skies": "sky", "cries": "cri", "ties": "tie", "agreed": "agre", "luxuriated": "luxuri", "happy": "happi", "by": "by", "say": "say", "controlled": "control",
        "national": "nation", "formalize": "formal", "electriciti": "electr", "adjustment": "adjust", "adoption": "adopt", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi", "analogi": "analog",
    }.items():
        assert tx.stem(word) == want, word


BAKERY = ["She was baking bread at dawn", "Two ovens bake all night", "Ovenproof dishes, oven gloves", "warm bread baked twice"]


def test_english_modes(spark):
    s = col(spark, BAKERY, "english_v1")
    assert sorted(hits(s, TextSearch("t", "bake"))) == ["000", "001", "003"]
    assert sorted(hits(s, TextSearch("t", "baking bread").phrase())) == ["000"]
    assert sorted(hits(s, TextSearch("t", "bread baked").phrase())) == ["003"]
    assert sorted(hits(s, TextSearch("t", "oven").prefix())) == ["001", "002"]
    assert sorted(hits(s, TextSearch("t", "ovenproof").prefix())) == ["002"]
    got = ex.group_envelopes(s, QueryRequest("docs").search(TextSearch("t", "bake")).filter(Filter().gte("/n", 1)).aggregate("n", Aggregation.count()))
    assert exact.dumps(got) == '[{"group":{},"values":{"n":2}}]'
    assert [r.id for r in ex.rows(s, QueryRequest("docs").search(TextSearch("t", "bake")).sort_desc("/n")).collect()] == ["003", "001", "000"]


def test_unicode_scores(spark):
    texts = ["ﬁsh", "fish FISH soup", "what the fish wrote home about the weather", "bread"]
    s = col(spark, texts, "unicode_v1")
    rows = ex.rows(s, QueryRequest("docs").search(TextSearch("t", "Fish"))).collect()
    sizes = [len(tx.words(t)) for t in texts]
    idf, mean = math.log(1 + (4 - 3 + 0.5) / 3.5), sum(sizes) / 4
    want = {f"{i:03d}": idf * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * sizes[i] / mean)) for i, tf in ((0, 1), (1, 2), (2, 1))}
    assert {r.id: pytest.approx(r.score) for r in rows} == want
    assert [r.id for r in rows] == sorted(want, key=lambda i: (-want[i], i))


def test_fuzzy_prefix_budget_and_errors(spark):
    s = col(spark, ["harbour", "harbor", "labour", "bread", "harobur"], "unicode_v1")
    assert sorted(hits(s, TextSearch("t", "harbour").fuzzy(1))) == ["000", "001", "004"]
    assert sorted(hits(s, TextSearch("t", "harbour").fuzzy(2))) == ["000", "001", "002", "004"]
    assert hits(s, TextSearch("t", "harbour").fuzzy(1))[0] == "000"
    for search, code in [(TextSearch("t", "harbour").fuzzy(3), "INVALID"), (TextSearch("t", "ox").fuzzy(1), "INVALID"), (TextSearch("t", "?!"), "INVALID"), (TextSearch("x", "a"), "INDEX_REQUIRED")]:
        with pytest.raises(EngineError, match=code):
            hits(s, search)
    many = col(spark, [f"crate{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(70)], "unicode_v1")
    with pytest.raises(EngineError, match="RESOURCE_EXHAUSTED"):
        hits(many, TextSearch("t", "crate").prefix())
    with pytest.raises(EngineError, match="UNAVAILABLE"):
        hits(col(spark, ["東京"], "japanese_v1"), TextSearch("t", "東京"))


def test_stored_index_answers_alike(spark, tmp_path):
    from docquarry.operators.search import build_text_index

    s = col(spark, BAKERY, "english_v1")
    stored = build_text_index(s, "t", str(tmp_path / "index"))
    for search in (TextSearch("t", "bake"), TextSearch("t", "baking bread").phrase(), TextSearch("t", "oven").prefix(), TextSearch("t", "braed").fuzzy(1)):
        want = [(r.id, round(r.score, 9)) for r in ex.rows(s, QueryRequest("docs").search(search)).collect()]
        assert want and [(r.id, round(r.score, 9)) for r in ex.rows(stored, QueryRequest("docs").search(search)).collect()] == want


def test_terms_match_within_one_field(spark):
    s = col(spark, [{"text": "red", "tags": ["blue"]}, {"text": "x", "tags": ["red", "blue"]}, {"text": None}, {}, {"text": "red blue"}], "unicode_v1", IndexField("/tags", "string_array"))
    assert sorted(hits(s, TextSearch("t", "red blue"))) == ["001", "004"]
    assert sorted(hits(s, TextSearch("t", "red blue").phrase())) == ["004"]
    assert hits(s, TextSearch("t", "green")) == []
