import itertools
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=800, deadline=None)
@given(st.text(alphabet="0123456789.@+-() ab%é\n", max_size=50))
def test_rules(text):
    assert pii.base_spans(text) == brute(text)


def test_rules_on_real_texts_and_luhn():
    import pyarrow.dataset as ds

    for text in ds.dataset("/root/testdata/sf0.01/documents.parquet").to_table()["text"].to_pylist():
        assert pii.base_spans(text) == brute(text)
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")


def model_of(rng, text, spans):
    m = pii.Model()
    for s in spans:
        for f in pii.span_features(text, s):
            m.weight.setdefault(f, rng.uniform(-0.6, 0.6))
    m.follow = {(a, b): rng.uniform(-1, 1) for a in pii.KINDS for b in pii.KINDS}
    return m


def segmentations(model, text, spans):
    for n in range(len(spans) + 1):
        for pick in itertools.combinations(sorted(spans, key=lambda s: s[1]), n):
            if all(x[2] <= y[1] for x, y in zip(pick, pick[1:])):
                v = sum(model.score(text, s) for s in pick)
                yield v + sum(model.follow[x[0], y[0]] for x, y in zip(pick, pick[1:]) if x[2] == y[1]), pick


@pytest.mark.parametrize("seed", range(6))
def test_sums_and_best_against_all_segmentations(seed):
    rng = random.Random(seed)
    text = ["ab 1.2.3.4 x", "+1 555-1234567 z", "call (12) 345-6789 now", "a@b.c.d e", "1.2.3.45.6.7.8", "12345678901234"][seed]
    spans = sorted({s for a, b in pii.regions(text) for s in pii.candidates(text, a, b)}, key=lambda s: (s[1], s[2], s[0]))[:14]
    model = model_of(rng, text, spans)
    every = list(segmentations(model, text, spans))
    z, p, pairs = pii.expectations(model, text, spans)
    whole = sum(math.exp(v) for v, _ in every)
    assert z == pytest.approx(math.log(whole))
    for s, q in zip(spans, p, strict=True):
        assert q == pytest.approx(sum(math.exp(v) for v, pick in every if s in pick) / whole)
    for k, q in pairs.items():
        want = sum(math.exp(v) * sum(x[2] == y[1] and (x[0], y[0]) == k for x, y in zip(pick, pick[1:])) for v, pick in every)
        assert q == pytest.approx(want / whole, abs=1e-12)
    if len(spans) < 14:
        best = model.best(text, 0, len(text))
        assert max(every)[0] == pytest.approx(next(v for v, pick in every if list(pick) == best))


@pytest.mark.parametrize("text", ["a@b.cc.d@e.ff", "1.2.3.45.6.7.8", "ab@c.de5.6.7.8", "+1 555-1234567 1.2.3.4"])
def test_best_of_random_models_with_negative_weights(text):
    spans = sorted({s for a, b in pii.regions(text) for s in pii.candidates(text, a, b)}, key=lambda s: (s[1], s[2], s[0]))
    picks = [pick for n in range(4) for pick in itertools.combinations(spans, n) if all(x[2] <= y[1] for x, y in zip(pick, pick[1:]))]
    for seed in range(150):
        rng = random.Random(seed)
        model = model_of(rng, text, spans)
        model.follow = {(a, b): rng.uniform(-3, 1) for a in pii.KINDS for b in pii.KINDS}
        value = lambda pick: sum(model.score(text, s) for s in pick) + sum(model.follow[x[0], y[0]] for x, y in zip(pick, pick[1:]) if x[2] == y[1])  # noqa: E731,B023
        best = model.best(text, 0, len(text))
        assert value(best) >= max(map(value, picks)) - 1e-9, (text, seed)


def test_windows_of_long_regions_cover_them_and_cut_no_span():
    text = "; ".join(f"u{i}@mail{i}.example.org 10.0.{i % 256}.{i % 7}" for i in range(300))
    got = list(pii.windows(text))
    assert "".join(w for _, w in got) == text and max(len(w) for _, w in got) < pii.WINDOW + pii.MAX_CHARS
    assert sum(len(pii.base_spans(w)) for _, w in got) == len(pii.base_spans(text)) == 600
    assert {s for s, _ in got} == {"email", "ip"} or {s for s, _ in got} == {"email"}
    assert [s for s, _ in pii.windows("we sold 12 units")] == ["none"]


def test_long_obfuscated_forms_are_candidates():
    for kind, s in (("email", "jane.doe7 (at) mail (dot) example (dot) co (dot) uk"), ("card", ".".join("4539578763621486"))):
        assert (kind, 0, len(s)) in set(pii.candidates(s, 0, len(s)))


def test_very_long_text_of_spans(spark):
    text = "reach me at a.b@c.example.org or 10.0.0.1 now " * 4000
    got = pii.digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got.n_email, got.n_ip) == (4000, 4000) and got.base_sha256 == pii.sha256_of(brute(text))


def test_field_finds_rewritten_entities_and_leaves_text_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = pii.train(docs)
    rng = random.Random(9)
    right = total = 0
    for row in docs.where("doc_id % 7 = 3").collect():
        for a, b in pii.regions(row.text):
            for text, truth in pii.examples(row.text[a:b], rng)[1:]:
                total += 1
                right += sorted(pii.find(text, model)[1]) == sorted(truth)
    assert total > 30 and right / total > 0.85, (right, total)
    assert pii.find("In 2024 we sold 1234 units at 12.5 percent, version 3.11.2, page 10-12", model)[1] == []


def test_frame(spark):
    rows = [(1, "Mail a.b@c.example.org or +1 (212) 555-0199, é 10.0.0.1!"), (1, "Mail a.b@c.example.org or +1 (212) 555-0199, é 10.0.0.1!"), (2, None), (3, ""), (None, "4539 5787 6362 1486")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = pii.digests(df).collect()
    assert len(got) == 5
    for r, (_, t) in zip(sorted(got, key=lambda r: r.doc_id or 0), sorted(rows, key=lambda r: r[0] or 0)):
        assert r.base_sha256 == pii.sha256_of(brute(t)) and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == s[0] for s in brute(t)) for k in pii.KINDS)
    out = pii.mask(df)
    assert out.columns == df.columns
    assert {r.text for r in out.collect()} == {"Mail [EMAIL] or [PHONE], é [IP]!", None, "", "[CARD]"}
    assert pii.digests(df.limit(0)).count() == 0 and pii.mask(df.limit(0)).count() == 0
