import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docquarry.llm import lm

WORD = re.compile("[^\x20\x09-\x0d]+")


def toks(t):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), "\n"]


def test_tokens():
    for t in ["A b\x0bc\x0cd\x1ce\x85 f", "É À  x", "", None, "\n\r\t "]:
        assert [w.decode() for w in lm.tokens(t)] == toks(t)[:-1]


def likelihood(pairs, label):
    hot = np.eye(label.max() + 1)[label]
    t = hot.T @ pairs @ hot
    f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
    return f(t) - f(t.sum(0)) - f(t.sum(1))


def test_exchange_climbs_and_ends_in_a_local_optimum():
    rng = np.random.default_rng(2)
    pairs = rng.poisson(0.4, (40, 40)).astype(float)
    pairs[:20, 20:] += rng.poisson(6, (20, 20))
    fixed = np.full(40, -1)
    fixed[-1] = 5
    start = np.where(fixed >= 0, fixed, np.arange(40) % 4)
    end = lm.exchange(pairs, fixed, 4, 50)
    assert likelihood(pairs, end) > likelihood(pairs, start)
    assert end[-1] == 5 and end[:-1].max() < 4
    for w in range(39):
        for c in range(4):
            other = end.copy()
            other[w] = c
            assert likelihood(pairs, other) <= likelihood(pairs, end) + 1e-6


class Plain:
    """The model of some texts by loops over tokens and dictionaries."""

    def __init__(self, texts):
        texts = [toks(t) for t in texts]
        self.count = Counter(w for t in texts for w in t)
        self.n, self.v = sum(self.count.values()), len(self.count)
        ranked = sorted((w for w in self.count if w != "\n"), key=lambda w: (-self.count[w], w.encode()))[: lm.TOP]
        core = ranked[: lm.CORE]
        kind = lambda w: lm.CLASSES + lm.kind(w.encode())
        place = {w: i for i, w in enumerate(core)}
        end = len(core) + lm.RARE_KINDS
        symbol = lambda w: end if w == "\n" else place[w] if w in place else len(core) + lm.kind(w.encode())
        pairs = np.zeros((end + 1, end + 1))
        for t in texts:
            for x, y in zip(["\n", *t], t):
                pairs[symbol(x), symbol(y)] += 1
        fixed = np.array([-1] * len(core) + [lm.CLASSES + i for i in range(lm.RARE_KINDS + 1)])
        label = lm.exchange(pairs, fixed, lm.CLASSES, lm.SWEEPS)
        self.cls = {w: int(label[i]) for w, i in place.items()} | {"\n": lm.END_CLASS}
        of = lambda w: self.cls.get(w, kind(w))
        mass = [sum(self.count[w] + 0.5 for w in core if self.cls[w] == k) for k in range(lm.CLASSES)]
        first = self.transition([*[max(m, 0.5) for m in mass], *[1.0] * (lm.RARE_KINDS + 1)], [[of(w) for w in t] for t in texts])
        for group in (ranked[lm.CORE :], [w for w in self.count if w not in ranked and w != "\n"]):
            around = {w: [] for w in group}
            for t in texts:
                for x, y, z in zip(["\n", *t], t, t[1:]):
                    if y in around:
                        around[y].append((of(x), of(z)))
            for w, each in around.items():
                n = len(each)
                if n >= lm.LEAST_COUNT:
                    likely = [sum(math.log(first[x][k]) + math.log(first[k][z]) for x, z in each) - n * math.log(mass[k] + n + 0.5) for k in range(lm.CLASSES)]
                    around[w] = int(np.argmax(np.round(likely, 9)))
                else:
                    around[w] = kind(w)
            self.cls |= around
        self.size = [0.0] * lm.CLASSES + [0.5] * lm.RARE_KINDS + [0.0]
        for w, k in self.cls.items():
            self.size[k] += self.count[w] + 0.5
        self.size[lm.END_CLASS] = self.count["\n"] + 0.5
        self.size = [max(x, 0.5) for x in self.size]
        self.of = of
        self.t = self.transition(self.size, [[of(w) for w in t] for t in texts])

    @staticmethod
    def transition(size, texts):
        table = np.zeros((lm.ALL, lm.ALL))
        for t in texts:
            for x, y in zip([lm.END_CLASS, *t], t):
                table[x, y] += 1
        share = np.array([table[:, k].sum() + 0.5 if size[k] > 0 else 0 for k in range(lm.ALL)])
        strength = 0.5 * sum(x > 0 for x in size)
        return [(row + strength * share / share.sum()) / (row.sum() + strength) for row in table]

    def unigram(self, w):
        return (self.count[w] + 0.5) / (self.n + 0.5 * (self.v + 1))

    def probability(self, before, w):
        k = self.of(w)
        return lm.LAMBDA * self.t[self.of(before)][k] * (self.count[w] + 0.5) / self.size[k] + (1 - lm.LAMBDA) * self.unigram(w)

    def score(self, text):
        t = toks(text)
        return sum(math.log10(self.probability(x, y)) for x, y in zip(["\n", *t], t))


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def rows_of_words():
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"W{int(x)}" for x in np.minimum(rng.zipf(1.3, i % 37), 900))) for i in range(300)]
    rows += [(1000 + i, f"the {['cat', 'dog', 'été'][i % 3]} sat {i % 9}") for i in range(60)]
    return rows + [(None, None), (7, "only here été!"), (900, ""), (2, "long " * 3000 + "end"), (3, " \t\n")]


def test_digests_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "TOP", 40)
    monkeypatch.setattr(lm, "CORE", 15)
    rows = rows_of_words()
    df = spark.createDataFrame([(*r, 9.5, 1) for r in rows], "doc_id long, text string, score double, row int").repartition(3)
    plain = Plain([t for i, t in rows if not held(i)])
    want = Counter()
    for i, t in rows:
        w = toks(t)
        base = sum(math.log10(plain.unigram(x)) for x in w)
        want[i, held(i), len(w), sum(plain.count[x] > 0 for x in w), plain.n, round(base, 6), round(plain.score(t), 6)] += 1
    got = lm.digests(df).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    assert len({plain.cls[w] for w in plain.cls}) > 12


def test_train_and_score_apart_and_probabilities_add_up(spark, monkeypatch):
    monkeypatch.setattr(lm, "TOP", 30)
    monkeypatch.setattr(lm, "CORE", 10)
    rows = [r for r in rows_of_words() if not held(r[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    model, words = lm.train(df)
    plain = Plain([t for _, t in rows])
    other = [(1, "W1 W2 unseen W3"), (2, None), (3, "W1 W1 W1")]
    got = lm.score(spark.createDataFrame([(*r, 0, "c") for r in other], "doc_id long, text string, n_tokens int, codes string"), model, words).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "codes", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    assert {r.doc_id: round(r.score, 7) for r in got} == {i: round(plain.score(t), 7) for i, t in other}
    assert model.transition.sum(axis=1) == pytest.approx(1)
    unseen = ["q", "qqqqqqqqq", "q!", "qqqqqqqqqq!", "öq", "öqqqqqqqqq", "öq!", "öqqqqqqqqq!"]  # one of each kind
    assert [lm.kind(w.encode()) for w in unseen] == list(range(8))
    for before in ["W1", "W2", "q", "\n"]:
        classes = sum(plain.t[plain.of(before)][plain.of(w)] * (plain.count[w] + 0.5) / plain.size[plain.of(w)] for w in [*plain.count, *unseen])
        assert classes == pytest.approx(sum(plain.t[plain.of(before)][k] for k in {plain.of(w) for w in [*plain.count, *unseen]}), abs=1e-9)


def test_better_than_unigrams_on_held_out_texts(spark):
    rows = lm.digests(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert rows.s > rows.b
    print("perplexity", 10 ** (-rows.s / rows.n), "of unigrams", 10 ** (-rows.b / rows.n))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.digests(df).count() == 0
    assert [(r.n_known, r.train_tokens) for r in lm.digests(spark.createDataFrame([(1, "a b")], "doc_id long, text string").where("doc_id < 0")).collect()] == []


def test_without_training_texts(spark):
    i = next(i for i in range(99) if held(i))
    r = lm.digests(spark.createDataFrame([(i, "a b")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and r.base_score == pytest.approx(0)
    assert math.isfinite(r.score)


def test_words_outside_the_core_get_classes_by_what_stands_around_them(spark, monkeypatch):
    monkeypatch.setattr(lm, "CORE", 6)
    monkeypatch.setattr(lm, "TOP", 8)
    rows = [(i, f"aa n{i % 40} bb" if i % 2 else f"cc m{i % 40} dd") for i in range(400)] + [(1000 + i, "aa bb cc dd ee ff") for i in range(20)] + [(2000, "once")]
    model, words = lm.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    cls = {r["word"]: r["cls"] for r in words.collect()}
    cls |= {w.decode(): int(model.classes[i]) for w, i in model.place.items()}
    n, m = ({cls[f"{side}{k}"] for k in range(first, 40, 2)} for side, first in (("n", 1), ("m", 0)))
    assert len(n) == len(m) == 1 and n != m and max(n | m) < lm.CLASSES
    assert cls["once"] == lm.CLASSES + lm.kind(b"once")
    usual, odd = lm.score(spark.createDataFrame([(1, "aa n1 bb"), (2, "aa m0 bb")], "doc_id long, text string"), model, words).orderBy("doc_id").collect()
    assert usual.score > odd.score + 0.5
