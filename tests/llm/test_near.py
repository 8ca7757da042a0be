import random
import re

import numpy as np

from docquarry.llm import graph, near


def w5(t):
    w = re.findall(r"\w+", (t or "").lower())
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def test_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(5)
    hits, wanted = 0, 0.0
    for _ in range(60):
        h = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = np.unique(h[:250]), np.unique(h[50:])
        wa, wb = (a % np.uint64(3) + np.uint64(1)).astype(float), (b % np.uint64(3) + np.uint64(1)).astype(float) * rng.choice([0.8, 1, 2])
        wanted += near.weighted_jaccard((a, wa), (b, wb)) * near.BANDS * near.ROWS
        hits += int((near.samples(a, wa) == near.samples(b, wb)).sum())
    assert abs(hits - wanted) / wanted < 0.06


def corpus():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    rows, truth, k = [], {}, 0
    for group in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([60, 120, 400]))]
        for copy in range(rng.choice([1, 1, 2, 5, 20]) if group else 60):
            w = list(base)
            if copy % 3:
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((k, " ".join(w)))
            k += 1
    return rows


def components(rows):
    sets = {i: w5(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    text = dict(rows)
    for i in sets:
        for j in sets:
            if i < j and (text[i] == text[j] and text[i] is not None or sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in sets}


def test_classes_against_brute_force(spark):
    rows = corpus() + [(9001, None), (9002, None), (9003, ""), (9004, ""), (9005, "..."), (9006, "one two"), (9007, "One, two!")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, id int, key string").repartition(3)
    flat = near.Weights(np.zeros(0, np.int64), np.zeros(0))  # without document frequencies it is plain multiset similarity
    got = {r["id"]: r.class_id for r in near.classes(df, weights=flat).collect()}
    assert got == components(rows)
    kept = near.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.text or "" for r in kept.where("doc_id > 9000").collect()) == ["", "", "", "...", kept.where("text like '%two%'").first().text]


def test_repeats_null_ids_and_empty(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "lonely text"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.class_id or -1) for r in near.digests(df).collect()) == [(-1, -1), (-1, -1), (-1, 5), (5, 5), (5, 5)]
    assert near.digests(df.limit(0)).count() == 0
    assert near.one_of_each(df.limit(0)).count() == 0


def family(seed, size, words, edits, vocab=3000):
    """Copies of one text with random words replaced, the original missing."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(vocab)}" for _ in range(words)]
    rows = []
    for k in range(size):
        w = list(base)
        for at in rng.sample(range(words), edits):
            w[at] = f"w{rng.randrange(vocab)}"
        rows.append((k, " ".join(w)))
    return rows


def classes_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r["id"]: r.class_id for r in near.classes(df, weights=near.Weights(np.zeros(0, np.int64), np.zeros(0))).collect()}


def test_every_link_just_above_the_threshold_is_found(spark):
    for seed in (0, 2):
        rows = family(seed, 60, 200, 3)
        assert classes_of(spark, rows) == components(rows)


def test_links_between_the_blocks_of_a_group_are_found(spark, monkeypatch):
    monkeypatch.setattr(near, "SKETCH_BLOCK", 7)
    monkeypatch.setattr(near, "TEXT_BLOCK", 4)
    rows = family(2, 60, 200, 3)
    assert classes_of(spark, rows) == components(rows)


def brute_classes(rows, weights):
    """Classes by the weighted Jaccard similarity of every pair."""
    own = {i: weights.of(w) for (i, _), w in zip(rows, near.word_hashes([t for _, t in rows]))}
    up = {i: i for i in own}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in own:
        for j in own:
            if i < j and near.weighted_jaccard(own[i], own[j]) >= near.THRESHOLD:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in own}


def test_buckets_and_families_of_several_blocks_with_document_frequencies(spark, monkeypatch):
    monkeypatch.setattr(near, "SKETCH_BLOCK", 100)
    monkeypatch.setattr(near, "TEXT_BLOCK", 32)
    rng = random.Random(12)
    line = [f"common{k}" for k in range(60)]
    rows = family(5, 320, 120, 4) + [(1000 + i, " ".join(line + [f"w{rng.randrange(900)}" for _ in range(34)])) for i in range(300)]
    for i in range(60):  # near copies among texts that share much
        words = rows[320 + i][1].split()
        words[70 + i % 20] = "changed"
        rows.append((2000 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    weights = near.inverse_frequencies(df)
    assert len(weights.bucket)
    got = {r["id"]: r.class_id for r in near.classes(df).collect()}
    want = brute_classes(rows, weights)
    assert got == want
    assert len(set(want.values())) > 100


def test_hot_group_of_copies_is_one_class(spark):
    rows = family(7, 1500, 100, 1, vocab=10**6)
    df = spark.createDataFrame([*rows, (5000, rows[0][1])], "doc_id long, text string").repartition(3)
    assert {r.class_id for r in near.classes(df).collect()} == {0}


def test_very_long_text(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:150_000], "x", *words[150_000:]])), (3, " ".join(words[:1000])), (4, "short text")]
    got = {r["id"]: r.class_id for r in near.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_components_of_a_path_in_order(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(150)] + [(1000, 1001)], "a long, b long")
    got = graph.components(edges).collect()
    assert len(got) == 153 and len({r.root for r in got}) == 2
    assert len({r.root for r in got if r.node < 1000}) == 1
