import math
import random

import numpy as np

from docquarry.llm import toxicity as tx


def test_long_text_in_pieces_equals_whole(monkeypatch):
    text = "".join(chr(97 + i * 7 % 26) for i in range(5000)) + "é🙂 " * 50
    whole = tx.features(text)
    monkeypatch.setattr(tx, "PIECE", 64)
    assert np.array_equal(tx.features(text), whole)
    slot = np.full(1 << tx.BITS, -1, np.int32)
    slot[whole[:10]] = np.arange(10)
    assert tx.present(text, slot, 11).tolist() == [True] * 10 + [False]


def test_features_against_plain_counting():
    assert len(tx.features(None)) == len(tx.features("")) == 0
    grams = {f" abcd abcd "[i : i + n] for n in tx.ORDERS for i in range(12 - n)}
    assert len(tx.features("Abcd ABCD")) == len({g for g in grams})


def test_held_out_accuracy_on_a_table(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = tx.folds_scored(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.toxic == 1 and r.predicted == 1 for r in rows)
    assert hit / sum(r.toxic == 1 for r in rows) > 0.9
    assert hit / max(1, sum(r.predicted for r in rows)) > 0.97


def test_nulls_repeats_clashes_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "you idiot" if i % 2 else "kind word", 0.5) for i in range(40)] * 2 + [(None, None, None), (99, "", None)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    got = tx.folds_scored(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 82
    assert all(r.predicted == r.doc_id % 2 for r in got.where("doc_id < 40").collect())
    assert got.where("score is null or score < 0 or score > 1").count() == 0
    assert tx.folds_scored(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert tx.folds_scored(docs.limit(0), labels).count() == 0
    left = tx.without_toxic(docs, labels)
    assert left.columns == docs.columns and left.where("text = 'you idiot'").count() == 0 and left.where("text = 'kind word'").count() == 40


def test_labels_of_other_documents_take_no_place_in_the_sample(spark):
    docs = spark.createDataFrame([(i, "vile rotten words here" if i % 2 else "kind gentle words here") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, toxic int")
    rows = tx.training_rows(docs, labels, 8, "toxic", "doc_id", "text").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in rows} == {0: 8, 1: 8}


def plain_fit(texts, y, n_features, l2=tx.L2):
    """Ratios, choice and weights by loops and Newton's method."""
    has = [set(tx.features(t).tolist()) for t in texts]
    pos, neg = sum(y), len(y) - sum(y)
    table = {}
    for f in set().union(*has):
        p = sum(f in h for h, v in zip(has, y) if v)
        q = sum(f in h for h, v in zip(has, y) if not v)
        r = math.log((p + 1) / (pos + 2)) - math.log((q + 1) / (neg + 2))
        table[f] = abs(p / pos - q / neg) * abs(r), r
    best = sorted(sorted((f for f in table if table[f][0] > 0), key=lambda f: (-table[f][0], f))[:n_features])
    x = np.array([[table[f][1] * (f in h) for f in best] + [1.0] for h in has])
    share = np.array([0.5 / pos if v else 0.5 / neg for v in y])
    pull = np.array([l2] * len(best) + [0.0])
    w = np.zeros(len(best) + 1)
    for _ in range(60):
        s = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x.T * (share * s * (1 - s))) @ x + np.diag(pull), x.T @ (share * (s - y)) + pull * w)
        w -= step * min(1, 3 / np.linalg.norm(step))
    return best, w, x


def test_ratios_choice_and_weights_against_plain_loops(spark):
    rng = random.Random(3)
    bad, good = ["idiot", "vile", "rotten", "hate"], ["kind", "river", "bread", "lamp"]
    rows = [(i, " ".join(rng.choice(bad if rng.random() < (0.5 if i % 3 == 0 else 0.1) else good) for _ in range(rng.randrange(1, 7)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = tx.fit(docs, labels, n_features=25)
    best, w, x = plain_fit([t for _, t in rows], [int(i % 3 == 0) for i, _ in rows], 25)
    assert np.flatnonzero(model.slot >= 0).tolist() == best
    want = 1 / (1 + np.exp(-x @ w))
    assert np.allclose(model.scores([t for _, t in rows]), want, atol=2e-3)


def test_very_long_text(spark):
    docs = spark.createDataFrame([(i, ("you idiot " if i % 2 else "kind word ") * (20_000 if i > 37 else 2)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(36)], "doc_id long, toxic int")
    assert all(r.predicted == r.doc_id % 2 for r in tx.folds_scored(docs, labels).collect())
