"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text, case folded, is a row of code points; its runs of 3 to 6 characters
are hashed to 2**20 features, each either present or not.  Training:

1. At most `sample_per_class` labelled ids of each class (of those among the
   documents given, the ones with the smallest hash) give the features of their whole texts; the
   labels are joined by broadcast, which that bound makes safe.
2. r = log((p + 1) / (P + 2)) - log((q + 1) / (Q + 2)) over the documents of
   either class that have a feature, counted over all training rows; the
   `n_features` with the largest evidence |p / P - q / Q| |r| stay, of equal
   ones those with the lower hash.
3. A logistic regression with an L2 penalty is fitted on presence times r, until
   its slope is flat.

The fitted table has a fixed size and is broadcast; scoring is a narrow map
over whole texts, cut into overlapping pieces so that a very long text needs
no more memory than its pieces.

Defined cases: null text is empty; an empty text gets the bias alone; a label
that is null is no label; an id labelled twice takes the larger label; a
repeated document is a repeated training row; without a row of each class, as
with an empty table of labels, every score is 0; an empty table of documents
gives no rows; columns named score or predicted are replaced, others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import counter_sum, gathered, sliced, small_batches, with_columns
from .storage import written
from .text import mix

ORDERS = (3, 4, 5, 6)
BITS = 20
SAMPLE_PER_CLASS = 3000
#: More features reach the same order of texts but fewer toxic ones at 0.5; see the README.
N_FEATURES = 4096
L2 = 1e-3
PIECE = 1 << 15

_U = np.uint64


@dataclass
class Model:
    weight: np.ndarray  # float32 of each feature that stays
    slot: np.ndarray  # int32 by hash: its feature, or -1
    bias: float

    def scores(self, texts: list[str | None]) -> list[float]:
        out = []
        for text in texts:
            seen = np.flatnonzero(present(text, self.slot, len(self.weight)))
            z = self.bias + float(self.weight[seen].sum(dtype=np.float64))
            out.append(float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0)))))
        return out


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """Feature hashes of all n-grams of a row of code points."""
    x = mix(codes.astype(_U) + _U(1))
    out = []
    run = x
    for n in range(2, max(ORDERS) + 1):
        if len(codes) < n:
            break
        run = run[:-1] * _U(0x9E3779B97F4A7C15) + x[n - 1 :]
        if n in ORDERS:
            h = run ^ (run >> _U(29))
            out.append(((h * _U(0xBF58476D1CE4E5B9 + 2 * n)) >> _U(64 - BITS)).astype(np.int32))
    return out


def _pieces(text: str | None):
    """Overlapping pieces of the case-folded text between marks of its ends."""
    text = f" {(text or '').lower()} " if text else ""
    over = max(ORDERS) - 1
    for at in range(0, max(1, len(text) - over), PIECE):
        yield np.frombuffer(text[at : at + PIECE + over].encode("utf-32-le", "surrogatepass"), np.uint32)


def features(text: str | None) -> np.ndarray:
    """The distinct hashed n-grams of a whole text."""
    found = np.zeros(0, np.int32)
    for codes in _pieces(text):
        found = np.unique(np.concatenate([found, *_hashes(codes)]))
    return found


def present(text: str | None, slot: np.ndarray, n: int) -> np.ndarray:
    """Which of the model's n features a whole text has, as a mask."""
    mask = np.zeros(n + 1, bool)
    for codes in _pieces(text):
        for h in _hashes(codes):
            mask[slot[h]] = True  # -1 marks the spare last place
    return mask[:-1]


def training_rows(docs: DataFrame, labels: DataFrame, sample_per_class: int, label: str, doc_id: str, text: str) -> DataFrame:
    """y and the features of at most sample_per_class labelled rows of each class."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg((F.max(label) > 0).cast("int").alias("__y"))
    known = known.join(docs.select(F.col(f"`{doc_id}`").alias("__id")), "__id", "left_semi")  # labels of other documents take no place
    order = F.xxhash64("__id", F.lit(17))
    chosen = known.where("__y = 1").orderBy(order, "__id").limit(sample_per_class).unionAll(known.where("__y = 0").orderBy(order, "__id").limit(sample_per_class))
    texts = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    rows = texts.join(F.broadcast(chosen), "__id").select(F.col("__y").alias("y"), "__text")

    def kernel(batches):
        for batch in sliced(batches, 64):
            made = [features(t) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "features": pa.array(made, pa.list_(pa.int32()))})

    small_batches(rows)
    return rows.mapInArrow(kernel, "y int, features array<int>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample_per_class: int = SAMPLE_PER_CLASS, n_features: int = N_FEATURES) -> Model | None:
    """The model, or None unless both classes have a training row.

    Pass only the rows of docs that may be learned from.
    """
    rows = written(training_rows(docs, labels, sample_per_class, label, doc_id, text), "toxicity")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return None

    def count(counters: np.ndarray, batch: pa.RecordBatch) -> None:
        for y, lists in zip(batch.column("y").to_pylist(), batch.column("features"), strict=True):
            counters[(y << BITS) + lists.values.to_numpy()] += 1  # a row's features are distinct

    q, p = gathered(counter_sum(rows, 2 << BITS, count), 2 << BITS).reshape(2, -1)
    ratios, best = selected(p, q, pos, neg, n_features)
    if not len(best):
        return None
    slot = np.full(1 << BITS, -1, np.int32)
    slot[best] = np.arange(len(best))
    kept = spark_broadcast(rows, slot)

    def narrow(batches):
        for batch in (part for given in batches for part in sliced([given], 64)):
            lists = batch.column("features")
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            at = kept.value[lists.flatten().to_numpy()]
            mask = np.zeros((len(lists), len(best) + 1), bool)
            mask[row, at] = True  # -1 marks the spare last place
            bits = np.packbits(mask[:, :-1], axis=1)
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "bits": pa.array([b.tobytes() for b in bits], pa.binary())})

    found = rows.mapInArrow(narrow, "y int, bits binary").toArrow()
    data = sorted(zip(found["y"].to_pylist(), found["bits"].to_pylist(), strict=True))
    has = [np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(best))).astype(np.int32) for _, bits in data]
    weight, bias = logistic(has, ratios, np.array([y for y, _ in data], float))
    return Model((weight * ratios).astype(np.float32), slot, bias)


def selected(p: np.ndarray, q: np.ndarray, pos: int, neg: int, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """The log-count ratios of the features with the largest evidence, and their hashes in order."""
    ratio = np.log((p + 1) / (pos + 2)) - np.log((q + 1) / (neg + 2))
    evidence = np.where(p + q > 0, np.abs(p / pos - q / neg) * np.abs(ratio), 0)
    best = np.lexsort((np.arange(len(p)), -evidence))[:n_features]
    best = np.sort(best[evidence[best] > 0])
    return ratio[best], best


def spark_broadcast(df: DataFrame, value):
    return df.sparkSession.sparkContext.broadcast(value)


def logistic(has: list[np.ndarray], ratios: np.ndarray, y: np.ndarray, l2: float = L2, rounds: int = 300) -> tuple[np.ndarray, float]:
    """The least of the mean logistic loss plus l2/2 |w|^2 over presence times ratio; both classes weigh the same.

    Limited-memory BFGS from 0, until no slope is above 1e-6.
    """
    n = len(ratios)
    size = np.array([len(h) + 1 for h in has])
    at = np.concatenate([np.append(h, n) for h in has]).astype(np.int32)  # the bias is one more feature of every row
    starts = np.cumsum(size) - size
    scale = np.append(ratios, 1.0)
    pull = np.append(np.full(n, l2), 0.0)
    share = np.where(y > 0, 0.5 / max(float(y.sum()), 1), 0.5 / max(float(len(y) - y.sum()), 1))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.add.reduceat((w * scale)[at], starts)
        value = float((share * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (pull * w * w).sum())
        err = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * share
        return value, np.bincount(at, np.repeat(err, size), n + 1) * scale + pull * w

    w = np.zeros(n + 1)
    value, slope = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(slope).max() < 1e-6:
            break
        way, parts = slope.copy(), []
        for s, g, r in reversed(past):
            parts.append(r * (s @ way))
            way -= parts[-1] * g
        if past:
            s, g, _ = past[-1]
            way *= (s @ g) / (g @ g)
        for (s, g, r), part in zip(past, reversed(parts), strict=True):
            way += (part - r * (g @ way)) * s
        step, down = (1.0 if past else 1 / max(1.0, float(np.linalg.norm(slope)))), float(slope @ way)
        while True:
            new = w - step * way
            new_value, new_slope = loss(new)
            if new_value <= value - 1e-4 * step * down or step < 1e-10:
                break
            step /= 2
        if step < 1e-10:
            break
        s, g = new - w, new_slope - slope
        if s @ g > 1e-14:
            past = [*past[-9:], (s, g, 1 / (s @ g))]
        w, value, slope = new, new_value, new_slope
    return w[:n], float(w[n])


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with `score` (0 to 1) and `predicted` (score >= 0.5). A narrow map."""
    if model is None:
        return docs.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))
    shared = spark_broadcast(docs, model)

    def kernel(fitted: Model, texts: list) -> dict[str, pa.Array]:
        s = fitted.scores(texts)
        return {"score": pa.array(s, pa.float64()), "predicted": pa.array([int(v >= 0.5) for v in s], pa.int32())}

    return with_columns(docs, text, kernel, "score double, predicted int", lambda: shared.value)


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")) % 5


def folds_scored(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Per document doc_id, held_out, score and predicted; learned from the rows that are not held out."""
    docs = docs.select("doc_id", "text")
    model = fit(docs.where(fold() != 0), labels, **settings)
    scored = score(docs, model)
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents that the classifier does not call toxic; columns as given."""
    model = fit(docs.select("doc_id", "text").where(fold() != 0), labels, **settings)
    kept = [F.col(f"`{c}`") for c in docs.columns]
    scored = score(docs.select(F.struct(*kept).alias("__doc"), F.col("text").alias("__text")), model, "__text")
    return scored.where("predicted = 0").select("__doc.*")
