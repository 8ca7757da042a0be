"""LM scoring with Brown classes: exchange clustering and a class bigram model.

Tokens are the words between spaces and ASCII white space, A-Z folded, then one
end of text.  What is learned, over all training texts:

1. Counts of all tokens, a distributed table.  The TOP most frequent words, each
   at least one token in LEAST_SHARE, are handed to the executors; every other
   word is rare: none of them makes up more than one token in TOP.
2. The texts as codes, two bytes a token: the place of a frequent word, or the
   spelling kind of a rare one, beside the rare words themselves.  All that
   follows reads these instead of cutting the texts again.
3. Pair counts of the symbols: the CORE most frequent words, RARE_KINDS kinds of
   other words, and the end, which also stands before the first word.
4. Classes of the core by exchange: each word in turn moves to the class in
   which the class bigram likelihood is greatest, until a sweep moves none
   (SWEEPS at most).  Each kind, and the end, is a class of its own.
5. Every other word that occurs LEAST_COUNT times joins the class in which its
   own occurrences, between the classes before and behind them, are likeliest:
   the frequent ones from counters of a fixed size, the rare ones each from its
   own occurrences, dealt out by word and summed as a stream.  No word is left
   out for want of room; only words that occur less often stay with their kind.
6. Class bigrams over all texts with the classes of all words.

A token's probability is
  LAMBDA T(class | class before) E(word | class) + (1 - LAMBDA) U(word),
U the add-half unigram probability, E the share of the word among its class by
add-half counts, T the class bigram with add-one-half-times-class-share
smoothing.

Defined cases: null text is empty (one token, the end); an empty table gives no
rows; without training texts every count is 0; repeated rows count as often as
they stand; equal counts go by the word, equal likelihoods to the class of the
lower number; a very long text is one row of codes, two bytes a token; columns
whose names are those of results are replaced, others stay.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batch_rows, counter_sum, gathered, sliced, small_batches
from .storage import drop, written
from .text import FOLD, encoded

CORE = 2032
CLASSES = 64
SWEEPS = 100
LAMBDA = 0.75
TOP = 50_000
#: A frequent word makes up at least one in so many tokens; so there are never more than that many to choose from.
LEAST_SHARE = 1 << 20
RARE_KINDS = 8
#: Words outside the core that occur so often get a class.
LEAST_COUNT = 3
#: Above every class.
OPEN = 128
#: A rare word that the training texts do not have; its class is that of its kind.
NONE = 255
#: All classes: those of the exchange, the kinds and the end.
ALL = CLASSES + RARE_KINDS + 1
END_CLASS = ALL - 1
SYMBOLS = 1 << 11  # core words, rare kinds and the end: at most
PAIRS = SYMBOLS * SYMBOLS
#: The code of a rare word is this plus its kind; frequent words have lower codes.
RARE = (1 << 16) - RARE_KINDS
END = b"\n"  # no word is one
#: Distinct words that one task counts before it hands them on.
HELD_WORDS = 400_000
#: Texts, or their codes, that a kernel sees at once.
TEXTS = 64


def tokens(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; the end is not among them. Bytes split at exactly space and 9 to 13."""
    return encoded(text).translate(FOLD).split()


def kind(word: bytes) -> int:
    """The kind of a rare word: letters beyond ASCII, signs, length."""
    ascii_ = word.isascii()
    return (not ascii_) * 4 + (not word.isalnum() if ascii_ else word.translate(None, _SIGNS) != word) * 2 + (len(word) > 7)


_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, c) over all rows, the end of text among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words, counts = list(held), list(held.values())
            held.clear()
            for at in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_pydict({"word": pa.array(words[at : at + 50_000], pa.string()), "c": pa.array(counts[at : at + 50_000], pa.int64())})

        for batch in sliced(batches, TEXTS):
            for t in batch.column("text").to_pylist():
                held.update(tokens(t))
                if len(held) > HELD_WORDS:
                    yield from out()
            held[END] += batch.num_rows
        yield from out()

    small_batches(docs)
    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def exchange(pairs: np.ndarray, fixed: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """The class of each symbol under pairs[a, b], counts of b after a.

    Symbols with fixed >= 0 keep that class (above `classes`); the others start
    by rank modulo `classes` and move to where sum n log n over class pairs,
    less that over class sizes on both sides, is largest.
    """
    n = len(pairs)
    total = int(max(fixed.max(initial=-1) + 1, classes))
    label = np.where(fixed >= 0, fixed, np.arange(n) % classes)
    hot = np.zeros((n, total))
    hot[np.arange(n), label] = 1
    after = pairs @ hot  # of each symbol: the classes behind it
    before = pairs.T @ hot
    table = hot.T @ after

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    for _ in range(sweeps):
        moved = 0
        for w in np.flatnonzero(fixed < 0):
            here, own = label[w], pairs[w, w]
            right, left = after[w].copy(), before[w].copy()
            if not right.any() and not left.any():
                continue
            table[here] -= right
            table[:, here] -= left
            table[here, here] += own
            right[here] -= own
            left[here] -= own
            rows, cols = table.sum(axis=1) + left, table.sum(axis=0) + right  # with w back in any class
            base = f(table)
            gain = (f(table + right) - base).sum(axis=1) + (f(table + left[:, None]) - base).sum(axis=0)
            diag = np.diag(table)
            gain += f(diag + right + left + own) - f(diag + right) - f(diag + left) + f(diag)
            out, into = right.sum() + own, left.sum() + own
            gain -= f(rows + out) - f(rows) + f(cols + into) - f(cols)
            gain[classes:] = -np.inf
            best = int(gain.argmax())
            if gain[best] <= gain[here] + 1e-9:
                best = here
            right[here] += own
            left[here] += own
            if best != here:
                moved += 1
                label[w] = best
                column, row = pairs[:, w], pairs[w]
                after[:, here] -= column
                after[:, best] += column
                before[:, here] -= row
                before[:, best] += row
                right, left = after[w], before[w]
            table[best] += right
            table[:, best] += left
            table[best, best] -= own
        if not moved:
            break
    return label


@dataclass
class Model:
    """What scoring needs beside the table of rare words; its size is fixed."""

    total: int  # N
    distinct: int  # V
    place: dict[bytes, int]  # of the frequent words and the end, which is last
    count: np.ndarray  # by place
    classes: np.ndarray  # by place
    core: int  # places below this are clustered by exchange
    size: np.ndarray  # of a class: sum of (count + 1/2), the unseen word of a kind included
    transition: np.ndarray  # T over classes

    @property
    def whole(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def log_classes(self, classes: np.ndarray) -> np.ndarray:
        """For each token of some texts, one behind the other, log10 of its probability less log10(c + 1/2)."""
        previous = np.concatenate([[END_CLASS], classes[:-1]])  # each text ends with the end, which stands before the next
        return np.log10(LAMBDA * self.transition[previous, classes] / self.size[classes] + (1 - LAMBDA) / self.whole)


def _together(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of some texts one behind the other, and where each text starts."""
    data = column.to_pylist()
    width = np.dtype(kind).itemsize
    ends = np.cumsum([len(d) // width for d in data])
    return np.frombuffer(b"".join(data), kind), np.concatenate([[0], ends[:-1]]).astype(np.int64)


def _opened(docs: DataFrame, place: dict[bytes, int], text: str, names: list[str]) -> DataFrame:
    """(doc, row, codes, rare): columns `names` as a struct, a code for each token, the rare words in order."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    shared = docs.sparkSession.sparkContext.broadcast(place)
    doc = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(0).alias("none"))
    given = docs.select(doc.alias("doc"), F.monotonically_increasing_id().alias("row"), F.col(f"`{text}`").alias("text"))
    schema = StructType([*given.schema.fields[:2], *_parse_datatype_string("struct<codes binary, rare array<string>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in sliced(batches, TEXTS):
            codes, rare = [], []
            for t in batch.column("text").to_pylist():
                words = tokens(t)
                at = [known.get(w) for w in words]
                own = [w for w, a in zip(words, at, strict=True) if a is None]
                row = np.array([RARE if a is None else a for a in at] + [known[END]], "<u2")
                row[row == RARE] += np.array([kind(w) for w in own], "<u2")
                codes.append(row.tobytes())
                rare.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("row"), pa.array(codes, pa.binary()), pa.array(rare, pa.list_(pa.string()))], names=[f.name for f in schema])

    small_batches(docs)
    return written(given.mapInArrow(run, schema), "opened")


def train(docs: DataFrame, text: str = "text") -> tuple[Model, DataFrame]:
    """The model and the table of the rare words (word, c, cls); cls is a class of the exchange, or that of the word's kind."""
    counted = _counted(docs, text)
    opened = _opened(docs, counted.place, text, [])
    model, words = _learned(opened, counted)
    return _with_transitions(model, _coded(opened, model, words)), words


def _counted(docs: DataFrame, text: str) -> Model:
    """N, V and the frequent words."""
    counts = written(word_counts(docs, text), "words")
    totals = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    is_end = F.col("word") == END.decode()
    frequent = F.col("c") * LEAST_SHARE >= int(totals["n"] or 0)
    top = counts.where(~is_end & frequent).orderBy(F.desc("c"), "word").limit(TOP).collect()
    ends = counts.where(is_end).first()
    drop(counts)
    place = {r["word"].encode(): i for i, r in enumerate(top)}
    place[END] = len(top)
    c = np.array([*[r["c"] for r in top], ends["c"] if ends else 0], np.int64)
    kinds = np.array([*[CLASSES + kind(r["word"].encode()) for r in top], END_CLASS])
    return Model(int(totals["n"] or 0), int(totals["v"] or 0), place, c, kinds, min(CORE, len(top)), np.zeros(ALL), np.zeros((ALL, ALL)))


def _learned(opened: DataFrame, counted: Model) -> tuple[Model, DataFrame]:
    """The model with the classes of all words, and the table of the rare words."""
    core, top, end = counted.core, len(counted.count) - 1, counted.core + RARE_KINDS
    kinds = counted.classes
    symbol = np.zeros(1 << 16, np.int64)
    symbol[: top + 1] = [*range(core), *(core + kinds[core:top] - CLASSES), end]
    symbol[RARE:] = core + np.arange(RARE_KINDS)

    def pair(counters: np.ndarray, batch: pa.RecordBatch) -> None:
        for part in sliced([batch], TEXTS):
            codes, _ = _together(part.column("codes"), "<u2")
            row = np.concatenate([[end], symbol[codes]])
            np.add.at(counters, row[:-1] * SYMBOLS + row[1:], 1)

    pairs = gathered(counter_sum(opened.select("codes"), PAIRS, pair), PAIRS).reshape(SYMBOLS, SYMBOLS)[: end + 1, : end + 1].astype(np.float64)
    fixed = np.full(end + 1, -1)
    fixed[core:] = CLASSES + np.arange(RARE_KINDS + 1)
    label = exchange(pairs, fixed, CLASSES, SWEEPS)
    hot = np.zeros((end + 1, ALL))
    hot[np.arange(end + 1), label] = 1
    table = hot.T @ pairs @ hot
    c = counted.count.astype(np.float64)
    size = np.zeros(ALL)
    np.add.at(size, label[:core], c[:core] + 0.5)
    clustered = size[:CLASSES].copy()
    smooth = _smoothed(table, np.maximum(clustered, 0.5).tolist() + [1.0] * (RARE_KINDS + 1))
    classes = np.concatenate([label[:core], kinds[core:]])

    # the frequent words outside the core, from counters of what stands on either side of each
    around = np.zeros(1 << 16, np.int64)
    around[: top + 1] = classes
    around[RARE:] = CLASSES + np.arange(RARE_KINDS)
    middle = top - core

    def sides(counters: np.ndarray, batch: pa.RecordBatch) -> None:
        for part in sliced([batch], TEXTS):
            codes, _ = _together(part.column("codes"), "<u2")
            own = np.flatnonzero((codes >= core) & (codes < top))
            cls = np.concatenate([[END_CLASS], around[codes]])
            at = (codes[own].astype(np.int64) - core) * 2 * ALL
            np.add.at(counters, at + cls[own], 1)
            np.add.at(counters, at + ALL + cls[own + 2], 1)

    if middle:
        found = gathered(counter_sum(opened.select("codes"), middle * 2 * ALL, sides), middle * 2 * ALL).reshape(middle, 2, ALL)
        n = c[core:top]
        likely = found[:, 0] @ _before(smooth) + found[:, 1] @ _behind(smooth)
        classes[core:top] = np.where(n >= LEAST_COUNT, _likeliest(likely, n, clustered), kinds[core:top])
        around[core:top] = classes[core:top]
        np.add.at(size, classes[core:top], n + 0.5)
    with batch_rows(opened.sparkSession, 10_000):
        words = written(_assigned(opened, around, smooth, clustered), "rare")
    for r in words.groupBy("cls").agg(F.sum(F.col("c") + 0.5).alias("mass")).collect():
        size[r["cls"]] += r["mass"]
    size[CLASSES:END_CLASS] += 0.5
    size[END_CLASS] = c[-1] + 0.5
    return Model(counted.total, counted.distinct, counted.place, counted.count, classes, core, np.maximum(size, 0.5), smooth), words


def _before(transition: np.ndarray) -> np.ndarray:
    """For the class before a word, the log likelihood of each class of the word."""
    return np.log(transition)[:, :CLASSES]


def _behind(transition: np.ndarray) -> np.ndarray:
    return np.log(transition)[:CLASSES].T


def _likeliest(likely: np.ndarray, n: np.ndarray, clustered: np.ndarray) -> np.ndarray:
    """The class of each word: its n occurrences share the class with what is in it."""
    n = np.asarray(n, np.float64)[:, None]
    return (likely - n * np.log(clustered + n + 0.5)).argmax(axis=1)


def _smoothed(table: np.ndarray, size) -> np.ndarray:
    """T from class bigram counts; a class without words gets no share of what is smoothed."""
    size = np.asarray(size)
    share = np.where(size > 0, table.sum(axis=0) + 0.5, 0)
    share /= share.sum()
    strength = 0.5 * np.count_nonzero(size)
    return (table + strength * share) / (table.sum(axis=1, keepdims=True) + strength)


def _assigned(opened: DataFrame, around: np.ndarray, transition: np.ndarray, clustered: np.ndarray) -> DataFrame:
    """(word, c, cls) of the rare words.

    Each occurrence goes to its word's task with the classes on both sides;
    there the occurrences of a word, sorted, are summed as they come.
    """

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, TEXTS):
            codes, _ = _together(batch.column("codes"), "<u2")
            own = np.flatnonzero(codes >= RARE)
            cls = np.concatenate([[END_CLASS], around[codes]])
            yield pa.RecordBatch.from_arrays([batch.column("rare").flatten(), pa.array((cls[own] * OPEN + cls[own + 2]).astype(np.int32))], names=["word", "around"])

    before, behind = _before(transition), _behind(transition)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, n, likely = None, 0, np.zeros(CLASSES)  # of the last word so far

        def made(words: list[str], n: np.ndarray, likely: np.ndarray) -> pa.RecordBatch:
            kinds = np.array([CLASSES + kind(w.encode()) for w in words], np.int64)
            cls = np.where(n >= LEAST_COUNT, _likeliest(likely, n, clustered), kinds)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64()), pa.array(cls, pa.int32())], names=["word", "c", "cls"])

        for batch in batches:
            if not batch.num_rows:
                continue
            words, at = batch.column("word"), batch.column("around").to_numpy()
            turn = pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(turn) + 1])
            sums = np.add.reduceat(before[at // OPEN] + behind[at % OPEN], starts)
            counts = np.diff(np.append(starts, len(words)))
            own = words.take(pa.array(starts)).to_pylist()
            if own[0] == word:
                sums[0] += likely
                counts[0] += n
            elif word is not None:
                yield made([word], np.array([n]), likely[None])
            if len(own) > 1:
                yield made(own[:-1], counts[:-1], sums[:-1])
            word, n, likely = own[-1], counts[-1], sums[-1].copy()
        if word is not None:
            yield made([word], np.array([n]), likely[None])

    met = opened.select("codes", "rare").mapInArrow(occurrences, "word string, around int")
    return met.repartition("word").sortWithinPartitions("word").mapInArrow(summed, "word string, c bigint, cls int")


def _coded(opened: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """(doc, n, known, logs, codes): tokens, known tokens, sum of log10(c + 1/2), the class of each token as a byte."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    shared = opened.sparkSession.sparkContext.broadcast((model.count, model.classes))
    schema = StructType([opened.schema["doc"], *_parse_datatype_string("struct<n bigint, known bigint, logs double, codes binary>").fields])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, own = shared.value
        cls = np.zeros(1 << 16, np.uint8)
        cls[: len(own)] = own
        cls[RARE:] = CLASSES + np.arange(RARE_KINDS)
        logs = np.zeros(1 << 16)
        logs[: len(count)] = np.log10(count + 0.5)
        known = np.zeros(1 << 16, np.int64)
        known[: len(count)] = count > 0
        for batch in sliced(batches, TEXTS):
            codes, starts = _together(batch.column("codes"), "<u2")
            classes = cls[codes]
            rare = np.flatnonzero(codes >= RARE)
            found = batch.column("found").flatten().to_numpy() % 256
            classes[rare] = np.where(found == NONE, classes[rare], found)
            out = [classes[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(codes)], strict=True)]
            n = np.diff(np.append(starts, len(codes)))
            arrays = [pa.array(n, pa.int64()), pa.array(np.add.reduceat(known[codes], starts) + batch.column("seen").to_numpy()), pa.array(np.add.reduceat(logs[codes], starts) + batch.column("more").to_numpy()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *arrays], names=[f.name for f in schema])

    rare = opened.select("row", F.posexplode("rare").alias("pos", "word"))
    c = F.coalesce(F.col("c"), F.lit(0))
    place = F.col("pos").cast("long") * 256 + F.coalesce(F.col("cls"), F.lit(NONE))
    own = rare.join(words, "word", "left").groupBy("row").agg(F.sum(F.log10(c + 0.5)).alias("more"), F.sum((c > 0).cast("long")).alias("seen"), F.sort_array(F.collect_list(place)).alias("found"))
    met = opened.select("doc", "row", "codes").join(own, "row", "left").select("doc", "codes", F.coalesce("more", F.lit(0.0)).alias("more"), F.coalesce("seen", F.lit(0)).alias("seen"), F.coalesce("found", F.expr("cast(array() as array<bigint>)")).alias("found"))
    return written(met.mapInArrow(close, schema), "coded")


def _with_transitions(model: Model, coded: DataFrame) -> Model:
    """The model with the class bigrams of the texts of _coded()."""

    def count(counters: np.ndarray, batch: pa.RecordBatch) -> None:
        for part in sliced([batch], TEXTS):
            classes, _ = _together(part.column("codes"), "u1")
            row = np.concatenate([[END_CLASS], classes]).astype(np.int64)
            np.add.at(counters, row[:-1] * OPEN + row[1:], 1)

    table = gathered(counter_sum(coded.select("codes"), OPEN * OPEN, count), OPEN * OPEN).reshape(OPEN, OPEN)[:ALL, :ALL].astype(np.float64)
    return replace(model, transition=_smoothed(table, model.size))


def score(docs: DataFrame, model: Model, words: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with n_tokens, n_known, train_tokens, base_score and score."""
    names = [c for c in keep or docs.columns if c.lower() not in ("n_tokens", "n_known", "train_tokens", "base_score", "score")]
    return _scored(_coded(_opened(docs, model.place, text, names), model, words), model)


def _scored(coded: DataFrame, model: Model) -> DataFrame:
    """What score() returns, of the texts of _coded()."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    light = replace(model, place={}, count=np.zeros(0), classes=np.zeros(0))
    shared = coded.sparkSession.sparkContext.broadcast(light)
    out = StructType([*coded.drop("codes").schema.fields, *_parse_datatype_string("struct<classes double>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in sliced(batches, TEXTS):
            classes, starts = _together(batch.column("codes"), "u1")
            made = pa.array(np.add.reduceat(m.log_classes(classes.astype(np.int64)), starts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "n", "known", "logs")), made], names=[f.name for f in out])

    return coded.mapInArrow(run, out).select(
        "doc.*",
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n") * math.log10(model.whole)).alias("base_score"),
        (F.col("logs") + F.col("classes")).alias("score"),
    )


def perplexity(score: str = "score", n: str = "n_tokens"):
    """The column of a text's perplexity."""
    return F.pow(F.lit(10.0), -F.col(score) / F.col(n))


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text leaves 1 modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")) % 5 == 1


def digests(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text").withColumn("held_out", held_out())
    counted = _counted(docs.where("not held_out"), "text")
    opened = _opened(docs, counted.place, "text", ["doc_id", "held_out"])
    model, words = _learned(opened.where("not doc.held_out"), counted)
    coded = _coded(opened, model, words)
    drop(opened)
    drop(words)
    return _scored(coded, _with_transitions(model, coded.where("not doc.held_out")))
