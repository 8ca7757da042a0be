"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles.

Words are those of text.py, a shingle is SHINGLE of them (fewer, but not none,
make one).  The weight of a shingle in a text is its count there times its
inverse document frequency, 1 up to one document in RARE and falling with the
logarithm of the frequency to 1 - DAMPING for a shingle of all documents.  The
full logarithm (DAMPING = 1) would part real near copies: what large groups of
copies share weighs less there than their edits do (figures in the README).
Frequencies are counted over all documents, in 2**BUCKET_BITS hashed counters;
only those above N / RARE are handed to the executors, and as the frequencies
add up to N times the mean length there are at most RARE times the mean length
of them, whatever N.

Steps:

1. Equal texts become one node (key: md5 of the text) by a partial aggregate.
2. Each node gets BANDS hashes, each over ROWS consistent weighted samples.  At
   a weighted Jaccard similarity of 0.8 two texts share one with probability
   1 - (1 - 0.8**3)**16 = 0.99999.
3. Families: components of the pairs of a bucket (band, hash) whose samples
   agree in LEAST_ESTIMATE or more of all places.
4. Classes: components of the pairs of a family whose weighted Jaccard
   similarity, over whole texts, is THRESHOLD or more.

Steps 3 and 4 go the same way (`linked`).  A group of at most one block
(SKETCH_BLOCK samples, TEXT_BLOCK texts or BLOCK_BYTES of text) is compared in
memory, every pair that is not yet linked.  A larger one is dealt by hash into
blocks, twice, after which a group of real copies is one class whatever its
size.  Where a group is still of several classes, its blocks are formed anew,
those of a large class apart, and every two blocks that are not of one class
meet in a task of their own.  So every pair of the group is compared or already
linked, no task sees more than two blocks, and from each only a spanning forest
of what it has verified leaves, never the pairs it has compared.  The price: a
group of many similar texts that are not duplicates is compared in full, block
against block.

Joins with the groups and classes of several blocks are salted; a bucket with
many rows is a skewed key of one more join, a sort-merge join that adaptive
execution splits; aggregates are partial.

Defined cases: a null text, or one that no other equals or resembles, is a
class of its own; empty texts equal each other; texts without words are
compared as equal texts only; rows with a null id have the class of their
text, null where it has no other id; repeated rows are each returned; a very
long text is sampled piece by piece and fills a block alone; an empty table
gives no rows; other columns, whatever their names, are ignored by classes()
and kept by one_of_each().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import BLOCK, counter_sum, sliced, small_batches, unpacked
from .graph import components
from .storage import drop, written
from .text import mix, shingle_hashes, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 3
RARE = 1024
DAMPING = 0.1
BUCKET_BITS = 22
#: At a similarity of 0.8 the estimate from 48 samples is below this with probability 1e-5.
LEAST_ESTIMATE = 0.55
SKETCH_BLOCK = 1024
TEXT_BLOCK = 256
BLOCK_BYTES = 4 << 20
SALTS = 32
#: Shingles that are sampled at once.
CHUNK = 512

_U = np.uint64
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=_U) * _U(0xA0761D6478BD642F))[:, None]


def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) at the middles of 2**16 equal parts of probability, and its logarithm."""
    x = np.linspace(0, 40, 1 << 21)
    cdf = 1 - (1 + x) * np.exp(-x)
    at = np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), cdf, x)
    return at.astype(np.float32), np.log(at).astype(np.float32)


_GAMMA, _LOG_GAMMA = _quantiles()


def samples(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One token per sampler: equal with the probability of the weighted Jaccard similarity.

    r and c are Gamma(2, 1) and beta uniform, drawn by hash of shingle and
    sampler; t = floor(ln w / r + beta), and the smallest
    ln c - r (t - beta + 1) is sampled with its t.
    """
    best = np.full(len(_SEEDS), np.inf, np.float32)
    token = np.zeros(len(_SEEDS), _U)
    row = np.arange(len(_SEEDS))
    for at in range(0, len(shingles), CHUNK):
        h = shingles[at : at + CHUNK]
        log_w = np.log(weights[at : at + CHUNK]).astype(np.float32)
        z = (h ^ _SEEDS) * _U(0xE7037ED1A0B428DB)
        z ^= z >> _U(32)
        z *= _U(0x8EBC6AF09C88C6E3)
        r = _GAMMA[z >> _U(48)]
        log_c = _LOG_GAMMA[(z >> _U(32)) & _U(0xFFFF)]
        beta = ((z >> _U(16)) & _U(0xFFFF)).astype(np.float32) * np.float32(2**-16)
        t = np.floor(log_w / r + beta)
        value = log_c - r * (t - beta + 1)
        low = value.argmin(axis=1)
        least = value[row, low]
        better = least < best
        best[better] = least[better]
        new = mix(h[low] + t[row, low].astype(np.int64).astype(_U) * _U(0x9E3779B97F4A7C15))
        token[better] = new[better]
    return token


def band_hashes(token: np.ndarray) -> np.ndarray:
    parts = token.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=_U)
    for j in range(ROWS):
        out = mix(out * _U(0x9E3779B97F4A7C15) + parts[:, j])
    return out.view(np.int64)


class Weights:
    """Inverse document frequencies: those below 1 by bucket, all others 1."""

    def __init__(self, bucket: np.ndarray, idf: np.ndarray):
        self.bucket, self.idf = bucket, idf

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shingles of a text in order, and their weights."""
        shingles, count = np.unique(shingle_hashes(words, SHINGLE), return_counts=True)
        weights = count.astype(np.float64)
        if len(self.bucket) and len(shingles):
            own = _bucket(shingles)
            at = np.minimum(np.searchsorted(self.bucket, own), len(self.bucket) - 1)
            weights *= np.where(self.bucket[at] == own, self.idf[at], 1.0)
        return shingles, weights


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> _U(64 - BUCKET_BITS)).astype(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    total = float(a[1].sum() + b[1].sum()) - both
    return both / total if total else 0.0


def inverse_frequencies(docs: DataFrame, text: str = "text") -> Weights:
    """Counted over all rows of docs."""

    def count(counters: np.ndarray, batch: pa.RecordBatch) -> None:
        for words in word_hashes(batch.column("text").to_pylist()):
            counters[np.unique(_bucket(shingle_hashes(words, SHINGLE)))] += 1
        counters[1 << BUCKET_BITS] += batch.num_rows

    rows = docs.select(F.col(f"`{text}`").alias("text")).where("text is not null")
    sums = written(counter_sum(rows, (1 << BUCKET_BITS) + 1, count), "frequencies")
    last = sums.where(F.col("block") == (1 << BUCKET_BITS) // BLOCK).first()
    n = int(unpacked(last["data"])[0]) if last else 0

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                counts = unpacked(data)
                at = np.flatnonzero(counts * RARE > n)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(at + block * BLOCK, pa.int64()), "df": pa.array(counts[at], pa.int64())})

    found = sums.mapInArrow(frequent, "bucket bigint, df bigint").where(F.col("bucket") < (1 << BUCKET_BITS)).toArrow()
    bucket, df = found["bucket"].to_numpy(), found["df"].to_numpy()
    order = np.argsort(bucket)
    share = np.log(n / np.maximum(df[order], 1)) / np.log(RARE) if n else np.zeros(0)
    return Weights(bucket[order], 1 - DAMPING * (1 - np.clip(share, 0, 1)))


def sketched(docs: DataFrame, weights, row_id: str, text: str) -> DataFrame:
    """(id, key, bytes, bands, sketch): key and length of the text, its band hashes and its samples (32 bits of each); null without words."""
    small_batches(docs)
    given = docs.select(F.col(f"`{row_id}`").alias("id"), F.unhex(F.md5(F.col(f"`{text}`").cast("binary"))).alias("key"), F.octet_length(F.col(f"`{text}`")).alias("bytes"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = weights.value
        for batch in sliced(batches):
            bands: list[np.ndarray | None] = []
            sketch: list[bytes | None] = []
            for words in word_hashes(batch.column("text").to_pylist()):
                token = samples(*shared.of(words)) if len(words) else None
                bands.append(None if token is None else band_hashes(token))
                sketch.append(None if token is None else token.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "key", "bytes")), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["id", "key", "bytes", "bands", "sketch"])

    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(run, f"id {kind}, key binary, bytes int, bands array<bigint>, sketch binary")


class _Sketches:
    """The samples of a block."""

    def __init__(self, data: list[bytes]):
        self.token = np.frombuffer(b"".join(data), "<u4").reshape(len(data), -1)

    def similar(self, i: int, others: np.ndarray, side: int) -> np.ndarray:
        """Which of the others agree with i in enough samples."""
        return others[(self.token[others] == self.token[i]).mean(axis=1) >= LEAST_ESTIMATE]


class _Texts:
    """The weighted shingles of a block's texts."""

    def __init__(self, data: list[str], weights: Weights):
        self.own = [weights.of(w) for w in word_hashes(data)]
        self.total = np.array([w.sum() for _, w in self.own])
        self.size = np.array([len(h) for h, _ in self.own])
        every = np.concatenate([h for h, _ in self.own])
        self.distinct, number = np.unique(every, return_inverse=True)
        self.number = np.split(number, np.cumsum(self.size)[:-1])
        self.held: dict[int, tuple] = {}

    def _laid(self, others: np.ndarray, side: int) -> tuple:
        """The others, or a few more of their side, with their shingles one behind the other."""
        if side not in self.held or len(self.held[side][0]) > 2 * len(others):
            starts = np.cumsum(self.size[others]) - self.size[others]
            self.held[side] = others, np.concatenate([self.number[j] for j in others]), np.concatenate([self.own[j][1] for j in others]), starts
        return self.held[side]

    def similar(self, i: int, others: np.ndarray, side: int) -> np.ndarray:
        """Which of the others have a weighted Jaccard similarity of THRESHOLD with i."""
        laid, number, weight, starts = self._laid(others, side)
        dense = np.zeros(len(self.distinct))
        dense[self.number[i]] = self.own[i][1]
        both = np.add.reduceat(np.minimum(dense[number], weight), starts)
        total = self.total[i] + self.total[laid] - both
        good = laid[both >= THRESHOLD * total]
        return good if len(laid) == len(others) else good[np.isin(good, others)]


def _forest(block, label: np.ndarray, side: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of similar members that span the components of the classes `label`.

    Where members are of two sides, only pairs of both sides count.  A member
    is compared with those that are not yet reached, so a block of copies
    takes one comparison a member.
    """
    order = np.argsort(label, kind="stable")
    fellows = np.split(order, np.flatnonzero(np.diff(label[order])) + 1)
    of_label = {int(label[f[0]]): f for f in fellows}
    left = np.ones(len(label), bool)
    two = side.min() != side.max()
    for start in range(len(label)):
        if not left[start]:
            continue
        queue = of_label[int(label[start])].tolist()
        left[queue] = False
        for i in queue:  # grows while it is walked
            facing = 1 - int(side[i]) if two else 0
            others = np.flatnonzero(left & (side == facing)) if two else np.flatnonzero(left)
            if not len(others):
                continue
            for j in block.similar(i, others, facing).tolist():
                if left[j]:
                    more = of_label[int(label[j])].tolist()
                    left[more] = False
                    queue += more
                    yield i, j


def _links(dealt: DataFrame, make: Callable[[list], object]) -> DataFrame:
    """Links (a, b) between classes, in the blocks or pairs of blocks (grp, low, high) with members (side, key, root, data)."""
    by = ["grp", "low", "high"]
    names = [*by, "side", "key", "root", "data"]
    small_batches(dealt)
    dealt = dealt.select(*names).repartition(*by).sortWithinPartitions(*by, "key")

    def links(rows: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        (_, low, high), *_ = rows[0]
        side = np.array([int(low != high and r[1] == high) for r in rows])
        if len(rows) < 2 or low != high and side.min() == side.max():
            return
        number: dict[bytes, int] = {}
        label = np.array([number.setdefault(r[3], len(number)) for r in rows])
        if len(number) < 2:
            return
        for i, j in _forest(make([r[4] for r in rows]), label, side):
            yield min(rows[i][3], rows[j][3]), max(rows[i][3], rows[j][3])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple[bytes, bytes]] = []

        def made() -> pa.RecordBatch:
            a, b = zip(*out, strict=True) if out else ((), ())
            out.clear()
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

        for batch in sliced(batches):
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                own = row[:3], *row[3:]
                if held and held[-1][0] != own[0]:
                    out += links(held)
                    held = []
                held.append(own)
            if len(out) > 10_000:
                yield made()
        out += links(held) if held else []
        yield made()

    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def _placed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of groups of several blocks that are still of several classes, with their roots."""
    placed = members.where("blocks > 1").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = placed.groupBy("grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("grp")
    return _salted(placed, mixed, ["grp"])


def _salted(members: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """A join with one row for each group or class, of which few are left but which may have very many members."""
    salt = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(SALTS)).cast("int")
    copies = other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return members.withColumn("salt", salt).join(copies, [*on, "salt"]).drop("salt")


def _block(number, *by) -> F.Column:
    return F.pmod(F.xxhash64(*by), F.ceil(number).cast("bigint")).cast("string")


def _crossed(placed: DataFrame) -> DataFrame:
    """Every two blocks of a group that are not of one class, as (grp, low, high) with their members.

    A class of a block's size or more has blocks of its own; smaller classes
    share blocks.
    """
    classes = placed.groupBy("grp", "root").agg(F.sum("size").alias("share"))
    few = classes.where("share < 1").groupBy("grp").agg(F.sum("share").alias("few"))
    classes = classes.join(few, "grp", "left")
    large = F.col("share") >= 1
    own = F.concat(F.hex("root"), F.lit(":"), _block(F.col("share"), "key", F.lit(3)))
    block = F.when(large, own).otherwise(_block(F.greatest(F.coalesce("few", F.lit(1.0)), F.lit(1.0)), "root", F.lit(4)))
    dealt = _salted(placed, classes, ["grp", "root"]).withColumn("side", block).withColumn("one", F.when(large, F.col("root")))
    blocks = dealt.select("grp", "side", "one").distinct()
    left, right = blocks.select("grp", F.col("side").alias("low"), F.col("one").alias("x")), blocks.select("grp", F.col("side").alias("high"), F.col("one").alias("y"))
    pairs = left.join(right, "grp").where("low <= high and not coalesce(x = y, false)").select("grp", "low", "high")
    sides = pairs.withColumn("side", F.explode(F.array_distinct(F.array("low", "high"))))
    return dealt.join(sides, ["grp", "side"])


def linked(members: DataFrame, data: DataFrame, make: Callable[[list], object], what: str) -> DataFrame:
    """(node, root) of all members with a link.

    members: (grp, key, size), 1 being the size of a full block; data: (key,
    data).  A pair of similar members of one group is a link.
    """
    whole = members.groupBy("grp").agg(F.ceil(F.sum("size")).alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = written(members.join(whole, "grp").join(data.hint("merge"), "key"), f"{what}-members")
    roots: DataFrame | None = None
    for turn in range(3):
        placed = members.withColumn("root", F.col("key")) if roots is None else _placed(members, roots)
        if turn == 2:
            dealt = _crossed(written(placed, f"{what}-apart"))
        else:
            block = _block(F.col("blocks"), "key", "grp", F.lit(turn))
            dealt = placed.withColumn("low", block).withColumn("high", F.col("low")).withColumn("side", F.col("low"))
        found = written(_links(dealt, make), f"{what}-links")
        if roots is None:
            roots = components(found, stored=True)
            if members.where("blocks > 1").isEmpty():
                break
        elif not found.isEmpty():
            roots = written(_joined(roots, components(found, stored=True)), f"{what}-roots")
    drop(members)
    return roots


def _joined(roots: DataFrame, higher: DataFrame) -> DataFrame:
    """The classes of `roots`, joined as `higher` joins their roots and members that had no link so far."""
    up = higher.select(F.col("node").alias("root"), F.col("root").alias("up"))
    mapped = roots.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return mapped.unionAll(higher.join(roots.select("node"), "node", "left_anti").select("node", "root"))


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """(key, data): the text of each node; in each task equal texts are reduced to one before they are dealt out."""
    keyed = docs.select(F.unhex(F.md5(F.col(f"`{text}`").cast("binary"))).alias("key"), F.col(f"`{text}`").alias("data"))
    return keyed.where("key is not null").groupBy("key").agg(F.first("data").alias("data"))


def classes(docs: DataFrame, row_id: str = "doc_id", text: str = "text", weights: Weights | None = None) -> DataFrame:
    """(id, class_id) for each row of docs; class_id is the smallest id of its class."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights or inverse_frequencies(docs, text))
    rows = written(sketched(docs, shared, row_id, text), "sketches")
    made = F.first(F.struct("bytes", "bands", "sketch")).alias("made")
    nodes = written(rows.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), made).select("key", "id", "made.*"), "nodes")
    buckets = nodes.where("bands is not null").select(F.explode("bands").alias("grp"), "key", F.lit(1.0 / SKETCH_BLOCK).alias("size"))
    families = linked(buckets, nodes.select("key", F.col("sketch").alias("data")), _Sketches, "bucket")
    share = F.greatest(F.lit(1.0 / TEXT_BLOCK), F.col("bytes") / F.lit(float(BLOCK_BYTES)))
    relatives = families.select(F.col("node").alias("key"), F.col("root").alias("grp")).join(nodes.select("key", share.alias("size")), "key")
    roots = linked(relatives, _texts(docs, text), lambda data: _Texts(data, shared.value), "family")
    placed = nodes.select("key", "id").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = placed.groupBy("root").agg(F.min("id").alias("class_id"))
    ids = placed.join(least, "root").select("key", "class_id")
    return rows.select("id", "key").join(ids, "key", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))


def digests(docs: DataFrame) -> DataFrame:
    return classes(docs).withColumnRenamed("id", "doc_id")


def one_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """The first stored row of each class; columns as given."""
    columns = docs.columns
    tagged = written(docs.select(F.monotonically_increasing_id().alias("__row"), *[F.col(f"`{c}`") for c in columns]), "tagged")
    others = classes(tagged, "__row", text).where("id <> class_id").select(F.col("id").alias("__row"))
    return tagged.join(written(others, "others"), "__row", "left_anti").select(*[F.col(f"`{c}`") for c in columns])
