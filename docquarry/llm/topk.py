"""Exact top-k inner products over a bit-sliced index.

Vectors become integers floor(1024 x).  A block of the index holds up to
BLOCK_ROWS rows in order of id: for each attribute its least value and, for
each binary digit of what exceeds it, a bitmap over the rows (a slice).  For a
query the slices are added as bitmaps: each signed binary digit of a query
component sends the attribute's slices (complemented where the digit is
negative) to the columns of their weights, and the columns are reduced by
carry-save adders, many bitmaps at a time.  What remains is the score as
slices.  From the most significant downward they split the rows into those
above the k-th score, those still equal to it, and the rest; ties at the
boundary go to the smallest ids, and the selected rows' scores are recomputed
from their integers.

Rows with an integer of WIDE or more go to blocks of their own, with as many
slices as their integers need and Python's integers where 64 bits end; else
they are searched alike.

Queries are dealt into groups of about GROUP_QUERIES.  Each block meets each
group in one shuffle join on (group, place of the block), so neither goes
through the driver.  Per query and block at most k rows leave a task, and the
rank within a query limits them again before the shuffle.

Defined cases: vectors that are null or hold a null or non-finite component,
and rows with a null id, take no part; every finite vector does; a vector
shorter than the longest counts as ending in zeros (its integers, not its
place); a repeated row is ranked as often as it stands; rows with the query's
own id are not its results; an empty vector scores 0; ranks are by exact
scores, and a score beyond 64 bits is given as the nearest 64-bit integer; an
empty table, or one without queries, gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import small_batches
from .storage import written

SCALE = 1024
BLOCK_ROWS = 1 << 16
#: An integer of so much is wide: int64 sums of products would not hold it.
WIDE = 1 << 31
#: Rows of a block with wide integers, which may have a thousand slices an attribute.
WIDE_ROWS = 1 << 10
#: Queries of a group at about most.
GROUP_QUERIES = 2048
LONG = (1 << 63) - 1

_INDEX = "ids binary, dims int, wide boolean, low binary, digits int, slices binary"


def vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x array<double>) of the rows that take part."""
    x = F.transform(F.col(f"`{vector}`"), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.where(F.col(f"`{vec_id}`").isNotNull() & F.col(f"`{vector}`").isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), x.alias("x"))


def _integer(x: float) -> int:
    """floor(SCALE * x), exact where the product would be beyond a double."""
    return int(x) * SCALE if abs(x) >= 1 << 53 else math.floor(x * SCALE)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of doubles, padded with zeros to the longest."""
    n = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    dims = int(n.max()) if len(n) else 0
    if len(n) and (n == dims).all():
        return flat.reshape(len(n), dims)
    out = np.zeros((len(n), dims))
    out[np.arange(dims) < n[:, None]] = flat
    return out


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): int64 if none is wide, else Python's integers."""
    if not x.size or np.abs(x).max() * SCALE < WIDE:
        return np.floor(x * SCALE).astype(np.int64)
    return np.array([[_integer(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def _raw(values: np.ndarray) -> bytes:
    """64-bit integers, or a text of them where they are wider."""
    return ",".join(map(str, values.tolist())).encode() if values.dtype == object else values.astype("<i8").tobytes()


def _read(raw: bytes, wide: bool) -> np.ndarray:
    return np.array([int(v) for v in raw.split(b",") if v], object) if wide else np.frombuffer(raw, "<i8")


def _ordered(value: int) -> str:
    """A text that sorts as the integer does, of up to 9999 digits."""
    digits = str(abs(value))
    text = f"{len(digits):04d}{digits}"
    return f"p{text}" if value >= 0 else "n" + text.translate(_NINES)


_NINES = str.maketrans("0123456789", "9876543210")


def _sliced(ids: np.ndarray, q: np.ndarray) -> dict:
    """One block of the index."""
    order = np.argsort(ids, kind="stable")
    ids, q = ids[order], q[order]
    low = q.min(axis=0) if q.shape[1] else np.zeros(0, np.int64)
    over = (q - low).T
    digits = int(over.max(initial=0)).bit_length()
    words = -(-len(ids) // 64)
    bits = np.zeros((q.shape[1], digits, words * 64), bool)
    for j in range(digits):
        bits[:, j, : len(ids)] = (over >> j) & 1
    slices = np.packbits(bits, axis=-1, bitorder="little")
    return {"ids": ids.tobytes(), "dims": q.shape[1], "wide": q.dtype == object, "low": _raw(low), "digits": digits, "slices": slices.tobytes()}


def build_index(rows: DataFrame) -> DataFrame:
    """Blocks of the index over all rows of vectors(); each from rows of one partition."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {False: [], True: []}
        kind = pa.schema([("ids", pa.binary()), ("dims", pa.int32()), ("wide", pa.bool_()), ("low", pa.binary()), ("digits", pa.int32()), ("slices", pa.binary())])

        def made(wide: bool) -> pa.RecordBatch:
            parts = held[wide]
            dims = max(x.shape[1] for _, x in parts)
            x = np.concatenate([np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for _, x in parts])
            ids = np.concatenate([i for i, _ in parts])
            held[wide] = []
            return pa.RecordBatch.from_pylist([_sliced(ids, integers(x))], schema=kind)

        for batch in batches:
            ids, x = batch.column("vec_id").to_numpy(), _matrix(batch.column("x"))
            over = np.abs(x).max(axis=1, initial=0) * SCALE >= WIDE
            for wide, most in ((False, BLOCK_ROWS), (True, WIDE_ROWS)):
                own = np.flatnonzero(over == wide)
                while len(own):
                    room = most - sum(len(i) for i, _ in held[wide])
                    part, own = own[:room], own[room:]
                    held[wide].append((ids[part], x[part]))
                    if len(part) == room:
                        yield made(wide)
        for wide in (False, True):
            if held[wide]:
                yield made(wide)

    small_batches(rows)
    made = rows.mapInArrow(blocks, _INDEX)
    return made.select(F.monotonically_increasing_id().alias("block"), *made.columns)


class Block:
    """A block of the index, ready to be searched."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.low = _read(row["low"], row["wide"])
        words = -(-len(self.ids) // 64)
        self.slices = np.frombuffer(row["slices"], np.uint64).reshape(row["dims"], row["digits"], words)
        self.rows = np.full(words, ~np.uint64(0))
        if len(self.ids) % 64:
            self.rows[-1] = np.uint64((1 << len(self.ids) % 64) - 1)

    def summed(self, query: np.ndarray) -> list[np.ndarray]:
        """The slices, least significant first, of the scores less a constant."""
        dims, digits, _ = self.slices.shape
        columns: dict[int, list[np.ndarray]] = {}
        query = query[:dims]
        for place, positive, negative in signed_digits(query):
            for dims_here, flip in ((positive, False), (negative, True)):
                if len(dims_here):
                    for j in range(digits):
                        part = self.slices[dims_here, j]
                        columns.setdefault(place + j, []).append(~part if flip else part)
        out = []
        place = 0
        while columns:
            parts = columns.pop(place, None)
            if parts is None:
                out.append(np.zeros_like(self.rows))
            else:
                column = np.concatenate(parts)
                while len(column) > 1:
                    third = len(column) // 3
                    if third:
                        a, b, c = column[:third], column[third : 2 * third], column[2 * third : 3 * third]
                        half = a ^ b
                        carry = (a & b) | (c & half)
                        column = np.concatenate([half ^ c, column[3 * third :]])
                    else:
                        a, b = column[:1], column[1:]
                        carry = a & b
                        column = a ^ b
                    columns.setdefault(place + 1, []).append(carry)
                out.append(column[0])
            place += 1
        return out

    def top(self, query: np.ndarray, k: int) -> np.ndarray:
        """Places of the k rows with the highest scores; of equal scores the smallest ids."""
        above, equal = np.zeros_like(self.rows), self.rows.copy()
        if len(self.ids) <= k:
            return np.arange(len(self.ids))
        for part in reversed(self.summed(query)):
            high = equal & part
            n = int(np.bitwise_count(above).sum() + np.bitwise_count(high).sum())
            if n > k:
                equal = high
            else:
                above = above | high
                equal = equal & ~part
                if n == k:
                    return _places(above)
        chosen = _places(above)
        return np.concatenate([chosen, _places(equal)[: k - len(chosen)]])

    def scores(self, query: np.ndarray, places: np.ndarray) -> list[int]:
        """The inner products of some rows, from their integers."""
        dims, digits, _ = self.slices.shape
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        over = (self.slices[:, :, word] >> bit) & np.uint64(1)
        weights = query[:dims]
        if not len(weights):
            return [0] * len(places)
        wide = self.low.dtype == object or weights.dtype == object or digits + int(np.abs(weights).max()).bit_length() + dims.bit_length() > 62
        number = object if wide else np.int64
        value = np.array([1 << j for j in range(digits)], number).reshape(1, -1, 1)
        values = (over.astype(number) * value).sum(axis=1) + self.low.astype(number)[:, None]
        return [int(v) for v in weights.astype(number) @ values[: len(weights)]]


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def signed_digits(query: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each binary place the dimensions whose digit there is 1, and those where it is -1 (no two digits adjoin)."""
    rest = query
    place = 0
    while rest.any():
        digit = np.where((rest & 1).astype(bool), 2 - (rest & 3), 0)
        yield place, np.flatnonzero(digit == 1), np.flatnonzero(digit == -1)
        rest = (rest - digit) >> 1
        place += 1


def _found(block: Block, queries: list[tuple[np.ndarray, list[int]]], k: int) -> Iterator[tuple[int, int, int]]:
    for vector, ids in queries:
        own = {i: int(np.searchsorted(block.ids, i, "right") - np.searchsorted(block.ids, i, "left")) for i in ids}
        places = block.top(vector, k + max(own.values()))
        ranked = sorted(zip((-s for s in block.scores(vector, places)), block.ids[places].tolist(), strict=True))
        for query in ids:
            left = k
            for score, other in ranked:
                if other != query and left:
                    yield query, other, -score
                    left -= 1


def search(index: DataFrame, queries: DataFrame, k: int = 10, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of each query's k best rows; queries as from vectors(), index stored."""
    groups = max(1, -(-queries.count() // group_queries))
    places = max(1, index.count())
    group = F.pmod(F.xxhash64("vec_id", "x", F.lit(5)), F.lit(groups)).cast("int")
    asked = queries.distinct().select(group.alias("group"), "vec_id", "x")
    asked = asked.groupBy("group").agg(F.collect_list(F.struct("vec_id", "x")).alias("asked"))
    asked = asked.select("group", F.explode(F.sequence(F.lit(0), F.lit(places - 1))).alias("place"), "asked")
    place = F.pmod(F.xxhash64("block"), F.lit(places)).cast("int")
    blocks = index.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), place.alias("place"), *index.columns)
    met = blocks.join(asked, ["group", "place"]).select("ids", "dims", "wide", "low", "digits", "slices", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                by_vector: dict[tuple, list[int]] = {}
                for one in row["asked"]:
                    by_vector.setdefault(tuple(one["x"]), []).append(one["vec_id"])
                vectors = [(integers(np.array(x, float).reshape(1, -1))[0], ids) for x, ids in by_vector.items()]
                out = list(_found(Block(row), vectors, k))
                for start in range(0, len(out), 1 << 16):
                    q, v, s = zip(*out[start : start + (1 << 16)], strict=True)
                    clamped = pa.array([max(-LONG - 1, min(LONG, x)) for x in s], pa.int64())
                    beyond = pa.array([_ordered(x) if abs(x) >= LONG else "" for x in s], pa.string())
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": clamped, "beyond": beyond})

    found = met.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint, beyond string")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """Rows whose vec_id is divisible by `every` are queries against every row."""
    rows = vectors(embeddings)
    index = written(build_index(rows), "bit-slices")
    return search(index, rows.where(F.col("vec_id") % every == 0), k)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(q) AS x, unnest(range(len(q))) AS i FROM v),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score FROM e a JOIN e b ON a.i = b.i
  WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY 1, 2),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""
