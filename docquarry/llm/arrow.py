"""Arrow helpers: narrow maps that add columns, and sums of wide counter arrays."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 14
LANES = 16
#: Rows of a batch that a kernel sees at once; bounds what it holds beside the batch.
SLICE = 512


#: Rows of an Arrow batch between the JVM and Python, unless the session says otherwise.
BATCH_ROWS = 1000
_DEFAULT = "10000"


def small_batches(df: DataFrame) -> None:
    """Keep Arrow batches of whole texts small: both sides hold a few of them at once outside the heap.

    Only where the session has Spark's own default; a setting of the user's stays.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == _DEFAULT:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what is run within; for narrow rows only."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _packed(counts: np.ndarray, lane: int) -> Iterator[pa.RecordBatch]:
    for block in range(0, len(counts), BLOCK):
        part = counts[block : block + BLOCK]
        if part.any():
            data = zlib.compress(part.astype("<i8").tobytes(), 1)
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array([block // BLOCK], pa.int32()), "lane": pa.array([lane], pa.int32()), "data": pa.array([data], pa.binary())}
            )


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<i8")


def _summing(lane: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, at, data in zip(batch.column("block").to_pylist(), batch.column("lane").to_pylist(), batch.column("data").to_pylist(), strict=True):
                key = (block, at if lane else 0)
                part = unpacked(data)
                held[key] = held[key] + part if key in held else part
        for (block, at), part in held.items():
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([block], pa.int32()),
                    "lane": pa.array([at], pa.int32()),
                    "data": pa.array([zlib.compress(part.astype("<i8").tobytes(), 1)], pa.binary()),
                }
            )

    return add


def counter_sum(df: DataFrame, size: int, count: Callable[[np.ndarray, pa.RecordBatch], None]) -> DataFrame:
    """Sum a counter array of fixed `size` over all rows of df.

    count(counters, batch) adds a batch to one task's own array, at most 1 a
    byte of the batch to one counter.  A task hands
    on only compressed blocks of it; they are added as a stream, in two steps,
    so no task ever holds more than its own blocks whatever the input.
    Returns (block int, data binary): compressed little-endian 64-bit counts.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        counters = np.zeros(size, np.int32)
        held = 0
        lane = context.partitionId() % LANES if context else 0
        for batch in sliced(batches):
            count(counters, batch)
            held += batch.nbytes
            if held > 1 << 30:  # a 32-bit counter holds twice that
                yield from _packed(counters, lane)
                counters[:] = 0
                held = 0
        yield from _packed(counters, lane)

    small_batches(df)
    schema = "block int, lane int, data binary"
    parts = df.mapInArrow(local, schema)
    near = parts.repartition("block", "lane").mapInArrow(_summing(True), schema)
    return near.repartition("block").mapInArrow(_summing(False), schema).select("block", "data")


def gathered(sums: DataFrame, size: int) -> np.ndarray:
    """The whole counter array on the driver; its size is fixed beforehand."""
    out = np.zeros(size, np.int64)
    for row in sums.toLocalIterator():
        part = unpacked(row["data"])
        out[row["block"] * BLOCK : row["block"] * BLOCK + len(part)] = part
    return out


def with_columns(df: DataFrame, needs: str, kernel: Callable[[list], dict[str, pa.Array]], schema: str, setup=None) -> DataFrame:
    """df and new columns that kernel makes of column `needs`, row by row.

    setup() makes what the kernel works with, once a task; its close(), if it
    has one, ends the task.

    Existing columns pass through untouched; one whose name a new column takes
    is replaced.  schema is the DDL of the new columns.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    small_batches(df)
    added: StructType = _parse_datatype_string(f"struct<{schema}>")
    names = {f.name.lower() for f in added}
    kept = [f for f in df.schema if f.name.lower() not in names]
    out = StructType(kept + list(added))
    needed = "__in"
    df = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{needs}`").alias(needed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = setup() if setup else None
        for batch in sliced(batches):
            new = kernel(made, batch.column(needed).to_pylist()) if setup else kernel(batch.column(needed).to_pylist())
            cols = [batch.column(f.name) for f in kept] + [new[f.name] for f in added]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in out])
        if hasattr(made, "close"):
            made.close()  # workers outlive their tasks

    return df.mapInArrow(run, out)
