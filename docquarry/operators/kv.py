"""An ordered key-value layer: rows (key binary, value binary), keys ordered as bytes.

Range reads are a filter and a top-k; Parquet written by seal() is range
partitioned and sorted by key, so a bounded scan skips files and row groups by
their minima and maxima.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.errors import EngineError, invalid

CODECS = ("lz4", "zstd", "snappy", "uncompressed")


def _bytes(key: bytes) -> Column:
    return F.lit(bytearray(key))


def get(table: DataFrame, key: bytes) -> DataFrame:
    return table.where(F.col("key") == _bytes(key))


def exists(table: DataFrame, key: bytes) -> bool:
    return not get(table, key).select("key").limit(1).isEmpty()


def next_prefix(prefix: bytes) -> bytes | None:
    """The least key above all that begin with prefix; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def with_prefix(table: DataFrame, prefix: bytes) -> DataFrame:
    """As a range, which files can be skipped by."""
    return bounded(table, prefix, next_prefix(prefix))


def prefix_exists(table: DataFrame, prefix: bytes) -> bool:
    return not with_prefix(table, prefix).select("key").limit(1).isEmpty()


def bounded(table: DataFrame, lower: bytes | None = None, upper: bytes | None = None) -> DataFrame:
    """lower <= key < upper; an empty or inverted range has no rows."""
    if lower is not None:
        table = table.where(F.col("key") >= _bytes(lower))
    if upper is not None:
        table = table.where(F.col("key") < _bytes(upper))
    return table


def forward(table: DataFrame, lower: bytes | None, upper: bytes | None, limit: int) -> DataFrame:
    return bounded(table, lower, upper).orderBy("key").limit(_limit(limit))


def reverse(table: DataFrame, lower: bytes | None, upper: bytes | None, limit: int) -> DataFrame:
    """Bounds still ascend; rows descend."""
    return bounded(table, lower, upper).orderBy(F.desc("key")).limit(_limit(limit))


def seek(table: DataFrame, key: bytes, limit: int = 1) -> DataFrame:
    """The first rows at or after key."""
    return forward(table, key, None, limit)


def next_after(table: DataFrame, key: bytes, limit: int = 1) -> DataFrame:
    """The first rows after key."""
    return forward(table, key + b"\x00", None, limit)


def _limit(n: int) -> int:
    if n < 0:
        raise invalid("`limit` must not be negative")
    return n


def merged(levels: list[DataFrame]) -> DataFrame:
    """One table of levels (key, value), newest first: the newest row of a key wins, a null value deletes.

    max_by is a partial aggregate, so a key that every level holds is reduced
    before the shuffle.
    """
    tagged = [level.select("key", F.struct(F.col("value").alias("v")).alias("box"), F.lit(-age).alias("age")) for age, level in enumerate(levels)]
    rows = tagged[0]
    for more in tagged[1:]:
        rows = rows.unionByName(more)
    newest = rows.groupBy("key").agg(F.max_by("box", "age").alias("box"))
    return newest.select("key", F.col("box.v").alias("value")).where(F.col("value").isNotNull())


def commits(log: DataFrame) -> DataFrame:
    """The state after a log (sequence, ordinal, key, value) of batches: put, or delete where value is null."""
    last = log.groupBy("key").agg(F.max_by(F.struct("value"), F.struct("sequence", "ordinal")).alias("box"))
    return last.select("key", F.col("box.value").alias("value")).where(F.col("value").isNotNull())


def group_commit(batches: list[list[tuple[bytes, bytes | None]]], first: int) -> list[tuple[int, int, bytes, bytes | None]]:
    """Log rows of batches, one sequence number each."""
    return [(first + s, o, key, value) for s, batch in enumerate(batches) for o, (key, value) in enumerate(batch)]


def seal(table: DataFrame, path: str, codec: str = "zstd", files: int | None = None, bloom: bool = False) -> str:
    """Write an immutable run in key order and return the digest of its rows.

    Keys must be unique.  With `bloom`, Parquet bloom filters answer point reads
    of absent keys.
    """
    if codec not in CODECS:
        raise invalid(f"`codec` is one of {', '.join(CODECS)}")
    n = files or int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = table.select("key", "value").repartitionByRange(n, "key").sortWithinPartitions("key")
    checked = ordered.mapInArrow(_ascending, "key binary, value binary")
    writer = checked.write.option("compression", codec)
    if bloom:
        writer = writer.option("parquet.bloom.filter.enabled#key", "true")
    writer.parquet(path)
    return digest(table.sparkSession.read.parquet(path))


def _ascending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal keys share a range partition and are neighbours in it."""
    last = None
    for batch in batches:
        keys = batch.column("key")
        if len(keys):
            if keys[0].as_py() == last or (len(keys) > 1 and pc.any(pc.equal(keys[1:], keys[:-1])).as_py()):
                raise EngineError("INVALID_ARGUMENT", "a sealed run has a key twice")
            last = keys[-1].as_py()
        yield batch


def digest(table: DataFrame) -> str:
    """A digest of the rows that does not depend on how they are stored: the sum of the rows' own."""
    row = F.sha2(F.concat(F.hex("key"), F.lit(":"), F.coalesce(F.hex("value"), F.lit("-"))), 256)
    halves = [F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    found = table.agg(F.count(F.lit(1)).alias("n"), *halves).first()
    return hashlib.sha256(":".join(str(v or 0) for v in found).encode()).hexdigest()


def opened(spark, path: str, expected: str | None = None) -> DataFrame:
    """A sealed run; with `expected` its digest is verified."""
    table = spark.read.parquet(path)
    if expected is not None and digest(table) != expected:
        raise EngineError("CORRUPTION", f"the run at {path} differs from its digest")
    return table
