"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each shard draws a number in (0, 1) for a key; the shard with the largest
-weight / ln(number) gets the record.  The key and the shards alone decide, so
one more shard takes records only into itself, and a shard of twice the weight
gets twice the records.  All of it is one expression of built-in functions.

Slots number the records of a shard without gaps, in order of key.  The rows
are range-partitioned by (key, position in the input), which also divides the
copies of one very frequent key, and written with their position in the
partition; the counts of partition and shard are then added up and joined on.
No task ever sorts a whole shard.

Defined cases: a null key is the text "null" and comes first; null text has
size 1; records that share a key share the shard, each with its own slot; an
empty table gives no rows; the length of a text does not matter; digests() gives
its own columns only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import written

#: Bits of the digest behind a shard's number.
_DIGITS = 13


def _number(key: Column, shard: int) -> Column:
    """In (0, 1): the first 52 bits of the md5 of key and shard."""
    digest = F.md5(F.concat(key, F.lit(f"#{shard}")).cast("binary"))
    whole = F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double")
    return (whole + 0.5) / float(1 << 4 * _DIGITS)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) of a key; of equal bids the lowest shard wins."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, and at least one")
    text = F.coalesce(key.cast("string"), F.lit("null"))
    bids = [F.struct((-F.lit(float(w)) / F.ln(_number(text, s))).alias("bid"), F.lit(-s).alias("shard")) for s, w in enumerate(weights)]
    return -F.array_max(F.array(*bids))["shard"]


def shards(docs: DataFrame, weights: Sequence[float], key: str = "doc_id") -> DataFrame:
    """docs with `shard` (int). Narrow."""
    return docs.withColumn("shard", rendezvous(F.col(f"`{key}`"), weights).cast("int"))


def slots(sharded: DataFrame, key: str = "doc_id", shard: str = "shard") -> DataFrame:
    """sharded with `slot` (long): gapless from 0 in each shard, in order of key, null keys first."""
    spark = sharded.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [c for c in sharded.columns if c.lower() != "slot"]
    rows = sharded.select(*[F.col(f"`{c}`") for c in names], F.monotonically_increasing_id().alias("__at"))
    dealt = rows.repartitionByRange(n, F.col(f"`{key}`").asc_nulls_first(), F.col("__at")).withColumn("__part", F.spark_partition_id())
    held = written(dealt, "slots")
    local = W.partitionBy("__part", shard).orderBy(F.col(f"`{key}`").asc_nulls_first(), "__at")
    counts = held.groupBy("__part", shard).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(shard).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("__part", shard, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    ranked = held.withColumn("__rank", F.row_number().over(local))
    joined = ranked.join(starts, ["__part", shard])
    return joined.select(*[F.col(f"`{c}`") for c in names], (F.col("__start") + F.col("__rank") - 1).alias("slot"))


def digests(docs: DataFrame, n: int = 8) -> DataFrame:
    """One row per document: its place under n equal shards, and its shard with one more."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = shards(narrow, [1.0] * n).withColumn("grown_shard", rendezvous(F.col("doc_id"), [1.0] * (n + 1)).cast("int"))
    return slots(placed).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _sql_shard(n: int) -> str:
    bids = [f"-1.0 / ln((CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '#{s}'), 1, {_DIGITS})) AS BIGINT) + 0.5) / {float(1 << 4 * _DIGITS)!r})" for s in range(n)]
    return f"CAST(list_position([{', '.join(bids)}], list_max([{', '.join(bids)}])) - 1 AS INTEGER)"


#: DuckDB has no crc32: it is computed from the bytes by a fold over the reflected polynomial's table.
_CRC_TABLE = "[" + ", ".join(str(c) for c in (lambda f: [f(i) for i in range(256)])(lambda i: __import__("functools").reduce(lambda c, _: (c >> 1) ^ (0xEDB88320 if c & 1 else 0), range(8), i))) + "]"
ORACLE = f"""
WITH t AS (SELECT {_CRC_TABLE} AS tab),
h AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT DISTINCT text FROM h),
x AS (SELECT text, hex(encode(text)) AS hx FROM u),
c AS (SELECT x.text, length(hx) // 2 + 1 AS size,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(hx) // 2), lambda i: CAST(('0x' || substr(hx, 2 * i + 1, 2)) AS BIGINT))),
    lambda a, b: xor(a >> 8, CAST(t.tab[(xor(a, b) & 255) + 1] AS BIGINT))), CAST(4294967295 AS BIGINT)) AS crc FROM x, t),
p AS (SELECT h.r, doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, {_sql_shard(8)} AS shard, {_sql_shard(9)} AS grown_shard FROM h JOIN c USING (text))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, r) - 1 AS BIGINT) AS slot, grown_shard FROM p
"""
