import hashlib
import math
import zlib

from pyspark.sql import functions as F

from docquarry.llm import shard


def brute(key, weights):
    def bid(s):
        n = int(hashlib.md5(f"{'null' if key is None else key}#{s}".encode()).hexdigest()[:13], 16)
        return -weights[s] / math.log((n + 0.5) / 2**52)

    return max(range(len(weights)), key=lambda s: (bid(s), -s))


def test_places_growth_and_gapless_slots(spark):
    rows = [(i % 700, f"té {i}") for i in range(1000)] + [(None, None)] * 300 + [(5, "x")] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = shard.digests(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.shard == brute(r.doc_id, [1.0] * 8)
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        own = sorted((r.slot, r.doc_id if r.doc_id is not None else -1) for r in got if r.shard == s)
        assert [x[0] for x in own] == list(range(len(own)))
        assert [x[1] for x in own] == sorted(x[1] for x in own)
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted((r.size, r.text_crc32) for r in got) == want


def test_weights_clashing_columns_and_empty(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(1).alias("slot"), F.lit(2).alias("shard"))
    n = {r["shard"]: r["count"] for r in shard.shards(df, [1.0, 3.0]).groupBy("shard").count().collect()}
    assert 0.7 < n[1] / 4000 < 0.8
    assert shard.slots(shard.shards(df, [1.0, 3.0])).columns == ["doc_id", "text", "shard", "slot"]
    assert shard.digests(df.limit(0)).count() == 0
