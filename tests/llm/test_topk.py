import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.llm import topk
from docquarry.llm.storage import written


def brute(rows, every=100, k=10):
    ok = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in ok:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])}
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 150), st.integers(1, 12), st.integers(0, 2**32), st.integers(1, 2000))
def test_block_top_equals_sorting(dims, n, k, seed, size):
    rng = np.random.default_rng(seed)
    q = rng.integers(-size, size + 1, (n, dims))
    block = topk.Block(topk._sliced(np.arange(n) * 3, q))
    query = rng.integers(-size, size + 1, dims)
    want = sorted(range(n), key=lambda i: (-int(q[i] @ query), i))[:k]
    got = block.top(query, k)
    assert sorted(got.tolist()) == sorted(want)
    assert block.scores(query, got) == [int(q[i] @ query) for i in got]


def test_frame_with_ties_nulls_and_passes(spark):
    rng = np.random.default_rng(3)
    rows = [(i * 10, [float(x) for x in rng.normal(size=6)]) for i in range(120)]
    rows += [(5000 + i, [0.5] * 6) for i in range(60)] + [(7, None), (8, [1.0, None]), (9, [float("nan")] * 6), (None, [1.0] * 6), (200000, [0.25, -0.5]), (11, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int").repartition(5)
    assert set(map(tuple, topk.neighbours(df).collect())) == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    vectors = topk.vectors(df)
    many = topk.search(written(topk.build_index(vectors), "index"), vectors.where("vec_id % 100 = 0"), 10, group_queries=3)
    assert set(map(tuple, many.collect())) == set(map(tuple, topk.neighbours(df).collect()))
    assert topk.neighbours(df.limit(0)).count() == 0
    twice = df.where("vec_id in (0, 10, 20)").unionAll(df.where("vec_id in (0, 10)"))
    assert [r.vec_id for r in topk.neighbours(twice).orderBy("rank").collect() if r.query_id == 0].count(10) == 2


def test_every_finite_vector_takes_part(spark):
    rng = np.random.default_rng(8)
    rows = [(0, [1.0, 0.0, 0.0]), (1, [3e6, 0.0, 0.0]), (2, [0.5, 0.0, 0.0]), (100, [-4e6, 2.5, -7e5]), (200, [0.0, 0.0, 2097152.0])]
    rows += [(1000 + i, [float(x) for x in rng.normal(size=3) * 10.0 ** rng.integers(-2, 6)]) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = set(map(tuple, topk.neighbours(df).collect()))
    assert got == brute(rows)
    assert (0, 1, 1, 3145728000000) in got


def test_scores_beyond_64_bits_rank_exactly_and_are_clamped(spark):
    rows = [(0, [1e30, -1.0]), (1, [1e30, 5.0]), (2, [-1e30, 0.5]), (3, [1e300, 1.0]), (4, [2.0, 1e18]), (5, [-1e30, 0.25]), (100, [-1e305, 1e-300])]
    got = {tuple(r) for r in topk.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    exact = {i: [int(x) * 1024 if abs(x) > 2**53 else math.floor(x * 1024) for x in v] for i, v in rows}
    want = set()
    for i in (0, 100):
        scored = sorted((-sum(a * b for a, b in zip(exact[i], v)), j) for j, v in exact.items() if j != i)
        want |= {(i, n + 1, j, max(-(2**63), min(2**63 - 1, -s))) for n, (s, j) in enumerate(scored)}
    assert got == want
