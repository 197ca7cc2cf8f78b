import math
import random

import numpy as np
import pytest

from titrate.llm import exact_topk

SCHEMA = "vec_id bigint, embedding array<float>, slot string, low string, n int"


def brute(data, k=5, every=50, scale=256):
    vectors = []
    for uid, (vec_id, e, *_) in enumerate(data):
        if vec_id is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        vectors.append((uid, vec_id, [math.floor(scale * float(np.float32(x))) for x in e]))
    out = []
    for uid, vec_id, q in vectors:
        if vec_id % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for u, i, v in vectors if u != uid and len(v) == len(q))
        out += [(vec_id, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def data():
    r = random.Random(5)
    made = [(k, [r.gauss(0, 0.2) for _ in range(8)], "s", "l", 1) for k in range(400)]
    made += [(50, made[50][1], "s", "l", 1), (700, made[50][1], "s", "l", 1), (701, made[50][1], "s", "l", 1)]  # repeated row, ties
    made += [(None, made[1][1], "s", "l", 1), (800, None, "s", "l", 1), (850, [1.0, float("nan")] * 4, "s", "l", 1), (900, [float("inf")] * 8, "s", "l", 1),
             (950, [None] + [0.0] * 7, "s", "l", 1), (1000, [0.5, -0.5], "s", "l", 1), (1050, [], "s", "l", 1), (-50, [0.0] * 8, "s", "l", 1)]
    return made


@pytest.mark.parametrize("block_rows,query_rows", [(4096, 256), (16, 3)])
def test_agrees_with_brute_force(spark, block_rows, query_rows):
    rows = data()
    found = exact_topk.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), block_rows=block_rows, query_rows=query_rows)
    assert sorted(tuple(x) for x in found.collect()) == brute(rows)


def test_few_candidates_and_empty_tables(spark):
    three = [(k, [float(k), 1.0], "", "", 0) for k in (0, 1, 2)]
    assert sorted(tuple(x) for x in exact_topk.top_k(spark.createDataFrame(three, SCHEMA)).collect()) == brute(three)
    assert exact_topk.top_k(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("largest", [1e6, 1e7, 1e9, 1e15])
def test_large_components_and_repeated_ids(spark, largest):
    """Sums beyond doubles, and sums that leave 64 bits on the way to a result within them."""
    r = random.Random(int(largest))
    rows = [(k % 150, [r.choice((0.0, 1.0, -1.0, largest, -largest)) if k % 50 else float(k % 3) / 256 for _ in range(6)], "", "", 0) for k in range(200)]
    rows += [(0, [1.0, 1.0], "", "", 0), (1, [largest, 0.0], "", "", 0), (2, [2 * largest, 0.0], "", "", 0), (0, [largest / 4, 1.0], "", "", 0)]
    if largest > 1e8:
        rows = [x for x in rows if x[0] % 50 or max(map(abs, x[1])) <= 1]
    if largest > 1e12:
        rows = [x for x in rows if len(x[1]) == 6]
    found = exact_topk.top_k(spark.createDataFrame(rows, SCHEMA).coalesce(1), block_rows=32)
    assert sorted(tuple(x) for x in found.collect()) == brute(rows)


def test_components_beyond_the_bound_are_refused():
    assert exact_topk.components_of([2.0**53], 256).tolist() == [1 << 61]
    with pytest.raises(ValueError):
        exact_topk.components_of([2.0**54], 256)


@pytest.mark.parametrize("spread", [3, 300, 1 << 20, 1 << 27])
def test_bounds_hold(spread):
    r = np.random.default_rng(spread)
    vectors, queries = (r.integers(-spread, spread + 1, (n, 16)) for n in (300, 40))
    low, high = exact_topk.bounds(queries, *exact_topk.approximate(vectors))
    exact = queries @ vectors.T
    assert (low <= exact).all() and (exact <= high).all()


def test_reading_ends_once_the_result_is_certain():
    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, some):
            reads.append(len(some))
            return np.asarray(self)[some]

    r = np.random.default_rng(1)
    vectors = r.integers(-40, 41, (4000, 64))
    _, high = exact_topk.bounds(vectors[:1], *exact_topk.approximate(vectors))
    best = exact_topk.visit(vectors[0], high[0], vectors.view(Counted), np.arange(4000), np.arange(4000) != 0, -(1 << 60), 5)
    exact = vectors @ vectors[0]
    assert [s for s, _ in best] == sorted(exact[1:].tolist(), reverse=True)[:5] and sum(reads) < 400


def test_copies_of_queries_are_never_broadcast(spark):
    """The optimizer sees the size of one copy: broadcast, all of them would pass through the driver."""
    docs = spark.createDataFrame(data(), SCHEMA)
    got = exact_topk.top_k(docs)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 2
