import math
import random

import numpy as np
import pytest

from titrate.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, label int, embedding array<double>, uid string, id string, n int, part string, score string, `a.b` string"


def rows(seed=5, count=330, scale=1.0):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(3)]
    made = []
    for k in range(count):
        label = r.randrange(4)
        x = [scale * (c + r.gauss(0, 0.5)) for c in centres[label % 3]]
        made.append((k, label, x))
    made += [(50, 1, made[3][2]), (50, 1, made[3][2]), (7, 2, made[4][2])]  # repeated ids and vectors
    made += [(1000 + k, k % 2, [1.0, 0, 0, 0, 0, 0]) for k in range(60)]  # ties
    made += [(2000, 1, None), (None, 1, [0.0] * 6), (2050, None, [1.0] * 6), (2100, 1, [1.0, None, 0, 0, 0, 0]), (2150, 1, [math.nan] * 6),
             (2200, 1, [math.inf] * 6), (2250, 1, []), (2300, 2, []), (2350, 1, [0.0] * 6), (2400, 0, [1.0, 2.0]), (2401, 0, [1.0, 2.0]), (2402, 1, [1.0, 1.0])]
    return [(i, lab, None if e is None else [None if x is None else float(x) for x in e], "u", "i", 1, "p", "s", "d") for i, lab, e in made]


def brute_force(data, k, m, lowest, highest, every):
    ok = [(i, lab, [math.floor(256 * x) for x in e]) for i, lab, e, *_ in data
          if i is not None and lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, (i, lab, e) in enumerate(ok):
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(e, f, strict=True)), j, b, other) for b, (j, other, f) in enumerate(ok) if b != a and len(f) == len(e))
        for s, j, _, _ in [x for x in scored if x[3] == lab][:k]:
            fits = [x for x in scored if x[3] != lab and lowest * -s <= 100 * -x[0] <= highest * -s]
            out += [(i, j, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fits[:m])]
    return sorted(out)


@pytest.mark.parametrize("scale, every, block", [(1.0, 50, 1 << 18), (1.0, 10, 120), (1e6, 25, 300), (3e5, 50, 1 << 18)])
def test_agrees_with_brute_force(spark, scale, every, block):
    data = rows(scale=scale)
    vectors = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = hn.hard_negatives(vectors, every=every, block_values=block, anchor_values=max(6, block // 16))
    want = brute_force(data, 5, 3, 50, 95, every)
    assert sorted(tuple(x) for x in got.collect()) == want and len(want) > 50


def test_empty_table_gives_no_row(spark):
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []


def test_reading_stops_early_and_misses_nothing():
    made = np.random.default_rng(3)
    exact = made.integers(-20, 20, (4000, 8))
    exact[:40] += 400
    lists = hn.sorted_lists(exact)
    anchor = exact[0]
    read = 0
    for fresh, threshold in hn.accesses(anchor, exact, lists):
        read += len(fresh)
        if threshold is not None and threshold < np.sort(exact @ anchor)[-5]:
            break
    assert read < 1500
    ids = np.arange(4000)
    found = hn.best_rows(anchor, exact, lists, np.ones(4000, dtype=bool), ids, ids, [(None, None), (10, 500)], 5)
    scored = sorted(zip((-(exact @ anchor)).tolist(), ids.tolist(), strict=True))
    assert [x[:2] for x in found[0]] == scored[:5]
    assert [x[:2] for x in found[1]] == [x for x in scored if 10 <= -x[0] <= 500][:5]


def test_no_wrong_result_beyond_64_bits():
    with pytest.raises(ValueError):
        hn.components_of([1e300], 256)
    big = hn.fitting(np.array([[1 << 40, 1 << 40]]), 1 << 40)
    assert int((big @ big[0])[0]) == 2 << 80


def test_copies_of_anchors_are_never_broadcast(spark):
    """The optimizer sees the size of one copy: broadcast, all of them would pass through the driver."""
    got = hn.hard_negatives(spark.createDataFrame(rows(), SCHEMA))
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
