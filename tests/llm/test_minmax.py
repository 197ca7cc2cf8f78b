import math
import random

import numpy as np
import pytest

from tests.llm.fixtures import documents, rows
from titrate.llm import minmax


def shingle_set(text, size):
    found = (text or "").encode().lower().split()
    return {tuple(found[k : k + size]) for k in range(max(1, len(found) - size + 1))} if found else set()


def similar(a, b, percent=80, link_blank=False):
    return 100 * len(a & b) >= percent * len(a | b) if a | b else link_blank


def edited(r, words, times):
    words = list(words)
    for k in r.sample(range(len(words)), times):
        words[k] = f"x{r.randrange(10**6)}"
    return words


def corpus(seed=11):
    """Copies at all similarities, a chain, a family around a text of its own, texts with one common passage, texts without words."""
    r = random.Random(seed)

    def prose(n):
        return [f"w{r.randrange(3000)}" for _ in range(n)]

    texts = []
    for n in (3, 40, 120, 400, 1500):
        for k in range(15):
            base = prose(n)
            texts += [base, edited(r, base, max(1, n * k // 250))]
    chain = prose(300)
    for _ in range(40):
        texts.append(chain)
        chain = edited(r, chain, 9)
    middle = prose(250)
    texts += [edited(r, middle, 5 + k % 16) for k in range(80)]
    passage = prose(60)
    texts += [passage + prose(r.randrange(5, 50)) for _ in range(120)]
    texts += [["ab"], ["AB"], ["  "], [], ["ab", "cd"]]
    r.shuffle(texts)
    return [(1000 - k, " ".join(t) if t or k % 2 else None, "en", "web", 0, "mine", "u", "t", "k", "dot") for k, t in enumerate(texts)]


def brute_force(data, size, percent=80, link_blank=False):
    """[(doc_id, n_shingles, component_id)] by comparing all pairs."""
    sets = [shingle_set(x[1], size) for x in data]
    head = list(range(len(data)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for b in range(len(data)):
        for a in range(b):
            if similar(sets[a], sets[b], percent, link_blank):
                head[find(b)] = find(a)
    ids = {}
    for k, row in enumerate(data):
        ids.setdefault(find(k), []).append(row[0])
    return [(row[0], len(sets[k]), min((x for x in ids[find(k)] if x is not None), default=None)) for k, row in enumerate(data)], len(ids)


@pytest.mark.parametrize("size, percent, link_blank, block", [(2, 80, False, 4096), (2, 80, False, 8), (5, 80, True, 4096), (3, 60, False, 16)])
def test_agrees_with_brute_force(spark, size, percent, link_blank, block):
    data = corpus()
    want, classes = brute_force(data, size, percent, link_blank)
    docs = documents(spark, data).repartition(5, "doc_id")
    got = minmax.near_duplicates(docs, words=size, percent=percent, link_blank=link_blank, block_nodes=block).collect()
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == sorted(want)
    assert classes < len(data) - 40 and sum(x["kept"] for x in got) == classes
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)


def test_awkward_rows_repeated_ids_and_empty_tables(spark):
    data = rows() * 2
    want, classes = brute_force(data, 2)
    got = minmax.near_duplicates(documents(spark, data)).collect()
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got), key=repr) == sorted(want, key=repr)
    assert sum(x["kept"] for x in got) == classes
    assert minmax.near_duplicates(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        minmax.near_duplicates(documents(spark, []), percent=0)


def family(n, edits, words=400):
    """Members that differ from one text in ``edits`` words each: no two are similar enough, all are similar."""
    r = random.Random(5)
    base = [f"w{k}" for k in range(words)]
    return [" ".join(edited(r, base, edits)) for _ in range(n)]


def cell_of(texts, size=2, percent=80, side=None):
    bands = minmax.bands_for(percent)
    permutations, mixers = minmax.factors(bands)
    sets = [minmax.shingles(t, size) for t in texts]
    made = np.stack([minmax.signature(x, permutations, len(mixers)) for x in sets])
    keys = (made * mixers).reshape(len(texts), bands, -1).sum(2, dtype=np.uint64).view(np.int64)
    columns = {"node": np.arange(len(texts)), "label": np.arange(len(texts)), "n": np.array([len(x) for x in sets]), "sketch": (made >> np.uint64(8)).astype(np.uint8),
               "keys": keys, "band": np.zeros(len(texts), dtype=int), "side": np.zeros(len(texts), dtype=int) if side is None else side}
    return columns, sets


@pytest.mark.parametrize("n", [100, 200, 400])
def test_families_below_the_share_give_no_rows_and_above_it_a_forest(n):
    for edits, linked in ((26, 0), (4, 1)):
        columns, sets = cell_of(family(n, edits))
        columns["keys"] = np.zeros_like(columns["keys"])  # as if all shared the first bucket
        cell = minmax.Cell(columns, 80, minmax.least_agreeing(columns["sketch"].shape[1], 80))
        assert len(minmax.flagged(cell)) <= n
        assert len(minmax.forest(cell, sets)) == linked * (n - 1)


def test_seeking_rows_grow_with_members_only(spark):
    """Written rows of candidates over a family without links: at most one for each member and bucket."""
    seen = {}
    real = minmax.written

    def noting(df, name):
        out = real(df, name)
        seen.setdefault(name, []).append(out.count())
        return out

    minmax.written = noting
    try:
        counts = {}
        for n in (100, 200, 400):
            seen.clear()
            data = [(k, t, "en", "a", 0, "", "", "", "", "") for k, t in enumerate(family(n, 26))]
            assert minmax.near_duplicates(documents(spark, data)).select("component_id").distinct().count() == n
            counts[n] = seen["seeking"][0]
    finally:
        minmax.written = real
    bands = minmax.bands_for(80)
    assert all(counts[n] <= n * bands for n in counts) and counts[400] <= 6 * max(counts[100], 100)


def test_signature_values_agree_as_often_as_the_sets_do():
    r = np.random.default_rng(3)
    permutations, mixers = minmax.factors(minmax.bands_for(80))
    assert 2 * len(permutations) - len(mixers) in (0, 1)  # half the evaluations
    for share in (0.3, 0.8):
        agreed = []
        for _ in range(40):
            union = r.integers(0, 1 << 64, 400, dtype=np.uint64)
            common, rest = union[: int(400 * share)], union[int(400 * share) :]
            half = len(rest) // 2
            a, b = np.concatenate([common, rest[:half]]), np.concatenate([common, rest[half:]])
            agreed.append((minmax.signature(a, permutations, len(mixers)) == minmax.signature(b, permutations, len(mixers))).mean())
        assert abs(np.mean(agreed) - share) < 3 * math.sqrt(share * (1 - share) / (40 * len(mixers))) + 0.01


def test_bands_take_both_values_of_no_permutation_and_miss_less_than_one_in_a_million():
    bands = minmax.bands_for(80)
    assert (1 - 0.8**minmax.ROWS) ** bands <= 1e-6 < (1 - 0.8**minmax.ROWS) ** (bands - 1)
    permutations, mixers = minmax.factors(bands)
    source = np.arange(len(mixers)) % len(permutations)
    assert all(len(set(x)) == minmax.ROWS for x in source.reshape(bands, -1).tolist())
    values = bands * minmax.ROWS
    assert 0.6 * values < minmax.least_agreeing(values, 80) < 0.7 * values
