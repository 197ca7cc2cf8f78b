import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.fixtures import documents, rows
from titrate.llm import collocations as co


def pieces(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in (re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0a-\x0d]", lowered)) if w]


def brute_force(data, least, longest, top):
    n, f = Counter(), defaultdict(Counter)
    for row in data:
        lang = "und" if row[2] is None else row[2]
        for w in pieces(row[1]):
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[k : k + m]) for k in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least}
        inside = defaultdict(int)
        for p, a in often.items():
            for m in range(2, len(p)):
                for k in range(len(p) - m + 1):
                    inside[p[k : k + m]] = max(inside[p[k : k + m]], a)
        scored = []
        for p, a in often.items():
            if len(p) > 1 and inside[p] < a:
                score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def corpus():
    r = random.Random(12)
    words = [f"w{k}" for k in range(40)] + ["É", "日本", "ﬁ", "A"]
    fixed = ["w1 w2 w3 w4 w5 w6", "a a a a a a", "New York", "new york city", "one two", "É 日本 ﬁ"]
    data = []
    for k in range(250):
        parts = []
        for _ in range(r.randrange(0, 25)):
            run = r.choices(words, [1 / (x + 1) for x in range(len(words))], k=r.randrange(0, 12))
            if r.random() < 0.5:
                run.insert(r.randrange(len(run) + 1), r.choice(fixed))
            parts.append((" " if r.random() < 0.8 else " \t ").join(run))
        data.append((k, r.choice([". ", ", ", "\n", ";", "\x0b", "!?"]).join(parts), r.choice(["en", "en", "fr", None, "und", ""]), "web", 0, "m", "u", "t", "k", "d"))
    return data


@pytest.mark.parametrize("least, longest, shard, top", [(20, 5, 1 << 20, 2000), (4, 5, 60, 2000), (6, 3, 500, 7), (5, 2, 300, 50), (10, 6, 400, 2000)])
def test_agrees_with_brute_force(spark, least, longest, shard, top):
    data = corpus()
    docs = documents(spark, data).repartition(3, "doc_id")
    got = co.collocations(docs, min_count=least, max_words=longest, shard_words=shard, top=top).collect()
    want = brute_force(data, least, longest, top)
    assert sorted(tuple(x) for x in got) == want and len(want) > 15


def test_awkward_rows(spark):
    got = co.collocations(documents(spark), min_count=3, shard_words=4000).collect()
    assert sorted(tuple(x) for x in got) == brute_force(rows(), 3, 5, 2000)


def test_empty_tables_and_rare_phrases_give_no_row(spark):
    assert co.collocations(documents(spark, [])).collect() == []
    assert co.collocations(documents(spark), min_count=10**6).collect() == []


def test_intervals_count_phrases():
    r = np.random.default_rng(1)
    tokens = np.r_[r.integers(0, 6, 3000), 0].astype(np.int32)
    ids = np.array([0, 50, 20, 0, 40, 10])
    index = co.Index.of(tokens, ids, 3)
    text = ids[tokens].tolist()
    low, n = index.words()
    state = {(int(w),): (int(a), int(a), int(c)) for w, a, c in zip(index.symbols, low, n, strict=True)}
    for size in (2, 3, 4):
        side = co.RIGHT if size % 2 == 0 else co.LEFT
        heads = list(state)
        low, rlow, n = (np.array([state[h][k] for h in heads]) for k in range(3))
        own, other = (rlow, low) if side == co.RIGHT else (low, rlow)
        grown = {}
        for o, s, a, b, c in zip(*index.extend(side, own, other, n), strict=True):
            w = (int(index.symbols[s - 1]),)
            grown[heads[o] + w if side == co.RIGHT else w + heads[o]] = (int(b), int(a), int(c)) if side == co.RIGHT else (int(a), int(b), int(c))
        want = Counter(t for k in range(len(text) - size + 1) if 0 not in (t := tuple(text[k : k + size])))
        assert {p: x[2] for p, x in grown.items()} == want
        state = grown


@pytest.mark.parametrize("bits", [20, 26, 29])
def test_filters_hold_all_frequent_hashes_and_few_others(spark, bits):
    r = np.random.default_rng(bits)
    hashes = co.hashed("en", r.integers(1, 1 << 62, (4000, 2)))
    parts = []
    for k in range(7):  # the first 300 reach 2100 in all and no more than 300 in any shard
        buckets, cells, times = co.cell_rows(hashes, np.where(np.arange(4000) < 300, 300, 1), bits)
        parts += [(b, bytearray(c), bytearray(t)) for b, c, t in zip(buckets, cells, times, strict=True)]
    rows = spark.createDataFrame(parts, co._CELLS)
    passed = co.Filter(rows, bits, 2100)(hashes)
    assert passed[:300].all() and passed[300:].mean() < 0.01
    assert not co.Filter(rows, bits, 2108)(hashes)[:300].all()


def test_words_that_share_an_id_get_new_ones(spark):
    data = corpus()
    totals, phrases = co.phrase_counts(documents(spark, data), min_count=20, shard_words=500, id_bits=11)
    _, plain = co.phrase_counts(documents(spark, data), min_count=20, shard_words=500)
    assert sorted(map(tuple, phrases.collect())) == sorted(map(tuple, plain.collect()))


def test_index_needs_no_join_and_sends_no_row_for_rare_extensions(spark):
    """A shard gives its counts in a row for each bucket."""
    words = [f"w{k % 211}x" for k in range(211 * 40)]
    random.Random(1).shuffle(words)
    tokens = np.r_[np.unique(words, return_inverse=True)[1] + 1, 0].astype(np.int32)
    index = co.Index.of(tokens, np.r_[0, np.arange(1, 212)], 4)  # 8 440 pairs, most of them different
    row = {"lang": "en", "symbols": index.symbols.tobytes(), "forward": index.sides[co.LEFT].tobytes(), "reverse": index.sides[co.RIGHT].tobytes()}
    import pyarrow as pa

    got = list(co._scan(1, 5, 20, [])(iter([pa.RecordBatch.from_pylist([row])])))
    assert sum(len(b) for b in got) <= 256
    assert sum(sum(t.as_py()) for b in got for t in b.column("times")) == len(words) - 1


def test_shards_are_added_up_before_the_shuffle():
    import pyarrow as pa

    a, b = (np.array(x, dtype=np.int64).tobytes() for x in ([[1, 2], [3, 4]], [[3, 4], [5, 6]]))
    n, m = (np.array(x, dtype=np.int64).tobytes() for x in ([10, 20], [1, 2]))
    rows = pa.record_batch([pa.array(["en", "en", "fr"]), pa.array([9, 9, 9], pa.int32()), pa.array([a, b, b]), pa.array([n, m, m])], names=["lang", "bucket", "ids", "n"])
    (got,) = co._folded(2)(iter([rows]))
    found = {r["lang"]: (np.frombuffer(r["ids"], np.int64).tolist(), np.frombuffer(r["n"], np.int64).tolist()) for r in got.to_pylist()}
    assert found == {"en": ([1, 2, 3, 4, 5, 6], [10, 21, 2]), "fr": ([3, 4, 5, 6], [1, 2])}
