import itertools
import random

import numpy as np
import xxhash

from tests.llm.fixtures import documents, rows
from titrate.llm import simhash


def brute_print(text):
    found, word = [], b""
    for c in (text or "").encode() + b" ":
        if c in b" \t\n\x0b\x0c\r":
            found, word = found + [word] if word else found, b""
        else:
            word += bytes([c + 32 if 65 <= c <= 90 else c])
    if not found:
        return 0
    shingles = [b" ".join(found[k : k + 4]) for k in range(max(1, len(found) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    """Smallest reachable index of each, by depth-first search over all pairs."""
    head = [-1] * len(prints)
    for k in range(len(prints)):
        if head[k] >= 0:
            continue
        todo, head[k] = [k], k
        while todo:
            at = todo.pop()
            for m in range(len(prints)):
                if head[m] < 0 and (prints[m] ^ prints[at]).bit_count() <= 4:
                    head[m] = k
                    todo.append(m)
    return head


def signed(x):
    return np.array(x, dtype=np.uint64).view(np.int64)


def test_golay_words_two_bits_apart_share_a_key():
    tables = simhash.golay_tables()
    remainders, patterns = tables
    assert ((patterns >= 0).sum(1) == np.where((patterns[:, 1] >= 0), 6, 1)).all()
    leaders = np.array([sum(1 << b for b in bits) for w in range(4) for bits in itertools.combinations(range(23), w)], dtype=np.int64)
    near = np.array([sum(1 << b for b in bits) for w in range(3) for bits in itertools.combinations(range(23), w)], dtype=np.int64)
    mine = simhash.codeword_indices(leaders, tables)
    for flips in near:
        other = simhash.codeword_indices(leaders ^ flips, tables)
        shared = (mine[:, :, None] == other[:, None, :]) & (mine[:, :, None] >= 0)
        assert shared.any((1, 2)).all()


def test_every_link_shares_a_key():
    r = random.Random(1)
    tables = simhash.golay_tables()
    a = [r.getrandbits(64) for _ in range(3000)]
    b = [x ^ sum(1 << k for k in r.sample(range(64), 4)) for x in a]
    keys = [simhash.candidate_keys(signed(x), tables) for x in (a, b)]
    sets = [[set() for _ in a] for _ in keys]
    for k, (key, owner) in enumerate(keys):
        for x, o in zip(key.tolist(), owner.tolist(), strict=True):
            sets[k][o].add(x)
    assert all(x & y for x, y in zip(*sets, strict=True))


def test_bucket_forest_joins_what_links_join():
    r = random.Random(2)
    for trial in range(30):
        base = [r.getrandbits(64) for _ in range(3)]
        prints = list({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 9))) for b in base for _ in range(25)})
        u, v = simhash.bucket_edges(signed(prints), 4)
        assert len(u) < len(prints)
        head = {x: x for x in signed(prints).tolist()}

        def find(x):
            while head[x] != x:
                x = head[x]
            return x

        for x, y in zip(u.tolist(), v.tolist(), strict=True):
            assert ((x ^ y) & (2**64 - 1)).bit_count() <= 4
            head[find(x)] = find(y)
        want = brute_components(prints)
        got = [find(x) for x in signed(prints).tolist()]
        assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_agrees_with_brute_force(spark):
    data = rows()
    r = random.Random(3)
    base = data[20][1].split() * 4
    for k in range(60):  # a family of near copies, chained
        base[r.randrange(len(base))] = f"w{k}"
        data.append((100 + k, " ".join(base), *data[0][2:]))
    prints = [brute_print(x[1]) for x in data]
    assert [simhash.fingerprint(x[1]) & (2**64 - 1) for x in data] == prints
    head = brute_components(prints)
    want = []
    for k, row in enumerate(data):
        ids = [data[m][0] for m in range(len(data)) if head[m] == head[k] and data[m][0] is not None]
        want.append((row[0], f"{prints[k]:016x}", min(ids, default=None)))
    found = simhash.near_duplicates(documents(spark, data).repartition(4, "doc_id"))
    got = found.collect()
    assert sorted(((x["doc_id"], x["fingerprint"], x["component_id"]) for x in got), key=repr) == sorted(want, key=repr)
    kept = [x for x in got if x["kept"]]
    assert len(kept) == len(set(head))


def test_stage_keeps_one_of_each(spark):
    kept = simhash.stage(spark, documents(spark, rows()[:12] * 2), "")
    assert kept.columns == documents(spark, []).columns and kept.count() == 12
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
