import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.fixtures import documents, rows
from titrate.llm import packing


def first_fit_decreasing(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        for b in bins:
            if sum(b) + n <= capacity:
                b.append(n)
                break
        else:
            bins.append([n])
    return bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
def test_tree_places_like_plain_first_fit(lengths):
    tree = packing.FirstFit(len(lengths), 64)
    got = defaultdict(list)
    for n in sorted(lengths, reverse=True):
        got[tree.place(n)].append(n)
    assert [got[k] for k in sorted(got)] == first_fit_decreasing(lengths, 64)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 128), min_size=1, max_size=60))
def test_groups_are_whole_and_gapless(lengths):
    out = packing.pack_group(lengths, 128, 4)
    taken, filled = defaultdict(int), defaultdict(int)
    for piece, first, n, sequence, offset in sorted(out, key=lambda x: (x[3], x[4])):
        assert n > 0 and first == taken[piece] and offset == filled[sequence]
        taken[piece] += n
        filled[sequence] += n
    assert [taken[k] for k in range(len(lengths))] == lengths and sorted(filled) == list(range(len(filled)))
    assert all(n <= 128 and (128 - n <= 4 or n & (n - 1) == 0) for n in filled.values())


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    words = packing.WordIds(packing.vocabulary(), memo_pieces=50)
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    latin = "".join(map(chr, range(1, 0x250)))
    for text in [*(r[1] for r in rows()), latin, latin.lower(), latin[32:], latin[160:255] * 2, "don't WE'RE it'S o'clock's 'd''s", "a\xad\xa0b \x85 c", "x<|y|>z <|ENDOFTEXT|>"]:
        want = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(words.ids(text), dtype="<u4").tolist() == want


def test_documents_come_back_whole(spark):
    from tokenizers import Tokenizer

    data = rows()
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    want = sorted(tuple([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in data)
    got = packing._digest(packing.pack(documents(spark), packing.vocabulary(), group_pieces=7)).collect()
    pieces = packing.pack(documents(spark), packing.vocabulary(), group_pieces=7).collect()
    by = defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(bytes(p["ids"]), dtype="<u4")
        assert len(ids) == p["length"] and p["length"] <= 4096
        by[p["sequence_id"]].append((p["offset"], p["length"]))
    for places in by.values():
        assert [o for o, _ in sorted(places)] == np.cumsum([0, *[n for _, n in sorted(places)]])[:-1].tolist()
    assert sum(p["length"] for p in pieces) == sum(map(len, want))
    starts = defaultdict(list)
    for p in pieces:
        starts[p["doc_id"]].append(p)
    single = {r[0] for r in data if r[0] is not None and [x[0] for x in data].count(r[0]) == 1}
    for r in data:
        if r[0] in single:
            ids = b"".join(bytes(p["ids"]) for p in sorted(starts[r[0]], key=lambda p: p["start"]))
            assert tuple(np.frombuffer(ids, dtype="<u4").tolist()) in want and starts[r[0]][0]["doc_tokens"] * 4 == len(ids)
    assert sorted(x["ids_crc32"] for x in got) == sorted(zlib.crc32(bytes(p["ids"])) for p in pieces)
    assert packing.pack(documents(spark, []), packing.vocabulary()).count() == 0
