import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.fixtures import documents, rows
from titrate.llm import token_counts
from titrate.llm.packing import vocabulary


def greedy(word, initial, continuing):
    at = count = 0
    while at < len(word):
        pieces = continuing if at else initial
        for end in range(len(word), at, -1):
            if word[at:end] in pieces:
                break
        else:
            return 0
        at, count = end, count + 1
    return count


pieces = st.lists(st.text("abc", min_size=1, max_size=5), max_size=12)


@settings(max_examples=300, deadline=None)
@given(pieces, pieces, st.lists(st.text("abcd", min_size=1, max_size=14), max_size=20))
def test_counts_like_greedy_longest_match(initial, continuing, words):
    automaton = token_counts.LongestMatch(initial, continuing)
    assert [automaton.count(w) for w in words] == [greedy(w, set(initial), set(continuing)) for w in words]


def test_whole_vocabulary(spark):
    initial, continuing = token_counts.pieces_of(vocabulary("byte_bpe_50k.json"))
    assert len(initial) > 20_000 and len(continuing) > 10_000
    automaton = token_counts.LongestMatch(initial, continuing)
    sets, r = (set(initial), set(continuing)), random.Random(2)
    words = ["".join(r.choice(initial + continuing) for _ in range(r.randint(1, 4))) for _ in range(3000)]
    assert [automaton.count(w) for w in words] == [greedy(w, *sets) for w in words]
    want = []
    for row in rows():
        counts = [greedy(w, *sets) for w in re.findall(token_counts.WORDS, row[1] or "")]
        want.append((row[0], len(counts), sum(c or 1 for c in counts), counts.count(0)))
    found = token_counts.token_counts(documents(spark).withColumnRenamed("key", "N_Words"), vocabulary("byte_bpe_50k.json"), memo_words=40)
    assert found.columns[-3:] == ["n_words", "n_tokens", "n_unknown"] and "N_Words" not in found.columns
    assert sorted((tuple(x) for x in found.select("doc_id", "n_words", "n_tokens", "n_unknown").collect()), key=repr) == sorted(want, key=repr)
    assert token_counts.token_counts(documents(spark, []), vocabulary("byte_bpe_50k.json")).count() == 0
