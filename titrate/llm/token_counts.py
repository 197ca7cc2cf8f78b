"""Operator 7: word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie with a second root for continuing pieces. Every node has a failure link and the number of pieces that are popped when the
link is followed, computed once, breadth first. A word is read character by character, each once; the count of greedy longest-match pieces comes out
without any piece being built.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titrate.llm.common import per_worker, replacing, table, travels
from titrate.llm.packing import vocabulary
from titrate.llm.registry import query

WORDS = r"\w+|[^\w\s]"  # runs of word characters; any other visible character is a word of its own
MEMO_WORDS = 1_000_000


class LongestMatch:
    """Counts of greedy longest-match pieces; 0 for a word that cannot be cut into pieces."""

    def __init__(self, initial: Iterable[str], continuing: Iterable[str]) -> None:
        self.next: list[dict[str, int]] = [{}, {}]  # 0: begin of a word, 1: after a piece
        self.fail = [-1, -1]
        self.pops = [0, 0]
        whole = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                at = root
                for c in piece:
                    to = self.next[at].get(c)
                    if to is None:
                        to = self.next[at][c] = len(self.next)
                        self.next.append({})
                        self.fail.append(-1)
                        self.pops.append(0)
                        whole.append(False)
                    at = to
                if piece:
                    whole[at] = True
        level = [0, 1]
        while level:
            below = []
            for u in level:
                for c, v in self.next[u].items():
                    below.append(v)
                    if whole[v]:
                        self.fail[v], self.pops[v] = 1, 1
                        continue
                    at, popped = self.fail[u], self.pops[u]
                    while at >= 0 and c not in self.next[at]:
                        popped += self.pops[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[v], self.pops[v] = self.next[at][c], popped
            level = below

    def count(self, word: str) -> int:
        after, fail, pops = self.next, self.fail, self.pops
        at = pieces = 0
        for c in word:
            to = after[at].get(c)
            while to is None:
                pieces += pops[at]
                at = fail[at]
                if at < 0:
                    return 0
                to = after[at].get(c)
            at = to
        while at != 1:
            pieces += pops[at]
            at = fail[at]
            if at < 0:
                return 0
        return pieces


def pieces_of(path: str) -> tuple[list[str], list[str]]:
    """(initial, continuing) pieces of a byte-level vocabulary: a leading space mark begins a word; pieces that are no whole text are left out."""
    with open(path, encoding="utf-8") as file:
        vocab = json.load(file)["model"]["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    back = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    initial, continuing = [], []
    for token in vocab:
        if any(c not in back for c in token):
            continue
        try:
            text = bytes(back[c] for c in token).decode()
        except UnicodeDecodeError:
            continue
        if text.startswith(" ") and len(text) > 1:
            initial.append(text[1:])
        elif text.strip():
            continuing.append(text)
    return initial, continuing


def _counter(path: str, memo_words: int):
    """Counts of one text: words, pieces, words that cannot be cut. The memo of words starts anew when it is full."""
    automaton = per_worker(f"automaton {path}", lambda: LongestMatch(*pieces_of(path)))
    words = re.compile(WORDS).findall
    memo: dict[str, int] = per_worker(f"counts {path}", dict)

    def known(word: str) -> int:
        found = memo[word] = automaton.count(word)
        return found

    def count(text: str | None) -> tuple[int, int, int]:
        if not text:
            return 0, 0, 0
        if len(memo) > memo_words:
            memo.clear()
        get = memo.get
        counts = [n if (n := get(w)) is not None else known(w) for w in words(text)]
        lost = counts.count(0)
        return len(counts), sum(counts) + lost, lost

    return count


def token_counts(docs: DataFrame, vocabulary_path: str, text: str = "text", memo_words: int = MEMO_WORDS) -> DataFrame:
    """Every row of ``docs`` with n_words, n_tokens and n_unknown (long).

    A word that the vocabulary cannot cut counts as one (unknown) token. Null and empty texts, and white space, count zero. The order of rows, copies
    and other columns play no part; an empty table gives an empty table. Input columns named like a result column are replaced.
    """

    @F.pandas_udf("n_words long, n_tokens long, n_unknown long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count = _counter(vocabulary_path, memo_words)
        for texts in batches:
            yield pd.DataFrame([count(t) for t in texts], columns=["n_words", "n_tokens", "n_unknown"], dtype="int64")

    own = [f"`{c}`" for c in replacing(docs, "n_words", "n_tokens", "n_unknown").columns]
    return docs.withColumn("__counts", counted(F.col(text))).select(*own, "__counts.n_words", "__counts.n_tokens", "__counts.n_unknown")


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, vocabulary("byte_bpe_50k.json")).select("doc_id", "n_words", "n_tokens", "n_unknown")


travels(__name__)
