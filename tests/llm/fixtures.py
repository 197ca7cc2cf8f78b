"""Small tables with every awkward row: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, uid string, topic string, key string, `a.b` string"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(("an", "er", "th", "on", "re", "él", "ß")) for _ in range(r.randint(1, 4))) for _ in range(words))


def rows() -> list[tuple]:
    texts = [(k, prose(k, 20 + k)) for k in range(30)]
    texts += [(40, prose(3, 23).upper()), (41, prose(3, 23)), (42, prose(4, 24)), (42, prose(4, 24)), (None, prose(5, 25)), (43, None), (44, ""), (45, " \n\t "), (None, None),
              (46, "x"), (46, "x"), (47, prose(7, 9000)), (48, "the " * 4000), (49, "a" * 3000), (50, "1 2 3-4 " * 3000), (51, "日本語 テスト 🙂 ≥ naïve İ ﬁ"),
              (52, "Kelvin K two\x85three\x1cfour"), (53, "<|endoftext|> it's <|startoftext|>x's WE'LL 12²")]
    rest = [("en", "a"), (None, "a"), ("fr", None), ("en", "b")]
    return [(i, t, *rest[k % 4], None if t is None else len(t), "mine", "u", "t", "k", "dot") for k, (i, t) in enumerate(texts)]


def documents(spark, chosen=None):
    return spark.createDataFrame(rows() if chosen is None else chosen, SCHEMA)
