import random
import re

from tests.llm.fixtures import documents, prose, rows
from titrate.llm import licenses

SPLIT = re.compile(r"[\W_]+")


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in SPLIT.split(lowered) if w]


def shingles(found):
    return [" ".join(found[k : k + 5]) for k in range(max(1, len(found) - 4))] if found else []


def brute(data, templates, share=0.8):
    out = []
    for doc_id, text, *_ in data:
        mine = shingles(words(text))
        for name, body in templates:
            asked = set(shingles(words(body)))
            if not asked:
                continue
            size = 1
            while size < max(1, len(words(body)) - 4):
                size *= 2
            best = max(((len(asked & set(mine[k : k + 2 * size])) / len(asked), -k) for k in range(0, len(mine), size)), default=(0, 0))
            if best[0] >= share - 1e-9:
                out.append((doc_id, name, round(best[0], 6), -best[1]))
    return sorted(out, key=repr)


def test_agrees_with_brute_force(spark):
    r = random.Random(6)
    data = rows()
    for k, (_, body) in enumerate(licenses.TEMPLATES * 6):
        cut = body.split()
        for _ in range(r.randint(0, 2)):  # worn copies, some beyond recognition
            cut[r.randrange(len(cut))] = "worn"
        before = prose(k, r.randint(0, 60))
        data.append((500 + k, f"{before} {' '.join(cut).upper() if k % 5 == 0 else ' '.join(cut)} {prose(k + 1, 30)}", *data[0][2:]))
    data += [(900, "license", *data[0][2:]), (901, "under the MIT License released", *data[0][2:]), data[-1], (902, "license " * 5000, *data[0][2:])]
    got = licenses.scan(documents(spark, data), licenses.template_table(spark)).select("doc_id", "template_id", "containment", "first_word").collect()
    want = brute(data, licenses.TEMPLATES)
    assert sorted((tuple(x) for x in got), key=repr) == want and len(want) > 20


def test_templates_of_any_size(spark):
    templates = [("none", ""), ("null", None), ("word", "copyright"), ("two", "all rights"), ("long", prose(77, 700)), ("long", prose(77, 700))]
    data = [(1, "copyright", *[None] * 8), (2, "All Rights", *[None] * 8), (3, f"{prose(1, 300)} {prose(77, 700)}", *[None] * 8), (4, "copyright all rights", *[None] * 8)]
    got = licenses.scan(documents(spark, data), licenses.template_table(spark, templates)).collect()
    assert {(x["doc_id"], x["template_id"]) for x in got} == {(1, "word"), (2, "two"), (3, "long")}
    assert licenses.scan(documents(spark, []), licenses.template_table(spark)).count() == 0
    assert licenses.scan(documents(spark, data), licenses.template_table(spark, templates[:2])).count() == 0


def test_bands_make_misses_rare():
    for n in range(1, 300):
        size = 1 << max(0, n - 1).bit_length()
        held = -(-8 * n // 10)
        assert (1 - held / (2 * size + n - held)) ** licenses.bands_for(n, size, 0.8) <= 1e-6
