import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, rows
from titrate.llm import mixing


def brute(data, targets=None):
    """(doc_id, tokens, probability) of each row."""
    parsed = []
    for doc_id, text, lang, source, *_ in data:
        text = text or ""
        topic = "contact" if "@" in text else "legal" if "licen" in text or "Licen" in text else "tabular" if " | " in text else "prose"
        parsed.append((doc_id, len(re.findall(r"[^ \t-\r]+", text)), (source or "", lang or "", topic)))
    cells = defaultdict(int)
    for _, n, cell in parsed:
        cells[cell] += n
    cells = {c: n for c, n in cells.items() if n}
    weight = {c: float(n) for c, n in cells.items()}
    wanted = []
    for d, name in enumerate(mixing.DIMENSIONS):
        sums = defaultdict(int)
        for c, n in cells.items():
            sums[c[d]] += n
        pull = {v: n ** mixing.TEMPER[name] for v, n in sums.items()}
        default = {v: x / sum(pull.values()) for v, x in pull.items()}
        wanted.append((targets or {}).get(name, default))
    for _ in range(mixing.SWEEPS):
        for d, target in enumerate(wanted):
            sums = defaultdict(float)
            for c, w in weight.items():
                sums[c[d]] += w
            weight = {c: w * target.get(c[d], 0.0) / sums[c[d]] if sums[c[d]] else 0.0 for c, w in weight.items()}
    total, raked = sum(cells.values()), sum(weight.values())
    factor = {c: weight[c] / cells[c] * total / raked for c in cells}
    scale = mixing.RATE
    for _ in range(mixing.CALIBRATIONS):
        full = {c for c in cells if factor[c] * scale >= 1}
        rest = sum(factor[c] * n for c, n in cells.items() if c not in full)
        scale = max(0, mixing.RATE * total - sum(cells[c] for c in full)) / rest if rest else scale
    return [(i, n, min(1.0, factor.get(c, 0.0) * scale)) for i, n, c in parsed]


@pytest.mark.parametrize("targets", [None, {"source": {"a": 0.5, "b": 0.5, "absent": 0.0}, "lang": {"en": 0.9, "": 0.1}}])
def test_agrees_with_brute_force(spark, targets):
    data = rows() + [(200 + k, f"see a@b.c {k}", *x[2:]) for k, x in enumerate(rows())] + [(300, "x licensed | y", *rows()[0][2:])]
    tables = targets and {d: spark.createDataFrame(list(t.items()), "value string, target double") for d, t in targets.items()}
    found = mixing.mix(documents(spark, data), tables)
    assert found.columns[-4:] == ["topic", "n_tokens", "probability", "sampled"] and found.columns.count("topic") == 1
    got = sorted((tuple(x) for x in found.select("doc_id", "n_tokens", "probability", "sampled").collect()), key=repr)
    want = sorted(((i, n, p) for i, n, p in brute(data, targets)), key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in sorted(got, key=lambda x: x[2])] == pytest.approx([w[2] for w in sorted(want, key=lambda x: x[2])], abs=1e-8)
    for i, _, p, sampled in got:
        u = int(hashlib.md5(f"7:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 16**13
        assert sampled == (u < p)


def test_sample_meets_the_targets(spark):
    r = random.Random(9)
    data = [(k, "w " * r.randint(1, 40), r.choice(("en", "en", "fr")), "hot" if k % 3 else r.choice("abc"), 0, "", "", "", "", "") for k in range(6000)]
    target = {"hot": 0.4, "a": 0.2, "b": 0.2, "c": 0.2}
    tables = {"source": spark.createDataFrame(list(target.items()), "value string, target double")}
    found = mixing.mix(documents(spark, data), tables, rate=0.3).where("sampled").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    total = sum(x["n"] for x in found)
    assert {x["source"]: x["n"] / total for x in found} == pytest.approx(target, abs=0.03)


def test_empty_tables_and_texts(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    blank = mixing.mix(documents(spark, [(1, None, *[None] * 8), (2, " ", *[None] * 8)])).collect()
    assert [(x["n_tokens"], x["probability"], x["sampled"]) for x in blank] == [(0, 0.0, False)] * 2
