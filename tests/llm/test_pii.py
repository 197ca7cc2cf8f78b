import hashlib
import random
import re

from tests.llm.fixtures import documents, rows
from titrate.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": pii.IBAN,
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def good(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "iban":
        plain = m.replace(" ", "")
        return pii.IBAN_LENGTHS.get(plain[:2]) == len(plain) and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    return True


def brute(text):
    return sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if good(kind, m[0]))


TEXTS = [
    "mail a.b@c.de, x@y, p@q.r.s_t@u.vw a@b.c@d.e é@x.io +@-.-", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0000255.0.00.1 9.9.9 1.2.3.4.", "4111 1111 1111 1111, 4111-1111-1111-1112 420705 1279108084",
    "tel +1 (375) 555-4393 and +49 30 1234567 8 +12 +1--------- +1234567890123456 ++1 555 555 5555", "IBAN DE89370400440532013000 GB82 WEST 1234 5698 7654 32 DE00370400440532013000",
    "🙂🙂 a@b.cd 🙂 4111111111111111", "a@b.c " * 700, "7" * 20000, "x" * 2500 + "@", "1 " * 9000, "+1" + " " * 9000 + "2", "@@..@@", "a" * 2000 + "@b.c",
]


def digest(spans):
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)


def test_agrees_with_brute_force(spark):
    r = random.Random(4)
    noise = ["".join(r.choice("0123456789 -.+@ab()AGB") for _ in range(400)) for _ in range(60)]
    data = [(k, t, "en", "s", 0, "", "", "", "", "") for k, t in enumerate([*TEXTS, *TEXTS[:2], *noise])] + [(x[0] and x[0] + 1000, *x[1:]) for x in rows()]
    docs = documents(spark, data).withColumnRenamed("kept", "PII")
    got = {}
    for x in pii.digest(pii.find(docs)).collect():
        got.setdefault(x["doc_id"], []).append(tuple(x)[1:])
    want = {}
    for doc_id, text, *_ in data:
        spans = brute(text)
        base = [s for s in spans if s[1] < 4]
        want.setdefault(doc_id, []).append((*(sum(s[3] == k for s in spans) for k in list(BASE)[:4]), hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert sum(x[5].count("iban") for v in got.values() for x in v) >= 2


def test_context_raises_the_score(spark):
    docs = documents(spark, [(1, "call +1 375 555 4393 or +1 375 555 4394 then", *[None] * 8)])
    first, second = pii.find(docs).first()["pii"]
    assert first["score"] > second["score"] and first["value"] == "+1 375 555 4393"


def test_empty_table(spark):
    assert pii.find(documents(spark, [])).count() == 0
