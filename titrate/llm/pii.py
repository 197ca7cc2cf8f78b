"""Operator 4: personal data by regular expressions, checksum validators and context words, in built-in functions only.

Regular expressions propose spans; Luhn (cards), mod-97 and the country's length (IBANs), part and digit counts confirm them; words just before a span
raise its score. Positions come from the pieces between matches: a text is split at its matches, and lengths are summed up in two levels, so a text
with very many matches costs little more than its length.

The patterns are the contract's, written so that Java's engine reads any text in linear time without recursion (possessive repeats, and no start
inside a run that has already failed); their matches are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titrate.llm.common import replacing, table
from titrate.llm.registry import query

_LOCAL = "A-Za-z0-9._%+-"
_LABEL = "A-Za-z0-9-"
# IBAN lengths by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "BR": 29, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27,
    "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26, "UA": 29,
}
# Every country's own length, so that a number never takes in what follows it.
IBAN = "(?:" + "|".join(rf"(?:{'|'.join(c for c, m in IBAN_LENGTHS.items() if m == n)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n in sorted(set(IBAN_LENGTHS.values()))) + ")"
# Kind, pattern, context words, score without and with them.
KINDS = (
    ("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++", "mail|contact|write", 0.8, 0.95),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "ip|host|server|address|login", 0.6, 0.85),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", "card|visa|credit|debit|payment", 0.85, 0.98),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "tel|phone|call|mobile|fax", 0.6, 0.9),
    ("iban", IBAN, "iban|account|bank|transfer", 0.9, 0.98),
)
BASE = 4  # the first kinds are the contract's; the others are added
CONTEXT_CHARS = 40
BLOCK = 64
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
IP_PARTS = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a one-element generator, a step that the optimizer does not merge across: each is computed once a row."""
    held = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", held)


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def _running(totals: Column) -> Column:
    """The sum of all totals before each."""
    return F.transform(totals, lambda _, i: _total(F.slice(totals, F.lit(1), i)))


def _digit(text: Column, at: Column) -> Column:
    return F.ascii(F.substring(text, at, F.lit(1))) - 48


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    size = F.length(digits)

    def weighed(i: Column) -> Column:
        twice = _digit(digits, i) * 2
        return F.when((size - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(_digit(digits, i))

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), lambda a, i: a + weighed(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 by ISO 7064 mod 97-10."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))
    code = lambda i: F.ascii(F.substring(turned, i, F.lit(1)))
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0),
                       lambda a, i: F.when(code(i) < 58, (a * 10 + code(i) - 48) % 97).otherwise((a * 100 + code(i) - 55) % 97)) == 1


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(IP_PARTS)
    if kind == "card":
        return F.when(F.length(_digits(value)).between(14, 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    if kind == "iban":
        plain = F.replace(value, F.lit(" "), F.lit(""))
        return mod97(plain)
    return F.lit(True)


def _spans(kind: str, order: int, words: str, low: float, high: float) -> Column:
    """Confirmed spans of a kind from its pieces, matches and summed lengths."""
    pieces, matches, lengths, before = (F.col(f"__{kind}_{x}") for x in ("pieces", "matches", "lengths", "before"))

    def span(match: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        gap = F.element_at(pieces, i + 1)
        start = F.element_at(before, block + 1) + _total(F.slice(lengths, block * BLOCK + 1, i % BLOCK)) + F.length(gap)
        near = F.right(gap, F.lit(CONTEXT_CHARS)).rlike(rf"(?i)\b(?:{words})\b")
        return F.struct(start.cast("long").alias("start"), F.lit(order).alias("order"), (start + F.length(match)).cast("long").alias("end"),
                        F.lit(kind).alias("kind"), F.when(near, F.lit(high)).otherwise(F.lit(low)).alias("score"), match.alias("value"))

    marked = F.transform(matches, lambda m, i: F.when(confirmed(kind, m), span(m, i)))
    return F.filter(marked, lambda s: s.isNotNull())


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``pii``: array of (start, order, end, kind, score, value), by start, then kind.

    Positions are code points of the whole text, ends exclusive. A null text counts as empty: no spans. Spans of one kind never overlap; those of
    different kinds may. Repeated rows give repeated results, an empty table an empty one. An input column named ``pii`` is replaced.
    """
    own = replacing(docs, "pii").columns
    body = F.coalesce(F.col(text), F.lit(""))
    rows = once(docs.withColumn("__body", body).select(*[f"`{c}`" for c in own], "__body"), __digits=F.col("__body").rlike("[0-9]"), __at=F.instr("__body", "@") > 0)
    none = F.expr("cast(array() as array<string>)")
    cut, sums, blocks = {}, {}, {}
    for kind, pattern, *_ in KINDS:
        some = F.col("__at") if kind == "email" else F.col("__digits")
        cut[f"__{kind}_pieces"] = F.when(some, F.split("__body", pattern, -1)).otherwise(none)
        cut[f"__{kind}_matches"] = F.when(some, F.regexp_extract_all("__body", F.lit(pattern), F.lit(0))).otherwise(none)
        pieces, matches, lengths = (F.col(f"__{kind}_{x}") for x in ("pieces", "matches", "lengths"))
        sums[f"__{kind}_lengths"] = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m))
        each = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / BLOCK).cast("int")), lambda b: _total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
        blocks[f"__{kind}_blocks"] = each
    rows = once(rows, **cut).drop("__body")
    rows = once(rows, **sums)
    rows = once(rows, **blocks)
    rows = once(rows, **{f"__{k}_before": _running(F.col(f"__{k}_blocks")) for k, *_ in KINDS})
    found = F.concat(*[_spans(kind, order, words, low, high) for order, (kind, _, words, low, high) in enumerate(KINDS)])
    return once(rows, pii=F.array_sort(found)).select(*[f"`{c}`" for c in own], "pii")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("pii", lambda s: s["order"] < BASE)

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k, *_ in KINDS[:BASE]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def _sql() -> str:
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": IBAN,
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    valid = {
        "email": "true", "ip": f"regexp_matches(m, '{IP_PARTS}')", "phone": f"length({digits}) between 10 and 15",
    }
    valid["card"] = (f"length({digits}) between 14 and 19 and list_sum(list_transform(range(length({digits})), lambda k: "
                     f"case when k % 2 = 1 then (2 * substr({digits}, length({digits}) - k, 1)::int) // 10 + (2 * substr({digits}, length({digits}) - k, 1)::int) % 10 "
                     f"else substr({digits}, length({digits}) - k, 1)::int end)) % 10 = 0")
    plain = "replace(m, ' ', '')"
    chars = f"list_transform(string_split(substr({plain}, 5) || substr({plain}, 1, 4), ''), lambda x: ascii(x))"
    valid["iban"] = (f"list_reduce(list_prepend(0, {chars}), lambda a, c: case when c < 58 then (a * 10 + c - 48) % 97 else (a * 100 + c - 55) % 97 end) = 1")
    kinds = [k for k, *_ in KINDS]
    parts = []
    for order, kind in enumerate(kinds):
        parts.append(f"""
select rn, {order} as o, '{kind}' as kind, s, s + length(m) as e from (
  select rn, m, (list_sum(list_transform(ps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[:i-1], lambda x: length(x))), 0))::bigint as s
  from (select rn, ps, ms, unnest(ms) as m, unnest(range(1, len(ms) + 1)) as i
        from (select rn, regexp_split_to_array(t, '{patterns[kind]}') as ps, regexp_extract_all(t, '{patterns[kind]}') as ms from d)))
where {valid[kind]}""")
    counts = ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in kinds[:BASE])
    line = "kind || ':' || s || ':' || e"
    return f"""
with d as (select doc_id, coalesce(text, '') as t, row_number() over () as rn from documents),
f as ({" union all ".join(parts)})
select doc_id, {counts}, sha256(coalesce(string_agg({line}, ',' order by s, o) filter (o < {BASE}), '')) as base_sha256,
       coalesce(string_agg({line}, ',' order by s, o), '') as spans
from d left join f using (rn) group by rn, doc_id
"""


SQL = _sql()


@query("op4_pii", SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(table(spark, sf_dir, "documents").select("doc_id", "text")))
