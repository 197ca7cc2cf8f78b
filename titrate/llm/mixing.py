"""Operator 5: mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Token counts are gathered into cells of (source, language, topic). Each sweep rakes the cell weights to the source, language and topic targets in
turn: a marginal is one small aggregate that joins back to the cells. Cells are written to the shared folder after each sweep. A document is then
kept with a probability in proportion to its cell's factor, calibrated so that the expected sample holds ``RATE`` of the tokens; a cell that is
asked for more than it has is kept whole and the others make up for it. Where no cell is, the kept tokens meet the targets in expectation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titrate.llm.common import keep_columns, replacing, table, written
from titrate.llm.pii import once
from titrate.llm.registry import query

SWEEPS = 4
RATE = 0.8  # of all tokens, in the expected sample
CALIBRATIONS = 4
TEMPER = {"source": 0.9, "lang": 0.9, "topic": 0.95}  # default targets: observed shares to this power, so that rare values gain a little
DIGITS = 13  # hexadecimal digits of a document's uniform number
TOPICS = ("contact", "legal", "tabular")  # else "prose"
DIMENSIONS = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    """A coarse topic by marks in the text; the first that fits."""
    return (F.when(text.contains("@"), TOPICS[0]).when(ascii_contains(text, "licen"), TOPICS[1]).when(text.contains(" | "), TOPICS[2]).otherwise("prose"))


def ascii_contains(text: Column, word: str) -> Column:
    return text.contains(word) | text.contains(word.capitalize())


def token_count(text: Column) -> Column:
    """Words: runs of characters other than ASCII space, tab, line and page breaks."""
    return F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("long")


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the document's id, the same at every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def default_targets(cells: DataFrame, dimension: str, temper: float) -> DataFrame:
    """(value, target): observed token shares of a dimension to the power ``temper``, in proportion."""
    sums = cells.groupBy(dimension).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper)).alias("pull"))
    total = sums.agg(F.sum("pull")).first()[0] or 1.0
    return sums.select(F.col(dimension).alias("value"), (F.col("pull") / total).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """Cells with ``weight``: tokens raked to the targets. Cells (the dimensions, tokens > 0); each target (value, target), summing to 1 over values.

    A value that a target lacks keeps weight zero; one that only the target has gets nothing.
    """
    fitted = cells.withColumn("weight", F.col("tokens").cast("double"))
    for sweep in range(sweeps):
        for dimension, target in targets.items():
            sums = fitted.groupBy(dimension).agg(F.sum("weight").alias("__sum"))
            pull = sums.join(target, sums[dimension] == target["value"], "left").select(
                F.col(dimension), F.when(F.col("__sum") > 0, F.coalesce("target", F.lit(0.0)) / F.col("__sum")).otherwise(0.0).alias("__pull"))
            fitted = fitted.join(pull, dimension).withColumn("weight", F.col("weight") * F.col("__pull")).drop("__pull")
        fitted = written(fitted, f"rake-{sweep}")
    return fitted


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, topic: Column | None = None, text: str = "text", doc_id: str = "doc_id",
        sweeps: int = SWEEPS, rate: float = RATE, seed: int = 7) -> DataFrame:
    """Every row of ``docs`` with topic, n_tokens, probability and sampled.

    ``targets``: for any of source, lang and topic a table (value, target); the others get ``default_targets``. Null sources and languages are a value
    of their own (empty). A null text is empty. Documents without a word weigh nothing: they take their cell's probability where the cell has words,
    else 0. Copies of one id share their fate. An empty table gives an empty table. Input columns named like a result column are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = once(docs.withColumns({"__source": F.coalesce("source", F.lit("")), "__lang": F.coalesce("lang", F.lit(""))}),
                __tokens=token_count(body), __topic=topic if topic is not None else topic_of(body))
    cells = written(rows.groupBy("__source", "__lang", "__topic").agg(F.sum("__tokens").alias("tokens")).where("tokens > 0").select(
        F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), "tokens"), "cells")
    wanted = {d: (targets or {}).get(d) for d in DIMENSIONS}
    wanted = {d: t if t is not None else default_targets(cells, d, TEMPER[d]) for d, t in wanted.items()}
    fitted = rake(cells, wanted, sweeps)
    tokens, weight = fitted.agg(F.sum("tokens"), F.sum("weight")).first()
    fitted = fitted.withColumn("factor", F.col("weight") / F.col("tokens") * ((tokens or 1) / (weight or 1.0)))
    scale = rate
    for _ in range(CALIBRATIONS):  # two sums over the cells each
        full = F.col("factor") * scale >= 1
        whole, rest = fitted.agg(F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(~full, F.col("factor") * F.col("tokens")))).first()
        scale = max(0.0, rate * (tokens or 0) - (whole or 0)) / rest if rest else scale
    rates = fitted.select(F.col("source").alias("__source"), F.col("lang").alias("__lang"), F.col("topic").alias("__topic"),
                          F.least(F.col("factor") * scale, F.lit(1.0)).alias("__rate"))
    results = {"topic": F.col("__topic"), "n_tokens": F.col("__tokens"), "probability": F.round(F.coalesce("__rate", F.lit(0.0)), 9)}
    results["sampled"] = uniform(F.col(doc_id), seed) < results["probability"]
    own = [f"`{c}`" for c in replacing(docs, *results).columns]
    return rows.join(rates, ["__source", "__lang", "__topic"], "left").select(*own, *[v.alias(n) for n, v in results.items()])


def sql(docs: str = "documents", sweeps: int = SWEEPS, seed: int = 7) -> str:
    """The same for DuckDB, over a table or query of documents."""
    steps, last = [], "c0"
    for d in DIMENSIONS:
        steps.append(f"t_{d} as (select {d}, pow(sum(tokens)::double, {TEMPER[d]}) / sum(pow(sum(tokens)::double, {TEMPER[d]})) over () as target from c0 group by {d})")
    for sweep in range(sweeps):
        for d in DIMENSIONS:
            name = f"c_{sweep}_{d}"
            steps.append(f"{name} as materialized (select source, lang, topic, tokens, weight * target / sum(weight) over (partition by {d}) as weight from {last} join t_{d} using ({d}))")
            last = name
    steps.append(f"f as materialized (select source, lang, topic, tokens, weight / tokens * (sum(tokens) over () / sum(weight) over ()) as factor from {last})")
    steps.append(f"s0 as (select {RATE}::double as scale)")
    for k in range(CALIBRATIONS):
        steps.append(f"s{k + 1} as materialized (select greatest(0, {RATE} * sum(tokens) - coalesce(sum(tokens) filter (factor * scale >= 1), 0)) / sum(factor * tokens) filter (factor * scale < 1) as scale from f, s{k})")
    return f"""
with d as (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, coalesce(text, '') as t from {docs}),
r as (select doc_id, source, lang, len(regexp_extract_all(t, '[^ \\t-\\r]+')) as n_tokens,
             case when contains(t, '@') then 'contact' when contains(t, 'licen') or contains(t, 'Licen') then 'legal'
                  when contains(t, ' | ') then 'tabular' else 'prose' end as topic from d),
c0 as materialized (select source, lang, topic, sum(n_tokens)::bigint as tokens, sum(n_tokens)::double as weight from r group by all having sum(n_tokens) > 0),
{", ".join(steps)},
p as (select source, lang, topic, least(factor * scale, 1) as rate from f, s{CALIBRATIONS}),
o as (select doc_id, source, lang, topic, n_tokens, round(coalesce(rate, 0), 9) as probability from r left join p using (source, lang, topic))
select *, ('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, '')), 1, {DIGITS}))::bigint / {float(16**DIGITS)!r} < probability as sampled from o
"""


@query("op5_mixing", sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"),
                                                         "topic", "n_tokens", "probability", "sampled")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the sampled documents."""
    return keep_columns(mix(docs).where("sampled"), docs)
