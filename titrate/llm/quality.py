"""Operator 3: quality by co-training of a text-content and a page-metadata classifier.

Both views are naive Bayes models over binned features: text (symbol, capital, digit, repetition, length shares ...) and metadata (source, language,
length class). All counts are exact sums over whole tables, so results do not depend on task order. In every round each view labels the unlabelled
documents it is sure of, and the other view counts them in. Scores of each view are calibrated on held-out labelled documents by monotone
regression over fixed score bins; the calibrated odds of the two views add up, less the prior's.

Models have a fixed size (bins of hashed sources and of features), whatever the number of documents; nothing else comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titrate.llm.common import keep_columns, replacing, settled, table, written
from titrate.llm.pii import once
from titrate.llm.registry import query

ROUNDS = 3
SURE_GOOD, SURE_BAD = 0.99, 0.01  # calibrated probabilities from which a view labels for the other
THRESHOLD = 0.5
BINS = 16  # bins of a text feature
SOURCE_BINS, LENGTH_BINS, LANG_BINS = 512, 24, 64
CALIBRATION_BINS = 60  # of one unit of log odds each, around zero
HELD_OUT = 4  # one labelled document in so many calibrates
SMOOTHING = 1.0

# Shares are binned by powers of two below one, so that small shares tell apart: bin 0 is none, bin 15 all but everything.
SYMBOLS = "*#$%&!|<>{}[]=~^\\/_"
TEXT_FEATURES = ("symbols", "capitals", "digits", "distinct", "repeats", "word_size", "marked_words", "lines", "stops", "longest")


def _share_bin(part: Column, whole: Column) -> Column:
    share = part / F.greatest(whole, F.lit(1))
    return F.when(part <= 0, 0).otherwise(F.greatest(F.lit(1), F.lit(BINS - 1) + F.floor(2 * F.log2(F.least(share, F.lit(1.0))))).cast("int"))


def _linear_bin(share: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(share * BINS))).cast("int")


def text_bins(text: Column) -> dict[str, Column]:
    """Bins of the text features, from columns __words (array) and __size (characters)."""
    words, size = F.col("__words"), F.col("__size")
    n = F.greatest(F.size(words), F.lit(1))
    return {
        "symbols": _share_bin(size - F.length(F.translate(text, SYMBOLS, "")), size),
        "capitals": _share_bin(F.regexp_count(text, F.lit(r"\p{Lu}")), size),
        "digits": _share_bin(F.regexp_count(text, F.lit("[0-9]")), size),
        "distinct": _linear_bin(F.size(F.array_distinct(words)) / n),
        "repeats": _share_bin(F.regexp_count(text, F.lit(r"(?<!\S)(\S++) \1(?!\S)")), n),
        "word_size": F.least(F.lit(BINS - 1), F.floor(size / n)).cast("int"),
        "marked_words": _linear_bin(F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,;:'’()?\"-](?!\S)")) / n),
        "lines": _share_bin(size - F.length(F.replace(text, F.lit("\n"), F.lit(""))), n),
        "stops": _share_bin(size - F.length(F.replace(text, F.lit("."), F.lit(""))), n),
        "longest": F.least(F.lit(BINS - 1), F.floor(F.log2(F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0)) + 1) * 2)).cast("int"),
    }


def views(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with __text and __meta: for each view the positions of its features' bins in its model."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = once(docs, __body=body, __words=F.filter(F.split(body, r"\s+"), lambda w: w != ""), __size=F.length(body))
    rows = once(rows, **{f"__b_{k}": v for k, v in text_bins(F.col("__body")).items()})
    positions = [F.col(f"__b_{k}") + i * BINS for i, k in enumerate(TEXT_FEATURES)]
    length = F.least(F.lit(LENGTH_BINS - 1), F.floor(F.log2(F.greatest(F.coalesce(F.col("n_chars"), F.lit(0)), F.lit(0)) + 1))).cast("int")
    meta = [F.pmod(F.xxhash64("source"), F.lit(SOURCE_BINS)).cast("int"), F.pmod(F.xxhash64("lang"), F.lit(LANG_BINS)).cast("int") + SOURCE_BINS,
            length + SOURCE_BINS + LANG_BINS]
    own = [f"`{c}`" for c in docs.columns]
    return rows.select(*own, F.array(*[p.cast("int") for p in positions]).alias("__text"), F.array(*meta).alias("__meta"))


SIZES = {"__text": BINS * len(TEXT_FEATURES), "__meta": SOURCE_BINS + LANG_BINS + LENGTH_BINS}
FEATURES = {"__text": len(TEXT_FEATURES), "__meta": 3}
GROUPS = {"__text": [BINS] * len(TEXT_FEATURES), "__meta": [SOURCE_BINS, LANG_BINS, LENGTH_BINS]}


def constants(values: Sequence[float]) -> Column:
    """A constant array, folded into one literal however long it is."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def log_odds(view: str, weights: Sequence[float]) -> Column:
    """Sum of a view's weights at its bins; the prior's is the last."""
    held, total = constants(weights), F.lit(float(weights[-1]))
    for i in range(FEATURES[view]):
        total = total + F.element_at(held, F.element_at(F.col(view), i + 1) + 1)
    return total


def calibration_bin(score: Column) -> Column:
    return F.least(F.lit(CALIBRATION_BINS - 1), F.greatest(F.lit(0), F.floor(score) + CALIBRATION_BINS // 2)).cast("int")


def fit(training: DataFrame) -> dict[str, list[float]]:
    """Naive Bayes weights of both views from rows with a label for each (1, 0 or null: not counted), in one pass.

    At most two counts for each bin of a view come to the driver.
    """
    taught = [F.transform(F.when(F.col(label).isNotNull(), F.col(view)), _tagged(view, label)) for view, label in LABELS.items()]
    rows = training.select(F.explode(F.concat(*[F.coalesce(t, F.expr("cast(array() as array<struct<view:string,bin:int,y:int>>)")) for t in taught])).alias("t"))
    counts = rows.groupBy("t.view", "t.bin", "t.y").count().collect()
    models = {}
    for view in SIZES:
        seen = {(r["bin"], r["y"]): r["count"] for r in counts if r["view"] == view}
        whole = [sum(n for (_, y), n in seen.items() if y == k) / FEATURES[view] for k in (0, 1)]
        weights, at = [], 0
        for size in GROUPS[view]:
            for b in range(at, at + size):
                rates = [(seen.get((b, k), 0) + SMOOTHING) / (whole[k] + SMOOTHING * min(size, BINS)) for k in (0, 1)]
                weights.append(math.log(rates[1] / rates[0]))
            at += size
        models[view] = [*weights, math.log((whole[1] + SMOOTHING) / (whole[0] + SMOOTHING))]
    return models


LABELS = {"__text": "__for_text", "__meta": "__for_meta"}


def _tagged(view: str, label: str):
    def tagged(b: Column) -> Column:
        return F.struct(F.lit(view).alias("view"), b.cast("int").alias("bin"), F.col(label).cast("int").alias("y"))

    return tagged


def monotone(good: Sequence[float], total: Sequence[float], prior: float) -> list[float]:
    """Rates that never fall from bin to bin (pool adjacent violators), each pool drawn to the prior by one pseudo-document.

    A bin without documents takes the mean of the pools around it, or the rate of the one beside it.
    """
    pools: list[list[float]] = []  # good, documents, first bin, last bin
    for b, (g, n) in enumerate(zip(good, total, strict=True)):
        if not n:
            continue
        pools.append([g, n, b, b])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            g2, n2, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + g2, pools[-1][1] + n2, pools[-1][2], last]
    if not pools:
        return [prior] * len(good)
    rates = [(g + prior) / (n + 1) for g, n, *_ in pools]
    out = []
    for b in range(len(good)):
        below = [r for r, p in zip(rates, pools, strict=True) if p[2] <= b]
        above = [r for r, p in zip(rates, pools, strict=True) if p[3] >= b]
        out.append(above[0] if not below else below[-1] if not above else (below[-1] + above[0]) / 2)
    return out


def calibrate(held_out: DataFrame, weights: dict[str, list[float]], prior: float) -> dict[str, list[float]]:
    """Calibration of both views in one pass: two numbers for each of ``CALIBRATION_BINS`` bins come to the driver."""
    scored = F.array(*[F.struct(F.lit(v).alias("view"), calibration_bin(log_odds(v, weights[v])).alias("bin")) for v in SIZES])
    counts = held_out.select("__y", F.explode(scored).alias("s")).groupBy("s.view", "s.bin").agg(F.sum("__y").alias("good"), F.count("*").alias("n")).collect()
    curves = {}
    for view in SIZES:
        by = {r["bin"]: (r["good"], r["n"]) for r in counts if r["view"] == view}
        curves[view] = monotone(*([by.get(b, (0, 0))[k] for b in range(CALIBRATION_BINS)] for k in (0, 1)), prior)
    return curves


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """Adds __y: 1, 0 or null. Labels of one id that disagree evenly, and labels other than 0 and 1, do not count."""
    one = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("__id")).agg(F.avg(label).alias("__share")).where("__share <> 0.5").select(
        "__id", (F.col("__share") > 0.5).cast("int").alias("__y"))
    return docs.join(one, docs[doc_id] == one["__id"], "left").drop("__id")


def co_train(rows: DataFrame, rounds: int = ROUNDS) -> tuple[dict[str, list[float]], dict[str, list[float]], float]:
    """Weights and calibrations of both views, and the prior, from ``rows`` (__text, __meta, __y, __fold)."""
    held = rows.where("__y is not null and __fold = 0")
    teaching = rows.where("__y is null or __fold > 0")
    good, n = rows.where("__y is not null").agg(F.sum("__y"), F.count("*")).first()
    prior = ((good or 0) + 1) / (n + 2)
    weights = fit(teaching.where("__y is not null").withColumns({label: F.col("__y") for label in LABELS.values()}))
    curves = calibrate(held, weights, prior)
    for _ in range(rounds if n else 0):
        # Each view learns from the labelled documents and from those the other view is sure of.
        taught = {}
        for view, teacher in (("__text", "__meta"), ("__meta", "__text")):
            p = probability(teacher, weights[teacher], curves[teacher])
            taught[LABELS[view]] = F.coalesce("__y", F.when(p >= SURE_GOOD, 1).when(p <= SURE_BAD, 0))
        weights = fit(teaching.withColumns(taught))
        curves = calibrate(held, weights, prior)
    return weights, curves, prior


def probability(view: str, weights: Sequence[float], curve: Sequence[float]) -> Column:
    return F.element_at(constants(curve), calibration_bin(log_odds(view, weights)) + 1)


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", rounds: int = ROUNDS,
             threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` with p_text, p_meta, score (probability of quality 1) and keep.

    Null texts count as empty, null sources, languages and lengths as values of their own. Without any usable label every score is one half and every
    document is kept. Repeated rows are rows of their own; an empty table gives an empty table. Input columns named like a result are replaced.
    """
    narrow = views(docs.withColumn("__uid", F.monotonically_increasing_id()), text).select("__uid", F.col(doc_id).alias("__doc"), "__text", "__meta")
    rows = written(labelled(narrow, labels.withColumnRenamed(doc_id, "__doc"), "__doc", label).withColumn(
        "__fold", F.pmod(F.xxhash64("__doc"), F.lit(HELD_OUT))), "views")
    weights, curves, prior = co_train(rows, rounds)
    logit = lambda p: F.log(p / (1 - p))
    scored = rows.select("__uid", probability("__text", weights["__text"], curves["__text"]).alias("p_text"),
                         probability("__meta", weights["__meta"], curves["__meta"]).alias("p_meta"))
    odds = logit(F.col("p_text")) + logit(F.col("p_meta")) - math.log(prior / (1 - prior))
    scored = scored.select("__uid", "p_text", "p_meta", F.round(1 / (1 + F.exp(-odds)), 9).alias("score"))
    return scored.withColumn("keep", F.col("score") >= threshold)


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``classify`` with the documents' own columns beside the scores."""
    docs = settled(docs)
    scored = classify(docs, labels, **options)
    docs = replacing(docs, "p_text", "p_meta", "score", "keep")
    own = [f"`{c}`" for c in docs.columns]
    return docs.withColumn("__uid", F.monotonically_increasing_id()).join(scored, "__uid").select(*own, "p_text", "p_meta", "score", "keep")


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "p_text", "p_meta", "score", "keep")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the classifier rejects go."""
    return keep_columns(score_documents(docs, table(spark, sf_dir, "labels")).where("keep"), docs)
