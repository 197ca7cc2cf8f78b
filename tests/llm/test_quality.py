import random

import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, prose, rows
from titrate.llm import quality
from titrate.llm.common import table

LABELS = "doc_id bigint, quality int, toxic int"
SF = "/root/testdata/sf0.01"


def junk(seed):
    r = random.Random(seed)
    return " ".join(w + r.choice(("***", "%%%", "$$$")) for w in prose(seed, 80).split())


def made(n=600):
    return [(k, junk(k) if k % 5 == 0 else prose(k, 80).replace(" ", ". ", 1), "en", "spam" if k % 5 == 0 and k % 2 else "src", 400, "", "", "", "", "") for k in range(n)]


def test_separates_and_uses_both_views(spark):
    data = made()
    labels = spark.createDataFrame([(k, int(k % 5 != 0), 0) for k in range(0, 600, 3)], LABELS)
    got = {x["doc_id"]: x for x in quality.score_documents(documents(spark, data), labels).collect()}
    assert all(x["keep"] == (k % 5 != 0) for k, x in got.items())
    assert len({x["p_meta"] for x in got.values()}) > 1


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    known = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0)
    rest = labels.join(known, "doc_id", "left_anti")
    judged = quality.score_documents(docs, known).join(rest, "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("double")).alias("kept"), F.count("*").alias("n"))
    kept = {x["quality"]: x["kept"] for x in judged.collect()}
    assert kept[1] >= 0.98 and kept[0] <= 0.15


def test_awkward_rows_and_missing_labels(spark):
    docs = documents(spark, rows()).withColumnRenamed("kept", "Score")
    odd = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, None, 1), (3, 7, 0), (None, 1, 0)], LABELS)
    for labels in (odd, odd.limit(0)):
        got = quality.score_documents(docs, labels)
        assert got.columns[-4:] == ["p_text", "p_meta", "score", "keep"] and "Score" not in got.columns
        got = got.collect()
        assert len(got) == len(rows()) and all(x["score"] is not None for x in got)
    assert {x["score"] for x in got} == {0.5} and all(x["keep"] for x in got)
    assert quality.score_documents(documents(spark, []), odd).count() == 0
    assert quality.stage(spark, table(spark, SF, "documents").limit(5), SF).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_results_do_not_depend_on_partitions(spark):
    data = made(200)
    labels = spark.createDataFrame([(k, int(k % 5 != 0), 0) for k in range(0, 200, 2)], LABELS)
    runs = [sorted(tuple(x) for x in quality.score_documents(documents(spark, data).repartition(n), labels).select("doc_id", "score").collect()) for n in (1, 7)]
    assert runs[0] == runs[1]


def test_monotone_rates():
    assert quality.monotone([0, 0, 5, 1, 0, 9], [10, 0, 10, 10, 0, 10], 0.5) == pytest.approx(
        [0.5 / 11, (0.5 / 11 + 6.5 / 21) / 2, 6.5 / 21, 6.5 / 21, (6.5 / 21 + 9.5 / 11) / 2, 9.5 / 11])
    assert quality.monotone([0, 0], [0, 0], 0.7) == [0.7, 0.7]
