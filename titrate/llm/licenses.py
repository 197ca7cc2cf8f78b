"""Operator 10: license scans by MinHash bands over overlapping text windows, in built-in functions only.

A template of n word shingles belongs to the size class c, the next power of two. A text is cut into windows of 2c shingles, one every c, so that any
stretch as long as the template lies whole in some window. A window that holds the asked share of a template has a known least Jaccard similarity to
it; every class takes as many MinHash bands (of one row) as make a miss rarer than ``MISS``. Windows meet templates in an equi-join on their bands;
exact shingle containment settles each pair.

Only texts that hold a word of some template are cut: from each template's shingles one more than may be missing are taken, and a text with the asked
share of the template holds one of them whole, and so that one's longest word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titrate.llm.common import ascii_lower, table, written
from titrate.llm.pii import once
from titrate.llm.registry import query

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
MISS = 1e-6
BROADCAST_BYTES = 32 << 20  # a template side beyond this is joined by a shuffle
NOT_WORD = r"[^\p{L}\p{N}]+"
# Opening notices of common licenses.
TEMPLATES = (
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                          "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                           "conditions are met:"),
    ("cc-by-4.0-line", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                       "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit-line", "Released under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
                  "(the \"Software\"), to deal in the Software without restriction"),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def shingles_of(words: Column, size: int = SHINGLE_WORDS) -> Column:
    """Hashes of the word shingles in order; a shorter text is one shingle, a text without words has none."""
    last = F.size(words) - size + 1
    many = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(size)), " ")))
    whole = F.array(F.xxhash64(F.array_join(words, " ")))
    return F.when(F.size(words) == 0, F.expr("cast(array() as array<bigint>)")).when(last < 1, whole).otherwise(many)


def bands_for(shingles: int, size_class: int, share: float) -> int:
    """Bands of one row that find a pair of the least similarity with probability 1 - MISS."""
    held = math.ceil(share * shingles - 1e-9)
    least = held / (2 * size_class + shingles - held)
    return math.ceil(math.log(MISS) / math.log(1 - least)) if least < 1 else 1


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    return spark.createDataFrame(list(templates), "template_id string, text string")


def _signature(shingles: Column, bands: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), bands), lambda b: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, b))))


def scan(docs: DataFrame, templates: DataFrame, text: str = "text", doc_id: str = "doc_id", share: float = CONTAINMENT) -> DataFrame:
    """uid, doc_id, template_id, containment (best window), first_word (of the first best window): one row for each row of ``docs`` and template that
    it holds.

    Words are runs of letters and digits, A-Z lower-cased. Null and empty texts hold nothing, templates without words are held by nothing, repeated
    rows are rows of their own. Templates are a reference set: their sizes and words, not the documents', come to the driver. Empty tables on either
    side give an empty table.
    """
    known = once(templates.where("template_id is not null").withColumn("t_words", words_of(F.col("text"))), t_shingles=F.array_distinct(shingles_of(F.col("t_words"))))
    known = known.where(F.size("t_shingles") > 0).select(
        "template_id", "t_shingles", "t_words", F.size("t_shingles").alias("n"),
        F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.size("t_words") - SHINGLE_WORDS + 1, F.lit(1))))).cast("int").alias("size_class"))
    classes: dict[int, int] = {}
    needles: set[str] = set()
    template_bytes = 0
    for row in known.select("size_class", "n", "t_words").collect():
        bands = bands_for(row["n"], row["size_class"], share)
        classes[row["size_class"]] = max(classes.get(row["size_class"], 1), bands)
        template_bytes += bands * (8 * row["n"] + 100)
        words = row["t_words"]
        runs = [words[i : i + SHINGLE_WORDS] for i in range(max(1, len(words) - SHINGLE_WORDS + 1))]
        distinct = list(dict.fromkeys(tuple(r) for r in runs))
        may_miss = row["n"] - math.ceil(share * row["n"] - 1e-9)
        needles.update(max(r, key=len).lower() for r in distinct[: may_miss + 1])
    spark = docs.sparkSession
    out = "uid bigint, doc_id bigint, template_id string, containment double, first_word bigint"
    if not classes:
        return spark.createDataFrame([], out)
    lowered = F.lower(F.col("body"))
    some = F.lit(False)
    for needle in sorted(needles):
        some = some | lowered.contains(needle)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("body"))
    rows = once(rows.where(some), words=words_of(F.col("body"))).drop("body")
    rows = once(rows, shingles=shingles_of(F.col("words"))).drop("words").where(F.size("shingles") > 0)
    # The few texts that may hold a template, cut once for all classes, and dealt out anew: their windows are much work for few bytes.
    rows = written(rows, "shingles").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    kinds = F.array(*[F.struct(F.lit(c).alias("size_class"), F.lit(b).alias("bands")) for c, b in sorted(classes.items())])
    windows = rows.select("uid", "doc_id", "shingles", F.inline(kinds)).select(
        "*", F.explode(F.sequence(F.lit(0), F.size("shingles") - 1, F.col("size_class"))).alias("at")).select(
        "uid", "doc_id", "size_class", "bands", F.col("at").cast("long").alias("first_word"),
        F.slice("shingles", F.col("at") + 1, F.col("size_class") * 2).alias("window"))
    windows = once(windows, signature=_signature(F.col("window"), F.col("bands")))
    bands_of = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
    own = once(known, t_signature=_signature(F.col("t_shingles"), F.element_at(bands_of, F.col("size_class")))).select(
        "template_id", "t_shingles", "n", "size_class", F.posexplode("t_signature").alias("band", "least"))
    if template_bytes <= BROADCAST_BYTES:
        own = F.broadcast(own)
    hits = windows.select("*", F.posexplode("signature").alias("band", "least")).drop("signature").join(own, ["size_class", "band", "least"])
    part = F.size(F.array_intersect("window", "t_shingles")) / F.col("n")
    found = hits.withColumn("part", part).where(F.col("part") >= share - 1e-9)
    best = F.min(F.struct((-F.col("part")).alias("less"), "first_word")).alias("best")
    return found.groupBy("uid", "doc_id", "template_id").agg(best).select(
        "uid", "doc_id", "template_id", F.round(-F.col("best.less"), 6).alias("containment"), F.col("best.first_word").alias("first_word"))


def _words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{NOT_WORD}'), lambda w: w <> '')"


def _shingles_sql(words: str) -> str:
    return (f"case when len({words}) = 0 then [] when len({words}) < {SHINGLE_WORDS} then [array_to_string({words}, ' ')] else "
            f"list_transform(range(1, len({words}) - {SHINGLE_WORDS} + 2), lambda i: array_to_string({words}[i:i+{SHINGLE_WORDS - 1}], ' ')) end")


def _text_sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL = f"""
with t0(template_id, text) as (values {", ".join(f"({_text_sql(a)}, {_text_sql(b)})" for a, b in TEMPLATES)}),
t1 as (select template_id, {_words_sql("text")} as w from t0),
t as (select template_id, list_distinct({_shingles_sql("w")}) as ts, (2 ** ceil(log2(greatest(len(w) - {SHINGLE_WORDS} + 1, 1))))::int as c from t1),
d1 as (select row_number() over () as uid, doc_id, {_words_sql("text")} as w from documents),
d as (select uid, doc_id, {_shingles_sql("w")} as s from d1),
near as (select distinct uid, template_id from (select uid, unnest(s) as x from d) join (select template_id, unnest(ts) as x from t) using (x)),
windows as (select uid, doc_id, template_id, ts, unnest(range(0, len(s), c)) as first_word, s, c from d join near using (uid) join t using (template_id)),
p as (select uid, doc_id, template_id, first_word, len(list_intersect(list_distinct(s[first_word + 1 : first_word + 2 * c]), ts)) / len(ts) as part from windows)
select doc_id, template_id, round(max(part), 6) as containment, arg_max(first_word, part * 1e9 - first_word) as first_word
from p where part >= {CONTAINMENT} - 1e-9 group by uid, doc_id, template_id
"""


@query("op10_license_scan", SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), template_table(spark)).select("doc_id", "template_id", "containment", "first_word")
