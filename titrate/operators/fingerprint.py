"""Canonical-JSON fingerprints of documents and of the catalog."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _canonical(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        value = json.loads(text)
    except ValueError:
        return None
    if isinstance(value, dict):
        value.pop("fingerprint", None)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_json(body: Column) -> Column:
    """Sorted keys, no white space, the document's own fingerprint field left out (Arrow batches)."""

    @F.pandas_udf("string")
    def canonical(bodies: pd.Series) -> pd.Series:
        return bodies.map(_canonical)

    return canonical(body)


def fingerprint(body: Column) -> Column:
    """D16."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(body), 256))


def catalog_fingerprint(latest: DataFrame) -> DataFrame:
    """One fingerprint of all latest revisions.

    Two levels, so that the catalog is never one list in one task: ids fall into 4 096 buckets by hash, each bucket's
    (id, revision, fingerprint) lines are hashed in id order, and the bucket hashes are hashed in bucket order.
    """
    line = F.concat_ws("\n", "profile_id", F.col("revision").cast("string"), "fingerprint")
    buckets = latest.groupBy(F.substring(F.sha2("profile_id", 256), 1, 3).alias("bucket")).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("_h"), F.count("*").alias("_n"))
    return buckets.agg(
        F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("bucket", "_h"))), "\n"), 256)).alias("fingerprint"),
        F.sum("_n").alias("n_profiles"))
