"""Operator 1: exact top-k search with vector-approximation files.

Vectors are packed into blocks. A block holds for each component a coarse cell (one of 64 slices between the block's least and largest value) and,
apart from it, the exact integers. A first scan reads cells only: they bound every score from both sides, and the k-th largest guaranteed score of
a query over all blocks is a threshold. A second scan bounds the scores again, keeps what can still reach the threshold, and reads exact vectors in
the order of their bounds until the block's k-th result is certain. The query set meets the blocks block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titrate.functions.joins import join_rows
from titrate.llm.common import table, travels, written
from titrate.llm.registry import query

K = 5
EVERY = 50
SCALE = 256
SLICES = 64
BLOCK_ROWS = 4096
QUERY_ROWS = 256
LARGEST = 1 << 61  # larger scaled components are refused, so that differences of two stay within 64 bits
_NONE = np.iinfo(np.int64).min  # stands for no threshold


def _exact_type(largest: int, dims: int):
    """Products are summed in the smallest type that holds every partial sum exactly: floats, 64-bit integers, or integers without bound."""
    bound = dims * largest * largest
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object


def _largest(values: np.ndarray) -> int:
    return max(int(values.max(initial=0)), -int(values.min(initial=0)))


def scores_of(vectors: np.ndarray, query_: np.ndarray) -> np.ndarray:
    if _exact_type(max(_largest(vectors), _largest(query_)), max(1, len(query_))) is object:
        return vectors.astype(object) @ query_.astype(object)
    return vectors @ query_


def components_of(embedding, scale: int) -> np.ndarray | None:
    """floor(scale * x) of each component; None when the vector takes no part. Values beyond ``LARGEST`` are refused with an error."""
    if embedding is None:
        return None
    try:
        x = np.asarray(embedding, dtype=np.float64)
    except (TypeError, ValueError):
        return None
    if x.ndim != 1 or not np.isfinite(x).all():
        return None
    x = np.floor(scale * x)
    if np.abs(x).max(initial=0) > LARGEST:
        raise ValueError(f"a scaled component is beyond {LARGEST}")
    return x.astype(np.int64)


def approximate(exact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells uint8 [n, d], lower [SLICES, d], upper [SLICES, d]): every value lies between the bounds of its cell."""
    low, high = exact.min(0), exact.max(0)
    width = np.maximum(1, -(-(high - low + 1) // SLICES))
    cells = np.minimum((exact - low) // width, SLICES - 1).astype(np.uint8)
    lower = low + np.arange(SLICES)[:, None] * width
    return cells, lower, np.minimum(lower + width - 1, np.maximum(high, lower))


def bounds(queries: np.ndarray, cells: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds [queries, vectors] of the scores, from cells alone."""
    dims = np.arange(cells.shape[1])
    low, high = lower[cells, dims], upper[cells, dims]
    kind = _exact_type(max(map(_largest, (queries, low, high))), max(1, cells.shape[1]))
    plus, minus = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
    low, high = low.astype(kind).T, high.astype(kind).T
    return plus @ low + minus @ high, plus @ high + minus @ low


_BLOCK = "block bigint, dims int, n int, ids binary, uids binary, cells binary, lower binary, upper binary, exact binary"
_QUERIES = "part bigint, dims int, n int, ids binary, uids binary, exact binary"


def _blocks(scale: int, rows: int, every: int | None):
    """Packs the vectors of an input task into blocks as they stream by; with ``every``, only those of a query."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple]] = {}

        def block(dims: int) -> pa.RecordBatch:
            found = waiting.pop(dims)
            ids, uids = (np.array([x[k] for x in found], dtype=np.int64) for k in range(2))
            exact = np.array([x[2] for x in found], dtype=np.int64).reshape(len(found), dims)
            head = {"block": [int(uids[0])], "dims": [dims], "n": [len(found)], "ids": [ids.tobytes()], "uids": [uids.tobytes()]}
            types = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 6]
            if every is None:
                cells, lower, upper = approximate(exact)
                head |= {"cells": [cells.tobytes()], "lower": [lower.tobytes()], "upper": [upper.tobytes()]}
            else:
                head = {"part": head.pop("block"), **head}
            head["exact"] = [exact.tobytes()]
            return pa.record_batch([pa.array(v, t) for v, t in zip(head.values(), [*types[:5], *types[5:][: len(head) - 5]], strict=True)],
                                   names=list(head))

        for batch in batches:
            for uid, vec_id, embedding in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                vector = components_of(embedding, scale)
                if vector is None or vec_id is None or (every is not None and vec_id % every):
                    continue
                waiting.setdefault(len(vector), []).append((vec_id, uid, vector))
                if len(waiting[len(vector)]) == rows:
                    yield block(len(vector))
        for dims in list(waiting):
            yield block(dims)

    return blocks


def _array(value: bytes, kind, *shape: int) -> np.ndarray:
    return np.frombuffer(value, dtype=kind).reshape(shape)


def _thresholds(k: int):
    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k largest lower bounds of each query in each block."""
        for batch in batches:
            for x in batch.to_pylist():
                d, n, m = x["dims"], x["n"], x["q_n"]
                low, _ = bounds(_array(x["q_exact"], np.int64, m, d), _array(x["cells"], np.uint8, n, d), _array(x["lower"], np.int64, SLICES, d),
                                _array(x["upper"], np.int64, SLICES, d))
                own, uids = _array(x["q_uids"], np.int64, m), _array(x["uids"], np.int64, n)
                keep = min(k + 1, n)  # one more, since the query's own row may be among them
                if low.dtype == object:  # a threshold held within 64 bits is the same or a weaker one
                    low = np.clip(low, _NONE + 1, np.iinfo(np.int64).max).astype(np.int64)
                best = np.argpartition(-low, keep - 1, axis=1)[:, :keep]
                value = np.take_along_axis(low, best, 1)
                other = uids[best] != own[:, None]
                yield pa.record_batch([pa.array(np.repeat(own, keep)[other.ravel()]), pa.array(value.ravel()[other.ravel()].astype(np.int64))],
                                      names=["q_uid", "low"])

    return thresholds


def visit(query_: np.ndarray, upper: np.ndarray, exact: np.ndarray, ids: np.ndarray, allowed: np.ndarray, threshold: int, k: int) -> list[tuple[int, int]]:
    """(score, position) of the block's k best that reach the threshold, ties to smaller ids.

    Exact vectors are read in the order of their upper bounds, a few at a time; reading ends when no bound left can enter the k best.
    """
    can = np.nonzero(allowed & ((upper >= threshold) | (threshold <= _NONE + 1)))[0]
    order = can[np.argsort(-upper[can], kind="stable")]
    best: list[tuple[int, int, int]] = []
    step = 4 * k
    for at in range(0, len(order), step):
        if len(best) == k and upper[order[at]] < -best[-1][0]:
            break
        some = order[at : at + step]
        scores = scores_of(exact[some], query_)
        best = sorted([*best, *zip((-scores).tolist(), ids[some].tolist(), some.tolist(), strict=True)])[:k]
    return [(-s, p) for s, _, p in best]


def _exact(k: int):
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                d, n, m = x["dims"], x["n"], x["q_n"]
                asked, vectors = _array(x["q_exact"], np.int64, m, d), _array(x["exact"], np.int64, n, d)
                _, high = bounds(asked, _array(x["cells"], np.uint8, n, d), _array(x["lower"], np.int64, SLICES, d), _array(x["upper"], np.int64, SLICES, d))
                own, own_ids = _array(x["q_uids"], np.int64, m), _array(x["q_ids"], np.int64, m)
                uids, ids, least = _array(x["uids"], np.int64, n), _array(x["ids"], np.int64, n), _array(x["q_low"], np.int64, m)
                rows = [(own[q], own_ids[q], uids[p], ids[p], s) for q in range(m)
                        for s, p in visit(asked[q], high[q], vectors, ids, uids != own[q], int(least[q]), k)]
                if rows:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                                          names=["q_uid", "query_id", "uid", "vec_id", "score"])

    return exact


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding",
          block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query row, exact.

    Queries are the rows whose id is divisible by ``every``, candidates all rows but the query's own (a repeated row is another row, and a query of
    its own). Vectors that are null, or hold null or non-finite components, and rows without an id take no part. Vectors of different lengths never
    meet. Scores are exact at every size; a scaled component beyond 2^61 and a result beyond 64 bits are refused with an error. Ties go to smaller ids; ranks run from 1.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    blocks = written(rows.mapInArrow(_blocks(scale, block_rows, None), _BLOCK), "blocks")
    asked = written(rows.where(F.col("vec_id") % every == 0).mapInArrow(_blocks(scale, query_rows, every), _QUERIES), "queries")
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seat = F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int").alias("slot")
    renamed = asked.select("dims", *[F.col(c).alias(f"q_{c}") for c in ("part", "n", "ids", "uids", "exact")])
    # Each slot of blocks sees every query block once: queries are copied to slots, vectors move once. The optimizer knows the copies by the size of
    # one: these joins sort and merge, or all copies would be sent through the driver.
    spread = renamed.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    cells = blocks.select(seat, "block", "dims", "n", "uids", "cells", "lower", "upper")
    low = join_rows(spread, cells, ["slot", "dims"]).drop("slot", "block", "q_part", "q_ids").mapInArrow(_thresholds(k), "q_uid bigint, low bigint")
    nth = Window.partitionBy("q_uid").orderBy(F.desc("low"))
    least = low.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= k).groupBy("q_uid").agg(
        F.min(F.when(F.col("nth") == k, F.col("low"))).alias("low"))
    # Thresholds return to their query block in its order: at most query_rows of them.
    unpacked = asked.select("part", "n", F.col("uids")).mapInArrow(_unpack, "part bigint, position int, q_uid bigint")
    packed = join_rows(unpacked, least, ["q_uid"], "left").groupBy("part").agg(F.sort_array(F.collect_list(F.struct("position", "low"))).alias("lows"))
    with_low = join_rows(renamed, packed.select(F.col("part").alias("q_part"), "lows"), ["q_part"]).mapInArrow(
        _pack_low, T.StructType([*renamed.schema.fields, T.StructField("q_low", T.BinaryType())]))
    spread = with_low.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    found = join_rows(spread, blocks.withColumn("slot", seat), ["slot", "dims"]).drop("slot", "block", "q_part").mapInArrow(
        _exact(k), "q_uid bigint, query_id bigint, uid bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("q_uid").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, n, uids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            yield pa.record_batch([pa.array([part] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(_array(uids, np.int64, n))],
                                  names=["part", "position", "q_uid"])


def _pack_low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A query with fewer than k candidates has no threshold: the least integer stands for it."""
    for batch in batches:
        lows = [np.array([_NONE if x["low"] is None else x["low"] for x in row], dtype=np.int64).tobytes() for row in batch.column("lows").to_pylist()]
        columns = {c: batch.column(c) for c in ("dims", "q_part", "q_n", "q_ids", "q_uids", "q_exact")}
        yield pa.record_batch([*columns.values(), pa.array(lows, pa.binary())], names=[*columns, "q_low"])


SQL = """
with v as materialized (select row_number() over () as uid, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
           where embedding is not null and vec_id is not null
             and list_count(embedding) = len(embedding) and not list_contains(list_transform(embedding, lambda x: isfinite(x)), false)),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
      from v q join v c on q.vec_id % 50 = 0 and c.uid <> q.uid),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""


@query("op1_exact_topk", SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


travels(__name__)
