"""Operator 13: hard negatives by Fagin's threshold algorithm.

Vectors are packed into blocks that hold, beside the exact integers, one list of positions for each dimension, sorted by its component. An anchor
reads every list from its best end (the largest components where its own is positive, the smallest where it is negative), deeper by doubling steps.
Rows met for the first time are scored exactly; the sum of the products at the depth reached bounds every row not met yet. Reading stops once that
threshold falls strictly below the k-th score of everything asked for, so ties are always settled by id.

Two such searches: an anchor's positives, then for each positive the best rows of other labels inside its window of scores. Anchors meet the blocks
block by block; the bests of an anchor's blocks are merged by rank, so nothing holds more than one block of either side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from titrate.functions.joins import join_rows
from titrate.llm.common import table, travels, written
from titrate.llm.registry import query

POSITIVES = 5
NEGATIVES = 3
LOWEST, HIGHEST = 50, 95  # percent of the positive's score
EVERY = 50
SCALE = 256
BLOCK_VALUES = 1 << 18  # components of a block
ANCHOR_VALUES = 1 << 14  # components of a block of anchors
FIRST_DEPTH = 8
_LARGEST = 2.0**62

Found = tuple[int, int, int]  # (score with its sign turned, id, uid): sorts best first


def components_of(embedding: list | None, scale: int) -> np.ndarray | None:
    """floor(scale * x) of each component; None when the vector takes no part."""
    if embedding is None or any(x is None for x in embedding):
        return None
    x = np.array(embedding, dtype=np.float64)
    if not np.isfinite(x).all():
        return None
    x = np.floor(scale * x)
    if (np.abs(x) > _LARGEST).any():
        raise ValueError("a scaled component is beyond 2^62")
    return x.astype(np.int64)


def fitting(values: np.ndarray, largest: int) -> np.ndarray:
    """The integers in a type that holds every partial sum of products up to ``largest`` exactly: double, 64-bit integer, or Python's own."""
    bound = max(1, values.shape[-1]) * largest * largest
    return values.astype(np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object)


def sorted_lists(exact: np.ndarray) -> np.ndarray:
    """[dimension, rank] -> position, largest component first."""
    return np.argsort(-exact, axis=0, kind="stable").T.astype(np.int32)


def accesses(anchor: np.ndarray, exact: np.ndarray, lists: np.ndarray) -> Iterator[tuple[np.ndarray, int | None]]:
    """(positions met for the first time, the most that any other row can score; None when all were met), by doubling depth."""
    rows = len(exact)
    rising, falling = np.nonzero(anchor > 0)[0], np.nonzero(anchor < 0)[0]
    if not len(rising) + len(falling):  # an anchor of zeros: every row scores 0
        yield np.arange(rows), None
        return
    seen = np.zeros(rows, dtype=bool)
    done, depth = 0, min(FIRST_DEPTH, rows)
    while done < rows:
        met = np.zeros(rows, dtype=bool)
        met[lists[rising, done:depth]] = True
        met[lists[falling, rows - depth : rows - done]] = True
        fresh = np.nonzero(met & ~seen)[0]
        seen |= met
        if depth == rows or seen.all():
            yield fresh, None
            return
        threshold = exact[lists[rising, depth - 1], rising] @ anchor[rising] + exact[lists[falling, rows - depth], falling] @ anchor[falling]
        yield fresh, int(threshold)
        done, depth = depth, min(2 * depth, rows)


def best_rows(anchor: np.ndarray, exact: np.ndarray, lists: np.ndarray, allowed: np.ndarray, ids: np.ndarray, uids: np.ndarray,
              windows: list[tuple[int | None, int | None]], k: int) -> list[list[Found]]:
    """For each window of scores [low, high] (None: open) its k best allowed rows."""
    best: list[list[Found]] = [[] for _ in windows]
    for fresh, threshold in accesses(anchor, exact, lists):
        fresh = fresh[allowed[fresh]]
        scores = exact[fresh] @ anchor
        for at, (low, high) in enumerate(windows):
            inside = np.ones(len(fresh), dtype=bool)
            if low is not None:
                inside &= np.asarray(scores >= low, dtype=bool)
            if high is not None:
                inside &= np.asarray(scores <= high, dtype=bool)
            if len(best[at]) == k:
                inside &= np.asarray(scores >= -best[at][-1][0], dtype=bool)
            some = np.nonzero(inside)[0]
            if len(some):
                new = zip((-scores[some]).tolist(), ids[fresh[some]].tolist(), uids[fresh[some]].tolist(), strict=True)
                best[at] = sorted([*best[at], *((int(s), i, u) for s, i, u in new)])[:k]
        if threshold is None or all(
                (low is not None and high is not None and low > high) or (low is not None and threshold < low)
                or (len(found) == k and threshold < -found[-1][0]) for (low, high), found in zip(windows, best, strict=True)):
            break
    return best


def window_of(score: int, lowest: int, highest: int) -> tuple[int, int]:
    """The integers s with lowest * score <= 100 * s <= highest * score."""
    return -((-lowest * score) // 100), highest * score // 100


_BLOCK = "block bigint, dims int, n int, ids binary, uids binary, labels binary, exact binary, lists binary"
_ANCHORS = "part bigint, q_dims int, q_n int, q_ids binary, q_uids binary, q_labels binary, q_exact binary"


def _packed(scale: int, values: int, lists: bool):
    """Packs the vectors of an input task into blocks as they stream by."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple]] = {}

        def block(dims: int) -> pa.RecordBatch:
            found = waiting.pop(dims)
            ids, uids, labels = (np.array([x[k] for x in found], dtype=np.int64) for k in range(3))
            exact = np.array([x[3] for x in found], dtype=np.int64).reshape(len(found), dims)
            columns = [pa.array([int(uids[0])], pa.int64()), pa.array([dims], pa.int32()), pa.array([len(found)], pa.int32()),
                       *(pa.array([x.tobytes()], pa.binary()) for x in (ids, uids, labels, exact))]
            names = [x.split()[0] for x in (_BLOCK if lists else _ANCHORS).split(", ")]
            if lists:
                columns.append(pa.array([sorted_lists(exact).tobytes()], pa.binary()))
            return pa.record_batch(columns, names=names)

        for batch in batches:
            for uid, vec_id, label, embedding in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                vector = components_of(embedding, scale)
                if vector is None:
                    continue
                dims = len(vector)
                waiting.setdefault(dims, []).append((vec_id, uid, label, vector))
                if len(waiting[dims]) >= max(1, values // max(1, dims)):
                    yield block(dims)
        for dims in list(waiting):
            yield block(dims)

    return packed


class Meeting:
    """A block of anchors and a block of vectors."""

    def __init__(self, row: dict):
        m, n, dims = row["q_n"], row["n"], row["dims"]

        def read(name: str, *shape: int) -> np.ndarray:
            return np.frombuffer(row[name], dtype=np.int32 if name == "lists" else np.int64).reshape(shape)

        self.anchor_ids, self.anchor_uids, self.anchor_labels = read("q_ids", m), read("q_uids", m), read("q_labels", m)
        self.ids, self.uids, self.labels = read("ids", n), read("uids", n), read("labels", n)
        anchors, exact = read("q_exact", m, dims), read("exact", n, dims)
        largest = max(int(np.abs(anchors).max(initial=0)), int(np.abs(exact).max(initial=0)))
        self.anchors, self.exact, self.lists = fitting(anchors, largest), fitting(exact, largest), read("lists", dims, n)

    def search(self, at: int, same: bool, windows: list[tuple[int | None, int | None]], k: int) -> list[list[Found]]:
        allowed = self.labels == self.anchor_labels[at] if same else self.labels != self.anchor_labels[at]
        if same:
            allowed &= self.uids != self.anchor_uids[at]
        return best_rows(self.anchors[at], self.exact, self.lists, allowed, self.ids, self.uids, windows, k)


def _by_part(names: list[str], meet: Callable[[dict, dict], None], k: int):
    """Bests of consecutive blocks that meet the same anchors are merged before they are handed on.

    ``meet`` adds a meeting's finds to a dictionary: (head of the row) -> bests.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, {}

        def rows() -> Iterator[pa.RecordBatch]:
            made = [(*head, -s, i, u) for head, found in kept.items() for s, i, u in found]
            kept.clear()
            if made:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*made, strict=True)], names=names)

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["part"] != last:
                    yield from rows()
                    last = row["part"]
                found: dict = {}
                meet(row, found)
                for head, best in found.items():
                    kept[head] = sorted([*kept[head], *best])[:k] if head in kept else best
        yield from rows()

    return parts


def _positives(k: int):
    def meet(row: dict, found: dict) -> None:
        both = Meeting(row)
        for at in range(row["q_n"]):
            if best := both.search(at, True, [(None, None)], k)[0]:
                found[(row["part"], at, int(both.anchor_uids[at]))] = best

    return _by_part(["part", "position", "q_uid", "score", "id", "uid"], meet, k)


def _negatives(k: int, lowest: int, highest: int):
    def meet(row: dict, found: dict) -> None:
        both = Meeting(row)
        asked: dict[int, list] = {}
        for x in row["positives"]:
            asked.setdefault(x["position"], []).append((x["nth"], x["id"], x["score"]))
        for at, wanted in asked.items():
            windows = [window_of(score, lowest, highest) for _, _, score in wanted]
            for (nth, positive, score), best in zip(wanted, both.search(at, False, windows, k), strict=True):
                if best:
                    found[(int(both.anchor_uids[at]), int(both.anchor_ids[at]), nth, positive, score)] = best

    return _by_part(["q_uid", "anchor_id", "nth", "positive_id", "positive_score", "score", "id", "uid"], meet, k)


def hard_negatives(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST,
                   every: int = EVERY, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                   block_values: int = BLOCK_VALUES, anchor_values: int = ANCHOR_VALUES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``; scores are integer inner products with them; higher scores come first, ties by smaller id.
    An anchor's positives are its best other rows of the same label, all if fewer than ``positives``; each gives the best rows of other labels whose
    score lies between ``lowest`` and ``highest`` percent of the positive's, all if fewer than ``negatives`` (none for a positive below zero).
    Rows whose id, label or vector is null, and vectors with null or non-finite components, take no part. Vectors of different lengths never meet.
    Repeated rows are rows of their own, as anchors and as finds. A scaled component beyond 2^62 or a score beyond 64 bits is an error.
    Labels are integers. Other columns, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                          F.col(embedding).alias("embedding")).where("id is not null and label is not null and embedding is not null")
    blocks = written(rows.mapInArrow(_packed(scale, block_values, True), _BLOCK), "blocks")
    asked = written(rows.where(F.col("id") % every == 0).mapInArrow(_packed(scale, anchor_values, False), _ANCHORS), "anchors")
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int"))

    def met(anchors: DataFrame) -> DataFrame:
        """Every block of anchors beside every block of vectors of its length: anchors are copied to a fixed number of slots, vectors move once.

        Sorted and merged: the optimizer knows the copies by the size of one, and would send them all through the driver.
        """
        spread = anchors.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).withColumn("dims", F.col("q_dims"))
        return join_rows(spread, dealt, ["slot", "dims"])

    first = met(asked).mapInArrow(_positives(positives), "part bigint, position bigint, q_uid bigint, score bigint, id bigint, uid bigint")
    order = Window.partitionBy("q_uid").orderBy(F.desc("score"), "id", "uid")
    chosen = first.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives)
    # Back to the block of anchors: a fixed number of positives for each of a bounded number of anchors.
    packed = written(chosen.groupBy("part").agg(F.collect_list(F.struct("position", "nth", "id", "score")).alias("positives")), "positives")
    second = met(join_rows(asked, packed, ["part"])).mapInArrow(
        _negatives(negatives, lowest, highest),
        "q_uid bigint, anchor_id bigint, nth bigint, positive_id bigint, positive_score bigint, score bigint, id bigint, uid bigint")
    order = Window.partitionBy("q_uid", "nth").orderBy(F.desc("score"), "id", "uid")
    return second.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
           where vec_id is not null and label is not null and embedding is not null
             and list_count(embedding) = len(embedding) and not list_contains(list_transform(embedding, lambda x: isfinite(x)), false)),
s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_dot_product(a.e, c.e)::bigint as score
      from v a join v c on a.vec_id % 50 = 0 and c.vec_id <> a.vec_id),
p as (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as nth from s where same),
w as (select p.anchor_id, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score
      from p join s on p.anchor_id = s.anchor_id and p.nth <= 5 and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score),
r as (select *, row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id)::int as rank from w)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from r where rank <= 3
"""


@query("op13_hard_negatives", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved))


travels(__name__)
