"""Operator 8: Grace hash deduplication.

Records are dealt by a hash of their content into buckets. A bucket is read into an open-addressing table that compares complete content.
When the table's byte budget is spent, contents that are not in it yet leave the bucket as overflow records; they are written to spill files
in the shared folder and dealt again by another hash, until nothing overflows. A content is either wholly in a table or wholly in the overflow,
so no group is ever split. Copies of one content are folded inside each input task first, so a text that a third of all rows share
reaches its bucket as one row per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titrate.llm.common import keep_columns, partitions_for, replacing, settled, table, travels, written
from titrate.llm.registry import query

BUCKET_BYTES = 48 << 20  # content bytes that one table holds
FOLD_BYTES = 8 << 20  # content bytes that the folding table of an input task holds
MAX_LEVELS = 32

_RECORD = "content string, top struct<id:bigint,uid:bigint>, copies bigint"
_FOUND = _RECORD + ", sha string"


class ContentTable:
    """Open addressing with linear probing; equal means equal bytes, hashes only choose the slot."""

    def __init__(self, seed: int, budget: int) -> None:
        self.seed, self.budget, self.held = seed, budget, 0
        self.slots = np.full(1024, -1, dtype=np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.tops: list[tuple] = []
        self.copies: list[int] = []

    def _grow(self) -> None:
        size = len(self.slots) * 2
        slots, mask = np.full(size, -1, dtype=np.int64), size - 1
        for entry, h in enumerate(self.hashes):
            at = h & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = entry
        self.slots = slots

    def add(self, content: bytes, top: tuple, copies: int) -> bool:
        """Folds the record in; False when its content is new and the budget is spent."""
        h, mask = xxhash.xxh64_intdigest(content, self.seed), len(self.slots) - 1
        at = h & mask
        while (entry := int(self.slots[at])) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                self.copies[entry] += copies
                if top > self.tops[entry]:
                    self.tops[entry] = top
                return True
            at = (at + 1) & mask
        if self.contents and self.held + len(content) > self.budget:
            return False
        self.slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.tops.append(top)
        self.copies.append(copies)
        self.held += len(content)
        if len(self.contents) * 3 > len(self.slots) * 2:
            self._grow()
        return True


_NULL_ID = -(1 << 63)  # orders an absent id below all others inside the table


def _top_array(tops: list[tuple]) -> pa.StructArray:
    ids = pa.array([None if present == 0 else i for present, i, _ in tops], pa.int64())
    return pa.StructArray.from_arrays([ids, pa.array([u for _, _, u in tops], pa.int64())], ["id", "uid"])


def _records(batch: pa.RecordBatch) -> Iterable[tuple[bytes, tuple, int]]:
    """Reads (content, top, copies) of a batch; a top is (id present, id, uid)."""
    contents = batch.column("content").cast(pa.large_binary()).to_pylist()
    top = batch.column("top")
    ids, uids = top.field("id").to_pylist(), top.field("uid").to_pylist()
    for content, i, u, n in zip(contents, ids, uids, batch.column("copies").to_pylist(), strict=True):
        yield content, ((0, _NULL_ID, u) if i is None else (1, i, u)), n


def _text(contents: list[bytes]) -> pa.Array:
    return pa.array(contents, pa.binary()).cast(pa.string())


def _chunks(items: list, size: int = 4 << 20) -> Iterator[slice]:
    """Slices of contents of about ``size`` bytes, so that a batch stays small."""
    start = held = 0
    for k, x in enumerate(items):
        held += len(x)
        if held >= size:
            yield slice(start, k + 1)
            start, held = k + 1, 0
    if start < len(items):
        yield slice(start, len(items))


def _emit(store: ContentTable) -> Iterator[pa.RecordBatch]:
    for part in _chunks(store.contents):
        yield pa.record_batch([_text(store.contents[part]), _top_array(store.tops[part]), pa.array(store.copies[part], pa.int64())],
                              names=["content", "top", "copies"])


def _fold(budget: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Copies inside one input task become one record; a full table is passed on and begun anew."""
        store = ContentTable(0, budget)
        for batch in batches:
            lowered = pc.ascii_lower(batch.column("content"))
            batch = pa.record_batch([lowered, batch.column("top"), batch.column("copies")], names=["content", "top", "copies"])
            for record in _records(batch):
                if not store.add(*record):
                    yield from _emit(store)
                    store = ContentTable(0, budget)
                    store.add(*record)
        yield from _emit(store)

    return fold


def _bucket(seed: int, budget: int):
    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One bucket: overflow records (with their content) first, then one row without content for each content found."""
        store = ContentTable(seed, budget)
        over: list[tuple[bytes, tuple, int]] = []
        held = 0

        def spilled() -> pa.RecordBatch:
            n = len(over)
            return pa.record_batch([_text([x[0] for x in over]), _top_array([x[1] for x in over]), pa.array([x[2] for x in over], pa.int64()),
                                    pa.nulls(n, pa.string())], names=["content", "top", "copies", "sha"])

        for batch in batches:
            for record in _records(batch):
                if not store.add(*record):
                    over.append(record)
                    held += len(record[0])
                    if held >= 4 << 20:
                        yield spilled()
                        over, held = [], 0
        if over:
            yield spilled()
        for start in range(0, len(store.contents), 10_000):
            part = slice(start, start + 10_000)
            shas = [hashlib.sha256(c).hexdigest() for c in store.contents[part]]
            yield pa.record_batch([pa.nulls(len(shas), pa.string()), _top_array(store.tops[part]), pa.array(store.copies[part], pa.int64()),
                                   pa.array(shas, pa.string())], names=["content", "top", "copies", "sha"])

    return bucket


def content_groups(records: DataFrame, bucket_bytes: int = BUCKET_BYTES, fold_bytes: int = FOLD_BYTES) -> DataFrame:
    """One row for each different content of ``records(content, top, copies)``: sha, top, copies.

    Contents are compared after lower-casing A-Z. Two different contents of one SHA-256 would be an error of the digest; none is known.
    """
    total = records.select(F.sum(F.octet_length("content").cast("long"))).first()[0] or 0
    rest, level, found = records.mapInArrow(_fold(fold_bytes), _RECORD), 0, None
    while True:
        # A bucket gets half a table's worth on average, so that the usual bucket fits at once.
        buckets = partitions_for(2 * total, bucket_bytes, 1)
        dealt = rest.repartition(buckets, F.xxhash64(F.lit(level), F.col("content")))
        spill = written(dealt.mapInArrow(_bucket(level + 1, bucket_bytes), _FOUND), f"grace-{level}")
        done = spill.where("sha is not null").select("sha", "top", "copies")
        found = done if found is None else found.unionByName(done)
        rest = spill.where("sha is null").select("content", "top", "copies")
        total = rest.select(F.sum(F.octet_length("content").cast("long"))).first()[0]
        if total is None:
            return found
        level += 1
        if level > MAX_LEVELS:
            raise RuntimeError("contents cannot be told apart by hash")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket_bytes: int = BUCKET_BYTES,
                fold_bytes: int = FOLD_BYTES) -> DataFrame:
    """Every row of ``docs`` with ``text_sha256``, ``keep_id``, ``group_size`` and ``kept``.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. The row of the largest id stays; a null id counts as
    smaller than any other, and of repeated rows with one id a single row stays (the last one read). An empty table gives an empty table.
    Input columns named like a result column are replaced.
    """
    base = settled(docs).withColumn("__uid", F.monotonically_increasing_id())
    body = F.coalesce(F.col(text), F.lit(""))
    records = base.select(body.alias("content"), F.struct(F.col(doc_id).cast("long").alias("id"), F.col("__uid").alias("uid")).alias("top"),
                          F.lit(1).cast("long").alias("copies"))
    groups = content_groups(records, bucket_bytes, fold_bytes).where("copies > 1").select(
        F.col("sha").alias("__sha"), F.col("top.id").alias("__top"), F.col("top.uid").alias("__top_uid"), F.col("copies").alias("__copies"))
    rows = base.withColumn("__sha", _sha(body))
    single = F.col("__copies").isNull()
    joined = rows.join(groups, "__sha", "left")
    results = {
        "keep_id": F.when(single, F.col(doc_id).cast("long")).otherwise(F.col("__top")),
        "group_size": F.coalesce("__copies", F.lit(1).cast("long")),
        "kept": single | (F.col("__uid") == F.col("__top_uid")),
        "text_sha256": F.col("__sha"),
    }
    own = [f"`{c}`" for c in replacing(docs, *results).columns]
    return joined.select(*own, *[value.alias(name) for name, value in results.items()])


def _sha(text):
    """SHA-256 of the text after lower-casing A-Z, on Arrow batches."""

    @F.pandas_udf("string")
    def digest(texts):
        return texts.map(lambda x: hashlib.sha256(x.encode().lower()).hexdigest())

    return digest(text)


SQL = """
with t as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body from documents)
select doc_id, max(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size,
       doc_id = max(doc_id) over (partition by body) as kept, text_sha256
from t
"""


@query("op8_exact_dedup", SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts the row with the largest id stays."""
    return keep_columns(exact_dedup(docs).where("kept"), docs)


travels(__name__)
