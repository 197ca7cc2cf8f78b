"""Operator 2: packing by first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

A document's ids are cut into pieces of at most one sequence. Pieces are dealt at random into groups of bounded size; within a group they are
placed in decreasing length, each into the first bin that still holds it, found by descending a tournament tree. Bins that stay visibly short are
re-cut into sequences whose lengths are powers of two and need no padding. Groups never depend on each other, so a lost task repeats alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titrate.llm.common import partitions_for, per_worker, table, travels
from titrate.llm.registry import query

CAPACITY = 4096
END_ID = 2
GROUP_PIECES = 4096  # pieces in a group on average; memory of a group is at most a few times this many full sequences
SHORT = 64  # bins with more free places than this are re-cut
MEMO_PIECES = 800_000  # pieces whose ids a worker remembers before it starts anew: about 200 MB


class WordIds:
    """Ids of a text as the tokenizer gives them, through a memo of pieces.

    A text of printable Latin-1 and ASCII white space is lower-cased and cut by the tokenizer's own pattern (spelled out for these characters, whose
    normal form is their own), and each different piece is given to the tokenizer's model once. Any other text, and any that may hold the text of a
    special token, is cut at ASCII white space, which no token spans, and its words go through the whole tokenizer. The memo starts anew when full.
    """

    _LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
    # Fixed value: the splitter of word_bpe_49k.json, within Latin-1 after lower-casing.
    PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^ \t-\r{_LETTERS}{_NUMBERS}]+")
    PLAIN = re.compile("[ -~\t-\r\xa1-\xff]*")

    def __init__(self, path: str, memo_pieces: int = MEMO_PIECES) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte alphabet: others move behind 255 in order
        others = [b for b in range(256) if b not in printable]
        self.bytes = {b: chr(256 + k) for k, b in enumerate(others)}
        self.limit, self.known, self.words = memo_pieces, {}, {}

    def piece(self, piece: str) -> bytes:
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.bytes))
        found = self.known[piece] = np.array([t.id for t in tokens], dtype="<u4").tobytes()
        return found

    def word(self, word: bytes) -> bytes:
        found = self.words[word] = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
        return found

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if len(self.known) + len(self.words) > self.limit:
            self.known, self.words = {}, {}
        if self.PLAIN.fullmatch(text) and "<|" not in text:
            get, piece = self.known.get, self.piece
            return b"".join([get(p) or piece(p) for p in self.PIECES.findall(text.lower())])
        get, word = self.words.get, self.word
        return b"".join([get(w) or word(w) for w in text.encode().split()])


class FirstFit:
    """Bins of one capacity; a tournament tree over their free places finds the first bin that holds a piece in logarithmic time."""

    def __init__(self, most_bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, most_bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> int:
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < length:
                at += 1
        bin_ = at - self.leaves
        free[at] -= length
        while at > 1:
            at //= 2
            best = max(free[2 * at], free[2 * at + 1])
            if free[at] == best:
                break
            free[at] = best
        return bin_


def pack_group(lengths: list[int], capacity: int = CAPACITY, short: int = SHORT) -> list[tuple[int, int, int, int, int]]:
    """(piece, first id in the piece, length, sequence, offset) for pieces of at most ``capacity`` ids each, sequences counted from 0."""
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])  # stable: ties keep the given order
    tree = FirstFit(len(lengths), capacity)
    bins: dict[int, list[int]] = {}
    for k in order:
        bins.setdefault(tree.place(lengths[k]), []).append(k)
    out, sequence = [], 0
    for members in bins.values():
        held = sum(lengths[k] for k in members)
        if capacity - held <= short or held & (held - 1) == 0:
            sizes = [capacity]
        else:
            sizes = [1 << b for b in range(held.bit_length() - 1, -1, -1) if held >> b & 1]
        at = 0
        for k in members:
            taken = 0
            while taken < lengths[k]:
                cut = min(lengths[k] - taken, sizes[0] - at)
                out.append((k, taken, cut, sequence, at))
                taken, at = taken + cut, at + cut
                if at == sizes[0]:
                    sizes, sequence, at = sizes[1:], sequence + 1, 0
        sequence += at > 0
    return out


def _cut(path: str, end_id: int, capacity: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents to pieces of at most one sequence each; a batch gives several batches, so long texts stay small."""
        words = per_worker(f"word ids {path}", lambda: WordIds(path))
        names = ["uid", "doc_id", "start", "doc_tokens", "ids"]
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for uid, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids = words.ids(text) + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    rows.append((uid, doc_id, start, total, ids[4 * start : 4 * (start + capacity)]))
                    held += 1
                    if held % 1024 == 0:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECES, strict=True)], names=names)
                        rows = []
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECES, strict=True)], names=names)

    return cut


_PIECES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())


def pack(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID,
         group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32-bit, binary), doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizer file on every machine. A null or empty text is a document of the end id alone. Repeated rows are
    documents of their own. A sequence is padded to ``capacity`` unless its length is a power of two. An empty table gives no pieces; input
    columns but the two named play no part.
    """
    rows, octets = docs.select(F.count("*"), F.sum(F.octet_length(text).cast("long"))).first()
    groups = partitions_for(rows + (octets or 0) // capacity, group_pieces)
    pieces = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _cut(tokenizer, end_id, capacity), "uid bigint, doc_id bigint, start bigint, doc_tokens bigint, ids binary")
    group = F.pmod(F.xxhash64("uid", "start"), F.lit(groups)).alias("group")

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["uid", "start"], ignore_index=True)
        bodies = pdf["ids"].tolist()
        placed = pack_group([len(x) // 4 for x in bodies], capacity)
        k, first, length, sequence, offset = (np.array(x, dtype=np.int64) for x in zip(*placed, strict=True))
        return pd.DataFrame({
            "doc_id": pdf["doc_id"].astype("Int64").to_numpy()[k] if pdf["doc_id"].isna().any() else pdf["doc_id"].to_numpy(dtype=np.int64)[k],
            "start": pdf["start"].to_numpy()[k] + first, "length": length,
            "ids": [bodies[p][4 * a : 4 * (a + n)] for p, a, n in zip(k.tolist(), first.tolist(), length.tolist(), strict=True)],
            "doc_tokens": pdf["doc_tokens"].to_numpy()[k], "sequence_id": (int(key[0]) << 32) + sequence, "offset": offset,
        })

    return pieces.select("*", group).groupBy("group").applyInPandas(
        place, "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(pack(table(spark, sf_dir, "documents"), vocabulary()))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the pieces and their places in sequences."""
    return _digest(pack(docs, vocabulary()))


travels(__name__)
