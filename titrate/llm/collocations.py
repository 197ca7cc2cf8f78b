"""Operator 12: phrase collocations from an FM-index per shard.

A shard is about ``SHARD_WORDS`` words of one language, whole texts. Two Burrows-Wheeler transforms of it are kept: of its words and of its words reversed
(sorted by one word less than the longest phrase has, which is all that intervals of phrases to be extended need). Words that are too rare over the whole
language are breaks in it. A phrase is a pair of intervals of equal width, its count.

Phrases grow by one word in each round, to the right in even rounds and to the left in odd ones, so each is reached along one path. All extensions of a
phrase in a shard and their counts are the symbols under one of its intervals. Most extensions are rare; they are not sent as rows. A shard gives their
counts by cells of a hash, the cells are summed over shards, and a bitmap of the cells that reach ``MIN_COUNT`` goes back to the shards: every frequent
phrase lies in such a cell. The phrases in those cells are then counted by their words. A phrase is never rarer than one that holds it: nothing is lost.

A word's id is a hash, taken anew with another salt if two words of a language share one. Bitmaps have a fixed largest size, the only thing sent to all tasks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from titrate.llm.common import table, travels, written
from titrate.llm.registry import query

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
ABSORBED = 100  # percent of a phrase's count at which a longer one absorbs it
SHARD_WORDS = 1 << 20
BREAK = b"."  # stands for every break: no word holds a full stop
_PLAIN = bytes(10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else b for b in range(256)).lower()

RIGHT, LEFT = "right", "left"


def words_and_breaks(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased words in order, with ``BREAK`` between pieces and at the end."""
    # Once breaks are set apart, spaces and tabs are the only white space left in ASCII.
    return ((text or b"").translate(_PLAIN) + b"\n").replace(b"\n", b" . ").split()


def _shards(shard_words: int):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shard, lang, words, counts, tokens): number 0 is a break, number k the k-th word of ``words``."""
        waiting: dict[str, tuple[dict, list[np.ndarray]]] = {}
        sizes: dict[str, int] = defaultdict(int)
        made = TaskContext.get().partitionId() << 32

        def shard(lang: str) -> pa.RecordBatch:
            nonlocal made
            names, runs = waiting.pop(lang)
            del sizes[lang]
            tokens = np.concatenate(runs)
            counts = np.bincount(tokens, minlength=len(names))[1:]
            made += 1
            return pa.record_batch(
                [pa.array([made - 1], pa.int64()), pa.array([lang]), pa.array([list(names)[1:]], pa.list_(pa.binary())),
                 pa.array([counts], pa.list_(pa.int64())), pa.array([tokens.tobytes()], pa.binary())],
                names=["shard", "lang", "words", "counts", "tokens"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = words_and_breaks(text.as_py())
                if lang not in waiting:
                    names: dict = defaultdict()
                    names.default_factory = names.__len__
                    names[BREAK]
                    waiting[lang] = names, []
                names, runs = waiting[lang]
                runs.append(np.fromiter(map(names.__getitem__, found), np.int32, len(found)))
                sizes[lang] += len(found)
                if sizes[lang] >= shard_words:
                    yield shard(lang)
                while sum(sizes.values()) >= 2 * shard_words:  # many languages at once: the largest goes first
                    yield shard(max(sizes, key=sizes.__getitem__))
        for lang in list(waiting):
            yield shard(lang)

    return shards


def transform(text: np.ndarray, depth: int) -> np.ndarray:
    """The symbol before each suffix, suffixes sorted by ``depth`` symbols or more; the text is a ring that holds a break."""
    rank, width = text.astype(np.int64), 1
    while True:
        # As many neighbours as 63 bits hold at once; ranks take their place where that is too few. The order of ties has no meaning.
        bits = int(rank.max()).bit_length()
        times = min(-(-depth // width), max(2, 63 // max(1, bits)))
        key = rank
        for k in range(1, times):
            key = (key << bits) | np.roll(rank, -k * width)
        width *= times
        if width >= depth:
            return np.roll(text, 1)[np.argsort(key)]
        rank = np.unique(key, return_inverse=True)[1].reshape(-1).astype(np.int64)


def smallest(values: np.ndarray, symbols: int) -> np.ndarray:
    return values.astype(np.uint16 if symbols < 1 << 16 else np.uint32)


class Index:
    """Both transforms of a shard, and the word id of each symbol above 0 (in rising order)."""

    def __init__(self, symbols: np.ndarray, forward: np.ndarray, reverse: np.ndarray):
        self.symbols = symbols
        self.sides = {LEFT: forward, RIGHT: reverse}
        self.starts = np.r_[0, np.cumsum(np.bincount(self.sides[LEFT], minlength=len(symbols) + 1))]
        self._earlier: dict[str, np.ndarray] = {}

    @classmethod
    def of(cls, tokens: np.ndarray, ids: np.ndarray, depth: int) -> Index:
        """``ids[k]`` is the word id of number k, 0 for a break or a rare word."""
        symbols = np.unique(ids[ids > 0])
        number = np.where(ids > 0, np.searchsorted(symbols, ids) + 1, 0)
        text = number[tokens]
        text = text[(text > 0) | (np.r_[1, text[:-1]] > 0)]  # one break is as good as many
        text = np.r_[0, text]
        return cls(symbols, *(smallest(transform(x, depth), len(symbols) + 1) for x in (text, text[::-1])))

    def earlier(self, side: str) -> np.ndarray:
        """For each place of the transform: how often its symbol occurs before it."""
        if side not in self._earlier:
            symbols = self.sides[side]
            order = np.argsort(symbols, kind="stable")  # a radix sort for 16 bits
            out = np.empty(len(symbols), dtype=np.int64)
            out[order] = np.arange(len(symbols)) - self.starts[symbols[order]]
            self._earlier[side] = out
        return self._earlier[side]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(first place, count) of each word, the same in both directions."""
        return self.starts[1:-1], np.diff(self.starts)[1:]

    def _under(self, side: str, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, phrase's position and symbol in one number) of everything under the intervals."""
        ends = np.cumsum(count)
        places = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(low - (ends - count), count)
        return places, np.repeat(np.arange(len(low)) * (len(self.symbols) + 1), count) + self.sides[side][places]

    def extensions(self, side: str, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase's position, symbol, count) of every extension of the phrases by a word on this side."""
        key, times = np.unique(self._under(side, low, count)[1], return_counts=True)
        owner, symbol = np.divmod(key, len(self.symbols) + 1)
        word = symbol > 0
        return owner[word], symbol[word], times[word]

    def extend(self, side: str, low: np.ndarray, other: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """(phrase's position, symbol, low, other, count) of every extension of the phrases by a word on this side.

        ``low`` are the phrases' first places in this side's transform, ``other`` those in the opposite one.
        """
        places, under = self._under(side, low, count)
        key, first, times = np.unique(under, return_index=True, return_counts=True)
        owner, symbol = np.divmod(key, len(self.symbols) + 1)
        before = np.cumsum(times) - times
        stepped = self.starts[symbol] + self.earlier(side)[places[first]]
        across = other[owner] + before - (np.cumsum(count) - count)[owner]
        word = symbol > 0
        return owner[word], symbol[word], stepped[word], across[word], times[word]


_INDEX = "lang string, symbols binary, forward binary, reverse binary"
_CELLS = "bucket int, cells binary, times binary"
_FOUND = f"lang string, ids binary, n binary, {_CELLS}"  # of a shard and bucket: phrases and their counts, or counts of cells
ID_BITS = 63
FILTER_BITS = 26  # a filter has at most this power of two of bits: 8 MiB
BUCKET_BITS = 8, 11  # least and most; more than the least beyond a million cells a bucket
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_ids(words: list[bytes], salt: bytes, id_bits: int) -> np.ndarray:
    digest, mask = xxhash.xxh64_intdigest, (1 << id_bits) - 1
    return np.fromiter((max(1, digest(w + salt, 42) & mask) for w in words), np.int64, len(words))


def hashed(lang: str, ids: np.ndarray) -> np.ndarray:
    """64 bits for each row of word ids, the order of words and the language included."""
    out = np.full(len(ids), xxhash.xxh64_intdigest(lang.encode()), dtype=np.uint64)
    for k in range(ids.shape[1]):
        out = (out ^ ids[:, k].astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def bucket_bits(bits: int) -> int:
    least, most = BUCKET_BITS
    return max(least, min(bits - 20, most))


def by_bucket(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, list[int], list[tuple[int, int]]]:
    """(order of the hashes by bucket, buckets, their spans in it)."""
    bucket = (hashes >> np.uint64(64 - bucket_bits(bits))).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    names, starts = np.unique(bucket[order], return_index=True)
    spans = zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=False)
    return order, names.tolist(), list(spans) if len(bucket) else []


def cell_rows(hashes: np.ndarray, times: np.ndarray, bits: int) -> tuple[list[int], list[bytes], list[bytes]]:
    """(buckets, cells, times): counts by the first ``bits`` bits of the hashes, a byte for each; a larger count takes several entries."""
    low = bits - bucket_bits(bits)
    entries = -(-times // 255)
    part = np.full(int(entries.sum()), 255, dtype=np.uint8)
    part[np.cumsum(entries) - 1] = times - 255 * (entries - 1)
    hashes = np.repeat(hashes, entries)
    order, buckets, spans = by_bucket(hashes, bits)
    cell = ((hashes >> np.uint64(64 - bits)) & np.uint64((1 << low) - 1)).astype(np.uint16 if low <= 16 else np.uint32)[order]
    part = part[order]
    return buckets, [cell[i:j].tobytes() for i, j in spans], [part[i:j].tobytes() for i, j in spans]


def _reached(bits: int, least: int):
    low = bits - bucket_bits(bits)
    kept = min(bits, FILTER_BITS) - bucket_bits(bits)

    def reached(rows: pa.Table) -> pa.Table:
        """The bucket's part of the filter: a bit for each run of cells one of which counts ``least`` or more."""
        counts = np.zeros(1 << low, dtype=np.int64)
        for cells, times in zip(rows.column("cells"), rows.column("times"), strict=True):
            cell = np.frombuffer(cells.as_py(), dtype=np.uint16 if low <= 16 else np.uint32)
            np.add.at(counts, cell, np.frombuffer(times.as_py(), dtype=np.uint8))
        marks = (counts >= least).reshape(1 << kept, -1).any(axis=1)
        return pa.table({"bucket": rows.column("bucket").slice(0, 1), "marks": pa.array([np.packbits(marks).tobytes()], pa.binary())})

    return reached


class Filter:
    """Which hashes may be frequent: all that are, and a few others. Its size does not grow with the vocabulary."""

    def __init__(self, cells: DataFrame, bits: int, least: int):
        parts = cells.select("bucket", "cells", "times").groupBy("bucket").applyInArrow(_reached(bits, least), "bucket int, marks binary").collect()
        self.bits = min(bits, FILTER_BITS)
        each = 1 << (self.bits - bucket_bits(bits))
        marks = np.zeros((1 << bucket_bits(bits), -(-each // 8)), dtype=np.uint8)
        for row in parts:
            marks[row["bucket"]] = np.frombuffer(row["marks"], dtype=np.uint8)
        self.marks = marks.reshape(-1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return (self.marks[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 > 0


def _word_cells(bits: int):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, ids = np.array(batch.column("lang").to_pylist(), dtype=object), batch.column("id").to_numpy()
            for lang in set(langs.tolist()):
                own = ids[langs == lang]
                made = cell_rows(hashed(lang, own[:, None]), np.ones(len(own), dtype=np.int64), bits)
                yield pa.record_batch([pa.array(made[0], pa.int32()), *(pa.array(x, pa.binary()) for x in made[1:])], names=["bucket", "cells", "times"])

    return cells


def _build(salt: bytes, id_bits: int, depth: int, frequent):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lang = batch.column("lang")[k].as_py()
                ids = word_ids(batch.column("words")[k].as_py(), salt, id_bits)
                ids = np.r_[0, np.where(frequent.value(hashed(lang, ids[:, None])), ids, 0)]
                if not ids.any():
                    continue
                made = Index.of(np.frombuffer(batch.column("tokens")[k].as_py(), dtype=np.int32), ids, depth)
                parts = made.symbols, made.sides[LEFT], made.sides[RIGHT]
                yield pa.record_batch([pa.array([lang]), *(pa.array([x.tobytes()], pa.binary()) for x in parts)],
                                      names=["lang", "symbols", "forward", "reverse"])

    return build


def _read(row: dict) -> Index:
    symbols = np.frombuffer(row["symbols"], dtype=np.int64)
    kind = np.uint16 if len(symbols) + 1 < 1 << 16 else np.uint32
    return Index(symbols, np.frombuffer(row["forward"], dtype=kind), np.frombuffer(row["reverse"], dtype=kind))


def _side(size: int) -> str:
    return RIGHT if size % 2 == 0 else LEFT


def _joined(side: str, heads: np.ndarray, word: np.ndarray) -> np.ndarray:
    return np.c_[heads, word] if side == RIGHT else np.c_[word, heads]


def _scan(size: int, max_words: int, bits: int, filters: list):
    """Grows phrases to ``size`` words, keeping those that the filters of sizes 2 and more let pass; gives their counts and cells of their extensions."""

    def found(lang: str, index: Index) -> Iterator[pa.RecordBatch]:
        low, n = index.words()
        rlow, ids = low, index.symbols[:, None]
        for m in range(2, size + 1):
            side = _side(m)
            own, opposite = (rlow, low) if side == RIGHT else (low, rlow)
            owner, symbol, stepped, across, n = index.extend(side, own, opposite, n)
            ids = _joined(side, ids[owner], index.symbols[symbol - 1])
            low, rlow = (across, stepped) if side == RIGHT else (stepped, across)
            hashes = hashed(lang, ids)
            some = np.nonzero(filters[m - 2].value(hashes))[0]
            hashes, ids, low, rlow, n = hashes[some], ids[some], low[some], rlow[some], n[some]
        if size > 1 and len(n):
            order, buckets, spans = by_bucket(hashes, bits)
            own, counts = ids[order], n[order].astype(np.int64)
            parts = [buckets, [own[i:j].tobytes() for i, j in spans], [counts[i:j].tobytes() for i, j in spans]]
            yield pa.record_batch([pa.array([lang] * len(spans)), pa.array(parts[1], pa.binary()), pa.array(parts[2], pa.binary()),
                                   pa.array(buckets, pa.int32()), *[pa.nulls(len(spans), pa.binary())] * 2], names=names)
        if size < max_words and len(n):
            side = _side(size + 1)
            owner, symbol, times = index.extensions(side, rlow if side == RIGHT else low, n)
            made = cell_rows(hashed(lang, _joined(side, ids[owner], index.symbols[symbol - 1])), times, bits)
            rows = len(made[0])
            nothing = [pa.nulls(rows, t) for t in (pa.string(), pa.binary(), pa.binary())]
            yield pa.record_batch([*nothing, pa.array(made[0], pa.int32()), *(pa.array(x, pa.binary()) for x in made[1:])], names=names)

    names = [x.split()[0] for x in _FOUND.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from found(row["lang"], _read(row))

    return scan


def _added(ids: list, n: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(different phrases, sums of their counts) of packed phrases and counts."""
    words = np.concatenate([np.frombuffer(x, np.int64) for x in ids]).reshape(-1, size)
    counts = np.concatenate([np.frombuffer(x, np.int64) for x in n])
    order = np.lexsort(words.T)
    words = words[order]
    starts = np.nonzero(np.r_[True, (words[1:] != words[:-1]).any(axis=1)])[0]
    return words[starts], np.add.reduceat(counts[order], starts)


def _folded(size: int):
    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shards of a batch added up, before anything is shuffled."""
        for batch in batches:
            parts: dict[tuple, tuple[list, list]] = defaultdict(lambda: ([], []))
            for lang, bucket, ids, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = parts[lang, bucket]
                own[0].append(ids)
                own[1].append(n)
            made = [(*key, *(x.tobytes() for x in _added(*own, size))) for key, own in parts.items()]
            if made:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*made, strict=True), batch.schema.types, strict=True)], names=batch.schema.names)

    return folded


def _summed(size: int, least: int):
    def summed(rows: pa.Table) -> pa.Table:
        """Counts of the bucket's phrases over all shards, those of ``least`` or more."""
        ids, a = _added(rows.column("ids").to_pylist(), rows.column("n").to_pylist(), size)
        ids, a = ids[a >= least], a[a >= least]
        words = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * size), pa.array(ids.reshape(-1)))
        return pa.table({"lang": pa.array([rows.column("lang")[0].as_py()] * len(a), pa.string()), "words": words, "a": pa.array(a)})

    return summed


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, shard_words: int = SHARD_WORDS, text: str = "text",
                  lang: str = "lang", id_bits: int = ID_BITS) -> tuple[DataFrame, DataFrame]:
    """((lang, n) of all words, (lang, words, a) of every phrase of 1 to ``max_words`` words that occurs ``min_count`` times), as written tables."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").cast("binary").alias("body"))
    shards = written(rows.mapInArrow(
        _shards(shard_words), "shard bigint, lang string, words array<binary>, counts array<bigint>, tokens binary"), "shards")
    listed = shards.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("lang", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    counted = written(listed.groupBy("lang", "word").agg(F.sum("n").alias("a")), "words")
    totals = written(counted.groupBy("lang").agg(F.sum("a").alias("n")), "totals")
    size = totals.agg(F.sum("n")).first()[0] or 0
    bits = min(40, max(20, int(size).bit_length() - 3))
    for salt in (b"", *(bytes([k]) for k in range(1, 100))):  # until no two words of a language have one id
        word_id = F.greatest(F.lit(1), F.xxhash64(F.concat("word", F.lit(salt))).bitwiseAND((1 << id_bits) - 1)).alias("id")
        if counted.groupBy("lang", word_id).count().where("count > 1").isEmpty():
            break
    else:
        raise ValueError("more words than the ids tell apart")
    vocabulary = written(counted.where(F.col("a") >= min_count).select("lang", word_id, "word", "a"), "vocabulary")
    frequent = sc.broadcast(Filter(vocabulary.select("lang", "id").mapInArrow(_word_cells(bits), _CELLS), bits, 1))
    indexes = written(shards.select("lang", "words", "tokens").mapInArrow(_build(salt, id_bits, max(1, max_words - 1), frequent), _INDEX), "index")
    filters, levels = [], []
    for length in range(1, max_words + 1):
        found = indexes.mapInArrow(_scan(length, max_words, bits, list(filters)), _FOUND)
        if length > 1:
            found = written(found, "found")
            levels.append(found.where("lang is not null").select("lang", "bucket", "ids", "n").mapInArrow(
                _folded(length), "lang string, bucket int, ids binary, n binary").groupBy("lang", "bucket").applyInArrow(
                _summed(length, min_count), "lang string, words array<bigint>, a bigint"))
        if length < max_words:
            filters.append(sc.broadcast(Filter(found.where("lang is null"), bits, min_count)))
    phrases = vocabulary.select("lang", F.array(F.col("word").cast("string")).alias("words"), "a")
    if levels:
        longer = reduce(DataFrame.unionByName, levels)
        spelled = vocabulary.select("lang", "id", F.col("word").cast("string").alias("spelled"))
        placed = longer.select("lang", "words", "a", F.posexplode("words").alias("place", "id")).join(spelled, ["lang", "id"]).groupBy("lang", "words", "a").agg(
            F.array_sort(F.collect_list(F.struct("place", "spelled"))).alias("x"))
        phrases = phrases.unionByName(written(placed.select("lang", F.col("x.spelled").alias("words"), "a"), "spelled"))
    return totals, phrases


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, absorbed: int = ABSORBED,
                 shard_words: int = SHARD_WORDS, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by score, then count, then phrase in byte order.

    A phrase has 2 to ``max_words`` words inside a piece and occurs a >= ``min_count`` times, overlaps included. Its score is the least, over the cuts
    into a first and a last part of l and r occurrences, of floor(1000 * a * n / (l * r)), ties to the shortest first part; n counts the language's
    words. Phrases inside a longer one that has ``absorbed`` percent of their count or more are left out. A null text is empty, a null language is
    ``und``. Empty tables, and languages whose phrases are all too rare, give no row; repeated rows count as often as they come; long texts are read
    whole. Arithmetic is decimal of 38 digits (an overflow is an error). Other columns, whatever their names, are not read.
    """
    totals, counted = phrase_counts(docs, min_count, max_words, shard_words, text, lang)
    phrases = written(counted.withColumn("phrase", F.array_join("words", " ")), "phrases")
    size = F.size("words")
    longer = phrases.where(size > 2).select("lang", "a", F.explode(F.array(
        F.array_join(F.slice("words", F.lit(1), size - 1), " "), F.array_join(F.slice("words", F.lit(2), size - 1), " "))).alias("phrase"))
    holders = longer.groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    free = phrases.where(size > 1).join(holders, ["lang", "phrase"], "left").where(
        F.col("held").isNull() | (F.lit(100) * F.col("held") < F.lit(absorbed) * F.col("a"))).drop("held")
    cut = free.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, size - F.col("k")), " ").alias("last"))
    parts = phrases.select("lang", "phrase", "a")
    scored = cut.join(parts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"]).join(
        parts.select("lang", F.col("phrase").alias("last"), F.col("a").alias("r")), ["lang", "last"]).join(totals, "lang")
    exact = {c: f"cast({c} as decimal(19,0))" for c in "alrn"}
    scored = scored.withColumn("score", F.expr(f"(1000BD * {exact['a']} * {exact['n']}) div ({exact['l']} * {exact['r']})").cast("long"))
    least = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    return least.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


SQL = """
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from p),
t as (select lang, sum(len(w))::bigint as n from w group by lang),
m as (select unnest(range(1, 6)) as m),
g as (select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda k: array_to_string(w[k : k + m - 1], ' '))) as phrase
      from w join m on m <= len(w)),
f as (select lang, m, phrase, count(*) as a, string_split(phrase, ' ') as w from g group by all having count(*) >= 100),
x as (select lang, array_to_string(w[1 : m - 1], ' ') as phrase, a from f union all select lang, array_to_string(w[2 : m], ' '), a from f),
h as (select lang, phrase, max(a) as held from x group by all),
c as (select f.* from f left join h on f.lang = h.lang and f.phrase = h.phrase where m > 1 and (held is null or held < a)),
k as (select c.lang, c.phrase, c.a, u.m as k, array_to_string(w[1 : u.m], ' ') as p1, array_to_string(w[u.m + 1 : c.m], ' ') as p2
      from c join m u on u.m < c.m),
s as (select k.lang, k.phrase, k.a, k.k, y.a as l, z.a as r, t.n, ((1000::hugeint * k.a * t.n) // (y.a::hugeint * z.a))::bigint as score
      from k join f y on k.lang = y.lang and k.p1 = y.phrase join f z on k.lang = z.lang and k.p2 = z.phrase join t on t.lang = k.lang),
o as (select *, row_number() over (partition by lang, phrase order by score, k) as nth from s),
r as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from o where nth = 1)
select lang, rank, phrase, a, l, r, n, score from r where rank <= 2000
"""


@query("op12_collocations", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


travels(__name__)
