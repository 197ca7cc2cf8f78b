"""Operator 9: SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints are cut into three segments of 22, 21 and 21 bits, each read as a 23-bit word of the perfect binary Golay code. A word's keys are
the indices of all codewords within four bits: one key when its nearest codeword is within two bits, six otherwise; two words at most two bits
apart share a key. At most four wrong bits over three segments leave these cases (pigeonhole):

* a segment without error: it is a key part as it stands, joined to a codeword index of another segment with at most two errors (30 bits and more);
* no such segment: then two segments have one error each and the third at most two. The codeword index of one, the half of the other that has
  no error and the third part of the last that has none make the key (about 29 bits).

Every linked pair shares a key; pairs are verified bit by bit. Equal fingerprints are folded first, and a bucket gives the edges of a spanning
forest of its links instead of all its pairs, so families of near copies stay linear in edges. Components are found by alternating large-star and
small-star steps over tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titrate.llm.common import keep_columns, settled, table, travels, written
from titrate.llm.near_copies import near_copies
from titrate.llm.registry import query

SHINGLE_WORDS = 4
MAX_BITS = 4
HASH_SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (first bit, bits)
GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the [23,12,7] Golay code
BLOCK = 1 << 16  # shingles hashed at a time


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """Majority of each bit over the XXH64 of all word shingles; 0 without words."""
    if not text:
        return 0
    found = text.encode().lower().split()  # bytes split at ASCII white space only
    if not found:
        return 0
    size = min(words, len(found))
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(found) - size + 1].tolist()
    stops = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), BLOCK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[k : k + BLOCK], stops[k : k + BLOCK], strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<i8")[0])


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """(remainders of the 12 message bits, patterns [syndrome, 6]): the error patterns of weight at most 4 of each syndrome; -1 fills up.

    A syndrome has either one pattern of weight at most two, or one of weight three and five of weight four.
    """
    remainders = np.arange(1 << 12, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        remainders = np.where(remainders >> bit & 1, remainders ^ (GENERATOR << (bit - 11)), remainders)
    patterns = np.full((1 << 11, 6), -1, dtype=np.int64)
    used = np.zeros(1 << 11, dtype=np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            word = sum(1 << b for b in bits)
            syndrome = int(remainders[word >> 11]) ^ (word & 0x7FF)
            patterns[syndrome, used[syndrome]] = word
            used[syndrome] += 1
    return remainders, patterns


def codeword_indices(words: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """[n, 6] indices of the codewords within four bits of each 23-bit word; -1 where there are fewer."""
    remainders, patterns = tables
    near = patterns[remainders[words >> 11] ^ (words & 0x7FF)]
    return np.where(near < 0, -1, (words[:, None] ^ near) >> 11)


def candidate_keys(prints: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, positions of their fingerprints). A key is an exact packing of its case and parts, not a hash."""
    bits = prints.view(np.uint64)
    segments = [((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    codes = [codeword_indices(s, tables) for s in segments]
    keys, owners, case = [], [], 0
    everyone = np.arange(len(prints))

    def put(index: np.ndarray, rest: np.ndarray) -> None:
        some = index >= 0
        keys.append(((np.int64(case) << 40) | (rest[:, None] << 12) | index)[some])
        owners.append(np.broadcast_to(everyone[:, None], index.shape)[some])

    for exact in range(3):
        for other in range(3):
            if other != exact:
                put(codes[other], segments[exact])
                case += 1
    for coded, halved, third in ((0, 1, 2), (0, 2, 1), (1, 2, 0)):
        for half in range(2):
            for part in range(3):
                put(codes[coded], ((segments[halved] >> (11 * half) & 0x7FF) << 8) | (segments[third] >> (8 * part) & 0xFF))
                case += 1
    return np.concatenate(keys), np.concatenate(owners)


def bucket_edges(prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (larger, smaller) of a forest that joins exactly what links of at most ``max_bits`` bits join among these different fingerprints.

    Leaders take in all within reach; where several components are left, the members of all but the largest look for links to the rest.
    """
    n = len(prints)
    bits = prints.view(np.uint64)
    parent = np.arange(n)
    edges: list[tuple[np.ndarray, np.ndarray]] = []

    def look(at: int) -> None:
        near = np.nonzero(np.bitwise_count(bits ^ bits[at]) <= max_bits)[0]
        reached[near] = True
        others = np.unique(parent[near])
        others = others[others != parent[at]]
        if len(others):
            first = near[np.unique(parent[near], return_index=True)[1]]  # one link to each component
            first = first[parent[first] != parent[at]]
            edges.append((np.full(len(first), prints[at]), prints[first]))
            parent[np.isin(parent, others)] = parent[at]

    reached = np.zeros(n, dtype=bool)
    leaders = np.zeros(n, dtype=bool)
    at = 0
    while at < n:
        leaders[at] = True
        look(at)
        rest = np.nonzero(~reached[at + 1 :])[0]
        at = n if not len(rest) else at + 1 + int(rest[0])
    names, sizes = np.unique(parent, return_counts=True)
    if len(names) > 1:
        largest = names[np.argmax(sizes)]
        for k in np.nonzero((parent != largest) & ~leaders)[0]:
            look(int(k))
    if not edges:
        return prints[:0], prints[:0]
    a, b = np.concatenate([x for x, _ in edges]), np.concatenate([y for _, y in edges])
    return np.maximum(a, b), np.minimum(a, b)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = golay_tables()
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        for k in range(0, len(prints), 4096):
            part = prints[k : k + 4096]
            keys, owners = candidate_keys(part, tables)
            yield pa.record_batch([pa.array(keys), pa.array(part[owners])], names=["key", "print"])


def _links(max_bits: int):
    def of_runs(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch | None:
        starts = np.nonzero(np.r_[True, keys[1:] != keys[:-1]])[0]
        lengths = np.diff(np.r_[starts, len(keys)])
        two = starts[lengths == 2]
        a, b = prints[two], prints[two + 1]
        near = np.bitwise_count((a ^ b).view(np.uint64)) <= max_bits
        found = [(np.maximum(a, b)[near], np.minimum(a, b)[near])]
        many = lengths > 2
        found += [bucket_edges(prints[s : s + n], max_bits) for s, n in zip(starts[many].tolist(), lengths[many].tolist(), strict=True)]
        pairs = np.unique(np.stack([np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])]), axis=1)
        return pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"]) if pairs.shape[1] else None

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in key order; the last key of a batch waits for the next batch."""
        open_keys: list[np.ndarray] = []
        open_prints: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, prints = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            if keys[0] != keys[-1]:
                cut = int(np.searchsorted(keys, keys[-1]))
                out = of_runs(np.concatenate([*open_keys, keys[:cut]]), np.concatenate([*open_prints, prints[:cut]]))
                if out is not None:
                    yield out
                open_keys, open_prints = [keys[cut:]], [prints[cut:]]
            elif open_keys and open_keys[-1][-1] != keys[0]:
                out = of_runs(np.concatenate(open_keys), np.concatenate(open_prints))
                if out is not None:
                    yield out
                open_keys, open_prints = [keys], [prints]
            else:
                open_keys.append(keys)
                open_prints.append(prints)
        if open_keys and (out := of_runs(np.concatenate(open_keys), np.concatenate(open_prints))) is not None:
            yield out

    return links


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each linked node but the root with the smallest node of its component. Edges come as u > v.

    Large-star and small-star steps in turn until nothing changes; every step aggregates before it joins, so a hub is one row of the aggregate.
    """
    edges = written(edges.distinct(), "edges")
    state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            lowest.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "edges")
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if after == state:
            break
        state = after
    return edges


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = SHINGLE_WORDS,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(uid, doc_id, fingerprint, component_id, kept), one row for each row of ``docs``; uid numbers its rows as read.

    Texts without words (null, empty, white space) have fingerprint zero and are linked like any other. component_id is the smallest id that is
    not null in the component (null when all are); of a component the row with that id, the first read of several, has ``kept``.
    ``max_bits`` may be at most 4, what the keys are made for.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the keys find links of at most four bits")

    @F.pandas_udf("long")
    def printed(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    rows = written(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("body"))
                   .select("uid", "id", printed("body").alias("print")), "prints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("uid"))).alias("first")
    nodes = rows.groupBy("print").agg(first)
    # A fingerprint has over a hundred keys: they are made in as many tasks as the keys' own shuffle has, however few bytes the fingerprints take.
    spread = nodes.select("print").repartition(
        int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("print"))
    keyed = spread.mapInArrow(_keys, "key bigint, print bigint")
    dealt = keyed.repartition(F.col("key")).sortWithinPartitions("key", "print")
    stars = components(dealt.mapInArrow(_links(max_bits), "u bigint, v bigint"))
    rooted = nodes.join(stars, nodes["print"] == stars["u"], "left").select("print", "first", F.coalesce("v", "print").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"))
    named = rooted.join(heads, "root").select("print", "head")
    return rows.join(named, "print").select(
        "uid", F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("head.id").alias("component_id"), (F.col("uid") == F.col("head.uid")).alias("kept"))


@query("op9_simhash_components")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of documents linked by a five-word Jaccard similarity of 0.8 or more, one of each component stays, the one with the smallest id."""
    docs = settled(docs)
    kept = near_copies(docs).where("kept").select(F.col("uid").alias("__uid"))
    return keep_columns(docs.withColumn("__uid", F.monotonically_increasing_id()).join(kept, "__uid"), docs)


travels(__name__)
