"""Operator 11: near-duplicates by min-max hashing.

Of every permutation of the shingles' hashes both the least and the greatest value are kept: each agrees between two sets with a probability equal to
their Jaccard similarity, so a signature needs half the evaluations of MinHash, and its estimate has a lower variance. Bands take five values, never
both of one permutation; there are as many as let a pair of just the least similarity slip with a probability below ``MISS``.

From buckets to classes, without a row for each pair of a bucket:

* Equal sets are folded to one node first.
* Each node is held against one leader, the smallest member that most of its buckets have in common, by exact similarity (one row for each node).
* In buckets that hold several components after that, signatures tell inside the task which members may still have a partner in another component, each
  pair in the first bucket it shares. Those members alone are sent on with their whole sets, and a task gives the edges of a spanning forest of the links
  it confirms: fewer rows than members. A bucket beyond ``BLOCK_NODES`` members or ``BLOCK_SHINGLES`` shingles is dealt as pairs of blocks to many tasks.

No pair that bands and signatures name is left out, and every link is confirmed on full sets (of 64-bit hashes of the shingles).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titrate.llm.common import table, travels, written
from titrate.llm.registry import query

SHINGLE_WORDS = 2
PERCENT = 80
MISS = 1e-6
ROWS = 5  # signature values of a band
HASH_SEED = 42
STEP = 2048  # shingles whose values are made at a time
BLOCK_NODES = 4096
BLOCK_SHINGLES = 1 << 21


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands that find a pair of the least similarity with probability 1 - ``miss``."""
    return 1 if percent >= 100 else math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def least_agreeing(values: int, percent: int, miss: float = MISS) -> int:
    """The number of signature values such that a pair of the least similarity has fewer in common with a probability of at most ``miss``."""
    share, total = percent / 100, 0.0
    for k in range(values + 1):
        total += math.comb(values, k) * share**k * (1 - share) ** (values - k)
        if total > miss:
            return k
    return values


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted different XXH64 hashes of the word shingles, A-Z lower-cased; a shorter text is one shingle, a text without words has none."""
    found = text.encode().lower().split() if text else []  # bytes split at ASCII white space only
    if not found:
        return np.zeros(0, dtype=np.uint64)
    size = min(words, len(found))
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(found) - size + 1].tolist()
    stops = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts)))


def factors(bands: int, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(odd factor of each permutation, odd factor of each signature value in its band's key)."""
    made = np.random.default_rng(HASH_SEED).integers(0, 1 << 64, 2 * bands * rows, dtype=np.uint64, endpoint=False) | np.uint64(1)
    return made[: max(rows, -(-bands * rows // 2))], made[bands * rows :]


def signature(own: np.ndarray, permutations: np.ndarray, values: int) -> np.ndarray:
    """The least, then the greatest value under each permutation, cut to ``values``."""
    least = np.full(len(permutations), np.iinfo(np.uint64).max, dtype=np.uint64)
    greatest = np.zeros(len(permutations), dtype=np.uint64)
    for k in range(0, len(own), STEP):
        made = permutations[:, None] * own[None, k : k + STEP]
        np.minimum(least, made.min(1), out=least)
        np.maximum(greatest, made.max(1), out=greatest)
    return np.concatenate([least, greatest])[:values]


def fingerprint(own: np.ndarray) -> int:
    """SimHash of a set of hashes: each bit by the majority of its members; 0 without any."""
    if not len(own):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(own), STEP):
        counts += np.unpackbits(own[k : k + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(own), bitorder="little").view("<i8")[0])


def _prints(words: int, bands: int, link_blank: bool, fuzzy: bool):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutations, mixers = factors(bands)
        for batch in batches:
            uids, ids, bodies = batch.columns
            for k in range(0, batch.num_rows, 1024):
                digests, sizes, sketches, keys, marks = [], [], [], [], []
                for uid, text in zip(uids[k : k + 1024], bodies[k : k + 1024], strict=True):
                    own = shingles(text.as_py(), words)
                    made = signature(own, permutations, len(mixers))
                    blank = b"" if link_blank else uid.as_py().to_bytes(8, "little")
                    digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else b"blank" + blank)
                    sizes.append(len(own))
                    marks.append(fingerprint(own) if fuzzy else 0)
                    sketches.append((made >> np.uint64(8)).astype(np.uint8).tobytes())
                    keys.append((made * mixers).reshape(bands, -1).sum(1, dtype=np.uint64).view(np.int64) if len(own) else np.zeros(0, np.int64))
                offsets = np.r_[0, np.cumsum([len(x) for x in keys])].astype(np.int32)
                yield pa.record_batch(
                    [uids[k : k + 1024], ids[k : k + 1024], pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys))), pa.array(marks, pa.int64())],
                    names=["uid", "id", "digest", "n", "sketch", "keys", "print"])

    return prints


def _sets(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, bodies = batch.columns
            for k in range(0, batch.num_rows, 256):
                own = [shingles(x.as_py(), words).view(np.int64) for x in bodies[k : k + 256]]
                offsets = np.r_[0, np.cumsum([len(x) for x in own])].astype(np.int32)
                yield pa.record_batch([nodes[k : k + 256], pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own)))], names=["node", "own"])

    return sets


class Cell:
    """The members of a bucket, or of two blocks of one, that a task holds at a time."""

    def __init__(self, columns: dict[str, np.ndarray], percent: int, threshold: int):
        self.node, self.label, self.n, self.side = (columns[c] for c in ("node", "label", "n", "side"))
        self.sketch, self.keys, self.band = columns["sketch"], columns["keys"], int(columns["band"][0])
        self.percent, self.threshold = percent, threshold
        self.across = self.side.min() != self.side.max()
        names, self.part, counts = np.unique(self.label, return_inverse=True, return_counts=True)
        self.largest = int(np.argmax(counts)) if len(names) > 1 else None

    def lookers(self) -> list[int]:
        """Members of all components but the largest: every pair across components has one."""
        return [] if self.largest is None else np.nonzero(self.part != self.largest)[0].tolist()

    def partners(self, at: int) -> np.ndarray:
        """Members of other components that may be similar and share no earlier bucket."""
        low, high = np.minimum(self.n, self.n[at]), np.maximum(self.n, self.n[at])
        may = (self.part != self.part[at]) & (100 * low >= self.percent * high)
        if self.across:
            may &= self.side != self.side[at]
        some = np.nonzero(may)[0]
        some = some[np.count_nonzero(self.sketch[some] == self.sketch[at], axis=1) >= self.threshold]
        return some[np.argmax(self.keys[some] == self.keys[at], axis=1) == self.band]


def flagged(cell: Cell) -> np.ndarray:
    """Positions of the members that have a partner."""
    found = np.zeros(len(cell.node), dtype=bool)
    for at in cell.lookers():
        some = cell.partners(at)
        if len(some):
            found[some] = found[at] = True
    return np.nonzero(found)[0]


def forest(cell: Cell, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(larger, smaller) edges that join exactly the components that links between partners join."""
    lengths = np.array([len(x) for x in sets], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    _, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    marks = np.zeros(int(tokens.max(initial=0)) + 1, dtype=bool)
    root = np.arange(int(cell.part.max()) + 1)
    edges = []
    for at in cell.lookers():
        some = cell.partners(at)
        some = some[root[cell.part[some]] != root[cell.part[at]]]
        if not len(some):
            continue
        mine = tokens[starts[at] : starts[at] + lengths[at]]
        marks[mine] = True
        ends = np.cumsum(lengths[some])
        spots = np.arange(ends[-1]) + np.repeat(starts[some] - (ends - lengths[some]), lengths[some])
        common = np.add.reduceat(marks[tokens[spots]].astype(np.int64), ends - lengths[some])
        marks[mine] = False
        linked = some[100 * common >= cell.percent * (lengths[some] + lengths[at] - common)]
        for other in linked.tolist():
            a, b = root[cell.part[other]], root[cell.part[at]]
            if a != b:
                edges.append((max(cell.node[at], cell.node[other]), min(cell.node[at], cell.node[other])))
                root[root == a] = b
    return edges


_MEMBER = "key bigint, cell bigint, band int, node bigint, label bigint, n int, side int, sketch binary, keys array<bigint>"


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    rows = batch.num_rows
    out = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "cell", "band", "node", "label", "n", "side")}
    out["n"] = out["n"].astype(np.int64)
    out["sketch"] = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(rows, -1)
    out["keys"] = batch.column("keys").flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
    return out


def _by_cell(give: Callable[[pa.RecordBatch, dict[str, np.ndarray]], pa.RecordBatch | None]):
    """Hands on the rows of one cell at a time; they come in the order of key and cell."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if waiting:
                whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting.clear()
                if (out := give(whole, _columns(whole))) is not None:
                    yield out

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, cell = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "cell"))
            cuts = np.nonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))[0] + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if (key[a], cell[a]) != last:
                    yield from flush()
                    last = (key[a], cell[a])
                waiting.append(batch.slice(a, b - a))
        yield from flush()

    return cells


def _flags(percent: int, threshold: int):
    def give(rows: pa.RecordBatch, columns: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        some = flagged(Cell(columns, percent, threshold))
        return rows.take(pa.array(some)) if len(some) else None

    return _by_cell(give)


def _forests(percent: int, threshold: int):
    def give(rows: pa.RecordBatch, columns: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        own = rows.column("own")
        offsets, flat = own.offsets.to_numpy(), own.values.to_numpy(zero_copy_only=False)
        sets = [flat[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        edges = forest(Cell(columns, percent, threshold), sets)
        u, v = zip(*edges, strict=True) if edges else ((), ())
        return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"]) if edges else None

    return _by_cell(give)


def _fuzzy_pairs(nodes: DataFrame, max_bits: int) -> DataFrame:
    """(node, leader) pairs whose fingerprints are at most ``max_bits`` bits apart, by Golay keys (see ``simhash``): of each fingerprint one node stands
    for its others, and a bucket of fingerprints gives the edges of a spanning forest."""
    from titrate.llm import simhash

    heads = written(nodes.groupBy("print").agg(F.min("node").alias("head")), "fingerprints")
    slots = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = heads.select("print").repartition(slots, F.xxhash64("print")).mapInArrow(simhash._keys, "key bigint, print bigint")
    edges = keyed.repartition(F.col("key")).sortWithinPartitions("key", "print").mapInArrow(simhash._links(max_bits), "u bigint, v bigint").distinct()
    named = edges.join(heads.select(F.col("print").alias("u"), F.col("head").alias("a")), "u").join(
        heads.select(F.col("print").alias("v"), F.col("head").alias("b")), "v")
    same = nodes.join(heads, "print").where("node <> head").select("node", F.col("head").alias("leader"))
    return same.unionByName(named.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("leader")))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = SHINGLE_WORDS, percent: int = PERCENT,
                    link_blank: bool = False, block_nodes: int = BLOCK_NODES, block_shingles: int = BLOCK_SHINGLES,
                    fuzzy_bits: int | None = None) -> DataFrame:
    """(uid, doc_id, n_shingles, component_id, kept), one row for each row of ``docs``; uid numbers its rows as read (twice, so they must read alike).

    Documents are linked when 100 * intersection >= ``percent`` * union of their sets of ``words``-word shingles. A text with fewer words is one shingle.
    Texts without words (null, empty, white space) have empty sets and are linked with nothing, or with each other where ``link_blank``.
    component_id is the smallest id that is not null in the component (null when all are); of a component the row with that id, the first read of
    several, has ``kept``. Repeated rows are rows of their own. Other columns, whatever their names, are not read.
    With ``fuzzy_bits`` sets whose SimHash fingerprints are at most so many bits apart are candidates beside those of the bands.
    """
    if not 0 < percent <= 100:
        raise ValueError("the percentage must be above 0 and at most 100")
    from titrate.llm.simhash import components

    bands = bands_for(percent)
    threshold = least_agreeing(bands * ROWS, percent)
    numbered = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("body"))
    prints = written(numbered.mapInArrow(
        _prints(words, bands, link_blank, fuzzy_bits is not None),
        "uid bigint, id bigint, digest binary, n int, sketch binary, keys array<bigint>, print bigint"), "prints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("uid"))).alias("first")
    folded = written(prints.groupBy("digest").agg(F.min("uid").alias("node"), first), "folded")
    chosen = prints.join(folded.select(F.col("node").alias("uid")), "uid", "left_semi").select(F.col("uid").alias("node"), "n", "sketch", "keys", "print")
    keyed = written(chosen.select(F.posexplode("keys").alias("band", "key"), "node", "n"), "keys")
    heads = keyed.groupBy("key").agg(F.count("*").alias("size"), F.sum(F.col("n").cast("long")).alias("total"),
                                     F.min(F.struct("node", "n")).alias("lead")).where("size > 1")
    blocks = F.greatest(F.ceil(F.col("size") / block_nodes), F.ceil(F.col("total") / block_shingles)).cast("int")
    buckets = written(keyed.join(heads, "key").select("key", "band", "node", "n", blocks.alias("blocks"), "lead"), "buckets")
    alive = buckets.select("node")
    fuzzy = None
    if fuzzy_bits is not None:
        fuzzy = written(_fuzzy_pairs(chosen.where("n > 0").select("node", "print"), fuzzy_bits), "fuzzy")
        alive = alive.unionByName(fuzzy.select("node")).unionByName(fuzzy.select(F.col("leader").alias("node")))
    alive = alive.distinct()
    bodies = numbered.select(F.col("uid").alias("node"), "body").join(alive, "node", "left_semi")
    sets = written(bodies.mapInArrow(_sets(words), "node bigint, own array<bigint>"), "shingles")

    # One leader for each node: the one that most of its buckets have.
    near_size = 100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n")
    leaders = buckets.where(F.col("node") > F.col("lead.node")).where(near_size).groupBy("node", F.col("lead.node").alias("leader")).agg(
        F.count("*").alias("times")).groupBy("node").agg(F.max_by("leader", F.struct("times", -F.col("leader"))).alias("leader"))
    if fuzzy is not None:
        leaders = leaders.select("node", "leader").unionByName(fuzzy).distinct()
    both = leaders.join(sets.withColumnRenamed("own", "a"), "node").join(
        sets.select(F.col("node").alias("leader"), F.col("own").alias("b")), "leader")
    common = F.size(F.array_intersect("a", "b"))
    links = written(both.where(100 * common >= percent * (F.size("a") + F.size("b") - common)).select(
        F.col("node").alias("u"), F.col("leader").alias("v")), "links")
    stars = components(links)

    # Buckets that still hold several components.
    labelled = buckets.join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "key", "band", "node", F.coalesce("root", "node").alias("label"), "n", "blocks")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    side = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cell = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least("side", o).cast("long") * F.col("blocks") + F.greatest("side", o))
    members = labelled.join(mixed, "key", "left_semi").withColumn("side", side).withColumn("cell", F.explode(cell)).join(
        chosen.select("node", "sketch", "keys"), "node").select("key", "cell", "band", "node", "label", "n", "side", "sketch", "keys")
    dealt = members.repartition(F.col("key"), F.col("cell")).sortWithinPartitions("key", "cell", "node")
    seeking = written(dealt.mapInArrow(_flags(percent, threshold), _MEMBER), "seeking")
    dealt = seeking.join(sets, "node").select(*members.columns, "own").repartition(F.col("key"), F.col("cell")).sortWithinPartitions("key", "cell", "node")
    joined = dealt.mapInArrow(_forests(percent, threshold), "u bigint, v bigint")
    stars = components(links.unionByName(joined))

    rooted = folded.join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "digest", "first", F.coalesce("root", "node").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("head")), "root").select("digest", "head")
    return prints.select("uid", "id", "digest", "n").join(named, "digest").select(
        "uid", F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("head.id").alias("component_id"),
        (F.col("uid") == F.col("head.uid")).alias("kept"))


SQL = """
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
                                               else list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) end)) as g from w),
z as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as u, b.doc_id as v, count(*) as common from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select u, v from c join z x on u = x.doc_id join z y on v = y.doc_id where 100 * common >= 80 * (x.n + y.n - common)),
r as (select u, v from e union select r.u, e.v from r join e on r.v = e.u)
select w.doc_id, coalesce(any_value(z.n), 0)::bigint as n_shingles, least(w.doc_id, coalesce(min(r.v), w.doc_id)) as component_id,
       w.doc_id <= coalesce(min(r.v), w.doc_id) as kept
from w left join z using (doc_id) left join r on r.u = w.doc_id group by w.doc_id
"""


@query("op11_minmax_dedup", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


travels(__name__)
