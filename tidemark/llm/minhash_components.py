"""Operator 9: near-duplicate documents by MinHash, confirmed on full shingle sets, as connected components.

A document's set holds its distinct shingles of five words. 160 universal hash functions give 160 minima; 32 bands of
five of them choose candidates: a pair at similarity 0.85 shares no band with a probability below one in 10**8, one at
0.8, the pipeline's limit, with three in 10**6.
Candidates must then agree in enough of all minima (signature verification, far below the limit), and last
the similarity is confirmed on the full sets. Components come from alternating large-star and small-star steps.

Not all pairs of a bucket are emitted. Documents with equal sets collapse to their smallest id. Then each bucket's members
are paired with one centre, the member that meets most others, and a last round pairs only members of one bucket that are
still in different components and that no bound on their similarity rules out. So every candidate pair that can reach the limit is confirmed or inside one
component, which is what components need.

The digests of shingles have 64 bits. Intermediate tables are written to the shared folder, so a lost executor costs a
recomputation of its tasks only.

Defined results. Null or empty text, or spaces only: no shingles, a component of its own. Fewer than five words: the
whole sequence is the one shingle. Null ids: no links, component null, kept. Repeated ids: all their rows are one
document for linking. Empty tables give an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import texts as T
from tidemark.session import settle, written

BANDS, ROWS = 32, 5
MINIMA = BANDS * ROWS
_FACTORS = np.random.default_rng(9).integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = np.random.default_rng(10).integers(0, 2**63, MINIMA, dtype=np.uint64)
_CHAIN = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(column: pa.Array, words: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle digests of each row."""
    digests, bounds = T.word_digests(column)
    n = len(digests)
    long = np.zeros(n, np.uint64)
    if n >= words:
        acc = digests[:n - words + 1].copy()
        for k in range(1, words):
            acc = T.mix(acc * _CHAIN + digests[k:n - words + 1 + k])
        long[:len(acc)] = acc
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(long[a:b - words + 1]))
        elif b > a:
            acc = digests[a:a + 1] + np.uint64(b - a)
            for k in range(a + 1, b):
                acc = T.mix(acc * _CHAIN + digests[k:k + 1])
            out.append(acc)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of non-empty sets, one row each."""
    sizes = np.array([len(s) for s in sets])
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.empty((len(sets), MINIMA), np.uint64)
    # Blocks of whole sets of about a megabyte stay in the processor's cache for all functions.
    edges = [0]
    for i in range(1, len(sets) + 1):
        if i == len(sets) or starts[i] - starts[edges[-1]] >= 1 << 16:
            edges.append(i)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = flat[starts[a]:starts[b] if b < len(sets) else len(flat)]
        at = starts[a:b] - starts[a]
        for k in range(MINIMA):
            out[a:b, k] = np.minimum.reduceat(part * _FACTORS[k] + _SHIFTS[k], at)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(minima), BANDS))
    for k in range(ROWS):
        acc = T.mix(acc * _CHAIN + minima[:, k::ROWS])
    return acc


#: So many ids at most are sent to every task (some megabytes); beyond that the texts are shuffled.
BROADCAST_IDS = 500_000
#: Buckets above this size are paired under bounds only.
LARGE_BUCKET = 16


def of_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is among the distinct ids (a settled table)."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def without_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is not among the distinct ids; rows without an id stay."""
    ids = settle(ids)
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti")


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def sketches(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the whole set, 16 bits of each minimum, and band keys (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.pieces(batches):
            sets = shingle_sets(batch.column(1))
            sizes = np.array([len(s) for s in sets])
            some = np.flatnonzero(sizes)
            minima = signatures([sets[i] for i in some]) if len(some) else np.zeros((0, MINIMA), np.uint64)
            whole = [np.zeros(len(sets), np.uint64) for _ in range(2)]
            for i in some:
                whole[0][i] = T.mix(sets[i]).sum()
                whole[1][i] = T.mix(sets[i] ^ _CHAIN).sum()
            filled = sizes > 0
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(whole[0].view(np.int64)), pa.array(whole[1].view(np.int64)),
                pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(2 * MINIMA), len(sets), [None, pa.py_buffer(_spread(minima, filled).tobytes())]).cast(pa.binary()),
                _lists(band_keys(minima).view(np.int64).ravel(), np.where(filled, BANDS, 0), pa.int64()),
            ], ["doc_id", "n_shingles", "set_low", "set_high", "minima", "bands"])

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, set_low long, set_high long, minima binary, bands array<long>")


def _spread(minima: np.ndarray, filled: np.ndarray) -> np.ndarray:
    out = np.zeros((len(filled), MINIMA), np.uint16)
    out[filled] = (minima >> np.uint64(20)).astype(np.uint16)
    return out


def full_sets(documents: DataFrame) -> DataFrame:
    """doc_id and all its shingle digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.pieces(batches):
            sets = shingle_sets(batch.column(1))
            values = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(values, np.array([len(s) for s in sets]), pa.int64())],
                                             ["doc_id", "shingles"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest reachable id for every id that occurs in the edges (columns a, b), by large-star and small-star."""
    stars = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    before = None
    for _ in range(most_rounds):
        # Large star: larger neighbours of every id move to its smallest neighbour (itself included).
        both = stars.union(stars.select("b", "a")).toDF("node", "near")
        least = both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("least"))
        large = (both.where("near > node").join(least, "node")
                 .select(F.col("near").alias("a"), F.col("least").alias("b")).distinct())
        # Small star: smaller neighbours of every id, and the id, move to its smallest neighbour.
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        joined = large.join(least, "a")
        stars = settle(joined.select(F.col("b").alias("a"), F.col("least").alias("b")).where("a != b")
                       .union(least.select("a", F.col("least").alias("b"))).distinct())
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return stars.select(F.col("a").alias("doc_id"), F.col("b").alias("component_id"))
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def agreement(pairs: DataFrame, sketch: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose minima agree in at least the given share."""
    known = sketch.select("doc_id", "minima")
    wide = (pairs.join(known.toDF("a", "minima_a"), "a").join(known.toDF("b", "minima_b"), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, MINIMA) for k in (2, 3))
            near = (left == right).mean(1) >= least
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near))

    return wide.select("a", "b", "minima_a", "minima_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity: 100 * intersection >= percent * union."""
    inter = F.size(F.array_intersect("shingles_a", "shingles_b"))
    union = F.size("shingles_a") + F.size("shingles_b") - inter
    return (pairs.join(sets.toDF("b", "shingles_b"), "b").join(sets.toDF("a", "shingles_a"), "a")
            .where(100 * inter >= percent * union).select("a", "b").distinct())


def components(documents: DataFrame, percent: int = 85, agree: float = 0.15) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of the documents."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = written(sketches(documents), "sketch")
    # Equal sets: every document is linked with the smallest id of its set.
    filled = sketch.where("n_shingles > 0 and doc_id is not null")
    first = filled.groupBy("set_low", "set_high").agg(F.min("doc_id").alias("first"))
    copies = filled.select("doc_id", "set_low", "set_high").join(first, ["set_low", "set_high"]).where("doc_id != first")
    copies = settle(copies.select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct())

    # One document stands for each set. An id with several rows may stand for several; their places are its own.
    places = filled.join(first.select(F.col("first").alias("doc_id"), "set_low", "set_high"), ["doc_id", "set_low", "set_high"], "left_semi")
    slots = (places.select("doc_id", "n_shingles", F.posexplode("bands").alias("band", "key")).distinct())
    shared = slots.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    slots = settle(slots.join(shared, "key"))  # places in buckets of two members and more
    ids = settle(slots.select("doc_id").distinct())
    minima = written(of_ids(filled.select("doc_id", "minima", "bands"), ids).distinct(), "minima")
    sets = written(full_sets(of_ids(documents, ids)), "sets")
    edges = settle(_checked(_star_pairs(slots), minima, sets, percent, agree))
    labels = connected(edges)
    # The last pairs depend on the components that the stars have joined.
    more = settle(_checked(_remaining_pairs(slots, labels, minima, sets, percent), minima, sets, percent, agree))
    edges = edges.union(more)
    found = connected(edges.union(copies))
    return (sketch.select("doc_id", "n_shingles").join(found, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def _sized(pairs: DataFrame, percent: int) -> DataFrame:
    """Sets whose sizes differ too much cannot reach the similarity."""
    return pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))


def _checked(pairs: DataFrame, minima: DataFrame, sets: DataFrame, percent: int, agree: float) -> DataFrame:
    pairs = _sized(pairs, percent).select("a", "b").distinct()
    likely = settle(agreement(pairs, minima, percent / 100 - agree))
    return confirmed(likely, sets, percent)


def _star_pairs(slots: DataFrame) -> DataFrame:
    """Each bucket's members with the member that shares buckets with most others (ties: the smaller id)."""
    meets = slots.groupBy("doc_id").agg(F.sum("members").alias("meets"))
    known = settle(slots.select("doc_id", "n_shingles", "key").join(meets, "doc_id"))
    most = known.groupBy("key").agg(F.max("meets").alias("meets"))
    centre = known.join(most, ["key", "meets"]).groupBy("key").agg(F.min("doc_id").alias("b"))
    centre = centre.join(known.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), "key"), ["key", "b"])
    return (known.join(centre, "key").where("doc_id != b")
            .select(F.greatest("doc_id", "b").alias("a"), F.least("doc_id", "b").alias("b"),
                    F.col("n_shingles").alias("n_a"), "n_b"))


def _split_buckets(slots: DataFrame, labels: DataFrame) -> DataFrame:
    """Places in buckets whose members are in different components, with the component and the smallest set."""
    named = slots.join(labels, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    range_ = named.groupBy("key").agg(F.min("component_id").alias("low"), F.max("component_id").alias("high"),
                                      F.min("n_shingles").alias("least"))
    return named.join(range_.where("low < high"), "key")


def _remaining_pairs(slots: DataFrame, labels: DataFrame, minima: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket that are still in different components and that no bound rules out.

    Small buckets give all their pairs. In large ones, a shingle that no other document of these buckets has cannot be
    shared, so with u such shingles of n a document shares at most n - u, and its similarity to a set of m is at most
    (n - u) / (m + u). The bound on the bucket's smallest set takes whole documents out before the join. Within the join
    the bound is on the pair, and once more with shingles of up to three documents counted as unshared, unless the two
    have one of these in common. A pair comes from its first common band only.
    """
    split = settle(_split_buckets(slots, labels))
    small, large = split.where(F.col("members") <= LARGE_BUCKET), split.where(F.col("members") > LARGE_BUCKET)
    left = small.select("key", F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("component_id").alias("c_a"))
    right = small.select("key", F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("component_id").alias("c_b"))
    pairs = left.join(right, "key").where("a > b and c_a != c_b").select("a", "b", "n_a", "n_b")
    if large.isEmpty():
        return pairs

    ids = settle(large.select("doc_id").distinct())
    held = (of_ids(sets, ids).select("doc_id", F.explode("shingles").alias("shingle")).groupBy("shingle")
            .agg(F.count("*").alias("n"), F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), F.bit_xor("doc_id").alias("all"))
            .where("n <= 3"))
    # The third of three ids is what the exclusive or has beside the smallest and the largest.
    holders = F.expr("case n when 1 then array(x) when 2 then array(x, y) else array(x, y, all ^ x ^ y) end")
    rare = (held.select("shingle", "n", F.explode(holders).alias("doc_id")).groupBy("doc_id")
            .agg(F.count(F.when(F.col("n") == 1, 1)).alias("lone"), F.count("*").alias("rare"),
                 F.collect_list(F.when(F.col("n") > 1, F.col("shingle"))).alias("few"))
            .withColumn("few", F.when(F.size("few") <= 64, F.col("few"))))  # without a list, the second bound does not apply
    able = (large.join(rare, "doc_id", "left").withColumns({
        "lone": F.coalesce("lone", F.lit(0)), "few": F.when(F.col("rare").isNull(), F.expr("cast(array() as array<bigint>)")).otherwise(F.col("few")),
        "rare": F.coalesce("rare", F.lit(0))})
        .where(F.expr(f"100 * (n_shingles - lone) >= {percent} * (greatest(least, {percent} * n_shingles div 100) + lone)"))
        .join(minima.select("doc_id", "bands"), "doc_id"))
    able = settle(able.select("key", "doc_id", "n_shingles", "lone", "rare", "few", "component_id", F.slice("bands", 1, F.col("band")).alias("earlier")))
    names = ("n", "lone", "rare", "few", "c", "earlier")
    left, right = (able.toDF("key", side, *(f"{n}_{side}" for n in names)) for side in "ab")
    most, less = "least(n_a - lone_a, n_b - lone_b)", "least(n_a - rare_a, n_b - rare_b)"
    return pairs.union(left.join(right, "key").where(
        f"a > b and c_a != c_b and 100 * {most} >= {percent} * (n_a + n_b - {most})"
        f" and (100 * {less} >= {percent} * (n_a + n_b - {less}) or few_a is null or few_b is null or arrays_overlap(few_a, few_b))"
        " and not arrays_overlap(earlier_a, earlier_b)").select("a", "b", "n_a", "n_b"))
