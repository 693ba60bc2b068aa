"""Operator 11: group spelling variants, words one letter apart, by Bloom-guided neighbourhoods.

The vocabulary is counted over all documents. Of every word all deletions of a letter and all replacements by a later
letter are generated (an insertion is a deletion seen from the other word, a replacement by an earlier letter likewise),
as digests only, which one edit changes by a term; no edited string is built. The digests are probed against blocked Bloom
filters of the vocabulary, sharded by word length, that every executor holds. Only positives shuffle, to a join with the
vocabulary that is exact: it compares the words themselves, so false positives go and no pair is lost.

Filters are broadcast in rounds of at most ``FILTER_BYTES``: a round holds the shards of some lengths, or a part of one
length's digests where its shard alone is larger. The number of rounds grows with the vocabulary, the broadcast does not.

A word's form is its near word of most occurrences (of equal ones the smallest by code points), if that has at least
``ratio`` times the word's own; its root is where following forms ends. Forms are followed by doubling: a chain's counts
grow by the ratio with every step, so that a handful of rounds suffices.

Defined results. Null text: no words. Null id: the empty text in place of the id in the checksum that alters words.
Repeated rows count each. Texts and words of any length: texts are cut between words into pieces, a word's edits are
probed in slices. Words that are equally near and frequent: the smallest. Empty tables give empty results; further columns
are ignored by ``variants`` and kept by ``respelled``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import texts as T
from tidemark.session import TidemarkError, written

MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
#: Bound of the filters that a round broadcasts.
FILTER_BYTES = 16 << 20
#: Bits of filter per word: about one in a thousand edits is a false positive.
BITS = 16
#: A block has eight lanes of 32 bits; a word sets one bit in each.
LANES = 8
#: Lengths from here on share as many shards.
LONG = 64
#: A task hands on its counts when it holds so many words.
HELD_WORDS = 200_000
SLICE = 1 << 16
CHUNK = 1 << 20
LETTERS = "A-Za-z\u00C0-\u00FF"
RUN, BREAK = re.compile(f"[{LETTERS}]+"), re.compile(f"[^{LETTERS}]")
_LONG_RUN = re.compile(f"[{LETTERS}]{{{MIN_LETTERS},}}")
ALPHABET = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint8)

_rng = np.random.default_rng(311)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _rng.integers(1, 2**31, LANES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


# -- vocabulary -------------------------------------------------------------------------------------


def words_of(text: str) -> Counter[str]:
    """Runs of letters that are long enough, A-Z lower-cased, with their counts."""
    text = text.encode().lower().decode()  # bytes have ASCII letters only
    counts: Counter[str] = Counter()
    at = 0
    while at < len(text):
        gap = BREAK.search(text, at + CHUNK) if at + CHUNK < len(text) else None
        stop = gap.start() if gap else len(text)
        counts.update(_LONG_RUN.findall(text, at, stop))
        at = stop
    return counts


def altered(word: str, prefix: int, divisor: int) -> str:
    """The word without one letter where its checksum, begun with that of ``<doc_id>:``, is a multiple of the divisor."""
    h = zlib.crc32(word.encode(), prefix)
    if h % divisor:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def vocabulary(documents: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, divisor: int | None = None) -> DataFrame:
    """Words of enough letters and occurrences with their counts (word, n), over all documents.

    With a divisor, some occurrences lose a letter first (see ``altered``).
    """
    if min_letters < MIN_LETTERS:
        raise TidemarkError(f"words have at least {MIN_LETTERS} letters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words_of(text or "")
                if divisor is not None:
                    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    changed: Counter[str] = Counter()
                    for word, n in found.items():
                        changed[altered(word, prefix, divisor)] += n
                    found = changed
                for word, n in found.items():
                    if len(word) >= min_letters:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield flush()
        if held:
            yield flush()

    counted = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# -- digests ----------------------------------------------------------------------------------------


def as_letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all words, a byte each, and the words' bounds (one more than words)."""
    data = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


def polynomials(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the letters' values times powers of the base before every place, and each word's whole polynomial."""
    up, down = T.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[:len(data)], out=total[1:])
    return total, (total[bounds[1:]] - total[bounds[:-1]]) * down[bounds[:-1]]


def finished(polynomial: np.ndarray, letters: np.ndarray | int) -> np.ndarray:
    return T.mix(polynomial + np.asarray(letters).astype(np.uint64))


def digests(words: list[str]) -> np.ndarray:
    data, bounds = as_letters(words)
    return finished(polynomials(data, bounds)[1], np.diff(bounds))


# -- filters ----------------------------------------------------------------------------------------


def shard_of(letters: np.ndarray) -> np.ndarray:
    return np.where(letters < LONG, letters, LONG + letters % LONG)


@dataclass(frozen=True)
class Slot:
    """Where a part of a shard lies: the first block and the number of blocks in its round's array."""

    part: int
    parts: int
    first: int
    blocks: int


@dataclass
class Round:
    slots: dict[int, Slot] = field(default_factory=dict)
    blocks: int = 0


def plan_rounds(sizes: dict[int, int], filter_bytes: int = FILTER_BYTES) -> list[Round]:
    """Deal the shards (words each) to rounds whose blocks fit the bound; a shard that does not fit alone comes in parts."""
    most = max(1, filter_bytes // (4 * LANES))
    rounds: list[Round] = []
    for shard, words in sorted(sizes.items()):
        need = max(1, -(-words * BITS // (32 * LANES)))
        parts = -(-need // most)
        blocks = -(-need // parts)
        for part in range(parts):
            if not rounds or rounds[-1].blocks + blocks > most or shard in rounds[-1].slots:
                rounds.append(Round())
            now = rounds[-1]
            now.slots[shard] = Slot(part, parts, now.blocks, blocks)
            now.blocks += blocks
    return rounds


def part_of(digest: np.ndarray, parts: int) -> np.ndarray:
    return (digest * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(40)) % np.uint64(parts)


def block_of(digest: np.ndarray, slot: Slot) -> np.ndarray:
    return (slot.first + ((digest >> np.uint64(32)) * np.uint64(slot.blocks) >> np.uint64(32))).astype(np.int64)


def lane_bits(digest: np.ndarray, lane: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.uint32(1) << ((digest & np.uint64(0xFFFFFFFF)).astype(np.uint32) * _SALT[lane] >> np.uint32(27))


def probed(digest: np.ndarray, slot: Slot, lanes: np.ndarray) -> np.ndarray:
    """Positions of the digests that the filter may hold."""
    at = np.arange(len(digest)) if slot.parts == 1 else np.flatnonzero(part_of(digest, slot.parts) == np.uint64(slot.part))
    for lane in range(LANES):
        part = digest[at]
        at = at[lanes[block_of(part, slot), lane] & lane_bits(part, lane) != 0]
    return at


def build_filters(words: DataFrame, rounds: list[Round]) -> DataFrame:
    """Blocks of all rounds' filters (round, block, four longs of two lanes each), united by bitwise or."""
    names = ["round", "block", *[f"b{i}" for i in range(LANES // 2)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, shard = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for number, now in enumerate(rounds):
                for key, slot in now.slots.items():
                    mine = digest[shard == key]
                    mine = mine[part_of(mine, slot.parts) == np.uint64(slot.part)]
                    if not len(mine):
                        continue
                    bits = [lane_bits(mine, i).astype(np.uint64) for i in range(LANES)]
                    pairs = [pa.array((bits[i] | bits[i + 1] << np.uint64(32)).view(np.int64)) for i in range(0, LANES, 2)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), number, np.int64)), pa.array(block_of(mine, slot)), *pairs], names)

    rows = words.select("digest", "shard").mapInArrow(run, ", ".join(f"{n} long" for n in names))
    return rows.groupBy("round", "block").agg(*[F.bit_or(n).alias(n) for n in names[2:]])


def round_filter(blocks: DataFrame, number: int, now: Round) -> np.ndarray:
    """The lanes of one round's filter, of bounded size, on the driver."""
    got = blocks.where(F.col("round") == number).drop("round").toArrow()
    lanes = np.zeros((now.blocks, LANES // 2), np.int64)
    for i in range(LANES // 2):
        lanes[got.column(0).to_numpy(), i] = got.column(i + 1).to_numpy()
    return lanes.view(np.uint32)


# -- neighbours -------------------------------------------------------------------------------------


def positives(words: list[str], now: Round, lanes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of words, and digests of their edits that the round's filter may hold: each near pair's from one of its words."""
    data, bounds = as_letters(words)
    total, whole = polynomials(data, bounds)
    up, down = T.powers(len(data) + 2)
    sizes = np.diff(bounds)
    for size in np.unique(sizes):
        same = np.flatnonzero(sizes == size)
        shorter, equal = (now.slots.get(int(shard_of(np.array(n)))) for n in (size - 1, size))
        for low in range(0, len(same) * size, SLICE):
            flat = np.arange(low, min(low + SLICE, len(same) * size))
            word, place = same[flat // size], flat % size
            at = bounds[word] + place
            letter = data[at]
            if shorter is not None:
                # Of equal letters side by side only the first is deleted.
                kept = (place == 0) | (letter != data[np.maximum(at - 1, 0)])
                before = (total[at] - total[bounds[word]]) * down[bounds[word]]
                after = (total[bounds[word + 1]] - total[at + 1]) * down[bounds[word] + 1]
                digest = finished(before + after, size - 1)[kept]
                hit = probed(digest, shorter, lanes)
                yield word[kept][hit], digest[hit]
            if equal is not None:
                power = up[place]
                rest = whole[word] - _VALUE[letter] * power + np.uint64(size)
                for c in ALPHABET:
                    later = np.flatnonzero(letter < c)
                    digest = T.mix(rest[later] + _VALUE[c] * power[later])
                    hit = probed(digest, equal, lanes)
                    if len(hit):
                        yield word[later[hit]], digest[hit]


def near_pairs(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """All pairs of words one letter apart, once each (a, n_a, b, n_b), from a written vocabulary (word, n, digest, shard)."""
    spark = words.sparkSession
    sizes = {r["shard"]: r["count"] for r in words.groupBy("shard").count().collect()}  # at most 2 * LONG rows
    rounds = plan_rounds(sizes, filter_bytes)
    blocks = written(build_filters(words, rounds), "filters")
    found = None
    for number, now in enumerate(rounds):
        lanes = spark.sparkContext.broadcast(round_filter(blocks, number, now))

        def run(batches: Iterator[pa.RecordBatch], now: Round = now, lanes=lanes) -> Iterator[pa.RecordBatch]:
            for batch in T.pieces(batches, "word"):
                own = batch.column(1).to_numpy()
                for word, digest in positives(batch.column(0).to_pylist(), now, lanes.value):
                    yield pa.RecordBatch.from_arrays([pa.array(own[word]), pa.array(digest.view(np.int64))], ["a", "b"])

        part = words.select("word", "digest").mapInArrow(run, "a long, b long")
        found = part if found is None else found.unionByName(part)
    known = words.select("digest", "word", "n")
    if found is None:
        return known.selectExpr("word as a", "n as n_a", "word as b", "n as n_b").where("false")
    found = written(found, "positives")
    pairs = found.join(known.toDF("b", "other", "n_b"), "b").join(known.toDF("a", "word", "n_a"), "a")
    return pairs.where(F.levenshtein("word", "other", 1) == 1).select(F.col("word").alias("a"), "n_a", F.col("other").alias("b"), "n_b")


# -- forms ------------------------------------------------------------------------------------------


def with_digests(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.pieces(batches, "word"):
            texts = batch.column(0).to_pylist()
            shards = shard_of(np.array([len(w) for w in texts], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests(texts).view(np.int64)), pa.array(shards)],
                                             ["word", "n", "digest", "shard"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, digest long, shard long")


def roots(forms: DataFrame) -> DataFrame:
    """Where following forms ends, for words that have a form: (word, root). Every round doubles the steps taken."""
    jump = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = jump.join(step, "root", "left")
        if joined.where("next is not null").isEmpty():
            return jump
        jump = written(joined.select("word", F.coalesce("next", "root").alias("root")), "roots")


def group(words: DataFrame, ratio: int = RATIO, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of a vocabulary (word, n)."""
    words = written(with_digests(words), "vocabulary")
    pairs = near_pairs(words, filter_bytes)
    ways = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")),
                             F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n"))))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other")))
    near = pairs.select(ways.alias("way")).select("way.*").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    out = words.select("word", "n").join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.other")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n"))
    out = written(out, "forms")
    return out.join(roots(out.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(documents: DataFrame, divisor: int | None = None, ratio: int = RATIO) -> DataFrame:
    """The grouped words of the documents; with a divisor of words some of which lost a letter (see ``altered``)."""
    return group(vocabulary(documents, divisor=divisor), ratio).select("word", "form", "root", "n", "n_near", "form_n")


def respelled(documents: DataFrame, groups: DataFrame) -> DataFrame:
    """Per document the words that have another root with their roots and counts: the columns and ``spellings``.

    ``spellings`` is an array of (word, root, n) by word, empty where a text has none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.pieces(batches):
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words_of(text or "")
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(found), pa.int64()), pa.array(found.keys(), pa.string()),
                                                      pa.array(found.values(), pa.int64())], ["__row", "word", "n"])

    numbered = written(documents.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    used = numbered.select("__row", "text").mapInArrow(run, "__row long, word string, n long")
    moved = groups.where("root != word").select("word", "root")
    found = used.join(moved, "word").groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("word", "root", "n"))).alias("spellings"))
    none = F.array().cast("array<struct<word:string,root:string,n:bigint>>")
    return numbered.join(found, "__row", "left").withColumn("spellings", F.coalesce("spellings", none)).select(*documents.columns, "spellings")
