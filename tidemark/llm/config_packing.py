"""Operator 7: documents as token sequences of at most ``capacity``, by a configuration linear program.

Tokens come from a public tokenizer, whole text by whole text, with a separator id at the end of each document. Longer
documents are cut at the capacity. Pieces are counted by length; that histogram is the only thing that reaches the driver and
has ``capacity`` rows at most. Its configuration program asks how often to use each way of filling one sequence so that every
length is covered. Multiplicative weights solve it: a length's price starts in proportion to its size and falls exponentially
with the share of its pieces that is covered; a knapsack dynamic program finds the filling of highest price, which then enters
the fractional solution in proportion to what is left of its scarcest length. The same prices, divided by the value of the best
filling, are a solution of the dual program and so a lower bound on the number of sequences (``Plan.bound``, the best one met). The fractional
solution is rounded down, then up by largest remainders where the pieces last, and the rest is filled by decreasing size.

Pieces then take the slots of their length by rank. Ranks come from counts of (length, salt) groups, so one length that
many documents share is spread over tasks; offsets add the true lengths within a sequence.

Defined results. Null or empty text: the separator alone. Null ids and repeated rows: packed each. Empty table: no rows.
Further columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm import texts as T
from tidemark.session import settle

CAPACITY, SEPARATOR = 4096, 1
#: Prices start a little above proportion to size: what is large is harder to place, and small pieces are kept for gaps.
STEEPNESS = 1.3
_CACHED = 600_000
# How the tokenizer cuts a lower-cased text of Latin-1 characters: letters, single digits, contractions, other signs.
_LETTERS, _DIGITS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
_PARTS = re.compile(rf"[{_LETTERS}]+|[{_DIGITS}]|'(?:s|t|re|ve|m|ll|d)|[^\s{_LETTERS}{_DIGITS}]+")


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, with remembered parts.

    The tokenizer encodes every part that it cuts a text into by itself. Texts of Latin-1 characters are cut here and their
    parts looked up; others are cut at white space, which the tokenizer drops and never joins across. Texts with control
    characters that Python alone counts as spaces go to the tokenizer as they are.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def _direct(self, texts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", c.ids).tobytes() for c in coded]

    def encode(self, text: str) -> bytes:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self._direct([text])[0]
        if "<|" not in text and (text.isascii() or ord(max(text)) < 256):
            parts = _PARTS.findall(text.lower())
        else:
            parts = text.split()
        known = self.known
        if missing := [p for p in set(parts) if p not in known]:
            known.update(zip(missing, self._direct(missing), strict=True))
        out = b"".join(map(known.__getitem__, parts))
        if len(known) > _CACHED:
            known.clear()
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_pieces(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer), np.array([SEPARATOR], "<u4").tobytes()
        for batch in T.pieces(batches):
            columns: list[list] = [[] for _ in range(5)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(coder.encode(text or "") + end)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    for column, value in zip(columns, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Plan:
    """For each length the slots in order: first rank, first sequence and slots per sequence of every configuration."""

    sequences: int = 0
    bound: float = 0.0
    slots: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)
    taken: dict[int, int] = field(default_factory=dict)

    def use(self, configuration: dict[int, int], times: int) -> None:
        for size, count in configuration.items():
            rank = self.taken.get(size, 0)
            self.slots.setdefault(size, []).append((rank, self.sequences, count))
            self.taken[size] = rank + times * count
        self.sequences += times


def best_configuration(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[dict[int, int], float]:
    """The unbounded knapsack: which of the rising sizes fill the room at the highest total value, and that value."""
    worth = np.full(room + 1, -np.inf)
    worth[sizes] = value
    # best[c - s] for s = 1, 2, ... lies in one piece when best is kept from the end: mirrored[room - c] is best[c].
    mirrored, pick, gain = np.zeros(room + 1), np.zeros(room + 1, np.int64), np.empty(room + 1)
    for c in range(1, room + 1):
        np.add(mirrored[room - c + 1:], worth[1:c + 1], out=gain[:c])
        k = int(gain[:c].argmax())
        before = mirrored[room - c + 1]
        mirrored[room - c], pick[c] = (gain[k], k + 1) if gain[k] > before else (before, 0)
    out: dict[int, int] = {}
    c = room
    while c > 0:
        if not pick[c]:
            c -= 1
            continue
        size = int(pick[c])
        out[size] = out.get(size, 0) + 1
        c -= size
    return out, float(mirrored[0])


def threshold_bound(sizes: np.ndarray, need: np.ndarray, room: int) -> float:
    """The best of the dual solutions that price a length at 1 above ``room - k``, at its share of the room from k on, else at 0."""
    if not len(sizes):
        return 0.0
    tokens, pieces = np.zeros(room + 2), np.zeros(room + 2)
    tokens[sizes], pieces[sizes] = sizes * need, need
    tokens, pieces = np.cumsum(tokens[::-1])[::-1], np.cumsum(pieces[::-1])[::-1]  # of this length and above
    k = np.arange(room // 2 + 1)
    above = room - k + 1
    return float((pieces[above] + (tokens[k] - tokens[above]) / room).max())


def fractional_solution(counts: dict[int, int], room: int, rounds: int = 300, share: float = 0.5, strength: float = 1.0,
                        near: float = 0.97, tail: float = 0.002) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Fillings with how often each is used, covering the counts but for a tail, and the best dual bound that was met.

    Fillings are sought among lengths with many pieces left first, so that one rare length does not make every step small; when
    these give less than ``near`` of the value of the best filling of all, the limit is halved. It ends when a ``tail`` of the
    tokens is left, at single pieces, or after ``rounds`` prices; what is left then is packed in rounding.
    """
    sizes = np.array(sorted(counts), np.int64)
    need = np.array([counts[int(s)] for s in sizes], float)
    left, total = need.copy(), float(sizes @ need)
    bound, used = threshold_bound(sizes, need, room), {}
    level, whole = left.max(initial=0.0), np.inf
    for _ in range(rounds):
        if sizes @ left <= tail * total or level < 1:
            break
        price = (sizes / room) ** STEEPNESS * np.exp(-strength * (1 - left / need))
        fresh = False
        while level >= 1:
            allowed = left >= level
            if allowed.any():
                configuration, value = best_configuration(price[allowed], sizes[allowed], room)
                at = np.searchsorted(sizes, list(configuration))
                most = float((left[at] / list(configuration.values())).min())
                if value < near * whole and not fresh:
                    # Prices only fall, so an earlier value of the best filling of all stays an upper bound until it is too high.
                    whole, fresh = value if allowed.all() else best_configuration(price, sizes, room)[1], True
                    bound = max(bound, float(need @ price) / whole)
                if value >= near * whole and most >= 1:
                    break
            level /= 2
        else:
            break
        times = max(1.0, share * most)
        key = tuple(configuration.items())
        used[key] = used.get(key, 0.0) + times
        left[at] -= times * np.array(list(configuration.values()))
    return [(dict(k), x) for k, x in used.items()], bound


def plan_sequences(counts: dict[int, int], room: int, rounds: int = 300) -> Plan:
    """Configurations for all pieces: ``counts`` of pieces by length, and the lower bound on the number of sequences."""
    plan, left = Plan(), {s: n for s, n in sorted(counts.items()) if n}
    if room in left:  # full sequences already
        plan.use({room: 1}, left.pop(room))
    full = plan.sequences
    solution, bound = fractional_solution(left, room, rounds)
    plan.bound = full + bound

    def take(configuration: dict[int, int], times: int) -> None:
        times = min([times, *(left.get(s, 0) // n for s, n in configuration.items())])
        if times > 0:
            plan.use(configuration, times)
            for s, n in configuration.items():
                left[s] -= times * n
                if not left[s]:
                    del left[s]

    for configuration, x in solution:
        take(configuration, int(x))
    for configuration, _ in sorted(solution, key=lambda c: c[1] - int(c[1]), reverse=True):
        take(configuration, 1)
    while left:
        take(*_decreasing(left, room))
    return plan


def _decreasing(left: dict[int, int], room: int) -> tuple[dict[int, int], int]:
    """The filling that takes the largest sizes first, and how often its pieces last."""
    out, free = {}, room
    for size in sorted(left, reverse=True):
        if n := min(free // size, left[size]):
            out[size] = n
            free -= n * size
    return out, min(left[s] // n for s, n in out.items())


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """The pieces with sequence_id and offset."""
    pieces = settle(token_pieces(documents, capacity, tokenizer))
    total = pieces.count()
    salts = max(16, total // 20_000)
    classed = (pieces.withColumn("class", F.col("length").cast("int"))
               .withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts))))
    groups = classed.groupBy("class", "salt").agg(F.count("*").alias("n"))
    histogram = {r["class"]: r["n"] for r in groups.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = plan_sequences(histogram, capacity)
    slots = {size: np.array(rows, np.int64) for size, rows in plan.slots.items()}

    before = F.sum("n").over(Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    first = groups.select("class", "salt", F.coalesce(before, F.lit(0)).alias("first"))
    place = Window.partitionBy("class", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (classed.withColumn("rank", F.row_number().over(place)).join(first, ["class", "salt"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", "class", (F.col("first") + F.col("rank") - 1).alias("rank")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (np.asarray(batch.column(k), np.int64) for k in (5, 6))
            sequence = np.empty(len(batch), np.int64)
            for s in np.unique(size):
                mine = size == s
                row = slots[int(s)][np.searchsorted(slots[int(s)][:, 0], rank[mine], side="right") - 1]
                sequence[mine] = row[:, 1] + (rank[mine] - row[:, 0]) // row[:, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long"
    within = (Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece", "start", "ids_crc32")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.mapInArrow(run, schema).withColumn("offset", F.sum("length").over(within) - F.col("length"))
