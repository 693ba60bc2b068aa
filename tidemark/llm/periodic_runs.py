"""Operator 12: find passages in which a group of words repeats at least four times, and collapse them to one round.

Seeds are word k-grams that occur twice in a document, extended along their diagonal (the lag between the two places).
A run of period q and length max(6, 4q) or more holds max(5, 3q) words and more that equal the word q later, so a k-gram
with k <= max(5, 3q) is guaranteed to stand twice on its diagonal. The k of the index grow as 5, 18, 57, ... (three times
the last, plus three); each is asked for the lags from a third of it up to itself, which together are all lags.

Of the occurrences of a k-gram only neighbours are paired, so that a k-gram with m occurrences makes m - 1 pairs and not
m * m. None is missed: were a k-gram of at least q words found again after d < q words within a run of smallest period q,
its first q words would be a power of a shorter word group, and the run would have a smaller period. For the same reason
every diagonal that is long enough has its lag as smallest period. For each lag a table holds the furthest word that an
extension has covered; seeds before it are not extended again.

Digests of k-grams only choose the seeds; extensions compare words.

Defined results. Null text: no words. Null id: the empty text in place of the decimal id where the test edit needs it.
Repeated rows: one result each. Very long texts: the work is proportional to words times the logarithm of the longest text
of a batch, all in one task, as a text is one row. Empty tables give empty results, further columns are ignored by ``runs``
and kept by ``collapsed``.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tidemark.llm import texts as T

MIN_LENGTH, MIN_ROUNDS = 6, 4
FIRST_K = MIN_LENGTH - 1
WORD = re.compile("[^\x20\x09-\x0D]+")
STEP = 512
RESULT = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
          "collapsed_sha256 string")


@dataclass(frozen=True)
class Run:
    """Words start to start + length, of which each equals the one a period later."""

    start: int
    length: int
    period: int


def digests_of(words: list[str]) -> np.ndarray:
    """One number per word, equal for equal words of this list."""
    number: dict[str, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def seeds(ids: np.ndarray, bounds: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First places and lags of neighbouring occurrences of a k-gram within a row, for the lags from the least up to k."""
    n = len(ids) - k + 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    up, down = T.powers(len(ids) + 1)
    total = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(T.mix(ids.astype(np.uint64) + np.uint64(1)) * up[:len(ids)], out=total[1:])
    row = np.searchsorted(bounds, np.arange(n), side="right")
    at = np.flatnonzero(bounds[row] - np.arange(n) >= k)
    grams = T.mix((total[at + k] - total[at]) * down[at] + T.mix(row[at].astype(np.uint64)))
    order = np.argsort(grams, kind="stable")
    first, second = at[order[:-1]], at[order[1:]]
    lag = second - first
    found = (grams[order[:-1]] == grams[order[1:]]) & (lag >= least) & (lag <= k)
    return first[found], lag[found]


def _equal_run(ids: np.ndarray, at: int, lag: int, way: int, stop: int) -> int:
    """How many words from a place on (or back from it) equal the word a lag later, up to a bound of places."""
    n = 0
    while n < stop:
        step = min(STEP, stop - n)
        low = at + n if way > 0 else at - n - step + 1
        same = ids[low:low + step] == ids[low + lag:low + lag + step]
        if not same.all():
            return n + int(np.argmin(same if way > 0 else same[::-1]))
        n += step
    return n


def runs_of(ids: np.ndarray, bounds: np.ndarray) -> list[list[Run]]:
    """Per row all runs, by start and then period. Bounds are the rows' ends within the words of all rows."""
    out: list[list[Run]] = [[] for _ in bounds]
    begins = np.concatenate([[0], bounds[:-1]])
    longest = int((bounds - begins).max(initial=0))
    k, least = FIRST_K, 1
    while max(MIN_LENGTH, MIN_ROUNDS * least) <= longest:
        places, lags = seeds(ids, bounds, k, least)
        order = np.lexsort((places, lags))
        covered: dict[int, int] = {}
        for place, lag in zip(places[order].tolist(), lags[order].tolist()):
            if place < covered.get(lag, -1):
                continue
            row = int(np.searchsorted(bounds, place, side="right"))
            begin, end = int(begins[row]), int(bounds[row])
            right = _equal_run(ids, place, lag, 1, end - lag - place)
            covered[lag] = place + right
            if not right:
                continue
            start = place - _equal_run(ids, place - 1, lag, -1, place - begin)
            length = place + right + lag - start
            if length >= max(MIN_LENGTH, MIN_ROUNDS * lag):
                out[row].append(Run(start - begin, length, lag))
        k, least = 3 * (k + 1), k + 1
    return [sorted(found, key=lambda r: (r.start, r.period)) for found in out]


def strongest(runs: list[Run]) -> Run | None:
    """The run of most rounds, compared as exact fractions; of equal ones the first, then the shortest period."""
    best = None
    for run in runs:
        if best is None or run.length * best.period > best.length * run.period:
            best = run
    return best


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which words no run drops: all but those after the first period of a run that holds them."""
    change = np.zeros(n + 1, np.int64)
    for run in runs:
        change[run.start + run.period] += 1
        change[run.start + run.length] -= 1
    return np.cumsum(change[:-1]) == 0


def repeated_tail(words: list[str], doc_id: int | None) -> list[str]:
    """The words, of which those of every tenth id, by its checksum, go round in circles from some place on."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _rows(batch: pa.RecordBatch, edited: bool) -> Iterator[tuple[int | None, list[str], list[Run]]]:
    ids = batch.column(0).to_pylist()
    words = [WORD.findall(t or "") for t in batch.column(1).to_pylist()]
    if edited:
        words = [repeated_tail(w, i) for i, w in zip(ids, words)]
    bounds = np.cumsum([len(w) for w in words])
    found = runs_of(digests_of([w for row in words for w in row]), bounds)
    yield from zip(ids, words, found)


def runs(documents: DataFrame, edited: bool = False) -> DataFrame:
    """Per document its number of runs, the strongest one, and digests of all runs and of the collapsed text.

    With ``edited``, every tenth document is given a repeated tail first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RESULT.split(", ")]
        for batch in T.pieces(batches):
            out = []
            for doc_id, words, found in _rows(batch, edited):
                best = strongest(found)
                listed = "".join(f"{r.start},{r.length},{r.period}\n" for r in found)
                kept = kept_words(len(words), found)
                text = " ".join([w for w, k in zip(words, kept.tolist()) if k])
                out.append((doc_id, len(found), *((None,) * 4 if best is None else (best.start, best.length, best.period, 1000 * best.length // best.period)),
                            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n.endswith("sha256") else pa.int64()) for n, c in zip(names, columns)], names)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RESULT)


def collapsed(documents: DataFrame) -> DataFrame:
    """The documents with every run cut to its first period, words then joined by one space; other texts stay as they are.

    The new column ``runs`` lists (start, length, period) in words of the old text.
    """
    kind = ArrayType(StructType([StructField(n, LongType()) for n in ("start", "length", "period")]))
    schema = StructType([StructField("text", StringType()), *documents.drop("text", "runs").schema.fields, StructField("runs", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in T.pieces(batches):
            texts, listed = batch.column(0).to_pylist(), []
            pair = pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int64()), batch.column(0)], ["doc_id", "text"])
            for i, (_, words, found) in enumerate(_rows(pair, False)):
                listed.append([{"start": r.start, "length": r.length, "period": r.period} for r in found])
                if found:
                    texts[i] = " ".join([w for w, k in zip(words, kept_words(len(words), found).tolist()) if k])
            others = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *others, pa.array(listed, struct)], [f.name for f in schema])

    plain = documents.select(F.col("text").cast("string").alias("text"), *[f"`{c}`" for c in documents.columns if c not in ("text", "runs")])
    return plain.mapInArrow(run, schema)
