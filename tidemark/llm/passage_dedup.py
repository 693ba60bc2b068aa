"""Operator 1: passages that repeat across documents, by hashing lines.

A unit is a line, cut further where a sentence ends. Units are normalised (ASCII lower case, runs of spaces as one) and
hashed; digests are grouped globally and the earliest ranked occurrence of each, by document id and then by place, is
kept. Every later occurrence is a repeat. Neighbouring repeats of a document form a run; a run of at least
``min_words`` words is removed, a shorter one (a common short line) is left alone. Original offsets stay with every run.

Only counts and smallest ids per digest are grouped, with sums on the map side; a unit that a third of all documents hold
is one row per task there, and the join back to its occurrences is one that Spark splits.

Offsets are code points, end exclusive. Digests have 64 bits.

Defined results. Null or empty text: no units. Null ids: take no part, and ``remove`` leaves their texts alone. Repeated
ids: one document; occurrences of a unit within one row count in order, and equal rows give one result row. Empty table:
no rows. Further columns are ignored by ``repeats`` and kept by ``remove``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm import texts as T
from tidemark.session import settle

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
_CHAIN = 0xC2B2AE3D27D4EB4F


def _units(column: pa.Array, sentences: bool) -> tuple[np.ndarray, ...]:
    """Row, number in row, start and end (code points), words, digest and whether it is the row's first of its digest."""
    data, offsets = T.utf8(column)
    starts, ends, bounds = T.word_spans(data, offsets)
    none = (np.zeros(0, np.int64),) * 6 + (np.zeros(0, bool),)
    if not len(starts):
        return none
    lines = np.concatenate([[0], np.cumsum(data == ord("\n"))])
    opens = np.zeros(len(starts), bool)
    opens[bounds[:-1][bounds[:-1] < len(starts)]] = True
    opens[1:] |= lines[starts[1:]] > lines[ends[:-1]]
    if sentences:
        opens[1:] |= _ENDS[data[ends[:-1] - 1]]
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(starts)) - 1
    # The digest of a unit is a polynomial in its words' digests, modulo 2**64.
    words = T.span_digests(T.lower_ascii(data), starts, ends)
    place = np.arange(len(words)) - np.repeat(first, last - first + 1)
    longest = int(place.max()) + 1
    powers = np.full(longest, _CHAIN, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    digest = T.mix(np.add.reduceat(T.mix(words) * powers[place], first) + (last - first).astype(np.uint64))
    row = np.searchsorted(bounds, first, side="right") - 1
    number = np.arange(len(first)) - np.searchsorted(first, bounds[row])
    points = T.byte_to_code_point(data)
    base = points[offsets[row]]
    _, seen = np.unique(T.mix(digest ^ T.mix(row.astype(np.uint64) + np.uint64(1))), return_index=True)
    fresh = np.zeros(len(first), bool)
    fresh[seen] = True
    return row, number, points[starts[first]] - base, points[ends[last]] - base, last - first + 1, digest.view(np.int64), fresh


def units(documents: DataFrame, sentences: bool = True) -> DataFrame:
    """Every unit of every document: doc_id, unit, start, end, words, digest, fresh."""
    names = ["unit", "start", "end", "words", "digest", "fresh"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.pieces(batches):
            row, *rest = _units(batch.column(1), sentences)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(c) for c in rest)], ["doc_id", *names])

    return documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, unit long, start long, end long, words long, digest long, fresh boolean")


def repeats(documents: DataFrame, min_words: int = 30, sentences: bool = True) -> DataFrame:
    """Runs to remove: doc_id, start, end, n_units, n_words and first_doc_id, the smallest id that keeps one of their units."""
    every = units(documents, sentences)
    # Written first: Spark splits a hot digest in the join only where both sides are shuffled for the join itself.
    shared = settle(every.where("fresh").groupBy("digest").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc_id"))
                    .where("docs > 1").select("digest", "first_doc_id"))
    found = (every.join(shared, "digest", "left").where("not fresh or doc_id > first_doc_id")
             .select("doc_id", "unit", "start", "end", "words", F.least("doc_id", "first_doc_id").alias("first_doc_id")).distinct())
    order = Window.partitionBy("doc_id").orderBy("unit")
    runs = found.withColumn("run", F.col("unit") - F.row_number().over(order))
    return (runs.groupBy("doc_id", "run")
            .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_units"),
                 F.sum("words").alias("n_words"), F.min("first_doc_id").alias("first_doc_id"))
            .where(F.col("n_words") >= min_words).drop("run"))


def remove(documents: DataFrame, runs: DataFrame, text: str = "text") -> DataFrame:
    """The documents without the runs; a document's runs are sorted within its own row."""
    spans = runs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    cut = (f"aggregate(__spans, struct('' as done, 0L as at), (s, r) -> struct(concat(s.done, substring({text}, cast(s.at as int) + 1,"
           f" cast(r.start - s.at as int))) as done, r.end as at), s -> concat(s.done, substring({text}, cast(s.at as int) + 1)))")
    return (documents.join(spans, "doc_id", "left")
            .withColumn(text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(F.expr(cut))).select(*documents.columns))
