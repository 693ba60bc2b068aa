"""Operator 4: document quality by a factorisation machine.

Inputs of a score are hashed words, structure statistics (shares of character classes, word and line shapes) and the
``n_chars`` metadata; never labels, language, source or id. Pairwise interactions have low rank and are summed in
linear time: sum_{i<j} <v_i, v_j> x_i x_j = 1/2 * sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2].

The model is fitted on a bounded sample of labelled rows (``sample_rows``, the smallest hashes of the ids); a sampled
document has at most ``WORD_BUCKETS`` features, so what reaches the driver is bounded. Every document is scored, in one
pass without a shuffle.

Defined results. Null or empty text: scored from its structure alone (all counts zero). Null ``n_chars``: a bin of its
own. Null ids: kept, remainder of the empty text. Repeated rows: scored each, alike. Labels that are null or not 0/1
are ignored; of repeated labels of one id the smaller counts. No usable labels, or one class only: the model is the
class share (0.5 without labels). Empty tables give an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import texts as T

WORD_BUCKETS = 1 << 14
STATS = ("letters", "upper", "digits", "blanks", "lines", "stops", "marks", "shouts", "bars", "signs", "wide", "word_len",
         "long_words", "distinct", "top_word", "marked_words", "capital_words", "words", "chars", "n_chars")
BINS = 24
N_FEATURES = WORD_BUCKETS + len(STATS) * BINS
RANK = 8

# Shares are cut at powers of the golden ratio's square root; 0 has a bin of its own.
_SHARE_EDGES = np.array([0.0] + [1.45 ** -(BINS - 2 - i) for i in range(BINS - 1)])
_CLASSES = {
    "letters": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper": T.UPPER, "digits": "0123456789", "blanks": T.SPACES,
    "lines": "\n", "stops": ".", "marks": ",;:'\"()-?", "shouts": "!", "bars": "|", "signs": "*#$%&@^~<>=+_/\\[]{}`",
}


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features of a batch with columns text and n_chars: row bounds, indices, values."""
    data, offsets = T.utf8(batch.column(batch.schema.get_field_index("text")))
    n, rows = len(batch), np.arange(len(batch))
    starts, ends, bounds = T.word_spans(data, offsets)
    words = T.span_digests(T.lower_ascii(data), starts, ends)
    of_word = np.repeat(rows, np.diff(bounds))
    n_words, n_bytes = np.diff(bounds).astype(float), np.diff(offsets).astype(float)

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    def words_with(mask: np.ndarray) -> np.ndarray:
        return np.bincount(of_word[mask], minlength=n).astype(float)

    key, count = np.unique(of_word * WORD_BUCKETS + (words % np.uint64(WORD_BUCKETS)).astype(np.int64), return_counts=True)
    row, bucket = key // WORD_BUCKETS, key % WORD_BUCKETS
    weight = 1 + np.log(count)
    norm = np.sqrt(np.bincount(row, weight**2, minlength=n))
    top = np.zeros(n)
    np.maximum.at(top, row, count)

    lut = {name: np.isin(np.arange(256), [ord(c) for c in chars]) for name, chars in _CLASSES.items()}
    per_byte, per_word = np.maximum(n_bytes, 1), np.maximum(n_words, 1)
    stat = {name: total(table[data]) / per_byte for name, table in lut.items()}
    stat["wide"] = total(data >= 0xC0) / per_byte
    length = (ends - starts).astype(float)
    stat["word_len"] = np.minimum(np.bincount(of_word, length, minlength=n) / per_word / 40, 1)
    stat["long_words"] = words_with(length > 14) / per_word
    stat["distinct"] = np.bincount(row, minlength=n) / per_word
    stat["top_word"] = top / per_word
    signs = np.concatenate([[0], np.cumsum((lut["signs"] | lut["shouts"] | lut["bars"])[data], dtype=np.int64)])
    stat["marked_words"] = words_with(signs[ends] > signs[starts]) / per_word
    stat["capital_words"] = words_with(lut["upper"][data[starts]] & lut["upper"][data[np.minimum(ends - 1, starts + 1)]]) / per_word
    bins = [np.searchsorted(_SHARE_EDGES, stat[name], side="left") for name in STATS[:-3]]
    said = batch.column(batch.schema.get_field_index("n_chars")).cast(pa.float64())
    said = np.nan_to_num(np.asarray(said.fill_null(-1.0), float), nan=-1.0)
    bins += [np.log2(1 + x).astype(int) for x in (n_words, n_bytes)]
    bins.append(np.where(said < 0, BINS - 1, np.log2(1 + np.maximum(said, 0)).astype(int)))
    dense = np.stack([WORD_BUCKETS + k * BINS + np.clip(b, 0, BINS - 1) for k, b in enumerate(bins)], 1)

    row = np.concatenate([row, np.repeat(rows, dense.shape[1])])
    index = np.concatenate([bucket, dense.ravel()])
    value = np.concatenate([weight / np.maximum(norm, 1e-9)[row[:len(weight)]], np.full(dense.size, 0.5)])
    order = np.argsort(row, kind="stable")
    return np.searchsorted(row[order], np.arange(n + 1)), index[order].astype(np.int32), value[order].astype(np.float32)


def _by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, bounds[:-1], axis=0)  # every row has its structure bins, so none is empty


def logits(model: Model, bounds: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
    vx = model.factors[index] * value[:, None]
    sums = _by_row(vx, bounds)
    return model.bias + _by_row(model.linear[index] * value, bounds) + 0.5 * (sums**2 - _by_row(vx**2, bounds)).sum(1)


def fit(bounds: np.ndarray, index: np.ndarray, value: np.ndarray, label: np.ndarray, epochs: int = 8, batch: int = 64,
        rate: float = 0.05, decay: float = 1e-5, seed: int = 0) -> Model:
    """Logistic loss, adaptive steps (the squared gradients of each parameter are summed); classes weigh alike."""
    rng = np.random.default_rng(seed)
    n, ones = len(label), float(label.sum())
    share = (ones + 1) / (n + 2)
    model = Model(float(np.log(share / (1 - share))), np.zeros(N_FEATURES), rng.normal(0, 0.05, (N_FEATURES, RANK)))
    if n == 0 or ones in (0, n):
        model.factors[:] = 0
        return model
    weight = np.where(label == 1, 0.5 * n / ones, 0.5 * n / (n - ones))
    model.bias = 0.0
    grown_w, grown_v, grown_b = np.full(N_FEATURES, 1e-2), np.full((N_FEATURES, RANK), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(n)
        for start in range(0, n, batch):
            some = order[start:start + batch]
            take = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in some])
            size = np.diff(bounds)[some]
            own = np.concatenate([[0], np.cumsum(size)])
            i, x = index[take], value[take].astype(float)
            vx = model.factors[i] * x[:, None]
            sums = _by_row(vx, own)
            z = model.bias + _by_row(model.linear[i] * x, own) + 0.5 * (sums**2 - _by_row(vx**2, own)).sum(1)
            error = weight[some] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[some]) / len(some)
            each = np.repeat(error, size) * x
            touched, place = np.unique(i, return_inverse=True)
            g_w = np.bincount(place, each) + decay * model.linear[touched]
            pull = each[:, None] * (np.repeat(sums, size, axis=0) - vx)
            g_v = np.stack([np.bincount(place, pull[:, f]) for f in range(RANK)], 1) + decay * model.factors[touched]
            grown_w[touched] += g_w**2
            grown_v[touched] += g_v**2
            grown_b += error.sum() ** 2
            model.linear[touched] -= rate * g_w / np.sqrt(grown_w[touched])
            model.factors[touched] -= rate * g_v / np.sqrt(grown_v[touched])
            model.bias -= rate * error.sum() / np.sqrt(grown_b)
    return model


def training_sample(documents: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """Features of at most ``sample_rows`` labelled documents that are not held out."""
    usable = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (T.crc32_remainder(F.col("doc_id"), 3) != 1))
              .groupBy("doc_id").agg(F.min("quality").alias("label")))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    found = (documents.select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars"))
             .join(F.broadcast(chosen), "doc_id"))  # sample_rows narrow rows at most

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.pieces(batches):
            bounds, index, value = features(batch)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(3), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(index)),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(value))], ["doc_id", "label", "index", "value"])

    return found.mapInArrow(extract, "doc_id long, label int, index array<int>, value array<float>")


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = 4000) -> Model:
    rows = training_sample(documents, labels.select("doc_id", F.col("quality").cast("int").alias("quality")), sample_rows).toArrow()
    if not rows.num_rows:
        return fit(np.zeros(1, int), np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0))
    rows = rows.sort_by([("doc_id", "ascending"), ("label", "ascending")]).combine_chunks()
    index, value = rows.column("index").combine_chunks(), rows.column("value").combine_chunks()
    bounds = np.concatenate([[0], np.cumsum(np.asarray(index.value_lengths()))])
    return fit(bounds, np.asarray(index.flatten()), np.asarray(value.flatten()), np.asarray(rows.column("label"), float))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """One row per row of the documents: doc_id and the score between 0 and 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.pieces(batches):
            z = logits(model, *features(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])

    columns = documents.select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars"))
    return columns.mapInArrow(run, "doc_id long, score double")


def classify(documents: DataFrame, labels: DataFrame, sample_rows: int = 4000) -> DataFrame:
    scored = score(documents, train(documents, labels, sample_rows))
    return scored.select("doc_id", (T.crc32_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents whose score reaches the limit, with all their columns as they were."""
    columns = documents.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.pieces(batches):
            inputs = pa.RecordBatch.from_arrays(
                [batch.column(columns.index("text")), batch.column(columns.index("n_chars")).cast(pa.float64())], ["text", "n_chars"])
            z = logits(model, *features(inputs))
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))) >= least))

    return documents.mapInArrow(run, documents.schema)
