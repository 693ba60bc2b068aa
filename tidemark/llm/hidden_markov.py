"""Operator 6: score texts with a hidden Markov language model trained by Baum-Welch over the whole corpus.

Tokens are words (ASCII letters lower-cased) and one end token. The model has ``STATES`` latent states and emits symbols;
a symbol is a class of words (``SYMBOLS`` hash classes, the end token one more), and a word has its smoothed share of its
class: p(w | state) = E[state, class(w)] * (c(w) + 0.1) / (C(class) + 0.1 * (V(class) + 1)). So every word has a
probability of its own and the tables that are sent to tasks have a fixed size.

Training starts from a fit on a bounded sample of short excerpts (``start_rows``) and then runs ``passes`` Baum-Welch
passes over all training documents: each task adds up expected counts, Spark sums them over partitions, the driver
normalises tables of fixed size. Word counts, on which both scores rest, cover all training tokens.

The likelihood of a text is exact at any length. A text is cut into chunks; the scaled forward recursion runs in every
chunk from all states at once, and the chunks' matrices are then multiplied in order.

The base score needs the count of every token of every text. Counts of the ``TOP_WORDS`` most frequent words go to every
task (one megabyte); only other tokens are joined with the table of counts, and by then no key is hot.

Words are 64-bit digests inside. Defined results. Null or empty text: the end token alone. Null ids and repeated rows:
one result row per row. No training documents: counts are zero and every token has the same probability. Empty table:
no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import texts as T
from tidemark.session import settle

STATES, SYMBOLS, TOP_WORDS, CHUNK = 6, 8192, 65_536, 256
END_DIGEST = np.uint64(0x5DEECE66D1234567)
_RESCALE = 6  # steps between rescalings; an emission is far above the 50th part of the smallest double's exponent


@dataclass
class Model:
    start: np.ndarray  # STATES
    move: np.ndarray  # STATES x STATES
    emit: np.ndarray  # STATES x (SYMBOLS + 1)


@dataclass
class Counts:
    table: DataFrame  # digest, c
    tokens: int
    distinct: int
    top: np.ndarray  # sorted digests
    top_count: np.ndarray
    share: np.ndarray  # per symbol 1 / (C + 0.1 * (V + 1))


def symbols_of(digests: np.ndarray) -> np.ndarray:
    out = (digests % np.uint64(SYMBOLS)).astype(np.int32)
    out[digests == END_DIGEST] = SYMBOLS
    return out


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all tokens, the end token behind every row's words, and the rows' bounds."""
    words, bounds = T.word_digests(column)
    return np.insert(words, bounds[1:], END_DIGEST), bounds + np.arange(len(bounds))


def chunks_of(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and row of every chunk; rows are never empty."""
    sizes = np.diff(bounds)
    per_row = -(-sizes // CHUNK)
    row = np.repeat(np.arange(len(sizes)), per_row)
    number = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    start = bounds[:-1][row] + number * CHUNK
    return start, np.minimum(CHUNK, bounds[1:][row] - start), row


def _transfers(model: Model, emit: np.ndarray, symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per chunk the product of (move, then emit) over its tokens, rescaled, and the logarithm of the scale."""
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    n, k = len(start), len(model.start)
    x = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    scale = np.zeros(n)
    live = np.searchsorted(-length, -np.arange(length[0] if n else 0), side="left")  # chunks longer than t
    for t, m in enumerate(live):
        x[:m] = (x[:m].reshape(-1, k) @ model.move).reshape(m, k, k)
        x[:m] *= emit[symbols[start[:m] + t]][:, None, :]
        if t % _RESCALE == _RESCALE - 1:
            big = x[:m].max((1, 2))
            x[:m] /= big[:, None, None]
            scale[:m] += np.log(big)
    big = x.max((1, 2), initial=0)
    x /= big[:, None, None]
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return x[back], (scale + np.log(big))[back]


def log_likelihood(model: Model, emit: np.ndarray, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural logarithm of every row's probability; ``emit`` is by symbol, then state.

    The start distribution is folded into the first step: p(first state) = start @ move.
    """
    start, length, row = chunks_of(bounds)
    x, scale = _transfers(model, emit, symbols, start, length)
    first = np.searchsorted(row, np.arange(len(bounds) - 1))
    count = np.bincount(row, minlength=len(bounds) - 1)
    alpha = np.broadcast_to(model.start, (len(count), len(model.start))).copy()
    out = np.zeros(len(count))
    for c in range(count.max(initial=0)):
        some = np.flatnonzero(count > c)
        alpha[some] = np.einsum("nk,nkl->nl", alpha[some], x[first[some] + c])
        total = alpha[some].sum(1)
        alpha[some] /= total[:, None]
        out[some] += np.log(total) + scale[first[some] + c]
    return out


def expected_counts(model: Model, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch expectations of a batch: of the state before the text, of moves, and of emissions."""
    k = len(model.start)
    emit = np.ascontiguousarray(model.emit.T)
    start, length, row = chunks_of(bounds)
    x, _ = _transfers(model, emit, symbols, start, length)
    first = np.searchsorted(row, np.arange(len(bounds) - 1))
    count = np.bincount(row, minlength=len(bounds) - 1)
    enter, leave = np.empty((len(row), k)), np.ones((len(row), k))
    alpha = np.broadcast_to(model.start, (len(count), k)).copy()
    for c in range(count.max(initial=0)):
        some = np.flatnonzero(count > c)
        enter[first[some] + c] = alpha[some]
        alpha[some] = np.einsum("nk,nkl->nl", alpha[some], x[first[some] + c])
        alpha[some] /= alpha[some].sum(1)[:, None]
    beta = np.ones((len(count), k))
    for c in range(count.max(initial=0) - 1, -1, -1):
        some = np.flatnonzero(count > c)
        leave[first[some] + c] = beta[some]
        beta[some] = np.einsum("nkl,nl->nk", x[first[some] + c], beta[some])
        beta[some] /= beta[some].sum(1)[:, None]
    begin = model.start * beta
    begin = (begin / begin.sum(1)[:, None]).sum(0)

    order = np.argsort(-length, kind="stable")
    start, length, alpha, leave = start[order], length[order], enter[order], leave[order]
    live = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
    before = []  # forward vectors before every step
    for t, m in enumerate(live):
        before.append(alpha[:m].copy())
        alpha[:m] = (alpha[:m] @ model.move) * emit[symbols[start[:m] + t]]
        alpha[:m] /= alpha[:m].sum(1)[:, None]
    moves, gammas, places = np.zeros((k, k)), [], []
    beta = leave.copy()
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        seen = symbols[start[:m] + t]
        ahead = emit[seen] * beta[:m]
        past = before[t]
        back = ahead @ model.move.T
        norm = (past * back).sum(1)
        moves += (past / norm[:, None]).T @ ahead
        gammas.append((past @ model.move) * ahead / norm[:, None])
        places.append(seen)
        beta[:m] = back / back.sum(1)[:, None]
    moves *= model.move
    gamma, place = np.concatenate(gammas), np.concatenate(places)
    emits = np.stack([np.bincount(place, gamma[:, s], SYMBOLS + 1) for s in range(k)])
    return begin, moves, emits


def normalised(begin: np.ndarray, moves: np.ndarray, emits: np.ndarray, overall: np.ndarray, prior: float = 200.0) -> Model:
    """Probabilities from expected counts; emissions lean towards the overall shares with the weight of ``prior`` tokens."""
    begin, moves = begin + 1e-3, moves + 1e-3
    emits = emits + prior * overall
    return Model(begin / begin.sum(), moves / moves.sum(1)[:, None], emits / emits.sum(1)[:, None])


def first_model(symbols: np.ndarray, bounds: np.ndarray, overall: np.ndarray, states: int, rounds: int = 12, seed: int = 3) -> Model:
    """Baum-Welch on the driver over a bounded sample, from emissions disturbed at random."""
    rng = np.random.default_rng(seed)
    emits = overall * rng.gamma(1.0, 1.0, (states, SYMBOLS + 1))
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    model = Model(np.full(states, 1 / states), move / move.sum(1)[:, None], emits / emits.sum(1)[:, None])
    if len(bounds) > 1:
        for _ in range(rounds):
            model = normalised(*expected_counts(model, symbols, bounds), overall, 20.0)
    return model


def training(documents: DataFrame) -> DataFrame:
    return documents.where(T.crc32_remainder(F.col("doc_id"), 10) != 0)


def count_words(documents: DataFrame) -> Counts:
    """Counts of all training tokens; the full table stays in Spark, tables of fixed size come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            words, place = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            count = np.bincount(place, np.concatenate([c for _, c in held])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(count)], ["digest", "c"])

        for batch in T.pieces(batches, "text"):
            held.append(np.unique(tokens_of(batch.column(0))[0], return_counts=True))
            size += len(held[-1][0])
            if size > 1_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    table = settle(training(documents).select("text").mapInArrow(run, "digest long, c long")
                   .groupBy("digest").agg(F.sum("c").alias("c")))
    whole = table.agg(F.sum("c"), F.count("*")).first()
    # The most frequent words: the largest classes of counts (16 to the power of two) that together fit the limit. Sorting
    # with a limit would send as many rows from every task.
    size = F.floor(16 * F.log2("c")).cast("int")
    classes = table.groupBy(size.alias("size")).agg(F.count("*").alias("n")).toPandas().sort_values("size", ascending=False)
    fitting = classes["size"][classes["n"].cumsum() <= TOP_WORDS]
    top = table.where(size >= int(fitting.min()) if len(fitting) else F.lit(False)).toPandas()
    digests = top["digest"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(digests)
    # Digests are unsigned; their remainder comes from the two halves.
    symbol = F.when(F.col("digest") == int(np.array(END_DIGEST).view(np.int64)), SYMBOLS).otherwise(F.col("digest").bitwiseAND(F.lit(SYMBOLS - 1)))
    by = table.groupBy(symbol.cast("int").alias("s")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).toPandas()
    share = np.full(SYMBOLS + 1, 0.1)
    share[by["s"]] = by["c"] + 0.1 * (by["v"] + 1)
    return Counts(table, int(whole[0] or 0), int(whole[1]), digests[order], top["c"].to_numpy(np.int64)[order], 1 / share)


def symbol_shares(counts: Counts) -> np.ndarray:
    shares = 1 / counts.share
    return shares / shares.sum()


def train(documents: DataFrame, counts: Counts, states: int = STATES, passes: int = 3, start_rows: int = 400) -> Model:
    overall = symbol_shares(counts)
    chosen = training(documents).select("doc_id", "text").where("doc_id is not null")
    place = F.pmod(F.xxhash64("doc_id", F.lit("start")), F.greatest(F.lit(1), F.length("text") - 3000)).cast("int") + 1
    some = (chosen.select("doc_id", F.substring("text", place, F.lit(3000)).alias("text"))
            .orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(start_rows).toArrow())
    tokens, bounds = tokens_of(some.column("text").combine_chunks()) if some.num_rows else (np.zeros(0, np.uint64), np.zeros(1, int))
    model = first_model(symbols_of(tokens), bounds, overall, states)

    for _ in range(passes):
        def run(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in T.pieces(batches, "text"):
                tokens, bounds = tokens_of(batch.column(0))
                part = expected_counts(model, symbols_of(tokens), bounds)
                total = part if total is None else tuple(a + b for a, b in zip(total, part, strict=True))
            if total is not None:
                flat = np.concatenate([t.ravel() for t in total])
                some = np.flatnonzero(flat)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], ["at", "value"])

        sums = (training(documents).select("text").mapInArrow(run, "at long, value double")
                .groupBy("at").agg(F.sum("value").alias("value")).toPandas())  # the model's size at most
        flat = np.zeros(states + states**2 + states * (SYMBOLS + 1))
        flat[sums["at"]] = sums["value"]
        begin, moves, emits = np.split(flat, [states, states + states**2])
        if not len(sums):
            break
        model = normalised(begin, moves.reshape(states, states), emits.reshape(states, -1), overall)
    return model


def score(documents: DataFrame, model: Model, counts: Counts) -> DataFrame:
    """The query's rows: counts of tokens, base score and the model's log10 probability of every text."""
    emit = np.ascontiguousarray((model.emit * counts.share).T)
    top, log_top = counts.top, np.log10(counts.top_count + 0.1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.pieces(batches):
            tokens, bounds = tokens_of(batch.column(1))
            model_score = log_likelihood(model, emit, symbols_of(tokens), bounds) / np.log(10)
            at = np.minimum(np.searchsorted(top, tokens), max(len(top) - 1, 0))
            known = top[at] == tokens if len(top) else np.zeros(len(tokens), bool)
            value = np.where(known, log_top[at] if len(top) else 0.0, 0.0)
            sums = np.add.reduceat(value, bounds[:-1])
            hits = np.add.reduceat(known.astype(np.int64), bounds[:-1])
            rest = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.diff(bounds) - hits)]), pa.int32()), pa.array(tokens[~known].view(np.int64)))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(hits), pa.array(sums), pa.array(model_score), rest,
            ], ["doc_id", "n_tokens", "hits", "sums", "model", "rest"])

    rows = settle(documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, hits long, sums double, model double, rest array<long>")
        .withColumn("row", F.monotonically_increasing_id()))
    rare = (rows.select("row", F.explode("rest").alias("digest")).groupBy("row", "digest").agg(F.count("*").alias("times"))
            .join(counts.table, "digest", "left")
            .groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("found"),
                                F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("more")))
    logs = F.col("sums") + F.coalesce("more", F.lit(0.0))
    each = float(np.log10(counts.tokens + 0.1 * (counts.distinct + 1)))
    return (rows.drop("rest").join(rare, "row", "left")
            .select("doc_id", (T.crc32_remainder(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens",
                    (F.col("hits") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"),
                    (logs - F.col("n_tokens") * F.lit(each)).alias("base_score"), (F.col("model") + logs).alias("score")))


def language_scores(documents: DataFrame, states: int = STATES, passes: int = 3) -> DataFrame:
    counts = count_words(documents)
    return score(documents, train(documents, counts, states, passes), counts)
