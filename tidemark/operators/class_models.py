"""Class models walked forward: penalised softmax fits of all folds and penalties at once, and their choice by held-out loss.

A fold trains on the rows of strictly earlier ranks. Rows that are alike in rank, features and class are counted once.
Every Newton pass serves all fits together: a task sorts a batch by rank, so that each fold's training rows are a prefix of
it, and adds up loss, gradient and Hessian at that fold's own weights; partial sums are added in two levels and the systems
are solved where the sums meet. The driver holds one row of weights per fit, a number that the caller's lists bound.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.maths import softmax
from tidemark.operators.metrics import multiclass_brier, multiclass_log_loss
from tidemark.session import TidemarkError, small, written

# Partial sums of a fit meet in so many groups before they meet in one.
PARTS = 32


def class_cells(df: DataFrame, x: Sequence[str], y: str, rank: str, weight: str | None = None) -> DataFrame:
    """Equal rows once: _rank, the features, _y and their number _n. Rows with a NULL among these take no part."""
    features = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x)]
    count = F.col(weight) if weight else F.lit(1)
    rows = df.select(F.col(rank).cast("long").alias("_rank"), *features, F.col(y).cast("int").alias("_y"), count.alias("_n")).dropna()
    return written(rows.groupBy(*[c for c in rows.columns if c != "_n"]).agg(F.sum("_n").cast("double").alias("_n")), "cells")


def _pass(cells: DataFrame, p: int, k: int, fits: dict[int, tuple[int, float, np.ndarray]]) -> DataFrame:
    """Per fit its rows, penalised loss, largest gradient component and Newton step, at the given weights."""
    size = p * k

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {m: np.zeros(2 + size + size * size) for m in fits}
        for pdf in batches:
            pdf = pdf.sort_values("_rank")
            ranks, design = pdf["_rank"].to_numpy(), pdf[[f"x{i}" for i in range(p)]].to_numpy()
            weight, hot = pdf["_n"].to_numpy(), np.eye(k)[pdf["_y"].to_numpy()]
            for m, (fold, _, theta) in fits.items():
                end = int(np.searchsorted(ranks, fold))
                if not end:
                    continue
                rows, w, s = design[:end], weight[:end], sums[m]
                logits = rows @ theta
                logits -= logits.max(axis=1, keepdims=True)
                whole = np.log(np.exp(logits).sum(axis=1, keepdims=True))
                probs = np.exp(logits - whole)
                s[0] += w.sum()
                s[1] += (w * (whole[:, 0] - (logits * hot[:end]).sum(axis=1))).sum()
                s[2:2 + size] += (rows.T @ (w[:, None] * (probs - hot[:end]))).ravel()
                hessian = s[2 + size:].reshape(p, k, p, k)
                for a in range(k):
                    for b in range(a, k):
                        block = rows.T @ (rows * (w * probs[:, a] * ((a == b) - probs[:, b]))[:, None])
                        hessian[:, a, :, b] += block
                        if a != b:
                            hessian[:, b, :, a] += block
        part = TaskContext.get().partitionId() % PARTS
        yield pd.DataFrame({"model": list(sums), "part": part, "sums": [s.tolist() for s in sums.values()]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": pdf["model"][:1], "part": pdf["part"][:1], "sums": [np.sum(np.stack(pdf["sums"]), axis=0).tolist()]})

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        model, total = int(pdf["model"].iloc[0]), np.sum(np.stack(pdf["sums"]), axis=0)
        _, l2, theta = fits[model]
        gradient = total[2:2 + size] + 2 * l2 * theta.ravel()
        hessian = total[2 + size:].reshape(size, size) + 2 * l2 * np.eye(size)
        # Without a penalty the weights are only known up to a shift of all classes: the smallest step is taken.
        step = np.linalg.lstsq(hessian, gradient, rcond=1e-12)[0]
        return pd.DataFrame({"model": [model], "n": [total[0]], "loss": [total[1] + l2 * float((theta ** 2).sum())],
                             "gradient": [float(np.abs(gradient).max())], "step": [step.tolist()]})

    sums = cells.mapInPandas(partial, "model int, part int, sums array<double>")
    sums = sums.groupBy("model", "part").applyInPandas(added, "model int, part int, sums array<double>")
    return sums.groupBy("model").applyInPandas(solved, "model int, n double, loss double, gradient double, step array<double>")


def fit_class_folds(df: DataFrame, x: Sequence[str], y: str, n_classes: int, l2s: Sequence[float], folds: Sequence[int],
                    rank: str = "fold", tolerance: float = 1e-10, max_steps: int = 60, weight: str | None = None) -> DataFrame:
    """Weights minimising negative log likelihood plus l2 times their squared sum, per fold and penalty.

    Returns fold, l2, n (training rows), weights (feature by feature, the classes within), gradient, steps and converged.
    ``weight`` names a column with the number of rows that a row stands for. Folds without earlier rows have no fit. A step that does not lower the loss is halved. A fit that has not converged
    after the last step says so.
    """
    if not folds or not l2s or not x or n_classes < 2:
        raise TidemarkError("a fit needs folds, penalties, features and two classes")
    p, k = len(x), n_classes
    cells = class_cells(df, x, y, rank, weight)
    bad = cells.agg(F.count_if((F.col("_y") < 0) | (F.col("_y") >= k))).first()[0]
    if bad:
        raise TidemarkError(f"classes run from 0 to {k - 1}")
    keys = [(int(f), float(v)) for f in folds for v in l2s]
    state = {m: {"at": np.zeros((p, k)), "try": np.zeros((p, k)), "step": None, "loss": np.inf, "n": 0.0, "gradient": 0.0, "steps": 0, "done": False}
             for m in range(len(keys))}
    for _ in range(max_steps):
        open_fits = {m: (*keys[m], s["try"]) for m, s in state.items() if not s["done"]}
        if not open_fits:
            break
        for m, n, loss, gradient, step in _pass(cells, p, k, open_fits).collect():
            s = state[m]
            s["steps"] += 1
            if not n:
                s["done"] = True
                continue
            if loss > s["loss"] + 1e-12 * abs(s["loss"]):
                s["step"] = s["step"] / 2
            else:
                s.update(at=s["try"], loss=loss, n=n, gradient=gradient, step=np.array(step).reshape(p, k))
            s["try"] = s["at"] - s["step"]
            s["done"] = bool(np.abs(s["step"]).max() < tolerance)
        if all(s["steps"] == 0 for s in state.values()):
            break  # no rows at all
    rows = [(*keys[m], int(s["n"]), s["at"].ravel().tolist(), s["gradient"], s["steps"], s["done"]) for m, s in state.items() if s["n"]]
    return df.sparkSession.createDataFrame(
        rows, "fold long, l2 double, n long, weights array<double>, gradient double, steps int, converged boolean")


def class_predictions(df: DataFrame, fits: DataFrame, x: Sequence[str], n_classes: int, folds: Sequence[int], rank: str = "fold",
                      out: str = "probs") -> DataFrame:
    """Every row from the first fold on, once per penalty (column l2), with class probabilities by the fit of its fold.

    The fold of a row is the last one at or before its rank, so its fit has seen strictly earlier ranks only.
    """
    starts = F.array(*[F.lit(int(f)).cast("long") for f in sorted(folds)])
    placed = df.withColumn("_fold", F.array_max(F.filter(starts, lambda f: f <= F.col(rank))))
    side = fits.select(F.col("fold").alias("_fold"), "l2", F.col("weights").alias("_weights"))
    logits = [sum((F.col(c).cast("double") * F.get("_weights", F.lit(i * n_classes + k)) for i, c in enumerate(x)), F.lit(0.0)) for k in range(n_classes)]
    return placed.join(small(side), "_fold").withColumn(out, F.array(*softmax(logits))).drop("_fold", "_weights")


def penalty_path(predictions: DataFrame, y: str = "y", probs: str = "probs", key: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Held-out log loss and Brier score of every penalty, and which has the least log loss (of equal ones the largest).

    ``weight`` names a column with the number of rows that a row stands for.
    """
    label, held = F.col(y).cast("int"), F.col(weight) if weight else None
    scored = predictions.groupBy(*key, "l2").agg(
        (F.count("*") if held is None else F.sum(held)).alias("n"), multiclass_log_loss(label, F.col(probs), held).alias("log_loss"),
        multiclass_brier(label, F.col(probs), held).alias("brier"))
    place: Column = F.row_number().over(W.partitionBy(*(key or [F.lit(0)])).orderBy("log_loss", F.desc("l2")))
    return scored.withColumn("is_best", place == 1)
