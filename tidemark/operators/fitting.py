"""Model fitting whose work is distributed aggregates; the driver only solves small dense systems."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, IsotonicRegression
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.maths import decay_weight, low_score_factor
from tidemark.operators.ordered import row_positions
from tidemark.operators.sparse import packed_folds, packed_sums, scales_of, solve_packed
from tidemark.session import TidemarkError, small

# Priors of a team without history, bounds of the dependence parameter, fitting defaults.
NO_HISTORY_ATTACK = -0.3061
NO_HISTORY_DEFENCE = 0.2216
RHO_BOUNDS = (-0.25, 0.25)
ISOTONIC_BINS = 20
HOLDOUT_FRACTION = 0.2
MIN_HOLDOUT_ROWS = 200
MIN_INNER_ROWS = 200
# An aggregate column per pair stays in compiled code for so many features; more are summed as packed triangles.
NARROW = 8


# -- design ------------------------------------------------------------------------------------------

def feature_scales(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    return scales_of(df, columns)


def standardised(df: DataFrame, scales: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f"z_{c}": (F.col(c).cast("double") - m) / s for c, (m, s) in scales.items()})


def design_columns(df: DataFrame, numeric: Sequence[str], categories: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Intercept, standardised numbers and one 0/1 column per category value in sorted order.

    One table column per level: for categories of more than a thousand levels see ``sparse.sparse_design``.
    """
    out = standardised(df, feature_scales(df, numeric)).withColumn("z_intercept", F.lit(1.0))
    names = ["z_intercept", *[f"z_{c}" for c in numeric]]
    for c in categories:
        levels = sorted(r[0] for r in df.select(c).distinct().limit(1001).collect())
        if len(levels) > 1000:
            raise TidemarkError(f"{c} has too many levels for one column each; use sparse_design")
        for i, level in enumerate(levels):
            out = out.withColumn(f"z_{c}_{i}", (F.col(c) == level).cast("double"))
            names.append(f"z_{c}_{i}")
    return out, names


# -- ridge -------------------------------------------------------------------------------------------

def _gram_sums(x: Sequence[str], y: str) -> list[Column]:
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    return [
        F.count("*").alias("n"),
        *[F.sum(F.col(x[i]) * F.col(x[j])).alias(f"g_{i}_{j}") for i, j in pairs],
        *[F.sum(F.col(x[i]) * F.col(y)).alias(f"b_{i}") for i in range(len(x))],
    ]


def _solve(row, p: int, l2: float) -> np.ndarray:
    g = np.array([[row[f"g_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], dtype=float)
    return np.linalg.solve(g + l2 * np.eye(p), np.array([row[f"b_{i}"] for i in range(p)], dtype=float))


def fit_ridge(df: DataFrame, x: Sequence[str], y: str, l2: float) -> np.ndarray:
    """(X'X + l2 I) beta = X'y from one distributed pass over the rows."""
    if len(x) > NARROW:
        sums = np.zeros(1 + len(x) * (len(x) + 3) // 2)
        for r in packed_sums(df, x, y).collect():  # one row per pair of features
            sums[r["at"]] = r["total"]
        if not sums[0]:
            raise TidemarkError("no rows to fit")
        return solve_packed(sums, len(x), l2)
    row = df.agg(*_gram_sums(x, y)).first()
    if not row["n"]:
        raise TidemarkError("no rows to fit")
    return _solve(row, len(x), l2)


def linear_prediction(x: Sequence[str], beta: Sequence[float]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) * float(b) for c, b in zip(x, beta)])


def walk_forward_ridge(df: DataFrame, x: Sequence[str], y: str, l2s: Sequence[float], rank: str = "chronological_rank",
                       min_rows: int = 1) -> DataFrame:
    """Predictions of every rank by a fit on earlier ranks only, for each penalty.

    The sums of each rank are added up once; a running sum over ranks then gives every fold its training
    sums, so the work is linear in the rows however many folds there are.
    """
    p = len(x)
    if p > NARROW:
        return _walk_forward_wide(df, x, y, l2s, rank, min_rows)
    per_rank = df.groupBy(rank).agg(*_gram_sums(x, y))
    before = W.orderBy(rank).rowsBetween(W.unboundedPreceding, -1)  # one row per round of the calendar
    sums = [c for c in per_rank.columns if c != rank]
    folds = per_rank.select(rank, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in sums])
    folds = folds.filter(F.col("n") >= min_rows).withColumn("l2", F.explode(F.array(*[F.lit(float(v)) for v in l2s])))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            betas = [list(_solve(row, p, row["l2"])) for _, row in pdf.iterrows()]
            yield pd.DataFrame({rank: pdf[rank], "l2": pdf["l2"], "beta": betas})

    kind = dict(df.dtypes)[rank]
    fitted = folds.mapInPandas(solve, f"`{rank}` {kind}, l2 double, beta array<double>")
    prediction = reduce(lambda a, b: a + b, [F.col(c) * F.get("beta", F.lit(i)) for i, c in enumerate(x)])
    return df.join(fitted, rank).withColumn("prediction", prediction)


def _walk_forward_wide(df: DataFrame, x: Sequence[str], y: str, l2s: Sequence[float], rank: str, min_rows: int) -> DataFrame:
    p = len(x)
    folds = packed_folds(packed_sums(df, x, y, rank)).filter(F.get("sums", F.lit(0)) >= min_rows)
    folds = folds.withColumn("l2", F.explode(F.array(*[F.lit(float(v)) for v in l2s])))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            betas = [solve_packed(s, p, v).tolist() for s, v in zip(pdf["sums"], pdf["l2"])]
            yield pd.DataFrame({rank: pdf["rank"], "l2": pdf["l2"], "beta": betas})

    kind = dict(df.dtypes)[rank]
    fitted = folds.mapInPandas(solve, f"`{rank}` {kind}, l2 double, beta array<double>")
    # One fold per row of a bounded calendar, but p numbers each: joined by measure, and multiplied as arrays.
    features = F.array(*[F.col(c).cast("double") for c in x])
    product = F.aggregate(F.zip_with(features, F.col("beta"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return df.join(small(fitted), rank).withColumn("prediction", product)


# -- softmax -----------------------------------------------------------------------------------------

def fit_softmax(df: DataFrame, x: Sequence[str], y: str, n_classes: int, l2: float, steps: int = 30,
                tolerance: float = 1e-9) -> np.ndarray:
    """Multinomial weights minimising mean negative log likelihood plus l2/n times their squared sum.

    Each Newton step is one pass: tasks add up their gradient and Hessian, the driver adds the partials.
    """
    p, k = len(x), n_classes
    used = df.select(*[F.col(c).cast("double") for c in x], F.col(y).cast("int").alias("_y")).persist(StorageLevel.MEMORY_AND_DISK)
    weights = np.zeros((p, k))
    try:
        for _ in range(steps):
            current = weights.copy()

            def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                n, grad, hess = 0, np.zeros((p, k)), np.zeros((p * k, p * k))
                for pdf in batches:
                    m = pdf[list(x)].to_numpy()
                    logits = m @ current
                    probs = np.exp(logits - logits.max(axis=1, keepdims=True))
                    probs /= probs.sum(axis=1, keepdims=True)
                    n += len(m)
                    grad += m.T @ (probs - np.eye(k)[pdf["_y"].to_numpy()])
                    for a in range(k):
                        for b in range(a, k):
                            w = probs[:, a] * ((a == b) - probs[:, b])
                            block = m.T @ (m * w[:, None])
                            hess[a * p:(a + 1) * p, b * p:(b + 1) * p] += block
                            if a != b:
                                hess[b * p:(b + 1) * p, a * p:(a + 1) * p] += block.T
                flat = np.concatenate([[float(n)], grad.T.ravel(), hess.ravel()])
                yield pd.DataFrame({"i": np.arange(len(flat)), "v": flat})

            sums = used.mapInPandas(partial, "i int, v double").groupBy("i").agg(F.sum("v")).collect()
            flat = np.zeros(1 + p * k + (p * k) ** 2)
            for i, v in sums:
                flat[i] = v
            if flat[0] == 0:
                raise TidemarkError("no rows to fit")
            theta = weights.T.ravel()
            grad = flat[1:1 + p * k] + 2 * l2 * theta
            hess = flat[1 + p * k:].reshape(p * k, p * k) + 2 * l2 * np.eye(p * k)
            step = np.linalg.solve(hess, grad)
            weights = (theta - step).reshape(k, p).T
            if np.max(np.abs(step)) < tolerance:
                break
    finally:
        used.unpersist()
    return weights


# -- team strength -----------------------------------------------------------------------------------

def fit_team_strength(matches: DataFrame, as_of: str, teams: Sequence[str] = (), ridge: float = 0.01) -> tuple[DataFrame, float]:
    """Time-weighted Poisson attack and defence per team, and the home advantage.

    Matches: kickoff, home_team, away_team, home_goals, away_goals, home_xg, away_xg. A team without
    matches takes the fixed prior. Returns (team, attack, defence) and the home advantage.
    """
    days = F.timestamp_diff("SECOND", F.col("kickoff"), F.expr(f"TIMESTAMP_NTZ '{as_of}'")) / F.lit(86400.0)
    xg = F.col("home_xg").isNotNull() & F.col("away_xg").isNotNull()
    base = matches.withColumn("w", decay_weight(days, xg))
    shared = ["w"]
    home = base.select(F.col("home_team").alias("attacker"), F.col("away_team").alias("defender"),
                       F.when(xg, F.col("home_xg")).otherwise(F.col("home_goals")).cast("double").alias("goals"),
                       F.lit(1.0).alias("at_home"), *shared)
    away = base.select(F.col("away_team").alias("attacker"), F.col("home_team").alias("defender"),
                       F.when(xg, F.col("away_xg")).otherwise(F.col("away_goals")).cast("double").alias("goals"),
                       F.lit(0.0).alias("at_home"), *shared)
    # Rows alike in everything the likelihood sees are added up: the fit then runs on pairs of teams.
    rows = home.unionByName(away).groupBy("attacker", "defender", "at_home").agg(
        F.sum("w").alias("weight"), (F.sum(F.col("w") * F.col("goals")) / F.sum("w")).alias("goals")
    ).filter(F.col("weight") > 1e-12).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        indexers = [StringIndexer(inputCol=c, outputCol=f"{c}_i", stringOrderType="alphabetAsc").fit(rows)
                    for c in ("attacker", "defender")]
        indexed = reduce(lambda d, m: m.transform(d), indexers, rows)
        encoder = OneHotEncoder(inputCols=["attacker_i", "defender_i"], outputCols=["a_v", "d_v"], dropLast=False).fit(indexed)
        ready = VectorAssembler(inputCols=["a_v", "d_v", "at_home"], outputCol="features").transform(encoder.transform(indexed))
        glm = GeneralizedLinearRegression(family="poisson", link="log", weightCol="weight", labelCol="goals",
                                          fitIntercept=False, regParam=ridge, maxIter=50)
        coefficients = glm.fit(ready).coefficients.toArray()
    finally:
        rows.unpersist()
    attackers, defenders = indexers[0].labels, indexers[1].labels
    attack = {t: float(coefficients[i]) for i, t in enumerate(attackers)}
    defence = {t: float(coefficients[len(attackers) + i]) for i, t in enumerate(defenders)}
    known = sorted(set(attack) | set(defence) | set(teams))
    table = [
        (t, attack.get(t, NO_HISTORY_ATTACK), defence.get(t, NO_HISTORY_DEFENCE), t in attack or t in defence) for t in known
    ]
    spark = matches.sparkSession
    return spark.createDataFrame(table, "team string, attack double, defence double, has_history boolean"), float(coefficients[-1])


def match_rates(matches: DataFrame, strength: DataFrame, home_advantage: float) -> DataFrame:
    """Expected goals of both sides from the fitted strengths."""
    h = strength.select(F.col("team").alias("home_team"), F.col("attack").alias("_ha"), F.col("defence").alias("_hd"))
    a = strength.select(F.col("team").alias("away_team"), F.col("attack").alias("_aa"), F.col("defence").alias("_ad"))
    return (
        matches.join(small(h), "home_team").join(small(a), "away_team")
        .withColumn("home_rate", F.exp(F.col("_ha") + F.col("_ad") + home_advantage))
        .withColumn("away_rate", F.exp(F.col("_aa") + F.col("_hd")))
        .drop("_ha", "_hd", "_aa", "_ad")
    )


def fit_dependence(matches: DataFrame, weight: str = "w", points: int = 21, passes: int = 9) -> float:
    """Dependence parameter of the low scorelines by a shrinking grid; each pass is one aggregate."""
    # Rates belong to pairs of teams, so equal cells add up to a table of at most four rows per pair.
    low_cells = matches.filter((F.col("home_goals") <= 1) & (F.col("away_goals") <= 1)).groupBy(
        "home_goals", "away_goals", "home_rate", "away_rate"
    ).agg(F.sum(weight).alias(weight)).persist(StorageLevel.MEMORY_AND_DISK)
    low, high = RHO_BOUNDS
    best = 0.0
    try:
        for _ in range(passes):
            grid = [float(v) for v in np.linspace(low, high, points)]
            tried = low_cells.withColumn("_rho", F.explode(F.array(*[F.lit(v) for v in grid])))
            tau = low_score_factor(F.col("home_goals"), F.col("away_goals"), F.col("home_rate"), F.col("away_rate"), F.col("_rho"))
            scored = tried.groupBy("_rho").agg(
                F.sum(F.col(weight) * F.ln(F.when(tau > 0, tau))).alias("value"), F.count_if(tau <= 0).alias("impossible")
            ).collect()  # one row per grid point
            value = {r["_rho"]: r["value"] for r in scored if not r["impossible"]}
            if not value:
                return 0.0
            best = max(sorted(value), key=value.get)
            at = grid.index(best)
            low, high = grid[max(0, at - 1)], grid[min(points - 1, at + 1)]
    finally:
        low_cells.unpersist()
    return best


def residual_profile(df: DataFrame, y: str, prediction: str, key: Sequence[str] = ()) -> DataFrame:
    residual = F.col(y) - F.col(prediction)
    return df.groupBy(*key).agg(F.avg(residual).alias("residual_mean"), F.stddev_pop(residual).alias("residual_std"),
                                F.skewness(residual).alias("residual_skewness"))


# -- isotonic calibration ----------------------------------------------------------------------------

def equal_count_bins(df: DataFrame, n_bins: int, order: Sequence[str], out: str = "bin") -> DataFrame:
    """Bin by rank: floor(position * bins / rows)."""
    n = df.count()
    if n == 0:
        raise TidemarkError("no rows to bin")
    bins = max(1, min(n_bins, n))
    placed = row_positions(df, [], list(order), "_pos")
    return placed.withColumn(out, F.expr(f"least((_pos * {bins}) div {n}, {bins - 1})").cast("int")).drop("_pos")


def isotonic_bins(df: DataFrame, p: str, y: str, tie: Sequence[str], n_bins: int = ISOTONIC_BINS) -> DataFrame:
    """Mean prediction, smoothed rate and size of each equal-count bin."""
    binned = equal_count_bins(df.select(p, y, *tie), n_bins, [p, *tie])
    return binned.groupBy("bin").agg(
        F.avg(p).alias("x"), ((F.sum(y) + 0.5) / (F.count("*") + 1.0)).alias("rate"), F.count("*").cast("double").alias("weight")
    )


def fit_isotonic(df: DataFrame, p: str, y: str, tie: Sequence[str], n_bins: int = ISOTONIC_BINS) -> DataFrame:
    """Knots of a non-decreasing calibration curve, one per bin: (bin, x, rate, weight, fitted)."""
    bins = isotonic_bins(df, p, y, tie, n_bins).persist()
    model = IsotonicRegression(featuresCol="x", labelCol="rate", weightCol="weight", predictionCol="fitted").fit(bins)
    return model.transform(bins)


def knots(fitted: DataFrame) -> list[tuple[float, float]]:
    """The curve as literals; it has at most one knot per bin."""
    return sorted((r["x"], r["fitted"]) for r in fitted.select("x", "fitted").collect())


# -- folds -------------------------------------------------------------------------------------------

def inner_split(train: DataFrame, rank: str = "chronological_rank", fraction: float = HOLDOUT_FRACTION,
                min_holdout: int = MIN_HOLDOUT_ROWS, min_inner: int = MIN_INNER_ROWS) -> tuple[DataFrame, DataFrame] | None:
    """Hold out the last fifth of the ranks, or nothing when either side would be too small."""
    sizes = sorted((r[rank], r["n"]) for r in train.groupBy(rank).agg(F.count("*").alias("n")).collect())  # one per round
    if len(sizes) < 2:
        return None
    held = min(max(1, round(len(sizes) * fraction)), len(sizes) - 1)
    cutoff = sizes[-held][0]
    inner = sum(n for r, n in sizes if r < cutoff)
    if inner < min_inner or sum(n for _, n in sizes) - inner < min_holdout:
        return None
    return train.filter(F.col(rank) < cutoff), train.filter(F.col(rank) >= cutoff)


def walk_forward_rates(df: DataFrame, rank: str, condition: Column, key: Sequence[str] = (), min_rows: int = 1) -> DataFrame:
    """Per fold and group: share of an outcome over strictly earlier folds, the overall share as fallback.

    Folds are reduced to one row first, so the running sums see the calendar and not the rows.
    """
    group = list(key)
    cells = df.groupBy(rank, *group).agg(F.count("*").alias("_n"), F.sum(condition.cast("double")).alias("_s"))
    whole = cells.groupBy(rank).agg(F.sum("_n").alias("_an"), F.sum("_s").alias("_as"))
    past = W.orderBy(rank).rowsBetween(W.unboundedPreceding, -1)
    overall = whole.select(rank, F.sum("_an").over(past).alias("train_rows"), (F.sum("_as").over(past) / F.sum("_an").over(past)).alias("overall_rate"))
    if not group:
        return overall.filter(F.col("train_rows") >= min_rows).withColumn("rate", F.col("overall_rate"))
    own = W.partitionBy(*group).orderBy(rank).rowsBetween(W.unboundedPreceding, -1)
    rated = cells.select(rank, *group, (F.sum("_s").over(own) / F.sum("_n").over(own)).alias("_r"))
    return rated.join(overall, rank).filter(F.col("train_rows") >= min_rows).select(
        rank, *group, "train_rows", "overall_rate", F.coalesce("_r", "overall_rate").alias("rate")
    )


def walk_forward_logistic(df: DataFrame, x: str, y: str, folds: Sequence[int], rank: str = "fold", steps: int = 12) -> dict:
    """One-feature logistic fits for all folds at once: a Newton step sums every fold's rows in one pass."""
    cells = df.groupBy(rank, x).agg(F.count("*").alias("_n"), F.sum(F.col(y).cast("double")).alias("_y")).persist()
    betas = {f: np.zeros(2) for f in folds}
    try:
        for _ in range(steps):
            sums = []
            for f in folds:
                pi = 1 / (1 + F.exp(-(float(betas[f][0]) + float(betas[f][1]) * F.col(x))))
                r, w = F.col("_y") - F.col("_n") * pi, F.col("_n") * pi * (1 - pi)
                for i, v in enumerate((r, r * F.col(x), w, w * F.col(x), w * F.col(x) * F.col(x))):
                    sums.append(F.sum(F.when(F.col(rank) < f, v).otherwise(0.0)).alias(f"s{i}_{f}"))
            row = cells.agg(*sums).first()
            moved = 0.0
            for f in folds:
                r0, r1, w0, w1, w2 = (row[f"s{i}_{f}"] for i in range(5))
                step = np.linalg.solve(np.array([[w0, w1], [w1, w2]]) + np.eye(2) * 1e-8, np.array([r0, r1]))
                betas[f] = betas[f] + step
                moved = max(moved, float(np.max(np.abs(step))))
            if moved < 1e-10:
                break
    finally:
        cells.unpersist()
    return betas
