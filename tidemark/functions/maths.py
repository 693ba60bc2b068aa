"""Scalar mathematics as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Decay and source weight of match evidence, and the support of a scoreline.
HALF_LIFE_DAYS = 180.0
GOALS_SOURCE_WEIGHT = 0.6
MAX_GOALS = 10


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def half_up(x: Column, places: int = 0) -> Column:
    """``round(x, places)`` of a double, the same value for a fraction of the time.

    ``round`` writes every number out as decimal digits. Away from a tie the nearest whole number of units is the same, and
    its quotient is the double nearest to those digits; near a tie, beyond 2^40 units and for NaN ``round`` itself decides.
    """
    x = x.cast("double")
    units = x * F.lit(10.0 ** places)
    near = F.rint(units)
    plain = (F.abs(units) < float(1 << 40)) & (F.abs(units - near) < 0.499)
    return F.when(plain, near / F.lit(10.0 ** places) + F.lit(0.0)).otherwise(F.round(x, places))


def decay_weight(days: Column, from_xg: Column) -> Column:
    """Exponential time decay times the weight of the evidence's source."""
    return F.exp(-F.ln(F.lit(2.0)) * days / HALF_LIFE_DAYS) * F.when(from_xg, 1.0).otherwise(GOALS_SOURCE_WEIGHT)


def _ln_factorial(n: Column) -> Column:
    """ln(n!) as a sum, for counts beyond the range of ``factorial``."""
    return F.aggregate(F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), n.cast("bigint"))).otherwise(F.expr("CAST(array() AS ARRAY<BIGINT>)")),
                       F.lit(0.0), lambda total, i: total + F.ln(i.cast("double")))


def poisson(k: Column, rate: Column) -> Column:
    """Mass at k; above 20 by logarithms."""
    rate = F.greatest(rate, F.lit(1e-12))
    return F.when(k <= 20, F.exp(-rate) * F.pow(rate, k) / F.factorial(F.least(k, F.lit(20)))).otherwise(
        F.exp(k * F.ln(rate) - rate - _ln_factorial(k)))


def low_score_factor(h: Column, a: Column, home: Column, away: Column, rho: Column) -> Column:
    """Dependence correction of the four lowest scorelines."""
    return (
        F.when((h == 0) & (a == 0), 1 - home * away * rho).when((h == 0) & (a == 1), 1 + home * rho)
        .when((h == 1) & (a == 0), 1 + away * rho).when((h == 1) & (a == 1), 1 - rho).otherwise(1.0)
    )


def binomial(k: Column, n: Column, p: Column) -> Column:
    """Mass at k of n trials; above 20 trials by logarithms."""
    kept = F.greatest(n - k, F.lit(0))
    few, low = F.lit(20), lambda x: F.least(x, F.lit(20))
    ways = F.factorial(low(n)) / (F.factorial(low(k)) * F.factorial(low(kept)))
    many = F.exp(_ln_factorial(n) - _ln_factorial(k) - _ln_factorial(kept))
    return F.when(k > n, 0.0).otherwise(F.when(n <= few, ways).otherwise(many) * F.pow(p, k) * F.pow(1 - p, kept))


def _negative_binomial(mean: np.ndarray, r: np.ndarray, max_count: int) -> np.ndarray:
    """Masses at 0..max_count of a batch of rows by p(k+1) = p(k) (k+r)/(k+1) (1-p); a zero mean stays at 0."""
    p = r / (r + mean)
    out = np.empty((len(mean), max_count + 1))
    out[:, 0] = p ** r
    for k in range(max_count):
        out[:, k + 1] = out[:, k] * (k + r) / (k + 1) * (1 - p)
    return out


def negative_binomial(mean: Column, r: Column, max_count: int) -> Column:
    """Unnormalised masses at 0..max_count as an array. There is no log-gamma in Spark SQL; the recurrence
    runs on whole Arrow batches, far faster than as an interpreted array fold."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def batch(mean: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(list(_negative_binomial(mean.to_numpy(float), r.to_numpy(float), max_count)))

    return batch(mean, r)


def mixed_negative_binomial(rate: Column, r: Column, weights: Column, minutes: Sequence[float], max_count: int) -> Column:
    """Normalised masses mixed over minutes played: the mean scales with minutes/90, each part sums to one."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def batch(rate: pd.Series, r: pd.Series, weights: pd.Series) -> pd.Series:
        rates, shape, w = rate.to_numpy(float), r.to_numpy(float), np.stack(weights.to_numpy())
        total = np.zeros((len(rates), max_count + 1))
        for i, m in enumerate(minutes):
            part = _negative_binomial(rates * m / 90.0, shape, max_count)
            total += w[:, [i]] * part / part.sum(axis=1, keepdims=True)
        return pd.Series(list(total / total.sum(axis=1, keepdims=True)))

    return batch(rate, r, weights)


def mixed_binomial(share: Column, weights: Column, minutes: Sequence[float], goals: Column, max_count: int) -> Column:
    """Binomial masses mixed over minutes played (weights) and team goals (a dense distribution from 0)."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def batch(share: pd.Series, weights: pd.Series, goals: pd.Series) -> pd.Series:
        s, w = share.to_numpy(float), np.stack(weights.to_numpy())
        width = max(len(g) for g in goals)
        g = np.stack([np.pad(np.asarray(x, float), (0, width - len(x))) for x in goals])
        total = np.zeros((len(s), max_count + 1))
        for i, m in enumerate(minutes):
            p = np.clip(s * min(max(m, 0.0), 90.0) / 90.0, 0.0, 1.0)
            for n in range(width):
                for k in range(min(n, max_count) + 1):
                    total[:, k] += w[:, i] * g[:, n] * math.comb(n, k) * p**k * (1 - p) ** (n - k)
        return pd.Series(list(total / total.sum(axis=1, keepdims=True)))

    return batch(share, weights, goals)


def softmax(logits: Sequence[Column]) -> list[Column]:
    top = F.greatest(*logits)
    parts = [F.exp(x - top) for x in logits]
    total = sum(parts[1:], parts[0])
    return [x / total for x in parts]


def offset_softmax(first: Column, second: Column, offset: Column) -> list[Column]:
    """Three classes, the first the reference, the others sharing an exposure offset."""
    return softmax([F.lit(0.0) + first * 0, first + offset, second + offset])


def interpolate(x: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Piecewise-linear through a short list of knots, flat outside them."""
    out = F.when(x <= knots[0][0], F.lit(knots[0][1]))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        if x1 > x0:
            out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(knots[-1][1]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it inside ``body``.

    A lambda re-evaluates the outer expressions it mentions for every element; a bound variable is free.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def scaled(values: Column) -> Column:
    """An array divided by its sum."""
    return let(values, lambda v: let(array_sum(v), lambda total: F.transform(v, lambda x: x / total)))
