"""Class models walked forward, grouped quantile bins and grouped slopes, beside NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import class_models as cm
from tidemark.operators import metrics as me
from tidemark.session import TidemarkError

FOLDS = [1, 2, 3, 4, 5, 6]
X = ["one", "a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    n = 1400
    pdf = pd.DataFrame({"fold": rng.integers(0, 7, n), "one": 1.0, "a": rng.normal(size=n), "b": rng.integers(0, 4, n) / 2})
    logits = np.column_stack([np.zeros(n), 0.8 * pdf.a - 0.3, 0.5 * pdf.b - pdf.a * 0.4])
    probs = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    pdf["y"] = [int(rng.choice(3, p=p)) for p in probs]
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


def newton(pdf, l2, k=3):
    m, hot, theta = pdf[X].to_numpy(), np.eye(k)[pdf.y], np.zeros(3 * k)
    for _ in range(80):
        logits = m @ theta.reshape(3, k)
        probs = np.exp(logits - logits.max(axis=1, keepdims=True))
        probs /= probs.sum(axis=1, keepdims=True)
        gradient = (m.T @ (probs - hot)).ravel() + 2 * l2 * theta
        hessian = np.einsum("np,nq,nkl->pkql", m, m, np.eye(k) * probs[:, :, None] - probs[:, :, None] * probs[:, None, :]).reshape(3 * k, 3 * k)
        theta = theta - np.linalg.lstsq(hessian + 2 * l2 * np.eye(3 * k), gradient, rcond=1e-12)[0]
    return theta


def test_six_folds_and_three_penalties_agree_with_numpy(rows):
    pdf, df = rows
    fits = {(r["fold"], r["l2"]): r for r in cm.fit_class_folds(df, X, "y", 3, [0.0, 0.5, 50.0], FOLDS).collect()}
    assert set(fits) == {(f, v) for f in FOLDS for v in (0.0, 0.5, 50.0)}
    for (fold, l2), fit in fits.items():
        train = pdf[pdf.fold < fold]
        assert fit["converged"] and fit["n"] == len(train) and fit["gradient"] < 1e-6
        want = newton(train, l2)
        got = np.array(fit["weights"])
        if l2 == 0:  # only differences of classes are determined
            want, got = (v.reshape(3, 3) - v.reshape(3, 3)[:, :1] for v in (want, got))
        assert np.abs(got - want).max() < 1e-6


def test_predictions_use_earlier_ranks_only(rows):
    pdf, df = rows
    folds = [3, 5]
    fits = cm.fit_class_folds(df, X, "y", 3, [1.0], folds)
    got = cm.class_predictions(df, fits, X, 3, folds).toPandas()
    assert sorted(got.fold.unique()) == [3, 4, 5, 6] and len(got) == (pdf.fold >= 3).sum()
    weights = {r["fold"]: np.array(r["weights"]).reshape(3, 3) for r in fits.collect()}
    for r in got.head(50).itertuples():
        logits = np.array([r.one, r.a, r.b]) @ weights[3 if r.fold < 5 else 5]
        assert np.allclose(r.probs, np.exp(logits) / np.exp(logits).sum())
    changed = df.withColumn("y", F.when(F.col("fold") >= 3, 0).otherwise(F.col("y")))
    again = cm.fit_class_folds(changed, X, "y", 3, [1.0], [3]).first()
    assert np.allclose(again["weights"], weights[3].ravel(), atol=1e-9)


def test_penalty_path_picks_the_least_loss(rows):
    _, df = rows
    fits = cm.fit_class_folds(df, X, "y", 3, [0.1, 1e6], FOLDS)
    path = {r["l2"]: r for r in cm.penalty_path(cm.class_predictions(df, fits, X, 3, FOLDS)).collect()}
    assert path[0.1]["is_best"] and not path[1e6]["is_best"] and path[1e6]["log_loss"] == pytest.approx(np.log(3), abs=1e-3)
    assert path[0.1]["brier"] < path[1e6]["brier"]


def test_fits_of_odd_tables(spark, rows):
    _, df = rows
    assert cm.fit_class_folds(df.limit(0), X, "y", 3, [1.0], [1]).count() == 0
    assert cm.fit_class_folds(df, X, "y", 3, [1.0], [0, 1]).count() == 1  # nothing before rank 0
    holes = df.unionByName(df.limit(5).withColumn("a", F.lit(None).cast("double")))
    assert cm.fit_class_folds(holes, X, "y", 3, [1.0], [7]).first()["n"] == df.count()
    with pytest.raises(TidemarkError, match="classes run"):
        cm.fit_class_folds(df, X, "y", 2, [1.0], [3])
    separable = spark.createDataFrame([(0, 1.0, float(i), int(i > 4)) for i in range(10)], "fold int, one double, v double, y int")
    assert not cm.fit_class_folds(separable, ["one", "v"], "y", 2, [0.0], [1], max_steps=5).first()["converged"]


def test_quantile_bins_per_group(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c", None], 4000, p=[0.7, 0.2, 0.05, 0.05]), "p": np.round(rng.random(4000) ** 3, 3), "y": rng.integers(0, 2, 4000)})
    pdf = pd.concat([pdf, pd.DataFrame({"g": "one value", "p": 0.4, "y": [0, 1, 1]})])
    df = spark.createDataFrame(pdf.astype({"g": object}).where(pdf.notna(), None)).repartition(6)
    got = me.reliability(df, 10, "quantile", ["g"]).toPandas()
    for g, part in pdf.groupby("g", dropna=False):
        edges = np.unique(np.quantile(part.p, np.arange(11) / 10))
        edges[0], edges[-1] = 0.0, 1.0
        edges = edges if len(edges) > 1 else np.array([0.0, 1.0])
        at = np.searchsorted(edges[1:-1], part.p, side="right")
        mine = got[got.g.isna()] if g is None or g != g else got[got.g == g]
        assert sorted(mine.bin) == sorted(set(at)) and len(mine) > 0
        for r in mine.itertuples():
            held = part[at == r.bin]
            assert r.n == len(held) and r.mean_predicted == pytest.approx(held.p.mean()) and r.observed_rate == pytest.approx(held.y.mean())
            assert (r.bin_lo, r.bin_hi) == pytest.approx((edges[r.bin], edges[r.bin + 1]))


def test_slopes_of_ten_thousand_groups(spark):
    df = spark.range(400_000).selectExpr("id % 10000 as g", "(id * 7919 % 997 + 1) / 999D as p", "cast(id * 31 % 1009 < 300 + id * 7919 % 997 * 0.4 as int) as y")
    got = me.calibration_slope(df, "g")
    assert got.count() == 10_000
    pdf = df.filter("g in (3, 77, 9999)").toPandas()
    for r in got.filter("g in (3, 77, 9999)").collect():
        part = pdf[pdf.g == r["g"]]
        x = np.log(part.p / (1 - part.p))
        m, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
        for _ in range(60):
            pi = 1 / (1 + np.exp(-m @ beta))
            h = (m * (pi * (1 - pi))[:, None]).T @ m + 1e-8 * np.eye(2)
            beta = beta + np.linalg.solve(h, m.T @ (part.y - pi))
        assert r["converged"] and (r["intercept"], r["slope"]) == pytest.approx(tuple(beta), abs=1e-7)


def test_a_separated_group_is_not_converged(spark):
    df = spark.createDataFrame([("x", 0.2, 0), ("x", 0.9, 1), ("y", 0.2, 0), ("y", 0.3, 1), ("y", 0.8, 1), ("y", 0.9, 0)], "g string, p double, y int")
    got = {r["g"]: r["converged"] for r in me.calibration_slope(df, "g", max_steps=12).collect()}
    assert got == {"x": False, "y": True}
