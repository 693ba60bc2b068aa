"""Scoring rules, calibration and verdicts against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fitting as fi
from tidemark.operators import metrics as me
from tidemark.session import TidemarkError


@pytest.fixture(scope="module")
def predictions(spark):
    rng = np.random.default_rng(3)
    p = rng.random(3000) ** 2
    y = (rng.random(3000) < 0.2 + 0.6 * p).astype(int)
    pdf = pd.DataFrame({"id": np.arange(3000), "p": p, "y": y, "grp": rng.integers(0, 3, 3000)})
    return pdf, spark.createDataFrame(pdf).cache()


def newton(y, p):
    x = np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    m, beta = np.column_stack([np.ones_like(x), x]), np.zeros(2)
    for _ in range(40):
        pi = 1 / (1 + np.exp(-m @ beta))
        h = (m * (pi * (1 - pi))[:, None]).T @ m
        beta = beta + np.linalg.solve(h, m.T @ (y - pi))
    return beta[1], beta[0], np.sqrt(np.linalg.inv(h)[1, 1])


def test_hand_computed_scores(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0), (1, 0.5)], "y int, p double")
    row = me.scores(df).first()
    assert row["log_loss"] == pytest.approx((np.log(2) + 2e-12) / 3)
    assert row["brier"] == pytest.approx(0.25 / 3)


def test_rps_is_brier_for_two_classes(predictions):
    _, df = predictions
    two = df.withColumn("probs", F.array(1 - F.col("p"), F.col("p")))
    rps = two.agg(me.ranked_probability_score(F.col("y"), F.col("probs"))).first()[0]
    assert rps == pytest.approx(me.scores(df).first()["brier"])


def test_rps_needs_sums_of_one(spark):
    df = spark.createDataFrame([(0, [0.5, 0.4])], "y int, probs array<double>")
    with pytest.raises(Exception, match="sum of 1"):
        df.agg(me.ranked_probability_score(F.col("y"), F.col("probs"))).collect()


def test_last_bin_is_closed_and_edges_belong_to_the_right(spark):
    edges = [i / 10 for i in range(11)]
    df = spark.createDataFrame([(e, 1) for e in edges], "p double, y int")
    got = {r["p"]: r["b"] for r in df.select("p", me.width_bin(F.col("p"), 10).alias("b")).collect()}
    assert [got[e] for e in edges] == [*range(10), 9]


def test_quantile_bins_with_ties(spark):
    p = [0.2] * 50 + [0.7] * 10
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(p)], "p double, y int")
    bins = me.reliability(df, 10, "quantile").orderBy("bin").collect()
    assert sum(r["n"] for r in bins) == 60
    assert bins[0]["bin_lo"] == 0.0 and bins[-1]["bin_hi"] == 1.0


def test_slope_against_numpy(predictions):
    pdf, df = predictions
    got = {r["grp"]: r for r in me.calibration_slope(df, "grp").collect()}
    for g, part in pdf.groupby("grp"):
        want = newton(part["y"].to_numpy(), part["p"].to_numpy())
        np.testing.assert_allclose([got[g]["slope"], got[g]["intercept"], got[g]["slope_se"]], want, rtol=1e-6)


def verdict(spark, usable, beats, departs, built, text="stated"):
    df = spark.createDataFrame([(usable, beats, departs, built, text)],
                               "slope_usable boolean, beats_baselines boolean, departs_from_one boolean, calibrator_built boolean, decision_text string")
    return me.verdicts(df).first()["verdict"]


def test_verdict_order(spark):
    assert verdict(spark, False, True, True, True, "") == "BASE-RATE-ONLY"
    assert verdict(spark, True, False, True, True) == "FAIL"
    assert verdict(spark, True, True, True, False) == "PASS-with-accepted-departure"
    assert verdict(spark, True, True, True, True) == "PASS"
    assert verdict(spark, True, True, False, False, "") == "PASS"
    with pytest.raises(Exception, match="stated decision"):
        verdict(spark, True, True, True, True, "  ")


def test_feature_value_needs_equal_rows(spark):
    a = spark.createDataFrame([(1, 1, 0.5), (2, 0, 0.4)], "id int, y int, p double")
    with pytest.raises(TidemarkError, match="only one"):
        me.feature_value(a, a.filter("id = 1"), "id")


# -- fitting -----------------------------------------------------------------------------------------

def pava(rate, weight):
    blocks = []
    for r, w in zip(rate, weight):
        blocks.append([r, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return [b[0] for b in blocks for _ in range(b[2])]


def test_isotonic_against_pava(predictions):
    pdf, df = predictions
    got = fi.fit_isotonic(df, "p", "y", ["id"]).orderBy("bin").toPandas()
    s = pdf.sort_values(["p", "id"]).reset_index(drop=True)
    bins = s.groupby(s.index * 20 // len(s))
    rate, weight = (bins["y"].sum() + 0.5) / (bins.size() + 1), bins.size()
    np.testing.assert_allclose(got["x"], bins["p"].mean())
    np.testing.assert_allclose(got["fitted"], pava(rate, weight))
    assert got["fitted"].is_monotonic_increasing and got["fitted"].between(0, 1, inclusive="neither").all()


def test_one_row_per_bin(spark):
    df = spark.createDataFrame([(1, 0.1, 0), (2, 0.5, 1), (3, 0.9, 1)], "id int, p double, y int")
    assert [r["fitted"] for r in fi.fit_isotonic(df, "p", "y", ["id"]).orderBy("bin").collect()] == pytest.approx([0.25, 0.75, 0.75])


def test_ridge_and_walk_forward_against_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 2))
    pdf = pd.DataFrame({"one": 1.0, "a": x[:, 0], "b": x[:, 1], "y": x @ [2.0, -1.0] + 0.3 + rng.normal(size=400), "rank": np.sort(rng.integers(0, 12, 400))})
    df = spark.createDataFrame(pdf)
    names = ["one", "a", "b"]

    def direct(rows, l2):
        m = rows[names].to_numpy()
        return np.linalg.solve(m.T @ m + l2 * np.eye(3), m.T @ rows["y"].to_numpy())

    np.testing.assert_allclose(fi.fit_ridge(df, names, "y", 0.7), direct(pdf, 0.7))
    got = fi.walk_forward_ridge(df, names, "y", [0.1, 5.0], "rank", 40).toPandas()
    for (rank, l2), part in got.groupby(["rank", "l2"]):
        train = pdf[pdf["rank"] < rank]
        assert len(train) >= 40
        np.testing.assert_allclose(part["prediction"], part[names].to_numpy() @ direct(train, l2))
    assert got["rank"].min() > 0


def test_softmax_gradient_is_zero(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([np.ones(500), rng.normal(size=500)])
    y = rng.integers(0, 3, 500)
    df = spark.createDataFrame(pd.DataFrame({"one": x[:, 0], "a": x[:, 1], "cls": y}))
    w = fi.fit_softmax(df, ["one", "a"], "cls", 3, 1.0)
    logits = x @ w
    probs = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    assert np.abs(x.T @ (probs - np.eye(3)[y]) + 2 * w).max() < 1e-6


def test_walk_forward_logistic_against_numpy(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"fold": rng.integers(0, 5, 900), "x": rng.integers(0, 10, 900) / 5})
    pdf["y"] = (rng.random(900) < 1 / (1 + np.exp(1 - pdf["x"]))).astype(int)
    betas = fi.walk_forward_logistic(spark.createDataFrame(pdf), "x", "y", [2, 4], steps=20)
    for fold, beta in betas.items():
        part = pdf[pdf["fold"] < fold]
        p = 1 / (1 + np.exp(-part["x"]))  # the logit of this is x itself
        slope, intercept, _ = newton(part["y"].to_numpy(), p.to_numpy())
        np.testing.assert_allclose(beta, [intercept, slope], rtol=1e-5)


def test_dependence_is_recovered(spark):
    rho, lam, mu = -0.1, 1.2, 0.9
    cells = {(0, 0): 1 - lam * mu * rho, (0, 1): 1 + lam * rho, (1, 0): 1 + mu * rho, (1, 1): 1 - rho}
    base = {(h, a): lam**h * mu**a for h in (0, 1) for a in (0, 1)}
    rows = [(h, a, lam, mu, base[(h, a)] * t) for (h, a), t in cells.items()] + [(3, 2, lam, mu, 9.0)]
    df = spark.createDataFrame(rows, "home_goals int, away_goals int, home_rate double, away_rate double, w double")
    assert fi.fit_dependence(df) == pytest.approx(rho, abs=1e-4)


def test_team_strength_is_recovered(spark):
    from datetime import datetime

    rng = np.random.default_rng(2)
    attack, defence = {"A": 0.4, "B": 0.0, "C": -0.4}, {"A": -0.2, "B": 0.0, "C": 0.2}
    rows = []
    for i in range(3000):
        h, a = rng.choice(list("ABC"), 2, replace=False)
        rows.append((datetime(2024, 1, 1), str(h), str(a), int(rng.poisson(np.exp(attack[h] + defence[a] + 0.3))),
                     int(rng.poisson(np.exp(attack[a] + defence[h]))), None, None))
    df = spark.createDataFrame(rows, "kickoff timestamp_ntz, home_team string, away_team string, home_goals int, away_goals int, home_xg double, away_xg double")
    strength, advantage = fi.fit_team_strength(df, "2024-01-02 00:00:00", teams=["NEW"], ridge=0.0001)
    got = {r["team"]: r for r in strength.collect()}
    assert advantage == pytest.approx(0.3, abs=0.1)
    assert got["A"]["attack"] - got["C"]["attack"] == pytest.approx(0.8, abs=0.15)
    assert got["C"]["defence"] - got["A"]["defence"] == pytest.approx(0.4, abs=0.15)
    assert (got["NEW"]["attack"], got["NEW"]["defence"]) == (fi.NO_HISTORY_ATTACK, fi.NO_HISTORY_DEFENCE)


def test_inner_split_guards(spark):
    df = spark.createDataFrame([(r, i) for r in range(10) for i in range(5)], "chronological_rank int, i int")
    inner, held = fi.inner_split(df, min_holdout=5, min_inner=5)
    assert (inner.count(), held.count()) == (40, 10)
    assert fi.inner_split(df) is None
    assert fi.inner_split(df.filter("chronological_rank = 1"), min_holdout=1, min_inner=1) is None
