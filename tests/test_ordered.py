"""Ordered passes on a table in which one key holds most rows."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import ordered as od


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({
        "key": np.where(rng.random(4000) < 0.6, 0, rng.integers(1, 40, 4000)),
        "at": rng.permutation(4000), "v": rng.integers(0, 9, 4000),
    })
    return pdf, spark.createDataFrame(pdf).repartition(7).cache()


def joined(df, columns):
    return df.toPandas().sort_values("at").reset_index(drop=True)[columns]


def test_running_total(skewed):
    pdf, df = skewed
    got = joined(od.running_total(df, ["key"], ["at"], "v", "out"), ["at", "out"])
    want = pdf.sort_values("at").reset_index(drop=True)
    assert (got["out"] == want.groupby("key")["v"].cumsum()).all()


def test_positions_without_key(skewed):
    _, df = skewed
    got = joined(od.row_positions(df, [], ["at"], "pos"), ["at", "pos"])
    assert (got["at"] == got["pos"]).all()


def test_previous_value(skewed):
    pdf, df = skewed
    got = joined(od.previous_value(df, ["key"], ["at"], "v", "out"), ["out"])["out"]
    want = pdf.sort_values("at").reset_index(drop=True).groupby("key")["v"].shift(1)
    pd.testing.assert_series_equal(got, want, check_names=False, check_dtype=False)


@pytest.mark.parametrize("chunk", [6, 50, 100_000])
def test_trailing_mean_rows(skewed, chunk):
    pdf, df = skewed
    got = joined(od.trailing_mean_rows(df, ["key"], ["at"], {"out": "v"}, 5, chunk), ["out"])["out"]
    want = (pdf.sort_values("at").reset_index(drop=True).groupby("key")["v"]
            .transform(lambda s: s.shift(1).rolling(5, min_periods=1).mean()))
    pd.testing.assert_series_equal(got, want, check_names=False)


def test_exact_percentiles(skewed):
    pdf, df = skewed
    got = od.exact_percentiles(df, ["key"], "v", [0.1, 0.5, 0.77], ["a", "b", "c"]).toPandas().set_index("key").sort_index()
    want = pdf.groupby("key")["v"].quantile([0.1, 0.5, 0.77]).unstack()
    np.testing.assert_allclose(got[["a", "b", "c"]].to_numpy(), want.to_numpy())


def test_null_keys_are_kept(spark):
    df = spark.createDataFrame([(None, 1, 10), (None, 2, 20), ("a", 1, 1), ("a", 2, 2)], "k string, t int, v int")
    total = {(r["k"], r["t"]): r["x"] for r in od.running_total(df, ["k"], ["t"], "v", "x").collect()}
    assert total == {(None, 1): 10, (None, 2): 30, ("a", 1): 1, ("a", 2): 3}
    before = {(r["k"], r["t"]): r["x"] for r in od.previous_value(df, ["k"], ["t"], "v", "x").collect()}
    assert before == {(None, 1): None, (None, 2): 10, ("a", 1): None, ("a", 2): 1}
    assert {(r["k"], r["m"]) for r in od.exact_percentiles(df, ["k"], "v", [0.5], ["m"]).collect()} == {(None, 15.0), ("a", 1.5)}
