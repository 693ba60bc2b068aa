"""Sparse design rows and packed sums beside NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fitting as fi, sparse as sp
from tidemark.session import TidemarkError


def test_a_hundred_thousand_levels(spark):
    df = spark.range(150_000).select("id", (F.col("id") % 100_000).alias("level"), F.lit("a").alias("one"))
    rows, columns = sp.sparse_design(df, [], ["one", "level"])
    assert columns.count() == 100_002
    got = rows.select("level", F.get("indices", F.lit(2)).alias("i"), F.size("indices").alias("n")).distinct().toPandas()
    assert len(got) == 100_000 and (got["n"] == 3).all()
    names = sorted(map(str, range(100_000)))
    assert dict(zip(got["level"].astype(str), got["i"])) == {name: i + 2 for i, name in enumerate(names)}


def test_sparse_rows_equal_dense_ones(spark):
    data = [(i, float(i % 7) if i % 5 else None, f"c{i % 4}" if i % 3 else None) for i in range(60)]
    rows, columns = sp.sparse_design(spark.createDataFrame(data, "id int, a double, c string"), ["a"], ["c"])
    a = np.array([d[1] for d in data if d[1] is not None])
    for r in rows.collect():
        want = {0: 1.0}
        if r["a"] is not None:
            want[1] = (r["a"] - a.mean()) / a.std()
        if r["c"] is not None:
            want[2 + int(r["c"][1])] = 1.0
        assert r["indices"] == sorted(want)
        np.testing.assert_allclose(r["values"], [want[i] for i in sorted(want)])
    assert [(r["name"], r["level"]) for r in columns.orderBy("index").collect()] == [
        ("intercept", None), ("a", None), *[("c", f"c{i}") for i in range(4)]]

    dense = np.zeros((60, 6))
    for r in rows.collect():
        dense[r["id"], r["indices"]] = r["values"]
    beta = np.arange(6.0) - 2
    table = spark.createDataFrame([(i, float(b)) for i, b in enumerate(beta)], "index long, coefficient double")
    scores = {r["id"]: r["score"] for r in sp.sparse_scores(rows, ["id"], table).collect()}
    np.testing.assert_allclose([scores[i] for i in range(60)], dense @ beta)
    gram, y = np.zeros((6, 6)), np.zeros(6)
    for r in sp.sparse_sums(rows, "id").collect():
        if r["j"] is None:
            y[r["i"]] = r["total"]
        else:
            gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["total"]
    np.testing.assert_allclose(gram, dense.T @ dense, atol=1e-9)
    np.testing.assert_allclose(y, dense.T @ np.arange(60.0), atol=1e-9)


def test_sparse_rows_of_odd_tables(spark):
    empty = spark.createDataFrame([], "a double, c string, values int")
    with pytest.raises(TidemarkError, match="taken"):
        sp.sparse_design(empty, ["a"], ["c"])
    rows, columns = sp.sparse_design(empty, ["a"], ["c"], "at", "v")
    assert rows.count() == 0 and columns.count() == 2


@pytest.mark.parametrize("held", [4_000_000, 1])
def test_fifty_features_against_numpy(spark, monkeypatch, held):
    monkeypatch.setattr(sp, "HELD", held)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 50))
    names = [f"f{i}" for i in range(50)]
    pdf = pd.DataFrame(x, columns=names).assign(y=x @ rng.normal(size=50) + rng.normal(size=900), rank=rng.integers(0, 8, 900))
    df = spark.createDataFrame(pdf).repartition(5)

    def direct(rows, l2):
        m = rows[names].to_numpy()
        return np.linalg.solve(m.T @ m + l2 * np.eye(50), m.T @ rows["y"].to_numpy())

    np.testing.assert_allclose(fi.fit_ridge(df, names, "y", 0.7), direct(pdf, 0.7), rtol=1e-8)
    got = fi.walk_forward_ridge(df, names, "y", [0.1, 5.0], "rank", 200).toPandas()
    assert got["rank"].min() == 2 and len(got) == 2 * (pdf["rank"] >= 2).sum()
    for (rank, l2), part in got.groupby(["rank", "l2"]):
        np.testing.assert_allclose(part["prediction"], part[names].to_numpy() @ direct(pdf[pdf["rank"] < rank], l2), rtol=1e-7, atol=1e-9)
    with pytest.raises(TidemarkError, match="no rows"):
        fi.fit_ridge(df.limit(0), names, "y", 1.0)


def test_each_category_is_measured_for_itself(spark, monkeypatch):
    monkeypatch.setattr(sp, "SMALL_BYTES", 10_000)
    df = spark.range(5_000).select("id", (F.col("id") % 3).alias("few"), (F.col("id") % 2_000).alias("many"))
    rows, _ = sp.sparse_design(df, [], ["few", "many"])
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 1
    assert rows.filter(F.size("indices") == 3).count() == 5_000


def test_sums_read_the_design_once(spark):
    df = spark.range(60).select("id", (F.col("id") % 3).alias("c"), F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("y"))
    rows, _ = sp.sparse_design(df, [], ["c"])
    sums = sp.sparse_sums(rows, "y")
    assert sums._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1
    y = [i % 7 if i % 3 else None for i in range(60)]
    want = {(0, 0): 60, (0, None): sum(v for v in y if v is not None), (1, None): None}
    for c in range(3):
        want |= {(0, c + 1): 20, (c + 1, c + 1): 20}
    want |= {(c + 1, None): sum(y[c::3]) for c in (1, 2)}
    assert {(r["i"], r["j"]): r["total"] for r in sums.collect()} == want
