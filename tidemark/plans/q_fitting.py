"""Model fitting as distributed aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features as fe
from tidemark.operators import fitting as fi
from tidemark.operators import metrics as me
from tidemark.operators import pmf as pm
from tidemark.operators import rollups as ro
from tidemark.operators import sparse as sp
from tidemark.plans import standins as st
from tidemark.plans.q_features import MINUTES_TRAIL, ROW, ROWS, RANK_SQL, r6
from tidemark.plans.q_metrics import newton_sql
from tidemark.plans.registry import query, table
from tidemark.session import settle

NUMERIC = ["l_discount", "l_tax", "l_quantity"]
SCALE_SQL = "WITH sc AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) > 1e-8 THEN stddev_pop({c}) ELSE 1 END AS s_{c}" for c in NUMERIC) + " FROM lineitem)"


@query("feature_scales", SCALE_SQL + " SELECT " + ", ".join(f"round(m_{c}, 8) AS m_{c}, round(s_{c}, 8) AS s_{c}" for c in NUMERIC) + " FROM sc")
def feature_scales(spark, sf):
    scales = fi.feature_scales(table(spark, sf, "lineitem"), NUMERIC)
    row = {f"{n}_{c}": round(v, 8) for c, ms in scales.items() for n, v in zip("ms", ms)}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))


@query("design_matrix", SCALE_SQL + """ SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1.0::DOUBLE AS z_intercept, """ + ", ".join(
    f"round(({c} - m_{c}) / s_{c}, 8) AS z_{c}" for c in NUMERIC) + """, (l_returnflag = 'A')::INT::DOUBLE AS z_l_returnflag_0,
    (l_returnflag = 'N')::INT::DOUBLE AS z_l_returnflag_1, (l_returnflag = 'R')::INT::DOUBLE AS z_l_returnflag_2 FROM lineitem, sc""")
def design_matrix(spark, sf):
    rows, names = fi.design_columns(table(spark, sf, "lineitem"), NUMERIC, ["l_returnflag"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.round(n, 8).alias(n) for n in names])


CATEGORIES = ["l_returnflag", "l_partkey"]
SPARSE_SQL = SCALE_SQL + """, levels AS (SELECT name, level, row_number() OVER (ORDER BY pos, level) + 3 AS index FROM (
    SELECT DISTINCT 0 AS pos, 'l_returnflag' AS name, l_returnflag AS level FROM lineitem UNION ALL
    SELECT DISTINCT 1, 'l_partkey', CAST(l_partkey AS VARCHAR) FROM lineitem)),
  design AS (SELECT l.*, f.index AS fi, k.index AS ki, """ + ", ".join(f"({c} - m_{c}) / s_{c} AS z_{c}" for c in NUMERIC) + """
    FROM lineitem l, sc, levels f, levels k WHERE f.name = 'l_returnflag' AND f.level = l.l_returnflag
      AND k.name = 'l_partkey' AND k.level = CAST(l.l_partkey AS VARCHAR))"""


@query("sparse_design_rows", SPARSE_SQL + """ SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '0,1,2,3,' || fi || ',' || ki AS indices,
    """ + ", ".join(f"round(z_{c}, 8) AS z_{c}" for c in NUMERIC) + " FROM design")
def sparse_design_rows(spark, sf):
    rows, _ = sp.sparse_design(table(spark, sf, "lineitem"), NUMERIC, CATEGORIES)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat_ws(",", F.col("indices").cast("array<string>")).alias("indices"),
                       *[F.round(F.get("values", F.lit(i)), 8).alias(f"z_{c}") for i, c in enumerate(NUMERIC, 1)])


@query("sparse_design_columns", SPARSE_SQL + """ SELECT * FROM (SELECT CAST(index AS BIGINT) AS index, name, level FROM levels UNION ALL
    SELECT * FROM (VALUES (0, 'intercept', NULL), (1, 'l_discount', NULL), (2, 'l_tax', NULL), (3, 'l_quantity', NULL)) v(index, name, level))""")
def sparse_design_columns(spark, sf):
    return sp.column_index(table(spark, sf, "lineitem"), NUMERIC, CATEGORIES)


@query("sparse_design_sums", SPARSE_SQL + """, e AS (SELECT rowid AS r, l_quantity AS y, unnest([0, 1, 2, 3, fi, ki]) AS i,
    unnest([1.0, z_l_discount, z_l_tax, z_l_quantity, 1.0, 1.0]) AS v FROM (SELECT *, row_number() OVER () AS rowid FROM design))
  SELECT a.i::BIGINT AS i, b.i::BIGINT AS j, round(sum(a.v * b.v), 4) + 0.0 AS total FROM e a JOIN e b ON a.r = b.r AND b.i >= a.i GROUP BY 1, 2
  UNION ALL SELECT i::BIGINT, NULL, round(sum(v * y), 4) + 0.0 FROM e GROUP BY 1""")
def sparse_design_sums(spark, sf):
    rows, _ = sp.sparse_design(table(spark, sf, "lineitem"), NUMERIC, CATEGORIES)
    return sp.sparse_sums(rows, "l_quantity").select("i", "j", (F.round("total", 4) + 0.0).alias("total"))


@query("ridge_coefficients", """WITH g AS (SELECT count(*) + 0.5 AS a, sum(l_discount) AS b, sum(l_tax) AS c, sum(l_discount * l_discount) + 0.5 AS d,
    sum(l_discount * l_tax) AS e, sum(l_tax * l_tax) + 0.5 AS f, sum(l_quantity) AS y0, sum(l_discount * l_quantity) AS y1, sum(l_tax * l_quantity) AS y2 FROM lineitem),
  det AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM g)
  SELECT round((y0 * (d * f - e * e) - b * (y1 * f - e * y2) + c * (y1 * e - d * y2)) / det, 6) AS intercept,
    round((a * (y1 * f - e * y2) - y0 * (b * f - e * c) + c * (b * y2 - y1 * c)) / det, 6) AS discount,
    round((a * (d * y2 - y1 * e) - b * (b * y2 - y1 * c) + y0 * (b * e - d * c)) / det, 6) AS tax FROM det""")
def ridge_coefficients(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_discount", "l_tax", "l_quantity", F.lit(1.0).alias("one"))
    beta = fi.fit_ridge(rows, ["one", "l_discount", "l_tax"], "l_quantity", 0.5)
    return spark.createDataFrame([tuple(round(float(b), 6) for b in beta)], "intercept double, discount double, tax double")


# -- walk-forward ------------------------------------------------------------------------------------

WALK_SQL = MINUTES_TRAIL + f""", t AS (SELECT l.season, l.round, l.element, l.fixture, l.line, CAST(l.minutes AS DOUBLE) AS y, t.trailing_minutes_mean_5 AS x, s * 100 + l.round AS rk
    FROM labeled l JOIN trail t USING (season, element, round) JOIN {RANK_SQL.format('labeled')} r USING (season)),
  per AS (SELECT rk, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM t GROUP BY 1),
  folds AS (SELECT rk, sum(n) OVER w AS n, sum(sx) OVER w AS sx, sum(sxx) OVER w AS sxx, sum(sy) OVER w AS sy, sum(sxy) OVER w AS sxy FROM per
    WINDOW w AS (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  fitted AS (SELECT rk, l2, (sy * (sxx + l2) - sx * sxy) / ((n + l2) * (sxx + l2) - sx * sx) AS b0,
    ((n + l2) * sxy - sx * sy) / ((n + l2) * (sxx + l2) - sx * sx) AS b1 FROM folds, (VALUES (0.01), (1.0), (100.0)) p(l2) WHERE n >= 50),
  predicted AS (SELECT t.*, f.l2, f.b0 + f.b1 * x AS prediction FROM t JOIN fitted f USING (rk))"""


def walked(spark, sf):
    rows = settle(fe.minutes_table(st.facts(spark, sf)).select(  # read for the sums and again for the predictions
        *ROWS, "chronological_rank", F.col("minutes").cast("double").alias("y"), F.col("trailing_minutes_mean_5").alias("x"), F.lit(1.0).alias("one")))
    return fi.walk_forward_ridge(rows, ["one", "x"], "y", [0.01, 1.0, 100.0], min_rows=50)


@query("walk_forward_predictions", WALK_SQL + f" SELECT {ROW}, round(prediction, 5) AS prediction FROM predicted WHERE l2 = 1.0")
def walk_forward_predictions(spark, sf):
    return walked(spark, sf).filter("l2 = 1.0").select(*ROWS, F.round("prediction", 5).alias("prediction"))


@query("penalty_sweep", WALK_SQL + """ SELECT CAST(l2 AS DOUBLE) AS l2, count(*) AS n, round(avg(power(y - prediction, 2)), 5) AS mean_squared_error FROM predicted GROUP BY 1""")
def penalty_sweep(spark, sf):
    return walked(spark, sf).groupBy("l2").agg(F.count("*").alias("n"), F.round(F.avg(F.pow(F.col("y") - F.col("prediction"), 2)), 5).alias("mean_squared_error"))


WIDE = 12  # one feature per residue of the player's number
WIDE_SQL = st.FACTS_SQL + f""", w AS (SELECT round AS rk, CAST(total_points AS DOUBLE) AS y, element % {WIDE} AS r FROM facts),
  cells AS (SELECT rk, r, count(*) AS n, sum(y) AS sy FROM w GROUP BY 1, 2), ranks AS (SELECT DISTINCT rk FROM w),
  folds AS (SELECT k.rk, c.r, sum(c.n) AS n, sum(c.sy) AS sy FROM ranks k JOIN cells c ON c.rk < k.rk GROUP BY 1, 2),
  sized AS (SELECT rk FROM folds GROUP BY 1 HAVING sum(n) >= 50)
  SELECT CAST(w.rk AS BIGINT) AS round, CAST(w.r AS INT) AS residue, count(*) AS n, round(coalesce(any_value(f.sy / (f.n + 2.0)), 0.0), 6) + 0.0 AS prediction
  FROM w JOIN sized USING (rk) LEFT JOIN folds f ON f.rk = w.rk AND f.r = w.r GROUP BY 1, 2"""


@query("walk_forward_wide", WIDE_SQL)
def walk_forward_wide(spark, sf):
    facts = st.facts(spark, sf).select(F.col("round").cast("long").alias("round"), F.col("total_points").cast("double").alias("y"),
                                       (F.col("element") % WIDE).cast("int").alias("residue"))
    names = [f"r{i}" for i in range(WIDE)]
    rows = settle(facts.select("*", *[(F.col("residue") == i).cast("double").alias(n) for i, n in enumerate(names)]))
    got = fi.walk_forward_ridge(rows, names, "y", [2.0], "round", 50)
    return got.groupBy("round", "residue").agg(F.count("*").alias("n"), (F.round(F.first("prediction"), 6) + 0.0).alias("prediction"))


@query("inner_calibration_split", st.SCORED_SQL + """, sizes AS (SELECT fold, count(*) AS n FROM scored GROUP BY 1),
  ranked AS (SELECT *, row_number() OVER (ORDER BY fold) AS i, count(*) OVER () AS k FROM sizes),
  cut AS (SELECT max(fold) FILTER (i = k - least(greatest(1, CAST(round_even(k * 0.2, 0) AS INT)), k - 1) + 1) AS c FROM ranked)
  SELECT fold >= c AS held_out, count(*) AS n, min(fold) AS first_fold, max(fold) AS last_fold FROM scored, cut GROUP BY 1""")
def inner_calibration_split(spark, sf):
    inner, held = fi.inner_split(st.scored(spark, sf), "fold", min_holdout=1, min_inner=1)
    both = inner.withColumn("held_out", F.lit(False)).unionByName(held.withColumn("held_out", F.lit(True)))
    return both.groupBy("held_out").agg(F.count("*").alias("n"), F.min("fold").alias("first_fold"), F.max("fold").alias("last_fold"))


@query("softmax_weights")
def softmax_weights(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.lit(1.0).alias("one"), (F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("d"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("cls"))
    weights = fi.fit_softmax(rows, ["one", "q", "d"], "cls", 3, 1.0)
    return spark.createDataFrame([(f, k, float(weights[i, k])) for i, f in enumerate(("one", "q", "d")) for k in range(3)],
                                 "feature string, outcome int, weight double")


# -- team strength -----------------------------------------------------------------------------------

def matches(spark, sf):
    return settle(ro.match_table(fe.eligible(st.facts(spark, sf))))  # read by every step of the fits


@query("team_strength")
def team_strength(spark, sf):
    strength, advantage = fi.fit_team_strength(matches(spark, sf), "2002-01-01 00:00:00", teams=["T99"])
    return strength.withColumn("home_advantage", F.lit(advantage))


@query("team_strength_scorelines")
def team_strength_scorelines(spark, sf):
    played = matches(spark, sf)
    strength, advantage = fi.fit_team_strength(played, "2002-01-01 00:00:00")
    rated = fi.match_rates(played, strength, advantage).withColumn("w", F.lit(1.0))
    rated = rated.withColumn("rho", F.lit(fi.fit_dependence(rated)))
    return pm.scoreline_summary(rated, ["season", "fixture"])


LOW_SQL = """WITH low AS (SELECT l_orderkey AS fixture, CAST(min(l_partkey) % 2 AS INT) AS h, CAST(min(l_suppkey) % 2 AS INT) AS a,
    0.6 + (l_orderkey % 13) / 10.0 AS l, 0.5 + (l_orderkey % 11) / 10.0 AS m, 0.5 + (l_orderkey % 5) / 10.0 AS w FROM lineitem GROUP BY l_orderkey),
  cells AS (SELECT CASE WHEN h = 0 AND a = 0 THEN -l * m WHEN h = 0 AND a = 1 THEN l WHEN h = 1 AND a = 0 THEN m ELSE -1.0 END::DOUBLE AS c, sum(w)::DOUBLE AS w FROM low GROUP BY 1),
  r0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS rho)"""
for _i in range(1, 10):  # Newton on the concave log likelihood sum(w ln(1 + c rho))
    LOW_SQL += (f", r{_i} AS MATERIALIZED (SELECT any_value(rho) + sum(w * c / (1 + c * rho)) / sum(w * c * c / ((1 + c * rho) * (1 + c * rho))) AS rho "
                f"FROM cells, r{_i - 1})")


@query("low_score_dependence", LOW_SQL + " SELECT round(rho, 6) AS rho FROM r9")
def low_score_dependence(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("fixture")).agg(
        (F.min("l_partkey") % 2).cast("int").alias("home_goals"), (F.min("l_suppkey") % 2).cast("int").alias("away_goals"))
    key = F.col("fixture")
    rated = rows.withColumn("home_rate", 0.6 + (key % 13) / F.lit(10.0)).withColumn("away_rate", 0.5 + (key % 11) / F.lit(10.0)).withColumn("w", 0.5 + (key % 5) / F.lit(10.0))
    return spark.createDataFrame([(round(fi.fit_dependence(rated), 6),)], "rho double")


@query("residual_profile", """SELECT l_returnflag, round(avg(r), 7) AS residual_mean, round(stddev_pop(r), 7) AS residual_std,
    round((avg(r * r * r) - 3 * avg(r) * avg(r * r) + 2 * power(avg(r), 3)) / power(stddev_pop(r), 3), 6) AS residual_skewness
  FROM (SELECT l_returnflag, l_quantity - (20 + 50 * l_discount) AS r FROM lineitem) GROUP BY 1""")
def residual_profile(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("prediction", 20 + 50 * F.col("l_discount"))
    p = fi.residual_profile(rows, "l_quantity", "prediction", ["l_returnflag"])
    return p.select("l_returnflag", F.round("residual_mean", 7).alias("residual_mean"), F.round("residual_std", 7).alias("residual_std"),
                    F.round("residual_skewness", 6).alias("residual_skewness"))
