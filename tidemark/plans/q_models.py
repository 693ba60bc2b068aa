"""Class models walked forward over seasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.maths import half_up
from tidemark.operators import class_models as cm
from tidemark.operators import features as fe
from tidemark.operators import fitting as fi
from tidemark.plans import standins as st
from tidemark.plans.q_features import MINUTES_TRAIL
from tidemark.plans.registry import query
from tidemark.session import settle

FOLDS = list(range(1996, 2002))
PENALTIES = [0.1, 1.0, 10.0, 1000.0]
POSITIONS = ["DEF", "FWD", "GK", "MID"]

# -- a saturated design: the fit's probabilities are the earlier shares ------------------------------

STATE_SQL = st.ELIGIBLE_SQL + """, rows_ AS (SELECT CAST(substr(season, 1, 4) AS INT) AS fold, position,
    CASE WHEN minutes = 0 THEN 0 WHEN minutes < 60 THEN 1 ELSE 2 END AS y FROM eligible),
  folds AS (SELECT unnest([1996, 1997, 1998, 1999, 2000, 2001]) AS f),
  shares AS (SELECT f, position, avg((y = 0)::INT) AS p0, avg((y = 1)::INT) AS p1, avg((y = 2)::INT) AS p2, count(*) AS n_train
    FROM rows_ JOIN folds ON fold < f GROUP BY 1, 2),
  tested AS (SELECT f, position, y FROM rows_ JOIN folds ON fold = f)"""


def states(spark, sf):
    rows = fe.eligible(st.facts(spark, sf))
    y = F.when(F.col("minutes") == 0, 0).when(F.col("minutes") < 60, 1).otherwise(2)
    return rows.select(F.substring("season", 1, 4).cast("int").alias("fold"), "position", y.alias("y"),
                       *[(F.col("position") == p).cast("double").alias(f"is_{p}") for p in POSITIONS])


def state_predictions(spark, sf):
    rows, x = settle(states(spark, sf)), [f"is_{p}" for p in POSITIONS]
    fits = cm.fit_class_folds(rows, x, "y", 3, [0.0], FOLDS)
    return cm.class_predictions(rows.filter(F.col("fold") <= FOLDS[-1]), fits, x, 3, FOLDS)


@query("class_walk_forward", STATE_SQL + """ SELECT f AS fold, position, count(*) AS n, round(avg(p0), 6) AS p0, round(avg(p1), 6) AS p1, round(avg(p2), 6) AS p2
  FROM tested JOIN shares USING (f, position) GROUP BY 1, 2""")
def class_walk_forward(spark, sf):
    return state_predictions(spark, sf).groupBy("fold", "position").agg(
        F.count("*").alias("n"), *[F.round(F.avg(F.get("probs", F.lit(k))), 6).alias(f"p{k}") for k in range(3)])


@query("class_walk_forward_scores", STATE_SQL + """ SELECT f AS fold, count(*) AS n, round(avg(-ln(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)), 6) AS log_loss,
    round(avg(power(p0 - (y = 0)::INT, 2) + power(p1 - (y = 1)::INT, 2) + power(p2 - (y = 2)::INT, 2)), 6) AS brier
  FROM tested JOIN shares USING (f, position) GROUP BY 1""")
def class_walk_forward_scores(spark, sf):
    scored = cm.penalty_path(state_predictions(spark, sf), key=["fold"])
    return scored.select("fold", "n", F.round("log_loss", 6).alias("log_loss"), F.round("brier", 6).alias("brier"))


# -- two classes, one feature: Newton's method in SQL beside it --------------------------------------

CELLS_SQL = MINUTES_TRAIL + """, cells AS MATERIALIZED (SELECT CAST(substr(season, 1, 4) AS INT) AS fold, round(trailing_minutes_mean_5, 3) / 90 AS x,
    CAST(starts AS INT) AS y, count(*) AS n FROM labeled JOIN trail USING (season, element, round) GROUP BY 1, 2, 3)"""


def logistic_sql(penalties, steps: int = 14) -> str:
    """CTEs of Newton's method for every fold and penalty on cells(fold, x, y, n); each step solves 2x2 systems."""
    fits = ", ".join(f"({f}, {v})" for f in FOLDS for v in penalties)
    out = [f"m0 AS MATERIALIZED (SELECT f, l2::DOUBLE AS l2, 0::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS seen FROM (VALUES {fits}) v(f, l2))"]
    for i in range(1, steps + 1):
        out.append(
            f"s{i} AS MATERIALIZED (SELECT f, l2, a, b, sum(n) AS seen, sum(n * (y - pi)) - l2 * a AS r0, sum(n * (y - pi) * x) - l2 * b AS r1, "
            f"sum(n * pi * (1 - pi)) + l2 AS w0, sum(n * pi * (1 - pi) * x) AS w1, sum(n * pi * (1 - pi) * x * x) + l2 AS w2 "
            f"FROM (SELECT m.*, x, y, n, 1 / (1 + exp(-(a + b * x))) AS pi FROM cells JOIN m{i - 1} m ON cells.fold < m.f) GROUP BY 1, 2, 3, 4)")
        out.append(f"m{i} AS MATERIALIZED (SELECT f, l2, a + (r0 * w2 - r1 * w1) / (w0 * w2 - w1 * w1) AS a, "
                   f"b + (r1 * w0 - r0 * w1) / (w0 * w2 - w1 * w1) AS b, seen FROM s{i})")
    return ", " + ", ".join(out) + f", fits AS (SELECT * FROM m{steps})"


def starts(spark, sf):
    """Rows alike in fold, feature and class once, with their number n: thousandths of minutes, however many rows there are."""
    counted = F.inline(F.array(*[F.struct(F.lit(y).alias("y"), F.col(f"n_{y}").alias("n")) for y in (0, 1)]))
    rows = fe.started_rounds(st.facts(spark, sf)).select(
        F.substring("season", 1, 4).cast("int").alias("fold"), (half_up(F.col("trailing_minutes_mean_5"), 3) / 90).alias("x"), counted)
    return settle(rows.filter("n > 0").groupBy("fold", "x", "y").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1.0)))


@query("class_model_fits", CELLS_SQL + logistic_sql(PENALTIES) + """ SELECT f AS fold, l2, CAST(seen AS BIGINT) AS n, round(a, 5) AS intercept, round(b, 5) AS slope,
    true AS converged FROM fits""")
def class_model_fits(spark, sf):
    fits = cm.fit_class_folds(starts(spark, sf), ["one", "x"], "y", 2, PENALTIES, FOLDS, weight="n")
    at = [F.get("weights", F.lit(i)) for i in range(4)]
    return fits.select("fold", "l2", "n", F.round(at[1] - at[0], 5).alias("intercept"), F.round(at[3] - at[2], 5).alias("slope"), "converged")


@query("class_penalty_path", CELLS_SQL + logistic_sql(PENALTIES) + """, tested AS (SELECT l2, n, CASE WHEN y = 1 THEN p ELSE 1 - p END AS q FROM (
      SELECT l2, n, y, 1 / (1 + exp(-(a + b * x))) AS p FROM cells JOIN fits ON fold = f)),
    path AS (SELECT l2, CAST(sum(n) AS BIGINT) AS n, sum(-n * ln(q)) / sum(n) AS log_loss, sum(n * 2 * power(1 - q, 2)) / sum(n) AS brier FROM tested GROUP BY 1)
  SELECT l2, n, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier, row_number() OVER (ORDER BY log_loss, l2 DESC) = 1 AS is_best FROM path""")
def class_penalty_path(spark, sf):
    rows = starts(spark, sf)
    fits = cm.fit_class_folds(rows, ["one", "x"], "y", 2, PENALTIES, FOLDS, weight="n")
    path = cm.penalty_path(cm.class_predictions(rows.filter(F.col("fold") <= FOLDS[-1]), fits, ["one", "x"], 2, FOLDS), weight="n")
    return path.select("l2", "n", F.round("log_loss", 6).alias("log_loss"), F.round("brier", 6).alias("brier"), "is_best")


@query("walk_forward_logistic_fits", CELLS_SQL + logistic_sql([0]) + " SELECT f AS fold, round(a, 5) AS intercept, round(b, 5) AS slope FROM fits")
def walk_forward_logistic_fits(spark, sf):
    rows = fe.minutes_table(st.facts(spark, sf)).select(
        F.substring("season", 1, 4).cast("int").alias("fold"), "starts", (F.round("trailing_minutes_mean_5", 3) / 90).alias("x"))
    betas = fi.walk_forward_logistic(rows, "x", "starts", FOLDS)
    return spark.createDataFrame([(f, round(float(b[0]), 5), round(float(b[1]), 5)) for f, b in betas.items()], "fold int, intercept double, slope double")
