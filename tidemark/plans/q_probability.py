"""Probability tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import maths as m
from tidemark.operators import pmf as pm
from tidemark.operators import rollups as ro
from tidemark.plans import standins as st
from tidemark.plans.registry import query, table

# -- scorelines: one match per customer, rates from its keys -----------------------------------------

_RATES = """c_custkey AS fixture, 0.4 + (c_custkey % 23) / CAST(10 AS DOUBLE) AS home_rate,
  0.3 + (c_nationkey % 19) / CAST(10 AS DOUBLE) AS away_rate, CAST(-0.08 AS DOUBLE) AS rho"""
GRID_SQL = f"""WITH rates AS (SELECT {_RATES} FROM customer),
 g AS (SELECT fixture, home_rate AS l, away_rate AS m, rho, h, a,
   exp(-home_rate) * power(home_rate, h) / factorial(CAST(h AS INT)) * exp(-away_rate) * power(away_rate, a) / factorial(CAST(a AS INT))
   * CASE WHEN h = 0 AND a = 0 THEN 1 - home_rate * away_rate * rho WHEN h = 0 AND a = 1 THEN 1 + home_rate * rho
          WHEN h = 1 AND a = 0 THEN 1 + away_rate * rho WHEN h = 1 AND a = 1 THEN 1 - rho ELSE 1 END AS raw
   FROM rates, range(0, 11) x(h), range(0, 11) y(a)),
 grid AS (SELECT fixture, h, a, greatest(raw, 0) / sum(greatest(raw, 0)) OVER (PARTITION BY fixture) AS p,
   sum(greatest(raw, 0)) OVER (PARTITION BY fixture) AS mass FROM g)"""


def rated(spark, sf):
    return table(spark, sf, "customer").selectExpr(*st.columns(_RATES))


@query("scoreline_rows", GRID_SQL + " SELECT fixture, CAST(h AS INT) AS h, CAST(a AS INT) AS a, round(p, 9) AS p FROM grid")
def scoreline_rows(spark, sf):
    return pm.scoreline_cells(rated(spark, sf), ["fixture"]).select("fixture", "h", "a", F.round("p", 9).alias("p"))


@query("scoreline_summary", GRID_SQL + """
  SELECT fixture, round(max(mass), 9) AS mass, round(sum(p) FILTER (h > a), 9) AS home_win, round(sum(p) FILTER (h = a), 9) AS draw,
    round(sum(p) FILTER (h < a), 9) AS away_win, round(sum(h * p), 8) AS home_expected, round(sum(a * p), 8) AS away_expected
  FROM grid GROUP BY 1""")
def scoreline_summary(spark, sf):
    s = pm.scoreline_summary(rated(spark, sf), ["fixture"])
    return s.select("fixture", F.round("mass_before_truncation", 9).alias("mass"),
                    *[F.round(c, 9).alias(c) for c in ("home_win", "draw", "away_win")],
                    *[F.round(c, 8).alias(c) for c in ("home_expected", "away_expected")])


@query("scoreline_mode", GRID_SQL + """
  SELECT fixture, CAST(h AS INT) AS mode_home, CAST(a AS INT) AS mode_away FROM (
    SELECT *, row_number() OVER (PARTITION BY fixture ORDER BY round(p, 12) DESC, h, a) rn FROM grid) WHERE rn = 1""")
def scoreline_mode(spark, sf):
    return pm.scoreline_summary(rated(spark, sf), ["fixture"], mode_decimals=12).select("fixture", "mode_home", "mode_away")


@query("goal_marginal", GRID_SQL + """
  SELECT fixture, CAST(h AS INT) AS goals, round(sum(p), 9) AS probability FROM grid GROUP BY 1, 2""")
def goal_marginal(spark, sf):
    return pm.goal_marginal(rated(spark, sf), ["fixture"]).withColumn("probability", F.round("probability", 9))


# -- scalar masses -----------------------------------------------------------------------------------

_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
LINE = ", ".join(_LINE)


@query("poisson_mass", f"""SELECT {LINE}, round(exp(-r) * power(r, k) / factorial(k), 10) AS p FROM (
  SELECT *, l_quantity / 10.0 AS r, CAST(l_linenumber AS INT) AS k FROM lineitem)""")
def poisson_mass(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.select(*_LINE, F.round(m.poisson(F.col("l_linenumber"), F.col("l_quantity") / F.lit(10.0)), 10).alias("p"))


@query("binomial_mass", f"""SELECT {LINE}, round(CASE WHEN k > n THEN 0 ELSE CAST(factorial(n) AS DOUBLE) / (factorial(k) * factorial(n - least(k, n)))
    * power(p, k) * power(1 - p, n - least(k, n)) END, 10) AS p
  FROM (SELECT * EXCLUDE (l_comment) FROM (SELECT *, NULL AS l_comment, CAST(l_quantity AS INT) % 13 AS n, CAST(l_linenumber AS INT) AS k, l_tax * 5 AS p FROM lineitem))""")
def binomial_mass(spark, sf):
    lines = table(spark, sf, "lineitem")
    n = F.col("l_quantity").cast("int") % 13
    return lines.select(*_LINE, F.round(m.binomial(F.col("l_linenumber"), n, F.col("l_tax") * 5), 10).alias("p"))


@query("negative_binomial_mass", """WITH d AS (SELECT o_orderkey, 0.5 + (o_custkey % 40) / 4.0 AS mu, 1.0 + (o_orderkey % 7) / 2.0 AS r FROM orders),
  e AS (SELECT o_orderkey, k, exp(lgamma(k + r) - lgamma(r) - lgamma(k + 1) + r * ln(r / (r + mu)) + k * ln(1 - r / (r + mu))) AS p
    FROM d, range(0, 26) x(k))
  SELECT o_orderkey, round(sum(p), 8) AS captured, round(sum(k * p) / sum(p), 8) AS mean FROM e GROUP BY 1""")
def negative_binomial_mass(spark, sf):
    orders = table(spark, sf, "orders")
    mu, r = 0.5 + (F.col("o_custkey") % 40) / F.lit(4.0), 1.0 + (F.col("o_orderkey") % 7) / F.lit(2.0)
    rows = orders.select("o_orderkey", m.negative_binomial(mu, r, 25).alias("probs"))
    mean = m.array_sum(F.transform("probs", lambda p, k: k * p))
    total = m.array_sum(F.col("probs"))
    return rows.select("o_orderkey", F.round(total, 8).alias("captured"), F.round(mean / total, 8).alias("mean"))


@query("softmax_classes", f"""SELECT {LINE}, round(e0 / (e0 + e1 + e2), 9) AS p0, round(e1 / (e0 + e1 + e2), 9) AS p1, round(e2 / (e0 + e1 + e2), 9) AS p2
  FROM (SELECT *, exp(0.0) AS e0, exp(l_discount * 10 - 1 + ln(l_quantity / 90)) AS e1, exp(l_tax * 10 - 2 + ln(l_quantity / 90)) AS e2 FROM lineitem)""")
def softmax_classes(spark, sf):
    lines = table(spark, sf, "lineitem")
    p = m.offset_softmax(F.col("l_discount") * 10 - 1, F.col("l_tax") * 10 - 2, F.ln(F.col("l_quantity") / 90))
    return lines.select(*_LINE, *[F.round(x, 9).alias(f"p{i}") for i, x in enumerate(p)])


@query("decay_weight", f"""SELECT {LINE}, round(exp(-ln(2.0) * date_diff('day', l_shipdate, TIMESTAMP '2002-01-01') / 180.0)
    * CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.6 END, 10) AS weight FROM lineitem""")
def decay_weight(spark, sf):
    days = F.date_diff(F.lit("2002-01-01").cast("date"), "l_shipdate")
    return table(spark, sf, "lineitem").select(*_LINE, F.round(m.decay_weight(days, F.col("l_returnflag") == "A"), 10).alias("weight"))


KNOTS = [(0.05, 0.1), (0.2, 0.15), (0.5, 0.4), (0.9, 0.95)]


@query("interpolate_knots", st.SCORED_SQL + """ SELECT doc_id, round(CASE WHEN p <= 0.05 THEN 0.1
    WHEN p <= 0.2 THEN 0.1 + (p - 0.05) * (0.05 / 0.15) WHEN p <= 0.5 THEN 0.15 + (p - 0.2) * (0.25 / 0.3)
    WHEN p <= 0.9 THEN 0.4 + (p - 0.5) * (0.55 / 0.4) ELSE 0.95 END, 9) AS calibrated FROM scored""")
def interpolate_knots(spark, sf):
    return st.scored(spark, sf).select("doc_id", F.round(m.interpolate(F.col("p"), KNOTS), 9).alias("calibrated"))


# -- mixtures ----------------------------------------------------------------------------------------

@query("involvement_mixture", """WITH d AS (SELECT o_orderkey, 0.05 + (o_custkey % 30) / 60.0 AS s, CAST(o_orderkey % 4 AS INT) AS g2 FROM orders),
  mix AS (SELECT o_orderkey, k, sum(we * wg * CASE WHEN k > g THEN 0 ELSE CAST(factorial(g) AS DOUBLE) / (factorial(CAST(k AS INT)) * factorial(CAST(g - least(k, g) AS INT)))
      * power(s * mn / 90.0, k) * power(1 - s * mn / 90.0, g - least(k, g)) END) AS p
    FROM (SELECT o_orderkey, s, unnest([1, g2]) AS g, unnest([0.25, 0.75]) AS wg FROM d),
         (VALUES (0.0, 0.2), (45.0, 0.3), (90.0, 0.5)) e(mn, we), range(0, 7) x(k) GROUP BY 1, 2)
  SELECT o_orderkey, CAST(k AS INT) AS points, round(p / sum(p) OVER (PARTITION BY o_orderkey), 9) AS probability FROM mix""")
def involvement_mixture(spark, sf):
    orders = table(spark, sf, "orders")
    exposure = F.expr("array(0.2D, 0.3D, 0.5D)")
    second = F.col("o_orderkey") % 4
    goals = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda g: F.when(g == 1, 0.25).otherwise(0.0) + F.when(g == second, 0.75).otherwise(0.0))
    share = 0.05 + (F.col("o_custkey") % 30) / F.lit(60.0)
    rows = orders.select("o_orderkey", pm.involvement_mixture(share, exposure, goals, 6, (0.0, 45.0, 90.0)).alias("probs"))
    return pm.pmf_rows(rows, ["o_orderkey"]).withColumn("probability", F.round("probability", 9))


@query("count_mixture", """WITH d AS (SELECT o_orderkey, 1 + (o_custkey % 30) / 5.0 AS rate, 2.0 + (o_orderkey % 5) AS r FROM orders),
  nb AS (SELECT o_orderkey, we, k, CASE WHEN mn = 0 THEN CASE WHEN k = 0 THEN 1 ELSE 0 END
      ELSE exp(lgamma(k + r) - lgamma(r) - lgamma(k + 1) + r * ln(r / (r + rate * mn / 90.0)) + k * ln(1 - r / (r + rate * mn / 90.0) + CASE WHEN mn = 0 THEN 1 ELSE 0 END)) END AS p, mn
    FROM d, (VALUES (0.0, 0.25), (60.0, 0.25), (90.0, 0.5)) e(mn, we), range(0, 21) x(k)),
  one AS (SELECT *, p / sum(p) OVER (PARTITION BY o_orderkey, mn) AS q FROM nb)
  SELECT o_orderkey, round(sum(we * q) FILTER (k >= 5), 8) AS p_ge_5, round(sum(we * q * k), 7) AS mean FROM one GROUP BY 1""")
def count_mixture(spark, sf):
    orders = table(spark, sf, "orders")
    exposure = F.expr("array(0.25D, 0.25D, 0.5D)")
    rate, r = 1 + (F.col("o_custkey") % 30) / F.lit(5.0), 2.0 + F.col("o_orderkey") % 5
    rows = orders.select("o_orderkey", pm.count_mixture(rate, r, exposure, 20, (0.0, 60.0, 90.0)).alias("probs"))
    stats = pm.moments(pm.pmf_rows(rows, ["o_orderkey"]), ["o_orderkey"], at_least=[5])
    return stats.select("o_orderkey", F.round("p_ge_5", 8).alias("p_ge_5"), F.round("mean", 7).alias("mean"))


@query("involvement_chance", st.FACTS_SQL + """ SELECT season, round, element, fixture, line,
    round(1 - power(1 - (element % 10) / 10.0 * (minutes / 90.0), team_h_score), 9) AS chance FROM facts""")
def involvement_chance(spark, sf):
    chance = pm.involvement_chance((F.col("element") % 10) / F.lit(10.0), F.col("minutes") / F.lit(90.0), F.col("team_h_score"))
    return st.facts(spark, sf).select("season", "round", "element", "fixture", "line", F.round(chance, 9).alias("chance"))


# -- minutes ------------------------------------------------------------------------------------------

BAND_SQL = st.FACTS_SQL + """, banded AS (SELECT season, element, coalesce(starts, 0) AS state,
    CASE WHEN minutes <= 0 THEN 0 WHEN minutes < 30 THEN 1 WHEN minutes < 60 THEN 2 WHEN minutes < 75 THEN 3 WHEN minutes < 90 THEN 4 ELSE 5 END AS band FROM facts),
  counted AS (SELECT season, element, band, count(*) AS n, count(*) FILTER (state = 1) AS started FROM banded GROUP BY 1, 2, 3),
  shares AS (SELECT *, n / sum(n) OVER (PARTITION BY season, element) AS p FROM counted)"""


def band_arrays(spark, sf):
    mins = F.col("minutes")
    band = F.when(mins <= 0, 0).when(mins < 30, 1).when(mins < 60, 2).when(mins < 75, 3).when(mins < 90, 4).otherwise(5)
    counts = st.facts(spark, sf).groupBy("season", "element").agg(
        F.array(*[F.count_if(band == b).cast("double") for b in range(6)]).alias("n"))
    return counts.select("season", "element", m.scaled(F.col("n")).alias("bands"))


@query("minutes_expectations", BAND_SQL + """
  SELECT season, element, round(sum(p * CASE band WHEN 0 THEN 0 WHEN 1 THEN 15 WHEN 2 THEN 45 WHEN 3 THEN 67 WHEN 4 THEN 82 ELSE 90 END), 8) AS expected_minutes,
    round(coalesce(sum(p) FILTER (band >= 3), 0), 8) AS p_hour FROM shares GROUP BY 1, 2""")
def minutes_expectations(spark, sf):
    return band_arrays(spark, sf).select(
        "season", "element", F.round(pm.expected_minutes(F.col("bands")), 8).alias("expected_minutes"),
        F.round(pm.chance_of_an_hour(F.col("bands")), 8).alias("p_hour"))


@query("joint_state_bands", BAND_SQL + """
  SELECT s.season, s.element, CAST(b.band AS INT) AS band, round(0.7 * coalesce(p, 0), 9) AS joint
  FROM (SELECT DISTINCT season, element FROM facts) s CROSS JOIN range(0, 6) b(band) LEFT JOIN shares USING (season, element, band)""")
def joint_state_bands(spark, sf):
    joint = band_arrays(spark, sf).select("season", "element", pm.joint_minutes(F.lit(0.7), F.col("bands")).alias("j"))
    return joint.select("season", "element", F.posexplode("j").alias("band", "joint")).withColumn("joint", F.round("joint", 9))


# -- histograms, moments, checks ---------------------------------------------------------------------

HIST_SQL = """WITH counted AS (SELECT o_custkey, CAST(floor(o_totalprice / 60000) AS INT) AS v, count(*) AS n FROM orders GROUP BY 1, 2),
  spans AS (SELECT o_custkey, sum(n) AS total, min(v) AS lo, max(v) AS hi FROM counted GROUP BY 1),
  support AS (SELECT o_custkey, total, unnest(range(lo, hi + 1)) AS v FROM spans),
  hist AS (SELECT s.o_custkey, CAST(s.v AS INT) AS points, coalesce(n, 0) / total AS probability FROM support s LEFT JOIN counted USING (o_custkey, v))"""


def histogram(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", F.floor(F.col("o_totalprice") / 60000).cast("int").alias("v"))
    return pm.dense_histogram(rows, ["o_custkey"], "v")


@query("dense_histogram", HIST_SQL + " SELECT o_custkey, points, round(probability, 9) AS probability FROM hist")
def dense_histogram(spark, sf):
    return histogram(spark, sf).withColumn("probability", F.round("probability", 9))


@query("distribution_moments", HIST_SQL + """
  SELECT o_custkey, round(mean, 7) AS mean, round(v, 7) AS variance, round(t, 8) AS p_ge_4 FROM (
    SELECT o_custkey, sum(points * probability) AS mean,
      greatest(sum(points * points * probability) - power(sum(points * probability), 2), 0) AS v,
      coalesce(sum(probability) FILTER (points >= 4), 0) AS t FROM hist GROUP BY 1)""")
def distribution_moments(spark, sf):
    stats = pm.moments(histogram(spark, sf), ["o_custkey"], at_least=[4])
    return stats.select("o_custkey", F.round("mean", 7).alias("mean"), F.round("variance", 7).alias("variance"), F.round("p_ge_4", 8).alias("p_ge_4"))


@query("broken_distributions", HIST_SQL + """, cut AS (SELECT * FROM hist WHERE NOT (o_custkey % 5 = 0 AND points = 3))
  SELECT o_custkey, round(sum(probability), 8) AS total, count(*) AS n, CAST(max(points) - min(points) + 1 AS INT) AS span FROM cut GROUP BY 1
  HAVING abs(sum(probability) - 1) > 1e-6 OR count(*) <> max(points) - min(points) + 1""")
def broken_distributions(spark, sf):
    cut = histogram(spark, sf).filter(~((F.col("o_custkey") % 5 == 0) & (F.col("points") == 3)))
    return pm.broken_distributions(cut, ["o_custkey"]).select("o_custkey", F.round("total", 8).alias("total"), "n", "span")


@query("trailing_distribution", st.FACTS_SQL + """, totals AS (
    SELECT season, element, round, sum(total_points) AS t FROM facts WHERE round BETWEEN 24 AND 29 GROUP BY 1, 2, 3),
  counted AS (SELECT season, element, t, count(*) AS n FROM totals GROUP BY 1, 2, 3),
  spans AS (SELECT season, element, sum(n) AS total, min(t) AS lo, max(t) AS hi FROM counted GROUP BY 1, 2),
  support AS (SELECT season, element, total, unnest(range(CAST(lo AS BIGINT), CAST(hi + 1 AS BIGINT))) AS t FROM spans)
  SELECT season, element, t AS points, round(coalesce(n, 0) / total, 9) AS probability FROM support LEFT JOIN counted USING (season, element, t)""")
def trailing_distribution(spark, sf):
    hist = pm.trailing_distribution(st.facts(spark, sf), 30, 6)
    return hist.withColumn("probability", F.round("probability", 9))


@query("top_coded_shares", st.FACTS_SQL + """
  SELECT position, outcome, n, round(n / sum(n) OVER (PARTITION BY position), 9) AS probability FROM (
    SELECT position, least(saves, 5) AS outcome, count(*) AS n FROM facts GROUP BY 1, 2)""")
def top_coded_shares(spark, sf):
    return pm.top_coded_shares(st.facts(spark, sf), ["position"], "saves", 5).withColumn("probability", F.round("probability", 9))


@query("pmf_to_rows", HIST_SQL + " SELECT o_custkey, points, round(probability, 9) AS probability FROM hist")
def pmf_to_rows(spark, sf):
    rows = histogram(spark, sf).groupBy("o_custkey").agg(
        F.min("points").alias("lo"), F.array_sort(F.collect_list(F.struct("points", "probability"))).alias("s"))
    return pm.pmf_rows(rows.withColumn("probs", F.col("s.probability")), ["o_custkey"], lo="lo").withColumn(
        "probability", F.round("probability", 9))


# -- convolution over a customer's order priorities (at most five "fixtures" each) --------------------

PRIORITY_SQL = """WITH RECURSIVE counted AS (SELECT o_custkey, CAST(substr(o_orderpriority, 1, 1) AS INT) AS fx, CAST(floor(o_totalprice / 100000) AS INT) AS v, count(*) AS n
    FROM orders GROUP BY 1, 2, 3),
  pmf AS (SELECT o_custkey, fx, v, n / sum(n) OVER (PARTITION BY o_custkey, fx) AS p FROM counted),
  steps AS (SELECT o_custkey, fx, row_number() OVER (PARTITION BY o_custkey ORDER BY fx) AS i FROM (SELECT DISTINCT o_custkey, fx FROM pmf)),
  p2 AS (SELECT pmf.*, i FROM pmf JOIN steps USING (o_custkey, fx)),
  last AS (SELECT o_custkey, max(i) AS li FROM steps GROUP BY 1),
  conv AS (SELECT o_custkey, i, v AS x, p FROM p2 WHERE i = 1
    UNION ALL
    SELECT o_custkey, i, x, sum(p) FROM (SELECT c.o_custkey, b.i, c.x + b.v AS x, c.p * b.p AS p
      FROM conv c JOIN p2 b ON b.o_custkey = c.o_custkey AND b.i = c.i + 1) GROUP BY 1, 2, 3),
  done AS (SELECT c.o_custkey, x, p FROM conv c JOIN last l ON l.o_custkey = c.o_custkey AND l.li = c.i)"""


def combined(spark, sf):
    orders = table(spark, sf, "orders")
    hist = pm.dense_histogram(orders.select(
        "o_custkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("fixture"),
        F.floor(F.col("o_totalprice") / 100000).cast("int").alias("v")), ["o_custkey", "fixture"], "v")
    arrays = hist.groupBy("o_custkey", "fixture").agg(
        F.min("points").alias("lo"), F.array_sort(F.collect_list(F.struct("points", "probability"))).alias("s"))
    return pm.combine_fixtures(arrays.withColumn("probs", F.col("s.probability")), ["o_custkey"])


@query("combine_fixture_distributions", PRIORITY_SQL + """ SELECT o_custkey, CAST(x AS INT) AS points, round(p, 9) AS probability FROM done WHERE round(p, 9) > 0""")
def combine_fixture_distributions(spark, sf):
    rows = pm.pmf_rows(combined(spark, sf), ["o_custkey"], lo="lo").withColumn("probability", F.round("probability", 9))
    return rows.filter(F.col("probability") > 0)


@query("combined_moments", PRIORITY_SQL + """ SELECT o_custkey, round(sum(x * p), 6) AS mean, round(sum(x * x * p) - power(sum(x * p), 2), 6) AS variance FROM done GROUP BY 1""")
def combined_moments(spark, sf):
    stats = pm.moments(pm.pmf_rows(combined(spark, sf), ["o_custkey"], lo="lo"), ["o_custkey"])
    return stats.select("o_custkey", F.round("mean", 6).alias("mean"), F.round(F.col("variance"), 6).alias("variance"))


# -- calibrated rescaling ----------------------------------------------------------------------------

@query("rescale_start_class", st.SCORED_SQL + """ SELECT doc_id, round(c, 9) AS start, round((1 - p) * 0.6 * (1 - c) / (1 - p), 9) AS sub,
    round((1 - p) * 0.4 * (1 - c) / (1 - p), 9) AS unused FROM (SELECT *, 0.1 + 0.8 * p AS c FROM scored)""")
def rescale_start_class(spark, sf):
    p = F.col("p")
    parts = pm.rescale_start(p, (1 - p) * 0.6, (1 - p) * 0.4, 0.1 + 0.8 * p)
    return st.scored(spark, sf).select("doc_id", *[F.round(x, 9).alias(n) for x, n in zip(parts, ("start", "sub", "unused"))])


@query("rescale_two_classes", st.SCORED_SQL + """ SELECT doc_id, round(a * 0.95 / (a + b), 9) AS none, round(b * 0.95 / (a + b), 9) AS yellow, CAST(0.05 AS DOUBLE) AS red
  FROM (SELECT *, 0.9 - 0.3 * p AS a, 0.05 + 0.3 * p AS b FROM scored)""")
def rescale_two_classes(spark, sf):
    p = F.col("p")
    parts = pm.rescale_two(F.lit(0.05), 0.9 - 0.3 * p, 0.05 + 0.3 * p)
    return st.scored(spark, sf).select("doc_id", *[F.round(x, 9).alias(n) for x, n in zip(parts, ("none", "yellow", "red"))])


@query("rescale_tail_mass", """WITH sup AS (SELECT o_orderkey, 0.5 + (o_custkey % 40) / 20.0 AS r FROM orders),
  q AS (SELECT o_orderkey, k, exp(-r) * power(r, k) / factorial(CAST(k AS INT)) AS p FROM sup, range(0, 9) x(k)),
  s AS (SELECT *, p / sum(p) OVER (PARTITION BY o_orderkey) AS n FROM q),
  b AS (SELECT *, sum(CASE WHEN k >= 3 THEN n ELSE 0 END) OVER (PARTITION BY o_orderkey) AS tail FROM s)
  SELECT o_orderkey, CAST(k AS INT) AS points, round(CASE WHEN k >= 3 THEN n * 0.4 / tail ELSE n * 0.6 / (1 - tail) END, 9) AS probability FROM b""")
def rescale_tail_mass(spark, sf):
    rate = 0.5 + (F.col("o_custkey") % 40) / F.lit(20.0)
    raw = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: m.poisson(k, F.col("r")))
    rows = table(spark, sf, "orders").select("o_orderkey", rate.alias("r")).withColumn("probs", m.scaled(raw))
    moved = rows.select("o_orderkey", pm.rescale_tail(F.col("probs"), 3, F.lit(0.4)).alias("probs"))
    return pm.pmf_rows(moved, ["o_orderkey"]).withColumn("probability", F.round("probability", 9))


# -- draws -------------------------------------------------------------------------------------------

@query("seeded_draws", HIST_SQL + """, cum AS (SELECT *, sum(probability) OVER (PARTITION BY o_custkey ORDER BY points) AS c,
    max(points) OVER (PARTITION BY o_custkey) AS top FROM hist),
  sims AS (SELECT o_custkey, sim, CAST(('0x' || substr(md5(o_custkey || ':' || sim || ':3'), 1, 8)) AS BIGINT) / 4294967296.0 AS u
    FROM (SELECT DISTINCT o_custkey FROM hist), range(1, 41) x(sim)),
  drawn AS (SELECT o_custkey, sim, coalesce(min(points) FILTER (c > u), max(top)) AS draw FROM sims JOIN cum USING (o_custkey) GROUP BY 1, 2)
  SELECT o_custkey, CAST(draw AS INT) AS draw, count(*) AS n FROM drawn GROUP BY 1, 2""")
def seeded_draws(spark, sf):
    arrays = histogram(spark, sf).groupBy("o_custkey").agg(
        F.min("points").alias("lo"), F.array_sort(F.collect_list(F.struct("points", "probability"))).alias("s"))
    drawn = pm.draws(arrays.withColumn("probs", F.col("s.probability")), ["o_custkey"], 40, 3, lo="lo")
    return drawn.groupBy("o_custkey", "draw").agg(F.count("*").alias("n"))
