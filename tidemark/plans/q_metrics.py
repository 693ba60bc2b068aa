"""Scoring rules, calibration and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features as fe
from tidemark.operators import fitting as fi
from tidemark.operators import metrics as me
from tidemark.plans import standins as st
from tidemark.plans.q_features import BONUS, BONUS_TRAIL, CARDS, CARDS_TRAIL, ROWS, ROW
from tidemark.plans.registry import query
from tidemark.session import small

CLIPPED = "least(greatest(p, 1e-12), 1 - 1e-12)"
LL = f"avg(-(y * ln({CLIPPED}) + (1 - y) * ln(1 - {CLIPPED})))"

# Three ordered classes from quality and toxicity, with probabilities that depend on the text's length.
CLASSES_SQL = """WITH classes AS (SELECT doc_id, lang, CASE WHEN toxic = 1 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END AS y,
  (1 + n_chars % 7) / CAST(18 + n_chars % 7 + n_chars % 5 AS DOUBLE) AS p0,
  (12 + n_chars % 5) / CAST(18 + n_chars % 7 + n_chars % 5 AS DOUBLE) AS p1,
  5 / CAST(18 + n_chars % 7 + n_chars % 5 AS DOUBLE) AS p2
  FROM labels JOIN documents USING (doc_id))"""


def classes(spark, sf):
    docs = st.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    rows = st.table(spark, sf, "labels").join(docs, "doc_id")
    total = (18 + F.col("n_chars") % 7 + F.col("n_chars") % 5).cast("double")
    probs = F.array((1 + F.col("n_chars") % 7) / total, (12 + F.col("n_chars") % 5) / total, 5 / total)
    y = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 1).otherwise(0)
    return rows.select("doc_id", "lang", y.alias("y"), probs.alias("probs"))


@query("binary_scores", st.SCORED_SQL + f" SELECT lang, count(*) AS n, round({LL}, 8) AS log_loss, round(avg(power(p - y, 2)), 8) AS brier FROM scored GROUP BY 1")
def binary_scores(spark, sf):
    s = me.scores(st.scored(spark, sf), ["lang"])
    return s.select("lang", "n", F.round("log_loss", 8).alias("log_loss"), F.round("brier", 8).alias("brier"))


@query("multiclass_scores", CLASSES_SQL + """
  SELECT lang, round(avg(-ln(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)), 8) AS log_loss,
    round(avg(power(p0 - (y = 0)::INT, 2) + power(p1 - (y = 1)::INT, 2) + power(p2 - (y = 2)::INT, 2)), 8) AS brier,
    round(avg((power(p0 - (y <= 0)::INT, 2) + power(p0 + p1 - (y <= 1)::INT, 2)) / 2), 8) AS rps FROM classes GROUP BY 1""")
def multiclass_scores(spark, sf):
    y, probs = F.col("y"), F.col("probs")
    return classes(spark, sf).groupBy("lang").agg(
        F.round(me.multiclass_log_loss(y, probs), 8).alias("log_loss"), F.round(me.multiclass_brier(y, probs), 8).alias("brier"),
        F.round(me.ranked_probability_score(y, probs), 8).alias("rps"))


WIDTH_SQL = st.SCORED_SQL + """, edges AS (SELECT i AS bin, i / 10.0 AS lo, (i + 1) / 10.0 AS hi FROM range(0, 10) r(i)),
  bins AS (SELECT CAST(bin AS INT) AS bin, lo AS bin_lo, hi AS bin_hi, count(*) AS n, avg(p) AS mean_predicted, avg(y) AS observed_rate
    FROM scored JOIN edges ON p >= lo AND (p < hi OR hi >= 1.0) GROUP BY 1, 2, 3)"""
QUANTILE_SQL = st.SCORED_SQL + """, cuts AS (SELECT DISTINCT unnest(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM scored),
  ended AS (SELECT CASE WHEN e = min(e) OVER () THEN 0.0 WHEN e = max(e) OVER () THEN 1.0 ELSE e END AS e FROM cuts),
  edges AS (SELECT row_number() OVER (ORDER BY e) - 1 AS bin, e AS lo, lead(e) OVER (ORDER BY e) AS hi FROM ended),
  bins AS (SELECT CAST(bin AS INT) AS bin, lo AS bin_lo, hi AS bin_hi, count(*) AS n, avg(p) AS mean_predicted, avg(y) AS observed_rate
    FROM scored JOIN edges ON hi IS NOT NULL AND p >= lo AND (p < hi OR hi >= 1.0) GROUP BY 1, 2, 3)"""
BINS = " SELECT bin, n, round(bin_lo, 8) AS bin_lo, round(bin_hi, 8) AS bin_hi, round(mean_predicted, 8) AS mean_predicted, round(observed_rate, 8) AS observed_rate FROM bins"
ECE = "sum(n * abs(mean_predicted - observed_rate)) / sum(n)"


def shown_bins(bins):
    return bins.select("bin", "n", *[F.round(c, 8).alias(c) for c in ("bin_lo", "bin_hi", "mean_predicted", "observed_rate")])


@query("reliability_width", WIDTH_SQL + BINS)
def reliability_width(spark, sf):
    return shown_bins(me.reliability(st.scored(spark, sf)))


@query("reliability_quantile", QUANTILE_SQL + BINS)
def reliability_quantile(spark, sf):
    return shown_bins(me.reliability(st.scored(spark, sf), binning="quantile"))


@query("calibration_error", WIDTH_SQL + f" SELECT round({ECE}, 8) AS ece FROM bins")
def calibration_error(spark, sf):
    return me.calibration_error(me.reliability(st.scored(spark, sf))).select(F.round("ece", 8).alias("ece"))


@query("calibration_error_quantile", QUANTILE_SQL + f" SELECT round({ECE}, 8) AS ece FROM bins")
def calibration_error_quantile(spark, sf):
    bins = me.reliability(st.scored(spark, sf), binning="quantile")
    return me.calibration_error(bins).select(F.round("ece", 8).alias("ece"))


def newton_sql(rows: str, steps: int = 15) -> str:
    """CTEs that run Newton's method on rows(g, x, y); each step solves the 2x2 system in SQL."""
    out = [f"pts AS MATERIALIZED (SELECT g, ln(q / (1 - q)) AS x, y FROM (SELECT g, y, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM {rows}))",
           "n0 AS MATERIALIZED (SELECT g, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 FROM (SELECT DISTINCT g FROM pts))"]
    for i in range(1, steps + 1):
        out.append(
            f"s{i} AS MATERIALIZED (SELECT g, a, b, sum(y - pi) AS r0, sum((y - pi) * x) AS r1, sum(greatest(pi * (1 - pi), 1e-10)) + 1e-8 AS w0, "
            f"sum(greatest(pi * (1 - pi), 1e-10) * x) AS w1, sum(greatest(pi * (1 - pi), 1e-10) * x * x) + 1e-8 AS w2 "
            f"FROM (SELECT g, a, b, x, y, 1 / (1 + exp(-(a + b * x))) AS pi FROM pts JOIN n{i - 1} USING (g)) GROUP BY 1, 2, 3)")
        out.append(
            f"n{i} AS MATERIALIZED (SELECT g, a + (r0 * w2 - r1 * w1) / (w0 * w2 - w1 * w1) AS a, b + (r1 * w0 - r0 * w1) / (w0 * w2 - w1 * w1) AS b, w0, w1, w2 FROM s{i})")
    out.append(f"slopes AS (SELECT g, b AS slope, a AS intercept, sqrt(w0 / (w0 * w2 - w1 * w1)) AS slope_se FROM n{steps})")
    return ", ".join(out)


SLOPE_SHOW = "round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(slope_se, 6) AS slope_se"


def shown_slopes(df, *keep):
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "slope_se")])


@query("calibration_slope", st.SCORED_SQL + ", " + newton_sql("(SELECT half AS g, y, p FROM scored)") + f" SELECT g AS half, {SLOPE_SHOW} FROM slopes")
def calibration_slope(spark, sf):
    return shown_slopes(me.calibration_slope(st.scored(spark, sf), "half"), "half")


USABLE = ("NOT (0 BETWEEN slope - 1.959963985 * slope_se AND slope + 1.959963985 * slope_se) AS slope_usable, "
          "NOT (1 BETWEEN slope - 1.959963985 * slope_se AND slope + 1.959963985 * slope_se) AS departs_from_one")


@query("slope_usability", st.SCORED_SQL + ", " + newton_sql("(SELECT half AS g, y, p FROM scored)") + f" SELECT g AS half, round(slope, 6) AS slope, {USABLE} FROM slopes")
def slope_usability(spark, sf):
    s = me.slope_usability(me.calibration_slope(st.scored(spark, sf), "half"))
    return s.select("half", F.round("slope", 6).alias("slope"), "slope_usable", "departs_from_one")


REST_SQL = CLASSES_SQL + """, rest AS (SELECT 0 AS g, (y = 0)::INT AS y, p0 AS p FROM classes UNION ALL SELECT 1, (y = 1)::INT, p1 FROM classes
  UNION ALL SELECT 2, (y = 2)::INT, p2 FROM classes)"""


def report_sql(rows_cte: str) -> str:
    return f""", {newton_sql('(SELECT g, y, p FROM ' + rows_cte + ')')},
  base AS (SELECT g, count(*) AS n, {LL} AS log_loss, avg(power(p - y, 2)) AS brier FROM {rows_cte} GROUP BY 1),
  binned AS (SELECT g, i, count(*) AS n, avg(p) AS mp, avg(y) AS mo FROM {rows_cte}, range(0, 10) r(i)
    WHERE p >= i / 10.0 AND (p < (i + 1) / 10.0 OR i = 9) GROUP BY 1, 2),
  eced AS (SELECT g, sum(n * abs(mp - mo)) / sum(n) AS ece FROM binned GROUP BY 1),
  report AS (SELECT g, n, log_loss, brier, ece, slope, intercept, slope_se, {USABLE} FROM base JOIN eced USING (g) JOIN slopes USING (g))"""


REPORT_SHOW = f"n, round(log_loss, 7) AS log_loss, round(brier, 7) AS brier, round(ece, 7) AS ece, {SLOPE_SHOW}, slope_usable, departs_from_one"


def shown_report(df, *keep):
    return df.select(*keep, "n", *[F.round(c, 7).alias(c) for c in ("log_loss", "brier", "ece")],
                     *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "slope_se")], "slope_usable", "departs_from_one")


EACH_QUANTILE_SQL = """, cuts AS (SELECT DISTINCT g, unnest(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM rest GROUP BY g),
  ended AS (SELECT g, CASE WHEN e = min(e) OVER (PARTITION BY g) THEN 0.0 WHEN e = max(e) OVER (PARTITION BY g) THEN 1.0 ELSE e END AS e FROM cuts),
  edges AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY e) - 1 AS bin, e AS lo, lead(e) OVER (PARTITION BY g ORDER BY e) AS hi FROM ended),
  qb AS (SELECT rest.g, CAST(bin AS INT) AS bin, lo AS bin_lo, hi AS bin_hi, count(*) AS n, avg(p) AS mean_predicted, avg(y) AS observed_rate
    FROM rest JOIN edges ON rest.g = edges.g AND hi IS NOT NULL AND p >= lo AND (p < hi OR hi >= 1.0) GROUP BY 1, 2, 3, 4)"""


@query("evaluate_each_class", REST_SQL + report_sql("rest") + EACH_QUANTILE_SQL + f""" SELECT g AS outcome, {REPORT_SHOW}, ece_quantile
  FROM report JOIN (SELECT g, round({ECE}, 7) AS ece_quantile FROM qb GROUP BY 1) USING (g)""")
def evaluate_each_class(spark, sf):
    report, _ = me.evaluate_classes(classes(spark, sf))
    return shown_report(report.withColumn("ece_quantile", F.round("ece_quantile", 7)), "outcome", "ece_quantile")


@query("reliability_each_class", REST_SQL + EACH_QUANTILE_SQL + """, wb AS (SELECT g, CAST(i AS INT) AS bin, i / 10.0 AS bin_lo, (i + 1) / 10.0 AS bin_hi, count(*) AS n,
    avg(p) AS mean_predicted, avg(y) AS observed_rate FROM rest, range(0, 10) r(i) WHERE p >= i / 10.0 AND (p < (i + 1) / 10.0 OR i = 9) GROUP BY 1, 2, 3, 4),
  bins AS (SELECT *, 'width' AS binning FROM wb UNION ALL BY NAME SELECT *, 'quantile' AS binning FROM qb)""" + BINS.replace("SELECT bin", "SELECT g AS outcome, binning, bin"))
def reliability_each_class(spark, sf):
    _, bins = me.evaluate_classes(classes(spark, sf))
    return bins.select("outcome", "binning", "bin", "n", *[F.round(c, 8).alias(c) for c in ("bin_lo", "bin_hi", "mean_predicted", "observed_rate")])


@query("metrics_by_group", st.SCORED_SQL + ", by_half AS (SELECT half AS g, y, p FROM scored)" + report_sql("by_half") + f" SELECT g AS half, {REPORT_SHOW} FROM report")
def metrics_by_group(spark, sf):
    return shown_report(me.evaluate(st.scored(spark, sf), "half"), "half")


@query("evaluate_binary", st.SCORED_SQL + ", whole AS (SELECT 0 AS g, y, p FROM scored)" + report_sql("whole") + """,
  cuts AS (SELECT DISTINCT unnest(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM scored),
  ended AS (SELECT CASE WHEN e = min(e) OVER () THEN 0.0 WHEN e = max(e) OVER () THEN 1.0 ELSE e END AS e FROM cuts),
  edges AS (SELECT e AS lo, lead(e) OVER (ORDER BY e) AS hi FROM ended),
  qb AS (SELECT lo, count(*) AS n, avg(p) AS mp, avg(y) AS mo FROM scored JOIN edges ON hi IS NOT NULL AND p >= lo AND (p < hi OR hi >= 1.0) GROUP BY 1)
  SELECT """ + REPORT_SHOW + ", (SELECT round(sum(n * abs(mp - mo)) / sum(n), 7) FROM qb) AS ece_quantile FROM report")
def evaluate_binary(spark, sf):
    r = me.evaluate_binary(st.scored(spark, sf)).withColumn("ece_quantile", F.round("ece_quantile", 7))
    return shown_report(r, "ece_quantile")


# -- comparisons -------------------------------------------------------------------------------------

BASELINE_SQL = st.SCORED_SQL + """, b AS (SELECT *, avg(y) OVER (PARTITION BY lang) AS group_rate, 0.5::DOUBLE AS coin FROM scored)"""


def with_baselines(spark, sf):
    rows = st.scored(spark, sf)
    rates = me.group_rates(rows, "lang", F.col("y") == 1).withColumnRenamed("rate", "group_rate")
    return rows.join(rates, "lang").withColumn("coin", F.lit(0.5))


def ll_sql(p):
    return f"avg(-(y * ln(least(greatest({p}, 1e-12), 1 - 1e-12)) + (1 - y) * ln(1 - least(greatest({p}, 1e-12), 1 - 1e-12))))"


@query("model_against_baselines", BASELINE_SQL + f""", t AS (SELECT count(*) AS n, {ll_sql('p')} AS ml, avg(power(p - y, 2)) AS mb, {ll_sql('group_rate')} AS gl,
    avg(power(group_rate - y, 2)) AS gb, {ll_sql('coin')} AS cl, avg(power(coin - y, 2)) AS cb FROM b)
  SELECT n, round(ml, 7) AS model_log_loss, round(mb, 7) AS model_brier, round(gl, 7) AS group_log_loss, round(gb, 7) AS group_brier,
    round(cl, 7) AS coin_log_loss, round(cb, 7) AS coin_brier, ml < gl AND mb < gb AND ml < cl AND mb < cb AS beats_baselines FROM t""")
def model_against_baselines(spark, sf):
    c = me.compare_models(with_baselines(spark, sf), "p", {"group": "group_rate", "coin": "coin"})
    return c.select("n", *[F.round(f"{m}_{s}", 7).alias(f"{m}_{s}") for m in ("model", "group", "coin") for s in ("log_loss", "brier")], "beats_baselines")


@query("calibrated_not_worse", st.SCORED_SQL + f""", t AS (SELECT lang, count(*) AS n, {ll_sql('0.5 * p + 0.4')} AS ml, avg(power(0.5 * p + 0.4 - y, 2)) AS mb,
    {ll_sql('p')} AS rl, avg(power(p - y, 2)) AS rb FROM scored GROUP BY 1)
  SELECT lang, n, round(ml, 7) AS model_log_loss, round(mb, 7) AS model_brier, round(rl, 7) AS raw_log_loss, round(rb, 7) AS raw_brier,
    ml <= rl + 1e-9 AND mb <= rb + 1e-9 AS not_worse FROM t""")
def calibrated_not_worse(spark, sf):
    rows = st.scored(spark, sf).withColumn("calibrated", 0.5 * F.col("p") + 0.4)
    c = me.not_worse(rows, "p", "calibrated", key=["lang"])
    return c.select("lang", "n", *[F.round(f"{m}_{s}", 7).alias(f"{m}_{s}") for m in ("model", "raw") for s in ("log_loss", "brier")], "not_worse")


@query("feature_value_deltas", st.SCORED_SQL + f""" SELECT count(*) AS n, round({ll_sql('0.5 * p + 0.4')} - {ll_sql('p')}, 7) AS delta_log_loss,
    round(avg(power(0.5 * p + 0.4 - y, 2)) - avg(power(p - y, 2)), 7) AS delta_brier FROM scored""")
def feature_value_deltas(spark, sf):
    rows = st.scored(spark, sf)
    d = me.feature_value(rows.withColumn("p", 0.5 * F.col("p") + 0.4), rows, "doc_id")
    return d.select("n", F.round("delta_log_loss", 7).alias("delta_log_loss"), F.round("delta_brier", 7).alias("delta_brier"))


@query("gate_verdicts", REST_SQL + report_sql("rest") + """, rates AS (SELECT g, avg(y) AS r FROM rest GROUP BY 1),
  beat AS (SELECT g, """ + f"{LL} < {ll_sql('r')} AND avg(power(p - y, 2)) < avg(power(r - y, 2)) AS beats_baselines" + """ FROM rest JOIN rates USING (g) GROUP BY 1)
  SELECT g AS outcome, CASE WHEN NOT slope_usable THEN 'BASE-RATE-ONLY' WHEN NOT beats_baselines THEN 'FAIL'
    WHEN departs_from_one AND g <> 1 THEN 'PASS-with-accepted-departure' ELSE 'PASS' END AS verdict FROM report JOIN beat USING (g)""")
def gate_verdicts(spark, sf):
    rest = me.one_vs_rest(classes(spark, sf))
    rates = rest.groupBy("outcome").agg(F.avg("y").alias("base"))
    beats = me.compare_models(rest.join(rates, "outcome"), "p", {"base": "base"}, key=["outcome"]).select("outcome", "beats_baselines")
    table = me.evaluate(rest, "outcome").join(beats, "outcome").withColumn(
        "calibrator_built", F.col("outcome") == 1).withColumn("decision_text", F.lit("departure accepted"))
    return me.verdicts(table).select("outcome", "verdict")


@query("report_over_models", st.SCORED_SQL + """, runs AS (SELECT 'raw' AS g, y, p FROM scored UNION ALL SELECT 'shrunk', y, 0.5 * p + 0.4 FROM scored
    UNION ALL SELECT 'flipped', y, 1 - p FROM scored)""" + report_sql("runs") + f" SELECT g AS model, {REPORT_SHOW} FROM report")
def report_over_models(spark, sf):
    rows = st.scored(spark, sf)
    p = F.col("p")
    runs = rows.select("y", F.inline(F.array(*[F.struct(F.lit(n).alias("model"), v.alias("p")) for n, v in (
        ("raw", p), ("shrunk", 0.5 * p + 0.4), ("flipped", 1 - p))])))
    return shown_report(me.evaluate(runs, "model"), "model")


# -- class baselines ---------------------------------------------------------------------------------

def baseline_sql(trail, outcome, names, source):
    shares = ", ".join(f"avg(({outcome} = {k})::INT) AS s{k}" for k in range(len(names)))
    filled = ", ".join(f"coalesce(t.{n}, s{k}) AS f{k}" for k, n in enumerate(names))
    total = " + ".join(f"f{k}" for k in range(len(names)))
    out = ", ".join(f"round(CASE WHEN {total} > 0 THEN f{k} / ({total}) ELSE s{k} END, 8) AS b{k}" for k in range(len(names)))
    return (f"{trail}, shares AS (SELECT position, {shares} FROM used GROUP BY 1), "
            f"filled AS (SELECT {', '.join('u.' + c for c in ROWS)}, s.*, {filled} FROM used u JOIN trail t USING (season, element, round) JOIN shares s USING (position)) "
            f"SELECT {ROW}, {out} FROM filled")


CARD_RATES = [f"player_trailing_cards_class_rate_{k}_5" for k in range(3)]
BONUS_RATES = [f"player_trailing_bonus_class_rate_{k}_5" for k in range(4)]


def class_baseline(rows, features, outcome, names):
    joined = fe.attach_player(rows, features)
    shares = me.class_shares(rows, ["position"], outcome, range(len(names)))
    base = me.trailing_class_baseline([F.col(n) for n in names], F.col("shares"))
    out = joined.join(small(shares), "position").select(*ROWS, base.alias("b"))
    return out.select(*ROWS, *[F.round(F.get("b", F.lit(k)), 8).alias(f"b{k}") for k in range(len(names))])


@query("card_class_baselines", baseline_sql(CARDS_TRAIL, "outcome", CARD_RATES, "used"))
def card_class_baselines(spark, sf):
    rows = fe.card_outcome(fe.eligible(st.facts(spark, sf)))
    return class_baseline(rows, fe.cards_trail(fe.cards_rounds(rows)), "outcome", CARD_RATES)


@query("bonus_class_baselines", baseline_sql(BONUS_TRAIL, "bonus", BONUS_RATES, "used"))
def bonus_class_baselines(spark, sf):
    rows = fe.eligible(st.facts(spark, sf))
    return class_baseline(rows, fe.bonus_trail(fe.bonus_rounds(rows)), "bonus", BONUS_RATES)


@query("walk_forward_rates", st.SCORED_SQL + """, cells AS (SELECT fold, lang, count(*) AS n, sum(y) AS s FROM scored GROUP BY 1, 2),
  whole AS (SELECT fold, sum(n) AS n, sum(s) AS s FROM cells GROUP BY 1),
  past AS (SELECT fold, sum(n) OVER w AS train_rows, sum(s) OVER w / sum(n) OVER w AS overall_rate FROM whole
    WINDOW w AS (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  own AS (SELECT fold, lang, sum(s) OVER w / sum(n) OVER w AS r FROM cells
    WINDOW w AS (PARTITION BY lang ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT fold, lang, CAST(train_rows AS BIGINT) AS train_rows, round(overall_rate, 8) AS overall_rate, round(coalesce(r, overall_rate), 8) AS rate
  FROM own JOIN past USING (fold) WHERE train_rows >= 20""")
def walk_forward_rates(spark, sf):
    rates = fi.walk_forward_rates(st.scored(spark, sf), "fold", F.col("y") == 1, ["lang"], 20)
    return rates.select("fold", "lang", "train_rows", F.round("overall_rate", 8).alias("overall_rate"), F.round("rate", 8).alias("rate"))


# -- isotonic calibration ----------------------------------------------------------------------------

ISO_SQL = st.SCORED_SQL + """, ranked AS (SELECT *, row_number() OVER (ORDER BY p, doc_id) - 1 AS i, count(*) OVER () AS n FROM scored),
  bins AS (SELECT least(i * 20 // n, 19) AS bin, avg(p) AS x, (sum(y) + 0.5) / (count(*) + 1.0) AS rate, count(*) AS w FROM ranked GROUP BY 1),
  spans AS (SELECT a.bin AS lo, b.bin AS hi, sum(m.rate * m.w) / sum(m.w) AS v FROM bins a JOIN bins b ON a.bin <= b.bin JOIN bins m ON m.bin BETWEEN a.bin AND b.bin GROUP BY 1, 2),
  mins AS (SELECT s.lo, c.bin, min(s.v) AS v FROM spans s JOIN bins c ON s.lo <= c.bin AND s.hi >= c.bin GROUP BY 1, 2),
  fitted AS (SELECT bin, max(v) AS fitted FROM mins GROUP BY 1)"""


@query("isotonic_knots", ISO_SQL + """
  SELECT CAST(bin AS INT) AS bin, round(x, 8) AS x, round(rate, 8) AS rate, CAST(w AS DOUBLE) AS weight, round(fitted, 8) AS fitted FROM bins JOIN fitted USING (bin)""")
def isotonic_knots(spark, sf):
    fitted = fi.fit_isotonic(st.scored(spark, sf), "p", "y", ["doc_id"])
    return fitted.select("bin", *[F.round(c, 8).alias(c) for c in ("x", "rate", "fitted")], "weight")


@query("equal_count_bins", ISO_SQL + " SELECT doc_id, CAST(least(i * 20 // n, 19) AS INT) AS bin FROM ranked")
def equal_count_bins(spark, sf):
    return fi.equal_count_bins(st.scored(spark, sf), 20, ["p", "doc_id"]).select("doc_id", "bin")


@query("isotonic_calibrated", ISO_SQL + """, k AS (SELECT x, fitted, lead(x) OVER (ORDER BY x) AS x1, lead(fitted) OVER (ORDER BY x) AS f1 FROM bins JOIN fitted USING (bin))
  SELECT doc_id, round(CASE WHEN p <= (SELECT min(x) FROM k) THEN (SELECT arg_min(fitted, x) FROM k) WHEN p >= (SELECT max(x) FROM k) THEN (SELECT arg_max(fitted, x) FROM k)
    ELSE (SELECT max(fitted + (p - x) * (f1 - fitted) / (x1 - x)) FROM k WHERE p > x AND p <= x1) END, 7) AS calibrated FROM scored""")
def isotonic_calibrated(spark, sf):
    from tidemark.functions.maths import interpolate

    rows = st.scored(spark, sf)
    curve = fi.knots(fi.fit_isotonic(rows, "p", "y", ["doc_id"]))
    return rows.select("doc_id", F.round(interpolate(F.col("p"), curve), 7).alias("calibrated"))
