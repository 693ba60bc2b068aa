"""Decision logs: transfers, holds, ledgers and comparisons."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from tidemark.operators import decisions as de
from tidemark.plans import standins as st
from tidemark.plans.registry import query, table

MOVES_SQL = """WITH ev AS (
  SELECT '2024-25' AS season, user_id AS arm, CAST(day(ts) AS INT) AS gameweek, event_id % 20 AS element,
    CASE WHEN event_type IN ('signup', 'view') THEN 1 ELSE 0 END AS is_in, CAST(40 + floor(min(value)) % 60 AS INT) AS price
  FROM events GROUP BY 1, 2, 3, 4, 5)"""
HOLDS_SQL = MOVES_SQL + """,
 rec0 AS (SELECT season, arm, gameweek, count(*) FILTER (is_in = 1) AS n_in, count(*) FILTER (is_in = 0) AS n_out FROM ev GROUP BY 1, 2, 3),
 rec AS (SELECT *, n_out = 0 AND n_in > 0 AND (gameweek = min(gameweek) OVER (PARTITION BY season, arm) OR n_in = 15) AS free_build FROM rec0),
 marked AS (SELECT ev.*, free_build, max(CASE WHEN free_build THEN 1 ELSE 0 END) OVER (PARTITION BY season, arm, element) AS opened
   FROM ev JOIN rec USING (season, arm, gameweek)),
 paired AS (SELECT *, lag(is_in) OVER w AS kind, lag(gameweek) OVER w AS week, lead(is_in) OVER w IS NULL AS is_last
   FROM marked WHERE NOT free_build WINDOW w AS (PARTITION BY season, arm, element ORDER BY gameweek, is_in)),
 held AS (SELECT season, arm, element, gameweek,
   CASE WHEN is_in = 0 AND kind = 1 THEN gameweek - week END AS hold, is_in = 1 AS is_purchase, is_in = 1 AND is_last AS is_censored,
   is_in = 0 AND coalesce(kind, 0) <> 1 AND opened = 1 AS is_initial_sale,
   CASE WHEN is_in = 1 AND kind = 0 THEN gameweek - week END AS round_trip FROM paired)"""


def moves(spark, sf):
    events = table(spark, sf, "events")
    return events.groupBy(
        F.lit("2024-25").alias("season"), F.col("user_id").alias("arm"), F.dayofmonth("ts").alias("gameweek"),
        (F.col("event_id") % 20).alias("element"),
        F.when(F.col("event_type").isin("signup", "view"), 1).otherwise(0).alias("is_in"),
    ).agg((40 + F.floor(F.min("value")) % 60).cast("int").alias("price"))


def records(spark, sf):
    rows = moves(spark, sf).groupBy("season", "arm", "gameweek").agg(
        F.array_sort(F.collect_set(F.when(F.col("is_in") == 1, F.col("element")))).alias("transfers_in"),
        F.array_sort(F.collect_set(F.when(F.col("is_in") == 0, F.col("element")))).alias("transfers_out"))
    first = F.min("gameweek").over(W.partitionBy("season", "arm"))
    later = F.sequence(F.lit(1).cast("bigint"), F.lit(15).cast("bigint"))
    squad = F.when(F.col("gameweek") == first, F.col("transfers_in")).otherwise(later)
    return rows.withColumn("squad_element_ids", squad).withColumn(
        "hit_points", de.hit_points(F.size("transfers_out"), F.lit(1)))


@query("free_builds", HOLDS_SQL + " SELECT season, arm, gameweek, CAST(n_in AS INT) AS count FROM rec WHERE free_build")
def free_builds(spark, sf):
    return de.free_builds(records(spark, sf))


@query("hold_events", HOLDS_SQL + """
  SELECT season, arm, element, gameweek, CAST(hold AS DOUBLE) AS hold, is_purchase, is_censored, is_initial_sale,
    CAST(round_trip AS DOUBLE) AS round_trip FROM held""")
def hold_events(spark, sf):
    held = de.holds(records(spark, sf))
    return held.withColumn("hold", F.col("hold").cast("double")).withColumn("round_trip", F.col("round_trip").cast("double"))


@query("hold_lengths", HOLDS_SQL + """
  SELECT season, arm, count(hold) AS count, round(avg(hold), 6) AS mean, quantile_cont(hold, 0.5) AS median,
    quantile_cont(hold, 0.25) AS q1, quantile_cont(hold, 0.75) AS q3, count(*) FILTER (is_censored) AS censored_count,
    count(*) FILTER (is_initial_sale) AS initial_squad_sales FROM held GROUP BY 1, 2""")
def hold_lengths(spark, sf):
    return de.hold_lengths(records(spark, sf)).withColumn("mean", F.round("mean", 6))


@query("churn_fractions", HOLDS_SQL + """
  SELECT season, arm, count(*) FILTER (is_purchase) AS total_purchases, count(*) FILTER (is_censored) AS censored_count,
  """ + ", ".join(f"round(count(*) FILTER (hold < {n}) / nullif(count(*) FILTER (is_purchase), 0), 6) AS lt_{n}" for n in (1, 2, 3, 6))
  + " FROM held GROUP BY 1, 2")
def churn_fractions(spark, sf):
    shares = de.churn(records(spark, sf))
    return shares.select("season", "arm", "total_purchases", "censored_count",
                         *[F.round(f"lt_{n}", 6).alias(f"lt_{n}") for n in de.CHURN_LIMITS])


@query("transfer_counts", MOVES_SQL + """
  SELECT season, arm, gameweek, CAST(count(*) FILTER (is_in = 0) AS INT) AS n_transfers,
    CAST(-4 * greatest(0, count(*) FILTER (is_in = 0) - 1) AS INT) AS hit_points FROM ev GROUP BY 1, 2, 3""")
def transfer_counts(spark, sf):
    return de.transfer_counts(records(spark, sf))


@query("round_trips", HOLDS_SQL + """
  SELECT season, arm, count(round_trip) AS count, round(avg(round_trip), 6) AS mean, quantile_cont(round_trip, 0.5) AS median,
    quantile_cont(round_trip, 0.25) AS q1, quantile_cont(round_trip, 0.75) AS q3 FROM held GROUP BY 1, 2""")
def round_trips(spark, sf):
    return de.round_trips(records(spark, sf)).withColumn("mean", F.round("mean", 6))


ARMS_SQL = st.FACTS_SQL + """, results AS (
  SELECT season, CASE WHEN element % 2 = 0 THEN 'h6' ELSE 'h1' END AS arm, round, sum(total_points) AS points FROM facts GROUP BY 1, 2, 3)"""
COMPARE_SQL = ARMS_SQL + """, compared AS (
  SELECT season, CAST(sum(points) FILTER (arm = 'h6') AS BIGINT) AS first_total, CAST(sum(points) FILTER (arm = 'h1') AS BIGINT) AS second_total,
    count(*) FILTER (arm = 'h6') AS first_rounds, count(*) FILTER (arm = 'h1') AS second_rounds FROM results GROUP BY 1)"""


def results(spark, sf):
    arm = F.when(F.col("element") % 2 == 0, "h6").otherwise("h1")
    return st.facts(spark, sf).groupBy("season", arm.alias("arm"), "round").agg(F.sum("total_points").alias("points"))


@query("compare_arms", COMPARE_SQL + """
  SELECT *, first_total - second_total AS difference, first_total > second_total AS first_ahead FROM compared""")
def compare_arms(spark, sf):
    return de.compare_arms(results(spark, sf), "h6", "h1")


@query("arms_across_seasons", COMPARE_SQL + """
  SELECT count(*) AS n_seasons, count(*) FILTER (first_total > second_total) AS seasons_first_ahead,
    round(avg(first_total), 6) AS first_mean, round(avg(second_total), 6) AS second_mean FROM compared""")
def arms_across_seasons(spark, sf):
    whole = de.across_seasons(de.compare_arms(results(spark, sf), "h6", "h1"))
    return whole.withColumn("first_mean", F.round("first_mean", 6)).withColumn("second_mean", F.round("second_mean", 6))


@query("season_summary", ARMS_SQL + """
  SELECT season, arm, count(points) AS n_rounds, CAST(sum(points) AS BIGINT) AS total, round(avg(points), 6) AS mean,
    round(stddev_pop(points), 6) AS std, CAST(min(points) AS BIGINT) AS min, CAST(max(points) AS BIGINT) AS max,
    count(*) FILTER (points = 0) AS zero_rounds, """ + ", ".join(
    f"round(quantile_cont(points, {q}), 6) AS {n}" for n, q in
    (("median", 0.5), ("p5", 0.05), ("p25", 0.25), ("p75", 0.75), ("p95", 0.95))) + " FROM results GROUP BY 1, 2")
def season_summary(spark, sf):
    whole = de.season_summary(results(spark, sf), de.ARM)
    for c in ("mean", "std", "median", "p5", "p25", "p75", "p95"):
        whole = whole.withColumn(c, F.round(c, 6))
    return whole


@query("sweep_outcome", """WITH parts AS (
    SELECT user_id AS sweep, CASE WHEN event_id % 37 = 0 THEN 'written' WHEN event_type = 'error' THEN 'failed' ELSE 'unchanged' END AS outcome,
      CASE WHEN event_type = 'error' THEN 'hour ' || hour(ts) % 6 END AS error FROM events)
  SELECT sweep, CASE WHEN max(CASE outcome WHEN 'written' THEN 3 WHEN 'failed' THEN 2 ELSE 1 END) = 3 THEN 'written'
      WHEN max(CASE outcome WHEN 'written' THEN 3 WHEN 'failed' THEN 2 ELSE 1 END) = 2 THEN 'failed' ELSE 'unchanged' END AS outcome,
    coalesce(string_agg(DISTINCT error, '; ' ORDER BY error), '') AS errors FROM parts GROUP BY 1""")
def sweep_outcome(spark, sf):
    parts = table(spark, sf, "events").select(
        F.col("user_id").alias("sweep"),
        F.when(F.col("event_id") % 37 == 0, "written").when(F.col("event_type") == "error", "failed").otherwise("unchanged").alias("outcome"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("hour "), (F.hour("ts") % 6).cast("string"))).alias("error"))
    return de.sweep_outcome(parts, ["sweep"])


# -- money and transfers -----------------------------------------------------------------------------

@query("sell_price", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE WHEN c <= p THEN c ELSE p + (c - p) // 2 END AS INT) AS sell_price
  FROM (SELECT *, CAST(40 + l_partkey % 90 AS INT) AS p, CAST(40 + l_suppkey % 90 AS INT) AS c FROM lineitem)""")
def sell_price(spark, sf):
    lines = table(spark, sf, "lineitem")
    bought, now = (40 + F.col("l_partkey") % 90).cast("int"), (40 + F.col("l_suppkey") % 90).cast("int")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", de.sell_price(bought, now).alias("sell_price"))


@query("paid_transfers", MOVES_SQL + """
  SELECT season, arm, gameweek, CAST(-4 * greatest(0, count(*) FILTER (is_in = 0) - 2) AS INT) AS hit_points FROM ev GROUP BY 1, 2, 3""")
def paid_transfers(spark, sf):
    counts = moves(spark, sf).groupBy("season", "arm", "gameweek").agg(F.count_if(F.col("is_in") == 0).cast("int").alias("n"))
    return counts.select("season", "arm", "gameweek", de.hit_points(F.col("n"), F.lit(2)).alias("hit_points"))


@query("free_transfer_bank", MOVES_SQL.replace("WITH ev", "WITH RECURSIVE ev", 1) + """,
  counts AS (SELECT season, arm, gameweek AS round, CAST(count(*) FILTER (is_in = 0) AS INT) AS n_transfers,
    row_number() OVER (PARTITION BY season, arm ORDER BY gameweek) AS i FROM ev GROUP BY 1, 2, 3),
  bank AS (
    SELECT season, arm, round, n_transfers, i, 1 AS free FROM counts WHERE i = 1
    UNION ALL
    SELECT c.season, c.arm, c.round, c.n_transfers, c.i,
      CASE WHEN b.round + 1 = 16 THEN greatest(5, least(greatest(0, b.free - b.n_transfers) + 1, 5))
           ELSE least(greatest(0, b.free - b.n_transfers) + 1, 5) END
    FROM bank b JOIN counts c ON c.season = b.season AND c.arm = b.arm AND c.i = b.i + 1)
  SELECT season, arm, round, n_transfers, free, -4 * greatest(0, n_transfers - free) AS hit_points FROM bank""")
def free_transfer_bank(spark, sf):
    counts = moves(spark, sf).groupBy("season", "arm", F.col("gameweek").alias("round")).agg(
        F.count_if(F.col("is_in") == 0).alias("n_transfers"))
    return de.free_transfer_bank(counts, top_ups={16: 5})


@query("cash_ledger", MOVES_SQL + """, priced AS (
   SELECT *, last_value(CASE WHEN is_in = 1 THEN price END IGNORE NULLS) OVER (PARTITION BY season, arm, element ORDER BY gameweek, is_in
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bought FROM ev),
  weeks AS (SELECT season, arm, gameweek, CAST(sum(CASE WHEN is_in = 1 THEN -price WHEN price <= coalesce(bought, price) THEN price
     ELSE bought + (price - bought) // 2 END) AS BIGINT) AS delta FROM priced GROUP BY 1, 2, 3)
  SELECT *, CAST(1000 + sum(delta) OVER (PARTITION BY season, arm ORDER BY gameweek) AS BIGINT) AS bank,
    1000 + sum(delta) OVER (PARTITION BY season, arm ORDER BY gameweek) < 0 AS overspent FROM weeks""")
def cash_ledger(spark, sf):
    return de.cash_ledger(moves(spark, sf), 1000)


@query("transfer_continuity", MOVES_SQL + """, rec AS (
   SELECT season, arm, gameweek, coalesce(list(element) FILTER (is_in = 1), []) AS tin, coalesce(list(element) FILTER (is_in = 0), []) AS tout FROM ev GROUP BY 1, 2, 3),
  squads AS (SELECT *, CASE WHEN gameweek = min(gameweek) OVER (PARTITION BY season, arm) THEN tin ELSE range(1, 16) END AS squad FROM rec),
  seq AS (SELECT *, lag(squad) OVER (PARTITION BY season, arm ORDER BY gameweek) AS b FROM squads)
  SELECT season, arm, gameweek, CAST(len(list_filter(tout, lambda x: NOT list_contains(b, x))) AS INT) AS sold_not_held,
    CAST(len(list_filter(tin, lambda x: NOT list_contains(squad, x))) AS INT) AS bought_not_in_squad,
    list_sort(list_distinct(list_concat(list_filter(b, lambda x: NOT list_contains(tout, x)), tin))) <> list_sort(squad) AS squad_differs
  FROM seq WHERE b IS NOT NULL""")
def transfer_continuity(spark, sf):
    return de.continuity_checks(records(spark, sf))
