"""Time-travel reads over the event log."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import timetravel as tt
from tidemark.plans import standins as st
from tidemark.plans.registry import query, table

KEY = ["user_id", "event_type"]
CUT = datetime(2024, 1, 15, 12, tzinfo=timezone.utc)
SHOW = ["user_id", "event_type", "batch_id", "value"]

STATE_SQL = st.LOG_SQL + """, state AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY observed_at DESC, batch_id DESC) rn
                 FROM log WHERE observed_at <= TIMESTAMP '2024-01-15 12:00:00') WHERE rn = 1)"""


@query("as_of_state", STATE_SQL + " SELECT user_id, event_type, batch_id, value FROM state")
def as_of_state(spark: SparkSession, sf: str) -> DataFrame:
    return tt.as_of(st.log(spark, sf), KEY, CUT).select(*SHOW)


@query("as_of_singleton", st.LOG_SQL + """
  SELECT batch_id, user_id, value FROM log WHERE observed_at <= TIMESTAMP '2024-01-15 12:00:00'
  ORDER BY observed_at DESC, batch_id DESC LIMIT 1""")
def as_of_singleton(spark, sf):
    return tt.as_of(st.log(spark, sf), [], CUT).select("batch_id", "user_id", "value")


@query("effective_at_state", st.LOG_SQL + """, timed AS (
  SELECT *, strptime(valid_time, '%Y-%m-%dT%H:%M:%SZ') AS v FROM log WHERE valid_time IS NOT NULL)
  SELECT user_id, event_type, batch_id, value FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY v DESC, observed_at DESC, batch_id DESC) rn
    FROM timed WHERE v < TIMESTAMP '2024-01-15 12:00:00') WHERE rn = 1""")
def effective_at_state(spark, sf):
    return tt.effective_at(st.log(spark, sf), KEY, CUT, "valid_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").select(*SHOW)


@query("observation_stream", st.LOG_SQL + """
  SELECT user_id, event_type, batch_id, value, valid_time FROM log WHERE observed_at <= TIMESTAMP '2024-01-15 12:00:00'""")
def observation_stream(spark, sf):
    return tt.observations(st.log(spark, sf), CUT).select(*SHOW, "valid_time")


@query("observation_stream_ordered", st.LOG_SQL + """
  SELECT user_id, event_type, batch_id FROM log WHERE observed_at <= TIMESTAMP '2024-01-03 00:00:00' ORDER BY ALL""")
def observation_stream_ordered(spark, sf):
    log = st.log(spark, sf).select("user_id", "event_type", "batch_id", "observed_at")
    return tt.observations(log, datetime(2024, 1, 3, tzinfo=timezone.utc), ordered=True).drop("observed_at")


@query("latest_state", st.LOG_SQL + """
  SELECT user_id, event_type, batch_id, value FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY observed_at DESC, batch_id DESC) rn FROM log)
  WHERE rn = 1""")
def latest_state(spark, sf):
    return tt.latest(st.log(spark, sf), KEY).select(*SHOW)


@query("as_of_row_order", STATE_SQL + " SELECT user_id, event_type, batch_id FROM state ORDER BY user_id, event_type")
def as_of_row_order(spark, sf):
    return tt.as_of(st.log(spark, sf), KEY, CUT).select("user_id", "event_type", "batch_id").orderBy(*KEY)


@query("as_of_every_deadline", st.LOG_SQL + """,
  deadlines AS (SELECT DISTINCT date_trunc('day', ts) + INTERVAL 18 HOUR AS deadline FROM events)
  SELECT strftime(deadline, '%Y-%m-%d %H:%M:%S') AS deadline, user_id, event_type, batch_id, value FROM (
    SELECT d.deadline, l.*, row_number() OVER (PARTITION BY d.deadline, user_id, event_type
                                              ORDER BY observed_at DESC, batch_id DESC) rn
    FROM deadlines d JOIN log l ON l.observed_at <= d.deadline) WHERE rn = 1""")
def as_of_every_deadline(spark, sf):
    log = st.log(spark, sf)
    deadlines = log.select((F.date_trunc("day", "observed_at") + F.expr("INTERVAL 18 HOURS")).cast("timestamp_ntz").alias("deadline"))
    state = tt.as_of_deadlines(log, KEY, deadlines)
    return state.select(F.date_format("deadline", "yyyy-MM-dd HH:mm:ss").alias("deadline"), *SHOW)


@query("rows_before_round", st.FACTS_SQL + """
  SELECT season, round, element, fixture, line, total_points FROM facts WHERE round < 20""")
def rows_before_round(spark, sf):
    return tt.rows_before_round(st.facts(spark, sf), 20).select("season", "round", "element", "fixture", "line", "total_points")


@query("rows_for_round", st.FACTS_SQL + """
  SELECT season, round, element, fixture, line, total_points FROM facts WHERE round = 20""")
def rows_for_round(spark, sf):
    return tt.rows_for_round(st.facts(spark, sf), 20).select("season", "round", "element", "fixture", "line", "total_points")


@query("last_known_attributes", st.FACTS_SQL + """
  SELECT element, position, team, value FROM (
    SELECT *, row_number() OVER (PARTITION BY element ORDER BY season DESC, round DESC, fixture DESC, position DESC, team DESC, value DESC) rn
    FROM facts) WHERE rn = 1""")
def last_known_attributes(spark, sf):
    return tt.last_known_attributes(st.facts(spark, sf), ["position", "team", "value"], order=("season", "round", "fixture"))


@query("decision_view_attributes", st.FACTS_SQL + """
  SELECT element, fixture, position, team, value FROM (
    SELECT *, row_number() OVER (PARTITION BY element ORDER BY fixture, position, team, value) rn
    FROM facts WHERE season = '1999-00' AND round = 20) WHERE rn = 1""")
def decision_view_attributes(spark, sf):
    return tt.decision_view(st.facts(spark, sf), "1999-00", 20, ["position", "team", "value"])["attributes"]


@query("decision_view_forward", st.FACTS_SQL + """
  SELECT DISTINCT round, fixture, kickoff_time, team, opponent_team, was_home
  FROM facts WHERE season = '1999-00' AND round BETWEEN 21 AND 25""")
def decision_view_forward(spark, sf):
    return tt.decision_view(st.facts(spark, sf), "1999-00", 20, ["position"], horizon=6)["forward"]


@query("sampled_entities", """SELECT DISTINCT user_id FROM events
  WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' AND event_type = 'signup'""")
def sampled_entities(spark, sf):
    return tt.observations(st.log(spark, sf), CUT).filter("event_type = 'signup'").select("user_id").distinct()


@query("newest_pins", """WITH pins AS (
    SELECT event_type AS grp, CAST(user_id % 3 AS INT) AS season, CAST(user_id % 38 AS INT) AS round, event_id AS observed_at,
           CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 14 AS INT) END AS pinned_threshold FROM events)
  SELECT grp AS "group", season, round, observed_at, pinned_threshold FROM (
    SELECT *, row_number() OVER (PARTITION BY grp ORDER BY season DESC, round DESC, observed_at DESC) rn
    FROM pins WHERE pinned_threshold IS NOT NULL) WHERE rn = 1""")
def newest_pins(spark, sf):
    pins = table(spark, sf, "events").selectExpr(
        "event_type AS group", "CAST(user_id % 3 AS INT) AS season", "CAST(user_id % 38 AS INT) AS round",
        "event_id AS observed_at",
        "CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 14 AS INT) END AS pinned_threshold")
    return tt.newest_pins(pins)


@query("season_round_rows", st.FACTS_SQL + """
  SELECT season, round, count(*) AS n_rows, (SELECT max(season) FROM facts) = season AS newest FROM facts GROUP BY 1, 2""")
def season_round_rows(spark, sf):
    rows = st.facts(spark, sf).groupBy("season", "round").agg(F.count("*").alias("n_rows"))
    newest = rows.agg(F.max("season")).first()[0]
    return rows.withColumn("newest", F.col("season") == newest)
