"""Joins, unions, rollups, match tables and quality checks."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tidemark.operators import features as fe
from tidemark.operators import pmf as pm
from tidemark.operators import quality as qu
from tidemark.operators import relational as re
from tidemark.operators import rollups as ro
from tidemark.plans import standins as st
from tidemark.plans.q_features import BONUS_TRAIL, MINUTES_TRAIL, ROW, ROWS, mean_sql, r6, team_sql, zero
from tidemark.plans.registry import query, table
from tidemark.session import written

# -- projections and filters -------------------------------------------------------------------------


@query("normalised_positions", st.FACTS_SQL + f"""
  SELECT {ROW}, CASE WHEN position = 'GKP' THEN 'GK' ELSE position END AS position FROM facts WHERE position <> 'AM'""")
def normalised_positions(spark, sf):
    return fe.normalise_positions(st.facts(spark, sf)).select(*ROWS, "position")


@query("eligible_rows", st.ELIGIBLE_SQL + f" SELECT {ROW}, position, team FROM eligible")
def eligible_rows(spark, sf):
    return fe.eligible(st.facts(spark, sf)).select(*ROWS, "position", "team")


@query("minutes_states", st.FACTS_SQL + """ SELECT
    CASE WHEN starts = 1 THEN 'START' WHEN minutes > 0 THEN 'SUB' ELSE 'UNUSED' END AS state,
    CASE WHEN minutes <= 0 THEN '0' WHEN minutes < 30 THEN '1-29' WHEN minutes < 60 THEN '30-59'
         WHEN minutes < 75 THEN '60-74' WHEN minutes < 90 THEN '75-89' ELSE '90' END AS band, count(*) AS n FROM facts GROUP BY 1, 2""")
def minutes_states(spark, sf):
    return fe.minutes_state(st.facts(spark, sf)).groupBy("state", "band").agg(F.count("*").alias("n"))


@query("card_outcomes", st.FACTS_SQL + """ SELECT position, CASE WHEN red_cards = 1 THEN 2 WHEN yellow_cards = 1 THEN 1 ELSE 0 END AS outcome,
    count(*) AS n FROM facts GROUP BY 1, 2""")
def card_outcomes(spark, sf):
    return fe.card_outcome(st.facts(spark, sf)).groupBy("position", "outcome").agg(F.count("*").alias("n"))


@query("side_goals", st.FACTS_SQL + f""" SELECT {ROW}, CASE WHEN was_home THEN team_h_score ELSE team_a_score END AS team_goals,
    CASE WHEN was_home THEN team_a_score ELSE team_h_score END AS opponent_goals FROM facts""")
def side_goals(spark, sf):
    return fe.possible_goals(fe.side_goals(st.facts(spark, sf))).select(*ROWS, "team_goals", "opponent_goals")


@query("defensive_awards", st.FACTS_SQL + """ SELECT position, count(*) AS n, CAST(sum(CASE
      WHEN tackles + clearances_blocks_interceptions + CASE WHEN position = 'DEF' THEN 0 ELSE recoveries END >= CASE WHEN position = 'DEF' THEN 10 ELSE 12 END
      THEN 1 ELSE 0 END) AS BIGINT) AS n_awarded FROM facts WHERE position IN ('DEF', 'MID', 'FWD') GROUP BY 1""")
def defensive_awards(spark, sf):
    rows = st.facts(spark, sf).filter(F.col("position").isin("DEF", "MID", "FWD"))
    return fe.defensive_group(rows, {"DEF": 10, "MID_FWD": 12}).groupBy("position").agg(
        F.count("*").alias("n"), F.sum("awarded").alias("n_awarded"))


@query("minutes_fractions", st.FACTS_SQL + f" SELECT {ROW}, round(least(greatest(minutes, 0), 90) / 90.0, 9) AS minutes_frac FROM facts")
def minutes_fractions(spark, sf):
    return fe.minutes_fraction(st.facts(spark, sf)).select(*ROWS, F.round("minutes_frac", 9).alias("minutes_frac"))


@query("unexpected_positions", st.FACTS_SQL + " SELECT position, count(*) AS n_rows FROM facts WHERE position NOT IN ('GK', 'DEF', 'MID', 'FWD') GROUP BY 1")
def unexpected_positions(spark, sf):
    return qu.unexpected_values(st.facts(spark, sf), "position", fe.POSITIONS)


@query("drop_unrecorded_seasons", st.FACTS_SQL + """ SELECT season, count(*) AS n FROM facts
    WHERE season NOT IN (SELECT season FROM facts GROUP BY 1 HAVING count(expected_goals) = 0) GROUP BY 1""")
def drop_unrecorded_seasons(spark, sf):
    return ro.drop_unrecorded_seasons(st.facts(spark, sf), "expected_goals").groupBy("season").agg(F.count("*").alias("n"))


@query("missing_after_join", MINUTES_TRAIL + """ SELECT 'prev_round_any_start' AS column_name, count(*) FILTER (t.prev_round_any_start IS NULL) AS n_null,
    round(count(*) FILTER (t.prev_round_any_start IS NULL) / count(*), 9) AS null_rate FROM labeled JOIN trail t USING (season, element, round)""")
def missing_after_join(spark, sf):
    rows = fe.minutes_table(st.facts(spark, sf))
    checked = ro.missing_after_join(rows, ["trailing_start_rate_3", "trailing_minutes_mean_5", "games_played_this_season", "prev_round_any_start"])
    return checked.withColumn("null_rate", F.round("null_rate", 9))


@query("null_profile", st.FACTS_SQL + """ SELECT season, column_name, n - c AS n_null, round((n - c) / n, 9) AS null_rate FROM (
    SELECT season, count(*) AS n, count(starts) AS starts, count(expected_goals) AS expected_goals, count(attribution_complete) AS attribution_complete FROM facts GROUP BY 1)
  UNPIVOT (c FOR column_name IN (starts, expected_goals, attribution_complete))""")
def null_profile(spark, sf):
    p = ro.null_profile(st.facts(spark, sf), ["starts", "expected_goals", "attribution_complete"], ["season"])
    return p.withColumn("null_rate", F.round("null_rate", 9))


ROUNDS_SQL = """WITH rounds AS (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) + INTERVAL 17 HOUR AS deadline_time,
    count(*) FILTER (o_orderstatus = 'O') = 0 AS finished, count(*) % 2 = 0 AS data_checked FROM orders GROUP BY 1)"""


def rounds(spark, sf):
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    return table(spark, sf, "orders").groupBy((month + F.expr("INTERVAL 17 HOURS")).alias("deadline_time")).agg(
        (F.count_if(F.col("o_orderstatus") == "O") == 0).alias("finished"), (F.count("*") % 2 == 0).alias("data_checked"))


@query("settled_rounds_and_deadline", """WITH days AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 17 HOUR AS deadline_time,
    count(*) % 2 = 0 AS finished, count(*) % 3 > 0 AS data_checked FROM events GROUP BY 1)
  SELECT count(*) FILTER (finished AND data_checked) AS n_settled,
    strftime(min(deadline_time) FILTER (deadline_time > TIMESTAMP '2024-01-10 12:00:00'), '%Y-%m-%d %H:%M') AS next_deadline FROM days""")
def settled_rounds_and_deadline(spark, sf):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz") + F.expr("INTERVAL 17 HOURS")
    days = table(spark, sf, "events").groupBy(day.alias("deadline_time")).agg(
        (F.count("*") % 2 == 0).alias("finished"), (F.count("*") % 3 > 0).alias("data_checked"))
    now = F.expr("TIMESTAMP_NTZ '2024-01-10 12:00:00'")
    settled = re.settled_rounds(days).agg(F.count("*").alias("n_settled")).first()[0]
    nxt = re.next_deadline(days, now)
    return nxt.select(F.lit(settled).alias("n_settled"), F.date_format("next_deadline", "yyyy-MM-dd HH:mm").alias("next_deadline"))


@query("home_or_away", st.FACTS_SQL + f""" SELECT {ROW}, t = th AS was_home, CASE WHEN t = th THEN ta ELSE th END AS opponent FROM (
    SELECT *, element % 5 AS t, fixture % 5 AS th, (fixture + 1) % 5 AS ta FROM facts)""")
def home_or_away(spark, sf):
    rows = st.facts(spark, sf).withColumn("t", F.col("element") % 5).withColumn("team_h", F.col("fixture") % 5).withColumn(
        "team_a", (F.col("fixture") + 1) % 5)
    home, opponent = re.home_or_away(F.col("t"))
    return rows.select(*ROWS, home.alias("was_home"), opponent.alias("opponent"))


# -- joins -------------------------------------------------------------------------------------------

@query("feature_attach", MINUTES_TRAIL + f" SELECT {ROW}, {r6('t.trailing_minutes_mean_5', 'trailing_minutes_mean_5')} FROM labeled l LEFT JOIN trail t USING (season, element, round)")
def feature_attach(spark, sf):
    rows = fe.eligible(st.facts(spark, sf)).filter("starts IS NOT NULL")
    joined = fe.attach_player(rows, fe.minutes_trail(fe.minutes_rounds(rows)))
    return joined.select(*ROWS, F.round("trailing_minutes_mean_5", 6).alias("trailing_minutes_mean_5"))


@query("team_attach", BONUS_TRAIL + team_sql("used", "bps") + f""" SELECT {ROW}, team, round(coalesce(tt.team_mean, 0), 6) AS team_mean,
    coalesce(tt.team_cold_start, true) AS team_cold_start FROM used LEFT JOIN team_trail tt USING (season, team, round)""")
def team_attach(spark, sf):
    raw = fe.eligible(st.facts(spark, sf))
    joined = fe.attach_team(raw, fe.team_rounds(raw, "bps", "team_mean"), "team_mean")
    return joined.select(*ROWS, "team", F.round("team_mean", 6).alias("team_mean"), "team_cold_start")


SIDES_SQL = st.FACTS_SQL + """, h AS (SELECT season, fixture, count(*) AS n_home, max(team_h_score) AS goals FROM facts WHERE was_home GROUP BY 1, 2),
  a AS (SELECT season, fixture, count(*) AS n_away FROM facts WHERE NOT was_home GROUP BY 1, 2)"""


@query("pair_home_and_away", SIDES_SQL + """ SELECT season, fixture, coalesce(n_home, 0) AS n_home, coalesce(n_away, 0) AS n_away FROM h FULL JOIN a USING (season, fixture)""")
def pair_home_and_away(spark, sf):
    rows = st.facts(spark, sf)
    home = rows.filter("was_home").groupBy("season", "fixture").agg(F.count("*").alias("n_home"))
    away = rows.filter("NOT was_home").groupBy("season", "fixture").agg(F.count("*").alias("n_away"))
    return re.pair_sides(home, away, ["season", "fixture"]).fillna(0)


NAMES_SQL = """, names AS (SELECT DISTINCT season, team, 'Club ' || substr(team, 2) AS canonical FROM facts WHERE length(team) = 3)"""


def names(spark, sf):
    rows = st.facts(spark, sf).filter(F.length("team") == 3).select("season", "team").distinct()
    return rows.withColumn("canonical", F.concat(F.lit("Club "), F.substring("team", 2, 9)))


@query("canonical_team_names", st.FACTS_SQL + NAMES_SQL + " SELECT coalesce(canonical, team) AS team, count(*) AS n FROM facts LEFT JOIN names USING (season, team) GROUP BY 1")
def canonical_team_names(spark, sf):
    return ro.canonical_teams(st.facts(spark, sf), names(spark, sf)).groupBy("team").agg(F.count("*").alias("n"))


MATCH_SQL = st.ELIGIBLE_SQL + """, grouped AS (SELECT season, fixture, min(kickoff) AS kickoff, min(round) AS round,
    min(struct_pack(e := element, t := team)) FILTER (was_home) AS h, min(struct_pack(e := element, t := team)) FILTER (NOT was_home) AS a,
    max(team_h_score) AS home_goals, max(team_a_score) AS away_goals,
    CASE WHEN count(*) FILTER (was_home) > 0 AND count(*) FILTER (was_home AND expected_goals IS NULL) = 0 THEN sum(expected_goals) FILTER (was_home) END AS hx,
    CASE WHEN count(*) FILTER (NOT was_home) > 0 AND count(*) FILTER (NOT was_home AND expected_goals IS NULL) = 0 THEN sum(expected_goals) FILTER (NOT was_home) END AS ax
  FROM eligible GROUP BY 1, 2),
 matches AS (SELECT season, fixture, kickoff, round, h.t AS home_team, a.t AS away_team, home_goals, away_goals,
    CASE WHEN hx IS NOT NULL AND ax IS NOT NULL THEN hx END AS home_xg, CASE WHEN hx IS NOT NULL AND ax IS NOT NULL THEN ax END AS away_xg
  FROM grouped WHERE h IS NOT NULL AND a IS NOT NULL)"""


def matches(spark, sf):
    return ro.match_table(fe.eligible(st.facts(spark, sf)))


@query("match_table", MATCH_SQL + """ SELECT season, fixture, round, home_team, away_team, home_goals, away_goals, round(home_xg, 6) AS home_xg, round(away_xg, 6) AS away_xg,
    strftime(kickoff, '%Y-%m-%d') AS kickoff FROM matches""")
def match_table(spark, sf):
    return matches(spark, sf).select("season", "fixture", "round", "home_team", "away_team", "home_goals", "away_goals",
                                     F.round("home_xg", 6).alias("home_xg"), F.round("away_xg", 6).alias("away_xg"),
                                     F.date_format("kickoff", "yyyy-MM-dd").alias("kickoff"))


@query("conditional_totals", st.FACTS_SQL + """ SELECT season, CAST(sum(goals_scored) FILTER (was_home) AS BIGINT) AS home_goals,
    CAST(sum(goals_scored) FILTER (NOT was_home) AS BIGINT) AS away_goals, count(*) FILTER (minutes >= 60) AS n_hour FROM facts GROUP BY 1""")
def conditional_totals(spark, sf):
    return st.facts(spark, sf).groupBy("season").agg(
        F.sum(F.when(F.col("was_home"), F.col("goals_scored"))).alias("home_goals"),
        F.sum(F.when(~F.col("was_home"), F.col("goals_scored"))).alias("away_goals"), F.count_if(F.col("minutes") >= 60).alias("n_hour"))


@query("match_cards", st.FACTS_SQL + " SELECT season, fixture, CAST(sum(yellow_cards + red_cards) AS BIGINT) AS match_total_cards FROM facts GROUP BY 1, 2")
def match_cards(spark, sf):
    return ro.match_cards(st.facts(spark, sf))


@query("team_round_totals", st.FACTS_SQL + " SELECT season, team, round, CAST(sum(bps) AS BIGINT) AS total FROM facts GROUP BY 1, 2, 3")
def team_round_totals(spark, sf):
    return ro.team_rounds_total(st.facts(spark, sf), "bps")


@query("referee_of_match", """WITH home AS (SELECT DISTINCT o_orderkey AS fixture, CAST(o_orderdate AS DATE) AS d, o_custkey % 25 AS opp FROM orders),
  ident AS (SELECT n_nationkey AS id, n_nationkey + 100 AS code FROM nation),
  fx AS (SELECT min(o_orderkey) AS match_id, CAST(o_orderdate AS DATE) AS d, o_custkey % 25 + 100 AS away_code FROM orders GROUP BY 2, 3),
  cards AS (SELECT l_orderkey AS fixture, count(*) AS cards FROM lineitem GROUP BY 1)
  SELECT h.fixture, i.code AS away_team_code, f.match_id, coalesce(c.cards, 0) AS cards, 'Ref ' || (f.match_id % 40) AS official_name
  FROM home h LEFT JOIN ident i ON h.opp = i.id LEFT JOIN fx f ON h.d = f.d AND i.code = f.away_code LEFT JOIN cards c ON c.fixture = h.fixture
  WHERE f.match_id IS NOT NULL AND f.match_id % 3 > 0""")
def referee_of_match(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("kickoff_date"), (F.col("o_custkey") % 25).alias("opponent_team"))
    home = orders.withColumnRenamed("o_orderkey", "fixture").distinct()
    ident = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("opponent_team"), (F.col("n_nationkey") + 100).alias("away_team_code"))
    fixtures = orders.groupBy("kickoff_date", (F.col("opponent_team") + 100).cast("int").alias("away_team_code")).agg(F.min("o_orderkey").alias("match_id"))
    officials = fixtures.select("match_id", F.when(F.col("match_id") % 3 > 0, F.concat(F.lit("Ref "), (F.col("match_id") % 40).cast("string"))).alias("official_name"))
    cards = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("fixture")).agg(F.count("*").alias("cards"))
    resolved = (home.join(ident, "opponent_team", "left").join(fixtures, ["kickoff_date", "away_team_code"], "left")
                .join(officials, "match_id", "left").join(cards, "fixture", "left"))
    return resolved.filter(F.col("official_name").isNotNull()).select(
        "fixture", "away_team_code", "match_id", F.coalesce("cards", F.lit(0)).alias("cards"), "official_name")


REFEREE_SQL = st.FACTS_SQL + """, shaped AS (SELECT * REPLACE (CAST(fixture % 25 AS INT) AS opponent_team, CAST(date_trunc('week', kickoff) AS TIMESTAMP) AS kickoff) FROM facts),
  fx AS (SELECT min(fixture) AS match_id, kickoff, opponent_team + 100 AS away_team_code FROM shaped GROUP BY 2, 3),
  home AS (SELECT DISTINCT season, round, fixture, opponent_team, kickoff FROM shaped WHERE was_home),
  cards AS (SELECT season, fixture, sum(yellow_cards + red_cards) AS cards FROM shaped GROUP BY 1, 2),
  resolved AS (SELECT h.season, h.round, h.fixture, h.kickoff, f.match_id, 'Ref ' || (f.match_id % 40) AS official_name, cards AS match_total_cards
    FROM home h JOIN fx f ON f.kickoff = h.kickoff AND f.away_team_code = h.opponent_team + 100 AND f.match_id % 3 > 0 JOIN cards USING (season, fixture)),
  trailed AS (SELECT *, coalesce(avg(CAST(match_total_cards AS DOUBLE)) OVER (PARTITION BY official_name ORDER BY kickoff, season, round, fixture ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
    (SELECT avg(match_total_cards) FROM resolved)) AS m FROM resolved)"""


def referees(spark, sf):
    week = F.date_trunc("week", "kickoff").cast("timestamp_ntz")
    facts = st.facts(spark, sf).withColumn("opponent_team", (F.col("fixture") % 25).cast("int")).withColumn("kickoff", week)
    # A row per week and side of a season: what the schedule and the identities are taken from, without further reads of the facts.
    weeks = written(facts.groupBy("season", "kickoff", "opponent_team").agg(F.min("fixture").alias("match_id")), "weeks")
    identity = weeks.select("season", F.col("opponent_team").alias("id")).distinct().withColumn("code", F.col("id") + 100)
    fixtures = weeks.groupBy("kickoff", (F.col("opponent_team") + 100).alias("away_team_code")).agg(F.min("match_id").alias("match_id"))
    officials = fixtures.select("match_id", F.lit(True).alias("is_referee"), F.when(F.col("match_id") % 3 > 0, F.concat(F.lit("Ref "), (F.col("match_id") % 40).cast("string"))).alias("official_name")).distinct()
    return facts, fe.referee_trailing(ro.resolved_referees(facts, identity, fixtures, officials), order=("kickoff", "season", "round", "fixture"))


@query("referee_trailing_table", REFEREE_SQL + " SELECT season, round, fixture, match_id, official_name, CAST(match_total_cards AS BIGINT) AS match_total_cards, round(m, 6) AS referee_mean FROM trailed")
def referee_trailing_table(spark, sf):
    _, table_ = referees(spark, sf)
    return table_.select("season", "round", "fixture", "match_id", "official_name", "match_total_cards",
                         F.round("referee_trailing_cards_per_match_10", 6).alias("referee_mean"))


@query("referee_feature_attached", REFEREE_SQL + f" SELECT {ROW}, round(m, 6) AS referee_mean FROM shaped JOIN trailed USING (season, round, fixture)")
def referee_feature_attached(spark, sf):
    facts, table_ = referees(spark, sf)
    return ro.attach_referee(facts, table_).select(*ROWS, F.round("referee_trailing_cards_per_match_10", 6).alias("referee_mean"))


@query("finished_work_removed", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def finished_work_removed(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    return re.missing_keys(orders, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("restrict_to_wanted", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def restrict_to_wanted(spark, sf):
    wanted = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return re.restrict_to(table(spark, sf, "events"), wanted, ["user_id"]).select("event_id", "user_id")


WINDOWS_SQL = """WITH deadlines AS (SELECT DISTINCT CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 18 HOUR AS deadline FROM events),
  windows AS (SELECT deadline, h AS hours_before, deadline - to_hours(h) - INTERVAL 30 MINUTE AS ws, deadline - to_hours(h) + INTERVAL 30 MINUTE AS we
    FROM deadlines, (VALUES (78), (26), (6), (2)) x(h))"""


def windows(spark, sf):
    deadline = F.date_trunc("day", "ts").cast("timestamp_ntz") + F.expr("INTERVAL 18 HOURS")
    days = table(spark, sf, "events").select(deadline.alias("deadline")).distinct()
    return re.capture_windows(days)


@query("instants_in_windows", WINDOWS_SQL + """ SELECT event_id, strftime(deadline, '%Y-%m-%d') AS deadline, CAST(hours_before AS INT) AS hours_before
    FROM events JOIN windows ON ts >= ws AND ts < we""")
def instants_in_windows(spark, sf):
    hits = re.in_windows(table(spark, sf, "events"), windows(spark, sf), "ts")
    return hits.select("event_id", F.date_format("deadline", "yyyy-MM-dd").alias("deadline"), "hours_before")


@query("capture_decisions", WINDOWS_SQL + """, hits AS (SELECT deadline, hours_before, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS ok
    FROM events JOIN windows ON ts >= ws AND ts < we GROUP BY 1, 2)
  SELECT strftime(deadline, '%Y-%m-%d') AS deadline, CAST(hours_before AS INT) AS hours_before, coalesce(n, 0) AS attempts, coalesce(ok, 0) AS succeeded,
    CASE WHEN coalesce(ok, 0) > 0 THEN 'skipped_already_captured' WHEN coalesce(n, 0) >= 2 THEN 'skipped_max_attempts_exhausted' ELSE 'open' END AS decision
  FROM windows LEFT JOIN hits USING (deadline, hours_before)""")
def capture_decisions(spark, sf):
    attempts = table(spark, sf, "events").select(F.col("ts").alias("run_ts"), F.when(F.col("event_type") == "purchase", "written").otherwise("failed").alias("outcome"))
    decided = re.capture_decisions(attempts, windows(spark, sf))
    return decided.select(F.date_format("deadline", "yyyy-MM-dd").alias("deadline"), "hours_before", "attempts", "succeeded", "decision")


@query("fixture_roster", MATCH_SQL + """, players AS (SELECT DISTINCT season, team, element FROM eligible WHERE round = 10),
  both_sides AS (SELECT season, fixture, home_team AS team, true AS is_home FROM matches WHERE round = 11 UNION ALL SELECT season, fixture, away_team, false FROM matches WHERE round = 11)
  SELECT season, fixture, team, element, is_home FROM both_sides JOIN players USING (season, team)""")
def fixture_roster(spark, sf):
    players = fe.eligible(st.facts(spark, sf)).filter("round = 10").select("season", "team", "element").distinct()
    return re.roster(matches(spark, sf).filter("round = 11"), players).select("season", "fixture", "team", "element", "is_home")


@query("team_calendar", MATCH_SQL + """ SELECT season, fixture, home_team AS team, away_team AS opponent, true AS is_home FROM matches
  UNION ALL SELECT season, fixture, away_team, home_team, false FROM matches""")
def team_calendar(spark, sf):
    return re.team_calendar(matches(spark, sf)).drop("kickoff")


# -- set operations ----------------------------------------------------------------------------------

@query("two_provider_union", """SELECT c_custkey AS element, c_name AS name, CAST(c_nationkey AS VARCHAR) AS team, c_mktsegment AS segment, 'archive' AS source_provider,
    true AS attribution_complete FROM customer
  UNION ALL SELECT s_suppkey, s_name, 'T' || s_nationkey, NULL, 'live', s_suppkey % 2 = 0 FROM supplier""")
def two_provider_union(spark, sf):
    archive = table(spark, sf, "customer").select(F.col("c_custkey").alias("element"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("team"), F.col("c_mktsegment").alias("segment"))
    live = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("element"), F.col("s_name").alias("name"), F.concat(F.lit("T"), F.col("s_nationkey").cast("string")).alias("team"),
                                               (F.col("s_suppkey") % 2 == 0).alias("attribution_complete"))
    return re.two_providers(archive, live)


@query("distinct_rows", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def distinct_rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").dropDuplicates()


@query("squad_change_equality", """SELECT o_orderkey, list_sort(list_distinct(list_concat(list_filter([a, b, c], lambda x: x <> b), [d]))) = list_sort(list_distinct([a, c, d])) AS continues FROM (
    SELECT o_orderkey, o_custkey % 5 AS a, o_custkey % 7 + 10 AS b, o_custkey % 11 + 30 AS c, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 5 ELSE 50 END AS d FROM orders)""")
def squad_change_equality(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 5).alias("a"), (F.col("o_custkey") % 7 + 10).alias("b"), (F.col("o_custkey") % 11 + 30).alias("c"),
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey") % 5).otherwise(F.lit(50)).alias("d"))
    changed = re.squad_changes(F.array("a", "b", "c"), F.array("b"), F.array("d"), F.array("a", "c", "d"))
    return rows.select("o_orderkey", changed.alias("continues"))


# -- aggregates --------------------------------------------------------------------------------------

@query("group_rates", st.FACTS_SQL + """ SELECT position, count(*) AS n, round(avg(CASE WHEN starts = 1 THEN 1.0 ELSE 0.0 END), 9) AS rate,
    (SELECT round(avg(CASE WHEN starts = 1 THEN 1.0 ELSE 0.0 END), 9) FROM facts) AS overall_rate FROM facts GROUP BY 1""")
def group_rates(spark, sf):
    rates = ro.rates_by_group(st.facts(spark, sf), "position", F.coalesce(F.col("starts") == 1, F.lit(False)))
    return rates.select("position", "n", F.round("rate", 9).alias("rate"), F.round("overall_rate", 9).alias("overall_rate"))


OWN_SQL = """WITH picks AS (SELECT DISTINCT user_id, event_id % 40 AS element FROM events),
  own AS (SELECT element, count(*) AS n_picks, count(*) / (SELECT count(DISTINCT user_id) FROM picks) * 100 AS sampled_percent FROM picks GROUP BY 1),
  pop AS (SELECT s_suppkey AS element, 0.5 + s_suppkey % 60 AS selected_by_percent FROM supplier),
  dev AS (SELECT element, selected_by_percent, coalesce(sampled_percent, 0) AS sampled, coalesce(sampled_percent, 0) - selected_by_percent AS deviation
    FROM pop LEFT JOIN own USING (element) WHERE selected_by_percent >= 1.0)"""


def sample(spark, sf):
    picks = table(spark, sf, "events").select(F.col("user_id").alias("entry_id"), (F.col("event_id") % 40).alias("element")).distinct()
    population = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("element"), (0.5 + F.col("s_suppkey") % 60).alias("selected_by_percent"))
    return ro.ownership(picks), population


@query("sampled_ownership", OWN_SQL + " SELECT element, n_picks, round(sampled_percent, 8) AS sampled_percent FROM own")
def sampled_ownership(spark, sf):
    return sample(spark, sf)[0].withColumn("sampled_percent", F.round("sampled_percent", 8))


@query("sample_deviation", OWN_SQL + " SELECT element, CAST(selected_by_percent AS DOUBLE) AS population_percent, round(sampled, 8) AS sampled_percent, round(deviation, 8) AS deviation FROM dev")
def sample_deviation(spark, sf):
    d = ro.sample_deviation(*sample(spark, sf))
    return d.select("element", "population_percent", F.round("sampled_percent", 8).alias("sampled_percent"), F.round("deviation", 8).alias("deviation"))


@query("sample_verdict", OWN_SQL + " SELECT count(*) AS n, round(max(abs(deviation)), 8) AS max_deviation, max(abs(deviation)) <= 3.0 AS passed FROM dev")
def sample_verdict(spark, sf):
    return ro.sample_verdict(ro.sample_deviation(*sample(spark, sf))).withColumn("max_deviation", F.round("max_deviation", 8))


@query("sample_worst_offenders", OWN_SQL + " SELECT element, round(deviation, 8) AS deviation FROM dev ORDER BY abs(deviation) DESC, element LIMIT 10")
def sample_worst_offenders(spark, sf):
    return ro.worst_offenders(ro.sample_deviation(*sample(spark, sf))).select("element", F.round("deviation", 8).alias("deviation"))


@query("pin_thresholds", st.FACTS_SQL + """, obs AS (SELECT position, tackles + clearances_blocks_interceptions AS c,
    CASE WHEN fixture % 9 = 0 THEN NULL WHEN position = 'GK' THEN bps >= 30 ELSE tackles + clearances_blocks_interceptions >= 8 END AS awarded FROM facts),
  b AS (SELECT position, min(c) FILTER (awarded) AS lo, max(c) FILTER (NOT awarded) AS hi, count(awarded) AS n_observations, count(*) - count(awarded) AS n_unattributable FROM obs GROUP BY 1)
  SELECT position, lo AS lower_bound, hi AS upper_bound, n_observations, n_unattributable, coalesce(lo <= hi, false) AS contradiction,
    CAST(coalesce(CASE WHEN lo - 1 = hi THEN lo END, -1) AS INT) AS count_threshold FROM b""")
def pin_thresholds(spark, sf):
    count = F.col("tackles") + F.col("clearances_blocks_interceptions")
    awarded = F.when(F.col("fixture") % 9 == 0, None).when(F.col("position") == "GK", F.col("bps") >= 30).otherwise(count >= 8)
    obs = st.facts(spark, sf).select("position", count.alias("c"), awarded.alias("awarded"))
    return ro.pin_thresholds(obs, "position", "c", "awarded").withColumn("count_threshold", F.coalesce("count_threshold", F.lit(-1)))


@query("outcome_distribution", st.FACTS_SQL + " SELECT bonus, count(*) AS n FROM facts GROUP BY 1")
def outcome_distribution(spark, sf):
    return ro.outcome_counts(st.facts(spark, sf), "bonus")


@query("distinct_key_counts", st.FACTS_SQL + " SELECT season, count(DISTINCT element) AS n_elements, count(DISTINCT fixture) AS n_fixtures, count(DISTINCT round) AS n_rounds FROM facts GROUP BY 1")
def distinct_key_counts(spark, sf):
    return st.facts(spark, sf).groupBy("season").agg(*[F.count_distinct(c).alias(f"n_{c}s") for c in ("element", "fixture", "round")])


@query("result_rates", MATCH_SQL + """, sided AS (SELECT season, fixture, kickoff, home_team AS team, 'home' AS side, home_goals - away_goals AS d FROM matches
    UNION ALL SELECT season, fixture, kickoff, away_team, 'away', away_goals - home_goals FROM matches)
  SELECT season, fixture, team, side, """ + ", ".join(
    f"round(coalesce({mean_sql(f'({c})', 5, 'team', 'kickoff, season, fixture, side')}, 1 / 3.0), 8) AS {n}"
    for n, c in (("win_rate", "d > 0"), ("draw_rate", "d = 0"), ("loss_rate", "d < 0"))) + " FROM sided")
def result_rates(spark, sf):
    r = ro.result_rates(matches(spark, sf))
    return r.select("season", "fixture", "team", "side", *[F.round(c, 8).alias(c) for c in ("win_rate", "draw_rate", "loss_rate")])


@query("form_forecast", MATCH_SQL + f""", sided AS (SELECT season, fixture, kickoff, home_team AS team, 'home' AS side, home_goals - away_goals AS d FROM matches
    UNION ALL SELECT season, fixture, kickoff, away_team, 'away', away_goals - home_goals FROM matches),
  w AS (SELECT season, fixture, side, least(coalesce({mean_sql('(d > 0)', 5, 'team', 'kickoff, season, fixture, side')}, 1 / 3.0) * 0.8, 0.79) AS w FROM sided),
  p AS (SELECT season, fixture, max(w) FILTER (side = 'home') AS h, max(w) FILTER (side = 'away') AS a FROM w GROUP BY 1, 2)
  SELECT season, fixture, round(a / (h + a + greatest(1 - h - a, 0.01)), 8) AS p_away, round(greatest(1 - h - a, 0.01) / (h + a + greatest(1 - h - a, 0.01)), 8) AS p_draw,
    round(h / (h + a + greatest(1 - h - a, 0.01)), 8) AS p_home FROM p""")
def form_forecast(spark, sf):
    f = ro.form_forecast(ro.result_rates(matches(spark, sf)))
    return f.select("season", "fixture", *[F.round(c, 8).alias(c) for c in ("p_away", "p_draw", "p_home")])


# -- quality -----------------------------------------------------------------------------------------

@query("repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, sf):
    return qu.repeated_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("repeated_rows_emptied", """SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE (l_orderkey, l_linenumber) IN (
    SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) = 1)""")
def repeated_rows_emptied(spark, sf):
    kept, _ = qu.drop_repeated(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), ["l_orderkey", "l_linenumber"])
    return kept


@query("repeated_in_batch", "SELECT day(ts) AS batch_id, user_id, event_type, count(*) AS n_rows FROM events GROUP BY 1, 2, 3 HAVING count(*) > 1")
def repeated_in_batch(spark, sf):
    rows = table(spark, sf, "events").select(F.dayofmonth("ts").alias("batch_id"), "user_id", "event_type")
    return qu.repeated_in_batch(rows, ["user_id", "event_type"])


@query("as_of_leak_guard", "SELECT count(*) AS n_rows FROM events WHERE ts <= TIMESTAMP '2000-01-01'")
def as_of_leak_guard(spark, sf):
    return qu.leaked_rows(st.log(spark, sf), ["user_id", "event_type"], datetime(2000, 1, 1, tzinfo=timezone.utc))


@query("season_coverage", st.FACTS_SQL + """, seen AS (SELECT DISTINCT season, round FROM facts WHERE round BETWEEN 1 AND 38),
  grid AS (SELECT season, CAST(r AS INT) AS round FROM (SELECT DISTINCT season FROM facts), range(1, 39) x(r))
  SELECT g.season, CAST(count(s.round) AS INT) AS n_present, CAST(38 - count(s.round) AS INT) AS n_missing,
    coalesce(string_agg(CAST(g.round AS VARCHAR), ',' ORDER BY g.round) FILTER (s.round IS NULL), '') AS missing_rounds, round(count(s.round) / 38.0, 8) AS coverage
  FROM grid g LEFT JOIN seen s ON s.season = g.season AND s.round = g.round GROUP BY 1""")
def season_coverage(spark, sf):
    return qu.season_coverage(st.facts(spark, sf)).withColumn("coverage", F.round("coverage", 8))


GAP_SQL = """WITH runs AS (SELECT DISTINCT event_type AS job, ts AS run FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00'),
  stepped AS (SELECT job, lag(run) OVER (PARTITION BY job ORDER BY run) AS s, run AS e FROM runs),
  gaps AS (SELECT * FROM stepped WHERE s IS NOT NULL AND e >= TIMESTAMP '2024-01-13 00:00:00' UNION ALL SELECT job, max(run), TIMESTAMP '2024-01-20 00:00:00' FROM runs GROUP BY 1),
  best AS (SELECT *, date_diff('microsecond', s, e) AS gap, row_number() OVER (PARTITION BY job ORDER BY date_diff('microsecond', s, e) DESC, s) AS rn FROM gaps),
  report AS (SELECT job, (SELECT count(*) FROM runs r WHERE r.job = b.job) AS run_count, gap AS largest_gap_us, s, e FROM best b WHERE rn = 1)"""
AT = datetime(2024, 1, 20, tzinfo=timezone.utc)


def gap_report(spark, sf):
    runs = table(spark, sf, "events").select(F.col("event_type").alias("job"), F.col("ts").alias("run_ts"))
    return qu.heartbeat_gaps(runs, AT, timedelta(days=7))


@query("heartbeat_gaps", GAP_SQL + """ SELECT job, run_count, largest_gap_us, strftime(s, '%Y-%m-%d %H:%M:%S') AS gap_start, strftime(e, '%Y-%m-%d %H:%M:%S') AS gap_end FROM report""")
def heartbeat_gaps(spark, sf):
    g = gap_report(spark, sf)
    return g.select("job", "run_count", "largest_gap_us", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("gap_start", "gap_end")])


@query("heartbeat_health", GAP_SQL + """ SELECT job, coalesce(run_count, 0) AS run_count, coalesce(largest_gap_us <= 7200000000, false) AS healthy
  FROM (SELECT DISTINCT event_type AS job FROM events UNION SELECT 'never_run') LEFT JOIN report USING (job)""")
def heartbeat_health(spark, sf):
    jobs = table(spark, sf, "events").select(F.col("event_type").alias("job")).union(spark.createDataFrame([("never_run",)], "job string"))
    return qu.heartbeat_health(gap_report(spark, sf), jobs, timedelta(hours=2)).select("job", "run_count", "healthy")


@query("season_mismatch", st.FACTS_SQL + " SELECT season, count(*) AS n_rows FROM facts WHERE season <> '1999-00' GROUP BY 1")
def season_mismatch(spark, sf):
    return qu.season_mismatch(st.facts(spark, sf), "1999-00")
