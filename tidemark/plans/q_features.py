"""Trailing features, training tables and serving rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.maths import half_up
from tidemark.operators import features as fe
from tidemark.plans import standins as st
from tidemark.plans.registry import query, table

ROW = "season, round, element, fixture, line"
ROWS = ["season", "round", "element", "fixture", "line"]
THRESHOLDS = {"DEF": 10, "MID_FWD": 12}


def rounded(df, keep, numbers):
    return df.select(*keep, *[half_up(F.col(c), 6).alias(c) for c in numbers])


def mean_sql(value, rows, key="season, element", order="round"):
    return (f"avg(CAST({value} AS DOUBLE)) OVER (PARTITION BY {key} ORDER BY {order} "
            f"ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)")


def games_sql(flag, key="season, element"):
    return (f"coalesce(sum(CAST(coalesce({flag}, false) AS DOUBLE)) OVER (PARTITION BY {key} ORDER BY round "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")


def lag_sql(value, key="season, element", order="round"):
    return f"lag({value}) OVER (PARTITION BY {key} ORDER BY {order})"


def r6(expr, name):
    return f"round(CAST({expr} AS DOUBLE), 6) AS {name}"


def zero(expr):
    return f"coalesce({expr}, 0)"


RANK_SQL = "(SELECT season, dense_rank() OVER (ORDER BY season) - 1 AS s FROM (SELECT DISTINCT season FROM {}))"

# -- minutes -----------------------------------------------------------------------------------------

MINUTES = [
    *[(f"trailing_start_rate_{w}", zero(mean_sql("any_start", w))) for w in (3, 5, 10)],
    *[(f"trailing_minutes_mean_{w}", zero(mean_sql("round_minutes", w))) for w in (3, 5)],
    ("trailing_full_appearance_rate", zero(mean_sql("(round_minutes >= 75)", 5))),
    ("games_played_this_season", games_sql("any_start = 1 OR round_minutes > 0")),
    ("prev_gw_value", zero(lag_sql("round_value"))),
    ("prev_gw_selected_log1p", f"ln(1 + {zero(lag_sql('round_selected'))})"),
    ("prev_round_any_start", lag_sql("any_start")),
]
MINUTES_ROLL = st.ELIGIBLE_SQL + """,
labeled AS (SELECT *,
    CASE WHEN starts = 1 THEN 'START' WHEN minutes > 0 THEN 'SUB' ELSE 'UNUSED' END AS state,
    CASE WHEN minutes <= 0 THEN '0' WHEN minutes < 30 THEN '1-29' WHEN minutes < 60 THEN '30-59'
         WHEN minutes < 75 THEN '60-74' WHEN minutes < 90 THEN '75-89' ELSE '90' END AS band
  FROM eligible WHERE starts IS NOT NULL),
rolled AS (SELECT season, element, round, CAST(sum(minutes) AS BIGINT) AS round_minutes, max(starts) AS any_start,
    min(struct_pack(f := fixture, v := value)).v AS round_value,
    min(struct_pack(f := fixture, v := selected)).v AS round_selected
  FROM labeled GROUP BY ALL)"""
MINUTES_TRAIL = MINUTES_ROLL + ", trail AS (SELECT season, element, round, " + ", ".join(
    f"{e} AS {n}" for n, e in MINUTES) + " FROM rolled)"
GAP_SQL = """,
calendar AS (SELECT DISTINCT season, team, fixture, kickoff FROM eligible),
gap0 AS (SELECT *, lag(kickoff) OVER (PARTITION BY season, team ORDER BY kickoff, fixture) AS b FROM calendar),
gap AS (SELECT season, team, fixture, kickoff,
    CASE WHEN b IS NULL THEN 7.0 ELSE date_diff('minute', b, kickoff) / 1440.0 END AS days_since_team_previous_fixture,
    b IS NULL AS team_first_fixture_in_window FROM gap0)"""


@query("player_round_rollup", MINUTES_ROLL + " SELECT * FROM rolled")
def player_round_rollup(spark, sf):
    rows = fe.eligible(st.facts(spark, sf)).filter("starts IS NOT NULL")
    return fe.minutes_rounds(rows)


@query("trailing_mean", st.FACTS_SQL + f""", rolled AS (
    SELECT season, element, round, sum(total_points) AS p FROM facts GROUP BY ALL)
  SELECT season, element, round, {r6(mean_sql('p', 3), 'mean_3')}, {r6(mean_sql('p', 5), 'mean_5')},
         {r6(mean_sql('p', 10), 'mean_10')} FROM rolled""")
def trailing_mean(spark, sf):
    rounds = fe.player_rounds(st.facts(spark, sf), {"p": "total_points"})
    means = [fe.trailing_mean(F.col("p"), w, fe.PLAYER).alias(f"mean_{w}") for w in fe.WINDOWS]
    return rounded(rounds.select("*", *means), ["season", "element", "round"], [f"mean_{w}" for w in fe.WINDOWS])


@query("games_before_and_cold_start", st.FACTS_SQL + f""", rolled AS (
    SELECT season, element, round, sum(minutes) AS m, max(value) AS v FROM facts GROUP BY ALL)
  SELECT season, element, round, CAST({games_sql('m > 0')} AS BIGINT) AS games,
    {games_sql('m > 0')} = 0 AS cold_start, {r6('ln(1 + coalesce(' + lag_sql('v') + ', 0))', 'previous_value')} FROM rolled""")
def games_before_and_cold_start(spark, sf):
    rounds = fe.player_rounds(st.facts(spark, sf), {"m": "minutes"}, [F.max("value").alias("v")])
    games = fe.games_before(F.col("m") > 0)
    lagged = F.log1p(F.coalesce(fe.previous(F.col("v")).cast("double"), F.lit(0.0)))
    return rounds.select("season", "element", "round", games.cast("bigint").alias("games"),
                         (games == 0).alias("cold_start"), F.round(lagged, 6).alias("previous_value"))


@query("trailing_class_rates", st.FACTS_SQL + f""", rolled AS (
    SELECT season, element, round, sum(bonus) AS b FROM facts GROUP BY ALL)
  SELECT season, element, round, {', '.join(r6(mean_sql(f'(b = {k})', 5), f'rate_{k}') for k in range(4))} FROM rolled""")
def trailing_class_rates(spark, sf):
    rounds = fe.player_rounds(st.facts(spark, sf), {"b": "bonus"})
    rates = [fe.trailing_mean((F.col("b") == k).cast("int"), 5, fe.PLAYER).alias(f"rate_{k}") for k in range(4)]
    return rounded(rounds.select("*", *rates), ["season", "element", "round"], [f"rate_{k}" for k in range(4)])


@query("team_round_trailing", st.ELIGIBLE_SQL + f""", rolled AS (
    SELECT season, team, round, sum(bps) AS t FROM eligible GROUP BY ALL)
  SELECT season, team, round, {r6(zero(mean_sql('t', 5, 'season, team')), 'team_mean')},
    {lag_sql('t', 'season, team')} IS NULL AS team_cold_start FROM rolled""")
def team_round_trailing(spark, sf):
    team = fe.team_rounds(fe.eligible(st.facts(spark, sf)), "bps", "team_mean")
    return rounded(team, ["season", "team", "round", "team_cold_start"], ["team_mean"])


@query("rest_gap", st.ELIGIBLE_SQL + GAP_SQL + f"""
  SELECT {ROW}, team, round(g.days_since_team_previous_fixture, 6) AS days_since_team_previous_fixture,
         g.team_first_fixture_in_window
  FROM eligible JOIN gap g USING (season, team, fixture, kickoff)""")
def rest_gap(spark, sf):
    raw = fe.eligible(st.facts(spark, sf))
    gap = fe.attach_gap(raw, fe.team_fixture_gap(raw))
    return rounded(gap, [*ROWS, "team", "team_first_fixture_in_window"], ["days_since_team_previous_fixture"])


@query("chronological_rank", st.FACTS_SQL + f"""
  SELECT {ROW}, s * 100 + round AS chronological_rank FROM facts JOIN {RANK_SQL.format('facts')} r USING (season)""")
def chronological_rank(spark, sf):
    return fe.chronological_rank(st.facts(spark, sf)).select(*ROWS, "chronological_rank")


@query("minutes_training_table", MINUTES_TRAIL + GAP_SQL + f"""
  SELECT {ROW}, state, band, was_home, {', '.join(r6('t.' + n, n) for n, _ in MINUTES)},
    t.games_played_this_season = 0 AS cold_start, round(g.days_since_team_previous_fixture, 6) AS days_since_team_previous_fixture,
    g.team_first_fixture_in_window, s * 100 + round AS chronological_rank
  FROM labeled l JOIN trail t USING (season, element, round) JOIN gap g USING (season, team, fixture, kickoff)
  JOIN {RANK_SQL.format('labeled')} r USING (season)""")
def minutes_training_table(spark, sf):
    table = fe.minutes_table(st.facts(spark, sf))
    keep = [*ROWS, "state", "band", "was_home", "cold_start", "team_first_fixture_in_window", "chronological_rank"]
    return rounded(table, keep, [*[n for n, _ in MINUTES], "days_since_team_previous_fixture"])


# -- the other families ------------------------------------------------------------------------------

GAMES = ("games_played_this_season", games_sql("m > 0"))
ATTACKING = [
    *[(f"player_trailing_{m}_{w}", zero(mean_sql(m, w))) for m in ("goals", "assists", "xg", "xa") for w in (3, 5, 10)],
    GAMES,
    ("player_trailing_scored_rate_5", mean_sql("(goals > 0)", 5)),
    ("player_trailing_assisted_rate_5", mean_sql("(assists > 0)", 5)),
]
CARDS = [
    *[(f"player_trailing_card_rate_{w}", zero(mean_sql("(carded > 0)", w))) for w in (3, 5, 10)],
    GAMES,
    *[(f"player_trailing_cards_class_rate_{k}_5", mean_sql(f"(worst = {k})", 5)) for k in (0, 1, 2)],
]
SAVES = [*[(f"player_trailing_saves_mean_{w}", zero(mean_sql("saved", w))) for w in (3, 5, 10)], GAMES]
BONUS = [
    *[(f"player_trailing_bps_{w}", zero(mean_sql("b", w))) for w in (3, 5, 10)],
    GAMES,
    *[(f"player_trailing_bonus_class_rate_{k}_5", mean_sql(f"(won = {k})", 5)) for k in (0, 1, 2, 3)],
]
DEFENSIVE = [
    *[(f"player_trailing_count_{w}", zero(mean_sql("c", w, "grp, season, element"))) for w in (3, 5, 10)],
    ("games_played_this_season", games_sql("m > 0", "grp, season, element")),
    ("player_trailing_awarded_rate_5", mean_sql("(c >= threshold)", 5, "grp, season, element")),
]

SIDE = "CASE WHEN was_home THEN team_h_score ELSE team_a_score END AS team_goals, " \
       "CASE WHEN was_home THEN team_a_score ELSE team_h_score END AS opponent_goals"


def trail_sql(rows, rolled, features, key="season, element"):
    listed = ", ".join(f"{e} AS {n}" for n, e in features)
    return (f", used AS ({rows}), rolled AS (SELECT {key}, round, {rolled} FROM used GROUP BY {key}, round), "
            f"trail AS (SELECT {key}, round, {listed} FROM rolled)")


def team_sql(source, value):
    mean = zero(mean_sql("t", 5, "season, team"))
    return (f", tr AS (SELECT season, team, round, sum({value}) AS t FROM {source} GROUP BY ALL), "
            f"team_trail AS (SELECT season, team, round, {mean} AS team_mean, "
            f"{lag_sql('t', 'season, team')} IS NULL AS team_cold_start FROM tr)")


ATTACKING_TRAIL = st.ELIGIBLE_SQL + trail_sql(
    f"SELECT *, {SIDE} FROM eligible WHERE expected_goals IS NOT NULL AND expected_assists IS NOT NULL",
    "sum(goals_scored) AS goals, sum(assists) AS assists, sum(expected_goals) AS xg, sum(expected_assists) AS xa, "
    "sum(minutes) AS m", ATTACKING)
CARDS_TRAIL = st.ELIGIBLE_SQL + trail_sql(
    "SELECT *, CASE WHEN red_cards = 1 THEN 2 WHEN yellow_cards = 1 THEN 1 ELSE 0 END AS outcome FROM eligible",
    "sum(yellow_cards + red_cards) AS carded, max(outcome) AS worst, sum(minutes) AS m", CARDS)
SAVES_TRAIL = st.ELIGIBLE_SQL + trail_sql(
    f"SELECT *, {SIDE} FROM eligible WHERE position = 'GK'", "sum(saves) AS saved, sum(minutes) AS m", SAVES)
BONUS_TRAIL = st.ELIGIBLE_SQL + trail_sql(
    "SELECT *, least(greatest(minutes, 0), 90) / 90.0 AS minutes_frac FROM eligible",
    "sum(bps) AS b, sum(bonus) AS won, sum(minutes) AS m", BONUS)
DEFENSIVE_TRAIL = st.ELIGIBLE_SQL + trail_sql(
    """SELECT *, CASE WHEN position = 'DEF' THEN 'DEF' ELSE 'MID_FWD' END AS grp,
      tackles + clearances_blocks_interceptions + CASE WHEN position = 'DEF' THEN 0 ELSE recoveries END AS cnt,
      CASE WHEN position = 'DEF' THEN 10 ELSE 12 END AS threshold
    FROM eligible WHERE defensive_contribution IS NOT NULL AND position IN ('DEF', 'MID', 'FWD')""",
    "sum(cnt) AS c, max(threshold) AS threshold, sum(minutes) AS m", DEFENSIVE, "grp, season, element")


def table_sql(trail, features, extra, where="true", key="season, element, round", team=None, team_name=None):
    listed = ", ".join(r6("t." + n, n) for n, _ in features)
    teamed = f", round(tt.team_mean, 6) AS {team_name}, tt.team_cold_start" if team else ""
    join = "JOIN team_trail tt USING (season, team, round)" if team else ""
    return (f"{trail}{team or ''} SELECT {ROW}, {extra}, {listed}, t.games_played_this_season = 0 AS cold_start"
            f"{teamed}, s * 100 + round AS chronological_rank FROM used u JOIN trail t USING ({key}) {join} "
            f"JOIN {RANK_SQL.format('used')} r USING (season) WHERE {where}")


@query("attacking_training_table", table_sql(ATTACKING_TRAIL, ATTACKING, "position, was_home, team_goals, goals_scored, assists"))
def attacking_training_table(spark, sf):
    keep = [*ROWS, "position", "was_home", "team_goals", "goals_scored", "assists", "cold_start", "chronological_rank"]
    return rounded(fe.attacking_table(st.facts(spark, sf)), keep, [n for n, _ in ATTACKING])


@query("defensive_training_table", table_sql(
    DEFENSIVE_TRAIL, DEFENSIVE,
    'position, was_home, grp AS "group", cnt AS "count", CAST(cnt >= threshold AS INT) AS awarded, CAST(position = \'FWD\' AS INT) AS is_forward',
    key="grp, season, element, round", team=team_sql("used", "defensive_contribution"), team_name="team_trailing_dc_mean_5"))
def defensive_training_table(spark, sf):
    keep = [*ROWS, "position", "was_home", "group", "count", "awarded", "is_forward", "cold_start", "team_cold_start",
            "chronological_rank"]
    return rounded(fe.defensive_table(st.facts(spark, sf), THRESHOLDS), keep,
                   [*[n for n, _ in DEFENSIVE], "team_trailing_dc_mean_5"])


@query("cards_training_table", table_sql(
    CARDS_TRAIL, CARDS, "position, was_home, outcome", where="minutes > 0",
    team=team_sql("used", "yellow_cards + red_cards"), team_name="team_trailing_cards_mean_5"))
def cards_training_table(spark, sf):
    keep = [*ROWS, "position", "was_home", "outcome", "cold_start", "team_cold_start", "chronological_rank"]
    return rounded(fe.cards_table(st.facts(spark, sf)), keep, [*[n for n, _ in CARDS], "team_trailing_cards_mean_5"])


@query("saves_training_table", table_sql(
    SAVES_TRAIL, SAVES, "was_home, saves, opponent_goals AS opponent_goals_this_fixture", where="minutes > 0"))
def saves_training_table(spark, sf):
    keep = [*ROWS, "was_home", "saves", "opponent_goals_this_fixture", "cold_start", "chronological_rank"]
    return rounded(fe.saves_table(st.facts(spark, sf)), keep, [n for n, _ in SAVES])


@query("bonus_training_table", table_sql(
    BONUS_TRAIL, BONUS, "position, was_home, bonus, round(minutes_frac, 6) AS minutes_frac",
    team=team_sql("used", "bps"), team_name="team_trailing_bps_mean_5"))
def bonus_training_table(spark, sf):
    keep = [*ROWS, "position", "was_home", "bonus", "cold_start", "team_cold_start", "chronological_rank"]
    return rounded(fe.bonus_table(st.facts(spark, sf)), keep,
                   ["minutes_frac", *[n for n, _ in BONUS], "team_trailing_bps_mean_5"])


# -- serving: the round after a season's last one ----------------------------------------------------

def spine_of(facts):
    return facts.select("season", "element").distinct().withColumn("round", F.lit(99))


def serving_sql(trail, features, source="rolled", key="season, element"):
    """The oracle appends the future rows itself and runs the same windows."""
    head, _, tail = trail.partition(", trail AS (")
    cols = "NULL"
    listed = ", ".join(f"{e} AS {n}" for n, e in features)
    return (f"{head}, spine AS (SELECT DISTINCT {key}, 99 AS round, true AS is_spine FROM {source}), "
            f"both_rows AS (SELECT * FROM (SELECT *, false AS is_spine FROM {source}) UNION ALL BY NAME SELECT * FROM spine), "
            f"served AS (SELECT {key}, round, is_spine, {listed} FROM both_rows) "
            f"SELECT {key}, round, {', '.join(r6(n, n) for n, _ in features)}, "
            f"games_played_this_season = 0 AS cold_start FROM served WHERE is_spine")


def served(df, features, key=("season", "element")):
    return rounded(df, [*key, "round", "cold_start"], [n for n, _ in features])


@query("serve_minutes_rows", serving_sql(MINUTES_TRAIL, MINUTES))
def serve_minutes_rows(spark, sf):
    facts = st.facts(spark, sf)
    spine = spine_of(fe.eligible(facts).filter("starts IS NOT NULL"))
    return served(fe.serve_minutes(facts, spine), MINUTES)


@query("serve_attacking_rows", serving_sql(ATTACKING_TRAIL, ATTACKING))
def serve_attacking_rows(spark, sf):
    facts = st.facts(spark, sf)
    spine = spine_of(fe.eligible(facts).filter("expected_goals IS NOT NULL AND expected_assists IS NOT NULL"))
    return served(fe.serve_attacking(facts, spine), ATTACKING)


@query("serve_cards_rows", serving_sql(CARDS_TRAIL, CARDS))
def serve_cards_rows(spark, sf):
    facts = st.facts(spark, sf)
    return served(fe.serve_cards(facts, spine_of(fe.eligible(facts))), CARDS)


@query("serve_saves_rows", serving_sql(SAVES_TRAIL, SAVES))
def serve_saves_rows(spark, sf):
    facts = st.facts(spark, sf)
    return served(fe.serve_saves(facts, spine_of(fe.eligible(facts).filter("position = 'GK'"))), SAVES)


@query("serve_bonus_rows", serving_sql(BONUS_TRAIL, BONUS))
def serve_bonus_rows(spark, sf):
    facts = st.facts(spark, sf)
    return served(fe.serve_bonus(facts, spine_of(fe.eligible(facts))), BONUS)


@query("serve_defensive_rows", serving_sql(DEFENSIVE_TRAIL, DEFENSIVE, key="grp, season, element").replace(
    "max(threshold) AS threshold", "max(threshold) AS threshold").replace(
    "SELECT grp, season, element, round, round(", 'SELECT grp AS "group", season, element, round, round('))
def serve_defensive_rows(spark, sf):
    facts = st.facts(spark, sf)
    rows = fe.eligible(facts).filter("defensive_contribution IS NOT NULL AND position IN ('DEF', 'MID', 'FWD')")
    spine = fe.defensive_group(rows, THRESHOLDS).select("group", "season", "element").distinct().withColumn("round", F.lit(99))
    return served(fe.serve_defensive(facts, spine, THRESHOLDS), DEFENSIVE, ("group", "season", "element"))


# -- serving: a roster's next three fixtures, two of them in one round -------------------------------

SCHEDULE = [(0, 60, 3), (1, 61, 10), (2, 61, 12)]  # number, round, days after the team's last fixture of the season


def schedule(facts):
    last = facts.groupBy("season", "team").agg(F.max("kickoff").alias("last_kickoff"))
    rows = F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r).alias("round"), F.lit(d).alias("days")) for i, r, d in SCHEDULE]))
    return last.select("*", rows).select(
        "season", "team", "round", (F.lit(90_000_000) + F.col("i")).cast("long").alias("fixture"),
        F.expr("last_kickoff + make_dt_interval(days)").alias("kickoff"), (F.col("i") % 2 == 0).alias("was_home"))


def roster_of(facts):
    return fe.eligible(facts).select("season", "element", "team", "position").distinct()


def fixtures_sql(trail, features, where="true", key="season, element", team=None, gap=False, extra=""):
    """The oracle gives every player, and team, one closing row and joins it to all fixtures of the schedule."""
    head = trail.partition(", trail AS (")[0]
    listed = ", ".join(f"{e} AS {n}" for n, e in features)
    days = ", ".join(str(v) for v in SCHEDULE)
    out = (f"{head}, lasted AS (SELECT season, team, max(kickoff) AS lk FROM facts GROUP BY 1, 2), "
           f"schedule AS (SELECT season, team, v.round, 90000000 + i AS fixture, lk + to_days(d) AS kickoff, i % 2 = 0 AS was_home FROM lasted, (VALUES {days}) v(i, round, d)), "
           f"roster AS (SELECT DISTINCT season, element, team, position, CASE WHEN position = 'DEF' THEN 'DEF' ELSE 'MID_FWD' END AS grp FROM eligible WHERE {where}), "
           f"closing AS (SELECT DISTINCT {key}, 99 AS round, true AS is_spine FROM roster), "
           f"both_rows AS (SELECT * FROM (SELECT *, false AS is_spine FROM rolled) UNION ALL BY NAME SELECT * FROM closing), "
           f"served AS (SELECT * FROM (SELECT {key}, is_spine, {listed} FROM both_rows) WHERE is_spine)")
    shown, joins = "", ""
    if team:
        value, name = team
        out += (f", tr AS (SELECT season, team, round, sum({value}) AS t FROM used GROUP BY 1, 2, 3), "
                f"tboth AS (SELECT *, false AS closes FROM tr UNION ALL SELECT DISTINCT season, team, 99, NULL, true FROM roster), "
                f"team_served AS (SELECT * FROM (SELECT season, team, closes, {zero(mean_sql('t', 5, 'season, team'))} AS team_mean, "
                f"{lag_sql('t', 'season, team')} IS NULL AS team_cold_start FROM tboth) WHERE closes)")
        shown, joins = f", round(team_mean, 6) AS {name}, team_cold_start", "JOIN team_served USING (season, team)"
    if gap:
        out += (", instants AS (SELECT season, team, kickoff, min(fixture) AS first_fixture FROM (SELECT season, team, kickoff, fixture FROM eligible "
                "UNION ALL SELECT season, team, kickoff, fixture FROM schedule) GROUP BY 1, 2, 3), "
                "gaps AS (SELECT *, lag(kickoff) OVER (PARTITION BY season, team ORDER BY kickoff) AS before FROM instants)")
        shown = (", round(CASE WHEN fixture <> first_fixture THEN 0 WHEN before IS NULL THEN 7 ELSE date_diff('minute', before, kickoff) / 1440.0 END, 6) "
                 "AS days_since_team_previous_fixture, fixture = first_fixture AND before IS NULL AS team_first_fixture_in_window")
        joins = "JOIN gaps USING (season, team, kickoff)"
    return (f"{out} SELECT season, element, round, fixture, team, position, was_home{extra}, {', '.join(r6(n, n) for n, _ in features)}, "
            f"games_played_this_season = 0 AS cold_start{shown} FROM roster JOIN schedule USING (season, team) JOIN served USING ({key}) {joins}")


SERVED = ["season", "element", "round", "fixture", "team", "position", "was_home", "cold_start"]


@query("serve_minutes_fixtures", fixtures_sql(MINUTES_TRAIL, MINUTES, gap=True))
def serve_minutes_fixtures(spark, sf):
    facts = st.facts(spark, sf)
    rows = fe.serve_minutes_fixtures(facts, roster_of(facts), schedule(facts))
    return rounded(rows, [*SERVED, "team_first_fixture_in_window"], [*[n for n, _ in MINUTES], "days_since_team_previous_fixture"])


@query("serve_attacking_fixtures", fixtures_sql(ATTACKING_TRAIL, ATTACKING))
def serve_attacking_fixtures(spark, sf):
    facts = st.facts(spark, sf)
    return rounded(fe.serve_attacking_fixtures(facts, roster_of(facts), schedule(facts)), SERVED, [n for n, _ in ATTACKING])


@query("serve_defensive_fixtures", fixtures_sql(
    DEFENSIVE_TRAIL, DEFENSIVE, "position IN ('DEF', 'MID', 'FWD')", "grp, season, element", ("defensive_contribution", "team_trailing_dc_mean_5"),
    extra=', grp AS "group", CAST(position = \'FWD\' AS INT) AS is_forward'))
def serve_defensive_fixtures(spark, sf):
    facts = st.facts(spark, sf)
    rows = fe.serve_defensive_fixtures(facts, roster_of(facts), schedule(facts), THRESHOLDS)
    return rounded(rows, [*SERVED, "group", "is_forward", "team_cold_start"], [*[n for n, _ in DEFENSIVE], "team_trailing_dc_mean_5"])


@query("serve_cards_fixtures", fixtures_sql(CARDS_TRAIL, CARDS, team=("yellow_cards + red_cards", "team_trailing_cards_mean_5")))
def serve_cards_fixtures(spark, sf):
    facts = st.facts(spark, sf)
    rows = fe.serve_cards_fixtures(facts, roster_of(facts), schedule(facts))
    return rounded(rows, [*SERVED, "team_cold_start"], [*[n for n, _ in CARDS], "team_trailing_cards_mean_5"])


@query("serve_saves_fixtures", fixtures_sql(SAVES_TRAIL, SAVES, "position = 'GK'"))
def serve_saves_fixtures(spark, sf):
    facts = st.facts(spark, sf)
    return rounded(fe.serve_saves_fixtures(facts, roster_of(facts), schedule(facts)), SERVED, [n for n, _ in SAVES])


@query("serve_bonus_fixtures", fixtures_sql(BONUS_TRAIL, BONUS, team=("bps", "team_trailing_bps_mean_5")))
def serve_bonus_fixtures(spark, sf):
    facts = st.facts(spark, sf)
    rows = fe.serve_bonus_fixtures(facts, roster_of(facts), schedule(facts))
    return rounded(rows, [*SERVED, "team_cold_start"], [*[n for n, _ in BONUS], "team_trailing_bps_mean_5"])


@query("live_null_guard", st.FACTS_SQL + """
  SELECT season, element, n_rows, column_name FROM (
    SELECT season, element, count(*) AS n_rows, count(expected_goals) AS expected_goals,
      count(defensive_contribution) AS defensive_contribution, count(starts) AS starts FROM facts GROUP BY 1, 2)
  UNPIVOT (n FOR column_name IN (expected_goals, defensive_contribution, starts)) WHERE n = 0""")
def live_null_guard(spark, sf):
    return fe.live_null_guard(st.facts(spark, sf), ["expected_goals", "defensive_contribution", "starts"])


@query("referee_trailing", """WITH matches AS (
    SELECT l_orderkey AS fixture, min(l_suppkey) AS official_name, min(l_shipdate) AS kickoff, count(*) AS match_total_cards
    FROM lineitem GROUP BY 1)
  SELECT fixture, official_name, round(coalesce(avg(CAST(match_total_cards AS DOUBLE)) OVER (
      PARTITION BY official_name ORDER BY kickoff, fixture ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
      (SELECT avg(match_total_cards) FROM matches)), 6) AS referee_mean FROM matches""")
def referee_trailing(spark, sf):
    matches = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("fixture")).agg(
        F.min("l_suppkey").alias("official_name"), F.min("l_shipdate").alias("kickoff"),
        F.count("*").alias("match_total_cards"))
    trailed = fe.referee_trailing(matches)
    return trailed.select("fixture", "official_name",
                          F.round("referee_trailing_cards_per_match_10", 6).alias("referee_mean"))
