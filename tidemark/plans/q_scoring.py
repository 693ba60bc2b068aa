"""Rule scoring, awards, squads and decision tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import scoring as sc
from tidemark.operators.features import normalise_positions
from tidemark.plans import standins as st
from tidemark.plans.registry import query, table

# A scoring configuration in the published payload's form.
PAYLOAD = (
    '{"scoring": {"long_play": 2, "short_play": 1, "saves": 1, "assists": 3, "bonus": 1, "yellow_cards": -1, '
    '"red_cards": -3, "own_goals": -2, "penalties_saved": 5, "penalties_missed": -2, '
    '"goals_scored": {"GKP": 10, "DEF": 6, "MID": 5, "FWD": 4}, "clean_sheets": {"GKP": 4, "DEF": 4, "MID": 1, "FWD": 0}, '
    '"goals_conceded": {"GKP": -1, "DEF": -1, "MID": 0, "FWD": 0}, '
    '"defensive_contribution": {"GKP": 0, "DEF": 2, "MID": 2, "FWD": 2}}}'
)
PLAYED_SQL = st.FACTS_SQL + """, played AS (
  SELECT * REPLACE (CASE WHEN position = 'GKP' THEN 'GK' ELSE position END AS position),
    coalesce(defensive_contribution >= 10, false) AS met FROM facts WHERE position <> 'AM')"""
POINTS_SQL = """
  CASE WHEN minutes >= 60 THEN 2 WHEN minutes > 0 THEN 1 ELSE 0 END
  + clean_sheets * CASE position WHEN 'GK' THEN 4 WHEN 'DEF' THEN 4 WHEN 'MID' THEN 1 ELSE 0 END
  + goals_scored * CASE position WHEN 'GK' THEN 10 WHEN 'DEF' THEN 6 WHEN 'MID' THEN 5 ELSE 4 END
  + assists * 3 + (goals_conceded // 2) * CASE WHEN position IN ('GK', 'DEF') THEN -1 ELSE 0 END
  + own_goals * -2 + penalties_saved * 5 + penalties_missed * -2 - yellow_cards - red_cards * 3 + saves // 3 + bonus
  + CASE WHEN met AND position <> 'GK' THEN 2 ELSE 0 END"""


def played(spark, sf):
    met = F.coalesce(F.col("defensive_contribution") >= 10, F.lit(False))
    return normalise_positions(st.facts(spark, sf)).withColumn("defensive_contribution_met", met)


def config(spark):
    return sc.scoring_config(spark.createDataFrame([(PAYLOAD,)], "payload string"))


@query("points_from_outcomes", PLAYED_SQL + f"""
  SELECT season, round, element, fixture, line, position, CAST({POINTS_SQL} AS BIGINT) AS points FROM played""")
def points_from_outcomes(spark, sf):
    scored = sc.score_outcomes(played(spark, sf), config(spark))
    return scored.select("season", "round", "element", "fixture", "line", "position", "points")


@query("season_points_with_config", PLAYED_SQL + f"""
  SELECT season, position, CAST(sum({POINTS_SQL}) AS BIGINT) AS points, count(*) AS n FROM played GROUP BY ALL""")
def season_points_with_config(spark, sf):
    scored = sc.score_outcomes(played(spark, sf), config(spark))
    return scored.groupBy("season", "position").agg(F.sum("points").alias("points"), F.count("*").alias("n"))


@query("invalid_outcomes", st.FACTS_SQL + """
  SELECT season, element, fixture, line, position FROM facts WHERE position NOT IN ('GK', 'DEF', 'MID', 'FWD')
     OR (clean_sheets > 0 AND minutes < 60) OR bonus > 3""")
def invalid_outcomes(spark, sf):
    return sc.invalid_outcomes(st.facts(spark, sf)).select("season", "element", "fixture", "line", "position")


@query("zero_missing_weights", st.FACTS_SQL + """
  SELECT season, CAST(count(expected_goals) > 0 AS INT) AS use_expected_goals,
    CAST(count(defensive_contribution) > 0 AS INT) AS use_defensive_contribution FROM facts GROUP BY 1""")
def zero_missing_weights(spark, sf):
    return sc.zero_missing_weights(st.facts(spark, sf), ["expected_goals", "defensive_contribution"])


# -- awards ------------------------------------------------------------------------------------------

@query("award_by_rank", """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS quantity,
    CAST(greatest(0, 4 - rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC)) AS INT) AS award FROM lineitem""")
def award_by_rank(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    awarded = sc.award_points(lines, ["l_orderkey"], "l_quantity")
    return awarded.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                          F.col("l_quantity").cast("bigint").alias("quantity"), "award")


VERIFY_SQL = st.FACTS_SQL + """, ruled AS (
  SELECT season, fixture, bonus, greatest(0, 4 - rank() OVER (PARTITION BY season, fixture ORDER BY bps DESC)) AS rule FROM facts),
 verified AS (SELECT season, fixture, count(*) AS n_players,
    CAST(sum(CASE WHEN rule <> bonus THEN 1 ELSE 0 END) AS BIGINT) AS n_mismatched FROM ruled GROUP BY 1, 2 HAVING count(*) > 1)"""


@query("award_rule_by_fixture", VERIFY_SQL + """
  SELECT season, fixture, n_players, n_mismatched, n_mismatched = 0 AS matches FROM verified""")
def award_rule_by_fixture(spark, sf):
    return sc.verify_awards(st.facts(spark, sf), ["season", "fixture"])


@query("award_rule_match_rate", VERIFY_SQL + """
  SELECT count(*) AS fixtures, CAST(sum(CASE WHEN n_mismatched = 0 THEN 1 ELSE 0 END) AS BIGINT) AS matching,
    round(avg(CASE WHEN n_mismatched = 0 THEN 1.0 ELSE 0.0 END), 6) AS match_rate FROM verified""")
def award_rule_match_rate(spark, sf):
    return sc.verify_awards(st.facts(spark, sf), ["season", "fixture"]).agg(
        F.count("*").alias("fixtures"), F.count_if("matches").alias("matching"),
        F.round(F.avg(F.col("matches").cast("double")), 6).alias("match_rate"))


@query("outcome_space_checks", st.FACTS_SQL + """
  SELECT position, CAST(sum(CASE WHEN yellow_cards = 1 AND red_cards = 1 THEN 1 ELSE 0 END) AS BIGINT) AS both_cards,
    CAST(sum(CASE WHEN minutes = 0 AND yellow_cards + red_cards > 0 THEN 1 ELSE 0 END) AS BIGINT) AS carded_without_minutes,
    CAST(sum(CASE WHEN minutes = 90 AND coalesce(starts, 0) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS full_without_start,
    round(corr(saves, goals_conceded), 6) AS saves_conceded_correlation FROM facts GROUP BY 1""")
def outcome_space_checks(spark, sf):
    cards = F.col("yellow_cards") + F.col("red_cards")
    return st.facts(spark, sf).groupBy("position").agg(
        F.count_if((F.col("yellow_cards") == 1) & (F.col("red_cards") == 1)).alias("both_cards"),
        F.count_if((F.col("minutes") == 0) & (cards > 0)).alias("carded_without_minutes"),
        F.count_if((F.col("minutes") == 90) & (F.coalesce("starts", F.lit(0)) == 0)).alias("full_without_start"),
        F.round(F.corr("saves", "goals_conceded"), 6).alias("saves_conceded_correlation"))


# -- squads ------------------------------------------------------------------------------------------

POOL_SQL = st.FACTS_SQL + """, pool AS (
  SELECT season, round, element, min(CASE WHEN position = 'GKP' THEN 'GK' ELSE position END) AS position, min(team) AS team,
    min(value) AS value, min(selected) AS worth, -min(selected) AS unpopular FROM facts WHERE position <> 'AM' GROUP BY 1, 2, 3),
 quotas(position, quota) AS (VALUES ('GK', 2), ('DEF', 5), ('MID', 5), ('FWD', 3)),
 squads AS (
  SELECT arm, season, round, element, position, team, value, worth FROM (
    SELECT 'cheap' AS arm, *, row_number() OVER (PARTITION BY season, round, position ORDER BY value, element) pick FROM pool
    UNION ALL
    SELECT 'popular' AS arm, *, row_number() OVER (PARTITION BY season, round, position ORDER BY unpopular, element) pick FROM pool)
  JOIN quotas USING (position) WHERE pick <= quota)"""
ELEVEN_SQL = POOL_SQL + """, bounds(position, lo, hi) AS (VALUES ('GK', 1, 1), ('DEF', 3, 5), ('MID', 2, 5), ('FWD', 1, 3)),
 placed AS (SELECT *, row_number() OVER (PARTITION BY arm, season, round, position ORDER BY worth DESC, element) AS pr FROM squads),
 cored AS (SELECT *, pr <= lo AS core, pr > lo AND pr <= hi AS room FROM placed JOIN bounds USING (position)),
 filled AS (SELECT *, row_number() OVER (PARTITION BY arm, season, round, room ORDER BY worth DESC, element) AS fill,
    sum(CASE WHEN core THEN 1 ELSE 0 END) OVER (PARTITION BY arm, season, round) AS cores FROM cored),
 eleven AS (SELECT *, core OR (room AND fill <= 11 - cores) AS in_eleven FROM filled),
 chosen AS (SELECT *, row_number() OVER (PARTITION BY arm, season, round, in_eleven ORDER BY worth DESC, element) AS slot FROM eleven)"""


def squads(spark, sf):
    rows = normalise_positions(st.facts(spark, sf))
    pool = rows.groupBy("season", "round", "element").agg(
        F.min("position").alias("position"), F.min("team").alias("team"), F.min("value").alias("value"),
        F.min("selected").alias("worth"), (-F.min("selected")).alias("unpopular"))
    quotas = sc.SquadRules().composition
    arms = [
        sc.cheapest_per_position(pool, quotas, ["season", "round"], price).withColumn("arm", F.lit(arm))
        for arm, price in (("cheap", "value"), ("popular", "unpopular"))
    ]
    return arms[0].unionByName(arms[1]).drop("pick", "unpopular")


def elevens(spark, sf):
    return sc.choose_eleven(squads(spark, sf), ["arm", "season", "round"])


@query("cheapest_per_position", POOL_SQL + " SELECT arm, season, round, element, position, value FROM squads")
def cheapest_per_position(spark, sf):
    return squads(spark, sf).select("arm", "season", "round", "element", "position", "value")


@query("best_eleven", ELEVEN_SQL + """
  SELECT arm, season, round, element, position, in_eleven, slot, in_eleven AND slot = 1 AS is_captain,
    in_eleven AND slot = 2 AS is_vice FROM chosen""")
def best_eleven(spark, sf):
    return elevens(spark, sf).select("arm", "season", "round", "element", "position", "in_eleven", "slot", "is_captain", "is_vice")


@query("squad_validity", POOL_SQL + """, whole AS (
   SELECT arm, season, round, count(*) AS n, sum(value) AS cost, count(*) FILTER (position = 'GK') AS gk,
     count(*) FILTER (position = 'DEF') AS def, count(*) FILTER (position = 'MID') AS mid, count(*) FILTER (position = 'FWD') AS fwd
   FROM squads GROUP BY 1, 2, 3),
 club AS (SELECT arm, season, round, max(c) AS club FROM (SELECT arm, season, round, team, count(*) c FROM squads GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
 flags AS (SELECT arm, season, round, unnest([CASE WHEN n <> 15 THEN 'size' END, CASE WHEN cost > 1000 THEN 'budget' END,
   CASE WHEN club > 3 THEN 'club_cap' END, CASE WHEN gk <> 2 THEN 'composition_GK' END, CASE WHEN def <> 5 THEN 'composition_DEF' END,
   CASE WHEN mid <> 5 THEN 'composition_MID' END, CASE WHEN fwd <> 3 THEN 'composition_FWD' END]) AS broken_rule
   FROM whole JOIN club USING (arm, season, round))
 SELECT * FROM flags WHERE broken_rule IS NOT NULL""")
def squad_validity(spark, sf):
    return sc.squad_checks(squads(spark, sf), ["arm", "season", "round"])


OUTCOME_SQL = """, outcome AS (SELECT season, round, element, sum(total_points) AS pts, sum(minutes) AS mins FROM facts GROUP BY 1, 2, 3),
 joined AS (SELECT c.*, in_eleven AND slot = 1 AS cap, in_eleven AND slot = 2 AS vice, coalesce(pts, 0) AS pts, coalesce(mins, 0) AS mins
   FROM chosen c LEFT JOIN outcome USING (season, round, element))"""


@query("round_outcomes", st.FACTS_SQL + """
  SELECT season, round, element, CAST(sum(total_points) AS BIGINT) AS total_points, CAST(sum(minutes) AS BIGINT) AS minutes
  FROM facts GROUP BY 1, 2, 3""")
def round_outcomes(spark, sf):
    return sc.round_outcomes(st.facts(spark, sf))


@query("score_elevens_as_named", ELEVEN_SQL + OUTCOME_SQL + """
  SELECT season, arm, round, CAST(sum(CASE WHEN in_eleven THEN pts ELSE 0 END) AS BIGINT) AS base_points,
    CAST(CASE WHEN max(CASE WHEN cap AND mins > 0 THEN 1 ELSE 0 END) = 1 THEN sum(CASE WHEN cap THEN pts ELSE 0 END)
         ELSE sum(CASE WHEN vice AND mins > 0 THEN pts ELSE 0 END) END AS BIGINT) AS captain_points
  FROM joined GROUP BY 1, 2, 3""")
def score_elevens_as_named(spark, sf):
    scored = sc.score_decisions(elevens(spark, sf), sc.round_outcomes(st.facts(spark, sf)), with_autosubs=False)
    return scored.select("season", "arm", "round", "base_points", "captain_points")


@query("score_decisions_with_autosubs")
def score_decisions_with_autosubs(spark, sf):
    scored = sc.score_decisions(elevens(spark, sf), sc.round_outcomes(st.facts(spark, sf)))
    return scored.select("season", "arm", "round", "base_points", "captain_points", "n_subs", "points")


@query("autosub_moves")
def autosub_moves(spark, sf):
    scored = sc.score_decisions(elevens(spark, sf), sc.round_outcomes(st.facts(spark, sf)))
    moves = scored.select("season", "arm", "round", F.posexplode("subs").alias("step", "move"))
    return moves.select("season", "arm", "round", "step", "move.out", "move.in")


# -- signals -----------------------------------------------------------------------------------------

@query("seeded_signal", """SELECT s_suppkey AS element,
  round(CAST(('0x' || substr(md5(CAST(s_suppkey AS VARCHAR) || ':7'), 1, 8)) AS BIGINT) / 4294967296.0, 9) AS signal FROM
  (SELECT DISTINCT l_suppkey AS s_suppkey FROM lineitem)""")
def seeded_signal(spark, sf):
    ids = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("element")).distinct()
    return ids.select("element", F.round(sc.seeded_uniform("element", F.lit("7")), 9).alias("signal"))


@query("seeded_sample", """SELECT user_id FROM (SELECT DISTINCT user_id FROM events)
  ORDER BY substr(md5(CAST(user_id AS VARCHAR) || ':11'), 1, 8), user_id LIMIT 25""")
def seeded_sample(spark, sf):
    return sc.sample_entities(table(spark, sf, "events"), "user_id", 11, 25)


@query("previous_round_ownership", st.FACTS_SQL + """
  SELECT season, element, min(struct_pack(f := fixture, s := selected)).s AS signal FROM facts WHERE round = 19 GROUP BY 1, 2""")
def previous_round_ownership(spark, sf):
    return sc.previous_round_ownership(st.facts(spark, sf), 20)


@query("recent_form", st.FACTS_SQL + """
  SELECT season, element, CAST(sum(total_points) AS BIGINT) AS signal FROM facts WHERE round BETWEEN 16 AND 19 GROUP BY 1, 2""")
def recent_form(spark, sf):
    return sc.form(st.facts(spark, sf), 20)


@query("candidates_with_fallback", st.FACTS_SQL + """, h AS (SELECT * FROM facts WHERE season = '1999-00'),
  pool AS (SELECT element, min(position) AS position, min(team) AS team, avg(total_points) AS expected FROM h WHERE round = 20 GROUP BY 1),
  held AS (SELECT DISTINCT element FROM facts WHERE season = '1998-99'),
  known AS (SELECT element, max(struct_pack(a := round, b := fixture, position := position, team := team)) AS l FROM h WHERE round < 20 GROUP BY 1)
  SELECT element, position, team, round(expected, 6) AS expected, false AS from_history FROM pool
  UNION ALL
  SELECT held.element, l.position, l.team, 0.0, true FROM held LEFT JOIN known USING (element)
  WHERE held.element NOT IN (SELECT element FROM pool)""")
def candidates_with_fallback(spark, sf):
    facts = st.facts(spark, sf)
    season = facts.filter("season = '1999-00'")
    pool = season.filter("round = 20").groupBy("element").agg(
        F.min("position").alias("position"), F.min("team").alias("team"), F.round(F.avg("total_points"), 6).alias("expected"))
    held = facts.filter("season = '1998-99'").select("element")
    return sc.candidates(pool, held, season.filter("round < 20"), ["position", "team"])
