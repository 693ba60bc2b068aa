"""Leakage-free trailing features.

Every family follows one path: fixture rows are rolled up to rounds (map-side combined sums, so a hot
player shrinks to at most one row per round before any window), windows run over earlier rounds only,
and the result is attached back to the fixture rows or read off appended future rows when serving.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators.ordered import trailing_mean_rows
from tidemark.session import small, written

# Trailing windows, defaults and thresholds of the features.
WINDOWS = (3, 5, 10)
TEAM_WINDOW = 5
CLASS_RATE_WINDOW = 5
REFEREE_WINDOW = 10
FIRST_FIXTURE_GAP_DAYS = 7.0
FULL_APPEARANCE_MINUTES = 75
POSITIONS = ("GK", "DEF", "MID", "FWD")

# A round after every other, for rows that close a player's or team's history.
CLOSING_ROUND = 2**31 - 1

PLAYER = ("season", "element")
TEAM = ("season", "team")


# -- row preparation ---------------------------------------------------------------------------------

def normalise_positions(df: DataFrame) -> DataFrame:
    kept = df.filter(F.col("position") != "AM")
    return kept.withColumn("position", F.when(F.col("position") == "GKP", "GK").otherwise(F.col("position")))


def eligible(df: DataFrame, seasons: Sequence[str] | None = None, allow_live: bool = False) -> DataFrame:
    """Rows that may train a model: archive rows with complete attribution and known positions."""
    if not allow_live:
        df = df.filter(F.col("source_provider") != "live")
    df = normalise_positions(df.filter(F.coalesce(F.col("attribution_complete"), F.lit(True))))
    return df.filter(F.col("season").isin(*seasons)) if seasons else df


def minutes_state(df: DataFrame) -> DataFrame:
    """START / SUB / UNUSED and the six minute bands."""
    m = F.col("minutes")
    state = F.when(F.col("starts") == 1, "START").when(m > 0, "SUB").otherwise("UNUSED")
    band = (
        F.when(m <= 0, "0").when(m < 30, "1-29").when(m < 60, "30-59").when(m < 75, "60-74")
        .when(m < 90, "75-89").otherwise("90")
    )
    return df.withColumn("state", state).withColumn("band", band)


def card_outcome(df: DataFrame) -> DataFrame:
    """0 none, 1 yellow, 2 red; a row with both is a broken input."""
    both = (F.col("yellow_cards") == 1) & (F.col("red_cards") == 1)
    outcome = (
        F.when(both, F.raise_error(F.lit("a row has both a yellow and a red card")).cast("int"))
        .when(F.col("red_cards") == 1, 2).when(F.col("yellow_cards") == 1, 1).otherwise(0)
    )
    return df.withColumn("outcome", outcome)


def side_goals(df: DataFrame) -> DataFrame:
    home = F.col("was_home")
    return df.withColumn("team_goals", F.when(home, F.col("team_h_score")).otherwise(F.col("team_a_score"))).withColumn(
        "opponent_goals", F.when(home, F.col("team_a_score")).otherwise(F.col("team_h_score"))
    )


def possible_goals(df: DataFrame) -> DataFrame:
    """Fail the query when a player has more goals or assists than the team scored."""
    bad = (F.col("goals_scored") > F.col("team_goals")) | (F.col("assists") > F.col("team_goals"))
    guarded = F.when(bad, F.raise_error(F.lit("goals or assists exceed the team's goals")).cast("int")).otherwise(
        F.col("team_goals")
    )
    return df.withColumn("team_goals", guarded)


def defensive_group(df: DataFrame, thresholds: Mapping[str, int]) -> DataFrame:
    """Group, component count and award: defenders without recoveries, others with."""
    base = F.col("tackles") + F.col("clearances_blocks_interceptions")
    group = F.when(F.col("position") == "DEF", "DEF").when(F.col("position").isin("MID", "FWD"), "MID_FWD")
    count = F.when(F.col("position") == "DEF", base).otherwise(base + F.col("recoveries"))
    limit = F.when(F.col("position") == "DEF", thresholds["DEF"]).otherwise(thresholds["MID_FWD"])
    return (
        df.withColumn("group", group).withColumn("count", count).withColumn("threshold", limit)
        .withColumn("awarded", (F.col("count") >= F.col("threshold")).cast("int"))
        .withColumn("is_forward", (F.col("position") == "FWD").cast("int"))
    )


def minutes_fraction(df: DataFrame) -> DataFrame:
    clipped = F.least(F.greatest(F.col("minutes"), F.lit(0)), F.lit(90))
    return df.withColumn("minutes_frac", clipped / F.lit(90.0))


# -- windows over rounds -----------------------------------------------------------------------------

def earlier(key: Sequence[str], rows: int | None = None, order: str = "round") -> W:
    start = W.unboundedPreceding if rows is None else -rows
    return W.partitionBy(*key).orderBy(order).rowsBetween(start, -1)


def trailing_mean(value: Column, rows: int, key: Sequence[str], order: str = "round") -> Column:
    return F.avg(value.cast("double")).over(earlier(key, rows, order))


def games_before(appeared: Column, key: Sequence[str] = PLAYER) -> Column:
    flag = F.coalesce(appeared.cast("double"), F.lit(0.0))
    return F.coalesce(F.sum(flag).over(earlier(key)), F.lit(0.0))


def previous(value: Column, key: Sequence[str] = PLAYER, order: str = "round") -> Column:
    return F.lag(value).over(W.partitionBy(*key).orderBy(order))


def first_by(order: Sequence[str], value: str) -> Column:
    """The value on the first row by ``order``; equal positions take the smaller value."""
    return F.min(F.struct(*order, value))[value]


def chronological_rank(df: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``season position * 100 + round``.

    ``rows`` is a cheaper table with the same seasons (before any join), so that numbering the seasons
    reads one column instead of running the whole query twice. There is one season per calendar year.
    """
    seasons = (df if rows is None else rows).select("season").distinct()
    ranked = small(seasons.withColumn("_s", F.dense_rank().over(W.orderBy("season")) - 1))
    return (
        df.join(ranked, "season").withColumn("chronological_rank", F.col("_s") * 100 + F.col("round")).drop("_s")
    )


# -- round tables ------------------------------------------------------------------------------------

def player_rounds(df: DataFrame, sums: Mapping[str, Column | str], extra: Sequence[Column] = (),
                  key: Sequence[str] = PLAYER) -> DataFrame:
    totals = [F.sum(v).alias(k) for k, v in sums.items()]
    return df.groupBy(*key, "round").agg(*totals, *extra)


def team_totals(df: DataFrame, value: Column | str) -> DataFrame:
    return df.groupBy(*TEAM, "round").agg(F.sum(value).alias("_total"))


def team_trail(totals: DataFrame, out: str) -> DataFrame:
    return totals.select(
        *TEAM, "round",
        F.coalesce(trailing_mean(F.col("_total"), TEAM_WINDOW, TEAM), F.lit(0.0)).alias(out),
        previous(F.col("_total"), TEAM).isNull().alias("team_cold_start"),
    )


def team_rounds(df: DataFrame, value: Column | str, out: str) -> DataFrame:
    """Team totals per round with the mean of the five rounds before and a no-history flag."""
    return team_trail(team_totals(df, value), out)


def attach_team(df: DataFrame, team: DataFrame, feature: str) -> DataFrame:
    joined = df.join(small(team), [*TEAM, "round"], "left")
    return joined.withColumn(feature, F.coalesce(F.col(feature), F.lit(0.0))).withColumn(
        "team_cold_start", F.coalesce(F.col("team_cold_start"), F.lit(True))
    )


def team_fixture_gap(df: DataFrame) -> DataFrame:
    """Days since the team's previous fixture, one row per team and kickoff instant.

    Only the first fixture of an instant looks back to the instant before, the others follow at once,
    so the window runs over distinct instants and never over all fixtures of a busy team.
    """
    instants = df.groupBy(*TEAM, "kickoff").agg(F.min("fixture").alias("_first_fixture"))
    before = F.lag("kickoff").over(W.partitionBy(*TEAM).orderBy("kickoff"))
    minutes = F.timestamp_diff("MINUTE", F.col("_before"), F.col("kickoff"))
    gap = F.when(F.col("_before").isNull(), FIRST_FIXTURE_GAP_DAYS).otherwise(minutes / F.lit(1440.0))
    return instants.withColumn("_before", before).select(
        *TEAM, "kickoff", "_first_fixture", gap.alias("_gap"), F.col("_before").isNull().alias("_opening")
    )


def attach_gap(df: DataFrame, gap: DataFrame) -> DataFrame:
    first = F.col("fixture") == F.col("_first_fixture")
    return (
        df.join(small(gap), [*TEAM, "kickoff"], "left")
        .withColumn("days_since_team_previous_fixture", F.when(first, F.col("_gap")).otherwise(0.0))
        .withColumn("team_first_fixture_in_window", first & F.col("_opening"))
        .drop("_first_fixture", "_gap", "_opening")
    )


def _zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def minutes_rounds(df: DataFrame, sums: Mapping[str, Column | str] | None = None) -> DataFrame:
    """``sums`` are further totals of a round that the trail passes on."""
    return player_rounds(
        df, {"round_minutes": "minutes", **(sums or {})},
        [F.max("starts").alias("any_start"), first_by(["fixture"], "value").alias("round_value"),
         first_by(["fixture"], "selected").alias("round_selected")],
    )


def minutes_trail(rounds: DataFrame) -> DataFrame:
    start, minutes = F.col("any_start"), F.col("round_minutes")
    appeared = (start == 1) | (minutes > 0)
    games = games_before(appeared)
    return rounds.select(
        *[c for c in rounds.columns if c not in ("round_value", "round_selected")],
        *[_zero(trailing_mean(start, w, PLAYER)).alias(f"trailing_start_rate_{w}") for w in WINDOWS],
        *[_zero(trailing_mean(minutes, w, PLAYER)).alias(f"trailing_minutes_mean_{w}") for w in (3, 5)],
        _zero(trailing_mean((minutes >= FULL_APPEARANCE_MINUTES).cast("int"), 5, PLAYER))
        .alias("trailing_full_appearance_rate"),
        games.alias("games_played_this_season"),
        (games == 0).alias("cold_start"),
        _zero(previous(F.col("round_value")).cast("double")).alias("prev_gw_value"),
        F.log1p(_zero(previous(F.col("round_selected")).cast("double"))).alias("prev_gw_selected_log1p"),
        previous(start).cast("double").alias("prev_round_any_start"),
    )


def attacking_rounds(df: DataFrame) -> DataFrame:
    return player_rounds(df, {
        "round_goals": "goals_scored", "round_assists": "assists", "round_xg": "expected_goals",
        "round_xa": "expected_assists", "round_minutes": "minutes",
    })


def attacking_trail(rounds: DataFrame) -> DataFrame:
    games = games_before(F.col("round_minutes") > 0)
    return rounds.select(
        "*",
        *[_zero(trailing_mean(F.col(f"round_{m}"), w, PLAYER)).alias(f"player_trailing_{m}_{w}")
          for m in ("goals", "assists", "xg", "xa") for w in WINDOWS],
        games.alias("games_played_this_season"), (games == 0).alias("cold_start"),
        trailing_mean((F.col("round_goals") > 0).cast("int"), CLASS_RATE_WINDOW, PLAYER)
        .alias("player_trailing_scored_rate_5"),
        trailing_mean((F.col("round_assists") > 0).cast("int"), CLASS_RATE_WINDOW, PLAYER)
        .alias("player_trailing_assisted_rate_5"),
    )


def defensive_rounds(df: DataFrame) -> DataFrame:
    return player_rounds(df, {"round_count": "count", "round_minutes": "minutes"},
                         [F.max("threshold").alias("threshold")], key=("group", *PLAYER))


def defensive_trail(rounds: DataFrame) -> DataFrame:
    key = ("group", *PLAYER)
    games = games_before(F.col("round_minutes") > 0, key)
    awarded = (F.col("round_count") >= F.col("threshold")).cast("int")
    return rounds.select(
        *[c for c in rounds.columns if c != "threshold"],
        *[_zero(trailing_mean(F.col("round_count"), w, key)).alias(f"player_trailing_count_{w}") for w in WINDOWS],
        games.alias("games_played_this_season"), (games == 0).alias("cold_start"),
        trailing_mean(awarded, CLASS_RATE_WINDOW, key).alias("player_trailing_awarded_rate_5"),
    )


def cards_rounds(df: DataFrame) -> DataFrame:
    return player_rounds(df, {"round_carded": F.col("yellow_cards") + F.col("red_cards"), "round_minutes": "minutes"},
                         [F.max("outcome").alias("round_outcome")])


def cards_trail(rounds: DataFrame) -> DataFrame:
    games = games_before(F.col("round_minutes") > 0)
    carded = (F.col("round_carded") > 0).cast("int")
    return rounds.select(
        "*",
        *[_zero(trailing_mean(carded, w, PLAYER)).alias(f"player_trailing_card_rate_{w}") for w in WINDOWS],
        games.alias("games_played_this_season"), (games == 0).alias("cold_start"),
        *[trailing_mean((F.col("round_outcome") == k).cast("int"), CLASS_RATE_WINDOW, PLAYER)
          .alias(f"player_trailing_cards_class_rate_{k}_5") for k in (0, 1, 2)],
    )


def saves_rounds(df: DataFrame) -> DataFrame:
    return player_rounds(df, {"round_saves": "saves", "round_minutes": "minutes"})


def saves_trail(rounds: DataFrame) -> DataFrame:
    games = games_before(F.col("round_minutes") > 0)
    return rounds.select(
        "*",
        *[_zero(trailing_mean(F.col("round_saves"), w, PLAYER)).alias(f"player_trailing_saves_mean_{w}") for w in WINDOWS],
        games.alias("games_played_this_season"), (games == 0).alias("cold_start"),
    )


def bonus_rounds(df: DataFrame) -> DataFrame:
    return player_rounds(df, {"round_bps": "bps", "round_bonus": "bonus", "round_minutes": "minutes"})


def bonus_trail(rounds: DataFrame) -> DataFrame:
    games = games_before(F.col("round_minutes") > 0)
    return rounds.select(
        "*",
        *[_zero(trailing_mean(F.col("round_bps"), w, PLAYER)).alias(f"player_trailing_bps_{w}") for w in WINDOWS],
        games.alias("games_played_this_season"), (games == 0).alias("cold_start"),
        *[trailing_mean((F.col("round_bonus") == k).cast("int"), CLASS_RATE_WINDOW, PLAYER)
          .alias(f"player_trailing_bonus_class_rate_{k}_5") for k in (0, 1, 2, 3)],
    )


# -- training tables ---------------------------------------------------------------------------------

def attach_player(df: DataFrame, features: DataFrame, key: Sequence[str] = PLAYER) -> DataFrame:
    """Left join on (key, round); round totals stay behind, they belong to the round being predicted."""
    wanted = features.select(*[c for c in features.columns if not c.startswith("round_") and c != "any_start"])
    return df.join(wanted, [*key, "round"], "left")


def started_rounds(facts: DataFrame, seasons: Sequence[str] | None = None, allow_live: bool = False) -> DataFrame:
    """A row per player and round with the features of ``minutes_table`` and how many of its rows start (n_1) or do not (n_0).

    All rows of a round have the same features, so counting them in the rollup spares the join back to the rows.
    """
    labeled = eligible(facts, seasons, allow_live).filter(F.col("starts").isNotNull())
    return minutes_trail(minutes_rounds(labeled, {f"n_{y}": (F.col("starts") == y).cast("long") for y in (0, 1)}))


def minutes_table(facts: DataFrame, seasons: Sequence[str] | None = None, allow_live: bool = False) -> DataFrame:
    raw = eligible(facts, seasons, allow_live)
    labeled = minutes_state(raw.filter(F.col("starts").isNotNull()))
    table = attach_player(labeled, minutes_trail(minutes_rounds(labeled)))
    return chronological_rank(attach_gap(table, team_fixture_gap(raw)), labeled)


def attacking_table(facts: DataFrame, seasons: Sequence[str] | None = None, allow_live: bool = False) -> DataFrame:
    raw = eligible(facts, seasons, allow_live)
    labeled = raw.filter(F.col("expected_goals").isNotNull() & F.col("expected_assists").isNotNull())
    labeled = possible_goals(side_goals(labeled))
    return chronological_rank(attach_player(labeled, attacking_trail(attacking_rounds(labeled))), labeled)


def defensive_table(facts: DataFrame, thresholds: Mapping[str, int], seasons: Sequence[str] | None = None,
                    allow_live: bool = False) -> DataFrame:
    """Both groups in one pass: the group is one more partition column of the same windows."""
    raw = eligible(facts, seasons, allow_live)
    raw = raw.filter(F.col("defensive_contribution").isNotNull() & F.col("position").isin("DEF", "MID", "FWD"))
    rows = defensive_group(raw, thresholds)
    table = attach_player(rows, defensive_trail(defensive_rounds(rows)), ("group", *PLAYER))
    team = team_rounds(raw, "defensive_contribution", "team_trailing_dc_mean_5")
    return chronological_rank(attach_team(table, team, "team_trailing_dc_mean_5"), raw)


def cards_table(facts: DataFrame, seasons: Sequence[str] | None = None, allow_live: bool = False) -> DataFrame:
    raw = card_outcome(eligible(facts, seasons, allow_live).filter(F.col("team").isNotNull()))
    table = attach_player(raw, cards_trail(cards_rounds(raw)))
    team = team_rounds(raw, F.col("yellow_cards") + F.col("red_cards"), "team_trailing_cards_mean_5")
    table = attach_team(table, team, "team_trailing_cards_mean_5")
    # Idle rows leave after the windows, where they count.
    return chronological_rank(table.filter(F.col("minutes") > 0), raw.filter(F.col("minutes") > 0))


def saves_table(facts: DataFrame, seasons: Sequence[str] | None = None, allow_live: bool = False) -> DataFrame:
    raw = eligible(facts, seasons, allow_live).filter(F.col("team").isNotNull() & (F.col("position") == "GK"))
    rows = side_goals(raw).withColumnRenamed("opponent_goals", "opponent_goals_this_fixture")
    table = attach_player(rows, saves_trail(saves_rounds(rows)))
    return chronological_rank(table.filter(F.col("minutes") > 0), raw.filter(F.col("minutes") > 0))


def bonus_table(facts: DataFrame, seasons: Sequence[str] | None = None, allow_live: bool = False) -> DataFrame:
    raw = minutes_fraction(eligible(facts, seasons, allow_live).filter(F.col("team").isNotNull()))
    table = attach_player(raw, bonus_trail(bonus_rounds(raw)))
    team = team_rounds(raw, "bps", "team_trailing_bps_mean_5")
    return chronological_rank(attach_team(table, team, "team_trailing_bps_mean_5"), raw)


# -- serving -----------------------------------------------------------------------------------------

def serve(rounds: DataFrame, spine: DataFrame, trail, key: Sequence[str] = PLAYER) -> DataFrame:
    """Features as they stand before each round of a whole roster: the training windows over all earlier rounds.

    ``spine`` has (key, round); its rounds may lie in the past, in the future, or skip some. What holds before a round is
    what the windows say on the first round of the history that is not earlier, or on a closing row without outcome.
    So served rounds never stand in each other's windows, and a past round is served as it was trained.
    """
    wanted = spine.select(*key, "round").distinct()
    closing = wanted.select(*key).distinct().withColumn("round", F.lit(CLOSING_ROUND))
    trailed = trail(rounds.unionByName(closing, allowMissingColumns=True))
    features = [c for c in trailed.columns if not c.startswith("round_") and c not in (*key, "round", "any_start")]
    both = wanted.unionByName(trailed.select(*key, "round", F.struct(*features).alias("_known")), allowMissingColumns=True)
    # One row per player and round of the calendar: from the last round back, the latest history row seen so far.
    later = W.partitionBy(*key).orderBy(F.desc("round"), F.col("_known").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("_next", F.last("_known", ignorenulls=True).over(later)).filter(F.col("_known").isNull())
    return found.select(*key, "round", "_next.*")


def serve_minutes(facts: DataFrame, spine: DataFrame) -> DataFrame:
    return serve(minutes_rounds(eligible(facts).filter(F.col("starts").isNotNull())), spine, minutes_trail)


def serve_attacking(facts: DataFrame, spine: DataFrame) -> DataFrame:
    rows = eligible(facts).filter(F.col("expected_goals").isNotNull() & F.col("expected_assists").isNotNull())
    return serve(attacking_rounds(rows), spine, attacking_trail)


def serve_cards(facts: DataFrame, spine: DataFrame) -> DataFrame:
    return serve(cards_rounds(card_outcome(eligible(facts))), spine, cards_trail)


def serve_saves(facts: DataFrame, spine: DataFrame) -> DataFrame:
    return serve(saves_rounds(eligible(facts).filter(F.col("position") == "GK")), spine, saves_trail)


def serve_bonus(facts: DataFrame, spine: DataFrame) -> DataFrame:
    return serve(bonus_rounds(eligible(facts)), spine, bonus_trail)


def serve_defensive(facts: DataFrame, spine: DataFrame, thresholds: Mapping[str, int]) -> DataFrame:
    """``spine`` also names the group of each player."""
    raw = eligible(facts).filter(
        F.col("defensive_contribution").isNotNull() & F.col("position").isin("DEF", "MID", "FWD")
    )
    return serve(defensive_rounds(defensive_group(raw, thresholds)), spine, defensive_trail, ("group", *PLAYER))


def roster_fixtures(roster: DataFrame, fixtures: DataFrame) -> DataFrame:
    """One row per player and fixture of the player's team.

    roster: season, element, team, position. fixtures: season, team, round, fixture, kickoff, was_home, a row for each side.
    """
    joined = normalise_positions(roster.select(*TEAM, "element", "position").distinct()).join(
        fixtures.select(*TEAM, "round", "fixture", "kickoff", "was_home"), list(TEAM))
    return written(joined, "upcoming")  # read for the players' spine, for the teams' and for the served rows


def _with_player(upcoming: DataFrame, features: DataFrame, key: Sequence[str] = PLAYER) -> DataFrame:
    return upcoming.join(features, [*key, "round"])


def _with_team(upcoming: DataFrame, totals: DataFrame, out: str) -> DataFrame:
    return attach_team(upcoming, serve(totals, upcoming, lambda rows: team_trail(rows, out), TEAM), out)


def serve_minutes_fixtures(facts: DataFrame, roster: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Player features, rest gap, venue and position. Fixtures of the schedule count for the gap, whoever is served."""
    upcoming = roster_fixtures(roster, fixtures)
    played = eligible(facts).select(*TEAM, "kickoff", "fixture").unionByName(fixtures.select(*TEAM, "kickoff", "fixture"))
    return attach_gap(_with_player(upcoming, serve_minutes(facts, upcoming)), team_fixture_gap(played))


def serve_attacking_fixtures(facts: DataFrame, roster: DataFrame, fixtures: DataFrame) -> DataFrame:
    upcoming = roster_fixtures(roster, fixtures)
    return _with_player(upcoming, serve_attacking(facts, upcoming))


def serve_defensive_fixtures(facts: DataFrame, roster: DataFrame, fixtures: DataFrame, thresholds: Mapping[str, int]) -> DataFrame:
    """Outfield players, with the group that sets their threshold."""
    upcoming = roster_fixtures(roster.filter(F.col("position").isin("DEF", "MID", "FWD")), fixtures)
    upcoming = upcoming.withColumn("group", F.when(F.col("position") == "DEF", "DEF").otherwise("MID_FWD"))
    served = _with_player(upcoming, serve_defensive(facts, upcoming, thresholds), ("group", *PLAYER))
    raw = eligible(facts).filter(F.col("defensive_contribution").isNotNull() & F.col("position").isin("DEF", "MID", "FWD"))
    served = _with_team(served, team_totals(raw, "defensive_contribution"), "team_trailing_dc_mean_5")
    return served.withColumn("is_forward", (F.col("position") == "FWD").cast("int"))


def serve_cards_fixtures(facts: DataFrame, roster: DataFrame, fixtures: DataFrame) -> DataFrame:
    upcoming = roster_fixtures(roster, fixtures)
    raw = eligible(facts).filter(F.col("team").isNotNull())
    served = _with_player(upcoming, serve_cards(facts, upcoming))
    return _with_team(served, team_totals(raw, F.col("yellow_cards") + F.col("red_cards")), "team_trailing_cards_mean_5")


def serve_saves_fixtures(facts: DataFrame, roster: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Goalkeepers only; the goals against in the fixture itself are not known before it."""
    upcoming = roster_fixtures(roster, fixtures).filter(F.col("position") == "GK")
    return _with_player(upcoming, serve_saves(facts, upcoming))


def serve_bonus_fixtures(facts: DataFrame, roster: DataFrame, fixtures: DataFrame) -> DataFrame:
    upcoming = roster_fixtures(roster, fixtures)
    raw = eligible(facts).filter(F.col("team").isNotNull())
    return _with_team(_with_player(upcoming, serve_bonus(facts, upcoming)), team_totals(raw, "bps"), "team_trailing_bps_mean_5")


def live_null_guard(facts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Entities that have earlier rows but no value at all in some source column: one row per finding."""
    counts = facts.groupBy(*PLAYER).agg(F.count("*").alias("n_rows"), *[F.count(c).alias(c) for c in columns])
    empty = F.filter(
        F.array(*[F.when(F.col(c) == 0, F.lit(c)) for c in columns]), lambda c: c.isNotNull()
    )
    return counts.select(*PLAYER, "n_rows", F.explode(empty).alias("column_name"))


# -- referee features --------------------------------------------------------------------------------

def referee_trailing(matches: DataFrame, referee: str = "official_name", value: str = "match_total_cards",
                     order: Sequence[str] = ("kickoff", "fixture")) -> DataFrame:
    """Mean of a referee's ten matches before, across seasons; a first match takes the overall mean."""
    matches = written(matches, "matches")  # read for the mean, for the slices' bounds and for the slices
    overall = matches.agg(F.avg(F.col(value).cast("double"))).first()[0]
    out = "referee_trailing_cards_per_match_10"
    trailed = trailing_mean_rows(matches, [referee], list(order), {out: value}, REFEREE_WINDOW)
    return trailed.withColumn(out, F.coalesce(F.col(out), F.lit(overall)))
