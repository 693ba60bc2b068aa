"""Nested payloads to rows. Every function takes a table with one JSON payload per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.dates import local_to_utc
from tidemark.operators.relational import home_or_away

_PLAYER = "STRUCT<id: STRING, position: STRING, subPosition: STRING, shirtNum: INT, isCaptain: BOOLEAN>"
_SIDE = f"STRUCT<teamId: STRING, players: ARRAY<{_PLAYER}>>"


def needed(value: Column, name: str) -> Column:
    """The value, or a failed query when the payload lacks it."""
    return F.coalesce(value, F.raise_error(F.lit(f"payload lacks {name}")).cast("string"))


def lineups(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Starters and bench; a substitute's position is its sub-position. A missing side has no rows."""
    parsed = payloads.select("match_id", F.from_json(payload, f"STRUCT<home_team: {_SIDE}, away_team: {_SIDE}>").alias("m"))
    sides = parsed.select("match_id", F.explode(F.array_compact(F.array("m.home_team", "m.away_team"))).alias("t"))
    players = sides.select("match_id", needed(F.col("t.teamId"), "teamId").alias("team_code"), F.explode("t.players").alias("p"))
    bench = F.col("p.position") == "Substitute"
    return players.select(
        "match_id", F.col("team_code").cast("bigint").alias("team_code"), F.col("p.id").cast("bigint").alias("player_code"),
        F.when(bench, "bench").otherwise("start").alias("role"),
        F.when(bench, F.col("p.subPosition")).otherwise(F.col("p.position")).alias("position"),
        F.col("p.shirtNum").alias("shirt_number"), F.coalesce("p.isCaptain", F.lit(False)).alias("is_captain"),
    )


def substitutions(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """The player going off is required, the one coming on is not."""
    side = "STRUCT<id: STRING, subs: ARRAY<STRUCT<playerOnId: STRING, playerOffId: STRING, period: STRING, time: STRING>>>"
    parsed = payloads.select("match_id", F.from_json(payload, f"STRUCT<homeTeam: {side}, awayTeam: {side}>").alias("m"))
    sides = parsed.select("match_id", F.explode(F.array_compact(F.array("m.homeTeam", "m.awayTeam"))).alias("t"))
    subs = sides.select("match_id", needed(F.col("t.id"), "id").alias("team_code"), F.explode("t.subs").alias("s"))
    return subs.select(
        "match_id", F.col("team_code").cast("bigint").alias("team_code"), F.col("s.period").alias("period"),
        F.col("s.time").cast("int").alias("minute"), F.col("s.playerOnId").cast("bigint").alias("player_on_code"),
        needed(F.col("s.playerOffId"), "playerOffId").cast("bigint").alias("player_off_code"),
    )


def _stat_rows(df: DataFrame, stats: str) -> DataFrame:
    """Long statistics: numbers in ``value``, anything else as JSON in ``value_raw``."""
    rows = df.select(*[c for c in df.columns if c != stats], F.explode(stats).alias("stat_key", "_v"))
    kind = F.schema_of_variant("_v")
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return rows.select(
        *[c for c in rows.columns if c != "_v"], F.when(number, F.variant_get("_v", "$", "double")).alias("value"),
        F.when(~number & (kind != "VOID"), F.to_json("_v")).alias("value_raw"),
    )


def team_match_stats(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    sides = F.from_json(payload, "ARRAY<STRUCT<side: STRING, stats: MAP<STRING, VARIANT>>>")
    rows = payloads.select("match_id", F.explode(sides).alias("b")).select("match_id", "b.side", F.col("b.stats").alias("_s"))
    return _stat_rows(rows, "_s")


def player_season_stats(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    stats = F.from_json(payload, "STRUCT<stats: MAP<STRING, VARIANT>>")["stats"]
    return _stat_rows(payloads.select("season", "player_element_id", stats.alias("_s")), "_s")


def fixtures(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Fixtures of a match week, local kickoffs turned into UTC."""
    team = "STRUCT<id: STRING, name: STRING>"
    data = F.from_json(payload, f"STRUCT<data: ARRAY<STRUCT<matchId: STRING, kickoff: STRING, homeTeam: {team}, awayTeam: {team}, ground: STRING, period: STRING>>>")
    rows = payloads.select("season", "matchweek", F.explode(data["data"]).alias("f"))
    local = F.to_timestamp_ntz(needed(F.col("f.kickoff"), "kickoff"), F.lit("yyyy-MM-dd HH:mm:ss"))
    return rows.select(
        needed(F.col("f.matchId"), "matchId").alias("match_id"), "season", "matchweek", local_to_utc(local).alias("kickoff"),
        needed(F.col("f.homeTeam.id"), "homeTeam.id").cast("bigint").alias("home_team_code"),
        needed(F.col("f.awayTeam.id"), "awayTeam.id").cast("bigint").alias("away_team_code"),
        F.col("f.homeTeam.name").alias("home_team_name"), F.col("f.awayTeam.name").alias("away_team_name"),
        F.col("f.ground").alias("ground"), F.col("f.period").alias("period"),
    )


def officials(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    entry = "STRUCT<type: STRING, official: STRUCT<name: STRING, firstName: STRING, lastName: STRING>>"
    rows = payloads.select("match_id", F.explode(F.from_json(payload, f"STRUCT<matchOfficials: ARRAY<{entry}>>")["matchOfficials"]).alias("o"))
    role = needed(F.col("o.type"), "type")
    return rows.select("match_id", role.alias("role"), (role == "Referee").alias("is_referee"), F.col("o.official.name").alias("official_name"),
                       F.col("o.official.firstName").alias("official_first_name"), F.col("o.official.lastName").alias("official_last_name"))


_OUTCOME = "STRUCT<name: STRING, description: STRING, price: DOUBLE, point: DOUBLE>"
_EVENT = ("STRUCT<id: STRING, commence_time: STRING, home_team: STRING, away_team: STRING, bookmakers: ARRAY<STRUCT<key: STRING, title: STRING, "
          f"markets: ARRAY<STRUCT<key: STRING, last_update: STRING, outcomes: ARRAY<{_OUTCOME}>>>>>>")


def quotes(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Bookmaker, market and outcome levels unrolled to one row per quote."""
    e = payloads.select(F.from_json(payload, _EVENT).alias("e"))
    match = ["provider_event_id", "commence_time", "home_team", "away_team"]
    b = e.select(
        needed(F.col("e.id"), "id").alias("provider_event_id"), needed(F.col("e.commence_time"), "commence_time").alias("commence_time"),
        "e.home_team", "e.away_team", F.inline("e.bookmakers").alias("bookmaker_key", "bookmaker_title", "_markets"),
    )
    m = b.select(*match, "bookmaker_key", "bookmaker_title", F.inline("_markets").alias("market_key", "market_last_update", "_outcomes"))
    kept = [*match, "bookmaker_key", "bookmaker_title", "market_key", "market_last_update"]
    return m.select(*kept, F.inline("_outcomes").alias("outcome_name", "player_name_raw", "outcome_price", "outcome_point"))


def picks(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """A manager's picks with the entry's history of the event beside each."""
    schema = ("STRUCT<active_chip: STRING, entry_history: STRUCT<bank: INT, value: INT, event_transfers: INT, event_transfers_cost: INT, points_on_bench: INT, overall_rank: BIGINT>, "
              "picks: ARRAY<STRUCT<element: BIGINT, position: INT, multiplier: INT, is_captain: BOOLEAN, is_vice_captain: BOOLEAN>>>")
    rows = payloads.select("event", "entry_id", F.from_json(payload, schema).alias("p"))
    h = "p.entry_history"
    return rows.select("event", "entry_id", F.col("p.active_chip").alias("active_chip"), F.col(f"{h}.bank").alias("bank"),
                       F.col(f"{h}.value").alias("team_value"), F.col(f"{h}.event_transfers").alias("event_transfers"),
                       F.col(f"{h}.event_transfers_cost").alias("event_transfers_cost"), F.col(f"{h}.points_on_bench").alias("points_on_bench"),
                       F.col(f"{h}.overall_rank").alias("overall_rank"), F.inline("p.picks"))


def automatic_subs(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    schema = "STRUCT<automatic_subs: ARRAY<STRUCT<element_in: BIGINT, element_out: BIGINT>>>"
    return payloads.select("event", "entry_id", F.inline(F.from_json(payload, schema)["automatic_subs"]))


# Statistics that add up over fixtures, and those known only for a single one.
LINEAR = ("minutes", "goals_scored", "assists", "clean_sheets", "own_goals", "yellow_cards", "red_cards", "penalties_saved",
          "penalties_missed", "bonus")
THRESHOLD = ("saves", "goals_conceded", "defensive_contribution")
STATS_ONLY = ("bps", "clearances_blocks_interceptions", "recoveries", "tackles", "starts")
EXPECTED = ("expected_goals", "expected_assists", "expected_goal_involvements", "expected_goals_conceded")


def live_rows(payloads: DataFrame, games: DataFrame, known: DataFrame, season: str, gameweek: int, payload: str = "payload") -> DataFrame:
    """Live gameweek rows per player and fixture.

    One fixture: the player's own statistics. Several: only what each fixture's explanation attributes,
    linear statistics defaulting to 0, the others unknown, and the row marked incomplete. A player named
    by no explanation takes the fixtures of the current team; without any there is no row.

    ``payloads``: element, current_team and JSON. ``games``: fixture id, team_h, team_a, scores, kickoff.
    ``known``: element, team_id, team, position as of the round's deadline.
    """
    fields = ", ".join([*[f"{c}: BIGINT" for c in ("total_points", *LINEAR, *THRESHOLD, *STATS_ONLY)], *[f"{c}: STRING" for c in EXPECTED]])
    schema = (f"STRUCT<stats: STRUCT<{fields}>, explain: ARRAY<STRUCT<fixture: BIGINT, "
              "stats: ARRAY<STRUCT<identifier: STRING, points: INT, value: BIGINT>>>>>")
    live = payloads.select("element", "current_team", F.from_json(payload, schema).alias("l"))
    explained = live.filter(F.size(F.coalesce("l.explain", F.array())) > 0).withColumn(
        "n_fixtures", F.size(F.array_distinct("l.explain.fixture"))
    ).select("element", "l", "n_fixtures", F.explode("l.explain").alias("x"))
    explained = explained.select("element", F.col("l.stats").alias("s"), "n_fixtures", F.col("x.fixture").alias("fixture"), F.col("x.stats").alias("parts"))
    by_team = games.select("fixture", F.explode(F.array_distinct(F.array("team_h", "team_a"))).alias("current_team"))
    per_team = by_team.groupBy("current_team").agg(F.count("*").cast("int").alias("n_fixtures"))
    idle = live.filter(F.size(F.coalesce("l.explain", F.array())) == 0).join(per_team, "current_team").join(by_team, "current_team").select(
        "element", F.col("l.stats").alias("s"), "n_fixtures", "fixture",
        F.expr("CAST(array() AS ARRAY<STRUCT<identifier: STRING, points: INT, value: BIGINT>>)").alias("parts"),
    )
    rows = explained.unionByName(idle).join(games, "fixture").join(known, "element", "left")
    single = F.col("n_fixtures") == 1
    given = F.map_from_entries(F.transform("parts", lambda p: F.struct(p["identifier"], p["value"])))
    rows = rows.withColumn("_given", given)
    points = F.aggregate("parts", F.lit(0), lambda t, p: t + F.coalesce(p["points"], F.lit(0)))
    home, opponent = home_or_away(F.col("team_id"))
    return rows.select(
        F.lit(season).alias("season"), F.lit(gameweek).alias("round"), "element", "fixture", "team", "position", "team_h_score", "team_a_score",
        "kickoff_time", home.alias("was_home"), opponent.alias("opponent_team"), single.alias("attribution_complete"),
        F.when(single, F.coalesce("s.total_points", F.lit(0))).otherwise(points.cast("bigint")).alias("total_points"),
        *[F.when(single, F.coalesce(f"s.{c}", F.lit(0)) if c == "minutes" else F.col(f"s.{c}")).otherwise(F.coalesce(F.col("_given")[c], F.lit(0))).alias(c) for c in LINEAR],
        *[F.when(single, F.col(f"s.{c}")).otherwise(F.col("_given")[c]).alias(c) for c in THRESHOLD],
        *[F.when(single, F.col(f"s.{c}")).alias(c) for c in STATS_ONLY],
        *[F.when(single, F.col(f"s.{c}").cast("double")).alias(c) for c in EXPECTED],
    )


def history_mirror(payloads: DataFrame, total_players: int, payload: str = "payload") -> DataFrame:
    """A player's history per fixture with ownership in percent; duplicate keys are a finding of Q2."""
    item = "STRUCT<round: INT, fixture: BIGINT, minutes: INT, starts: INT, goals_scored: INT, assists: INT, selected: BIGINT, value: INT, total_points: INT>"
    rows = payloads.select("player_code", "element", F.inline(F.from_json(payload, f"STRUCT<history: ARRAY<{item}>>")["history"]))
    percent = F.round(F.col("selected") / F.lit(total_players) * 100, 2)
    return rows.withColumnRenamed("round", "gameweek").withColumn("ownership_percent", percent if total_players > 0 else F.lit(None).cast("double"))
