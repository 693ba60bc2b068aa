"""Rollups, match tables, conditional aggregates, profiles and sample checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators.features import trailing_mean
from tidemark.operators.ordered import trailing_mean_rows
from tidemark.session import written

# The sample check's limits.
SAMPLE_LIMIT_PP = 3.0
SAMPLE_MIN_PERCENT = 1.0


def match_table(facts: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One row per fixture: kickoff, both sides, goals, and xG where no player of either side lacks it.

    Fixtures without a resolvable side and seasons whose team is wholly NULL drop out. ``names`` maps
    (season, team) to a canonical name.
    """
    if names is not None:
        facts = canonical_teams(facts, names)
    side = F.col("was_home")

    def xg(cond: Column) -> Column:
        whole = (F.count_if(cond) > 0) & (F.count_if(cond & F.col("expected_goals").isNull()) == 0)
        return F.when(whole, F.sum(F.when(cond, F.col("expected_goals"))))

    first = F.struct("element", "team")
    grouped = facts.groupBy("season", "fixture").agg(
        F.min("kickoff").alias("kickoff"), F.min("round").alias("round"),
        F.min(F.when(side & F.col("team").isNotNull(), first))["team"].alias("home_team"),
        F.min(F.when(~side & F.col("team").isNotNull(), first))["team"].alias("away_team"),
        F.max("team_h_score").alias("home_goals"), F.max("team_a_score").alias("away_goals"),
        xg(side).alias("_hx"), xg(~side).alias("_ax"),
    )
    both = F.col("_hx").isNotNull() & F.col("_ax").isNotNull()
    return (
        grouped.filter(F.col("home_team").isNotNull() & F.col("away_team").isNotNull())
        .withColumn("home_xg", F.when(both, F.col("_hx"))).withColumn("away_xg", F.when(both, F.col("_ax")))
        .drop("_hx", "_ax")
    )


def canonical_teams(facts: DataFrame, names: DataFrame) -> DataFrame:
    """Left join of the name map on (season, team); unmapped names stay."""
    mapped = names.select("season", "team", F.col("canonical").alias("_name"))
    return facts.join(mapped, ["season", "team"], "left").withColumn("team", F.coalesce("_name", "team")).drop("_name")


def drop_unrecorded_seasons(facts: DataFrame, column: str) -> DataFrame:
    """Leave out the seasons in which a column is NULL throughout."""
    empty = facts.groupBy("season").agg(F.count(column).alias("_n")).filter("_n = 0").select("season")
    return facts.join(empty, "season", "left_anti")


def team_rounds_total(facts: DataFrame, value: Column | str, out: str = "total") -> DataFrame:
    return facts.groupBy("season", "team", "round").agg(F.sum(value).alias(out))


def match_cards(facts: DataFrame) -> DataFrame:
    return facts.groupBy("season", "fixture").agg(F.sum(F.col("yellow_cards") + F.col("red_cards")).alias("match_total_cards"))


def resolved_referees(facts: DataFrame, team_identity: DataFrame, fixtures: DataFrame, officials: DataFrame) -> DataFrame:
    """Referee and total cards of each fixture: opponent id to code, (date, away code) to match, match to referee.

    ``team_identity``: season, id, code. ``fixtures``: match_id, kickoff, away_team_code. ``officials``:
    match_id, is_referee, official_name. Fixtures without a referee drop out. The facts are read once: home sides and cards
    come from one rollup.
    """
    sides = written(facts.groupBy("season", "round", "fixture", "opponent_team", "kickoff").agg(
        F.max("was_home").alias("was_home"), F.sum(F.col("yellow_cards") + F.col("red_cards")).alias("_cards")), "sides")
    home = sides.filter("was_home").select("season", "round", "fixture", "opponent_team", "kickoff")
    cards = sides.groupBy("season", "fixture").agg(F.sum("_cards").alias("match_total_cards"))
    codes = team_identity.select("season", F.col("id").alias("opponent_team"), F.col("code").alias("away_team_code"))
    played = fixtures.select("match_id", F.to_date("kickoff").alias("kickoff_date"), "away_team_code")
    referees = officials.filter("is_referee").select("match_id", "official_name")
    resolved = (
        home.withColumn("kickoff_date", F.to_date("kickoff"))
        .join(codes, ["season", "opponent_team"], "left").join(played, ["kickoff_date", "away_team_code"], "left")
        .join(referees, "match_id", "left").join(cards, ["season", "fixture"], "left")
    )
    return resolved.filter(F.col("official_name").isNotNull()).select(
        "season", "round", "fixture", "kickoff", "match_id", "official_name", "match_total_cards"
    )


def attach_referee(table: DataFrame, referees: DataFrame, feature: str = "referee_trailing_cards_per_match_10") -> DataFrame:
    """Rows of fixtures with a known referee, with the referee's trailing mean; the others leave."""
    return table.join(referees.select("season", "round", "fixture", feature), ["season", "round", "fixture"])


def rates_by_group(facts: DataFrame, group: str, condition: Column) -> DataFrame:
    """Share of an outcome per group, with the overall share for groups without rows."""
    counted = facts.groupBy(group).agg(F.count("*").alias("n"), F.sum(condition.cast("double")).alias("_s"))
    overall = counted.agg(F.sum("_s") / F.sum("n")).first()[0]
    return counted.select(group, "n", F.coalesce(F.col("_s") / F.col("n"), F.lit(overall)).alias("rate"),
                          F.lit(overall).alias("overall_rate"))


def ownership(picks: DataFrame, entry: str = "entry_id", element: str = "element") -> DataFrame:
    """Share of sampled entries that hold each element, in percent."""
    n = picks.agg(F.count_distinct(entry)).first()[0]
    held = picks.groupBy(element).agg(F.count("*").alias("n_picks"))
    return held.withColumn("sampled_percent", F.col("n_picks") / F.lit(n) * 100)


def sample_deviation(sampled: DataFrame, population: DataFrame, key: str = "element", percent: str = "selected_by_percent",
                     minimum: float = SAMPLE_MIN_PERCENT) -> DataFrame:
    """Sample against population; elements nobody sampled count as zero."""
    wanted = population.filter(F.col(percent) >= minimum)
    joined = wanted.join(sampled.select(key, "sampled_percent"), key, "left")
    own = F.coalesce(F.col("sampled_percent"), F.lit(0.0))
    return joined.select(key, F.col(percent).alias("population_percent"), own.alias("sampled_percent"),
                         (own - F.col(percent)).alias("deviation"))


def sample_verdict(deviation: DataFrame, limit: float = SAMPLE_LIMIT_PP) -> DataFrame:
    return deviation.agg(F.count("*").alias("n"), F.max(F.abs("deviation")).alias("max_deviation")).withColumn(
        "passed", F.col("max_deviation") <= limit
    )


def worst_offenders(deviation: DataFrame, key: str = "element", n: int = 10) -> DataFrame:
    return deviation.orderBy(F.desc(F.abs("deviation")), key).limit(n)


def pin_thresholds(observations: DataFrame, group: str, count: str, awarded: str) -> DataFrame:
    """The award threshold of each group, pinned when the lowest award is one above the highest non-award."""
    low, high = F.col("lower_bound"), F.col("upper_bound")
    return (
        observations.groupBy(group).agg(
            F.min(F.when(F.col(awarded), F.col(count))).alias("lower_bound"),
            F.max(F.when(~F.col(awarded), F.col(count))).alias("upper_bound"),
            F.count_if(F.col(awarded).isNotNull()).alias("n_observations"),
            F.count_if(F.col(awarded).isNull()).alias("n_unattributable"),
        )
        .withColumn("contradiction", F.coalesce(low <= high, F.lit(False)))
        .withColumn("count_threshold", F.when(low - 1 == high, low))
    )


def null_profile(df: DataFrame, columns: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """Share of NULLs of every column in one pass, as one row per column."""
    counts = df.groupBy(*key).agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in columns])
    return counts.select(*key, "_n", F.inline(pairs)).select(
        *key, "column_name", "n_null", (F.col("n_null") / F.col("_n")).alias("null_rate")
    )


def missing_after_join(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Feature columns with NULLs left after a join; empty when the join was complete."""
    return null_profile(df, columns).filter(F.col("n_null") > 0)


def result_rates(matches: DataFrame, window: int = 5) -> DataFrame:
    """Each side's share of wins, draws and losses over its last matches at any venue; a third each at first.

    Both sides of a match become rows; a team may have any number of matches, so the window is split.
    """
    goals = F.col("home_goals") - F.col("away_goals")
    sides = [
        matches.select("season", "fixture", "kickoff", F.col(f"{s}_team").alias("team"), F.lit(s).alias("side"),
                       (sign * goals).alias("_d")) for s, sign in (("home", 1), ("away", -1))
    ]
    rows = sides[0].unionByName(sides[1]).select(
        "season", "fixture", "kickoff", "team", "side",
        *[cond.cast("double").alias(f"_{n}") for n, cond in (("w", F.col("_d") > 0), ("d", F.col("_d") == 0), ("l", F.col("_d") < 0))],
    )
    trailed = trailing_mean_rows(rows, ["team"], ["kickoff", "season", "fixture", "side"],
                                 {"win_rate": "_w", "draw_rate": "_d", "loss_rate": "_l"}, window)
    third = F.lit(1.0 / 3.0)
    return trailed.select("season", "fixture", "team", "side",
                          *[F.coalesce(c, third).alias(c) for c in ("win_rate", "draw_rate", "loss_rate")])


def form_forecast(rates: DataFrame) -> DataFrame:
    """Away, draw and home chances from both sides' win rates."""
    wide = rates.groupBy("season", "fixture").agg(
        *[F.max(F.when(F.col("side") == s, F.least(F.col("win_rate") * 0.8, F.lit(0.79)))).alias(f"_{s}") for s in ("home", "away")]
    )
    draw = F.greatest(1 - F.col("_home") - F.col("_away"), F.lit(0.01))
    total = F.col("_home") + F.col("_away") + draw
    return wide.select("season", "fixture", (F.col("_away") / total).alias("p_away"), (draw / total).alias("p_draw"),
                       (F.col("_home") / total).alias("p_home"))


def outcome_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))
