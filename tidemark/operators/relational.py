"""Joins and set operations that the data model needs more than once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

_FAMILY = {
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType, T.DecimalType),
}
# Hours before a deadline at which a capture window of one hour is centred, and its tries.
CAPTURE_HOURS = (78, 26, 6, 2)
CAPTURE_WIDTH_MINUTES = 60
CAPTURE_ATTEMPTS = 2


def union_widened(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name with missing columns as NULL; a column of mixed families becomes text.

    Spark would turn text joined with integers into bigint and fail on the text.
    """
    kinds: dict[str, set] = {}
    for df in frames:
        for f in df.schema:
            if not isinstance(f.dataType, T.NullType):
                family = next((n for n, ts in _FAMILY.items() if isinstance(f.dataType, ts)), f.dataType.simpleString())
                kinds.setdefault(f.name, set()).add(family)
    target = {}
    for name, families in kinds.items():
        if families <= {"integer", "float"}:
            target[name] = "bigint" if families == {"integer"} else "double"
        elif len(families) > 1:
            target[name] = "string"
    cast = [df.select(*[F.col(c).cast(target[c]).alias(c) if c in target else F.col(c) for c in df.columns]) for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def two_providers(archive: DataFrame, live: DataFrame, season: str | None = None) -> DataFrame:
    """Both providers' rows with their origin; archive rows count as wholly attributed."""
    if season is not None:
        archive, live = (df.filter(F.col("season") == season) for df in (archive, live))
    return union_widened([
        archive.withColumn("source_provider", F.lit("archive")).withColumn("attribution_complete", F.lit(True)),
        live.withColumn("source_provider", F.lit("live")),
    ])


def pair_sides(home: DataFrame, away: DataFrame, key: Sequence[str]) -> DataFrame:
    """Full outer pairing of home and away rows; the key is taken from whichever side has it."""
    return home.join(away, list(key), "full")


def missing_keys(expected: DataFrame, present: DataFrame, key: Sequence[str]) -> DataFrame:
    return expected.join(present.select(*key).distinct(), list(key), "left_anti")


def restrict_to(df: DataFrame, wanted: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.join(wanted.select(*key), list(key), "left_semi")


def squad_changes(before: Column, sold: Column, bought: Column, after: Column) -> Column:
    """Does (before - sold) + bought equal the squad after, as sets?"""
    expected = F.array_union(F.array_except(before, sold), bought)
    return F.array_sort(expected) == F.array_sort(F.array_distinct(after))


def team_calendar(fixtures: DataFrame) -> DataFrame:
    """Each team's fixtures, home and away in one list."""
    keep = ["season", "fixture", "kickoff"]
    home = fixtures.select(*keep, F.col("home_team").alias("team"), F.col("away_team").alias("opponent"), F.lit(True).alias("is_home"))
    away = fixtures.select(*keep, F.col("away_team").alias("team"), F.col("home_team").alias("opponent"), F.lit(False).alias("is_home"))
    return home.unionByName(away)


def roster(fixtures: DataFrame, players: DataFrame) -> DataFrame:
    """Players of either side of each fixture: two equi-joins instead of one on ``home or away``."""
    return team_calendar(fixtures).join(players, ["season", "team"])


def home_or_away(team: Column) -> tuple[Column, Column]:
    """(was_home, opponent) of a deadline-resolved team in a fixture; unknown teams stay unknown."""
    home = F.when(team.isNotNull(), F.col("team_h") == team)
    return home, F.when(home, F.col("team_a")).when(~home, F.col("team_h"))


def settled_rounds(events: DataFrame) -> DataFrame:
    return events.filter(F.col("finished") & F.col("data_checked"))


def next_deadline(events: DataFrame, now: Column, deadline: str = "deadline_time") -> DataFrame:
    return events.filter(F.col(deadline) > now).agg(F.min(deadline).alias("next_deadline"))


def capture_windows(deadlines: DataFrame, deadline: str = "deadline") -> DataFrame:
    """The windows [start, end) before each deadline."""
    hours = F.array(*[F.lit(h) for h in CAPTURE_HOURS])
    half = CAPTURE_WIDTH_MINUTES // 2
    rows = deadlines.select(deadline).distinct().select("*", F.explode(hours).alias("hours_before"))
    at = F.timestamp_add("HOUR", -F.col("hours_before"), F.col(deadline))
    return rows.select(
        deadline, "hours_before", F.timestamp_add("MINUTE", F.lit(-half), at).alias("window_start"),
        F.timestamp_add("MINUTE", F.lit(half), at).alias("window_end"),
    )


def in_windows(instants: DataFrame, windows: DataFrame, at: str) -> DataFrame:
    """Interval join on the hours a window touches: an equi-join with the exact bounds checked after."""
    first, last = (F.date_trunc("hour", c).cast("timestamp_ntz") for c in ("window_start", "window_end"))
    touched = windows.withColumn("_hour", F.explode(F.sequence(first, last, F.expr("INTERVAL 1 HOUR"))))
    tagged = instants.withColumn("_hour", F.date_trunc("hour", at).cast("timestamp_ntz"))
    inside = (F.col(at) >= F.col("window_start")) & (F.col(at) < F.col("window_end"))
    return tagged.join(touched, "_hour").filter(inside).drop("_hour")


def capture_decisions(attempts: DataFrame, windows: DataFrame, at: str = "run_ts", outcome: str = "outcome") -> DataFrame:
    """Per window: attempts so far and whether another capture should be made while it is open."""
    seen = in_windows(attempts, windows, at).groupBy("deadline", "hours_before").agg(
        F.count("*").alias("attempts"),
        F.count_if(F.col(outcome).isin("written", "skipped_unchanged")).alias("succeeded"),
    )
    joined = windows.join(seen, ["deadline", "hours_before"], "left").fillna(0, ["attempts", "succeeded"])
    return joined.withColumn(
        "decision", F.when(F.col("succeeded") > 0, "skipped_already_captured")
        .when(F.col("attempts") >= CAPTURE_ATTEMPTS, "skipped_max_attempts_exhausted").otherwise("open"),
    )
