"""Data-quality checks: every one returns its findings as rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators.ordered import previous_value
from tidemark.operators.timetravel import as_of, instant_column

# Fixed value: rounds of a whole season.
SEASON_ROUNDS = 38


def repeated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys with more than one row."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def repeated_in_batch(df: DataFrame, key: Sequence[str], batch: str = "batch_id") -> DataFrame:
    return repeated_keys(df, [batch, *key])


def drop_repeated(df: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows without the keys that repeat, and the report of those keys."""
    report = repeated_keys(df, key)
    return df.join(report, list(key), "left_anti"), report


def leaked_rows(df: DataFrame, key: Sequence[str], cutoff: datetime, **names: str) -> DataFrame:
    """What a read before all data returns; anything is a leak."""
    return as_of(df, key, cutoff, **names).agg(F.count("*").alias("n_rows"))


def season_coverage(df: DataFrame, rounds: int = SEASON_ROUNDS) -> DataFrame:
    """Rounds present and missing per season; at most one value per round of the calendar is collected."""
    seen = df.groupBy("season").agg(F.array_sort(F.collect_set("round")).alias("_seen"))
    missing = F.array_except(F.sequence(F.lit(1), F.lit(rounds)), "_seen")
    found = F.size(F.filter("_seen", lambda r: r.between(1, rounds)))
    return seen.select("season", found.alias("n_present"), F.size(missing).alias("n_missing"),
                       F.array_join(missing.cast("array<string>"), ",").alias("missing_rounds"),
                       (found / F.lit(rounds)).alias("coverage"))


def heartbeat_gaps(runs: DataFrame, at: datetime, window: timedelta, job: str = "job", run: str = "run_ts") -> DataFrame:
    """Largest gap per job among those ending in the window, the time since the last run always among them.

    Runs are made distinct, then ordered in slices, so a job with most of the runs stays split; equal
    gaps report the earliest.
    """
    kind = runs.schema[run].dataType
    now, opens = instant_column(at, kind), instant_column(at - window, kind)
    distinct = runs.select(job, run).distinct().filter(F.col(run) <= now)
    stepped = previous_value(distinct, [job], [run], run, "_before")
    inner = stepped.filter(F.col("_before").isNotNull() & (F.col(run) >= opens)).select(
        job, F.col("_before").alias("gap_start"), F.col(run).alias("gap_end")
    )
    last = distinct.groupBy(job).agg(F.max(run).alias("gap_start")).withColumn("gap_end", now)
    gaps = inner.unionByName(last)
    micros = F.timestamp_diff("MICROSECOND", F.col("gap_start"), F.col("gap_end"))
    before = -F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz").cast(kind), F.col("gap_start"))
    best = gaps.groupBy(job).agg(F.max(F.struct(micros.alias("gap"), before.alias("o"), "gap_start", "gap_end")).alias("b"))
    counts = distinct.groupBy(job).agg(F.count("*").alias("run_count"), F.max(run).alias("last_run"))
    return counts.join(best, job).select(
        job, "run_count", "last_run", F.col("b.gap").alias("largest_gap_us"), F.col("b.gap_start").alias("gap_start"),
        F.col("b.gap_end").alias("gap_end"),
    )


def heartbeat_health(gaps: DataFrame, jobs: DataFrame, limit: timedelta, job: str = "job") -> DataFrame:
    """Healthy when the largest gap is within the limit; a job without runs is unhealthy."""
    limit_us = int(limit.total_seconds() * 1_000_000)
    joined = jobs.select(job).distinct().join(gaps, job, "left")
    return joined.select(job, F.coalesce("run_count", F.lit(0)).alias("run_count"), "largest_gap_us",
                         F.coalesce(F.col("largest_gap_us") <= limit_us, F.lit(False)).alias("healthy"))


def heartbeat_rows(results: DataFrame, job: str, run: Column) -> DataFrame:
    """One row per target of a run, whatever its outcome."""
    return results.select(F.lit(job).alias("job"), run.alias("run_ts"), "target_dataset", "outcome", "payload_hash", "n_rows", "error")


def season_mismatch(df: DataFrame, season: str) -> DataFrame:
    """Seasons in the payload other than the one asked for."""
    return df.filter(~F.col("season").eqNullSafe(season)).groupBy("season").agg(F.count("*").alias("n_rows"))


def unexpected_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(*allowed)).groupBy(column).agg(F.count("*").alias("n_rows"))
