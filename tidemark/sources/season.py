"""Reads of the appearance datasets: both providers as they were true at a time, and one season with its coverage."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.features import normalise_positions
from tidemark.operators.quality import SEASON_ROUNDS, season_coverage
from tidemark.operators.relational import two_providers
from tidemark.session import TidemarkError, settle
from tidemark.sources.catalog import ARCHIVE_STATS, LIVE_STATS
from tidemark.sources.store import ObservationStore

# What a season's slice cannot do without, and of these what must hold a value somewhere.
SEASON_COLUMNS = ("season", "round", "element", "name", "position", "team", "value", "selected", "total_points", "minutes", "fixture")
FILLED_COLUMNS = ("position", "team")


def stats_effective_at(store: ObservationStore, at: datetime, season: str | None = None) -> DataFrame:
    """Appearances of both providers that were true before ``at``, each dataset resolved by its own valid time.

    A season is filtered before the newest rows are taken: it is part of the key, so the filter reaches the scans. A
    provider without batches takes no part; without either the result is empty and has no columns.
    """
    found = []
    for dataset in (ARCHIVE_STATS, LIVE_STATS):
        rows = store.effective_at(dataset, at)
        found.append(rows if season is None or not rows.columns else rows.filter(F.col("season") == season))
    archive, live = found
    if not live.columns:
        return archive if not archive.columns else archive.withColumns(
            {"source_provider": F.lit("archive"), "attribution_complete": F.lit(True)})
    if not archive.columns:
        return live.withColumn("source_provider", F.lit("live"))
    return two_providers(archive, live)


@dataclass(frozen=True)
class SeasonSlice:
    """A season's appearances with normalised positions, and the rounds it has and lacks."""

    season: str
    rows: DataFrame
    coverage: DataFrame


def load_season(
    store: ObservationStore, season: str, *, until: datetime | None = None, rounds: int = SEASON_ROUNDS,
    dataset: str = ARCHIVE_STATS,
) -> SeasonSlice:
    """Every observed appearance of a season; refuses what no squad can be built from, and reports missing rounds.

    Refused: a dataset without rows, a season without rows (the error names those present), missing columns, and a
    position or team that is NULL in every row. One rollup of the season's rows to rounds decides, and gives the coverage.
    """
    every = store.observations(dataset, until or datetime.now(timezone.utc))
    if "season" not in every.columns:
        raise TidemarkError(f"dataset {dataset} is empty: nothing to load")
    rows = every.filter(F.col("season") == season)
    checked = [c for c in FILLED_COLUMNS if c in every.columns]
    kept = normalise_positions(rows) if "position" in every.columns else rows
    known = F.count_if(F.col("position") != "AM") if "position" in every.columns else F.count("*")
    by_round = settle(rows.groupBy("season", *[c for c in ("round",) if c in every.columns]).agg(
        F.count("*").alias("_n"), known.alias("_kept"), *[F.count(c).alias(c) for c in checked]))
    n, *filled = by_round.agg(F.sum("_n"), *[F.sum(c) for c in checked]).first()
    if not n:
        # A season is a year of the calendar, so their number is small.
        present = sorted(s for (s,) in every.select("season").distinct().collect() if s is not None)
        raise TidemarkError(f"season {season!r} has no rows in {dataset}; seasons present: {present}"
                            if present else f"dataset {dataset} is empty: nothing to load")
    missing = [c for c in SEASON_COLUMNS if c not in every.columns]
    if missing:
        raise TidemarkError(f"season {season!r} is missing required columns {missing}")
    void = [c for c, held in zip(checked, filled, strict=True) if not held]
    if void:
        raise TidemarkError(f"season {season!r}: columns {void} are NULL in every row")
    return SeasonSlice(season, kept, season_coverage(by_round.filter("_kept > 0"), rounds))
