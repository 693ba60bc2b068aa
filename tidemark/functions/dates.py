"""Times: ISO text, days between instants, local clocks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ISO_Z = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def iso_to_ntz(text: Column) -> Column:
    """Naive UTC instant of ``2024-01-05T18:30:00Z``; other text fails the query under ANSI mode."""
    return F.to_timestamp_ntz(text, F.lit(ISO_Z))


def try_iso(text: Column) -> Column:
    """The same, NULL for text that does not parse."""
    return F.try_to_timestamp(text, F.lit(ISO_Z)).cast("timestamp_ntz")


def days_between(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("SECOND", earlier, later) / F.lit(86400.0)


def local_to_utc(local: Column, zone: str = "Europe/London") -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def season_start(season: Column) -> Column:
    """First of August of a season's first year."""
    return F.make_timestamp_ntz(F.substring(season, 1, 4).cast("int"), F.lit(8), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
