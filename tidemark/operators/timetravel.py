"""Bitemporal reads over an observation log.

``observed_at`` is when a row was learned and is compared inclusively; a valid time is when it became
true and is compared strictly. Every read needs a timezone-aware cut-off.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tidemark.functions.dates import ISO_Z
from tidemark.operators.ordered import running_total
from tidemark.session import SMALL_BYTES, TidemarkError, measured_bytes, settle


def instant(name: str, cutoff: datetime) -> datetime:
    if cutoff.tzinfo is None:
        raise TidemarkError(f"{name} must be timezone-aware, got {cutoff!r}")
    return cutoff.astimezone(timezone.utc)


def instant_column(cutoff: datetime, dtype: T.DataType) -> Column:
    """A literal of the column's own type, so that the comparison reaches the Parquet scan."""
    if isinstance(dtype, T.TimestampNTZType):
        return naive_literal(cutoff)
    return F.lit(cutoff).cast(dtype)


def naive_literal(moment: datetime) -> Column:
    """The clock reading itself; a Python datetime literal would be moved by the zones of Python and the session."""
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def _newest(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    if not key:
        return df.orderBy(*order).limit(1)
    # A row_number filter of one lets Spark keep one row per key in each map task before the shuffle.
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def known_by(df: DataFrame, cutoff: datetime, observed: str = "observed_at") -> DataFrame:
    cutoff = instant("cutoff", cutoff)
    return df.filter(F.col(observed) <= instant_column(cutoff, df.schema[observed].dataType))


def as_of(
    df: DataFrame, key: Sequence[str], cutoff: datetime,
    observed: str = "observed_at", batch: str = "batch_id",
) -> DataFrame:
    """State as it was known at the cut-off: the newest row of each key, ties to the higher batch."""
    return _newest(known_by(df, cutoff, observed), key, [F.desc(observed), F.desc(batch)])


def effective_at(
    df: DataFrame, key: Sequence[str], cutoff: datetime, valid: str, fmt: str | None = None,
    deal: Callable[[DataFrame], DataFrame] = lambda rows: rows, observed: str = "observed_at", batch: str = "batch_id",
) -> DataFrame:
    """State as it was true before the cut-off, by a declared valid-time column; NULL times drop out.

    ``deal`` spreads the rows that qualify by their key; without it Spark does.
    """
    cutoff = instant("cutoff", cutoff)
    if fmt == ISO_Z:
        # Texts of this form sort like their times, so the bound on the text prunes Parquet row groups.
        whole = cutoff.replace(microsecond=0)
        bound = whole if whole == cutoff else whole + timedelta(seconds=1)
        df = df.filter(F.col(valid) < bound.strftime("%Y-%m-%dT%H:%M:%SZ"))
    when = F.to_timestamp_ntz(F.col(valid), F.lit(fmt)) if fmt else F.col(valid)
    timed = df.withColumn("_valid", when)
    true = timed.filter(F.col("_valid") < instant_column(cutoff, timed.schema["_valid"].dataType))
    return _newest(deal(true), key, [F.desc("_valid"), F.desc(observed), F.desc(batch)]).drop("_valid")


def observations(df: DataFrame, until: datetime, observed: str = "observed_at", ordered: bool = False) -> DataFrame:
    """Every row known at the cut-off, not collapsed; ``ordered`` sorts by all columns, nulls last."""
    known = known_by(df, until, observed)
    return known.orderBy(*[F.asc_nulls_last(c) for c in known.columns]) if ordered else known


def latest(df: DataFrame, key: Sequence[str], observed: str = "observed_at", batch: str = "batch_id") -> DataFrame:
    return as_of(df, key, datetime.now(timezone.utc), observed, batch)


def _clock_seconds(c: Column, kind: T.DataType) -> Column:
    """Whole seconds of a clock reading, growing with time whatever the session's zone."""
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_date(c.cast("date")).cast("bigint") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return F.unix_seconds(c.cast("timestamp"))


def _calendar(deadlines: DataFrame, deadline: str, kind: T.DataType) -> tuple[DataFrame, int, int, int]:
    """Deadlines on an even grid with a bucket per deadline: (_b, _before, _marks), the first second, the width and their number.

    _before counts the deadlines of earlier buckets, _marks holds those of the bucket in order, so a time finds its place among
    all deadlines by an equal bucket and a look at one or two marks.
    """
    mark = F.struct(F.col(deadline).cast(kind).alias("at"), F.col(deadline).alias("deadline"))
    dates = settle(deadlines.filter(F.col(deadline).isNotNull()).select(mark.alias("_mark")).distinct())
    second = _clock_seconds(F.col("_mark.at"), kind)
    low, high, n = dates.agg(F.min(second), F.max(second), F.count("*")).first()
    if not n:
        return dates.select(F.lit(0).alias("_b"), F.lit(0).alias("_before"), F.array("_mark").alias("_marks")), 0, 1, 0
    width = (high - low) // n + 1
    filled = dates.groupBy(F.floor((second - low) / width).cast("bigint").alias("_b")).agg(F.array_sort(F.collect_list("_mark")).alias("_marks"))
    grid = deadlines.sparkSession.range(n).withColumnRenamed("id", "_b").join(filled, "_b", "left")
    size = F.coalesce(F.size("_marks"), F.lit(0)).cast("bigint")
    return running_total(grid, [], ["_b"], size, "_before", before=True), low, width, n


def as_of_deadlines(
    df: DataFrame, key: Sequence[str], deadlines: DataFrame, deadline: str = "deadline",
    observed: str = "observed_at", batch: str = "batch_id",
) -> DataFrame:
    """State of every key at every deadline (a backward as-of join without a range join), for any number of deadlines.

    Rows are first reduced to the newest one per (key, interval between deadlines); each survivor is
    then valid until the key's next survivor, so a key's window holds at most one row per deadline.
    Rows without a time are never known, and NULL deadlines take no part.
    """
    kind = df.schema[observed].dataType
    calendar, low, width, n = _calendar(deadlines, deadline, kind)
    calendar = settle(calendar)
    placed = F.broadcast if measured_bytes(calendar) <= SMALL_BYTES else (lambda side: side)
    bucket = F.floor((_clock_seconds(F.col(observed), kind) - low) / width)
    at = F.greatest(F.lit(0), F.least(F.lit(n - 1), bucket)).cast("bigint")
    tagged = (
        df.filter(F.col(observed).isNotNull()).withColumn("_b", at).join(placed(calendar), "_b")
        .withColumn("_i", (F.col("_before") + F.coalesce(F.size(F.filter("_marks", lambda m: m["at"] < F.col(observed))), F.lit(0))).cast("int"))
        .drop("_b", "_before", "_marks")
    )
    reduced = _newest(tagged, [*key, "_i"], [F.desc(observed), F.desc(batch)])
    until = F.coalesce(F.lead("_i").over(W.partitionBy(*key).orderBy("_i")), F.lit(n)) - 1
    spread = (
        reduced.withColumn("_until", until).filter(F.col("_until") >= F.col("_i"))
        .withColumn("_i", F.explode(F.sequence("_i", "_until")))
        .drop("_until")
    )
    numbered = calendar.select("_before", F.posexplode("_marks").alias("_p", "_mark")).select(
        (F.col("_before") + F.col("_p")).cast("int").alias("_i"), F.col("_mark.deadline").alias(deadline))
    return spread.join(placed(numbered), "_i").drop("_i")


def rows_before_round(df: DataFrame, n: int) -> DataFrame:
    return df.filter(F.col("round") < n)


def rows_for_round(df: DataFrame, n: int) -> DataFrame:
    return df.filter(F.col("round") == n)


def last_known_attributes(
    df: DataFrame, columns: Sequence[str], entity: str = "element", order: Sequence[str] = ("round", "fixture"),
) -> DataFrame:
    """Each entity's attributes on its last row, the row contents settling equal positions."""
    last = F.max(F.struct(*order, *columns)).alias("_last")
    return df.groupBy(entity).agg(last).select(entity, *[F.col(f"_last.{c}").alias(c) for c in columns])


def newest_pins(
    df: DataFrame, group: str = "group", value: str = "pinned_threshold",
    order: Sequence[str] = ("season", "round", "observed_at"),
) -> DataFrame:
    """The newest non-null pinned value of each group."""
    last = F.max(F.struct(*order, value)).alias("_last")
    return (
        df.filter(F.col(value).isNotNull()).groupBy(group).agg(last)
        .select(group, *[F.col(f"_last.{c}").alias(c) for c in [*order, value]])
    )


def decision_view(facts: DataFrame, season: str, n: int, attributes: Sequence[str], horizon: int = 1) -> dict[str, DataFrame]:
    """What may be seen when deciding round ``n``: history, current attributes and schedules, never outcomes."""
    rows = facts.filter(F.col("season") == season)
    schedule = ["round", "fixture", "kickoff_time", "team", "opponent_team", "was_home"]
    current = rows_for_round(rows, n)
    first = W.partitionBy("element").orderBy("fixture", *attributes)
    return {
        "history": rows_before_round(rows, n),
        "attributes": current.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1")
        .select("element", "fixture", *attributes),
        "fixtures": current.select(*schedule).distinct(),
        "forward": rows.filter(F.col("round").between(n + 1, n + horizon - 1)).select(*schedule).distinct(),
    }
