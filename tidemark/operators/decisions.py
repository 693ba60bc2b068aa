"""Analytics over decision logs: transfers, holds, round trips, ledgers and arm comparisons.

A decision record has one row per (season, arm, gameweek) with arrays ``transfers_in``, ``transfers_out``
and ``squad_element_ids``. An element has at most one buy and one sell per gameweek, so a window over
(season, arm, element) is as long as the calendar, whatever the number of decisions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

ARM = ("season", "arm")
CHURN_LIMITS = (1, 2, 3, 6)


def is_free_build() -> Column:
    """Nothing sold and the whole squad bought: the opening of a season, not a transfer."""
    bought = F.size("transfers_in")
    return (F.size("transfers_out") == 0) & (bought > 0) & (bought == F.size("squad_element_ids"))


def free_builds(records: DataFrame, key: Sequence[str] = ARM) -> DataFrame:
    """The opening squads that holds and churn leave out: one row per gameweek, with the number of elements bought."""
    return records.filter(is_free_build()).select(*key, "gameweek", F.size("transfers_in").alias("count"))


def transfer_events(records: DataFrame, key: Sequence[str] = ARM) -> DataFrame:
    """One row per bought or sold element; ``free_build`` marks opening squads, ``is_in`` buys."""
    moves = F.concat(
        F.transform("transfers_out", lambda e: F.struct(F.lit(0).alias("is_in"), e.cast("bigint").alias("element"))),
        F.transform("transfers_in", lambda e: F.struct(F.lit(1).alias("is_in"), e.cast("bigint").alias("element"))),
    )
    return records.select(*key, "gameweek", is_free_build().alias("free_build"), F.inline(moves))


def _paired(records: DataFrame, key: Sequence[str]) -> DataFrame:
    """Events of an element in order (a gameweek's sale before its purchase) with the event before."""
    events = transfer_events(records, key)
    w = W.partitionBy(*key, "element").orderBy("gameweek", "is_in")
    opened = F.max(F.col("free_build").cast("int")).over(W.partitionBy(*key, "element"))
    marked = events.withColumn("_opened", opened).filter(~F.col("free_build"))
    return (
        marked.withColumn("_kind", F.lag("is_in").over(w)).withColumn("_week", F.lag("gameweek").over(w))
        .withColumn("_last", F.lead("is_in").over(w).isNull())
    )


def holds(records: DataFrame, key: Sequence[str] = ARM) -> DataFrame:
    """Per event: completed hold length of a sale, and flags for purchases, censored and opening-squad sales."""
    paired = _paired(records, key)
    sale = F.col("is_in") == 0
    closes = sale & (F.col("_kind") == 1)
    return paired.select(
        *key, "element", "gameweek",
        F.when(closes, F.col("gameweek") - F.col("_week")).alias("hold"),
        (F.col("is_in") == 1).alias("is_purchase"),
        ((F.col("is_in") == 1) & F.col("_last")).alias("is_censored"),
        (sale & ~F.coalesce(closes, F.lit(False)) & (F.col("_opened") == 1)).alias("is_initial_sale"),
        F.when((F.col("is_in") == 1) & (F.col("_kind") == 0), F.col("gameweek") - F.col("_week")).alias("round_trip"),
    )


def distribution(value: str, prefix: str = "") -> list[Column]:
    """Count, mean, median and inclusive quartiles; for small integer domains (weeks)."""
    v = F.col(value)
    return [
        F.count(v).alias(f"{prefix}count"), F.avg(v).alias(f"{prefix}mean"), F.percentile(v, 0.5).alias(f"{prefix}median"),
        F.percentile(v, 0.25).alias(f"{prefix}q1"), F.percentile(v, 0.75).alias(f"{prefix}q3"),
    ]


def hold_lengths(records: DataFrame, key: Sequence[str] = ARM) -> DataFrame:
    return holds(records, key).groupBy(*key).agg(
        *distribution("hold"), F.count_if("is_censored").alias("censored_count"),
        F.count_if("is_initial_sale").alias("initial_squad_sales"),
    )


def churn(records: DataFrame, key: Sequence[str] = ARM) -> DataFrame:
    """Share of all purchases sold again within fewer than 1, 2, 3 and 6 gameweeks."""
    counts = holds(records, key).groupBy(*key).agg(
        F.count_if("is_purchase").alias("total_purchases"), F.count_if("is_censored").alias("censored_count"),
        *[F.count_if(F.col("hold") < n).alias(f"_{n}") for n in CHURN_LIMITS],
    )
    share = [F.when(F.col("total_purchases") > 0, F.col(f"_{n}") / F.col("total_purchases")).alias(f"lt_{n}") for n in CHURN_LIMITS]
    return counts.select(*key, "total_purchases", "censored_count", *share)


def transfer_counts(records: DataFrame, key: Sequence[str] = ARM) -> DataFrame:
    return records.select(*key, "gameweek", F.size("transfers_out").alias("n_transfers"), "hit_points")


def round_trips(records: DataFrame, key: Sequence[str] = ARM) -> DataFrame:
    return holds(records, key).groupBy(*key).agg(*distribution("round_trip"))


def compare_arms(results: DataFrame, first: str, second: str, points: str = "points") -> DataFrame:
    """Season totals of two arms side by side and whether the first is ahead."""
    totals = results.groupBy("season").agg(
        F.sum(F.when(F.col("arm") == first, F.col(points))).alias("first_total"),
        F.sum(F.when(F.col("arm") == second, F.col(points))).alias("second_total"),
        F.count_if(F.col("arm") == first).alias("first_rounds"), F.count_if(F.col("arm") == second).alias("second_rounds"),
    )
    return totals.withColumn("difference", F.col("first_total") - F.col("second_total")).withColumn(
        "first_ahead", F.col("first_total") > F.col("second_total")
    )


def across_seasons(comparison: DataFrame) -> DataFrame:
    return comparison.agg(
        F.count("*").alias("n_seasons"), F.count_if("first_ahead").alias("seasons_first_ahead"),
        F.avg("first_total").alias("first_mean"), F.avg("second_total").alias("second_mean"),
    )


def season_summary(results: DataFrame, key: Sequence[str], points: str = "points") -> DataFrame:
    """Total, mean, median, spread, range, percentiles and zero rounds; a group is one season of rounds."""
    v = F.col(points)
    levels = {"median": 0.5, "p5": 0.05, "p25": 0.25, "p75": 0.75, "p95": 0.95}
    return results.groupBy(*key).agg(
        F.count(v).alias("n_rounds"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.count_if(v == 0).alias("zero_rounds"),
        *[F.percentile(v, q).alias(name) for name, q in levels.items()],
    )


def sweep_outcome(parts: DataFrame, key: Sequence[str], outcome: str = "outcome", error: str = "error") -> DataFrame:
    """One outcome per sweep: written beats failed beats unchanged; error texts joined in order."""
    weight = F.when(F.col(outcome) == "written", 3).when(F.col(outcome) == "failed", 2).otherwise(1)
    best = F.max(weight)
    return parts.groupBy(*key).agg(
        F.when(best == 3, "written").when(best == 2, "failed").otherwise("unchanged").alias("outcome"),
        F.array_join(F.array_sort(F.collect_set(error)), "; ").alias("errors"),
    )


# -- transfers and money -----------------------------------------------------------------------------

def sell_price(purchase: Column, current: Column) -> Column:
    """Losses in full, half of a gain rounded down."""
    gain = F.floor((current - purchase) / F.lit(2)).cast("int")
    return F.when(current <= purchase, current).otherwise(purchase + gain)


def hit_points(n_transfers: Column, free: Column, hit_cost: int = 4) -> Column:
    return -F.greatest(F.lit(0), n_transfers - free) * hit_cost


def free_transfer_bank(transfers: DataFrame, key: Sequence[str] = ARM, start: int = 1, per_round: int = 1,
                       cap: int = 5, top_ups: Mapping[int, int] | None = None) -> DataFrame:
    """Free transfers standing before each round: spent, advanced by one, capped, and topped up in some rounds.

    The clamped recursion folds over one season's rounds of an arm, an array no longer than the calendar.
    """
    step = F.struct(F.col("round").cast("int").alias("round"), F.col("n_transfers").cast("int").alias("n_transfers"))
    one = transfers.groupBy(*key).agg(F.array_sort(F.collect_list(step)).alias("steps"))

    def spend(state: Column, s: Column) -> Column:
        left = F.greatest(F.lit(0), state["free"] - s["n_transfers"])
        following = F.least(left + per_round, F.lit(cap))
        for at, least in (top_ups or {}).items():
            following = F.when(s["round"] + 1 == at, F.greatest(following, F.lit(least))).otherwise(following)
        row = F.struct(s["round"].alias("round"), s["n_transfers"].alias("n_transfers"), state["free"].alias("free"))
        return F.struct(following.cast("int").alias("free"), F.concat(state["out"], F.array(row)).alias("out"))

    empty = F.struct(
        F.lit(start).cast("int").alias("free"),
        F.expr("CAST(array() AS ARRAY<STRUCT<round: INT, n_transfers: INT, free: INT>>)").alias("out"),
    )
    folded = F.aggregate("steps", empty, spend, lambda s: s["out"])
    return one.select(*key, F.inline(folded)).withColumn(
        "hit_points", hit_points(F.col("n_transfers"), F.col("free"))
    )


def cash_ledger(moves: DataFrame, opening: int, key: Sequence[str] = ARM) -> DataFrame:
    """Money in the bank after each gameweek; ``overspent`` marks balances below zero.

    ``moves``: (key, gameweek, element, is_in, price). A sale is paid by the price of the purchase it
    closes; a sale of something never bought counts at its current price.
    """
    w = W.partitionBy(*key, "element").orderBy("gameweek", "is_in").rowsBetween(W.unboundedPreceding, -1)
    bought = F.last(F.when(F.col("is_in") == 1, F.col("price")), ignorenulls=True).over(w)
    delta = F.when(F.col("is_in") == 1, -F.col("price")).otherwise(
        sell_price(F.coalesce(bought, F.col("price")), F.col("price"))
    )
    weeks = moves.withColumn("_d", delta).groupBy(*key, "gameweek").agg(F.sum("_d").alias("delta"))
    bank = F.sum("delta").over(W.partitionBy(*key).orderBy("gameweek")) + opening
    return weeks.withColumn("bank", bank).withColumn("overspent", F.col("bank") < 0)


def continuity_checks(records: DataFrame, key: Sequence[str] = ARM) -> DataFrame:
    """Rows whose transfers do not turn the squad before into the squad after, and why."""
    before = F.lag("squad_element_ids").over(W.partitionBy(*key).orderBy("gameweek"))
    rows = records.withColumn("_before", before).filter(F.col("_before").isNotNull())
    expected = F.array_union(F.array_except("_before", "transfers_out"), "transfers_in")
    return rows.select(
        *key, "gameweek",
        F.size(F.array_except("transfers_out", "_before")).alias("sold_not_held"),
        F.size(F.array_except("transfers_in", "squad_element_ids")).alias("bought_not_in_squad"),
        (F.array_sort(expected) != F.array_sort(F.array_distinct("squad_element_ids"))).alias("squad_differs"),
    )
