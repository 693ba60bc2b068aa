"""Ordered passes (running totals, lags, percentiles) that stay split when one key holds most rows.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Here rows are range-partitioned on
``(keys, order)`` first, so a hot key is spread over many slices; the pass runs inside each slice and a
small table with one row per (key, slice) carries the state from slice to slice. The slices are written
to shared storage once, because range bounds are sampled and must not move when a task is rerun.

Tables already rolled up to a bounded grain (rounds of a season, days of a calendar) use plain windows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.session import settle

SLICE = "_slice"


def slices(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    placed = df.repartitionByRange(*[F.col(c) for c in [*keys, *order]])
    return settle(placed.withColumn(SLICE, F.spark_partition_id()))


def _with_carry(rows: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on the keys, a NULL key being a key like any other."""
    other = carried.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *[c for c in carried.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    return rows.join(other, same).drop(*[f"_key{i}" for i in range(len(keys))])


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column | str, out: str,
    *, before: bool = False,
) -> DataFrame:
    """Running sum of ``value`` per key; ``before`` leaves the current row out. ``order`` must be unique."""
    value = F.col(value) if isinstance(value, str) else value
    cut = slices(df.withColumn("_v", value), keys, order)
    inside = W.partitionBy(SLICE, *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    across = W.partitionBy(*(keys or [F.lit(0)])).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    carried = (
        cut.groupBy(SLICE, *keys).agg(F.sum("_v").alias("_t"))
        .withColumn("_carry", F.coalesce(F.sum("_t").over(across), F.lit(0)))
        .drop("_t")
    )
    summed = cut.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return (
        _with_carry(summed, carried, [SLICE, *keys])
        .withColumn(out, F.col("_in") + F.col("_carry"))
        .drop("_in", "_carry", "_v", SLICE)
    )


def row_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Zero-based position of each row within its key."""
    return running_total(df, keys, order, F.lit(1).cast("bigint"), out, before=True)


def previous_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str
) -> DataFrame:
    """``lag(value)`` per key."""
    cut = slices(df, keys, order)
    inside = W.partitionBy(SLICE, *keys).orderBy(*order)
    across = W.partitionBy(*(keys or [F.lit(0)])).orderBy(SLICE)
    carried = (
        cut.groupBy(SLICE, *keys).agg(F.max_by(value, F.struct(*order)).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(across))
        .drop("_last")
    )
    marked = cut.withColumn("_n", F.row_number().over(inside)).withColumn("_in", F.lag(value).over(inside))
    return (
        _with_carry(marked, carried, [SLICE, *keys])
        .withColumn(out, F.when(F.col("_n") == 1, F.col("_carry")).otherwise(F.col("_in")))
        .drop("_n", "_in", "_carry", SLICE)
    )


def trailing_mean_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], means: Mapping[str, str], rows: int,
    chunk: int = 100_000,
) -> DataFrame:
    """Means of the ``rows`` rows before each row of a key, for keys of any size; ``means`` is {out: column}.

    A key is cut into chunks by row position; the last rows of a chunk are repeated as context of the next.
    """
    chunk = max(chunk, rows)
    placed = row_positions(df, keys, order, "_pos").withColumn("_chunk", F.floor(F.col("_pos") / chunk))
    tail = F.col("_pos") % chunk >= chunk - rows
    copies = F.when(tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = placed.withColumn("_ahead", F.explode(copies)).withColumn("_chunk", F.col("_chunk") + F.col("_ahead"))
    w = W.partitionBy(*keys, "_chunk").orderBy("_pos").rowsBetween(-rows, -1)
    trailed = spread.select("*", *[F.avg(F.col(v).cast("double")).over(w).alias(out) for out, v in means.items()])
    return trailed.filter("_ahead = 0").drop("_ahead", "_chunk", "_pos")


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """Exact linear-interpolated percentiles per key, one column per probability.

    Equal values are counted before the shuffle; the built-in ``percentile`` would hold every distinct
    value of a key in one task.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    placed = running_total(counted, keys, [value], "_c", "_before", before=True)
    totals = df.groupBy(*keys).agg(F.count(value).alias("_n"))
    if keys:
        placed = _with_carry(placed, totals, list(keys))
    else:
        placed = placed.withColumn("_n", F.lit(totals.first()["_n"]))

    picks = []
    for prob, name in zip(probs, names):
        at = F.lit(float(prob)) * (F.col("_n") - 1)
        for side, row in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            held = (F.col("_before") <= row) & (row < F.col("_before") + F.col("_c"))
            picks.append(F.max(F.when(held, F.col(value))).alias(f"_{side}_{name}"))
    picked = placed.groupBy(*keys, "_n").agg(*picks)
    outs = []
    for prob, name in zip(probs, names):
        at = F.lit(float(prob)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outs.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return picked.select(*keys, *outs)
