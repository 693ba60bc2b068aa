"""Design rows and sums for more columns than a table or an aggregate should have.

A category of any number of levels becomes (index, value) entries of a row; the index of a level is a row of a table, joined
and never collected. Wide sums of squares and products are kept as one packed triangle per task instead of an aggregate
column per pair, which would leave compiled code at a few dozen features.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.operators.ordered import row_positions
from tidemark.session import SMALL_BYTES, TidemarkError, measured_bytes, settle

# Packed numbers that a task holds before it passes its sums on.
HELD = 4_000_000


def scales_of(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of every column in one pass; near-constant columns scale by one."""
    if not columns:
        return {}
    aggs = [f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = df.agg(*aggs).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] if (row[f"s_{c}"] or 0.0) > 1e-8 else 1.0) for c in columns}


# -- sparse rows -------------------------------------------------------------------------------------

def column_index(df: DataFrame, numeric: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """Every column of the design: (index, name, level), the intercept first, then numbers, then levels in sorted order.

    A NULL category has no column.
    """
    fixed = df.sparkSession.createDataFrame(
        [(i, c, None) for i, c in enumerate(["intercept", *numeric])], "index long, name string, level string")
    if not categories:
        return fixed
    named = F.explode(F.array(*[F.struct(F.lit(i).alias("_at"), F.lit(c).alias("name"), F.col(c).cast("string").alias("level"))
                                for i, c in enumerate(categories)]))
    levels = df.select(named.alias("_n")).select("_n.*").filter(F.col("level").isNotNull()).distinct()
    placed = row_positions(levels, [], ["_at", "level"], "_pos")
    return fixed.unionByName(placed.select((F.col("_pos") + 1 + len(numeric)).alias("index"), "name", "level"))


def sparse_design(df: DataFrame, numeric: Sequence[str], categories: Sequence[str], indices: str = "indices",
                  values: str = "values") -> tuple[DataFrame, DataFrame]:
    """The rows with two arrays, indices and values of their non-zero design columns by rising index, and the table of columns.

    Numbers are standardised. A NULL number or category has no entry: it stands at the mean, or at no level. Levels join as
    texts. Each category is measured for itself: its levels are broadcast while they are small, so that a category of three
    levels never deals the rows to three tasks; beyond that the join shuffles, with skewed levels split.
    """
    clash = {indices, values} & set(df.columns)
    if clash:
        raise TidemarkError(f"columns {sorted(clash)} are taken")
    columns = settle(column_index(df, numeric, categories))
    scales = scales_of(df, numeric)
    entries = [F.struct(F.lit(0).cast("long").alias("i"), F.lit(1.0).alias("v"))]
    for i, c in enumerate(numeric, 1):
        mean, deviation = scales[c]
        z = (F.col(c).cast("double") - F.lit(mean)) / deviation
        entries.append(F.when(z.isNotNull(), F.struct(F.lit(i).cast("long").alias("i"), z.alias("v"))))
    out = df
    for j, c in enumerate(categories):
        side = columns.filter((F.col("name") == c) & F.col("level").isNotNull()).select(
            F.col("level").alias(f"_level{j}"), F.col("index").alias(f"_index{j}"))
        placed = F.broadcast(side) if measured_bytes(side) <= SMALL_BYTES else side
        out = out.join(placed, F.col(c).cast("string") == F.col(f"_level{j}"), "left").drop(f"_level{j}")
        entries.append(F.when(F.col(f"_index{j}").isNotNull(), F.struct(F.col(f"_index{j}").alias("i"), F.lit(1.0).alias("v"))))
    rows = out.withColumn("_entries", F.array_compact(F.array(*entries)))
    return rows.withColumns({indices: F.col("_entries.i"), values: F.col("_entries.v")}).drop(
        "_entries", *[f"_index{j}" for j in range(len(categories))]), columns


def sparse_scores(design: DataFrame, key: Sequence[str], coefficients: DataFrame, out: str = "score", indices: str = "indices",
                  values: str = "values") -> DataFrame:
    """Sum of value times coefficient per row key; ``coefficients`` is (index, coefficient) of any length, absent ones are zero."""
    pairs = design.select(*key, F.explode(F.arrays_zip(F.col(indices).alias("i"), F.col(values).alias("v"))).alias("_e"))
    held = pairs.select(*key, F.col("_e.i").alias("index"), F.col("_e.v").alias("_v"))
    joined = held.join(coefficients.select("index", "coefficient"), "index", "left")
    return joined.groupBy(*key).agg(F.sum(F.col("_v") * F.coalesce("coefficient", F.lit(0.0))).alias(out))


def sparse_sums(design: DataFrame, y: str, indices: str = "indices", values: str = "values") -> DataFrame:
    """The non-zero normal equations as a table: (i, j, total) for i <= j, and j NULL for the sums with ``y``.

    A row gives one entry per pair of its own few columns, combined on the map side. Its ``y`` is an entry without an index
    behind the others, so that the design, which may come from a join of all rows, is read once.
    """
    e = F.arrays_zip(F.col(indices).alias("i"), F.col(values).alias("v"))
    last = F.array(F.struct(F.lit(None).cast("long").alias("i"), F.col(y).cast("double").alias("v")))
    left = design.select(F.concat(e, last).alias("_all"), F.explode(e).alias("_l"))
    pairs = left.select("_l", F.explode("_all").alias("_r")).filter("_r.i IS NULL OR _r.i >= _l.i").select(
        F.col("_l.i").alias("i"), F.col("_r.i").alias("j"), (F.col("_l.v") * F.col("_r.v")).alias("v"))
    return pairs.groupBy("i", "j").agg(F.sum("v").alias("total"))


# -- packed sums -------------------------------------------------------------------------------------

def packed_sums(df: DataFrame, x: Sequence[str], y: str, rank: str | None = None) -> DataFrame:
    """(rank, at, total): the number of rows at 0, then the upper triangle of X'X row by row, then X'y.

    A NULL counts as zero in its products, as it does in a sum of products. Rows of a NULL rank take no part.
    """
    p = len(x)
    upper = np.triu_indices(p)
    size = 1 + len(upper[0]) + p
    wanted = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate([*x, y])]
    kind = dict(df.dtypes)[rank] if rank else "int"
    ranked = (F.col(rank) if rank else F.lit(0)).alias("rank")
    rows = df.select(ranked, *wanted).filter(F.col("rank").isNotNull())

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame({"rank": list(held), "sums": [s.tolist() for s in held.values()]})

        for pdf in batches:
            values = pdf.iloc[:, 1:].to_numpy(dtype=float)
            for r, at in pdf.groupby("rank").indices.items():
                m, v = values[at, :p], values[at, p]
                s = held.setdefault(r, np.zeros(size))
                s[0] += len(at)
                s[1:-p] += (m.T @ m)[upper]
                s[-p:] += m.T @ v
            if len(held) * size > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    sums = rows.mapInPandas(partial, f"rank {kind}, sums array<double>")
    return sums.select("rank", F.posexplode("sums").alias("at", "v")).groupBy("rank", "at").agg(F.sum("v").alias("total"))


def packed_folds(sums: DataFrame) -> DataFrame:
    """Per rank the packed sums of strictly earlier ranks, as one array; the first rank has none."""
    before = W.partitionBy("at").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)  # a row per round of the calendar
    running = sums.withColumn("total", F.sum("total").over(before)).filter(F.col("total").isNotNull())
    return running.groupBy("rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "total"))), lambda e: e["total"]).alias("sums"))


def solve_packed(sums: Sequence[float], p: int, l2: float) -> np.ndarray:
    sums = np.asarray(sums, dtype=float)
    gram = np.zeros((p, p))
    gram[np.triu_indices(p)] = sums[1:-p]
    gram = np.triu(gram) + np.triu(gram, 1).T
    return np.linalg.solve(gram + l2 * np.eye(p), sums[-p:])
