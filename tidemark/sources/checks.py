"""Checks of a stored dataset, batch by batch, with their findings as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import TidemarkError
from tidemark.sources.catalog import RESERVED, lookup
from tidemark.sources.store import ObservationStore

# Provenance that every row must carry.
PROVENANCE = ("observed_at", "content_hash", "batch_id")
_FIELDS = "STRUCT<fields: ARRAY<STRUCT<name: STRING, type: STRING>>>"
# Names that a schema has in JSON, by family; a type of several words or a nested one is told by its beginning.
_FAMILY = {
    "integer": ("byte", "short", "integer", "long"), "float": ("float", "double", "decimal"), "string": ("string",),
    "boolean": ("boolean",), "temporal": ("date", "timestamp_ntz", "timestamp", "interval day", "time("), "null": ("void",),
}


def _family(kind: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, starts in _FAMILY.items():
        hit = kind.isin(*starts)
        for start in starts:
            if start in ("decimal", "interval day", "time("):
                hit = hit | kind.startswith(start)
        found = F.when(hit, F.lit(name)).otherwise(found)
    return found


def batch_fields(store: ObservationStore, dataset: str) -> DataFrame:
    """One row per batch and data column, from the manifest alone: its type and family (NULL for a nested type)."""
    entries = store.provenance(dataset)
    if entries is None:
        raise TidemarkError(f"dataset {dataset} was never written")
    fields = F.from_json("fields", _FIELDS)["fields"]
    rows = entries.select("batch_id", "observed_at", F.inline(fields)).withColumnsRenamed({"name": "field", "type": "dtype"})
    return rows.filter(~F.col("field").isin(*RESERVED)).withColumn("family", _family(F.col("dtype")))


def schema_findings(store: ObservationStore, dataset: str) -> DataFrame:
    """Where a batch breaks its dataset's contract: batch_id, field, finding, dtype.

    ``missing``: a required field that the batch lacks; ``nested``: a required field of no accepted family; ``zoned``: a
    column with a time zone; ``drift``: a column (not counted as nested already) whose family differs from that of the
    earliest batch that has it, so that one read of both cannot give either's values.
    """
    minimum = list(lookup(dataset).minimum)
    rows = batch_fields(store, dataset)
    batches = store.provenance(dataset).select("batch_id")
    held = rows.groupBy("batch_id").agg(F.collect_list("field").alias("_held"))
    wanted = F.array(*[F.lit(c) for c in minimum]).cast("array<string>")
    absent = F.array_except(wanted, F.coalesce("_held", F.array().cast("array<string>")))
    missing = batches.join(held, "batch_id", "left").select("batch_id", F.explode(absent).alias("field"))
    first = rows.filter("family is not null").groupBy("field").agg(F.min_by("family", F.struct("observed_at", "batch_id")).alias("_first"))
    nested = F.col("family").isNull() & F.col("field").isin(*minimum)
    drift = rows.join(first, "field").filter(~F.col("family").eqNullSafe(F.col("_first")) & ~nested)
    parts = [
        missing.withColumn("finding", F.lit("missing")).withColumn("dtype", F.lit(None).cast("string")),
        rows.filter(nested).withColumn("finding", F.lit("nested")),
        rows.filter("dtype = 'timestamp'").withColumn("finding", F.lit("zoned")),
        drift.withColumn("finding", F.lit("drift")),
    ]
    return _united([p.select("batch_id", "field", "finding", "dtype") for p in parts])


def provenance_findings(store: ObservationStore, dataset: str) -> DataFrame:
    """Batches as the manifest has them against the rows themselves: one row per batch with what does not agree.

    Counts the rows, the rows without provenance and the distinct hashes of every batch in one pass over three columns; a
    batch that only one side knows has NULL on the other.
    """
    rows = store.scan(dataset)
    if rows is None:
        raise TidemarkError(f"dataset {dataset} was never written")
    absent = F.lit(False)
    for name in PROVENANCE:
        absent = absent | F.col(name).isNull()
    seen = rows.groupBy("batch_id").agg(
        F.count("*").alias("rows_found"), F.count_if(absent).alias("rows_without_provenance"),
        F.min("content_hash").alias("_low"), F.max("content_hash").alias("_high"))
    said = store.provenance(dataset).select("batch_id", F.col("n_rows").alias("rows_said"), F.col("content_hash").alias("_said"))
    both = said.join(seen, said["batch_id"].eqNullSafe(seen["batch_id"]), "full").select(
        F.coalesce(said["batch_id"], seen["batch_id"]).alias("batch_id"), "rows_said", "rows_found",
        F.coalesce("rows_without_provenance", F.lit(0)).alias("rows_without_provenance"),
        (F.col("_low").eqNullSafe(F.col("_high")) & F.col("_low").eqNullSafe(F.col("_said"))).alias("one_hash"))
    return both.withColumn("sound", F.col("rows_said").eqNullSafe(F.col("rows_found")) & (F.col("rows_without_provenance") == 0) & F.col("one_hash"))


def _united(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
