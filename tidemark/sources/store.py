"""An append-only bitemporal store on Parquet.

Layout: ``<base>/<dataset>/date=YYYY-MM-DD/``. Batches are only ever appended; a correction is a later row.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.operators import timetravel as tt
from tidemark.sources.catalog import CATALOG, DERIVED_FIELDS, DERIVED_PREFIX, RESERVED, family, lookup, zoned_columns
from tidemark.sources.manifest import Manifest
from tidemark.session import TidemarkError, child_names, settle

# Rows of a task that takes the newest rows: as few while the tasks stay at UNSORTED at most, at most as many beyond.
FEW, UNSORTED, MANY = 100_000, 200, 4_000_000


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of a row as JSON with its columns in name order and NULLs kept."""
    row = F.struct(*[F.col(c) for c in sorted(columns)])
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def hash_parts(df: DataFrame) -> DataFrame:
    """Row count and two sums of row digests: independent of row and column order, duplicates counted."""
    digest = df.select(row_digest(df.columns).alias("d"))
    limb = F.lit((1 << 20) - 1)

    def limbs(name: str, start: int) -> list[Column]:
        # Sixty bits as three sums of twenty: whole numbers add faster than decimals, and overflow only beyond 2^43 rows.
        number = F.conv(F.substring("d", start, 15), 16, 10).cast("bigint")
        return [F.sum(F.shiftright(number, 20 * i).bitwiseAND(limb)).alias(f"{name}{i}") for i in range(3)]

    def joined(name: str) -> Column:
        whole = [F.col(f"{name}{i}").cast("decimal(19,0)") * F.lit(1 << 20 * i).cast("decimal(13,0)") for i in range(3)]
        return (whole[0] + whole[1] + whole[2]).cast("decimal(38,0)").alias(name)

    sums = digest.agg(F.count("*").alias("n_rows"), *limbs("low", 1), *limbs("high", 16))
    return sums.select("n_rows", joined("low"), joined("high"))


def content_hash(df: DataFrame) -> tuple[str, int]:
    """(hash, rows) of a table's contents from one distributed pass."""
    import hashlib

    n, low, high = hash_parts(df).first()
    text = f"{sorted(df.columns)}:{n}:{low or 0}:{high or 0}"
    return hashlib.sha256(text.encode()).hexdigest(), n


@dataclass(frozen=True)
class WriteResult:
    written: bool
    content_hash: str
    batch_id: str | None
    n_rows: int


class ObservationStore:
    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark = spark
        self.base = base.rstrip("/")

    def path(self, dataset: str) -> str:
        return f"{self.base}/{dataset}"

    # -- writing -------------------------------------------------------------------------------------

    def write(
        self, dataset: str, df: DataFrame, *, valid_at: datetime, observed_at: datetime, source: str,
        skip_if_unchanged: bool = True, provider_id: str | None = None, capability: str | None = None,
        endpoint: str | None = None, fixed: bool = False, together: Sequence[str] = (),
    ) -> WriteResult:
        """Append one immutable batch, unless it equals the newest one.

        ``fixed``: the rows are settled or come straight from files that do not change, so they need no copy before they are hashed.
        ``together``: columns whose equal values lie together in every file, so that a read of few values passes over the other pages.
        """
        self._guard(dataset, df)
        valid_at, observed_at = tt.instant("valid_at", valid_at), tt.instant("observed_at", observed_at)
        df = df if fixed else settle(df)  # hashed and written: both must see the same rows
        digest, n = content_hash(df)
        if n == 0:
            raise TidemarkError(f"refusing to write an empty batch to {dataset}")
        if skip_if_unchanged and self.latest_content_hash(dataset) == digest:
            return WriteResult(False, digest, None, n)
        batch = uuid.uuid4().hex
        stamped = self._widened(self._pinned(dataset, df)).select(
            "*", F.lit(valid_at).cast("timestamp").alias("valid_at"), F.lit(observed_at).cast("timestamp").alias("observed_at"),
            F.lit(source).alias("source"), F.lit(digest).alias("content_hash"), F.lit(batch).alias("batch_id"),
            *[F.lit(v).cast("string").alias(k) for k, v in
              (("provider_id", provider_id), ("capability", capability), ("endpoint", endpoint))],
            F.lit(observed_at.date()).alias("date"),
        )
        manifest = self.manifest(dataset)
        stamped = stamped.sortWithinPartitions("date", *together) if together else stamped
        stamped.write.mode("append").partitionBy("date").parquet(self.path(dataset))
        manifest.append({"observed_at": observed_at, "batch_id": batch, "valid_at": valid_at, "source": source, "content_hash": digest, "n_rows": n,
                         "date": observed_at.date(), "fields": T.StructType([f for f in stamped.schema if f.name != "date"]).json()})
        return WriteResult(True, digest, batch, n)

    def manifest(self, dataset: str) -> Manifest:
        """The dataset's batches; one made from its rows where it was written without."""
        manifest = Manifest(self.spark, self.path(dataset))
        if not child_names(self.spark, manifest.path):
            rows = self._merged(dataset)
            if rows is not None:
                manifest.rebuilt(rows)
        return manifest

    def write_all(self, frames: Mapping[str, DataFrame], **stamp) -> dict[str, WriteResult]:
        """One payload's datasets at one instant."""
        return {name: self.write(name, df, **stamp) for name, df in frames.items()}

    @staticmethod
    def _guard(dataset: str, df: DataFrame) -> None:
        clash = sorted({*RESERVED, "date"} & set(df.columns))
        if clash:
            raise TidemarkError(f"payload columns collide with reserved metadata: {clash}")
        derived = set(DERIVED_FIELDS) & set(df.columns)
        if derived and not dataset.startswith(DERIVED_PREFIX):
            raise TidemarkError(f"{dataset} is an observed dataset but the payload carries {sorted(derived)}")
        if dataset.startswith(DERIVED_PREFIX) and len(derived) < len(DERIVED_FIELDS):
            raise TidemarkError(f"{dataset} needs every derived field, missing {sorted(set(DERIVED_FIELDS) - derived)}")
        zoned = zoned_columns(df)
        if zoned:
            raise TidemarkError(f"columns {zoned} carry a time zone; data columns are naive UTC")

    def _pinned(self, dataset: str, df: DataFrame) -> DataFrame:
        """Columns without any value take the dataset's declared type, or the one that earlier batches gave them."""
        void = [f.name for f in df.schema if isinstance(f.dataType, T.NullType)]
        if not void:
            return df
        known = {f.name: f.dataType for f in self.manifest(dataset).schema() or ()}
        known |= dict(CATALOG[dataset].pins) if dataset in CATALOG else {}
        return df.withColumns({name: F.col(name).cast(known[name]) for name in void if name in known})

    @staticmethod
    def _widened(df: DataFrame) -> DataFrame:
        """One physical type per family, so that batches of different years merge; unseen columns are left out."""
        wide = {"integer": "bigint", "float": "double"}
        kept = [f for f in df.schema if not isinstance(f.dataType, T.NullType)]
        return df.select(*[F.col(f.name).cast(wide.get(family(f.dataType), f.dataType)).alias(f.name) for f in kept])

    # -- reading -------------------------------------------------------------------------------------

    def scan(self, dataset: str) -> DataFrame | None:
        """Every batch, columns united by name as the manifest has them; None when nothing was ever written."""
        schema = self.manifest(dataset).schema()
        if schema is None:
            return None
        return self.spark.read.schema(T.StructType([*schema, T.StructField("date", T.DateType())])).parquet(self.path(dataset))

    def _merged(self, dataset: str) -> DataFrame | None:
        """Every batch with a schema merged from the footers of all files, for datasets without a manifest."""
        try:
            return self.spark.read.option("mergeSchema", "true").parquet(self.path(dataset))
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def _known(self, dataset: str, cutoff: datetime) -> DataFrame | None:
        """Batches up to the cut-off's day; ``date`` is the partition that this store writes, so whole folders are left out."""
        day = tt.instant("cutoff", cutoff).date()
        df = self.scan(dataset)
        return None if df is None else df.filter(F.col("date") <= F.lit(day))

    def _dealt(self, dataset: str, df: DataFrame, key: Sequence[str]) -> DataFrame:
        """Rows dealt by their key before the newest of each is taken, to a number of tasks that follows the manifest's row counts.

        A key has a row per batch, so the tasks stay even. Stored rows are small and wide: a few files would otherwise hold
        more rows than one task should sort.
        """
        n = self.manifest(dataset).entries().agg(F.sum("n_rows")).first()[0] or 0
        # Up to UNSORTED tasks the writing side needs no sort either.
        return df.repartition(max(1, min(UNSORTED, -(-n // FEW)), -(-n // MANY)), *[F.col(k) for k in key]) if key else df

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([]))

    def latest_content_hash(self, dataset: str) -> str | None:
        newest = self.manifest(dataset).newest()
        return None if newest is None else newest["content_hash"]

    def provenance(self, dataset: str) -> DataFrame | None:
        """One row per batch: when it was seen and valid, where from, its hash, size and columns."""
        return self.manifest(dataset).entries()

    def as_of(self, dataset: str, cutoff: datetime) -> DataFrame:
        key = lookup(dataset).key
        df = self._known(dataset, cutoff)
        return self._empty() if df is None else tt.as_of(self._dealt(dataset, df, key), key, cutoff)

    def effective_at(self, dataset: str, cutoff: datetime) -> DataFrame:
        spec = lookup(dataset)
        if spec.valid_time is None:
            raise TidemarkError(f"{dataset} declares no valid-time column")
        tt.instant("cutoff", cutoff)
        df = self.scan(dataset)
        return self._empty() if df is None else tt.effective_at(
            df, spec.key, cutoff, spec.valid_time, spec.valid_format, lambda rows: self._dealt(dataset, rows, spec.key))

    def observations(self, dataset: str, until: datetime) -> DataFrame:
        tt.instant("until", until)
        df = self._known(dataset, until)
        return self._empty() if df is None else tt.observations(df, until)

    def latest(self, dataset: str) -> DataFrame:
        df, key = self.scan(dataset), lookup(dataset).key
        return self._empty() if df is None else tt.latest(self._dealt(dataset, df, key), key)

    # -- derived facts -------------------------------------------------------------------------------

    def write_derived(
        self, dataset: str, df: DataFrame, *, derived_from: Sequence[Mapping], reference: str, residual_mean: float,
        residual_std: float, **stamp,
    ) -> WriteResult:
        """Stamp the modelled flag, the lineage and the calibration, then append."""
        if not lookup(dataset).is_derived:
            raise TidemarkError(f"{dataset} is not a derived dataset")
        if not derived_from:
            raise TidemarkError("a derived batch must record what it was derived from")
        clash = set(DERIVED_FIELDS) & set(df.columns)
        if clash:
            raise TidemarkError(f"payload columns {sorted(clash)} are stamped on write")
        stamped = df.select(
            "*", F.lit(True).alias("is_modelled"), F.lit(encode_lineage(derived_from)).alias("derived_from"),
            F.lit(reference).alias("calibration_reference"), F.lit(residual_mean).alias("calibration_residual_mean"),
            F.lit(residual_std).alias("calibration_residual_std"),
        )
        lookup(dataset).validate(stamped)
        return self.write(dataset, stamped, **stamp)

    def read_derived(self, dataset: str, cutoff: datetime) -> DataFrame:
        """State of a derived dataset; a row not marked as modelled fails the query that reads it."""
        if not lookup(dataset).is_derived:
            raise TidemarkError(f"{dataset} is not a derived dataset")
        df = self.as_of(dataset, cutoff)
        if "is_modelled" not in df.columns:
            return df
        return refuse_unmodelled(df)


def refuse_unmodelled(df: DataFrame) -> DataFrame:
    marked = F.when(F.coalesce("is_modelled", F.lit(False)), True).otherwise(
        F.raise_error(F.lit("a derived dataset holds a row that is not marked as modelled")).cast("boolean")
    )
    return df.withColumn("is_modelled", marked).filter("is_modelled")


LINEAGE = "ARRAY<STRUCT<capability: STRING, entity_key: MAP<STRING, STRING>, note: STRING>>"


def encode_lineage(inputs: Sequence[Mapping]) -> str:
    return json.dumps([dict(i) for i in inputs], sort_keys=True)


def decode_lineage(column: Column) -> Column:
    return F.from_json(column, LINEAGE)
