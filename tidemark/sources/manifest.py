"""What a dataset's batches were, without reading the batches.

Layout under ``<dataset>/_manifest`` (readers of the dataset skip names that begin with an underscore):
``gen=N/newest`` holds one entry, ``gen=N/head`` all entries up to a compaction, ``gen=N/tail`` those since. The newest
batch is found from ``newest`` and a tail of at most ``COMPACT_AFTER`` entries, however long the history is. A compaction
writes generation N + 1 and then removes the older ones; a generation counts once its head is complete.

One writer per dataset at a time. A batch whose entry is missing (the writer was lost in between) is found by ``rebuilt``.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from tidemark.session import child_names, remove

COMPACT_AFTER = 32
ENTRY = "observed_at timestamp, batch_id string, valid_at timestamp, source string, content_hash string, n_rows long, date date, fields string"


class Manifest:
    def __init__(self, spark: SparkSession, dataset_path: str) -> None:
        self.spark = spark
        self.path = f"{dataset_path}/_manifest"

    def _generation(self) -> int | None:
        found = [int(n.removeprefix("gen=")) for n in child_names(self.spark, self.path) if n.startswith("gen=")]
        whole = [n for n in found if "_SUCCESS" in child_names(self.spark, f"{self.path}/gen={n}/head")]
        return max(whole, default=None)

    def _read(self, *parts: str) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(*parts)

    def _tail(self, generation: int) -> list[str]:
        place = f"{self.path}/gen={generation}/tail"
        return [place] if child_names(self.spark, place) else []

    def append(self, entry: Mapping) -> None:
        """Add one entry; the tail is folded into a new generation when it is long."""
        row = self.spark.createDataFrame([tuple(entry[f.name] for f in T.StructType.fromDDL(ENTRY))], ENTRY).coalesce(1)
        generation = self._generation()
        if generation is None:
            self._write(0, row)
            return
        row.write.mode("append").parquet(f"{self.path}/gen={generation}/tail")
        if self._read(*self._tail(generation)).count() >= COMPACT_AFTER:
            self._write(generation + 1, self.entries())

    def _write(self, generation: int, entries: DataFrame) -> None:
        place = f"{self.path}/gen={generation}"
        remove(self.spark, place)  # left by a writer that was lost
        newest_entry(entries).coalesce(1).write.parquet(f"{place}/newest")
        entries.coalesce(1).write.parquet(f"{place}/head")
        for old in child_names(self.spark, self.path):
            if old.startswith("gen=") and int(old.removeprefix("gen=")) < generation:
                remove(self.spark, f"{self.path}/{old}")

    def entries(self) -> DataFrame | None:
        """All entries, one small row per batch."""
        generation = self._generation()
        return None if generation is None else self._read(f"{self.path}/gen={generation}/head", *self._tail(generation))

    def newest(self):
        """The entry of the newest batch (highest observation time, then batch id), from a bounded number of entries."""
        generation = self._generation()
        if generation is None:
            return None
        return newest_entry(self._read(f"{self.path}/gen={generation}/newest", *self._tail(generation))).first()

    def schema(self) -> T.StructType | None:
        """The columns of all batches, united by name, from the few distinct schemas that the entries carry."""
        entries = self.entries()
        if entries is None:
            return None
        seen = entries.groupBy("fields").agg(F.min(F.struct("observed_at", "batch_id")).alias("first")).orderBy("first").select("fields").collect()
        united: dict[str, T.StructField] = {}
        for (fields,) in seen:
            for field in T.StructType.fromJson(json.loads(fields)):
                united.setdefault(field.name, T.StructField(field.name, field.dataType))
        return T.StructType(list(united.values()))

    def rebuilt(self, batches: DataFrame) -> None:
        """Write the entries anew from a dataset's rows; they all get the dataset's whole schema."""
        fields = T.StructType([f for f in batches.schema if f.name != "date"]).json()
        entries = batches.groupBy("batch_id").agg(
            F.max("observed_at").alias("observed_at"), F.max("valid_at").alias("valid_at"), F.max("source").alias("source"),
            F.max("content_hash").alias("content_hash"), F.count("*").alias("n_rows"), F.max("date").alias("date"))
        generation = self._generation()
        names = [f.name for f in T.StructType.fromDDL(ENTRY)]
        self._write(0 if generation is None else generation + 1, entries.withColumn("fields", F.lit(fields)).select(*names))


def newest_entry(entries: DataFrame) -> DataFrame:
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("observed_at"), F.desc("batch_id")))
    return entries.withColumn("_place", place).filter("_place = 1").drop("_place")
