"""The store's reads and writes as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.operators.ordered import previous_value, running_total
from tidemark.operators.timetravel import _newest
from tidemark.session import child_names, remove, settle
from tidemark.sources.store import content_hash


def read_log(spark: SparkSession, path: str, schema: StructType, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)


def append_log(stream: DataFrame, path: str, checkpoint: str, date_from: str = "observed_at") -> StreamingQuery:
    """Observations appended as they come; a late correction is only a later row, so nothing waits."""
    dated = stream.withColumn("date", F.to_date(date_from))
    return (
        dated.writeStream.format("parquet").partitionBy("date").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )


def append_changed(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is appended unless its contents equal the newest stored batch.

    Every batch has its own folder, so a batch that is run again after a failure replaces itself. The newest hash is
    handed from batch to batch in ``_newest``: a batch reads one row, however much is stored.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = settle(batch)
        before = [int(n.removeprefix("batch=")) for n in child_names(spark, f"{path}/_newest") if n.startswith("batch=")]
        last = max((n for n in before if n < number), default=None)
        newest = None if last is None else spark.read.schema("content_hash string").parquet(f"{path}/_newest/batch={last}").first()[0]
        digest, n = content_hash(batch)
        if n and digest != newest:
            batch.withColumn("content_hash", F.lit(digest)).write.mode("overwrite").parquet(f"{path}/batch={number}")
            newest = digest
        spark.createDataFrame([(newest,)], "content_hash string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_newest/batch={number}")
        for old in before:
            if old < number - KEPT_VERSIONS:
                remove(spark, f"{path}/_newest/batch={old}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# Versions before the last that stay readable; a batch that runs again reads the one before it.
KEPT_VERSIONS = 2
# Rows of a bucket on average, beyond which the state is dealt to eight times as many buckets.
BUCKET_ROWS = 200_000
BUCKETS = "bucket int, version long, rows long, buckets int"


def maintain_latest(stream: DataFrame, key: Sequence[str], path: str, checkpoint: str,
                    observed: str = "observed_at", batch_id: str = "batch_id", buckets: int = 16, bucket_rows: int = BUCKET_ROWS) -> StreamingQuery:
    """The newest row of every key, kept up to date in buckets of keys of which a micro-batch rewrites those it touches.

    ``data/version=n/bucket=b`` holds what batch n wrote, ``manifest/version=n`` which version of every bucket is
    current. A version exists once its manifest is complete, so readers see whole versions and a batch that runs again
    replaces itself. Buckets grow in number with the state, so a touched one stays of bounded size: what a batch writes
    follows the keys it brings and not the state, but for the rare batches in which the buckets grow.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        order = [F.desc(observed), F.desc(batch_id)]
        rows = settle(_newest(batch, key, order))
        current = _state_manifest(spark, path, number)
        if current is None and rows.isEmpty():
            return
        dealt = buckets if current is None else current[0]["buckets"]
        rows = rows.withColumn("bucket", _bucket(key, dealt))
        known = {} if current is None else {r["bucket"]: r for r in current if r["rows"]}
        touched = {r["bucket"] for r in rows.select("bucket").distinct().collect()}  # at most one per bucket
        grow = sum(r["rows"] for r in known.values()) > bucket_rows * dealt
        if grow:
            dealt, touched = dealt * 8, set(known)
            rows = rows.withColumn("bucket", _bucket(key, dealt))
        held = _bucket_rows(spark, path, [known[b] for b in sorted(touched & set(known))], rows.drop("bucket").schema)
        if held is not None:
            rows = _newest(rows.drop("bucket").unionByName(held), key, order).withColumn("bucket", _bucket(key, dealt))
        place = f"{path}/data/version={number}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(place)
        stored = spark.read.parquet(place) if any(n.startswith("bucket=") for n in child_names(spark, place)) else None
        sizes = {} if stored is None else {r["bucket"]: r["count"] for r in stored.groupBy("bucket").count().collect()}
        kept = {} if grow else {b: (b, r["version"], r["rows"], dealt) for b, r in known.items()}
        kept |= {b: (b, number, n, dealt) for b, n in sizes.items()}
        spark.createDataFrame(list(kept.values()) or [(0, number, 0, dealt)], BUCKETS).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={number}")
        _clean(spark, path, number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _bucket(key: Sequence[str], buckets: int):
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose manifest is complete, in order."""
    found = [int(n.removeprefix("version=")) for n in child_names(spark, f"{path}/manifest") if n.startswith("version=")]
    return sorted(n for n in found if "_SUCCESS" in child_names(spark, f"{path}/manifest/version={n}"))


def _state_manifest(spark: SparkSession, path: str, before: int | None = None) -> list | None:
    """The rows (one per bucket) of the newest manifest, or of the newest before a version."""
    versions = [n for n in _versions(spark, path) if before is None or n < before]
    return spark.read.schema(BUCKETS).parquet(f"{path}/manifest/version={versions[-1]}").collect() if versions else None


def _bucket_rows(spark: SparkSession, path: str, wanted: Sequence, schema: StructType) -> DataFrame | None:
    if not wanted:
        return None
    return spark.read.schema(schema).parquet(*[f"{path}/data/version={r['version']}/bucket={r['bucket']}" for r in wanted])


def _clean(spark: SparkSession, path: str, number: int) -> None:
    """Remove manifests before the kept versions and the buckets that no remaining manifest names."""
    versions = [n for n in _versions(spark, path) if n <= number]
    for old in versions[:-1 - KEPT_VERSIONS]:
        remove(spark, f"{path}/manifest/version={old}")
    left = [r for n in versions[-1 - KEPT_VERSIONS:] for r in spark.read.schema(BUCKETS).parquet(f"{path}/manifest/version={n}").collect()]
    used = {(r["version"], r["bucket"]) for r in left}
    for name in child_names(spark, f"{path}/data"):
        version = int(name.removeprefix("version="))
        if version >= number:
            continue
        inside = [b for b in child_names(spark, f"{path}/data/{name}") if b.startswith("bucket=")]
        gone = [b for b in inside if (version, int(b.removeprefix("bucket="))) not in used]
        for bucket in [None] if len(gone) == len(inside) else gone:
            remove(spark, f"{path}/data/{name}" + (f"/{bucket}" if bucket else ""))


def read_latest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The maintained state: the current version of every bucket."""
    current = [r for r in _state_manifest(spark, path) or [] if r["rows"]]
    rows = _bucket_rows(spark, path, current, schema)
    return spark.createDataFrame([], schema) if rows is None else rows


def heartbeat_sessions(stream: DataFrame, gap: str, late: str, job: str = "job", run: str = "run_ts") -> DataFrame:
    """Runs of a job without a gap longer than ``gap``: a session that ends marks a gap.

    A run that comes more than ``late`` after a newer one is dropped, so the caller states that time. Set
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` to merge a job's sessions before they shuffle.
    """
    timed = stream.withColumn(run, F.col(run).cast("timestamp")).withWatermark(run, late)
    return timed.groupBy(F.session_window(run, gap).alias("s"), job).agg(F.count("*").alias("n_runs")).select(
        job, F.col("s.start").cast("timestamp_ntz").alias("session_start"), F.col("s.end").cast("timestamp_ntz").alias("session_end"), "n_runs"
    )


def sessions_of_log(runs: DataFrame, gap_seconds: int, job: str = "job", run: str = "run_ts") -> DataFrame:
    """The same sessions over a stored log, split over tasks even where one job has most rows.

    Equal instants are counted once; slices of (job, instant) then find the runs that open a session, and a running
    count of these, carried from slice to slice, numbers the sessions. Each is stitched from one partial per slice.
    """
    instants = runs.groupBy(job, run).agg(F.count("*").alias("_runs"))
    before = previous_value(instants, [job], [run], run, "_before")
    opens = F.col("_before").isNull() | (F.timestamp_diff("MICROSECOND", F.col("_before"), F.col(run)) > gap_seconds * 1_000_000)
    numbered = running_total(before.withColumn("_opens", opens.cast("long")), [job], [run], "_opens", "_session")
    end = F.max(run) + F.make_dt_interval(secs=F.lit(gap_seconds))
    return numbered.groupBy(job, "_session").agg(F.min(run).alias("session_start"), end.alias("session_end"), F.sum("_runs").alias("n_runs")).drop("_session")
