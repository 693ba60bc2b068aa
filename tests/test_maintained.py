"""Manifests of batches, maintained state in buckets, and sessions of hot jobs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_store import hour, put, state

from tidemark.session import child_names, remove, scratch_path, stored_bytes
from tidemark.sources import manifest
from tidemark.sources.store import ObservationStore
from tidemark.streaming import ingest

SCHEMA = "k long, v long, observed_at timestamp, batch_id string"


@pytest.fixture
def store(spark):
    return ObservationStore(spark, scratch_path(spark, "t"))


def test_the_newest_batch_is_found_in_bounded_reads(spark, store, monkeypatch):
    monkeypatch.setattr(manifest, "COMPACT_AFTER", 3)
    held = []
    for n in range(1, 9):
        put(store, [(i, n) for i in range(50)], n)
        entries = store.manifest("t_log")
        generation = entries._generation()
        tail = [f for f in child_names(spark, f"{entries.path}/gen={generation}/tail") if f.startswith("part-")]
        held.append(len(tail))
        assert len([g for g in child_names(spark, entries.path) if g.startswith("gen=")]) == 1
    assert max(held) <= 3 and store.provenance("t_log").count() == 8
    assert not put(store, [(i, 8) for i in range(50)], 9).written and put(store, [(1, 1)], 10).written
    put(store, [(2, 2)], 5, skip_if_unchanged=False)  # an older observation does not become the newest
    assert store.manifest("t_log").newest()["observed_at"].hour == 10
    newest = store.latest_content_hash("t_log")
    for name in child_names(spark, store.path("t_log")):
        if name.startswith("date="):
            remove(spark, f"{store.path('t_log')}/{name}")
    assert store.latest_content_hash("t_log") == newest  # no batch is read for it


def test_schemas_unite_without_reading_footers(spark, store):
    put(store, [(1, 10)], 1)
    wide = spark.createDataFrame([(2, 20, "x")], "k int, v int, extra string")
    store.write("t_log", wide, valid_at=hour(2), observed_at=hour(2), source="s")
    assert {r["k"]: r["extra"] for r in store.as_of("t_log", hour(3)).collect()} == {1: None, 2: "x"}


def test_a_store_without_a_manifest_gets_one(spark, store):
    put(store, [(1, 10)], 1)
    put(store, [(1, 11)], 2)
    remove(spark, f"{store.path('t_log')}/_manifest")
    assert state(store, hour(2)) == {1: 11} and not put(store, [(1, 11)], 3).written
    assert store.provenance("t_log").select("n_rows").collect() == [(1,), (1,)]


def test_a_compaction_that_was_lost_is_done_again(spark, store, monkeypatch):
    put(store, [(1, 10)], 1)
    entries = store.manifest("t_log")
    entries.entries().write.parquet(f"{entries.path}/gen=1/newest")  # no head: this generation does not count
    assert entries._generation() == 0
    monkeypatch.setattr(manifest, "COMPACT_AFTER", 1)
    put(store, [(1, 11)], 2)
    assert entries._generation() == 1 and entries.newest()["n_rows"] == 1 and store.provenance("t_log").count() == 2


# -- maintained state ---------------------------------------------------------------------------------


def feed(spark, folder, batches):
    """One file per micro-batch, in order of their names."""
    for i, rows in enumerate(batches):
        spark.createDataFrame([(k, v, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), b) for k, v, t, b in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")


def maintain(spark, folder, path, offsets, count, **settings):
    for i in range(count):  # one file after the other: a run per batch, with the same checkpoint
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(folder)
        ingest.maintain_latest(stream, ["k"], path, offsets, **settings).awaitTermination()


def newest_of(batches):
    best = {}
    for rows in batches:
        for k, v, t, b in rows:
            if k not in best or (t, b) > best[k][1:]:
                best[k] = (v, t, b)
    return {k: v[0] for k, v in best.items()}


def test_state_in_buckets(spark):
    folder, path, offsets = (scratch_path(spark, n) for n in ("in", "state", "offsets"))
    first = [(k, 0, 10, "a") for k in range(6000)]
    later = [[(k, n, 20 + n, "b") for k in (n, n + 1)] for n in range(1, 5)] + [[(1, 77, 5, "z"), (2, 5, 22, "c"), (6001, 6, 1, "n")]]
    batches, written = [first, *later], []
    for i, rows in enumerate(batches):
        feed(spark, f"{folder}/{i}", [rows])
        maintain(spark, folder, path, offsets, 1, buckets=4, bucket_rows=100)
        written.append(stored_bytes(spark, f"{path}/data/version={i}"))
        got = ingest.read_latest(spark, path, spark.read.schema(SCHEMA).parquet(f"{folder}/0/000").schema)
        assert {r["k"]: r["v"] for r in got.collect()} == newest_of(batches[:i + 1])
    buckets = {r["buckets"] for r in ingest._state_manifest(spark, path)}
    assert buckets == {256}  # 4, then 32 and 256 as the state outgrew them
    assert max(written[3:]) < written[0] / 5 and max(written[3:]) <= 2 * min(written[3:])
    assert ingest._versions(spark, path) == [3, 4, 5]
    used = {(r["version"], r["bucket"]) for n in (3, 4, 5) for r in spark.read.schema(ingest.BUCKETS).parquet(f"{path}/manifest/version={n}").collect()}
    for name in child_names(spark, f"{path}/data"):
        for bucket in child_names(spark, f"{path}/data/{name}"):
            if bucket.startswith("bucket="):
                assert (int(name.removeprefix("version=")), int(bucket.removeprefix("bucket="))) in used


def test_a_batch_that_runs_again_replaces_itself(spark):
    folder, path = scratch_path(spark, "in"), scratch_path(spark, "state")
    feed(spark, folder, [[(1, 1, 1, "a"), (2, 1, 1, "a")]])
    maintain(spark, folder, path, scratch_path(spark, "offsets"), 1)
    remove(spark, f"{path}/manifest/version=0/_SUCCESS")  # as if the writer had been lost before the end
    schema = spark.read.schema(SCHEMA).parquet(f"{folder}/000").schema
    assert ingest.read_latest(spark, path, schema).count() == 0
    maintain(spark, folder, path, scratch_path(spark, "offsets"), 1)
    assert {r["k"]: r["v"] for r in ingest.read_latest(spark, path, schema).collect()} == {1: 1, 2: 1}


# -- sessions -----------------------------------------------------------------------------------------


def test_sessions_of_a_hot_job(spark):
    """Nine tenths of the runs are one job's; they come from many slices and equal the built-in windows."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    runs = spark.range(4000).select(
        F.when(F.col("id") % 10 == 0, "cold").when(F.col("id") % 997 == 1, None).otherwise("hot").alias("job"),
        (start + F.make_dt_interval(secs=(F.col("id") * 37 + F.floor(F.col("id") / 50) * 900).cast("double"))).alias("run_ts"))
    runs = runs.unionByName(runs.limit(20)).repartition(8)
    got = {tuple(r) for r in ingest.sessions_of_log(runs, 600).select("job", "session_start", "session_end", "n_runs").collect()}
    zoned = runs.withColumn("run_ts", F.col("run_ts").cast("timestamp"))
    want = zoned.groupBy("job", F.session_window("run_ts", "600 seconds").alias("s")).agg(F.count("*").alias("n"))
    want = {tuple(r) for r in want.select("job", F.col("s.start").cast("timestamp_ntz"), F.col("s.end").cast("timestamp_ntz"), "n").collect()}
    assert got == want and len(got) > 50
