"""Bitemporal store: boundaries, ties, guards, order independence."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import timetravel as tt
from tidemark.session import TidemarkError, scratch_path
from tidemark.sources.catalog import CATALOG, Dataset, lookup, register
from tidemark.sources.store import ObservationStore, content_hash

UTC = timezone.utc
T0 = datetime(2024, 1, 1, tzinfo=UTC)

if "t_log" not in CATALOG:
    register(Dataset("t_log", ("k",), ("v",)))


def hour(n):
    return T0 + timedelta(hours=n)


@pytest.fixture
def store(spark):
    return ObservationStore(spark, scratch_path(spark, "t"))


def put(store, rows, n, **more):
    df = store.spark.createDataFrame(rows, "k int, v int")
    return store.write("t_log", df, valid_at=hour(n), observed_at=hour(n), source="s", **more)


def state(store, at):
    return {r["k"]: r["v"] for r in store.as_of("t_log", at).collect()}


def test_cutoff_is_inclusive_and_vanished_rows_stay(store):
    put(store, [(1, 10), (2, 20)], 1)
    put(store, [(1, 11)], 2)
    assert state(store, hour(1)) == {1: 10, 2: 20}
    assert state(store, hour(2) - timedelta(microseconds=1)) == {1: 10, 2: 20}
    assert state(store, hour(2)) == {1: 11, 2: 20}
    assert state(store, hour(0)) == {}


def test_write_order_does_not_matter(spark):
    a, b = (ObservationStore(spark, scratch_path(spark, "t")) for _ in range(2))
    batches = [([(1, 1)], 1), ([(1, 2), (3, 3)], 2), ([(2, 5)], 3)]
    for rows, n in batches:
        put(a, rows, n)
    for rows, n in reversed(batches):
        put(b, rows, n)
    for n in range(5):
        assert state(a, hour(n)) == state(b, hour(n))


def test_equal_times_fall_to_the_higher_batch(spark):
    df = spark.createDataFrame([(1, T0, "a", 1), (1, T0, "b", 2), (1, T0, "0", 3)], "k int, observed_at timestamp, batch_id string, v int")
    assert tt.as_of(df, ["k"], T0).first()["v"] == 2


def test_later_rows_never_change_an_earlier_read(store):
    put(store, [(1, 10)], 1)
    before = state(store, hour(1))
    put(store, [(1, 99), (7, 7)], 5)
    assert state(store, hour(1)) == before


def test_unchanged_batches_are_skipped(store):
    assert put(store, [(1, 10), (2, 20)], 1).written
    again = put(store, [(2, 20), (1, 10)], 2)
    assert not again.written and again.batch_id is None
    assert put(store, [(1, 10), (2, 20)], 3, skip_if_unchanged=False).written
    assert put(store, [(1, 10), (1, 10)], 4).written


def test_content_hash_ignores_order_but_not_duplicates(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    b = spark.createDataFrame([(None, 2), ("x", 1)], "b string, a int")
    assert content_hash(a) == content_hash(b)
    assert content_hash(a)[0] != content_hash(a.union(a))[0]
    assert content_hash(a)[0] != content_hash(a.filter("a = 1"))[0]


def test_schema_drift_reads_by_name(store):
    put(store, [(1, 10)], 1)
    wide = store.spark.createDataFrame([(2, 20, "new")], "k bigint, v bigint, extra string")
    store.write("t_log", wide, valid_at=hour(2), observed_at=hour(2), source="s")
    rows = {r["k"]: r["extra"] for r in store.as_of("t_log", hour(2)).collect()}
    assert rows == {1: None, 2: "new"}


def test_guards(store, spark):
    with pytest.raises(TidemarkError, match="empty"):
        put(store, [], 1)
    with pytest.raises(TidemarkError, match="reserved"):
        store.write("t_log", spark.createDataFrame([(1, "x")], "k int, source string"), valid_at=T0, observed_at=T0, source="s")
    with pytest.raises(TidemarkError, match="observed dataset"):
        store.write("t_log", spark.createDataFrame([(1, True)], "k int, is_modelled boolean"), valid_at=T0, observed_at=T0, source="s")
    with pytest.raises(TidemarkError, match="missing"):
        store.write("derived_x", spark.createDataFrame([(1,)], "k int"), valid_at=T0, observed_at=T0, source="s")
    with pytest.raises(TidemarkError, match="time zone"):
        store.write("t_log", spark.createDataFrame([(1, T0)], "k int, at timestamp"), valid_at=T0, observed_at=T0, source="s")
    with pytest.raises(TidemarkError, match="timezone-aware"):
        store.as_of("t_log", datetime(2024, 1, 1))
    with pytest.raises(TidemarkError, match="no declared entity key"):
        store.as_of("nobody_knows", T0)
    with pytest.raises(TidemarkError, match="valid-time"):
        store.effective_at("t_log", T0)
    assert store.as_of("t_log", T0).isEmpty()


def test_schema_validation(spark):
    with pytest.raises(TidemarkError, match="missing required"):
        lookup("t_log").validate(spark.createDataFrame([(1,)], "k int"))
    with pytest.raises(TidemarkError, match="no accepted family"):
        lookup("t_log").validate(spark.createDataFrame([(1, [1])], "k int, v array<int>"))


def test_effective_time_is_strict(spark):
    rows = [(1, 1, "2024-01-01T12:00:00Z"), (1, 2, "2024-01-01T13:00:00Z"), (2, 3, None)]
    df = spark.createDataFrame(rows, "k int, v int, kickoff_time string").withColumn("observed_at", F.lit(T0)).withColumn("batch_id", F.col("v").cast("string"))
    read = lambda at: [r["v"] for r in tt.effective_at(df, ["k"], at, "kickoff_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").collect()]
    assert read(hour(13)) == [1]
    assert read(hour(13) + timedelta(microseconds=1)) == [2]
    assert read(hour(13) + timedelta(seconds=1)) == [2]
    assert read(hour(12)) == []


@pytest.mark.parametrize("hours", [(0, 5, 14, 15, 33, 90), (14,), tuple(n / 97 for n in range(2000)), (-900, 10, 10.0001, 10.0002, 49)])
def test_deadline_join_against_brute_force(spark, hours):
    rows = [(i % 7 if i % 3 else 0, hour(i * 7 % 50).replace(tzinfo=None), i) for i in range(60)]
    df = spark.createDataFrame([*rows, (0, None, 99)], "k int, observed_at timestamp_ntz, batch_id int")
    deadlines = spark.createDataFrame([*[((T0 + timedelta(hours=n)).replace(tzinfo=None),) for n in hours] * 2, (None,)], "deadline timestamp_ntz")
    got = {(r["deadline"], r["k"]): r["batch_id"] for r in tt.as_of_deadlines(df, ["k"], deadlines).collect()}
    want = {}
    for (d,) in deadlines.dropna().collect():
        for k, at, b in rows:
            if at <= d and (d, k) not in want or at <= d and (at, b) > want[(d, k)]:
                want[(d, k)] = (at, b)
    assert got == {key: b for key, (_, b) in want.items()}
    assert tt.as_of_deadlines(df, ["k"], deadlines.limit(0)).count() == 0


def test_derived_rows_need_their_mark(store, spark):
    row = spark.createDataFrame([("2024-25", 1, 7, 3, 0, 0, 0.5)], "season string, round int, element int, fixture int, state int, band int, p double")
    stamp = dict(valid_at=T0, observed_at=T0, source="fit", reference="r", residual_mean=0.0, residual_std=1.0)
    with pytest.raises(TidemarkError, match="derived from"):
        store.write_derived("derived_minutes_pmf", row, derived_from=[], **stamp)
    with pytest.raises(TidemarkError, match="stamped"):
        store.write_derived("derived_minutes_pmf", row.withColumn("is_modelled", F.lit(True)), derived_from=[{"capability": "c"}], **stamp)
    store.write_derived("derived_minutes_pmf", row, derived_from=[{"capability": "c"}], **stamp)
    assert store.read_derived("derived_minutes_pmf", hour(1)).count() == 1
    forged = row.withColumn("is_modelled", F.lit(False)).withColumn("derived_from", F.lit("[]")).withColumn("calibration_reference", F.lit("r")).withColumn(
        "calibration_residual_mean", F.lit(0.0)).withColumn("calibration_residual_std", F.lit(1.0))
    store.write("derived_minutes_pmf", forged, valid_at=hour(2), observed_at=hour(2), source="x")
    with pytest.raises(Exception, match="not marked as modelled"):
        store.read_derived("derived_minutes_pmf", hour(3)).collect()


def test_cutoffs_do_not_move_with_the_session_zone(spark):
    df = spark.createDataFrame([(1, hour(3).replace(tzinfo=None), 1)], "k int, observed_at timestamp_ntz, batch_id int")
    deadlines = spark.createDataFrame([(hour(3).replace(tzinfo=None),)], "deadline timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert tt.as_of(df, ["k"], hour(3)).count() == 1
        assert tt.as_of(df, ["k"], hour(3) - timedelta(microseconds=1)).count() == 0
        assert tt.as_of_deadlines(df, ["k"], deadlines).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_goals_and_assists_are_two_facts(store, spark):
    rows = spark.createDataFrame([("2024-25", 1, 7, 3, s, 1, p) for s, p in (("goals", 0.2), ("assists", 0.3))],
                                 "season string, round int, element int, fixture int, stat string, count int, p double")
    store.write_derived("derived_attacking_pmf", rows, derived_from=[{"capability": "c"}], valid_at=T0, observed_at=T0, source="fit",
                        reference="r", residual_mean=0.0, residual_std=1.0)
    assert sorted(r["p"] for r in store.read_derived("derived_attacking_pmf", hour(1)).collect()) == [0.2, 0.3]


def test_a_business_date_is_no_partition(spark):
    log = spark.createDataFrame([(1, T0.replace(tzinfo=None), "b", (T0 + timedelta(days=9)).date())], "id int, observed_at timestamp_ntz, batch_id string, date date")
    assert tt.as_of(log, ["id"], hour(1)).count() == 1
