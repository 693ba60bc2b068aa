"""Two-provider reads, season loads, typed NULLs, checks of batches and snapshot runs."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import decisions as de
from tidemark.session import TidemarkError, scratch_path
from tidemark.sources import checks, season as ss
from tidemark.sources.catalog import ARCHIVE_STATS, CATALOG, DERIVED_PREFIX, LIVE_STATS, Dataset, lookup, register
from tidemark.sources.snapshot import HEARTBEAT, snapshot
from tidemark.sources.store import ObservationStore

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
ROW = "season string, round int, element int, fixture int, name string, position string, team string, value int, selected int, total_points int, minutes int, kickoff_time string"

if "t_open" not in CATALOG:
    register(Dataset("t_open", ("k",)))


def day(n):
    return T0 + timedelta(days=n)


@pytest.fixture
def store(spark):
    return ObservationStore(spark, scratch_path(spark, "t"))


def row(season="2023-24", round_=1, element=1, position="GKP", team="A", points=5):
    return (season, round_, element, 10 * round_, f"p{element}", position, team, 50, 100, points, 90, f"2024-01-{round_:02}T12:00:00Z")


def put(store, dataset, rows, n=0, **columns):
    df = store.spark.createDataFrame(rows, ROW).withColumns(columns)
    return store.write(dataset, df, valid_at=day(n), observed_at=day(n), source="s")


def test_every_observed_dataset_has_required_fields():
    observed = [d for n, d in CATALOG.items() if not n.startswith((DERIVED_PREFIX, "t_", "standin"))]
    assert len(observed) == 24 and all(d.required for d in observed)
    assert lookup("elements").minimum == ("id", "web_name", "team", "element_type", "now_cost", "selected_by_percent", "status")
    with pytest.raises(TidemarkError, match="required field"):
        Dataset("x", ("k",), valid_time="at")
    with pytest.raises(TidemarkError, match="without a valid-time"):
        Dataset("x", ("k",), valid_format="yyyy")


def test_void_columns_take_pinned_or_known_types(store, spark):
    put(store, LIVE_STATS, [row()], selected=F.lit(None), team=F.lit(None), nothing=F.lit(None))
    kinds = dict(store.scan(LIVE_STATS).dtypes)
    assert kinds["selected"] == "bigint" and kinds["team"] == "string" and "nothing" not in kinds
    for n, value in enumerate(("1.5D", "NULL")):
        df = spark.sql(f"SELECT {n} AS k, {value} AS v")
        store.write("t_open", df, valid_at=day(n), observed_at=day(n), source="s")
    assert checks.batch_fields(store, "t_open").filter("field = 'v'").select("dtype").distinct().collect() == [("double",)]
    assert [tuple(r) for r in store.as_of("t_open", day(3)).select("k", "v").orderBy("k").collect()] == [(0, 1.5), (1, None)]


def test_two_providers_each_by_its_own_time(store):
    assert ss.stats_effective_at(store, day(9)).columns == []
    put(store, ARCHIVE_STATS, [row(points=5), row(round_=2, points=6), row(season="2022-23", points=1)])
    alone = ss.stats_effective_at(store, day(9))
    assert {r["source_provider"] for r in alone.collect()} == {"archive"} and alone.filter("attribution_complete").count() == 3
    put(store, ARCHIVE_STATS, [row(points=7)], n=1)
    put(store, LIVE_STATS, [row(round_=3, points=8)], n=1, attribution_complete=F.lit(False), value=F.lit(None))
    read = lambda n, **more: sorted((r["season"], r["round"], r["total_points"], r["source_provider"], r["attribution_complete"], r["value"])
                                    for r in ss.stats_effective_at(store, day(n), **more).collect())
    assert read(9, season="2023-24") == [("2023-24", 1, 7, "archive", True, 50), ("2023-24", 2, 6, "archive", True, 50), ("2023-24", 3, 8, "live", False, None)]
    assert read(1, season="2023-24") == [("2023-24", 1, 7, "archive", True, 50)]  # the second round is played later that day
    assert read(9, season="2020-21") == []


def test_one_provider_alone(store):
    put(store, LIVE_STATS, [row()], attribution_complete=F.lit(True))
    assert [r["source_provider"] for r in ss.stats_effective_at(store, day(9)).collect()] == ["live"]


def test_season_load_refuses_what_cannot_be_used(store):
    with pytest.raises(TidemarkError, match="is empty"):
        ss.load_season(store, "2023-24")
    put(store, ARCHIVE_STATS, [row(), row(round_=3, element=2, position="AM"), row(round_=4, element=3, position="DEF"),
                               row(season="2019-20", position=None), row(season="2018-19", team=None)])
    with pytest.raises(TidemarkError, match=r"no rows .*\['2018-19', '2019-20', '2023-24'\]"):
        ss.load_season(store, "2001-02")
    with pytest.raises(TidemarkError, match=r"\['position'\] are NULL"):
        ss.load_season(store, "2019-20")
    with pytest.raises(TidemarkError, match=r"\['team'\] are NULL"):
        ss.load_season(store, "2018-19")
    loaded = ss.load_season(store, "2023-24", rounds=5)
    assert sorted((r["round"], r["position"]) for r in loaded.rows.collect()) == [(1, "GK"), (4, "DEF")]
    assert loaded.coverage.first()["missing_rounds"] == "2,3,5"
    with pytest.raises(TidemarkError, match="is empty"):
        ss.load_season(store, "2023-24", until=day(-1))


def test_season_load_names_missing_columns(store, spark):
    df = spark.createDataFrame([row()], ROW).drop("selected", "team")
    store.write(ARCHIVE_STATS, df, valid_at=T0, observed_at=T0, source="s")
    with pytest.raises(TidemarkError, match=r"missing required columns \['team', 'selected'\]"):
        ss.load_season(store, "2023-24")


def test_schema_findings_by_batch(store, spark):
    with pytest.raises(TidemarkError, match="never written"):
        checks.schema_findings(store, "teams")
    for n, text in enumerate(("1 AS id, 'a' AS name, 'b' AS short_name, 1.0D AS strength", "1L AS id, 'a' AS name, 'x' AS strength",
                              "1 AS id, array('a') AS name, 'b' AS short_name")):
        store.write("teams", spark.sql("SELECT " + text), valid_at=day(n), observed_at=day(n), source="s")
    order = {b: n for n, (b,) in enumerate(store.provenance("teams").orderBy("observed_at").select("batch_id").collect())}
    found = sorted((order[r["batch_id"]], r["field"], r["finding"]) for r in checks.schema_findings(store, "teams").collect())
    assert found == [(1, "short_name", "missing"), (1, "strength", "drift"), (2, "name", "nested")]


def test_provenance_findings_see_rows_that_the_manifest_does_not(store, spark):
    put(store, ARCHIVE_STATS, [row(), row(element=2)])
    assert [r["sound"] for r in checks.provenance_findings(store, ARCHIVE_STATS).collect()] == [True]
    stray = store.scan(ARCHIVE_STATS).limit(1).withColumns({"batch_id": F.lit(None).cast("string"), "content_hash": F.lit("other")})
    stray = spark.createDataFrame(stray.collect(), stray.schema)
    stray.write.mode("append").partitionBy("date").parquet(store.path(ARCHIVE_STATS))
    found = {r["batch_id"]: (r["rows_said"], r["rows_found"], r["rows_without_provenance"], r["sound"]) for r in checks.provenance_findings(store, ARCHIVE_STATS).collect()}
    assert found.pop(None) == (None, 1, 1, False) and list(found.values()) == [(2, 2, 0, True)]


def beats(store, at):
    return {r["target_dataset"]: (r["outcome"], r["n_rows"], r["error"]) for r in store.as_of(HEARTBEAT, day(9)).filter(F.dayofmonth("run_ts") == at).collect()}


def test_snapshot_writes_a_heartbeat_whatever_happens(store, spark):
    teams = spark.sql("SELECT 1 AS id, 'a' AS name, 'b' AS short_name")
    chips = spark.sql("SELECT 1 AS id, 'w' AS name")
    run = lambda n, fetch: snapshot(store, "boot", fetch, ("teams", "chips", "events"), at=day(n), source="s")
    assert set(run(0, lambda: {"teams": teams, "chips": chips})) == {"teams", "chips"}
    assert beats(store, 1) == {"teams": ("written", 1, None), "chips": ("written", 1, None), "events": ("failed", None, "the payload holds no such dataset")}
    run(1, lambda: {"teams": teams, "chips": chips.withColumn("name", F.lit("z"))})
    assert beats(store, 2)["teams"][0] == "skipped_unchanged" and beats(store, 2)["chips"][0] == "written"
    with pytest.raises(TidemarkError, match="missing required"):
        run(2, lambda: {"teams": teams, "chips": chips.drop("name")})
    assert beats(store, 3)["teams"][0] == "skipped_unchanged" and "missing required" in beats(store, 3)["chips"][2]

    def unreachable():
        raise OSError("no answer")

    with pytest.raises(OSError):
        run(3, unreachable)
    assert {v for v in beats(store, 4).values()} == {("failed", None, "OSError: no answer")}


def test_free_builds_are_returned(spark):
    rows = [("s", "a", 1, [1, 2], [], [1, 2]), ("s", "a", 2, [3], [1], [2, 3]), ("s", "a", 3, [], [], []), ("s", "a", 4, [5, 6], [], [5, 6])]
    df = spark.createDataFrame(rows, "season string, arm string, gameweek int, transfers_in array<int>, transfers_out array<int>, squad_element_ids array<int>")
    assert [tuple(r) for r in de.free_builds(df).orderBy("gameweek").collect()] == [("s", "a", 1, 2), ("s", "a", 4, 2)]
