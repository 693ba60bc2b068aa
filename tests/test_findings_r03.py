"""Steps that the third round's findings named: how often inputs are read, and how many rows a task takes."""

from datetime import datetime, timedelta, timezone

import pyarrow.dataset as ds
from pyspark.sql import functions as F

from tidemark.functions.maths import half_up
from tidemark.operators import class_models as cm
from tidemark.operators import features as fe
from tidemark.operators import rollups as ro
from tidemark.plans import q_models, q_sources
from tidemark.session import TidemarkError, scratch_path
from tidemark.sources import season as ss
from tidemark.sources import store as stores
from tidemark.sources.catalog import ARCHIVE_STATS, CATALOG, Dataset, register
from tidemark.sources.store import ObservationStore

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)

if "t_r3_log" not in CATALOG:
    register(Dataset("t_r3_log", ("k",), ("v", "v_at"), valid_time="v_at"))


def stored(spark, *batches):
    store = ObservationStore(spark, scratch_path(spark, "r3"))
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "k int, v int, v_at timestamp_ntz")
        store.write("t_r3_log", df, valid_at=T0 + timedelta(hours=n), observed_at=T0 + timedelta(hours=n), source="s")
    return store


def test_newest_rows_are_taken_in_tasks_that_follow_the_row_count(spark, monkeypatch):
    moment = datetime(2023, 1, 1)
    store = stored(spark, [(i, 0, moment) for i in range(8)], [(i, 1, moment) for i in range(0, 8, 2)])
    monkeypatch.setattr(stores, "FEW", 3)
    late = T0 + timedelta(days=1)
    for state in (store.as_of("t_r3_log", late), store.effective_at("t_r3_log", late), store.latest("t_r3_log")):
        assert state.rdd.getNumPartitions() == 4  # twelve rows, three a task
        assert {r["k"]: r["v"] for r in state.collect()} == {i: 1 - i % 2 for i in range(8)}
    monkeypatch.setattr(stores, "UNSORTED", 2)
    assert store.as_of("t_r3_log", late).rdd.getNumPartitions() == 2
    monkeypatch.setattr(stores, "MANY", 4)
    assert store.as_of("t_r3_log", late).rdd.getNumPartitions() == 3


def test_the_referees_matches_are_made_once(spark):
    """The mean, the bounds of the slices and the slices read a written table: the facts' own rows are read by one rollup."""
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    day = datetime(2024, 1, 1)
    rows = [("2023-24", n, n, n % 2, day + timedelta(days=n), home, n % 3, 0) for n in range(12) for home in (True, False)]
    plain = spark.createDataFrame(rows, "season string, round int, fixture long, opponent_team int, kickoff timestamp_ntz, was_home boolean, "
                                        "yellow_cards int, red_cards int")
    facts = plain.mapInPandas(counted, plain.schema)
    identity = spark.createDataFrame([("2023-24", 0, 100), ("2023-24", 1, 101)], "season string, id int, code int")
    fixtures = spark.createDataFrame([(n, day + timedelta(days=n), 100 + n % 2) for n in range(12)], "match_id long, kickoff timestamp_ntz, away_team_code int")
    officials = spark.createDataFrame([(n, True, "R") for n in range(12)], "match_id long, is_referee boolean, official_name string")
    trailed = fe.referee_trailing(ro.resolved_referees(facts, identity, fixtures, officials)).orderBy("fixture").collect()
    cards = [2 * (n % 3) for n in range(12)]
    before = [sum(cards[max(0, n - 10):n]) / min(n, 10) if n else sum(cards) / 12 for n in range(12)]
    assert [r["match_total_cards"] for r in trailed] == cards
    assert [round(r["referee_trailing_cards_per_match_10"], 9) for r in trailed] == [round(b, 9) for b in before]
    assert reads.value == len(rows)


def test_a_fixed_batch_is_not_copied_and_keeps_its_hash(spark, monkeypatch):
    rows = spark.range(5).selectExpr("CAST(id AS INT) AS k", "CAST(id AS INT) AS v", "NULL AS nothing", "TIMESTAMP_NTZ'2023-01-01' AS v_at")
    store = ObservationStore(spark, scratch_path(spark, "r3"))
    first = store.write("t_r3_log", rows, valid_at=T0, observed_at=T0, source="s")
    monkeypatch.setattr(stores, "settle", lambda df: (_ for _ in ()).throw(TidemarkError("copied")))
    again = store.write("t_r3_log", rows, valid_at=T0, observed_at=T0 + timedelta(hours=1), source="s", fixed=True)
    assert first.written and not again.written and first.content_hash == again.content_hash
    digests = [r["d"] for r in rows.select(stores.row_digest(rows.columns).alias("d")).collect()]
    assert tuple(map(int, stores.hash_parts(rows).first())) == (5, sum(int(d[:15], 16) for d in digests), sum(int(d[15:30], 16) for d in digests))


def test_the_appearances_of_both_providers_are_rolled_up_once(spark, monkeypatch):
    calls, facts = [], q_sources.st.facts
    monkeypatch.setattr(q_sources.st, "facts", lambda *args: calls.append(args) or facts(*args))
    q_sources.two_providers_effective(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_half_up_is_round_without_its_digits(spark):
    values = [None, 0.0, -0.0, 0.5, 1.5, -0.5, 2.5, -2.5, 0.49999999999999994, 28.499999999999996, 0.1234565, -0.1234565, 1.0000005, 1 / 3, -2 / 3, 1e-9,
              -1e-9, 12345678.9012345, 1e12 + 0.5, 4503599627370495.5, 1e300, float("inf"), float("nan"), 0.285 * 100, 1.005 * 100]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (0, 3, 6):
        for r in df.select("v", half_up(F.col("v"), places).alias("got"), F.round("v", places).alias("want")).collect():
            assert repr(r["got"]) == repr(r["want"]), r["v"]


def test_the_served_fixtures_are_made_once(spark):
    """The players' spine, the teams' and the served rows read a written table: roster and schedule are read once."""
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    facts = q_sources.st.facts(spark, "/root/testdata/sf0.001")
    plain = spark.createDataFrame([("1996-97", e, "T3", "DEF") for e in range(1, 6)], "season string, element long, team string, position string")
    fixtures = spark.createDataFrame([("1996-97", "T3", 60, 1, datetime(1997, 1, 1), True), ("1996-97", "T3", 61, 2, datetime(1997, 1, 8), False)],
                                     "season string, team string, round int, fixture long, kickoff timestamp_ntz, was_home boolean")
    served = fe.serve_bonus_fixtures(facts, plain.mapInPandas(counted, plain.schema), fixtures).collect()
    assert len(served) == 10 and reads.value == 5


def test_class_models_take_equal_rows_once(spark):
    """Rows with a weight give the fits and the path of the rows repeated; a NULL feature is counted and has no loss."""
    rows = [(f, float(x), y, 1.0, 1 + (3 * f + x + y) % 4) for f in range(4) for x in range(3) for y in (0, 1)] + [(3, None, 1, 1.0, 5)]
    cells = spark.createDataFrame(rows, "fold int, x double, y int, one double, n long")
    every = cells.select("*", F.explode(F.sequence(F.lit(1), "n"))).drop("n", "col")
    both = [(cm.fit_class_folds(df, ["one", "x"], "y", 2, [0.1, 10.0], [2, 3], weight=w), df, w) for df, w in ((cells, "n"), (every, None))]
    fits = [sorted((r["fold"], r["l2"], r["n"], *[round(v, 9) for v in r["weights"]]) for r in f.collect()) for f, _, _ in both]
    paths = [sorted((r["l2"], r["n"], round(r["log_loss"], 9), round(r["brier"], 9), r["is_best"]) for r in
             cm.penalty_path(cm.class_predictions(df, f, ["one", "x"], 2, [2, 3]), weight=w).collect()) for f, df, w in both]
    assert fits[0] == fits[1] and paths[0] == paths[1] and len(paths[0]) == 2


def test_class_penalty_path_fits_cells_not_rows(spark):
    sf = "/root/testdata/sf0.001"
    cells = q_models.starts(spark, sf)
    table = fe.minutes_table(q_sources.st.facts(spark, sf)).select(F.substring("season", 1, 4).cast("int"), (F.round("trailing_minutes_mean_5", 3) / 90), F.col("starts").cast("int"))
    want = {}
    for r in table.collect():
        want[tuple(r)] = want.get(tuple(r), 0) + 1
    got = [((r["fold"], r["x"], r["y"]), r["n"]) for r in cells.collect()]
    assert len(got) == len(want) and dict(got) == want


def test_a_season_is_read_once_for_its_checks_and_coverage(spark):
    """The coverage comes from the rollup that the checks read, and equal seasons lie together in the files."""
    store = ObservationStore(spark, scratch_path(spark, "r3"))
    rows = [(f"20{20 + n % 3}-{21 + n % 3}", 1 + n % 7, n, "p", "AM" if n % 7 == 6 else "GKP", "t", 40, 1, 2, 90, n) for n in range(210)]
    store.write(ARCHIVE_STATS, spark.createDataFrame(rows, "season string, round int, element int, name string, position string, team string, value int, "
                                                           "selected int, total_points int, minutes int, fixture int").coalesce(2),
                valid_at=T0, observed_at=T0, source="s", together=["season"])
    for fragment in ds.dataset(store.path(ARCHIVE_STATS), format="parquet", exclude_invalid_files=True).get_fragments():
        if "_manifest" not in fragment.path:
            seasons = fragment.to_table(columns=["season"])["season"].to_pylist()
            assert seasons == sorted(seasons) and len(set(seasons)) == 3
    loaded = ss.load_season(store, "2021-22", rounds=8)
    assert loaded.coverage.inputFiles() == [] and loaded.rows.inputFiles() != []
    found = loaded.coverage.first()
    assert (found["n_present"], found["missing_rounds"]) == (6, "7,8") and loaded.rows.count() == 60


def test_appearances_keep_the_least_texts_of_doubled_suppliers(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    supplier = spark.read.parquet(f"{sf}/supplier.parquet")
    again = supplier.filter("s_suppkey % 3 = 0").withColumns({"s_name": F.concat(F.lit("A"), "s_name"), "s_nationkey": (F.col("s_nationkey") + 7) % 25})
    supplier.unionByName(again).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.read.parquet(f"{sf}/lineitem.parquet").write.parquet(f"{tmp_path}/lineitem.parquet")
    keys, texts = ["source_provider", "season", "round", "element", "fixture"], ["name", "position", "team", "kickoff_time"]
    got = q_sources.appearances(spark, str(tmp_path), "source_provider")
    want = q_sources.st.facts(spark, str(tmp_path)).groupBy(*keys).agg(*[F.min(c).alias(c) for c in texts], F.sum("total_points").alias("total_points"))
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect())
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortAggregate") == plan.count("SortAggregate(key=[element")  # only the suppliers' own
