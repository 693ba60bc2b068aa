"""Names and ids."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import identity as ident
from tidemark.operators.relational import union_widened
from tidemark.session import TidemarkError
from tidemark.sources import payloads as pa
from tidemark.sources import readers as rd


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t"))).first()[0]


@pytest.mark.parametrize("raw, want", [("Groß", "gross"), ("Ødegaard", "odegaard"), ("ESTÊVÃO", "estevao"), ("Łukasz Đ Æ", "lukasz d ae"), ("é", "e")])
def test_fold(spark, raw, want):
    assert one(spark, raw, tx.fold) == want


def test_fold_takes_ligatures_and_fractions(spark):
    assert one(spark, "Ĳssel ﬁnn ½", tx.fold) == "ijssel finn 1⁄2"
    assert one(spark, "Straße ﬆ", tx.fold) == "strasse st"


def test_keys(spark):
    assert one(spark, "  AFC Bournemouth ", tx.team_key) == "bournemouth"
    assert one(spark, "Brighton and Hove Albion", tx.team_key) == "brighton"
    assert one(spark, "O'Brien, J. Smith-Rowe", tx.player_key) == "o brien j smith-rowe"


def test_player_rungs(spark):
    squad = spark.createDataFrame([
        (1, 10, "Bukayo", "Saka", "Saka"), (2, 10, "Murillo", "Costa", "Murillo"), (3, 20, "Emile", "Smith Rowe", "Smith-Rowe"),
        (4, 20, "Ann", "Twin", "Twin"), (5, 10, "Bob", "Twin", "Twin"), (6, 30, "Far", "Away", "Away"),
    ], "id int, team_code int, first_name string, second_name string, web_name string")
    names = ["Bukayo Saka", "B. Sáka", "Murillo Santiago dos Santos", "X Smith-Rowe", "Cara Twin", "Far Away", "Ann Twin", ""]
    asked = spark.createDataFrame([(10, 20, n) for n in names], "home_team_code int, away_team_code int, player_name_raw string")
    got = {r["player_name_raw"]: (r["player_element_id"], r["rung"]) for r in ident.resolve_players(asked, squad).collect()}
    assert got == {"Bukayo Saka": (1, 1), "B. Sáka": (1, 2), "Murillo Santiago dos Santos": (2, 3), "X Smith-Rowe": (3, 2), "Cara Twin": (None, 2),
                   "Far Away": (None, None), "Ann Twin": (4, 1), "": (None, None)}
    kept = ident.attach_players(asked, ident.resolve_players(asked, squad))
    assert kept.count() == len(names) and kept.filter("NOT identity_resolved").count() == 3


def test_team_names(spark):
    teams = spark.createDataFrame([(1, "Man Utd"), (2, "Arsenal"), (3, "Leeds"), (4, "Leeds United")], "code int, name string")
    asked = spark.createDataFrame([("Manchester United",), ("Arsenal FC",), ("Leeds",), ("Nowhere",)], "team_name string")
    got = {r[0]: r[1] for r in ident.resolve_teams(asked, teams).collect()}
    assert got == {"Manchester United": 1, "Arsenal FC": 2, "Leeds": None, "Nowhere": None}


def test_player_map_fails_loudly(spark):
    rows = [(1, 100, "p100"), (2, 101, "p999"), (3, 100, "p100")]
    df = spark.createDataFrame(rows, "id int, code int, opta_code string")
    assert {(r["id"], r["reason"]) for r in ident.identity_failures(df).collect()} == {(1, "duplicate"), (2, "opta_code"), (3, "duplicate")}
    with pytest.raises(TidemarkError, match="identity check"):
        ident.player_map(df)


def test_renamed_club(spark):
    archive = spark.createDataFrame([("2020-21", 7, "Old"), ("2021-22", 7, "New"), ("2021-22", 8, "Other")], "season string, code int, name string")
    live = spark.createDataFrame([(8, "Live Other")], "code int, name string")
    got = {(r["season"], r["team"]): r["canonical"] for r in ident.canonical_names(archive, live).collect()}
    assert got == {("2020-21", "Old"): "New", ("2021-22", "New"): "New", ("2021-22", "Other"): "Live Other"}


def test_union_of_integers_and_text(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, only_a int"), spark.createDataFrame([("T7",)], "x string")
    assert {(r["x"], r["only_a"]) for r in union_widened([a, b]).collect()} == {("1", 2), ("T7", None)}


def test_payload_guards(spark):
    df = spark.createDataFrame([("m", '{"homeTeam": {"id": "1", "subs": [{"playerOnId": "5", "time": "60"}]}}')], "match_id string, payload string")
    with pytest.raises(Exception, match="playerOffId"):
        pa.substitutions(df).collect()


def test_stat_values(spark):
    payload = '[{"side": "Away", "stats": {"n": 3, "d": 1.5, "b": true, "o": {"z": 1, "a": "2"}, "t": "12", "nil": null}}]'
    rows = pa.team_match_stats(spark.createDataFrame([("m", payload)], "match_id string, payload string")).collect()
    got = {r["stat_key"]: (r["value"], r["value_raw"]) for r in rows}
    assert got == {"n": (3.0, None), "d": (1.5, None), "b": (None, "true"), "o": (None, '{"a":"2","z":1}'), "t": (None, '"12"'), "nil": (None, None)}


def test_corrupt_log_lines_are_left_out(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"season": "s", "arm": "a", "gameweek": 1, "transfers_in": [1]}\n{"season": "s", "ar\n{"season": "s", "arm": "b", "gameweek": 2}\n')
    assert sorted(r["gameweek"] for r in rd.read_decision_log(spark, str(path)).collect()) == [1, 2]


def test_csv_dates_stay_text(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("n,x,when\n1,0.5,2024-01-01\n2,,2024-02-01\n")
    assert dict(rd.read_csv(spark, str(path)).dtypes) == {"n": "int", "x": "double", "when": "string"}


def test_last_checkpoint_record_wins(spark):
    log = spark.createDataFrame([("u", 1, "failed"), ("u", 2, "written"), ("v", 1, "written")], "unit_key string, recorded_at int, outcome string")
    assert {r[0]: r[1] for r in rd.last_outcomes(log).collect()} == {"u": "written", "v": "written"}
