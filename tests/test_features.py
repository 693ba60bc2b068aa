"""Leakage, double rounds and the serving path."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as fe
from tidemark.plans import standins as st

COLUMNS = ("season string, round int, element bigint, fixture bigint, position string, team string, was_home boolean, kickoff timestamp_ntz, "
           "minutes int, starts int, value int, selected bigint, yellow_cards int, red_cards int, bps int, bonus int, "
           "team_h_score int, team_a_score int, goals_scored int, assists int, source_provider string, attribution_complete boolean")


def row(rnd, element, fixture, minutes=90, starts=1, position="MID", **over):
    base = dict(season="2024-25", round=rnd, element=element, fixture=fixture, position=position, team="A", was_home=True, minutes=minutes,
                starts=starts, value=50 + rnd, selected=1000 * rnd, yellow_cards=0, red_cards=0, bps=10 * rnd, bonus=rnd % 4, team_h_score=2,
                team_a_score=1, goals_scored=0, assists=0, source_provider="archive", attribution_complete=None)
    base.update(over)
    return base


@pytest.fixture
def build(spark):
    from datetime import datetime, timedelta

    def make(rows):
        for r in rows:
            r["kickoff"] = datetime(2024, 8, 1) + timedelta(days=7 * r["round"], hours=r["fixture"] % 5)
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], COLUMNS)

    return make


def history(n=8):
    return [row(r, 1, r, minutes=(0 if r % 3 == 0 else 90), starts=int(r % 3 > 0)) for r in range(1, n)] + [
        row(4, 1, 40, minutes=30, starts=0)] + [row(r, 2, r, position="GKP") for r in range(2, n)]


def features(df):
    return {(r["element"], r["round"], r["fixture"]): tuple(r[c] for c in ("trailing_start_rate_3", "trailing_minutes_mean_5", "games_played_this_season", "prev_gw_value"))
            for r in df.collect()}


def test_both_fixtures_of_a_round_share_history(build):
    f = features(fe.minutes_table(build(history())))
    assert f[(1, 4, 4)] == f[(1, 4, 40)]
    assert f[(1, 1, 1)] == (0.0, 0.0, 0.0, 0.0)
    assert f[(1, 5, 5)][1] == pytest.approx((90 + 90 + 0 + 120) / 4)


def test_future_rows_change_nothing(build):
    before = features(fe.minutes_table(build(history(6))))
    after = features(fe.minutes_table(build(history(6) + [row(9, 1, 90, minutes=17, starts=0), row(9, 2, 91)])))
    assert {k: v for k, v in after.items() if k[1] < 9} == before


def test_current_round_outcomes_change_nothing_in_their_own_row(build):
    rows = history(7)
    changed = [dict(r, minutes=1, starts=0) if r["round"] == 6 else dict(r) for r in rows]
    a, b = features(fe.minutes_table(build(rows))), features(fe.minutes_table(build(changed)))
    assert all(a[k] == b[k] for k in a if k[1] == 6)


def test_serving_equals_training(build):
    rows = history(8)
    trained = features(fe.minutes_table(build(rows)))
    past = build([r for r in rows if r["round"] < 7])
    spine = past.select("season", "element").distinct().withColumn("round", F.lit(7))
    served = {r["element"]: tuple(r[c] for c in ("trailing_start_rate_3", "trailing_minutes_mean_5", "games_played_this_season", "prev_gw_value"))
              for r in fe.serve_minutes(past, spine).collect()}
    assert served == {e: trained[(e, 7, 7)] for e in (1, 2)}


def test_excluded_rows(build):
    rows = [row(1, 1, 1), row(1, 2, 2, position="AM"), row(1, 3, 3, source_provider="live"), row(1, 4, 4, attribution_complete=False), row(1, 5, 5, position="GKP")]
    kept = {r["element"]: r["position"] for r in fe.eligible(build(rows)).collect()}
    assert kept == {1: "MID", 5: "GK"}
    assert fe.eligible(build(rows), allow_live=True).count() == 3


def test_rest_gap(build):
    rows = [row(1, 1, 1), row(1, 2, 1), row(2, 1, 2), row(2, 1, 4)]
    got = {(r["element"], r["fixture"]): (r["days_since_team_previous_fixture"], r["team_first_fixture_in_window"]) for r in fe.minutes_table(build(rows)).collect()}
    assert got[(1, 1)] == (7.0, True) and got[(2, 1)] == (7.0, True)
    assert got[(1, 2)][0] == pytest.approx(7 + 1 / 24)
    assert got[(1, 4)][0] == pytest.approx(2 / 24)


def test_two_cards_fail(build):
    with pytest.raises(Exception, match="both a yellow and a red"):
        fe.card_outcome(build([row(1, 1, 1, yellow_cards=1, red_cards=1)])).collect()


def test_more_goals_than_the_team_fail(build):
    with pytest.raises(Exception, match="exceed the team"):
        fe.possible_goals(fe.side_goals(build([row(1, 1, 1, goals_scored=3)]))).collect()


def test_idle_rounds_count_in_card_windows(build):
    rows = [row(1, 1, 1, yellow_cards=1), row(2, 1, 2, minutes=0), row(3, 1, 3)]
    got = {r["round"]: r["player_trailing_card_rate_3"] for r in fe.cards_table(build(rows)).collect()}
    assert got == {1: 0.0, 3: 0.5}


FAMILIES = {
    "minutes": (fe.minutes_table, fe.serve_minutes_fixtures, ("trailing_start_rate_3", "trailing_minutes_mean_5", "games_played_this_season", "prev_gw_value",
                                                              "prev_round_any_start", "cold_start", "days_since_team_previous_fixture", "team_first_fixture_in_window")),
    "attacking": (fe.attacking_table, fe.serve_attacking_fixtures, ("player_trailing_goals_3", "player_trailing_xa_10", "player_trailing_scored_rate_5", "cold_start")),
    "defensive": (lambda f: fe.defensive_table(f, {"DEF": 10, "MID_FWD": 12}), lambda *a: fe.serve_defensive_fixtures(*a, {"DEF": 10, "MID_FWD": 12}),
                  ("group", "player_trailing_count_5", "player_trailing_awarded_rate_5", "team_trailing_dc_mean_5", "team_cold_start", "is_forward")),
    "cards": (fe.cards_table, fe.serve_cards_fixtures, ("player_trailing_card_rate_10", "player_trailing_cards_class_rate_1_5", "team_trailing_cards_mean_5", "team_cold_start")),
    "saves": (fe.saves_table, fe.serve_saves_fixtures, ("player_trailing_saves_mean_3", "games_played_this_season", "cold_start")),
    "bonus": (fe.bonus_table, fe.serve_bonus_fixtures, ("player_trailing_bps_3", "player_trailing_bonus_class_rate_2_5", "team_trailing_bps_mean_5", "team_cold_start")),
}


@pytest.mark.parametrize("family", sorted(FAMILIES))
def test_serving_past_rounds_equals_training(spark, family):
    train, serve, columns = FAMILIES[family]
    facts = st.facts(spark, "/root/testdata/sf0.001").cache()
    roster = fe.eligible(facts).select("season", "element", "team", "position").distinct()
    fixtures = fe.eligible(facts).groupBy("season", "team", "round", "fixture", "kickoff").agg(F.max("was_home").alias("was_home"))
    keys = ["season", "element", "round", "fixture", "kickoff"]
    trained = {tuple(r[k] for k in keys): tuple(r[c] for c in columns) for r in train(facts).select(*keys, *columns).collect()}
    served = {tuple(r[k] for k in keys): tuple(r[c] for c in columns) for r in serve(facts, roster, fixtures).select(*keys, *columns).collect()}
    assert len(trained) > 50 and set(trained) <= set(served)
    assert all(served[k] == pytest.approx(v, nan_ok=True) if None not in v and "DEF" not in v and "MID_FWD" not in v else served[k] == v for k, v in trained.items())


def test_serving_newcomers_and_gaps_in_the_history(spark):
    """A player without rows is cold, rounds without matches see the rounds before them, scheduled fixtures set the gap."""
    rows = [("2020-21", r, 1, 10 + r, 90, 1) for r in (1, 2, 5)]
    day = "TIMESTAMP_NTZ '2020-09-01 15:00:00'"
    facts = spark.createDataFrame(rows, "season string, round int, element long, fixture long, minutes int, starts int").selectExpr(
        "*", "'A' as team", "'DEF' as position", "50 as value", "10L as selected", "'archive' as source_provider", "true as attribution_complete",
        f"{day} + make_dt_interval(7 * round) as kickoff")
    roster = spark.createDataFrame([("2020-21", 1, "A", "DEF"), ("2020-21", 2, "A", "GKP"), ("2020-21", 3, "B", "MID")], "season string, element long, team string, position string")
    fixtures = spark.createDataFrame([("2020-21", t, r, 100 + r, r % 2 == 0) for t in "AB" for r in (3, 6, 7)], "season string, team string, round int, fixture long, was_home boolean").selectExpr(
        "*", f"{day} + make_dt_interval(7 * round) as kickoff")
    got = {(r["element"], r["round"]): r for r in fe.serve_minutes_fixtures(facts, roster, fixtures).collect()}
    assert len(got) == 9 and {r["position"] for r in got.values()} == {"DEF", "GK", "MID"}
    assert [got[1, r]["games_played_this_season"] for r in (3, 6, 7)] == [2, 3, 3] and got[2, 6]["cold_start"] and got[2, 6]["prev_round_any_start"] is None
    assert [got[1, r]["days_since_team_previous_fixture"] for r in (3, 6, 7)] == [7, 7, 7] and got[3, 3]["team_first_fixture_in_window"]
    assert got[3, 6]["days_since_team_previous_fixture"] == 21
