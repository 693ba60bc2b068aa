"""Rules of the game: points, elevens, substitutions, ledgers and logs."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import decisions as de
from tidemark.operators import scoring as sc
from tidemark.plans.q_scoring import PAYLOAD

RULES = sc.SquadRules()
OUTCOME = ("position string, minutes int, clean_sheets int, goals_scored int, assists int, goals_conceded int, own_goals int, penalties_saved int, "
           "penalties_missed int, yellow_cards int, red_cards int, saves int, bonus int, defensive_contribution_met boolean")


def points(spark, **over):
    names = [c.split()[0] for c in OUTCOME.split(", ")]
    base = {n: 0 for n in names} | {"position": "MID", "minutes": 90, "defensive_contribution_met": False} | over
    config = sc.scoring_config(spark.createDataFrame([(PAYLOAD,)], "payload string"))
    return sc.score_outcomes(spark.createDataFrame([tuple(base[n] for n in names)], OUTCOME), config).first()["points"]


def test_points(spark):
    assert points(spark, minutes=59) == 1
    assert points(spark, minutes=60, clean_sheets=1, position="DEF") == 6
    assert points(spark, goals_conceded=3, saves=7, position="GK") == 2 - 1 + 2
    assert points(spark, goals_conceded=3) == 2
    assert points(spark, defensive_contribution_met=True, position="FWD") == 4
    with pytest.raises(Exception, match="breaks the scoring rules"):
        points(spark, minutes=59, clean_sheets=1)
    with pytest.raises(Exception, match="breaks the scoring rules"):
        points(spark, position="AM")


def test_missing_configuration_key(spark):
    broken = spark.createDataFrame([(PAYLOAD.replace('"saves": 1, ', ""),)], "payload string")
    with pytest.raises(Exception, match="lacks saves"):
        sc.scoring_config(broken).collect()


def test_award_ties(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([50, 50, 40, 40, 30])] + [(2, 9, 5)], "fixture int, element int, bps int")
    got = {r["element"]: r["award"] for r in sc.award_points(df, ["fixture"]).collect()}
    assert got == {0: 3, 1: 3, 2: 1, 3: 1, 4: 0, 9: 3}


def squad_rows(rng, arm):
    quota = [("GK", 2), ("DEF", 5), ("MID", 5), ("FWD", 3)]
    ids = rng.sample(range(1000), 15)
    return [("s", arm, 1, ids.pop(), p, f"T{rng.randrange(9)}", rng.randrange(40, 90), rng.randrange(12)) for p, n in quota for _ in range(n)]


def greedy_eleven(rows):
    """Minimum of every position first, then the best others while the position has room."""
    order = sorted(rows, key=lambda r: (-r[7], r[3]))
    chosen, used = [], {p: 0 for p in RULES.eleven}
    for r in order:
        if used[r[4]] < RULES.eleven[r[4]][0]:
            chosen.append(r)
            used[r[4]] += 1
    for r in order:
        if r not in chosen and len(chosen) < 11 and used[r[4]] < RULES.eleven[r[4]][1]:
            chosen.append(r)
            used[r[4]] += 1
    return {r[3] for r in chosen}


SQUAD = "season string, arm int, round int, element bigint, position string, team string, value int, worth int"


@pytest.fixture(scope="module")
def squads(spark):
    rng = random.Random(11)
    rows = [r for arm in range(60) for r in squad_rows(rng, arm)]
    return rows, spark.createDataFrame(rows, SQUAD).cache()


def test_eleven_against_greedy(squads):
    rows, df = squads
    got = sc.choose_eleven(df, ["season", "arm", "round"]).collect()
    for arm in range(60):
        own = [r for r in rows if r[1] == arm]
        assert {r["element"] for r in got if r["arm"] == arm and r["in_eleven"]} == greedy_eleven(own)
        captain = min((r for r in own if r[3] in greedy_eleven(own)), key=lambda r: (-r[7], r[3]))
        assert [r["element"] for r in got if r["arm"] == arm and r["is_captain"]] == [captain[3]]


def substituted(squad, minutes):
    """Straight-line restatement of the substitution rule for one squad."""
    first = sorted((p for p in squad if p["in_eleven"]), key=lambda p: p["slot"])
    bench = sorted((p for p in squad if not p["in_eleven"]), key=lambda p: p["slot"])
    field = {p["element"]: p["position"] for p in first}
    spent = set()
    for p in first:
        if minutes[p["element"]] > 0:
            continue
        for b in bench:
            if b["element"] in spent or minutes[b["element"]] == 0 or (p["position"] == "GK") != (b["position"] == "GK"):
                continue
            trial = {k: v for k, v in field.items() if k != p["element"]} | {b["element"]: b["position"]}
            counts = {q: list(trial.values()).count(q) for q in RULES.eleven}
            if counts[p["position"]] >= RULES.eleven[p["position"]][0] and counts[b["position"]] <= RULES.eleven[b["position"]][1]:
                field = trial
                spent.add(b["element"])
                break
    return set(field)


def test_decision_scores_against_brute_force(spark, squads):
    rows, df = squads
    rng = random.Random(5)
    minutes = {r[3]: rng.choice([0, 0, 90, 45]) for r in rows}
    pts = {e: (0 if mins == 0 else rng.randrange(-1, 15)) for e, mins in minutes.items()}
    chosen = sc.choose_eleven(df, ["season", "arm", "round"])
    outcomes = spark.createDataFrame([("s", 1, e, pts[e], mins) for e, mins in minutes.items()], "season string, round int, element bigint, total_points int, minutes int")
    hits = spark.createDataFrame([("s", 3, 1, -8)], "season string, arm int, round int, hit_points int")
    got = {r["arm"]: r for r in sc.score_decisions(chosen, outcomes, hits=hits).collect()}
    by_arm = {}
    for r in chosen.collect():
        by_arm.setdefault(r["arm"], []).append(r.asDict())
    for arm, squad in by_arm.items():
        active = substituted(squad, minutes)
        lead = next(p["element"] for p in squad if p["is_captain"])
        vice = next(p["element"] for p in squad if p["is_vice"])
        bonus = pts[lead] if minutes[lead] > 0 else pts[vice] if minutes[vice] > 0 else 0
        assert got[arm]["points"] == sum(pts[e] for e in active) + bonus + (-8 if arm == 3 else 0)
        assert len(active) == 11


def test_squad_rules(spark, squads):
    rows, _ = squads
    one = [r for r in rows if r[1] == 0]
    broken = [(*one[0][:3], one[1][3], *one[0][4:]), *one[1:]]
    df = spark.createDataFrame(broken, SQUAD).withColumn("value", F.lit(100)).withColumn("team", F.lit("T"))
    assert {r["broken_rule"] for r in sc.squad_checks(df, ["season", "arm", "round"]).collect()} == {"duplicate", "budget", "club_cap"}


def test_sell_price(spark):
    df = spark.createDataFrame([(50, 53), (50, 47), (50, 50), (50, 54)], "p int, c int")
    assert [r[0] for r in df.select(de.sell_price(F.col("p"), F.col("c"))).collect()] == [51, 47, 50, 52]


def test_bank_caps_spending_and_top_up(spark):
    n = [0, 0, 0, 3, 1, 0, 0]
    df = spark.createDataFrame([("s", "a", i + 1, v) for i, v in enumerate(n)], "season string, arm string, round int, n_transfers int")
    got = de.free_transfer_bank(df, cap=2, top_ups={6: 5}).orderBy("round").collect()
    assert [r["free"] for r in got] == [1, 2, 2, 2, 1, 5, 2]
    assert [r["hit_points"] for r in got] == [0, 0, 0, -4, 0, 0, 0]


LOG = "season string, arm string, gameweek int, transfers_in array<bigint>, transfers_out array<bigint>, squad_element_ids array<bigint>, hit_points int"


def test_holds_and_round_trips(spark):
    rows = [
        ("s", "a", 3, [1, 2, 3], [], [1, 2, 3], 0),
        ("s", "a", 4, [4], [1], [2, 3, 4], 0),
        ("s", "a", 6, [1], [4], [1, 2, 3], 0),
        ("s", "a", 7, [5], [2], [1, 3, 5], -4),
        ("s", "a", 9, [], [1], [3, 5], 0),
    ]
    df = spark.createDataFrame(rows, LOG)
    lengths = de.hold_lengths(df).first()
    assert (lengths["count"], lengths["mean"], lengths["censored_count"], lengths["initial_squad_sales"]) == (2, 2.5, 1, 2)
    c = de.churn(df).first()
    assert (c["total_purchases"], c["lt_1"], c["lt_3"], c["lt_6"]) == (3, 0.0, pytest.approx(1 / 3), pytest.approx(2 / 3))
    trip = de.round_trips(df).first()
    assert (trip["count"], trip["median"]) == (1, 2.0)
    assert [r["n_transfers"] for r in de.transfer_counts(df).orderBy("gameweek").collect()] == [0, 1, 1, 1, 1]
    bad = [r.asDict() for r in de.continuity_checks(df).filter("squad_differs OR sold_not_held > 0 OR bought_not_in_squad > 0").collect()]
    assert bad == []


def test_continuity_findings(spark):
    rows = [("s", "a", 1, [1, 2], [], [1, 2], 0), ("s", "a", 2, [3], [9], [1, 4], 0)]
    row = de.continuity_checks(spark.createDataFrame(rows, LOG)).first()
    assert (row["sold_not_held"], row["bought_not_in_squad"], row["squad_differs"]) == (1, 1, True)


def test_ledger(spark):
    moves = [("s", "a", 1, 7, 1, 60), ("s", "a", 3, 7, 0, 65), ("s", "a", 3, 8, 1, 70), ("s", "a", 5, 7, 1, 66)]
    df = spark.createDataFrame(moves, "season string, arm string, gameweek int, element int, is_in int, price int")
    got = de.cash_ledger(df, 100).orderBy("gameweek").collect()
    assert [(r["bank"], r["overspent"]) for r in got] == [(40, False), (32, False), (-34, True)]


def test_fixtures_are_dealt_by_the_number_of_rows(spark, monkeypatch):
    from tidemark.operators import scoring

    monkeypatch.setattr(scoring, "ROWS_SORTED", 100, raising=False)
    df = spark.range(0, 1000, 1, 1).selectExpr("id div 4 AS fixture", "id % 4 AS bps", "cast(id % 4 AS int) AS bonus")
    checked = scoring.verify_awards(df, ["fixture"])
    assert checked.rdd.getNumPartitions() == 10
    assert checked.filter("matches AND n_players = 4").count() == 250
