"""Points from outcomes, award rules, squads, elevens and the scoring of decision tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.session import TidemarkError

# The game's appearance cliff and divisors.
MINUTE_CLIFF = 60
SAVES_PER_POINT = 3
CONCEDED_PER_POINT = 2

PER_POSITION = ("goals_scored", "clean_sheets", "goals_conceded", "defensive_contribution")
SCALAR = ("long_play", "short_play", "saves", "assists", "bonus", "yellow_cards", "red_cards", "own_goals",
          "penalties_saved", "penalties_missed")


@dataclass(frozen=True)
class SquadRules:
    """Fixed values of the game's squad rules; prices in tenths."""

    budget: int = 1000
    size: int = 15
    composition: Mapping[str, int] = field(default_factory=lambda: {"GK": 2, "DEF": 5, "MID": 5, "FWD": 3})
    eleven: Mapping[str, tuple[int, int]] = field(
        default_factory=lambda: {"GK": (1, 1), "DEF": (3, 5), "MID": (2, 5), "FWD": (1, 3)}
    )
    per_club: int = 3


def by_position(values: Mapping[str, object], position: Column | str = "position") -> Column:
    position = F.col(position) if isinstance(position, str) else position
    picked = None
    for name, value in values.items():
        picked = F.when(position == name, value) if picked is None else picked.when(position == name, value)
    return picked


# -- points ------------------------------------------------------------------------------------------

def scoring_config(config: DataFrame, payload: str = "payload") -> DataFrame:
    """The singleton JSON configuration as one row per position; a missing key fails the query."""
    scoring = F.from_json(F.col(payload), "STRUCT<scoring: MAP<STRING, STRING>>")["scoring"]

    def needed(value: Column, name: str) -> Column:
        return F.coalesce(value, F.raise_error(F.lit(f"scoring configuration lacks {name}")).cast("string"))

    parsed = config.select(scoring.alias("s"))
    positions = ("GKP", "DEF", "MID", "FWD")
    rows = parsed.select("s", F.explode(F.array(*[F.lit(p) for p in positions])).alias("p"))
    columns = [F.when(F.col("p") == "GKP", "GK").otherwise(F.col("p")).alias("position")]
    for key in PER_POSITION:
        table = F.from_json(needed(F.col("s")[key], key), "MAP<STRING, INT>")
        columns.append(needed(table[F.col("p")].cast("string"), f"a position of {key}").cast("int").alias(f"w_{key}"))
    for key in SCALAR:
        columns.append(needed(F.col("s")[key], key).cast("int").alias(f"w_{key}"))
    return rows.select(*columns)


def valid_outcome() -> Column:
    """A clean sheet needs the appearance cliff, counts are non-negative and bonus is at most three."""
    counts = ("minutes", "goals_scored", "assists", "goals_conceded", "own_goals", "penalties_saved",
              "penalties_missed", "yellow_cards", "red_cards", "saves", "bonus")
    ok = (F.col("clean_sheets") == 0) | (F.col("minutes") >= MINUTE_CLIFF)
    for c in counts:
        ok = ok & (F.col(c) >= 0)
    return ok & (F.col("bonus") <= 3)


def invalid_outcomes(outcomes: DataFrame, positions: Sequence[str] = ("GK", "DEF", "MID", "FWD")) -> DataFrame:
    return outcomes.filter(~valid_outcome() | F.col("position").isNull() | ~F.col("position").isin(*positions))


def score_outcomes(outcomes: DataFrame, config: DataFrame, out: str = "points") -> DataFrame:
    """One projection: outcomes joined to the four-row weight table. Broken outcomes fail the query."""
    m = F.col("minutes")
    known = outcomes.join(F.broadcast(config), "position", "left")
    points = (
        F.when(m >= MINUTE_CLIFF, F.col("w_long_play")).when(m > 0, F.col("w_short_play")).otherwise(0)
        + F.col("clean_sheets") * F.col("w_clean_sheets")
        + F.col("goals_scored") * F.col("w_goals_scored")
        + F.expr(f"goals_conceded div {CONCEDED_PER_POINT}") * F.col("w_goals_conceded")
        + F.expr(f"saves div {SAVES_PER_POINT}") * F.col("w_saves")
        + F.when(F.col("defensive_contribution_met"), F.col("w_defensive_contribution")).otherwise(0)
    )
    for key in ("assists", "own_goals", "penalties_saved", "penalties_missed", "yellow_cards", "red_cards", "bonus"):
        points = points + F.col(key) * F.col(f"w_{key}")
    checked = F.when(valid_outcome() & F.col("w_long_play").isNotNull(), points).otherwise(
        F.raise_error(F.lit("outcome breaks the scoring rules")).cast("bigint")
    )
    weights = [f"w_{k}" for k in (*PER_POSITION, *SCALAR)]
    return known.withColumn(out, checked.cast("bigint")).drop(*weights)


def zero_missing_weights(facts: DataFrame, columns: Sequence[str], key: str = "season") -> DataFrame:
    """Per season, the scoring weight multiplier of each statistic: 0 when the season never recorded it."""
    counts = facts.groupBy(key).agg(*[F.count(c).alias(c) for c in columns])
    return counts.select(key, *[F.when(F.col(c) == 0, 0).otherwise(1).alias(f"use_{c}") for c in columns])


# -- award by rank -----------------------------------------------------------------------------------

def award_levels(df: DataFrame, fixture: Sequence[str], score: str) -> DataFrame:
    """Award of each distinct score of a fixture: 3/2/1 by competition rank, equal scores share it."""
    levels = df.groupBy(*fixture, score).agg(F.count("*").alias("_n"))
    above = F.sum("_n").over(W.partitionBy(*fixture).orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, -1))
    rank = F.coalesce(above, F.lit(0)) + 1
    return levels.withColumn("award", F.greatest(F.lit(0), 4 - rank).cast("int")).drop("_n")


def award_points(df: DataFrame, fixture: Sequence[str], score: str = "bps") -> DataFrame:
    return df.join(award_levels(df, fixture, score), [*fixture, score])


# Rows that a task sorts, at most on average.
ROWS_SORTED = 250_000


def verify_awards(df: DataFrame, fixture: Sequence[str], score: str = "bps", awarded: str = "bonus") -> DataFrame:
    """Per fixture: does the rule reproduce the recorded awards? Fixtures of one player are skipped.

    Players with equal score and award behave alike, so the check runs on their counts. Whole fixtures are then dealt by the
    number of rows, as a task sorts its share; ``df`` is read twice.
    """
    counted = df.groupBy(*fixture, score, awarded).agg(F.count("*").alias("_c"))
    counted = counted.repartition(max(1, -(-df.count() // ROWS_SORTED)), *fixture)
    above = F.sum("_c").over(W.partitionBy(*fixture).orderBy(F.desc(score)).rangeBetween(W.unboundedPreceding, -1))
    rule = F.greatest(F.lit(0), 3 - F.coalesce(above, F.lit(0)))
    return (
        counted.withColumn("_rule", rule)
        .groupBy(*fixture)
        .agg(F.sum("_c").alias("n_players"),
             F.sum(F.when(F.col("_rule") != F.col(awarded), F.col("_c")).otherwise(0)).alias("n_mismatched"))
        .filter(F.col("n_players") > 1)
        .withColumn("matches", F.col("n_mismatched") == 0)
    )


# -- squads ------------------------------------------------------------------------------------------

def cheapest_per_position(pool: DataFrame, quotas: Mapping[str, int], group: Sequence[str] = (),
                          price: str = "value", entity: str = "element") -> DataFrame:
    """The k cheapest of each position, ties by id; the largest quota limits map tasks before the shuffle."""
    w = W.partitionBy(*group, "position").orderBy(price, entity)
    ranked = pool.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= max(quotas.values()))
    return ranked.filter(F.col("pick") <= by_position(quotas))


def choose_eleven(squads: DataFrame, decision: Sequence[str], value: str = "worth", entity: str = "element",
                  rules: SquadRules = SquadRules()) -> DataFrame:
    """Starting eleven, bench order, captain and vice by value; a squad is fifteen rows, so windows are small.

    Each position's minimum is filled first; the other places go to the best remaining players whose
    position still has room, which is the same as ranking those under the position maximum.
    """
    lows = {p: lo for p, (lo, _) in rules.eleven.items()}
    highs = {p: hi for p, (_, hi) in rules.eleven.items()}
    best = [F.desc(value), F.asc(entity)]
    placed = squads.withColumn("_pos", F.row_number().over(W.partitionBy(*decision, "position").orderBy(*best)))
    core = F.col("_pos") <= by_position(lows)
    open_place = ~core & (F.col("_pos") <= by_position(highs))
    placed = placed.withColumn("_core", core).withColumn("_open", open_place)
    fill = F.row_number().over(W.partitionBy(*decision, "_open").orderBy(*best))
    cores = F.sum(F.col("_core").cast("int")).over(W.partitionBy(*decision))
    placed = placed.withColumn("in_eleven", F.col("_core") | (F.col("_open") & (fill <= 11 - cores)))
    slot = F.row_number().over(W.partitionBy(*decision, "in_eleven").orderBy(*best))
    return (
        placed.withColumn("slot", slot)
        .withColumn("is_captain", F.col("in_eleven") & (F.col("slot") == 1))
        .withColumn("is_vice", F.col("in_eleven") & (F.col("slot") == 2))
        .drop("_pos", "_core", "_open")
    )


def squad_checks(squads: DataFrame, decision: Sequence[str], price: str = "value", entity: str = "element",
                 rules: SquadRules = SquadRules()) -> DataFrame:
    """Each decision's broken squad rules, one row per rule."""
    key = list(decision)
    whole = squads.groupBy(*key).agg(
        F.count("*").alias("n"), F.count_distinct(entity).alias("n_ids"), F.sum(price).alias("cost"),
        *[F.count_if(F.col("position") == p).alias(f"n_{p}") for p in rules.composition],
    )
    clubs = squads.groupBy(*key, "team").count().groupBy(*key).agg(F.max("count").alias("club"))
    checks = [
        ("size", F.col("n") != rules.size), ("duplicate", F.col("n_ids") != F.col("n")),
        ("budget", F.col("cost") > rules.budget), ("club_cap", F.col("club") > rules.per_club),
        *[(f"composition_{p}", F.col(f"n_{p}") != k) for p, k in rules.composition.items()],
    ]
    broken = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]), lambda c: c.isNotNull())
    return whole.join(clubs, key).select(*key, F.explode(broken).alias("broken_rule"))


# -- scoring decisions -------------------------------------------------------------------------------

_MOVES = "ARRAY<STRUCT<out: BIGINT, in: BIGINT>>"


def autosubs(squad: Column | str, rules: SquadRules = SquadRules()) -> Column:
    """The ordered substitutions of one squad, as an array of (out, in).

    A goalkeeper who did not play gives way to the reserve goalkeeper if that one did. Then, by slot, every outfield
    starter who did not play gives way to the first bench player in order who did, is still unused and leaves every
    position within its bounds. A fold over at most ten starters; its state is how many play in each position, who was
    brought on, and the moves so far.
    """
    lines = [name for name in rules.eleven if name != "GK"]
    squad = F.col(squad) if isinstance(squad, str) else squad
    named = F.array_sort(F.transform(squad, lambda p: F.struct(
        p["slot"].cast("int").alias("slot"), p["in_eleven"].alias("in_eleven"), p["position"].alias("position"), p["element"].cast("bigint").alias("element"), p["minutes"].alias("minutes"))))

    def side(starts: bool, keeper: bool) -> Column:
        return F.filter(named, lambda p: (p["in_eleven"] == starts) & ((p["position"] == "GK") == keeper))

    def move(leaves: Column, enters: Column) -> Column:
        return F.struct(leaves["element"].alias("out"), enters["element"].alias("in"))

    first, reserve = F.get(side(True, True), 0), F.get(side(False, True), 0)
    keeper = F.when((first["minutes"] == 0) & (reserve["minutes"] > 0), F.array(move(first, reserve)))
    idle = F.filter(side(True, False), lambda p: p["minutes"] == 0)
    ready = F.filter(side(False, False), lambda p: p["minutes"] > 0)

    def count(name: str) -> Column:
        return F.size(F.filter(side(True, False), lambda p: p["position"] == name))

    playing = F.map_from_arrays(F.array(*[F.lit(n) for n in lines]), F.array(*[count(n) for n in lines]))
    least, most = ({n: rules.eleven[n][k] for n in lines} for k in (0, 1))

    def fits(counts: Column, leaves: Column, enters: Column) -> Column:
        """A like-for-like move changes no count; any other takes one from a position and adds one to another."""
        same = (leaves["position"] == enters["position"]).cast("int")
        fewer, more = counts[leaves["position"]] - 1 + same, counts[enters["position"]] + 1 - same
        return (fewer >= by_position(least, leaves["position"])) & (more <= by_position(most, enters["position"]))

    def step(state: Column, leaves: Column) -> Column:
        able = F.filter(ready, lambda b: ~F.array_contains(state["used"], b["element"]) & fits(state["counts"], leaves, b))
        enters = F.get(able, 0)
        changed = F.transform_values(state["counts"], lambda n, c: c - (n == leaves["position"]).cast("int") + (n == enters["position"]).cast("int"))
        return F.when(enters.isNull(), state).otherwise(F.struct(
            changed.alias("counts"), F.array_append(state["used"], enters["element"]).alias("used"),
            F.array_append(state["moves"], move(leaves, enters)).alias("moves")))

    start = F.struct(playing.alias("counts"), F.expr("CAST(array() AS ARRAY<BIGINT>)").alias("used"), F.expr(f"CAST(array() AS {_MOVES})").alias("moves"))
    folded = F.aggregate(idle, start, step, lambda state: state["moves"])
    return F.concat(F.coalesce(keeper, F.expr(f"CAST(array() AS {_MOVES})")), folded)


def score_decisions(squads: DataFrame, outcomes: DataFrame, decision: Sequence[str] = ("season", "arm", "round"),
                    hits: DataFrame | None = None, rules: SquadRules = SquadRules(),
                    with_autosubs: bool = True) -> DataFrame:
    """Points of each decision: the (substituted) eleven, the captain again, and the signed hit points.

    ``squads``: fifteen rows per decision with in_eleven, slot, is_captain, is_vice. ``outcomes``: points
    and minutes per (season, round, element), already summed over fixtures. A squad becomes one row.
    """
    key = list(decision)
    played = squads.join(outcomes, ["season", "round", "element"], "left").select(
        *key, "in_eleven", "slot", "element", "position", "is_captain", "is_vice",
        F.coalesce("minutes", F.lit(0)).cast("bigint").alias("minutes"),
        F.coalesce("total_points", F.lit(0)).cast("bigint").alias("pts"),
    )
    member = F.struct("in_eleven", F.col("slot").cast("int").alias("slot"), F.col("element").cast("bigint").alias("element"),
                      "position", "minutes", "pts", "is_captain", "is_vice")
    one = played.groupBy(*key).agg(F.collect_list(member).alias("squad"))

    def total(kept) -> Column:
        return F.aggregate(F.filter("squad", kept), F.lit(0).cast("bigint"), lambda a, p: a + p["pts"])

    if with_autosubs:
        one = one.withColumn("subs", autosubs("squad", rules))
    else:
        one = one.withColumn("subs", F.expr("CAST(array() AS ARRAY<STRUCT<out: BIGINT, in: BIGINT>>)"))
    outs, ins = F.col("subs.out"), F.col("subs.in")
    base = total(lambda p: (p["in_eleven"] & ~F.array_contains(outs, p["element"])) | F.array_contains(ins, p["element"]))
    captain_played = F.exists("squad", lambda p: p["is_captain"] & (p["minutes"] > 0))
    captain = F.when(captain_played, total(lambda p: p["is_captain"])).otherwise(
        total(lambda p: p["is_vice"] & (p["minutes"] > 0))
    )
    scored = one.select(*key, base.alias("base_points"), captain.alias("captain_points"), F.size("subs").alias("n_subs"), "subs")
    if hits is not None:
        scored = scored.join(hits.select(*key, "hit_points"), key, "left")
    else:
        scored = scored.withColumn("hit_points", F.lit(0))
    return scored.withColumn("hit_points", F.coalesce("hit_points", F.lit(0))).withColumn(
        "points", F.col("base_points") + F.col("captain_points") + F.col("hit_points")
    )


def round_outcomes(facts: DataFrame, key: Sequence[str] = ("season", "round", "element")) -> DataFrame:
    return facts.groupBy(*key).agg(F.sum("total_points").alias("total_points"), F.sum("minutes").alias("minutes"))


# -- signals -----------------------------------------------------------------------------------------

def seeded_uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) fixed by its parts, the same on every run and every engine with MD5."""
    digest = F.md5(F.concat_ws(":", *[F.col(p) if isinstance(p, str) else p for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sample_entities(df: DataFrame, entity: str, seed: int, n: int) -> DataFrame:
    """A reproducible sample of n entities."""
    ids = df.select(entity).distinct()
    return ids.withColumn("_u", seeded_uniform(entity, F.lit(str(seed)))).orderBy("_u", entity).limit(n).drop("_u")


def previous_round_ownership(facts: DataFrame, round_number: int) -> DataFrame:
    """Ownership on each element's first row of the round before."""
    rows = facts.filter(F.col("round") == round_number - 1)
    first = F.min(F.struct("fixture", "selected"))["selected"]
    return rows.groupBy("season", "element").agg(first.alias("signal"))


def form(facts: DataFrame, round_number: int, rounds: int = 4) -> DataFrame:
    """Points of the rounds just before."""
    recent = facts.filter(F.col("round").between(round_number - rounds, round_number - 1))
    return recent.groupBy("season", "element").agg(F.sum("total_points").alias("signal"))


def candidates(pool: DataFrame, held: DataFrame, history: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The round's candidates plus held entities that are absent from it, with their last known attributes.

    A held entity without any history keeps NULL attributes; absent entities expect zero points.
    """
    last = F.max(F.struct("round", "fixture", *columns)).alias("_last")
    known = history.join(held.select("element").distinct(), "element", "left_semi").groupBy("element").agg(last)
    absent = held.select("element").distinct().join(pool.select("element"), "element", "left_anti").join(
        known, "element", "left"
    )
    filled = absent.select("element", *[F.col(f"_last.{c}").alias(c) for c in columns], F.lit(0.0).alias("expected"),
                           F.lit(True).alias("from_history"))
    return pool.select("element", *columns, "expected", F.lit(False).alias("from_history")).unionByName(filled)
