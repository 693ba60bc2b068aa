"""Entity resolution: id maps, canonical names, name resolvers and source priority."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions.text import MIN_TOKEN, last_token, player_key, team_key, tokens
from tidemark.session import TidemarkError, settle

# Long club names and the short names they stand for.
TEAM_ALIASES = {
    "manchester united": "Man Utd",
    "manchester city": "Man City",
    "tottenham hotspur": "Spurs",
    "nottingham forest": "Nott'm Forest",
}


def require_none(findings: DataFrame, message: str) -> None:
    """Raise with a few examples when a check has findings."""
    examples = findings.limit(5).collect()
    if examples:
        raise TidemarkError(f"{message}, for example {[r.asDict() for r in examples]}")


def identity_failures(elements: DataFrame) -> DataFrame:
    """Rows whose opta code is not ``p`` + code, or whose id or code is missing or shared.

    Sharing is found on pre-counted keys, so a code repeated by most rows stays cheap.
    """
    def shared(c: str) -> DataFrame:
        return elements.groupBy(c).agg((F.count("*") > 1).alias(f"_{c}"))

    ok = F.coalesce(F.col("opta_code") == F.concat(F.lit("p"), F.col("code").cast("string")), F.lit(False))
    joined = elements.join(shared("code"), "code", "left").join(shared("id"), "id", "left")
    twice = F.coalesce(F.col("_code"), F.lit(False)) | F.coalesce(F.col("_id"), F.lit(False))
    reason = F.when(~ok | F.col("id").isNull(), "opta_code").when(twice, "duplicate")
    return joined.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("id", "code", "opta_code", "reason")


def player_map(elements: DataFrame) -> DataFrame:
    require_none(identity_failures(elements), "elements failed the player identity check")
    return elements.select(F.col("code").alias("player_code"), F.col("id").alias("element"))


def season_map(live: DataFrame, archive: DataFrame, current_season: str) -> DataFrame:
    """Identity rows keyed by season: the live snapshot for the current season, the archive for the others."""
    return live.withColumn("season", F.lit(current_season)).unionByName(
        archive.filter(F.col("season") != current_season), allowMissingColumns=True
    )


def team_map(teams: DataFrame, others: DataFrame) -> DataFrame:
    """Both sides' team ids: the id decides, the names only warn, a missing partner is unmatched."""
    right = others.select(F.col("id").cast("string").alias("other_id"), F.col("name").alias("other_name"))
    joined = teams.withColumn("other_id", F.col("code").cast("string")).join(
        right.withColumn("_found", F.lit(True)), "other_id", "left"
    )
    a, b = team_key(F.col("name")), team_key(F.col("other_name"))
    return joined.select(
        "code", "name", "other_id", "other_name", F.coalesce("_found", F.lit(False)).alias("matched"),
        (F.col("_found") & ~F.contains(a, b) & ~F.contains(b, a)).alias("name_differs"),
    )


def canonical_names(archive: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """(season, team name) -> canonical: the live name of its code, else the newest archived one."""
    known = archive.filter(F.col("season").isNotNull() & F.col("code").isNotNull() & F.col("name").isNotNull())
    newest = known.groupBy("code").agg(F.max(F.struct("season", "name"))["name"].alias("canonical"))
    if live is not None:
        now = live.groupBy("code").agg(F.max("name").alias("_live"))
        newest = newest.join(now, "code", "left").select("code", F.coalesce("_live", "canonical").alias("canonical"))
    return known.groupBy("season", F.col("name").alias("team")).agg(F.max("code").alias("code")).join(newest, "code").select(
        "season", "team", "canonical"
    )


def resolve_teams(names: DataFrame, teams: DataFrame, column: str = "team_name",
                  aliases: Mapping[str, str] = TEAM_ALIASES) -> DataFrame:
    """Code of each distinct name: alias, then the only team with the same key; NULL when neither decides."""
    spark = names.sparkSession
    known = teams.filter(F.col("code").isNotNull() & F.col("name").isNotNull())
    alias_rows = spark.createDataFrame(sorted(aliases.items()), "_raw string, _target string")
    exact = known.groupBy(F.col("name").alias("_target")).agg(F.max("code").alias("_alias_code"))
    by_alias = F.broadcast(alias_rows.join(exact, "_target").select("_raw", "_alias_code"))  # one row per alias
    by_key = known.groupBy(team_key(F.col("name")).alias("_key")).agg(
        F.min("code").alias("_key_code"), F.count("*").alias("_n")
    )
    distinct = names.select(column).distinct()
    tagged = distinct.withColumn("_raw", F.lower(F.trim(column))).withColumn("_key", team_key(F.col(column)))
    joined = tagged.join(by_alias, "_raw", "left").join(by_key, "_key", "left")
    return joined.select(
        column, F.coalesce("_alias_code", F.when(F.col("_n") == 1, F.col("_key_code"))).alias("team_code")
    )


def resolve_players(names: DataFrame, elements: DataFrame, name: str = "player_name_raw") -> DataFrame:
    """Element of each (home, away, name) by three rungs: whole key, last word, any long word.

    The first rung with a candidate decides, and only when it names exactly one element of the two squads.
    ``names``: home_team_code, away_team_code and the raw name. ``elements``: id, team_code, first_name,
    second_name, web_name.
    """
    who = ["home_team_code", "away_team_code", name]
    everyone = settle(names.select(*who).distinct())  # each rung reads the distinct names, not all the quotes
    asked = everyone.withColumn("_key", player_key(F.col(name))).filter(F.col("_key") != "")
    asked = asked.withColumn("team_code", F.explode(F.array_distinct(F.array("home_team_code", "away_team_code"))))

    whole = elements.select("team_code", F.col("id").alias("_id"), player_key(F.concat_ws(" ", "first_name", "second_name")).alias("_part"))
    web = player_key(F.col("web_name"))
    words = elements.select("team_code", F.col("id").alias("_id"), F.explode(
        F.array_distinct(F.concat(F.array(web), tokens(web)))).alias("_part")).distinct()
    rungs = [
        (1, asked.withColumn("_part", F.col("_key")), whole),
        (2, asked.withColumn("_part", last_token(F.col("_key"))), words),
        (3, asked.withColumn("_part", F.explode(F.array_distinct(tokens(F.col("_key"), MIN_TOKEN)))), words),
    ]
    # The lowest and highest element of a part tell whether it is alone. They are taken before the join, so a name meets
    # one row for each of its parts, however many players share it.
    def ends(parts: DataFrame) -> DataFrame:
        return parts.groupBy("team_code", "_part").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi"))

    hits = reduce(lambda a, b: a.unionByName(b), [
        left.join(ends(right), ["team_code", "_part"]).select(*who, "_lo", "_hi", F.lit(rung).alias("_rung")) for rung, left, right in rungs
    ])
    of_rung = lambda r, c: F.when(F.col("_rung") == r, F.col(c))
    first = hits.groupBy(*who).agg(*[f(of_rung(r, c)).alias(f"{c}{r}") for r in (1, 2, 3) for f, c in ((F.min, "_lo"), (F.max, "_hi"))])
    found = everyone.join(first, who, "left")
    rung = F.coalesce(*[F.when(F.col(f"_lo{r}").isNotNull(), F.lit(r)) for r in (1, 2, 3)])
    alone = F.coalesce(*[F.when(F.col(f"_lo{r}").isNotNull(), F.col(f"_lo{r}") == F.col(f"_hi{r}")) for r in (1, 2, 3)])
    return found.select(
        *who, F.when(alone, F.coalesce("_lo1", "_lo2", "_lo3")).alias("player_element_id"),
        rung.alias("rung"),
    )


def attach_players(quotes: DataFrame, resolved: DataFrame, name: str = "player_name_raw") -> DataFrame:
    """Quotes with their element; unresolved ones stay with a NULL id, the raw name and a false flag."""
    who = ["home_team_code", "away_team_code", name]
    return quotes.join(resolved.select(*who, "player_element_id"), who, "left").withColumn(
        "identity_resolved", F.col("player_element_id").isNotNull()
    )


def match_lookup(probes: DataFrame, matches: DataFrame) -> DataFrame:
    """Match of each (date, home, away); ``n_matches`` other than one is a finding."""
    key = ["date", "home_team_code", "away_team_code"]
    counted = matches.groupBy(*key).agg(F.count("*").alias("n_matches"), F.min("match_id").alias("_id"))
    joined = probes.join(counted, key, "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    return joined.withColumn("match_id", F.when(F.col("n_matches") == 1, F.col("_id"))).drop("_id")


def by_priority(sources: Sequence[tuple[int, DataFrame]], key: Sequence[str]) -> DataFrame:
    """One row per key from the best source that covers it (the lowest number)."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  [df.withColumn("source_priority", F.lit(p)) for p, df in sources])
    order = ["source_priority", *[F.asc_nulls_last(c) for c in rows.columns if c not in (*key, "source_priority")]]
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")
