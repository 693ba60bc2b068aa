"""Names, keys and entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates as dt
from tidemark.functions import text as tx
from tidemark.operators import identity as ident
from tidemark.plans.registry import query, table
from tidemark.plans import standins as st

FOLD_SQL = "lower(strip_accents(replace(replace(replace(text, 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')))"


@query("folded_text", f"SELECT doc_id, md5({FOLD_SQL}) AS folded FROM documents")
def folded_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.fold(F.col("text"))).alias("folded"))


# Club names made from brands and types, with the words that do not count.
CLUB_SQL = "CASE p_partkey % 4 WHEN 0 THEN p_name || ' FC' WHEN 1 THEN 'AFC ' || p_name WHEN 2 THEN p_name || '  City' ELSE 'Ünited ' || p_name END"
KEY_SQL = r"trim(regexp_replace(regexp_replace(lower(strip_accents({0})), '\b(fc|afc|and|hove|albion|city|united|town|wanderers)\b', ' ', 'g'), '\s+', ' ', 'g'))"


def clubs(spark, sf):
    n, name = F.col("p_partkey") % 4, F.col("p_name")
    club = (F.when(n == 0, F.concat(name, F.lit(" FC"))).when(n == 1, F.concat(F.lit("AFC "), name))
            .when(n == 2, F.concat(name, F.lit("  City"))).otherwise(F.concat(F.lit("Ünited "), name)))
    return table(spark, sf, "part").withColumn("club", club)


@query("team_keys", f"SELECT p_partkey, {KEY_SQL.format(CLUB_SQL)} AS team_key FROM part")
def team_keys(spark, sf):
    return clubs(spark, sf).select("p_partkey", tx.team_key(F.col("club")).alias("team_key"))


PLAYER_SQL = r"trim(regexp_replace(regexp_replace(lower(strip_accents({0})), '[^a-z0-9\s-]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("player_keys", "SELECT s_suppkey, " + PLAYER_SQL.format("replace(s_name, '#', ' Ó''')") + " AS player_key FROM supplier")
def player_keys(spark, sf):
    name = F.replace("s_name", F.lit("#"), F.lit(" Ó'"))
    return table(spark, sf, "supplier").select("s_suppkey", tx.player_key(name).alias("player_key"))


@query("name_tokens", r"""SELECT p_partkey, unnest(list_filter(regexp_split_to_array(replace(p_name, ' ', '- '), '[-\s]+'), lambda t: length(t) >= 4)) AS token FROM part""")
def name_tokens(spark, sf):
    key = F.replace("p_name", F.lit(" "), F.lit("- "))
    return table(spark, sf, "part").select("p_partkey", F.explode(tx.tokens(key, 4)).alias("token"))


@query("iso_times", st.LOG_SQL + """ SELECT batch_id, strftime(strptime(valid_time, '%Y-%m-%dT%H:%M:%SZ'), '%Y-%m-%d %H:%M:%S') AS parsed,
    round(date_diff('second', strptime(valid_time, '%Y-%m-%dT%H:%M:%SZ'), observed_at) / 86400.0, 8) AS days FROM log WHERE valid_time IS NOT NULL""")
def iso_times(spark, sf):
    log = st.log(spark, sf).filter("valid_time IS NOT NULL")
    parsed = dt.iso_to_ntz(F.col("valid_time"))
    whole = F.date_trunc("second", "observed_at").cast("timestamp_ntz")
    return log.select("batch_id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("parsed"),
                      F.round(dt.days_between(parsed, whole), 8).alias("days"))


@query("local_to_utc", """SELECT o_orderkey, strftime(CAST(CAST(o_orderdate + INTERVAL 15 HOUR AS TIMESTAMP) AT TIME ZONE 'Europe/London' AT TIME ZONE 'UTC' AS TIMESTAMP), '%Y-%m-%d %H:%M') AS utc FROM orders""")
def local_to_utc(spark, sf):
    local = F.col("o_orderdate") + F.expr("INTERVAL 15 HOURS")
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(dt.local_to_utc(local), "yyyy-MM-dd HH:mm").alias("utc"))


# -- id maps -----------------------------------------------------------------------------------------

ELEMENT_SQL = """WITH elements AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 31 = 30 THEN s_suppkey - 1 ELSE s_suppkey END + 1000 AS code,
    CASE WHEN s_suppkey % 17 = 5 THEN 'x' || s_suppkey WHEN s_suppkey % 23 = 7 THEN NULL
         ELSE 'p' || (CASE WHEN s_suppkey % 31 = 30 THEN s_suppkey - 1 ELSE s_suppkey END + 1000) END AS opta_code FROM supplier)"""


def elements(spark, sf):
    code = F.when(F.col("s_suppkey") % 31 == 30, F.col("s_suppkey") - 1).otherwise(F.col("s_suppkey")) + 1000
    opta = (F.when(F.col("s_suppkey") % 17 == 5, F.concat(F.lit("x"), F.col("s_suppkey").cast("string")))
            .when(F.col("s_suppkey") % 23 == 7, None).otherwise(F.concat(F.lit("p"), code.cast("string"))))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), code.alias("code"), opta.alias("opta_code"))


@query("player_identity_failures", ELEMENT_SQL + """ SELECT id, code, opta_code, CASE WHEN coalesce(opta_code = 'p' || code, false) THEN 'duplicate' ELSE 'opta_code' END AS reason
  FROM elements WHERE NOT coalesce(opta_code = 'p' || code, false) OR code IN (SELECT code FROM elements GROUP BY 1 HAVING count(*) > 1)""")
def player_identity_failures(spark, sf):
    return ident.identity_failures(elements(spark, sf))


@query("player_identity_map", "SELECT c_custkey + 5000 AS player_code, c_custkey AS element FROM customer")
def player_identity_map(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") + 5000).alias("code"))
    return ident.player_map(rows.withColumn("opta_code", F.concat(F.lit("p"), F.col("code").cast("string"))))


@query("season_identity_map", """SELECT s_suppkey AS id, s_name AS name, '2024-25' AS season FROM supplier
  UNION ALL SELECT c_custkey, c_name, CASE c_custkey % 2 WHEN 0 THEN '2022-23' ELSE '2023-24' END FROM customer WHERE c_custkey % 3 > 0""")
def season_identity_map(spark, sf):
    live = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    season = F.when(F.col("c_custkey") % 3 == 0, "2024-25").when(F.col("c_custkey") % 2 == 0, "2022-23").otherwise("2023-24")
    archive = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), season.alias("season"))
    return ident.season_map(live, archive, "2024-25")


@query("team_identity_map", f"""WITH t AS (SELECT p_partkey AS code, {CLUB_SQL} AS name FROM part),
  o AS (SELECT CAST(CASE WHEN p_partkey % 5 = 0 THEN -p_partkey ELSE p_partkey END AS VARCHAR) AS id, CASE WHEN p_partkey % 7 = 0 THEN p_type ELSE p_name || ' Town' END AS name FROM part),
  j AS (SELECT code, t.name, CAST(code AS VARCHAR) AS other_id, o.name AS other_name, o.id IS NOT NULL AS matched,
    {KEY_SQL.format('t.name')} AS a, {KEY_SQL.format('o.name')} AS b FROM t LEFT JOIN o ON CAST(code AS VARCHAR) = o.id)
  SELECT code, name, other_id, coalesce(other_name, '') AS other_name, matched, coalesce(NOT contains(a, b) AND NOT contains(b, a), false) AS name_differs FROM j""")
def team_identity_map(spark, sf):
    teams = clubs(spark, sf).select(F.col("p_partkey").alias("code"), F.col("club").alias("name"))
    others = table(spark, sf, "part").select(  # every fifth has an id that no team has
        F.when(F.col("p_partkey") % 5 == 0, -F.col("p_partkey")).otherwise(F.col("p_partkey")).alias("id"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_type")).otherwise(F.concat("p_name", F.lit(" Town"))).alias("name"))
    m = ident.team_map(teams, others)
    return m.withColumn("other_name", F.coalesce("other_name", F.lit(""))).withColumn("name_differs", F.coalesce("name_differs", F.lit(False)))


@query("canonical_names", """WITH archive AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS season, o_custkey % 60 AS code, 'Club ' || (o_custkey % 60) || ' v' || (year(o_orderdate) % 3) AS name FROM orders),
  live AS (SELECT n_nationkey AS code, n_name AS name FROM nation),
  newest AS (SELECT code, max(struct_pack(s := season, n := name)).n AS name FROM archive GROUP BY 1)
  SELECT DISTINCT season, a.name AS team, coalesce(l.name, n.name) AS canonical FROM archive a JOIN newest n USING (code) LEFT JOIN live l USING (code)""")
def canonical_names(spark, sf):
    year, code = F.year("o_orderdate"), F.col("o_custkey") % 60
    archive = table(spark, sf, "orders").select(
        year.cast("string").alias("season"), code.alias("code"),
        F.concat(F.lit("Club "), code.cast("string"), F.lit(" v"), (year % 3).cast("string")).alias("name"))
    live = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("code"), F.col("n_name").alias("name"))
    return ident.canonical_names(archive, live)


TEAMS_SQL = f"""WITH teams AS (SELECT p_partkey AS code, CASE p_partkey WHEN 3 THEN 'Man Utd' WHEN 4 THEN 'Spurs' ELSE p_name || ' ' || p_partkey END AS name FROM part),
  asked AS (SELECT DISTINCT CASE p_partkey % 50 WHEN 0 THEN ' Manchester United ' WHEN 1 THEN 'Tottenham Hotspur' WHEN 2 THEN 'Nottingham Forest' WHEN 3 THEN 'Nobody'
    ELSE 'AFC ' || p_name || '  ' || p_partkey END AS team_name FROM part)"""


@query("resolve_teams", TEAMS_SQL + f""", k AS (SELECT {KEY_SQL.format('name')} AS key, min(code) AS code, count(*) AS n FROM teams GROUP BY 1),
  alias(raw, target) AS (VALUES ('manchester united', 'Man Utd'), ('manchester city', 'Man City'), ('tottenham hotspur', 'Spurs'), ('nottingham forest', 'Nott''m Forest'))
  SELECT team_name, coalesce(t.code, CASE WHEN k.n = 1 THEN k.code END, -1) AS team_code FROM asked a LEFT JOIN alias ON lower(trim(team_name)) = raw LEFT JOIN teams t ON t.name = target
    LEFT JOIN k ON k.key = {KEY_SQL.format('team_name')}""")
def resolve_teams(spark, sf):
    key, name = F.col("p_partkey"), F.col("p_name")
    part = table(spark, sf, "part")
    teams = part.select(key.alias("code"), F.when(key == 3, "Man Utd").when(key == 4, "Spurs").otherwise(F.concat(name, F.lit(" "), key.cast("string"))).alias("name"))
    n = key % 50
    asked = part.select(F.when(n == 0, " Manchester United ").when(n == 1, "Tottenham Hotspur").when(n == 2, "Nottingham Forest").when(n == 3, "Nobody")
                        .otherwise(F.concat(F.lit("AFC "), name, F.lit("  "), key.cast("string"))).alias("team_name"))
    return ident.resolve_teams(asked, teams).withColumn("team_code", F.coalesce("team_code", F.lit(-1)))


# Squads from suppliers; asked names from lines: whole names, "x last", long words, and misses.
SQUAD_SQL = """WITH el AS (SELECT s_suppkey AS id, s_nationkey AS team_code, 'Giv' || (s_suppkey % 9) AS first_name, 'Sur' || (s_suppkey % 40) || '-Tail' || s_suppkey AS second_name,
    CASE WHEN s_suppkey % 2 = 0 THEN 'Sur' || (s_suppkey % 40) ELSE 'Mono' || (s_suppkey % 30) || '-Tail' || s_suppkey END AS web_name FROM supplier),
  asked AS (SELECT DISTINCT l_suppkey % 25 AS home_team_code, (l_suppkey + 1 + l_linenumber) % 25 AS away_team_code, CASE l_linenumber % 4
      WHEN 0 THEN 'Gív' || (l_suppkey % 9) || ' Sur' || (l_suppkey % 40) || '-Tail' || l_suppkey WHEN 1 THEN 'Someone Sur' || (l_suppkey % 40)
      WHEN 2 THEN 'Tail' || l_suppkey || ' de la Cruz' ELSE 'Nobody Atall' END AS player_name_raw FROM lineitem)"""
PKEY = PLAYER_SQL.format


RESOLVED_SQL = SQUAD_SQL + rf""", keyed AS (SELECT *, {PKEY('player_name_raw')} AS key FROM asked),
  sided AS (SELECT *, home_team_code AS team_code FROM keyed UNION SELECT *, away_team_code FROM keyed),
  whole AS (SELECT team_code, id, {PKEY("first_name || ' ' || second_name")} AS part FROM el),
  web AS (SELECT team_code, id, {PKEY('web_name')} AS w FROM el),
  words AS (SELECT team_code, id, w AS part FROM web UNION SELECT team_code, id, unnest(regexp_split_to_array(w, '[-\s]+')) FROM web),
  hits AS (SELECT home_team_code, away_team_code, player_name_raw, 1 AS rung, w.id FROM sided s JOIN whole w ON s.team_code = w.team_code AND s.key = w.part
    UNION SELECT home_team_code, away_team_code, player_name_raw, 2, w.id FROM sided s JOIN words w ON s.team_code = w.team_code AND w.part = list_extract(regexp_split_to_array(s.key, '\s+'), -1)
    UNION SELECT home_team_code, away_team_code, player_name_raw, 3, w.id FROM (SELECT *, unnest(list_filter(regexp_split_to_array(key, '[-\s]+'), lambda t: length(t) >= 4)) AS tok FROM sided) s
      JOIN words w ON s.team_code = w.team_code AND w.part = s.tok),
  best AS (SELECT home_team_code, away_team_code, player_name_raw, rung, count(DISTINCT id) AS n, min(id) AS id,
    row_number() OVER (PARTITION BY home_team_code, away_team_code, player_name_raw ORDER BY rung) AS rn FROM hits GROUP BY 1, 2, 3, 4),
  resolved AS (SELECT home_team_code, away_team_code, player_name_raw, CASE WHEN n = 1 THEN id END AS id, rung
    FROM asked LEFT JOIN (SELECT * FROM best WHERE rn = 1) USING (home_team_code, away_team_code, player_name_raw))"""


@query("resolve_players", RESOLVED_SQL + """
  SELECT home_team_code, away_team_code, player_name_raw, coalesce(id, -1) AS player_element_id, coalesce(rung, 0) AS rung FROM resolved""")
def resolve_players(spark, sf):
    found = ident.resolve_players(asked_names(spark, sf), squad(spark, sf))
    return found.withColumn("player_element_id", F.coalesce("player_element_id", F.lit(-1))).withColumn("rung", F.coalesce("rung", F.lit(0)))


def squad(spark, sf):
    k = F.col("s_suppkey")
    s = k.cast("string")
    sur = F.concat(F.lit("Sur"), (k % 40).cast("string"))
    tail = F.concat(F.lit("-Tail"), s)
    return table(spark, sf, "supplier").select(
        k.alias("id"), F.col("s_nationkey").cast("bigint").alias("team_code"), F.concat(F.lit("Giv"), (k % 9).cast("string")).alias("first_name"),
        F.concat(sur, tail).alias("second_name"), F.when(k % 2 == 0, sur).otherwise(F.concat(F.lit("Mono"), (k % 30).cast("string"), tail)).alias("web_name"))


def asked_names(spark, sf):
    k, line = F.col("l_suppkey"), F.col("l_linenumber")
    sur = F.concat(F.lit("Sur"), (k % 40).cast("string"))
    tail = F.concat(F.lit("Tail"), k.cast("string"))
    name = (F.when(line % 4 == 0, F.concat(F.lit("Gív"), (k % 9).cast("string"), F.lit(" "), sur, F.lit("-"), tail))
            .when(line % 4 == 1, F.concat(F.lit("Someone "), sur)).when(line % 4 == 2, F.concat(tail, F.lit(" de la Cruz"))).otherwise("Nobody Atall"))
    return table(spark, sf, "lineitem").select((k % 25).alias("home_team_code"), ((k + 1 + line) % 25).alias("away_team_code"), name.alias("player_name_raw"))


@query("quotes_with_unresolved_kept", RESOLVED_SQL + """, quotes AS (
    SELECT q.*, l_suppkey FROM lineitem JOIN (SELECT DISTINCT * FROM asked) q ON q.home_team_code = l_suppkey % 25 AND q.away_team_code = (l_suppkey + 1 + l_linenumber) % 25
      AND q.player_name_raw = CASE l_linenumber % 4 WHEN 0 THEN 'Gív' || (l_suppkey % 9) || ' Sur' || (l_suppkey % 40) || '-Tail' || l_suppkey
        WHEN 1 THEN 'Someone Sur' || (l_suppkey % 40) WHEN 2 THEN 'Tail' || l_suppkey || ' de la Cruz' ELSE 'Nobody Atall' END)
  SELECT player_name_raw, id IS NOT NULL AS identity_resolved, count(*) AS n_quotes
  FROM quotes JOIN resolved USING (home_team_code, away_team_code, player_name_raw) GROUP BY 1, 2""")
def quotes_with_unresolved_kept(spark, sf):
    asked = asked_names(spark, sf)
    kept = ident.attach_players(asked, ident.resolve_players(asked, squad(spark, sf)))
    return kept.groupBy("player_name_raw", "identity_resolved").agg(F.count("*").alias("n_quotes"))


@query("match_lookup", """WITH m AS (SELECT CAST(o_orderdate AS DATE) AS d, o_custkey % 6 AS h, o_orderkey % 5 AS a, count(*) AS n, min(o_orderkey) AS id FROM orders GROUP BY 1, 2, 3)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(n, 0) AS n_matches, coalesce(CASE WHEN n = 1 THEN id END, -1) AS match_id
  FROM lineitem LEFT JOIN m ON CAST(l_shipdate AS DATE) = d AND l_suppkey % 6 = h AND l_partkey % 5 = a""")
def match_lookup(spark, sf):
    matches = table(spark, sf, "orders").select(
        F.to_date("o_orderdate").alias("date"), (F.col("o_custkey") % 6).alias("home_team_code"), (F.col("o_orderkey") % 5).alias("away_team_code"), F.col("o_orderkey").alias("match_id"))
    probes = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("date"),
                                                 (F.col("l_suppkey") % 6).alias("home_team_code"), (F.col("l_partkey") % 5).alias("away_team_code"))
    found = ident.match_lookup(probes, matches)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "n_matches", F.coalesce("match_id", F.lit(-1)).alias("match_id"))


@query("source_priority", """SELECT id, name, source_priority FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source_priority, name) AS rn FROM (
    SELECT CASE WHEN s_suppkey % 3 = 0 THEN -s_suppkey ELSE s_suppkey END AS id, s_name AS name, 1 AS source_priority FROM supplier UNION ALL
    SELECT c_custkey, c_name, 2 FROM customer UNION ALL SELECT p_partkey, p_name, 3 FROM part)) WHERE rn = 1""")
def source_priority(spark, sf):
    a = table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 3 == 0, -F.col("s_suppkey")).otherwise(F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    c = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return ident.by_priority([(1, a), (2, b), (3, c)], ["id"])
