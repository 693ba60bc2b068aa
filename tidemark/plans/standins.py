"""The driver's tables reshaped into the shapes the operators work on.

The expressions are written once, in the dialect Spark SQL and DuckDB share, and used on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.maths import half_up
from tidemark.plans.registry import table

# One player's appearance in one fixture, from a line item and its supplier.
_BASE = """
  l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, s_nationkey, s_name,
  CAST(l_quantity AS INT) AS lq,
  CAST(round(l_discount * 100) AS INT) AS disc,
  CAST(round(l_tax * 100) AS INT) AS tax,
  CAST(year(l_shipdate) AS INT) AS yr,
  CASE WHEN l_linenumber % 2 = 1 THEN true ELSE false END AS was_home,
  CAST(l_orderkey % 4 AS INT) AS team_h_score,
  CAST(floor(l_orderkey / 4) % 3 AS INT) AS team_a_score,
  CASE WHEN CAST(l_quantity AS INT) % 5 = 0 THEN 0
       WHEN CAST(l_quantity AS INT) % 5 = 1 THEN 90
       ELSE least(90, CAST(l_quantity AS INT) * 2 - 3) END AS minutes
"""
_MIDDLE = """
  *,
  CASE WHEN was_home THEN team_h_score ELSE team_a_score END AS own_goals,
  CASE WHEN was_home THEN team_a_score ELSE team_h_score END AS other_goals
"""
_FACTS = """
  concat(CAST(yr AS STRING), '-', lpad(CAST((yr + 1) % 100 AS STRING), 2, '0')) AS season,
  CAST(floor((dayofyear(l_shipdate) - 1) / 7) + 1 AS INT) AS round,
  l_suppkey AS element,
  l_orderkey AS fixture,
  l_linenumber AS line,
  s_name AS name,
  CASE WHEN l_suppkey % 10 = 0 THEN 'GKP' WHEN l_suppkey % 10 = 1 THEN 'GK'
       WHEN l_suppkey % 10 < 5 THEN 'DEF' WHEN l_suppkey % 10 < 8 THEN 'MID'
       WHEN l_suppkey % 20 = 19 THEN 'AM' ELSE 'FWD' END AS position,
  concat('T', CAST(s_nationkey AS STRING)) AS team,
  CAST((s_nationkey + 1 + l_orderkey % 24) % 25 AS INT) AS opponent_team,
  was_home,
  l_shipdate AS kickoff,
  concat(substr(CAST(l_shipdate AS STRING), 1, 10), 'T00:00:00Z') AS kickoff_time,
  team_h_score, team_a_score, minutes,
  CASE WHEN lq % 7 = 0 THEN NULL WHEN minutes >= 60 THEN 1 ELSE 0 END AS starts,
  CAST(40 + l_partkey % 90 AS INT) AS value,
  (l_partkey * 37) % 100000 AS selected,
  disc + tax + CASE WHEN minutes >= 60 THEN 2 ELSE 0 END AS total_points,
  least(own_goals, CASE WHEN disc >= 9 THEN disc - 8 ELSE 0 END) AS goals_scored,
  least(own_goals, CASE WHEN tax = 8 THEN 1 ELSE 0 END) AS assists,
  CASE WHEN yr = 1995 OR lq % 17 = 0 THEN NULL ELSE disc / CAST(20 AS DOUBLE) END AS expected_goals,
  CASE WHEN yr = 1995 OR lq % 17 = 0 THEN NULL ELSE tax / CAST(20 AS DOUBLE) END AS expected_assists,
  lq % 6 AS tackles,
  lq % 9 AS clearances_blocks_interceptions,
  tax AS recoveries,
  CASE WHEN yr < 1997 THEN NULL ELSE lq % 6 + lq % 9 +
    CASE WHEN l_suppkey % 10 < 5 THEN 0 ELSE tax END END AS defensive_contribution,
  CASE WHEN disc = 3 THEN 1 ELSE 0 END AS yellow_cards,
  CASE WHEN disc = 7 AND tax < 3 THEN 1 ELSE 0 END AS red_cards,
  lq % 8 AS saves,
  CASE WHEN minutes > 0 THEN other_goals ELSE 0 END AS goals_conceded,
  CASE WHEN minutes >= 60 AND other_goals = 0 THEN 1 ELSE 0 END AS clean_sheets,
  CASE WHEN lq = 49 THEN 1 ELSE 0 END AS own_goals,
  CASE WHEN lq = 48 THEN 1 ELSE 0 END AS penalties_saved,
  CASE WHEN lq = 47 THEN 1 ELSE 0 END AS penalties_missed,
  lq + disc AS bps,
  CASE WHEN lq >= 47 THEN 3 WHEN lq >= 44 THEN 2 WHEN lq >= 40 THEN 1 ELSE 0 END AS bonus,
  CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 13 = 0 THEN false ELSE true END AS attribution_complete,
  CASE WHEN yr = 2001 AND l_partkey % 3 = 0 THEN 'live' ELSE 'archive' END AS source_provider
"""

FACTS_SQL = f"""WITH base0 AS (
  SELECT {_BASE} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
base AS (SELECT {_MIDDLE} FROM base0),
facts AS (SELECT {_FACTS} FROM base)"""


def columns(text: str) -> list[str]:
    """Split a select list on its top-level commas."""
    out, depth, quoted, start = [], 0, False, 0
    for at, ch in enumerate(text):
        if ch == "'":
            quoted = not quoted
        elif not quoted and ch in "([":
            depth += 1
        elif not quoted and ch in ")]":
            depth -= 1
        elif ch == "," and not depth and not quoted:
            out.append(text[start:at].strip())
            start = at + 1
    return [*out, text[start:].strip()]


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    suppliers = table(spark, sf_dir, "supplier")
    # The roundings of the text above, which would otherwise be most of a scan's time.
    whole = {n: half_up(F.col(c) * 100).cast("int").alias(n) for n, c in (("disc", "l_discount"), ("tax", "l_tax"))}
    return (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(*[whole.get(c.rpartition(" AS ")[2], F.expr(c)) for c in columns(_BASE)])
        .selectExpr(*columns(_MIDDLE))
        .selectExpr(*columns(_FACTS))
    )


_KICKOFF_TIME = next(e for e in columns(_FACTS) if e.endswith(" AS kickoff_time"))


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least name, position and team of every element among its facts: they hang on the supplier alone."""
    wanted = [e for e in columns(_FACTS) if e.endswith((" AS element", " AS name", " AS position", " AS team"))]
    named = table(spark, sf_dir, "supplier").withColumn("l_suppkey", F.col("s_suppkey")).selectExpr(*wanted)
    return named.groupBy("element").agg(*[F.min(c).alias(c) for c in ("name", "position", "team")])


def kickoff_time(kickoff: str) -> Column:
    """The facts' text of a kickoff; texts are in the order of their instants."""
    return F.expr(_KICKOFF_TIME.replace("l_shipdate", kickoff))


# Rows that may train a model: whole attributions from the archive, known positions.
ELIGIBLE_SQL = FACTS_SQL + """,
eligible AS (
  SELECT * REPLACE (CASE WHEN position = 'GKP' THEN 'GK' ELSE position END AS position)
  FROM facts
  WHERE position <> 'AM' AND source_provider <> 'live' AND coalesce(attribution_complete, true))"""


# An append-only observation log, from the event stream.
_LOG = """
  user_id, event_type, value, ts AS observed_at, event_id AS batch_id,
  CASE WHEN event_id % 29 = 0 THEN NULL
       ELSE concat(substr(CAST(ts AS STRING), 1, 10), 'T', substr(CAST(ts AS STRING), 12, 2), ':00:00Z') END AS valid_time
"""
LOG_SQL = f"WITH log AS (SELECT {_LOG} FROM events)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*columns(_LOG))


# Binary and three-class predictions with labels.
_SCORED = """
  doc_id, quality AS y, n_chars, lang,
  (n_chars % 97 + 1) / CAST(99 AS DOUBLE) AS p,
  CAST(floor(doc_id / 50) AS INT) AS fold,
  CAST(doc_id % 2 AS INT) AS half
"""
SCORED_SQL = f"WITH scored AS (SELECT {_SCORED} FROM labels JOIN documents USING (doc_id))"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").selectExpr(
        *columns(_SCORED)
    )
