"""File sources and record flattening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from tidemark.functions.dates import iso_to_ntz, season_start

# Fixed value: the season's last round has no next deadline; it counts as known a week after its own.
FINAL_ROUND_OFFSET_DAYS = 7


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Types inferred from the whole file; dates stay text."""
    inferred = spark.read.csv(path, header=True, inferSchema=True, samplingRatio=1.0).schema
    temporal = (T.DateType, T.TimestampType, T.TimestampNTZType)
    kept = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, temporal) else f.dataType) for f in inferred])
    return spark.read.csv(path, header=True, schema=kept)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None, lines: bool = True) -> DataFrame:
    reader = spark.read.option("multiLine", str(not lines).lower())
    return (reader.schema(schema) if schema else reader).json(path)


DECISION_RECORD = ("season STRING, arm STRING, gameweek INT, transfers_in ARRAY<BIGINT>, transfers_out ARRAY<BIGINT>, "
                   "hit_points INT, points INT, squad_element_ids ARRAY<BIGINT>")


def read_decision_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; corrupt lines are left out."""
    return spark.read.schema(DECISION_RECORD).json(path, mode="DROPMALFORMED")


def load_archive(df: DataFrame, season: str) -> tuple[DataFrame, DataFrame]:
    """A season's file with its season, exact duplicates dropped, and the counts before and after."""
    kept = df.dropDuplicates().withColumn("season", F.lit(season))
    counts = df.groupBy(*df.columns).agg(F.count("*").alias("_n")).agg(
        F.sum("_n").alias("n_read"), F.count("*").alias("n_kept")
    ).withColumn("n_dropped", F.col("n_read") - F.col("n_kept"))
    return kept, counts


def flatten_records(df: DataFrame) -> DataFrame:
    """Top-level records as one row each; nested values stay as JSON text with sorted keys."""
    nested = (T.StructType, T.ArrayType, T.MapType)

    def plain(f: T.StructField) -> Column:
        if not isinstance(f.dataType, nested):
            return F.col(f.name)
        return F.to_json(_sorted(F.col(f.name), f.dataType), {"ignoreNullFields": "false"}).alias(f.name)

    return df.select(*[plain(f) for f in df.schema])


def _sorted(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        rebuilt = F.struct(*[_sorted(value[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(value.isNotNull(), rebuilt)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: _sorted(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(value)))
    return value


def observed_when_public(attributes: DataFrame, rounds: DataFrame) -> DataFrame:
    """When a round's attributes were certainly public: the next round's deadline, else a week after its own.

    ``rounds``: season, id, deadline_time. The next round is id + 1, whether or not ids have gaps.
    """
    own = rounds.select("season", F.col("id").alias("gw"), F.col("deadline_time").alias("_own"))
    following = rounds.select("season", (F.col("id") - 1).alias("gw"), F.col("deadline_time").alias("_next"))
    late = F.timestamp_add("DAY", F.lit(FINAL_ROUND_OFFSET_DAYS), F.col("_own"))
    joined = attributes.join(own, ["season", "gw"], "left").join(following, ["season", "gw"], "left")
    return joined.withColumn("observed_at_imputed_time", F.coalesce("_next", late)).withColumn(
        "observed_at_source", F.when(F.col("_next").isNotNull(), F.concat(F.lit("deadline_time(gw="), (F.col("gw") + 1).cast("string"), F.lit(")")))
        .otherwise(F.concat(F.lit("deadline_time(gw="), F.col("gw").cast("string"), F.lit(")+7d"))),
    ).withColumn("observed_at_imputed", F.lit(True)).drop("_own", "_next")


# -- backfill ----------------------------------------------------------------------------------------

def static_units(seasons: DataFrame, rounds: int, capability: str = "match.fixtures@matchweek") -> DataFrame:
    """One unit for every round of every distinct season."""
    grid = seasons.select("season").distinct()
    rows = grid.select("season", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("matchweek"))
    return rows.select(F.lit(capability).alias("capability"), "season", "matchweek",
                       F.concat_ws("|", F.lit(capability), "season", F.col("matchweek").cast("string")).alias("unit_key"))


def match_units(fixtures: DataFrame, capabilities: Sequence[str]) -> DataFrame:
    """Units that depend on a match, one per match and capability."""
    rows = fixtures.select("season", "match_id", "kickoff", F.explode(F.array(*[F.lit(c) for c in capabilities])).alias("capability"))
    return rows.withColumn("unit_key", F.concat_ws("|", "capability", "season", F.col("match_id").cast("string")))


def last_outcomes(checkpoint: DataFrame, order: str = "recorded_at") -> DataFrame:
    """The last record of each unit wins."""
    return checkpoint.groupBy("unit_key").agg(F.max(F.struct(order, "outcome"))["outcome"].alias("outcome"))


def open_units(units: DataFrame, checkpoint: DataFrame) -> DataFrame:
    return units.join(last_outcomes(checkpoint), "unit_key", "left_anti")


def batch_valid_time(kickoffs: DataFrame, key: Sequence[str], kickoff: str = "kickoff_time") -> DataFrame:
    """Earliest kickoff of a batch, or the season's start where it has none."""
    return kickoffs.groupBy(*key, "season").agg(F.min(iso_to_ntz(F.col(kickoff))).alias("_first")).select(
        *key, "season", F.coalesce("_first", season_start(F.col("season"))).alias("valid_at")
    )
