"""Dataset specifications: entity keys, required fields, valid-time columns, and schema checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, types as T

from tidemark.functions.dates import ISO_Z
from tidemark.session import TidemarkError

RESERVED = ("observed_at", "valid_at", "source", "content_hash", "batch_id", "provider_id", "capability", "endpoint")
DERIVED_PREFIX = "derived_"
DERIVED_FIELDS = ("is_modelled", "derived_from", "calibration_reference", "calibration_residual_mean",
                  "calibration_residual_std")

FAMILIES = {
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType, T.DecimalType),
    "string": (T.StringType,),
    "boolean": (T.BooleanType,),
    "temporal": (T.DateType, T.TimestampNTZType, T.DayTimeIntervalType, T.TimeType),
    "null": (T.NullType,),
}


def family(dtype: T.DataType) -> str | None:
    if isinstance(dtype, T.TimestampType):
        return "temporal"
    return next((name for name, kinds in FAMILIES.items() if isinstance(dtype, kinds)), None)


def zoned_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]


@dataclass(frozen=True)
class Dataset:
    """``key`` is the entity key (empty for a singleton); ``required`` a minimum beside it, further columns are open.

    ``pins`` are the types that columns without any value take, so that a batch of NULLs merges with others.
    """

    name: str
    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    valid_time: str | None = None
    valid_format: str | None = None
    pins: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        if self.valid_format is not None and self.valid_time is None:
            raise TidemarkError(f"{self.name}: a valid-time format without a valid-time column")
        if self.valid_time is not None and self.valid_time not in self.minimum:
            raise TidemarkError(f"{self.name}: the valid-time column {self.valid_time} must be a required field")

    @property
    def is_derived(self) -> bool:
        return self.name.startswith(DERIVED_PREFIX)

    @property
    def minimum(self) -> tuple[str, ...]:
        """Columns that every batch has: the key, then the other required fields."""
        return tuple(dict.fromkeys((*self.key, *self.required)))

    def validate(self, df: DataFrame) -> None:
        """Presence, type family and naive times, from the schema alone."""
        missing = [c for c in self.minimum if c not in df.columns]
        if missing:
            raise TidemarkError(f"{self.name}: missing required fields {missing}")
        odd = [(c, df.schema[c].dataType.simpleString()) for c in self.minimum if family(df.schema[c].dataType) is None]
        if odd:
            raise TidemarkError(f"{self.name}: required fields of no accepted family {odd}")
        zoned = zoned_columns(df)
        if zoned:
            raise TidemarkError(f"{self.name}: columns {zoned} carry a time zone; data columns are naive UTC")


CATALOG: dict[str, Dataset] = {}


def register(dataset: Dataset) -> Dataset:
    if dataset.name in CATALOG:
        raise TidemarkError(f"dataset {dataset.name} is already registered")
    CATALOG[dataset.name] = dataset
    return dataset


def lookup(name: str) -> Dataset:
    if name not in CATALOG:
        raise TidemarkError(f"dataset {name!r} has no declared entity key; register it or read its observations")
    return CATALOG[name]


def key_of(name: str) -> Sequence[str]:
    return lookup(name).key


# The game's datasets, their entity keys and the other fields that every batch of theirs has.
for _name, _key, _fields in (
    ("elements", ("id",), "web_name team element_type now_cost selected_by_percent status"),
    ("teams", ("id",), "name short_name"),
    ("events", ("id",), "deadline_time"),
    ("chips", ("id",), "name"),
    ("game_config", (), "payload"),
    ("game_settings", (), "payload"),
    ("picks", ("entry_id", "event", "element"), "multiplier is_captain is_vice_captain overall_rank"),
    ("automatic_subs", ("entry_id", "event", "element_out"), "element_in"),
    ("match_lineups", ("match_id", "player_element_id"), "team_code player_code role position shirt_number is_captain"),
    ("match_substitutions", ("match_id", "team_code", "minute", "player_off_element_id"),
     "period player_on_element_id player_on_code player_off_code"),
    ("team_match_stats", ("match_id", "side", "stat_key"), "value"),
    ("player_season_stats", ("season", "player_element_id", "stat_key"), "player_code value"),
    ("match_fixtures", ("match_id",), "season matchweek kickoff home_team_code away_team_code"),
    ("match_officials", ("match_id", "role"), "is_referee official_name official_first_name official_last_name"),
    ("player_identity", ("season", "id"), "code element_type team team_code web_name first_name second_name now_cost"),
    ("team_identity", ("season", "id"), "code name short_name"),
    ("player_attributes", ("season", "gw", "id"),
     "status chance_of_playing_next_round selected_by_percent now_cost cost_change_event form ep_next ep_this expected_goals "
     "expected_assists expected_goal_involvements expected_goals_conceded penalties_order direct_freekicks_order "
     "corners_and_indirect_freekicks_order set_piece_threat total_points bonus bps observed_at_source observed_at_imputed"),
    ("gameweek_field_summary", ("season", "id"),
     "name deadline_time finished average_entry_score chip_plays most_captained most_vice_captained ranked_count "
     "observed_at_source observed_at_imputed"),
    ("match_odds", ("provider_event_id", "bookmaker_key", "market_key", "outcome_name", "outcome_point"),
     "season home_team_code away_team_code commence_time bookmaker_title market_last_update outcome_price"),
    ("player_goal_odds", ("provider_event_id", "bookmaker_key", "market_key", "player_name_raw", "outcome_name"),
     "season home_team_code away_team_code commence_time player_element_id identity_resolved bookmaker_title "
     "market_last_update outcome_price"),
    ("heartbeat", ("job", "run_ts", "target_dataset"), "outcome payload_hash n_rows error"),
    ("threshold_observations", ("season", "group", "round"),
     "lower_bound upper_bound count_threshold n_observations n_unattributable contradiction"),
):
    # A price without a point and a run without an error are whole batches of NULLs now and then.
    _pins = {"match_odds": (("outcome_point", "double"),),
             "heartbeat": (("payload_hash", "string"), ("n_rows", "bigint"), ("error", "string"))}.get(_name, ())
    register(Dataset(_name, _key, tuple(_fields.split()), pins=_pins))
ARCHIVE_STATS, LIVE_STATS = "archive_player_gameweek_stats", "live_player_gameweek_stats"
# Fields of an appearance, and the types of those that the live provider leaves without a value.
_STATS = ("name", "total_points", "minutes", "selected", "value", "was_home", "team_a_score", "team_h_score", "kickoff_time")
_LIVE_PINS = (("selected", "bigint"), ("value", "bigint"), ("attribution_complete", "boolean"), ("position", "string"),
              ("team", "string"), ("was_home", "boolean"), ("opponent_team", "bigint"))
for _name in (ARCHIVE_STATS, LIVE_STATS):
    register(Dataset(_name, ("season", "round", "element", "fixture"), _STATS, "kickoff_time", ISO_Z, _LIVE_PINS))
# What one modelled number is about, by dataset.
_APPEARANCE = ("season", "round", "element", "fixture")
for _name, _key in {
    "minutes_pmf": (*_APPEARANCE, "state", "band"),
    "attacking_pmf": (*_APPEARANCE, "stat", "count"),
    "defensive_pmf": (*_APPEARANCE, "count"),
    "cards_pmf": (*_APPEARANCE, "outcome"),
    "saves_pmf": (*_APPEARANCE, "count"),
    "bonus_pmf": (*_APPEARANCE, "count"),
    "team_strength": ("season", "gameweek", "team"),
    "scoreline_pmf": ("season", "round", "fixture", "home_goals", "away_goals"),
}.items():
    register(Dataset(DERIVED_PREFIX + _name, _key, DERIVED_FIELDS))
