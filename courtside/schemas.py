"""Tables and their columns, with the fixed vocabularies."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
    TimestampNTZType,
)

_TYPES = {"string": StringType(), "int": IntegerType(), "bigint": LongType(), "double": DoubleType(),
          "boolean": BooleanType(), "date": DateType(), "timestamp_ntz": TimestampNTZType()}


def columns(text: str) -> StructType:
    """A struct of nullable columns from 'name type, name type'."""
    pairs = [part.split() for part in text.split(",")]
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


# Vocabularies.
GENDERS = ("men", "women")
STAGES = ("pool", "preliminary", "quarterfinal", "semifinal", "bronze", "final", "other")
WINNERS = ("team_a", "team_b")
SCORES = ("3-0", "3-1", "3-2", "2-3", "1-3", "0-3")
MARGINS = ("3-0", "3-1", "3-2")

COMPETITION = columns(
    "competition_id string, name string, gender string, level string, is_club_competition boolean")
TEAM = columns(
    "team_id string, canonical_name string, gender string, country_code string, continent string, active boolean")
TEAM_ALIAS = columns("canonical_team_id string, source string, source_name string")
RAW_MATCH = columns(
    "seq bigint, source string, source_match_id string, date_str string, gender string, competition_name string, "
    "stage_str string, team_a_name string, team_b_name string, team_a_score int, team_b_score int, "
    "sets_a int, sets_b int, venue string, country_host string, neutral boolean, tournament_no string, "
    "no_in_tournament int")
MATCH = columns(
    "match_id string, date date, gender string, competition string, competition_id string, stage string, "
    "team_a string, team_b string, team_a_score int, team_b_score int, sets_a int, sets_b int, winner string, "
    "venue string, country_host string, neutral boolean, source string, source_match_id string, "
    "tournament_no string, no_in_tournament int")
SET_ROW = columns("match_id string, set_number int, team_a_points int, team_b_points int")
TEAM_MATCH_STATS = columns(
    "match_id string, team string, attack_attempts double, attack_points double, attack_errors double, "
    "attack_efficiency double, blocks double, aces double, serve_errors double, reception_attempts double, "
    "positive_reception double, perfect_reception double, digs double, sideout double, break_points double, "
    "points double, sets double")
TEAM_RATING = columns(
    "team_id string, gender string, as_of_date date, as_of_match_id string, elo_global double, "
    "elo_recent double, elo_time_decay double, elo_margin_adjusted double")
ALL_TABLES = {
    "competitions": COMPETITION, "teams": TEAM, "team_aliases": TEAM_ALIAS, "matches": MATCH, "sets": SET_ROW,
    "team_match_stats": TEAM_MATCH_STATS, "team_ratings": TEAM_RATING,
}
