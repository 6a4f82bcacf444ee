"""What is at stake: competition and stage weight, progress inside a tournament."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weight of a competition level.
LEVEL_IMPORTANCE = {
    "olympic_games": 5.0,
    "world_championship": 5.0,
    "world_cup": 4.0,
    "nations_league": 3.0,
    "continental": 2.0,
}
# Weight of a stage.
STAGE_IMPORTANCE = {
    "final": 4.0,
    "bronze": 3.0,
    "semifinal": 2.5,
    "quarterfinal": 2.0,
    "preliminary": 1.5,
    "pool": 1.0,
    "other": 1.0,
}
UNKNOWN_IMPORTANCE = 1.0


def lookup(table: dict, key: Column, default) -> Column:
    """Value of a small fixed map, or the default for a missing or unknown key."""
    chain = F.lit(default)
    for name, value in reversed(table.items()):
        chain = F.when(key == name, F.lit(value)).otherwise(chain)
    return chain


def last_per_key(catalogue: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per key: the last in file order (column ``ord``), or without it the one with the largest values."""
    order = [c for c in ("ord",) if c in catalogue.columns] + values
    return catalogue.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*keys, "_v.*")


def with_level(df: DataFrame, competitions: DataFrame) -> DataFrame:
    """Level of the competition of each row; null for an unknown id."""
    dim = last_per_key(competitions, ["competition_id"], ["level"])
    return df.join(dim, "competition_id", "left")


def add_importance(df: DataFrame, competitions: DataFrame) -> DataFrame:
    """competition_importance, stage_importance and their product match_importance."""
    return (
        with_level(df, competitions)
        .withColumn("competition_importance", lookup(LEVEL_IMPORTANCE, F.col("level"), UNKNOWN_IMPORTANCE))
        .withColumn("stage_importance", lookup(STAGE_IMPORTANCE, F.col("stage"), UNKNOWN_IMPORTANCE))
        .withColumn("match_importance", F.col("competition_importance") * F.col("stage_importance"))
        .drop("level")
    )


# Stages from which the loser goes home.
KNOCKOUT_STAGES = ("quarterfinal", "semifinal", "bronze", "final")


def add_stage_flags(df: DataFrame) -> DataFrame:
    """is_knockout and one flag for each knockout stage; false for a missing stage."""
    def is_one_of(*stages: str) -> Column:
        return F.coalesce(F.col("stage").isin(*stages), F.lit(False))
    return df.withColumns({"is_knockout": is_one_of(*KNOCKOUT_STAGES)} | {f"is_{s}": is_one_of(s) for s in KNOCKOUT_STAGES})


def tournament_sizes(df: DataFrame) -> DataFrame:
    """Highest match number seen in each tournament."""
    return df.groupBy("tournament_no").agg(F.max("no_in_tournament").alias("tournament_max"))


def add_tournament_progress(df: DataFrame) -> DataFrame:
    """Match number over the highest number of its tournament; null where it cannot be told.

    The sizes are aggregated and joined back: a window over the tournament would send all its
    rows to one task.
    """
    if "tournament_no" not in df.columns or "no_in_tournament" not in df.columns:
        return df.withColumn("tournament_progress", F.lit(None).cast("double"))
    top = F.col("tournament_max")
    return (
        df.join(tournament_sizes(df), "tournament_no", "left")
        .withColumn("tournament_progress", F.when(top > 0, F.col("no_in_tournament") / top))
        .drop("tournament_max")
    )
