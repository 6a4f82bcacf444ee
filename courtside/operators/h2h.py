"""Head-to-head record of the unordered pair before a match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtside.operators.ordering import ROW_BUDGET, cut_hot_groups

PAIR = ["gender", "lo", "hi"]


def meetings(matches: DataFrame) -> DataFrame:
    """One slim row per match keyed by the alphabetically ordered pair."""
    return matches.select(
        "gender", "date", "seq",
        F.least("team_a", "team_b").alias("lo"),
        F.greatest("team_a", "team_b").alias("hi"),
        (F.col("team_a") < F.col("team_b")).alias("a_is_lo"),
        F.when(F.col("winner") == "team_a", F.col("team_a")).otherwise(F.col("team_b")).alias("winner_team"),
    )


def head_to_head(matches: DataFrame, budget: int = ROW_BUDGET, largest: int | None = None) -> DataFrame:
    """seq, h2h_matches_played, h2h_win_rate_a; the rate is null while the pair has not met."""
    met = meetings(matches).withColumn("lo_won", (F.col("winner_team") == F.col("lo")).cast("int"))
    pieces = cut_hot_groups(met, PAIR, budget=budget, largest=largest)
    piece = [*PAIR, "piece"]
    rows = pieces.rows
    if pieces.split:
        so_far = Window.partitionBy(*PAIR).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        carry = (
            rows.groupBy(*piece).agg(F.count("*").alias("_n"), F.sum("lo_won").alias("_w"))
            .select(*piece, F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("off_n"),
                    F.coalesce(F.sum("_w").over(so_far), F.lit(0)).alias("off_w"))
        )
        rows = rows.join(carry, piece)
    else:
        zero = F.lit(0).cast("bigint")
        rows = rows.withColumn("off_n", zero).withColumn("off_w", zero)
    w = Window.partitionBy(*piece).orderBy("date", "seq").rowsBetween(Window.unboundedPreceding, -1)
    n = F.col("off_n") + F.count("*").over(w)
    lo_wins = F.col("off_w") + F.coalesce(F.sum("lo_won").over(w), F.lit(0))
    rows = rows.withColumn("_n", n).withColumn("_lo", lo_wins)
    a_wins = F.when(F.col("a_is_lo"), F.col("_lo")).otherwise(F.col("_n") - F.col("_lo"))
    return rows.select(
        "seq",
        F.col("_n").cast("bigint").alias("h2h_matches_played"),
        F.when(F.col("_n") > 0, a_wins / F.col("_n")).alias("h2h_win_rate_a"),
    )


def pair_days(matches: DataFrame) -> DataFrame:
    """Pair state as a table: meetings and wins per pair and day (at most one row per day)."""
    return (
        meetings(matches).groupBy(*PAIR, "date")
        .agg(F.count("*").alias("met"),
             F.sum((F.col("winner_team") == F.col("lo")).cast("bigint")).alias("lo_wins"))
    )


def record_before(requests: DataFrame, days: DataFrame) -> DataFrame:
    """Meetings strictly before each requested (pair, date): met, lo_wins.

    Requested dates and meeting days of a pair are put in one sequence and summed up to, but
    not including, the requested date.  Both sides hold at most one row per pair and day.
    """
    asked = requests.select(*PAIR, "date").distinct().select(
        *PAIR, "date", F.lit(0).cast("bigint").alias("met"), F.lit(0).cast("bigint").alias("lo_wins"),
        F.lit(True).alias("asked"))
    known = days.select(*PAIR, "date", "met", "lo_wins", F.lit(False).alias("asked"))
    w = Window.partitionBy(*PAIR).orderBy("date", F.desc("asked")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        asked.unionByName(known)
        .select(*PAIR, "date", "asked", F.coalesce(F.sum("met").over(w), F.lit(0)).alias("met"),
                F.coalesce(F.sum("lo_wins").over(w), F.lit(0)).alias("lo_wins"))
        .filter("asked").drop("asked")
    )
