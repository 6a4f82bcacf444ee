"""State after the last known match: what is kept to score matches yet to be played."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtside.operators.form import TEAM, WINDOWS, long_form
from courtside.operators.h2h import meetings, pair_days
from courtside.operators.ordering import null_safe_join
from courtside.session import cut


def team_state(matches: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """gender, team, matches_played, current_streak, last_match_date, recent (oldest first).

    Rows are counted per team and day. From these counts follow the days that hold a team's last rows, its last win and its last loss, and only
    rows of those days are looked at one by one.
    """
    depth = max(windows) if windows else 10
    rows = long_form(matches)
    last = {name: F.max(F.when(F.col("won") == won, F.col("seq"))).alias(name) for name, won in (("win", 1), ("loss", 0))}
    days = cut(rows.groupBy(*TEAM, "date").agg(F.count("*").alias("_n"), *last.values()))
    newer = Window.partitionBy(*TEAM).orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_later", F.coalesce(F.sum("_n").over(newer), F.lit(0)))
    # of its days with a win (a loss), the newest has the last one
    marked = days.withColumns({f"_{name}_day": F.col(name).isNotNull() & F.max(name).over(newer).isNull() for name in last})
    wanted = cut(marked.where((F.col("_later") < max(depth, 2)) | F.col("_win_day") | F.col("_loss_day")).drop("_n"))
    played = days.groupBy(*TEAM).agg(F.sum("_n").alias("matches_played"), F.max("date").alias("last_match_date"))
    near = null_safe_join(rows, wanted, [*TEAM, "date"])

    def since(name: str):
        """Rows after the last win or loss (null without one)."""
        on = F.col(f"_{name}_day")
        return F.max(F.when(on, F.col("_later"))) + F.sum(F.when(on & (F.col("seq") > F.col(name)), 1).otherwise(0))

    counts = near.groupBy(*TEAM).agg(since("win").alias("_since_win"), since("loss").alias("_since_loss"))
    newest_first = Window.partitionBy(*TEAM).orderBy(F.desc("date"), F.desc("seq"))
    ends = near.where(F.col("_later") < max(depth, 2)).withColumn("_back", F.row_number().over(newest_first)).where(F.col("_back") <= max(depth, 2))
    result = F.struct("date", "seq", (F.col("won") == 1).alias("won"), "sets_for", "sets_against")
    ends = ends.groupBy(*TEAM).agg(F.array_sort(F.collect_list(result)).alias("_ends"))
    both = null_safe_join(null_safe_join(played, counts, TEAM), ends, TEAM)
    won, before = F.element_at("_ends", -1)["won"], F.get("_ends", F.size("_ends") - 2)["won"]
    streak = (F.when(won, F.when(before, F.coalesce("_since_loss", "matches_played")).otherwise(1))
              .otherwise(F.when(~before, -F.coalesce("_since_win", "matches_played")).otherwise(-1)))
    recent = F.when(F.size("_ends") > depth, F.slice("_ends", -depth, depth)).otherwise(F.col("_ends"))
    return cut(both.select(  # a row a team, read by every side of a fixture
        *TEAM, "matches_played", streak.cast("bigint").alias("current_streak"), "last_match_date",
        F.transform(recent, lambda r: F.struct(
            r["date"].alias("date"), r["won"].alias("won"), r["sets_for"].alias("sets_for"),
            r["sets_against"].alias("sets_against"))).alias("recent"),
    ))


def pair_meetings(matches: DataFrame) -> DataFrame:
    """Every meeting of every pair, as rows: gender, lo, hi, date, seq, winner_team."""
    return meetings(matches).select("gender", "lo", "hi", "date", "seq", "winner_team")


def pair_state(matches: DataFrame) -> DataFrame:
    """Meetings and wins per pair and day."""
    return pair_days(matches)


def reference_date(states: DataFrame) -> DataFrame:
    """The day after the last known match, per pool."""
    return states.groupBy("gender").agg(F.date_add(F.max("last_match_date"), 1).alias("reference_date"))


def known_teams(ratings: DataFrame) -> DataFrame:
    """gender, team, n_teams: the teams of each pool as rows, with the size of the pool."""
    teams = ratings.select("gender", "team").distinct()
    return teams.join(teams.groupBy("gender").agg(F.count("*").alias("n_teams")), "gender")
