"""Rolling means over the last rows or days of a group, and counts of recent days.

Row windows run inside the bounded pieces of ``cut_hot_groups``; a piece brings along the few rows that its first windows reach
back to. Day windows run over one row per group and day, of which a group has at most as many as the calendar has days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.operators.form import TEAM
from courtside.operators.h2h import PAIR, meetings
from courtside.operators.ordering import ROW_BUDGET, cut_hot_groups, null_safe_join


def rolling_means(rows: DataFrame, values: list[str], windows: tuple[int, ...], keys: list[str] = TEAM,
                  budget: int = ROW_BUDGET) -> DataFrame:
    """``<value>_last<n>`` per value and window: the mean over the ``n`` rows before, null while there is none.

    Null values are left out of a mean, like in any average; rows keep their other columns.
    """
    depth = max(windows)
    pieces = cut_hot_groups(rows, keys, budget=budget)
    piece = [*keys, "piece"]
    tagged = pieces.rows.withColumn("_ghost", F.lit(0))
    if pieces.split:
        back = Window.partitionBy(*piece).orderBy(F.desc("date"), F.desc("seq"))
        tails = (pieces.rows.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= depth)
                 .groupBy(*piece).agg(F.array_sort(F.collect_list(F.struct("date", "seq", *values))).alias("_tail")))
        before = Window.partitionBy(*keys).orderBy("piece").rowsBetween(-depth, -1)
        seen = tails.withColumn("_seen", F.flatten(F.collect_list("_tail").over(before)))
        seen = seen.withColumn("_seen", F.when(F.size("_seen") > depth, F.slice("_seen", -depth, depth)).otherwise(F.col("_seen")))
        ghosts = seen.select(*piece, F.inline("_seen")).withColumn("_ghost", F.lit(1))
        tagged = tagged.unionByName(ghosts, allowMissingColumns=True)
    w = Window.partitionBy(*piece).orderBy("date", "seq")
    means = {f"{v}_last{n}": F.avg(v).over(w.rowsBetween(-n, -1)) for v in values for n in windows}
    return tagged.withColumns(means).filter("_ghost = 0").drop("_ghost", "piece")


def day_sums(rows: DataFrame, sums: dict[str, Column], days: dict[str, int], keys: list[str] = TEAM) -> DataFrame:
    """keys, date and ``<sum>_<window>``: sums over the days before each day on which the group has a row.

    ``days`` names each window and gives its length; the day itself is not part of it. Rows without a date are a day of their
    own that lies in no other day's window, and has nothing before it.
    """
    per_day = rows.groupBy(*keys, "date").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    w = Window.partitionBy(*keys).orderBy(F.unix_date("date"))
    dated = F.col("date").isNotNull()
    out = [F.coalesce(F.when(dated, F.sum(s).over(w.rangeBetween(-n, -1))), F.lit(0)).alias(f"{s}_{name}") for s in sums for name, n in days.items()]
    return per_day.select(*keys, "date", *out)


def points_long(matches: DataFrame) -> DataFrame:
    """Two rows per match with what a side and its opponent scored."""
    def side(tag: str, other: str) -> Column:
        return F.struct(
            F.lit(tag).alias("side"), F.col(f"team_{tag}").alias("team"), F.col(f"team_{other}").alias("opponent"),
            (F.col("winner") == f"team_{tag}").cast("int").alias("won"),
            F.try_divide(F.col(f"sets_{tag}"), F.col("sets_a") + F.col("sets_b")).alias("sets_win_rate"),
            F.try_divide(F.col(f"team_{tag}_score"), F.col("team_a_score") + F.col("team_b_score")).alias("points_win_rate"),
            (F.col(f"team_{tag}_score") - F.col(f"team_{other}_score")).cast("double").alias("point_difference"))
    return matches.select("gender", "date", "seq", F.inline(F.array(side("a", "b"), side("b", "a"))))


def form_last_year(long: DataFrame, days: int = 365) -> DataFrame:
    """Rows of the long frame with win_rate_365d and matches_365d, from the days before."""
    sums = day_sums(long, {"n": F.lit(1), "w": F.col("won")}, {"d": days})
    rate = F.when(F.col("n_d") > 0, F.col("w_d") / F.col("n_d"))
    return null_safe_join(long, sums, [*TEAM, "date"]).withColumn("win_rate_365d", rate).withColumn("matches_365d", F.col("n_d")).drop("n_d", "w_d")


def schedule_density(long: DataFrame, windows: tuple[int, ...] = (7, 14, 30)) -> DataFrame:
    """matches_last_<n>d per row, and back_to_back: the team also played on the day before."""
    sums = day_sums(long, {"n": F.lit(1)}, {f"last_{n}d": n for n in windows} | {"yesterday": 1})
    named = sums.select(*TEAM, "date", *[F.col(f"n_last_{n}d").alias(f"matches_last_{n}d") for n in windows],
                        (F.col("n_yesterday") > 0).alias("back_to_back"))
    return null_safe_join(long, named, [*TEAM, "date"])


def schedule_strength(long: DataFrame, history: DataFrame, windows: tuple[int, ...] = (5, 10), budget: int = ROW_BUDGET) -> DataFrame:
    """opponent_elo_last<n>: mean rating, before those matches, of a team's last opponents."""
    rated = long.join(history.select("seq", "elo_a_pre", "elo_b_pre"), "seq").withColumn(
        "opponent_elo", F.when(F.col("side") == "a", F.col("elo_b_pre")).otherwise(F.col("elo_a_pre"))).drop("elo_a_pre", "elo_b_pre")
    return rolling_means(rated, ["opponent_elo"], windows, budget=budget)


def h2h_last(matches: DataFrame, windows: tuple[int, ...] = (3, 5), budget: int = ROW_BUDGET) -> DataFrame:
    """seq and h2h_last_<n>: share of the pair's last meetings that side a won, null before the first."""
    met = meetings(matches).withColumn("lo_won", (F.col("winner_team") == F.col("lo")).cast("int"))
    rolled = rolling_means(met, ["lo_won"], windows, PAIR, budget)
    return rolled.select("seq", *[F.when(F.col("a_is_lo"), F.col(f"lo_won_last{n}")).otherwise(1 - F.col(f"lo_won_last{n}")).alias(f"h2h_last_{n}")
                                  for n in windows])
