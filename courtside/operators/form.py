"""Form of each side before a match: matches played, streak, rest, rolling rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtside.operators.ordering import ROW_BUDGET, cut_hot_groups

WINDOWS = (5, 10)
TEAM = ["gender", "team"]


def long_form(matches: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Two rows per match, one per side, with the result seen from that side."""
    def side(tag: str, other: str):
        return F.struct(
            F.lit(tag).alias("side"),
            F.col(f"team_{tag}").alias("team"),
            F.col(f"team_{other}").alias("opponent"),
            (F.col("winner") == f"team_{tag}").cast("int").alias("won"),
            F.col(f"sets_{tag}").cast("int").alias("sets_for"),
            F.col(f"sets_{other}").cast("int").alias("sets_against"),
        )
    return (
        matches.select("gender", "date", "seq", *extra, F.array(side("a", "b"), side("b", "a")).alias("_sides"))
        .select("gender", "date", "seq", *extra, F.inline("_sides"))
    )


def _with_carry(rows: DataFrame, depth: int) -> DataFrame:
    """Give every piece of a cut group its offset, last win/loss so far and ``depth`` earlier rows."""
    piece = [*TEAM, "piece"]
    forward = Window.partitionBy(*piece).orderBy("date", "seq")
    backward = Window.partitionBy(*piece).orderBy(F.desc("date"), F.desc("seq"))
    ranked = rows.withColumn("_rn", F.row_number().over(forward))
    totals = ranked.groupBy(*piece).agg(
        F.count("*").alias("_n"),
        F.max(F.when(F.col("won") == 1, F.col("_rn"))).alias("_w"),
        F.max(F.when(F.col("won") == 0, F.col("_rn"))).alias("_l"),
    )
    tail_row = F.struct("date", "seq", "won", "sets_for", "sets_against")
    tails = (
        rows.withColumn("_back", F.row_number().over(backward)).filter(F.col("_back") <= depth)
        .groupBy(*piece).agg(F.array_sort(F.collect_list(tail_row)).alias("_tail"))
    )
    order = Window.partitionBy(*TEAM).orderBy("piece")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        totals.join(tails, piece)
        .withColumn("off_n", F.coalesce(F.sum("_n").over(so_far), F.lit(0)))
        .withColumn("_w", F.col("off_n") + F.col("_w"))
        .withColumn("_l", F.col("off_n") + F.col("_l"))
        .withColumn("off_win", F.coalesce(F.max("_w").over(so_far), F.lit(0)))
        .withColumn("off_loss", F.coalesce(F.max("_l").over(so_far), F.lit(0)))
        .withColumn("_seen", F.flatten(F.collect_list("_tail").over(order.rowsBetween(-depth, -1))))
        .withColumn("_seen", F.when(F.size("_seen") > depth, F.slice("_seen", -depth, depth))
                    .otherwise(F.col("_seen")))
    )
    offsets = carry.select(*piece, "off_n", "off_win", "off_loss")
    ghosts = carry.select(*piece, F.inline("_seen")).withColumn("ghost", F.lit(1))
    return (
        rows.withColumn("ghost", F.lit(0)).unionByName(ghosts, allowMissingColumns=True)
        .join(offsets, piece, "left")
    )


def team_form(long: DataFrame, windows: tuple[int, ...] = WINDOWS, budget: int = ROW_BUDGET,
              largest: int | None = None) -> DataFrame:
    """Form columns for every row of the long frame, from earlier rows of the same team only."""
    pieces = cut_hot_groups(long, TEAM, budget=budget, largest=largest)
    if pieces.split:
        rows = _with_carry(pieces.rows, max(windows))
    else:
        zero = F.lit(0).cast("bigint")
        rows = (pieces.rows.withColumn("ghost", F.lit(0)).withColumn("off_n", zero)
                .withColumn("off_win", zero).withColumn("off_loss", zero))
    w = Window.partitionBy(*TEAM, "piece").orderBy("date", "seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    margin = F.col("sets_for") - F.col("sets_against")
    rows = rows.withColumn(
        "_pos", F.col("off_n") + F.sum(1 - F.col("ghost")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    real = F.col("ghost") == 0

    def last_place(won: int, carried: str):
        place = F.max(F.when(real & (F.col("won") == won), F.col("_pos"))).over(before)
        return F.greatest(F.coalesce(place, F.lit(0)), F.col(carried))

    rolling = {}
    for n in windows:
        frame = w.rowsBetween(-n, -1)
        rolling[f"win_rate_last{n}"] = F.avg("won").over(frame)
        rolling[f"set_margin_avg_last{n}"] = F.avg(margin).over(frame)
    rows = rows.withColumns({
        "_last_win": last_place(1, "off_win"), "_last_loss": last_place(0, "off_loss"),
        "_prev_won": F.lag("won").over(w), "_prev_date": F.lag("date").over(w), **rolling})
    played = F.col("_pos") - 1
    return (
        rows.filter(real)
        .withColumn("matches_played", played.cast("bigint"))
        .withColumn("current_streak", F.when(F.col("_prev_won").isNull(), F.lit(0))
                    .when(F.col("_prev_won") == 1, played - F.col("_last_loss"))
                    .otherwise(F.col("_last_win") - played).cast("bigint"))
        .withColumn("days_since_last", F.datediff("date", "_prev_date").cast("bigint"))
        .drop("ghost", "piece", "off_n", "off_win", "off_loss", "_pos", "_last_win", "_last_loss",
              "_prev_won", "_prev_date")
    )


def form_columns(windows: tuple[int, ...] = WINDOWS) -> list[str]:
    rolling = [f"{name}_last{n}" for n in windows for name in ("win_rate", "set_margin_avg")]
    return ["matches_played", "current_streak", "days_since_last", *rolling]


def form_by_match(form: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Back to one row per match (keyed by seq): a_* and b_* columns."""
    is_a = F.col("side") == "a"
    picks = []
    for name in form_columns(windows):
        picks.append(F.max(F.when(is_a, F.col(name))).alias(f"a_{name}"))
        picks.append(F.max(F.when(~is_a, F.col(name))).alias(f"b_{name}"))
    return form.groupBy("seq").agg(*picks)


def recent_dates(long: DataFrame, depth: int = 10, budget: int = ROW_BUDGET) -> DataFrame:
    """Provenance of the rolling columns: the dates of the up to ``depth`` rows before each row."""
    pieces = cut_hot_groups(long, TEAM, budget=budget)
    rows = _with_carry(pieces.rows, depth) if pieces.split else pieces.rows.withColumn("ghost", F.lit(0))
    w = Window.partitionBy(*TEAM, "piece").orderBy("date", "seq").rowsBetween(-depth, -1)
    return (rows.withColumn("source_match_dates", F.collect_list("date").over(w))
            .filter("ghost = 0").drop("ghost", "piece", "off_n", "off_win", "off_loss"))
