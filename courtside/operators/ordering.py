"""Order inside very large groups, without one task ever holding a whole group.

A window over ``partitionBy(key)`` runs one task per key.  When a key may hold a third of
all rows that is too much, so the helpers here cut an ordered group into bounded pieces and
carry what each piece needs from the pieces before it.

``seq`` is a unique integer row number; it breaks ties inside a day.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rows one task may hold of a single ordered group.
ROW_BUDGET = 2_000_000
# Width of the seq ranges used to number rows inside one day.
SEQ_WIDTH = 1 << 20


def with_position(df: DataFrame, keys: list[str], out: str = "pos", date: str = "date",
                  seq: str = "seq", width: int = SEQ_WIDTH) -> DataFrame:
    """Zero-based position of each row in its group, ordered by (date, seq).

    Rows are counted per (group, day, seq range).  Running sums over those counts give every
    range its offset, and the row number inside one range (at most ``width`` rows) does the rest.
    """
    cell = [*keys, date, "_range"]
    ranged = df.withColumn("_range", F.floor(F.col(seq) / F.lit(width)))
    cells = ranged.groupBy(*cell).agg(F.count("*").alias("_n"))
    days = cells.groupBy(*keys, date).agg(F.sum("_n").alias("_dn"))
    by_day = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*keys, date, F.coalesce(F.sum("_dn").over(by_day), F.lit(0)).alias("_day_off"))
    in_day = Window.partitionBy(*keys, date).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        null_safe_join(cells.withColumn("_range_off", F.coalesce(F.sum("_n").over(in_day), F.lit(0))), days, [*keys, date])
        .select(*cell, (F.col("_day_off") + F.col("_range_off")).alias("_off"))
    )
    local = F.row_number().over(Window.partitionBy(*cell).orderBy(seq))
    return (
        null_safe_join(ranged.withColumn("_local", local), offsets, cell)
        .withColumn(out, (F.col("_off") + F.col("_local") - 1).cast("bigint"))
        .drop("_range", "_local", "_off")
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null, keeping the left side's keys."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [left[k].eqNullSafe(named[f"_right_{k}"]) for k in keys]
    return left.join(named, on, how).drop(*[f"_right_{k}" for k in keys])


@dataclass(frozen=True)
class GroupSizes:
    """Rows in the largest pool, the largest team and the largest pair."""

    pool: int
    team: int
    pair: int


def group_sizes(matches: DataFrame) -> GroupSizes:
    """One pass over the matches; teams and pools are summed from the pair counts."""
    pairs = matches.groupBy(
        "gender", F.least("team_a", "team_b").alias("lo"), F.greatest("team_a", "team_b").alias("hi")
    ).agg(F.count("*").alias("n"))
    sides = pairs.select("gender", "n", "lo", F.explode(F.array("lo", "hi")).alias("team"))
    teams = sides.groupBy("gender", "team").agg(
        F.sum("n").alias("team_n"), F.sum(F.when(F.col("team") == F.col("lo"), F.col("n"))).alias("as_lo"),
        F.max("n").alias("pair_n"))
    pools = teams.groupBy("gender").agg(
        F.sum("as_lo").alias("pool_n"), F.max("team_n").alias("team_n"), F.max("pair_n").alias("pair_n"))
    top = pools.agg(F.max("pool_n"), F.max("team_n"), F.max("pair_n")).first()
    return GroupSizes(*(value or 0 for value in top))


@dataclass
class Pieces:
    """Rows tagged with ``piece``; ``split`` tells whether any group was cut at all."""

    rows: DataFrame
    split: bool


def cut_hot_groups(df: DataFrame, keys: list[str], date: str = "date", seq: str = "seq",
                   budget: int = ROW_BUDGET, largest: int | None = None) -> Pieces:
    """Tag rows with a ``piece`` number so that (keys, piece) never holds over 2 * budget rows.

    Group sizes are counted first (pre-aggregated on the map side).  With no group over the
    budget all rows keep piece 0 and a plain window does.  Otherwise only the large groups are
    cut along their day counts; a day that is itself too large is cut along seq ranges.
    A caller that knows the size of the largest group passes it as ``largest``.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    if largest is None:
        largest = sizes.agg(F.max("_n")).first()[0] or 0
    if largest <= budget:
        return Pieces(df.withColumn("piece", F.lit(0).cast("bigint")), False)

    hot = sizes.filter(F.col("_n") > budget).select(*keys, F.lit(True).alias("_hot"))
    marked = df.join(hot, keys, "left")
    days = marked.filter("_hot").groupBy(*keys, date).agg(F.count("*").alias("_n"))
    fat = days.filter(F.col("_n") > budget).select(*keys, date, F.lit(True).alias("_fat"))
    marked = marked.join(fat, [*keys, date], "left").withColumn(
        "_range", F.when(F.col("_fat"), F.floor(F.col(seq) / F.lit(budget))).otherwise(F.lit(0)))
    cell = [*keys, date, "_range"]
    before = Window.partitionBy(*keys).orderBy(date, "_range").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        marked.filter("_hot").groupBy(*cell).agg(F.count("*").alias("_n"))
        .select(*cell, F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / F.lit(budget))
                .cast("bigint").alias("piece"))
    )
    tagged = (
        marked.join(cells, cell, "left")
        .withColumn("piece", F.coalesce("piece", F.lit(0).cast("bigint")))
        .drop("_hot", "_fat", "_range")
    )
    return Pieces(tagged, True)
