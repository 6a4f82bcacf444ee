"""Chronological splits: walk-forward folds and tail hold-outs, by exact position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.operators.ordering import null_safe_join, with_position
from courtside.session import cut


def _counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each pool, written: a table of known size meets all rows without a shuffle of them by pool, which would send a pool to one task."""
    return cut(df.groupBy(*keys).agg(F.count("*").alias("pool_n")))


def _with_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """Position in the pool and the pool's row count."""
    return null_safe_join(with_position(df, keys), _counts(df, keys), keys)


def assign_folds(df: DataFrame, n_folds: int = 5, min_train_fraction: float = 0.3,
                 keys: tuple[str, ...] = ("gender",)) -> DataFrame:
    """pos and test_fold per row; test_fold is null in the warm-up.

    Fold i is tested on its own rows and trained on everything placed before them.  The last
    fold takes the remainder.  A pool too short for the folds is an error when it is read.
    """
    start = F.greatest(F.lit(1), F.floor(F.col("pool_n") * F.lit(float(min_train_fraction)))).cast("bigint")
    rest = F.col("pool_n") - F.col("train_start")
    fold = F.least(F.floor((F.col("pos") - F.col("train_start")) / F.col("fold_size")), F.lit(n_folds - 1))
    short = F.raise_error(F.concat(F.lit("not enough rows for the folds: "), F.col("pool_n").cast("string")))
    return (
        _with_count(df, list(keys))
        .withColumn("train_start", start)
        .withColumn("fold_size", F.when(rest < n_folds, short.cast("bigint"))
                    .otherwise(F.floor(rest / F.lit(n_folds))).cast("bigint"))
        .withColumn("test_fold", F.when(F.col("pos") >= F.col("train_start"), fold).cast("int"))
    )


def year_folds(df: DataFrame, warm_up: int = 1, keys: tuple[str, ...] = ("gender",)) -> DataFrame:
    """test_fold per row by calendar year: fold i is tested on one year and trained on all years before it.

    The first ``warm_up`` years of a pool are only trained on (test_fold null), as is a row without a date; years without rows count.
    """
    first = df.groupBy(*keys).agg(F.min(F.year("date")).alias("_first"))
    fold = F.year("date") - F.col("_first") - F.lit(warm_up)
    return null_safe_join(df, first, list(keys)).withColumn("test_fold", F.when(fold >= 0, fold).cast("int")).drop("_first")


def train_rows(folded: DataFrame, fold: int) -> DataFrame:
    return folded.filter(F.coalesce("test_fold", F.lit(-1)) < fold)


def test_rows(folded: DataFrame, fold: int) -> DataFrame:
    return folded.filter(F.col("test_fold") == fold)


def fold_bounds(folded: DataFrame, keys: tuple[str, ...] = ("gender",)) -> DataFrame:
    """Per pool and fold: sizes, last training day, first test day, and whether they overlap.

    One aggregate per fold, then running values over that tiny table.
    """
    per = (folded.withColumn("fold", F.coalesce("test_fold", F.lit(-1)))
           .groupBy(*keys, "fold").agg(F.count("*").alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi")))
    before = Window.partitionBy(*keys).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    return (
        per.select(*keys, "fold", "n", F.sum("n").over(before).alias("train_size"),
                   F.max("hi").over(before).alias("max_train_date"), F.col("lo").alias("min_test_date"))
        .filter("fold >= 0")
        .withColumn("leak", F.col("max_train_date") > F.col("min_test_date"))
    )


def assert_no_fold_leak(folded: DataFrame) -> None:
    bad = fold_bounds(folded).filter("leak").limit(1).collect()
    if bad:
        raise AssertionError(f"training reaches past the first test day: {bad[0].asDict()}")


def for_each_training_fold(folded: DataFrame, n_folds: int = 5) -> DataFrame:
    """Repeat a row once for every fold that trains on it (column fold)."""
    first = F.coalesce("test_fold", F.lit(-1)) + 1
    return folded.withColumn("_first", first).filter(F.col("_first") < n_folds).withColumn(
        "fold", F.explode(F.sequence("_first", F.lit(n_folds - 1)))).drop("_first")


def for_each_later_fold(df: DataFrame, own: str, n_folds: int = 5) -> DataFrame:
    """Repeat a row once for every fold after its ``own`` one (column fold)."""
    return df.filter(F.col(own) < n_folds - 1).withColumn("fold", F.explode(F.sequence(F.col(own) + 1, F.lit(n_folds - 1)))).drop(own)


def fold_weights(folded: DataFrame, scheme: str, n_folds: int = 5, days: float = 365.0, keys: tuple[str, ...] = ("gender",)) -> DataFrame:
    """Adds ``fold_weights``: what a row counts for in the training of each fold, an array with an entry a fold.

    Age is the days from the row to the fold's first test day. ``expanding``: 1 at any age; ``rolling``: 1 up to ``days``, 0
    beyond; ``decayed``: halved every ``days``. Rows that a fold does not train on, and rows without a date unless
    expanding, have 0 there; so has a fold without test rows.
    """
    if scheme not in ("expanding", "rolling", "decayed"):
        raise ValueError(f"unknown scheme {scheme}")
    starts = folded.where("test_fold IS NOT NULL").groupBy(*keys, "test_fold").agg(F.min("date").alias("_start")).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("test_fold", "_start"))).alias("_starts"))  # an entry a fold
    starts = cut(starts)  # a row a pool: see _counts

    def weight(fold: int) -> Column:
        start = F.try_element_at("_starts", F.lit(fold))
        age = F.datediff(start, "date").cast("double")
        w = {"expanding": F.when(start.isNotNull(), 1.0), "rolling": F.when(age <= days, 1.0),
             "decayed": F.pow(F.lit(0.5), age / F.lit(float(days)))}[scheme]
        return F.when(F.coalesce("test_fold", F.lit(-1)) < fold, F.coalesce(w, F.lit(0.0))).otherwise(0.0)

    return null_safe_join(folded, starts, list(keys), "left").withColumn(
        "fold_weights", F.array(*[weight(i) for i in range(n_folds)])).drop("_starts")


def tail_split(df: DataFrame, fraction: float, keys: tuple[str, ...] = ("gender",)) -> DataFrame:
    """held_out marks the last part of each pool; the first floor(n * (1 - fraction)) rows stay in.

    The training rows of a fold are the first rows of their pool, so their positions (pos) are
    used as they are.
    """
    first = F.floor(F.col("pool_n") * F.lit(1 - fraction))
    if "pos" in df.columns:
        placed = null_safe_join(df.drop("pool_n"), _counts(df, list(keys)), list(keys))
    else:
        placed = _with_count(df, list(keys))
    return placed.withColumn("held_out", F.col("pos") >= first)
