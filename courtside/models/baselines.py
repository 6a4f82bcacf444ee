"""Reference predictions of the point difference that need only aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def point_diff() -> Column:
    return (F.col("team_a_score") - F.col("team_b_score")).cast("double")


def _line_per_fold(folded: DataFrame, n_folds: int, x: Column, y: Column) -> DataFrame:
    """Per pool and fold, over all rows placed before the fold: mean of y, slope and intercept of y on x.

    The rows are read once, for centred moments of each fold's own rows; those of earlier folds are merged on that small table.
    """
    known = F.when(y.isNotNull(), x)
    both = F.when(x.isNotNull(), y)
    n = F.count(known)
    own = (folded.withColumn("_b", F.coalesce("test_fold", F.lit(-1))).groupBy("gender", "_b").agg(
        F.count(y).alias("rows"), F.sum(y).alias("total"), n.alias("n"), F.avg(known).alias("mx"), F.avg(both).alias("my"),
        (F.var_pop(known) * n).alias("xx"), (F.covar_pop(known, both) * n).alias("xy")))
    seen = own.where(F.col("_b") < n_folds - 1).withColumn("fold", F.explode(F.sequence(F.col("_b") + 1, F.lit(n_folds - 1))))
    means = seen.groupBy("gender", "fold").agg(
        (F.sum("total") / F.sum("rows")).alias("mean"), (F.sum(F.col("n") * F.col("mx")) / F.sum("n")).alias("x"),
        (F.sum(F.col("n") * F.col("my")) / F.sum("n")).alias("y"))
    dx, dy = F.col("mx") - F.col("x"), F.col("my") - F.col("y")
    spread = seen.join(means, ["gender", "fold"]).groupBy("gender", "fold").agg(
        F.first("mean").alias("_mean"), F.first("x").alias("x"), F.first("y").alias("y"),
        F.sum(F.col("xx") + F.col("n") * dx * dx).alias("xx"), F.sum(F.col("xy") + F.col("n") * dx * dy).alias("xy"))
    slope = F.when(F.col("xx") > 0, F.col("xy") / F.col("xx"))
    return spread.select("gender", "fold", "_mean", slope.alias("_b"), (F.col("y") - slope * F.col("x")).alias("_a"))


def _per_fold(folded: DataFrame, n_folds: int, x: Column, y: Column) -> DataFrame:
    return folded.filter("test_fold IS NOT NULL").withColumn("fold", F.col("test_fold")).join(
        _line_per_fold(folded, n_folds, x, y), ["gender", "fold"])


def mean_baseline(folded: DataFrame, n_folds: int = 5) -> DataFrame:
    """The training mean of each fold as the prediction for all its rows."""
    rows = _per_fold(folded, n_folds, F.lit(0.0), point_diff())
    return rows.select("gender", "seq", F.lit("mean_baseline").alias("model"), "fold", F.col("_mean").alias("p"), point_diff().alias("y"))


def linear_elo(folded: DataFrame, n_folds: int = 5) -> DataFrame:
    """Least squares of the point difference on elo_diff, fitted per fold."""
    x = F.col("elo_diff")
    rows = _per_fold(folded, n_folds, x, point_diff())
    return rows.select("gender", "seq", F.lit("linear_elo").alias("model"), "fold",
                       (F.col("_a") + F.col("_b") * x).alias("p"), point_diff().alias("y"))
