"""Walk-forward evaluation: fit on the past of each fold, predict the fold, measure.

A predictor is a callable ``train -> (test -> test with a column p)``.  The loop over folds runs
on the driver; fitting and predicting are distributed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.operators.evaluation import label, summarize
from courtside.operators.folds import assert_no_fold_leak, fold_bounds, test_rows, train_rows

Predict = Callable[[DataFrame], DataFrame]
Predictor = Callable[[DataFrame], Predict]


def elo_predictor(train: DataFrame) -> Predict:
    """Nothing to fit: the rating before the match already knows only the past."""
    return lambda test: test.withColumn("p", F.col("elo_pred_a"))


elo_predictor.needs_training = False


def evaluate(folded: DataFrame, predictors: dict[str, Predictor], n_folds: int = 5,
             keep: tuple[str, ...] = ("gender", "seq")) -> DataFrame:
    """Out-of-fold predictions of every model: gender, seq, model, fold, p, y.

    Predictors marked ``needs_training = False`` score all folds in one pass, and those marked ``all_folds`` are called as
    (folded, n_folds) and fit all pools and folds together. Folds whose training rows reach past their first test day are an error.
    """
    assert_no_fold_leak(folded)
    parts = []
    for name, factory in predictors.items():
        if getattr(factory, "all_folds", False):
            scored = [factory(folded, n_folds)]
        elif getattr(factory, "needs_training", True):
            scored = [factory(train_rows(folded, i))(test_rows(folded, i)) for i in range(n_folds)]
        else:
            scored = [factory(folded)(folded.filter("test_fold IS NOT NULL"))]
        parts += [s.select(*keep, F.lit(name).alias("model"), F.col("test_fold").alias("fold"), "p", label().alias("y"))
                  for s in scored]
    return reduce(DataFrame.unionByName, parts)


def fold_metrics(predictions: DataFrame, folded: DataFrame) -> DataFrame:
    """gender, model, fold, train_size, n, log_loss, brier_score, accuracy."""
    sizes = fold_bounds(folded).select("gender", "fold", "train_size")
    return summarize(predictions, ["gender", "model", "fold"]).join(sizes, ["gender", "fold"])
