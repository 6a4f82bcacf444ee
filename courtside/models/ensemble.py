"""Combining predictions that already exist, and calibrating a model on a held-out tail."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtside.operators.context import lookup
from courtside.operators.evaluation import label
from courtside.operators.folds import tail_split
from courtside.operators.ordering import null_safe_join
from courtside.plans.walkforward import Predict, Predictor
from courtside.session import cut, forget


def average_predictions(predictions: DataFrame, weights: dict[str, float] | None = None,
                        name: str = "ensemble") -> DataFrame:
    """Weighted (or plain) mean over the models of each row of a long prediction frame."""
    if weights is None:
        models = [r["model"] for r in predictions.select("model").distinct().collect()]
        weights = {m: 1.0 / len(models) for m in models}
    weighted = predictions.filter(F.col("model").isin(*weights)).withColumn(
        "_w", lookup(weights, F.col("model"), 0.0) * F.col("p"))
    return weighted.groupBy("gender", "seq", "fold", "y").agg(F.sum("_w").alias("p")).withColumn("model", F.lit(name))


def average_ensemble(components: dict[str, Predictor], weights: dict[str, float] | None = None) -> Predictor:
    """A predictor that averages others; each component adds one column to the same test rows."""
    shares = weights or {name: 1.0 / len(components) for name in components}

    def factory(train: DataFrame) -> Predict:
        fitted = {name: make(train) for name, make in components.items()}

        def predict(test: DataFrame) -> DataFrame:
            total, out = F.lit(0.0), test
            for i, (name, apply) in enumerate(fitted.items()):
                out = apply(out.drop("p")).withColumn(f"_p{i}", F.col("p"))
                total = total + F.col(f"_p{i}") * shares[name]
            return out.withColumn("p", total).drop(*[f"_p{i}" for i in range(len(fitted))])
        return predict
    return factory


def calibrated(base: Predictor, calibrator: Callable, fraction: float = 0.2) -> Predictor:
    """Fit the base on the earlier part of the training rows and the calibrator on the later part."""
    def factory(train: DataFrame) -> Predict:
        split = cut(tail_split(train, fraction), "held_out")
        predict = base(split.filter(~F.col("held_out")).drop("held_out"))
        tail = cut(predict(split.filter("held_out")).select("p", label().alias("y")))
        fitted = calibrator().fit(tail)
        forget(split)
        return lambda test: fitted.transform(predict(test))
    return factory


def simplex_weights(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Weights w >= 0 that add up to 1 and minimise w'Gw / 2 - c'w, by active sets.

    On the current support the equality-constrained optimum is one small linear system; a weight that would turn negative leaves the
    support at zero, and one whose gradient lies below the multiplier comes back. Columns that are equal share their weight.
    """
    k = len(cross)
    size = max(float(np.abs(gram).max()), 1e-300)
    g, c = gram / size + 1e-12 * np.eye(k), cross / size
    w, inside = np.full(k, 1.0 / k), np.ones(k, bool)
    for _ in range(8 * k * k):
        some = np.flatnonzero(inside)
        n = len(some)
        system = np.zeros((n + 1, n + 1))
        system[:n, :n] = g[np.ix_(some, some)]
        system[n, :n] = system[:n, n] = 1.0
        goal = np.zeros(k)
        solved = np.linalg.solve(system, np.r_[c[some], 1.0])
        goal[some] = solved[:n]
        negative = inside & (goal < 0)
        if negative.any():
            # as far towards the optimum as all weights stay positive
            share = np.where(negative, w / np.maximum(w - goal, 1e-300), np.inf)
            first = int(share.argmin())
            w = w + share[first] * (goal - w)
            w[first], inside[first] = 0.0, False
            continue
        w = goal
        slope = g @ w - c
        level = -solved[n]
        outside = np.where(inside, np.inf, slope - level)
        back = int(outside.argmin())
        if outside[back] >= -1e-10:
            break
        inside[back] = True
    return w / w.sum()


def stacking_weights(predictions: DataFrame, models: list[str]) -> DataFrame:
    """gender, fold, n, weights (array in the order of ``models``): each fold's weights are learned from earlier folds only.

    ``predictions`` has gender, seq, model, fold, p, y, a row per model, as ``evaluate`` gives it. One aggregate per pool and fold gives the
    sums of products of predictions and outcomes; earlier folds' sums are added up on that table, whose
    rows are solved by themselves. Rows that lack a model's prediction are left out; a fold without earlier rows has equal weights.
    """
    return _weights(predictions, _side_by_side(predictions, models), models)


def _weights(predictions: DataFrame, wide: DataFrame, models: list[str]) -> DataFrame:
    k = len(models)
    parts = [f"g{i}_{j}" for i in range(k) for j in range(i, k)] + [f"c{i}" for i in range(k)] + ["n"]
    whole = wide.dropna(subset=[f"_p{i}" for i in range(k)] + ["y"])
    sums = whole.groupBy("gender", "fold").agg(
        *[F.sum(F.col(f"_p{i}") * F.col(f"_p{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)],
        *[F.sum(F.col(f"_p{i}") * F.col("y")).alias(f"c{i}") for i in range(k)], F.count("*").alias("n"))
    folds = null_safe_join(predictions.select("gender", "fold").distinct(), sums, ["gender", "fold"], "left")
    before = Window.partitionBy("gender").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    earlier = folds.select("gender", "fold", *[F.coalesce(F.sum(p).over(before), F.lit(0)).alias(p) for p in parts])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                gram = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
                cross = np.array([r[f"c{i}"] for i in range(k)], float)
                w = simplex_weights(gram, cross) if r["n"] else np.full(k, 1.0 / k)
                out.append((r["gender"], r["fold"], r["n"], w.tolist()))
            yield pd.DataFrame(out, columns=["gender", "fold", "n", "weights"])

    return earlier.mapInPandas(solve, "gender string, fold int, n bigint, weights array<double>")


def _side_by_side(predictions: DataFrame, models: list[str]) -> DataFrame:
    return predictions.where(F.col("model").isin(*models)).groupBy("gender", "seq", "fold").agg(
        F.first("y").alias("y"), *[F.max(F.when(F.col("model") == m, F.col("p"))).alias(f"_p{i}") for i, m in enumerate(models)])


def stacked_predictions(predictions: DataFrame, models: list[str], name: str = "stacked") -> DataFrame:
    """gender, seq, fold, y, p, model: each row's predictions weighted by ``stacking_weights``; where some are missing, by the others' weights."""
    wide = cut(_side_by_side(predictions, models))   # read for the weights and for the rows
    weights = _weights(predictions, wide, models).select("gender", "fold", "weights")
    rows = null_safe_join(wide, weights, ["gender", "fold"])
    share = [F.when(F.col(f"_p{i}").isNotNull(), F.col("weights")[i]).otherwise(0.0) for i in range(len(models))]
    total = sum(share[1:], share[0])
    value = sum((s * F.coalesce(F.col(f"_p{i}"), F.lit(0.0)) for i, s in enumerate(share)), F.lit(0.0))
    return rows.select("gender", "seq", "fold", "y", F.when(total > 0, value / total).alias("p"), F.lit(name).alias("model"))
