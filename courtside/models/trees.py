"""Tree models over the feature columns: who wins, by what margin, by how many points."""

from __future__ import annotations

from dataclasses import replace
from typing import Self

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.functions.scores import margin_training_frame
from courtside.models.baselines import point_diff
from courtside.models.boosting import Boosted, Settings, fit_boosted, trained_by
from courtside.operators.evaluation import label
from courtside.schemas import MARGINS


def row_key() -> Column:
    """Tells the rows of a feature frame apart when a tree uses a share of them."""
    return F.xxhash64("gender", "seq")


class _Trees:
    """A fitted model; the feature list is part of it, so saving it saves both."""

    DEFAULTS: dict = {}
    objective, outputs = "squared", 1

    def __init__(self, model: Boosted | None = None, number: int = 0, **settings):
        self.model, self.number = model, number
        self.settings = replace(Settings(**self.DEFAULTS), **settings)

    def save(self, spark: SparkSession, path: str) -> None:
        only = slice(self.number, self.number + 1)
        kept = replace(self.model, start=self.model.start[only], gain=self.model.gain[only],
                       **{n: [a[only] for a in getattr(self.model, n)] for n in ("feature", "bound", "value")})
        kept.save(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Self:
        return cls(Boosted.load(spark, path))

    @property
    def feature_columns(self) -> list[str]:
        return self.model.columns

    def feature_importance(self, spark) -> DataFrame:
        """feature, importance: share of what all splits saved; highest first."""
        gain = self.model.gain[self.number]
        rows = [(c, float(g)) for c, g in zip(self.model.columns, gain / max(gain.sum(), 1e-300))]
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")

    def target(self) -> Column:
        raise NotImplementedError

    def frame(self, train: DataFrame, columns: list[str], pools: list[str] | None) -> tuple[DataFrame, Column]:
        """The training rows and each row's weight."""
        return train, F.lit(1.0)

    def fit(self, train: DataFrame, columns: list[str]) -> Self:
        """One model for all rows."""
        rows, weight = self.frame(train, columns, None)
        self.model = fit_boosted(rows, columns, self.target(), row_key(), trained_by(F.array(F.lit(0)), weight), 1, self.objective,
                                 self.outputs, self.settings)
        return self

    def fit_pools(self, train: DataFrame, columns: list[str], pools: list[str]) -> dict[str, Self]:
        """One model a pool, all fitted in the same passes."""
        rows, weight = self.frame(train, columns, pools)
        mine = F.array_compact(F.array(pool_number(pools)))
        model = fit_boosted(rows, columns, self.target(), row_key(), trained_by(mine, weight), len(pools), self.objective,
                            self.outputs, self.settings)
        made = {g: type(self)(model, i) for i, g in enumerate(pools)}
        for one in made.values():
            one.settings = self.settings
        return made

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        found = self.model.transform(df, "_found", self.number)
        return found.withColumn(out, F.col("_found")[self.outputs - 1]).drop("_found")


def pool_number(pools: list[str]) -> Column:
    """Place of a row's pool in the list; null for any other."""
    return F.coalesce(*[F.when(F.col("gender") == g, F.lit(i)) for i, g in enumerate(pools)])


class WinTrees(_Trees):
    """Boosted trees for the chance of side a."""

    DEFAULTS = {"least_rows": 20, "row_share": 0.8, "column_share": 0.8}
    objective = "logistic"

    def target(self) -> Column:
        return label()


class MarginTrees(_Trees):
    """Boosted trees for the three margins: one tree a round and margin, classes weighted to equal total weight."""

    DEFAULTS = {"penalty": 5.0}
    objective, outputs = "softmax", len(MARGINS)

    def target(self) -> Column:
        return margin_number()

    def frame(self, train: DataFrame, columns: list[str], pools: list[str] | None) -> tuple[DataFrame, Column]:
        rows = margin_training_frame(train, columns)
        pool = F.lit(0) if pools is None else pool_number(pools)
        sizes = {(r["g"], r["margin_class"]): r["n"] for r in rows.groupBy(pool.alias("g"), "margin_class").agg(F.count("*").alias("n")).collect()
                 if r["g"] is not None and r["margin_class"] is not None}
        weights = balanced(sizes)
        return rows, F.coalesce(*[F.when((pool == g) & (F.col("margin_class") == m), F.lit(w)) for (g, m), w in weights.items()], F.lit(0.0))

    def transform(self, df: DataFrame, prefix: str) -> DataFrame:
        """<prefix>_3-0, <prefix>_3-1, <prefix>_3-2."""
        found = self.model.transform(df, "_found", self.number)
        return found.withColumns({f"{prefix}_{m}": F.col("_found")[i] for i, m in enumerate(MARGINS)}).drop("_found")


def margin_number() -> Column:
    return F.coalesce(*[F.when(F.col("margin_class") == m, F.lit(float(i))) for i, m in enumerate(MARGINS)])


def balanced(sizes: dict[tuple, int]) -> dict[tuple, float]:
    """Weight of each (model, class): the model's largest class over this one."""
    top: dict = {}
    for (g, _), n in sizes.items():
        top[g] = max(top.get(g, 0), n)
    return {(g, m): top[g] / n for (g, m), n in sizes.items()}


class PointTrees(_Trees):
    """Boosted trees for the point difference."""

    objective = "squared"

    def target(self) -> Column:
        return point_diff()


def walk_forward_trees(folded: DataFrame, sets: dict[str, list[str]], settings: Settings, pools: list[str], n_folds: int = 5,
                       objective: str = "logistic", outputs: int = 1, y: Column | None = None, out: str = "p",
                       weights: dict[str, Column] | None = None) -> DataFrame:
    """Test rows once for every feature set (column model) with its prediction: all pools, folds and sets are fitted in the same passes.

    A fold is trained on the rows placed before it. ``weights`` gives a set an array column of row weights by fold (1 without it).
    """
    columns = list(dict.fromkeys(c for own in sets.values() for c in own))
    names = list(sets)
    many = len(names) * n_folds
    first = F.coalesce("test_fold", F.lit(-1)) + 1
    pool = pool_number(pools)
    ahead = F.when((first < n_folds) & pool.isNotNull(), F.sequence(first, F.lit(n_folds - 1))).otherwise(F.array().cast("array<int>"))

    def training(number: int, by_fold: Column | None) -> Column:
        def one(k: Column) -> Column:
            w = F.lit(1.0) if by_fold is None else F.element_at(by_fold, k + 1)
            return F.struct((pool * many + k * len(names) + number).cast("int").alias("m"), w.cast("double").alias("w"))
        return F.transform(ahead, one)

    trains = [training(i, (weights or {}).get(name)) for i, name in enumerate(names)]
    allowed = np.zeros((len(pools) * many, len(columns)), bool)
    for i, name in enumerate(names):
        allowed[i::len(names)] = [c in sets[name] for c in columns]
    model = fit_boosted(folded, columns, label() if y is None else y, row_key(), F.concat(*trains), len(pools) * many, objective, outputs,
                        settings, allowed)
    tested = folded.where(F.col("test_fold").isNotNull() & pool.isNotNull()).withColumn(
        "_set", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    scored = model.transform(tested, "_found", pool * many + F.col("test_fold") * len(names) + F.col("_set"))
    value = F.col("_found") if outputs > 1 else F.col("_found")[0]
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_set") + 1)
    return scored.withColumn(out, value).withColumn("model", named).drop("_found", "_set")
