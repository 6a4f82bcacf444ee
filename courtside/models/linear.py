"""Logistic models: team strengths, rating difference, and Platt calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions.scores import logit
from courtside.operators.evaluation import label
from courtside.operators.folds import for_each_later_fold
from courtside.operators.graph import connected_groups
from courtside.operators.ordering import null_safe_join
from courtside.schemas import GENDERS
from courtside.session import cut, forget


def _penalised(n: float, c: float, intercept: bool) -> LogisticRegression:
    """Squared penalty with inverse strength c on the summed loss, as an average loss over n rows."""
    return LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1.0 / (c * n), elasticNetParam=0.0,
                              fitIntercept=intercept, standardization=False, maxIter=1000, tol=1e-9)


def _with_chance(model: LogisticRegressionModel, df: DataFrame, out: str) -> DataFrame:
    scored = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    return scored.drop("_x", "rawPrediction", "probability", "prediction")


STEPS = 400            # at most; some 30 are usual
WHOLE = 1000           # teams of a group that one task solves together (their pairs and one square matrix, some 20 MB)


def pair_counts(matches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lo, hi, n, won: meetings of each pair and how many of them lo won; what the strengths depend on."""
    lo = F.least("team_a", "team_b")
    winner = F.when(F.col("winner") == "team_a", F.col("team_a")).otherwise(F.col("team_b"))
    return matches.groupBy(*keys, lo.alias("lo"), F.greatest("team_a", "team_b").alias("hi")).agg(
        F.count("*").cast("double").alias("n"), F.sum((winner == lo).cast("double")).alias("won"),
        F.sum((F.col("winner") == "team_a").cast("double")).alias("a_won"))


def _newton(lo: np.ndarray, hi: np.ndarray, n: np.ndarray, won: np.ndarray, teams: int, c: float) -> np.ndarray:
    """Strengths of teams 0, 1, ... from their pairs: Newton steps, halved while they do not help."""
    def loss(w: np.ndarray) -> float:
        gap = w[lo] - w[hi]
        return float((n * np.logaddexp(0, gap) - won * gap).sum() + (w * w).sum() / (2 * c))

    w = np.zeros(teams)
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(w[hi] - w[lo]))
        miss, bend = n * p - won, n * p * (1 - p)
        slope = np.bincount(lo, miss, teams) - np.bincount(hi, miss, teams) + w / c
        h = np.zeros((teams, teams))
        np.add.at(h, (lo, hi), -bend)
        h += h.T
        h[np.diag_indices(teams)] += np.bincount(lo, bend, teams) + np.bincount(hi, bend, teams) + 1.0 / c
        move, now = np.linalg.solve(h, slope), loss(w)
        while loss(w - move) > now + 1e-12 * abs(now):
            move /= 2
        w -= move
        if np.abs(move).max() < 1e-12:
            break
    return w


def team_strengths(pairs: DataFrame, keys: list[str], c: float = 1.0, tolerance: float = 1e-6, whole: int = WHOLE) -> DataFrame:
    """keys, team, strength of the penalised likelihood's maximum, for all groups of ``keys`` at once.

    A group in which one side always won has strengths zero. Groups of at most ``whole`` teams are solved by one task each; if any has
    more teams, all are found by steps over the whole table.
    """
    teams = pairs.select(*keys, F.explode(F.array("lo", "hi")).alias("team")).distinct().groupBy(*keys).count()
    if (teams.agg(F.max("count")).first()[0] or 0) > whole:
        return _strengths_by_steps(pairs, keys, c, tolerance)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        number, names = pd.factorize(pd.concat([pdf["lo"], pdf["hi"]]), use_na_sentinel=False)
        lo, hi = number[:len(pdf)], number[len(pdf):]
        n, won, a_won = (pdf[x].to_numpy(float) for x in ("n", "won", "a_won"))
        met = lo != hi  # a team that is named on both sides says nothing
        fits = 0 < a_won.sum() < n.sum()
        w = _newton(lo[met], hi[met], n[met], won[met], len(names), c) if fits else np.zeros(len(names))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(names) for k in keys}, "team": names, "strength": w})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keys, F.col("lo").alias("team")).schema)
    return cut(pairs.groupBy(*keys).applyInPandas(solve, f"{kinds}, strength double"))


def _strengths_by_steps(pairs: DataFrame, keys: list[str], c: float, tolerance: float) -> DataFrame:
    """A step moves every team by its own gradient over twice its curvature and the penalty, with momentum that a team loses
    when it moves against its gradient. At the maximum the strengths of teams that are connected by meetings add up to zero, so each such set is
    centred. A step is joins and sums per team; strengths are a table throughout.
    """
    whole = pairs.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("a_won").alias("a")).select(
        *keys, ((F.col("a") > 0) & (F.col("a") < F.col("n"))).alias("fits"))
    known = cut(null_safe_join(pairs, whole, keys))
    sets = connected_groups(known.select(*keys, F.col("lo").alias("a"), F.col("hi").alias("b")), keys).withColumnsRenamed({"node": "team", "label": "set"})
    sided = known.select(*keys, "fits", F.inline(F.array(
        F.struct(F.col("lo").alias("team"), F.col("hi").alias("other"), F.col("n"), F.col("won")),
        F.struct(F.col("hi").alias("team"), F.col("lo").alias("other"), F.col("n"), (F.col("n") - F.col("won")).alias("won")))))
    zero = F.lit(0.0)
    each = sided.groupBy(*keys, "team").agg(F.first("fits").alias("fits"), F.sum("won").alias("won"), F.sum("n").alias("met"))
    now = cut(null_safe_join(each, sets, [*keys, "team"], "left").select(
        *keys, "team", "set", "fits", "won", "met", zero.alias("strength"), zero.alias("look"), zero.alias("age"), zero.alias("change")))
    slim = cut(sided.where("fits AND team <> other").select(*keys, "team", "other", "n"))
    forget(known)

    def step(now: DataFrame) -> DataFrame:
        mine = now.select(*keys, "team", F.col("look").alias("w"))
        theirs = now.select(*keys, F.col("team").alias("other"), F.col("look").alias("v"))
        chance = 1.0 / (1.0 + F.exp(F.col("v") - F.col("w")))
        met = null_safe_join(null_safe_join(slim, mine, [*keys, "team"]), theirs, [*keys, "other"])
        sums = met.withColumn("p", chance).groupBy(*keys, "team").agg(
            F.sum(F.col("n") * F.col("p")).alias("e"), F.sum(F.col("n") * F.col("p") * (1 - F.col("p"))).alias("q"))
        slope = F.col("e") + F.col("look") / c - F.col("won")
        bend = F.least(2 * F.col("q"), F.col("met") / 2) + 1.0 / c
        moved = null_safe_join(now.drop("change"), sums, [*keys, "team"], "left").withColumn("slope", slope).withColumn(
            "next", F.when(F.col("fits") & F.col("e").isNotNull(), F.col("look") - F.col("slope") / bend).otherwise(zero))
        middle = moved.groupBy(*keys, "set").agg(F.avg("next").alias("mean"))
        moved = null_safe_join(moved, middle, [*keys, "set"]).withColumn("next", F.col("next") - F.col("mean")).withColumn(
            "change", F.col("next") - F.col("strength"))
        moved = moved.withColumn("age", F.when(F.col("change") * F.col("slope") > 0, zero).otherwise(F.col("age") + 1))
        return moved.select(*keys, "team", "set", "fits", "won", "met", F.col("next").alias("strength"),
                            (F.col("next") + F.col("age") / (F.col("age") + 3) * F.col("change")).alias("look"), "age", "change")

    for _ in range(STEPS):
        after = cut(step(now))
        forget(now)
        now = after
        if (now.agg(F.max(F.abs("change"))).first()[0] or 0.0) < tolerance:
            break
    return now.select(*keys, "team", "strength")


@dataclass
class BradleyTerry:
    """Team strengths such that P(a beats b) = 1 / (1 + exp(strength_b - strength_a)), with a squared penalty of inverse strength c."""

    c: float = 1.0
    strengths: DataFrame | None = None
    whole: int = WHOLE

    def fit(self, matches: DataFrame) -> BradleyTerry:
        one = matches.withColumn("_all", F.lit(0))
        self.strengths = team_strengths(pair_counts(one, ["_all"]), ["_all"], self.c, whole=self.whole).drop("_all")
        return self

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        """Unseen teams count as average."""
        scored = df
        for side in ("a", "b"):
            mine = self.strengths.select(F.col("team").alias(f"team_{side}"), F.col("strength").alias(f"_s{side}"))
            scored = scored.join(mine, f"team_{side}", "left")
        gap = F.coalesce("_sa", F.lit(0.0)) - F.coalesce("_sb", F.lit(0.0))
        return scored.withColumn(out, 1.0 / (1.0 + F.exp(-gap))).drop("_sa", "_sb")


class _OneFeature:
    """Logistic regression on a single column; without two classes it falls back to ``_plain``."""

    def __init__(self):
        self.model = None

    def _fit(self, rows: DataFrame):
        n, classes = rows.agg(F.count("*"), F.count_distinct("_y")).first()
        if classes >= 2:
            assembler = VectorAssembler(inputCols=["_v"], outputCol="_x")
            self.model = _penalised(n, 1.0, True).fit(assembler.transform(rows))
        return self

    def _score(self, df: DataFrame, value, out: str, plain) -> DataFrame:
        if self.model is None:
            return df.withColumn(out, plain)
        rows = VectorAssembler(inputCols=["_v"], outputCol="_x").transform(df.withColumn("_v", value))
        return _with_chance(self.model, rows, out).drop("_v")


class EloLogistic(_OneFeature):
    """Learns the scale of the rating difference instead of assuming it."""

    @staticmethod
    def _value():
        return F.col("elo_a_pre") - F.col("elo_b_pre")

    def fit(self, train: DataFrame) -> EloLogistic:
        return self._fit(train.select(self._value().alias("_v"), label().alias("_y")))

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        return self._score(df, self._value(), out, F.lit(0.5))


class Platt(_OneFeature):
    """Logistic curve on the logit of a probability; the identity when only one class was seen."""

    def fit(self, rows: DataFrame) -> Platt:
        return self._fit(rows.select(logit(F.col("p")).alias("_v"), F.col("y").alias("_y")))

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        return self._score(df, logit(F.col("p")), out, F.col("p"))


def bradley_terry_by_fold(folded: DataFrame, n_folds: int = 5, c: float = 1.0) -> DataFrame:
    """The test rows with p; every pool and fold has strengths of its own, from the rows before it, all found in the same steps.

    A team that a fold has not seen counts as average.
    """
    own = pair_counts(folded.withColumn("_own", F.coalesce("test_fold", F.lit(-1))), ["gender", "_own"])
    ahead = for_each_later_fold(own, "_own", n_folds).groupBy("gender", "fold", "lo", "hi").agg(
        *[F.sum(x).alias(x) for x in ("n", "won", "a_won")])
    strengths = team_strengths(ahead, ["gender", "fold"], c)
    scored = folded.where("test_fold IS NOT NULL")
    for side in ("a", "b"):
        mine = strengths.select("gender", F.col("fold").alias("test_fold"), F.col("team").alias(f"team_{side}"), F.col("strength").alias(f"_s{side}"))
        scored = null_safe_join(scored, mine, ["gender", "test_fold", f"team_{side}"], "left")
    gap = F.coalesce("_sa", F.lit(0.0)) - F.coalesce("_sb", F.lit(0.0))
    return scored.withColumn("p", 1.0 / (1.0 + F.exp(-gap))).drop("_sa", "_sb")


def fit_logistic(rows: DataFrame, xs: list[Column], y: Column, trains: Column, models: int, c: float = 1.0, steps: int = 50) -> np.ndarray:
    """[model, 1 + len(xs)]: intercept (not penalised) and slopes of weighted logistic regressions, all models in one aggregate a step.

    ``trains`` is an array of (m, w). Newton steps, halved while they raise a model's loss; NaN for a model whose rows
    are of one class. Rows with a null among y and xs are left out.
    """
    k = len(xs) + 1
    slim = rows.select(y.cast("double").alias("y"), *[x.cast("double").alias(f"x{i}") for i, x in enumerate(xs, 1)], F.inline(trains))
    slim = cut(slim.dropna().where("w > 0").withColumn("x0", F.lit(1.0)))
    found = np.zeros((models, k))
    scale = np.ones((models, k))
    moments = slim.groupBy("m").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("y"), *[
        F.max(F.abs(f"x{i}")).alias(f"s{i}") for i in range(1, k)])
    state = {r["m"]: r for r in moments.collect()}  # a row a model
    one_class = np.ones(models, bool)
    for m, r in state.items():
        one_class[m] = not 0 < r["y"] < r["n"]
        scale[m, 1:] = [r[f"s{i}"] or 1.0 for i in range(1, k)]
        if not one_class[m]:
            found[m, 0] = np.log(r["y"] / (r["n"] - r["y"]))
    step, before, last = np.ones(models), found.copy(), np.full(models, np.inf)

    def number(values: np.ndarray) -> Column:
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("m") + 1)

    moving = ~one_class
    for _ in range(steps):
        z = sum((number(found[:, i]) * F.col(f"x{i}") for i in range(1, k)), number(found[:, 0]))
        p = 1.0 / (1.0 + F.exp(-F.col("z")))
        loss = F.col("w") * (F.greatest(F.col("z"), F.lit(0.0)) - F.col("y") * F.col("z") + F.log1p(F.exp(-F.abs("z"))))
        sums = slim.withColumn("z", z).withColumn("r", F.col("w") * (p - F.col("y"))).withColumn("q", F.col("w") * p * (1 - p)).groupBy("m").agg(
            F.sum(loss).alias("loss"), *[F.sum(F.col("r") * F.col(f"x{i}")).alias(f"g{i}") for i in range(k)],
            *[F.sum(F.col("q") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)])
        for r in sums.collect():
            m = r["m"]
            if not moving[m]:
                continue
            ridge = np.r_[0.0, np.full(k - 1, 1.0 / c)]
            total = r["loss"] + 0.5 * (ridge * found[m] ** 2).sum()
            if total > last[m] + 1e-9 * abs(last[m]):
                step[m] /= 2
                found[m] = (found[m] + before[m]) / 2
                continue
            g = np.array([r[f"g{i}"] for i in range(k)]) + ridge * found[m]
            h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + np.diag(ridge)
            d = scale[m]
            move = np.linalg.solve((h / d[:, None] / d) + 1e-12 * np.eye(k) * max(r["h0_0"], 1e-12), g / d) / d
            before[m], last[m] = found[m].copy(), total
            found[m] = found[m] - move
            moving[m] = np.abs(move * d).max() > 1e-10
        if not moving.any():
            break
    forget(slim)
    found[one_class] = np.nan
    return found


def logistic_chance(coefficients: np.ndarray, xs: list[Column], model: Column, plain: float | Column = 0.5) -> Column:
    """Chance by each row's model; ``plain`` where the model has none."""
    def number(values: np.ndarray) -> Column:
        return F.element_at(F.array(*[F.lit(None if np.isnan(v) else float(v)).cast("double") for v in values]), model + 1)
    z = sum((number(coefficients[:, i]) * x for i, x in enumerate(xs, 1)), number(coefficients[:, 0]))
    return F.coalesce(1.0 / (1.0 + F.exp(-z)), plain if isinstance(plain, Column) else F.lit(plain))


def elo_gap() -> Column:
    return F.col("elo_a_pre") - F.col("elo_b_pre")


def elo_logistic_by_fold(folded: DataFrame, n_folds: int = 5, weights: Column | None = None, pools: tuple[str, ...] = GENDERS) -> DataFrame:
    """The test rows with p from a logistic curve over the rating difference, one a pool and fold, all fitted together.

    ``weights`` is an array column: a training row's weight in each fold (1 without it).
    """
    pool = F.coalesce(*[F.when(F.col("gender") == g, F.lit(i)) for i, g in enumerate(pools)])
    first = F.coalesce("test_fold", F.lit(-1)) + 1
    ahead = F.when((first < n_folds) & pool.isNotNull(), F.sequence(first, F.lit(n_folds - 1))).otherwise(F.array().cast("array<int>"))
    trains = F.transform(ahead, lambda f: F.struct((pool * n_folds + f).cast("int").alias("m"), (
        F.lit(1.0) if weights is None else F.element_at(weights, f + 1)).cast("double").alias("w")))
    found = fit_logistic(folded, [elo_gap()], label(), trains, len(pools) * n_folds)
    return folded.where("test_fold IS NOT NULL").withColumn("p", logistic_chance(found, [elo_gap()], pool * n_folds + F.col("test_fold")))
