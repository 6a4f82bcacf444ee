"""Training on everything known: models, ratings, state and run metadata, written per pool."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.models.trees import MarginTrees, PointTrees, WinTrees
from courtside.operators.elo import EloConfig, last_ratings
from courtside.operators.form import WINDOWS
from courtside.operators.h2h import pair_days
from courtside.operators.state import team_state
from courtside.plans.features import FEATURE_COLUMNS, build_features, feature_columns
from courtside.plans.predict import fixture_features, judge_requests, predict
from courtside.schemas import GENDERS
from courtside.session import cut


@dataclass
class Bundle:
    """Everything needed to score fixtures."""

    models: dict[str, tuple[WinTrees, MarginTrees, PointTrees]]
    ratings: DataFrame
    states: DataFrame
    days: DataFrame
    metadata: DataFrame
    elo: EloConfig = EloConfig()
    windows: tuple[int, ...] = WINDOWS

    def predict(self, fixtures: DataFrame, competitions: DataFrame) -> DataFrame:
        """A record per fixture. One that cannot be scored has its reason in the last column and nothing but its own columns."""
        judged = judge_requests(fixtures, competitions)
        pool = F.coalesce(F.col("gender").isin(*self.models), F.lit(False))
        judged = judged.withColumn("reason", F.coalesce("reason", F.when(~pool, F.lit("no model for the pool"))))
        refused = judged.where("reason IS NOT NULL").select("gender", "team_a", "team_b", "date", "competition_id", "reason")
        features = fixture_features(judged.where("reason IS NULL").drop("reason"), self.ratings, self.states, self.days, competitions,
                                    self.windows, self.elo.initial_rating)
        columns = feature_columns(self.windows)
        parts = [predict(features.filter(F.col("gender") == g), *models, columns).withColumn("reason", F.lit(None).cast("string"))
                 for g, models in self.models.items()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*parts, refused])


def run_metadata(features: DataFrame, columns: list[str] = FEATURE_COLUMNS) -> DataFrame:
    """Per pool: matches, date range, features and teams of a training run."""
    teams = features.select("gender", F.explode(F.array("team_a", "team_b")).alias("team")).distinct()
    sizes = teams.groupBy("gender").agg(F.count("*").alias("n_teams"))
    return features.groupBy("gender").agg(
        F.count("*").alias("n_matches"), F.min("date").alias("date_min"), F.max("date").alias("date_max")
    ).join(sizes, "gender").withColumn("feature_columns", F.lit(",".join(columns)))


def train_all(matches: DataFrame, competitions: DataFrame, win: dict | None = None, margin: dict | None = None,
              points: dict | None = None, elo: EloConfig = EloConfig(), windows: tuple[int, ...] = WINDOWS) -> Bundle:
    """Ratings and features are computed once and shared by state, metadata and the three models."""
    features = cut(build_features(matches, competitions, elo, windows), "gender")
    columns = feature_columns(windows)
    pools = [g for g in GENDERS if features.filter(F.col("gender") == g).limit(1).count()]
    kinds = (WinTrees(**(win or {})), MarginTrees(**(margin or {})), PointTrees(**(points or {})))
    fitted = [kind.fit_pools(features, columns, pools) for kind in kinds] if pools else []
    models = {g: tuple(by_pool[g] for by_pool in fitted) for g in pools}
    return Bundle(models, last_ratings(features), team_state(features), pair_days(features),
                  run_metadata(features, columns), elo, windows)


def save_bundle(bundle: Bundle, path: str) -> None:
    spark = bundle.ratings.sparkSession
    for g, (win, margin, points) in bundle.models.items():
        win.save(spark, f"{path}/models/{g}/win")
        margin.save(spark, f"{path}/models/{g}/margin")
        points.save(spark, f"{path}/models/{g}/points")
    for name in ("ratings", "states", "days"):
        getattr(bundle, name).write.mode("overwrite").partitionBy("gender").parquet(f"{path}/{name}")
    settings = {"trained_at": F.current_timestamp(), "initial_rating": F.lit(bundle.elo.initial_rating), "windows": F.lit(list(bundle.windows))}
    bundle.metadata.withColumns(settings).write.mode("overwrite").parquet(f"{path}/metadata")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("ratings", "states", "days", "metadata")}
    pools = [g for g in GENDERS if tables["metadata"].filter(F.col("gender") == g).limit(1).count()]
    models = {g: (WinTrees.load(spark, f"{path}/models/{g}/win"), MarginTrees.load(spark, f"{path}/models/{g}/margin"),
                  PointTrees.load(spark, f"{path}/models/{g}/points")) for g in pools}
    kept = tables["metadata"].first()
    settings = {"elo": EloConfig(initial_rating=kept["initial_rating"]), "windows": tuple(kept["windows"])} if kept else {}
    return Bundle(models, **tables, **settings)
