"""Team state kept up batch by batch, with late matches put where they belong.

Every batch writes its rows by month and, for the pools it touches, a new version of the state. A batch is played on from the newest version that
ends before its own first day and is not outdated by late rows that came after it; only the rows since that day are read and replayed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from courtside.operators.elo import EloConfig, elo_history, final_ratings
from courtside.operators.form import WINDOWS
from courtside.operators.ordering import null_safe_join
from courtside.operators.state import team_state
from courtside.session import cut, forget

_ROWS = "seq bigint, date date, gender string, team_a string, team_b string, sets_a int, sets_b int, winner string"
_RECENT = "array<struct<date:date,won:boolean,sets_for:int,sets_against:int>>"
_STATE = f"gender string, team string, matches_played bigint, current_streak bigint, last_match_date date, recent {_RECENT}, elo double"
_POOLS = "gender string, first date, last date"
_TEAM = ["gender", "team"]


def advance(before: DataFrame, rows: DataFrame, windows: tuple[int, ...] = WINDOWS, elo: EloConfig = EloConfig()) -> DataFrame:
    """The state after ``rows`` from the state ``before`` them, all of whose matches lie on earlier days."""
    ratings = before.select(*_TEAM, F.col("elo").alias("rating"), F.unix_date("last_match_date").alias("day"))
    new = null_safe_join(team_state(rows, windows), final_ratings(rows, elo_history(rows, elo, start=ratings)), _TEAM)
    old = before.select(*_TEAM, *[F.col(c).alias(f"_{c}") for c in ("matches_played", "current_streak", "last_match_date", "recent", "elo")])
    keys = new.select(*_TEAM).unionByName(old.select(*_TEAM)).distinct()
    both = null_safe_join(null_safe_join(keys, new, _TEAM, "left"), old, _TEAM, "left")
    # a run that covers all new rows goes on from the old one if that is of the same kind
    goes_on = (F.abs("current_streak") == F.col("matches_played")) & (F.signum("current_streak") == F.signum("_current_streak"))
    streak = F.when(F.col("current_streak").isNull(), F.col("_current_streak")).otherwise(
        F.col("current_streak") + F.when(goes_on, F.col("_current_streak")).otherwise(0))
    recent = F.concat(F.coalesce("_recent", F.array().cast(_RECENT)), F.coalesce("recent", F.array().cast(_RECENT)))
    depth = max(windows)
    return both.select(
        *_TEAM, (F.coalesce("matches_played", F.lit(0)) + F.coalesce("_matches_played", F.lit(0))).cast("bigint").alias("matches_played"),
        streak.cast("bigint").alias("current_streak"), F.coalesce("last_match_date", "_last_match_date").alias("last_match_date"),
        F.when(F.size(recent) > depth, F.slice(recent, -depth, depth)).otherwise(recent).alias("recent"), F.coalesce("elo", "_elo").alias("elo"))


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _bases(pools: DataFrame, batch_id: int) -> DataFrame:
    """gender, base, since for the pools of a batch: the newest usable version and the last day it knows (both null if there is none).

    A version is usable if neither this batch nor one between begins on or before its last day.
    """
    later = Window.partitionBy("gender").orderBy("batch").rowsBetween(1, Window.unboundedFollowing)
    seen = pools.where(F.col("batch") <= batch_id).withColumn("next_first", F.min("first").over(later))
    here = seen.where(F.col("batch") == batch_id).select("gender")
    usable = seen.where((F.col("batch") < batch_id) & (F.col("last") < F.col("next_first")))
    newest = usable.groupBy("gender").agg(F.max_by(F.struct("batch", "last"), "batch").alias("v"))
    return here.join(newest, "gender", "left").select("gender", F.col("v.batch").alias("base"), F.col("v.last").alias("since"))


def merge_state(batch: DataFrame, batch_id: int, out: str, windows: tuple[int, ...] = WINDOWS, elo: EloConfig = EloConfig()) -> None:
    """Add a batch of matches (with unique ``seq``) and write the new version of the state of its pools.

    The batch number names the folders, so a batch that is run again replaces itself. Rows without a date are stored and left out.
    """
    spark = batch.sparkSession
    month = (F.year("date") * 100 + F.month("date")).cast("int")
    names = [c.split()[0] for c in _ROWS.split(", ")]
    (batch.select(*names).withColumn("month", F.coalesce(month, F.lit(0))).write.mode("overwrite").partitionBy("month").parquet(f"{out}/rows/batch={batch_id}"))
    stored = _stored(spark, f"{out}/rows", f"{_ROWS}, batch bigint, month int").where((F.col("batch") <= batch_id) & F.col("date").isNotNull())
    new = stored.where(F.col("batch") == batch_id).groupBy("gender").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    known = _stored(spark, f"{out}/pools", f"{_POOLS}, batch bigint").where(F.col("batch") < batch_id)
    # a version knows all days up to the latest that any batch so far has brought
    reached = known.groupBy("gender").agg(F.max("last").alias("reached"))
    new = null_safe_join(new, reached, ["gender"], "left").select("gender", "first", F.greatest("last", "reached").alias("last"))
    new.write.mode("overwrite").parquet(f"{out}/pools/batch={batch_id}")
    pools = _stored(spark, f"{out}/pools", f"{_POOLS}, batch bigint")
    bases = cut(_bases(pools, batch_id))  # a row a pool
    found = bases.agg(F.min(F.coalesce(F.year("since") * 100 + F.month("since"), F.lit(0))), F.collect_set("base")).first()
    # whole months before the earliest base are not listed
    rows = stored.where(F.col("month") >= (found[0] or 0))
    rows = cut(null_safe_join(rows, bases.select("gender", "since"), ["gender"]).where("since IS NULL OR date > since").drop("since", "batch", "month"))
    versions = _stored(spark, f"{out}/state", f"{_STATE}, batch bigint").where(F.col("batch").isin(found[1] or [-1]))
    before = versions.join(bases.select("gender", F.col("base").alias("batch")), ["gender", "batch"]).drop("batch")
    advance(before, rows, windows, elo).write.mode("overwrite").parquet(f"{out}/state/batch={batch_id}")
    forget(rows)
    forget(bases)


def current_state(spark: SparkSession, out: str) -> DataFrame:
    """The newest version of every pool's state."""
    newest = _stored(spark, f"{out}/pools", f"{_POOLS}, batch bigint").groupBy("gender").agg(F.max("batch").alias("batch"))
    return _stored(spark, f"{out}/state", f"{_STATE}, batch bigint").join(newest, ["gender", "batch"]).drop("batch")
