"""Incremental ingest of landed files, and scoring of fixtures as they arrive."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.operators.cleaning import first_per_meeting, first_per_source_id, judge
from courtside.operators.names import distinct_names, resolve_names
from courtside.operators.ordering import with_position
from courtside.schemas import columns
from courtside.session import cut, forget
from courtside.sources.files import locate_lines, number_located
from courtside.sources.landing import LANDING, translate, usable

BUCKETS = 256  # of judged ids
_SEEN = columns("source string, source_match_id string, batch bigint, bucket int")
_KEPT = columns("gender string, date date, team_a string, team_b string, batch bigint, month int")


def _earlier(spark: SparkSession, path: str, schema, batch_id: int, part: str, touched: list[int]) -> DataFrame:
    """Rows stored by earlier batches in the partitions that the new rows touch; a repeated batch ignores itself.

    Only these folders are listed and read: history costs a batch what lies in its own partitions, not all of it.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not touched or not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).where((F.col("batch") < batch_id) & F.col(part).isin(touched))


def _touched(rows: DataFrame, part: str) -> list[int]:
    """The partitions of the new rows: at most ``BUCKETS``, or a number a calendar month."""
    return sorted(r[0] for r in rows.select(part).where(F.col(part).isNotNull()).distinct().collect())


def merge_batch(batch: DataFrame, batch_id: int, out: str, source: str, aliases: DataFrame, competitions: DataFrame,
                countries: DataFrame | None = None, overrides: DataFrame | None = None) -> None:
    """Judge the new rows and append those whose source id and meeting are new.

    Judged rows are stored by buckets of their ids and matches by month. The batch number names the output folders, so a batch
    that is run again replaces itself.
    """
    spark = batch.sparkSession
    raw = cut(usable(translate(number_located(batch), source)))
    bucket = F.pmod(F.xxhash64("source", "source_match_id"), F.lit(BUCKETS)).cast("int")
    first = first_per_source_id(raw)
    seen = _earlier(spark, f"{out}/judged", _SEEN, batch_id, "bucket", _touched(raw.select(bucket.alias("bucket")), "bucket"))
    fresh = first.join(seen.select("source", "source_match_id"), ["source", "source_match_id"], "left_anti")
    resolved = resolve_names(distinct_names(raw), aliases, overrides, countries)
    judged = cut(judge(fresh, resolved, competitions, raw).drop("file", "line").withColumn("bucket", bucket))
    judged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/judged/batch={batch_id}")

    valid = judged.filter("reason IS NULL").drop("bucket").withColumn("lo", F.least("team_a", "team_b")).withColumn(
        "hi", F.greatest("team_a", "team_b")).withColumn("month", (F.year("date") * 100 + F.month("date")).cast("int"))
    kept = _earlier(spark, f"{out}/matches", _KEPT, batch_id, "month", _touched(valid, "month")).select(
        "gender", "date", F.least("team_a", "team_b").alias("lo"), F.greatest("team_a", "team_b").alias("hi"))
    new = first_per_meeting(valid).join(kept, ["gender", "date", "lo", "hi"], "left_anti")
    new.drop("lo", "hi", "reason").hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(f"{out}/matches/batch={batch_id}")
    forget(judged)
    forget(raw)


def ingest_available(spark: SparkSession, landing: str, out: str, aliases: DataFrame, competitions: DataFrame,
                     source: str = "landing", files_per_batch: int = 1000, **names) -> None:
    """Process the files landed since the last run, then stop.  The checkpoint remembers them."""
    lines = (spark.readStream.schema(LANDING).option("recursiveFileLookup", True)
             .option("maxFilesPerTrigger", files_per_batch).json(landing))
    merge = partial(merge_batch, out=out, source=source, aliases=aliases, competitions=competitions, **names)
    query = (locate_lines(lines).writeStream.foreachBatch(lambda df, i: merge(df, i))
             .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()


def stored_matches(spark: SparkSession, out: str) -> DataFrame:
    """All matches ingested so far, with seq in order of arrival."""
    rows = spark.read.parquet(f"{out}/matches").drop("month").withColumn("_all", F.lit(0))
    return (with_position(rows, ["_all"], out="arrival", date="batch").drop("_all", "seq", "batch")
            .withColumnRenamed("arrival", "seq"))


def score_available(spark: SparkSession, landing: str, schema, out: str, score) -> None:
    """Score fixtures landed as parquet since the last run: ``score`` maps a frame to a frame."""
    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/scored/batch={batch_id}")

    query = (spark.readStream.schema(schema).parquet(landing).writeStream.foreachBatch(write)
             .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
