"""Line numbers of files that are read in splits, and generic readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from courtside.session import cut

# Splits, a row each, up to which their table is sent to every task (some 60 MB).
MOST_SPLITS = 500_000


def number_lines(df: DataFrame) -> DataFrame:
    """Add file, line (from 0, per file) and seq (from 0 over all files, in file order, then line order).

    A split is read by one task in order, so a line's place in it is how far its row id is from the split's first one. A small table
    with a row a split, of line counts summed over the splits before, does the rest; the text itself is neither sorted nor moved.
    """
    return number_located(locate_lines(df))


def locate_lines(df: DataFrame) -> DataFrame:
    """File and split of each line (on a stream too, where lines are numbered batch by batch)."""
    return df.select("*", F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("_block"))


def number_located(located: DataFrame) -> DataFrame:
    read = located.withColumn("_at", F.monotonically_increasing_id())
    splits = cut(read.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")))
    in_file = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # a row a file: a listing, not data
    over = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = splits.groupBy("file").agg(F.sum("_n").alias("_n")).select("file", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    shifts = splits.select("file", "_block", F.coalesce(F.sum("_n").over(in_file), F.lit(0)).alias("_shift"), "_first").join(files, "file")
    if splits.count() <= MOST_SPLITS:
        shifts = F.broadcast(shifts)
    return (read.join(shifts, ["file", "_block"])
            .withColumn("line", (F.col("_shift") + F.col("_at") - F.col("_first")).cast("bigint"))
            .withColumn("seq", (F.col("_before") + F.col("line")).cast("bigint"))
            .drop("_block", "_at", "_shift", "_first", "_before"))


def require_columns(df: DataFrame, columns) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_table(spark: SparkSession, path: str, schema, required=None) -> DataFrame:
    """A CSV table with declared types and required columns."""
    header = spark.read.option("header", True).csv(path)
    require_columns(header, required or schema.fieldNames())
    present = [f for f in schema.fields if f.name in header.columns]
    text = header.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in present])
    return text


def read_competitions(spark: SparkSession, path: str) -> DataFrame:
    header = spark.read.option("header", True).csv(path)
    require_columns(header, ["competition_id", "name", "gender", "level"])
    table = number_lines(header)  # of rows with one id the last counts
    club = F.col("is_club_competition").try_cast("boolean") if "is_club_competition" in table.columns else F.lit(False)
    return table.select("competition_id", "name", "gender", "level",
                        F.coalesce(club, F.lit(False)).alias("is_club_competition"), F.col("seq").alias("ord"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Alias rows with their file order (later rows win)."""
    schema = "canonical_team_id string, source string, source_name string"
    table = number_lines(spark.read.schema(schema).option("header", True).csv(path))
    return table.select("canonical_team_id", "source", "source_name", F.col("seq").alias("ord"))


def write_matches(matches: DataFrame, path: str, csv_path: str | None = None) -> None:
    """Parquet by gender; optionally CSV with blanks for nulls."""
    matches.write.mode("overwrite").partitionBy("gender").parquet(path)
    if csv_path:
        matches.write.mode("overwrite").option("header", True).option("nullValue", "").csv(csv_path)


def write_report(parts: list[DataFrame], path: str) -> None:
    """Reports of several pools or phases as one CSV."""
    from functools import reduce
    reduce(DataFrame.unionByName, parts).write.mode("overwrite").option("header", True).csv(path)
