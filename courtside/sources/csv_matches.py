"""Raw matches from CSV files with a configurable header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.sources.files import number_lines
from courtside.schemas import RAW_MATCH

# The expected columns, which are also the default header.
CSV_COLUMNS = ["date", "gender", "competition", "stage", "team_a", "team_b", "team_a_score", "team_b_score",
               "sets_a", "sets_b", "venue", "country_host"]


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def _score(c: Column) -> Column:
    """Integer part of a number written as text; null for blank or anything else."""
    return _blank_to_null(F.trim(c)).try_cast("double").try_cast("int")


def _unreadable(c: Column) -> Column:
    """Neither blank nor a number."""
    return (F.trim(c) != "") & _score(c).isNull()


def _count(c: Column) -> Column:
    """A whole number written as text; null for blank, fractions or anything else."""
    return F.when(F.trim(c).rlike(r"^[+-]?[0-9]+$"), F.trim(c).try_cast("int"))


def read_csv_matches(spark: SparkSession, path: str, source: str = "csv",
                     column_map: dict[str, str] | None = None) -> DataFrame:
    """Raw rows; source_match_id is <file stem>_<row number>.

    The header names the columns, so it is read once per file set; everything stays text until
    it is cast here.  A set count that is not a whole number becomes null and the quality gate rejects it; so it does with a
    score that is neither blank nor a number (column ``unreadable``).
    """
    names = {c: c for c in CSV_COLUMNS} | (column_map or {})
    fields = spark.read.option("header", True).csv(path).columns
    if not fields:
        return spark.createDataFrame([], RAW_MATCH)
    missing = [names[c] for c in ("date", "gender", "competition", "team_a", "team_b", "sets_a", "sets_b")
               if names[c] not in fields]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    schema = ", ".join(f"`{f}` string" for f in fields)
    text = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    lines = number_lines(text)

    def col(name: str) -> Column:
        return F.col(names[name]) if names[name] in fields else F.lit(None).cast("string")

    none = F.lit(None)
    return lines.select(
        "seq",
        F.lit(source).alias("source"),
        F.concat_ws("_", F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", ""),
                    F.col("line").cast("string")).alias("source_match_id"),
        col("date").alias("date_str"),
        F.lower(F.trim(col("gender"))).alias("gender"),
        col("competition").alias("competition_name"),
        _blank_to_null(col("stage")).alias("stage_str"),
        col("team_a").alias("team_a_name"),
        col("team_b").alias("team_b_name"),
        _score(col("team_a_score")).alias("team_a_score"),
        _score(col("team_b_score")).alias("team_b_score"),
        _count(col("sets_a")).alias("sets_a"),
        _count(col("sets_b")).alias("sets_b"),
        _blank_to_null(col("venue")).alias("venue"),
        _blank_to_null(col("country_host")).alias("country_host"),
        none.cast("boolean").alias("neutral"),
        none.cast("string").alias("tournament_no"),
        none.cast("int").alias("no_in_tournament"),
        F.coalesce(_unreadable(col("team_a_score")) | _unreadable(col("team_b_score")), F.lit(False)).alias("unreadable"),
    )
