"""Quality gate: raw rows to matches, with the reason for every rejected row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.functions.dates import parse_date, plausible
from courtside.functions.text import name_key, stage_of
from courtside.operators.context import last_per_key
from courtside.operators.names import distinct_names, resolve_names
from courtside.schemas import GENDERS, MATCH
from courtside.session import cut


def first_by(df: DataFrame, keys: list[Column | str], seq: str = "seq") -> DataFrame:
    """First row of each key in input order.

    Spark limits each group to one row before the shuffle, so a key with very many copies sends
    one row per map task.
    """
    w = Window.partitionBy(*keys).orderBy(seq)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def first_per_source_id(raw: DataFrame) -> DataFrame:
    """Exact copies of a source row: the first wins, before any validation."""
    return first_by(raw, ["source", "source_match_id"])


def natural_key() -> list[Column]:
    return [F.col("gender"), F.col("date"), F.least("team_a", "team_b"), F.greatest("team_a", "team_b")]


def first_per_meeting(valid: DataFrame) -> DataFrame:
    """The same two teams on the same day: the first valid row wins."""
    return first_by(valid, natural_key())


def competition_lookup(rows: DataFrame, competitions: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """rows plus competition_id and competition, matched on the normalised name and the gender.

    The distinct names are taken from ``named`` (any frame that covers those of ``rows`` and is
    cheaper to read), so that the rows themselves are not computed twice.
    """
    keys = (rows if named is None else named).select("competition_name").distinct().withColumn("_ckey", name_key(F.col("competition_name")))
    dim = last_per_key(competitions.withColumn("_ckey", name_key(F.col("name"))), ["_ckey", "gender"], ["name", "competition_id"])
    dim = dim.select("_ckey", F.col("gender").alias("_g"), F.col("name").alias("competition"), "competition_id")
    known = keys.join(dim, "_ckey").drop("_ckey").withColumnRenamed("competition_name", "_cname")
    hit = (F.col("competition_name") == F.col("_cname")) & (F.col("gender") == F.col("_g"))
    return rows.join(known, hit, "left").drop("_cname", "_g")


def match_faults(sets_a: Column, sets_b: Column, score_a: Column, score_b: Column, team_a: Column,
                 team_b: Column) -> Column:
    """First broken rule of a match, or null."""
    valid = ((sets_a == 3) & sets_b.between(0, 2)) | ((sets_b == 3) & sets_a.between(0, 2))
    return F.coalesce(
        F.when((score_a < 0) | (score_b < 0), F.lit("negative score")),
        F.when(sets_a.isNull() | sets_b.isNull(), F.lit("missing sets")),
        F.when(~sets_a.between(0, 3) | ~sets_b.between(0, 3), F.lit("sets out of range")),
        F.when(team_a == team_b, F.lit("same team")),
        F.when(~valid, F.lit("not a best-of-five result")),
    )


def judge(rows: DataFrame, resolved: DataFrame, competitions: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Every row with its normalised columns and the first reason against it (null when valid).

    ``raw`` is the frame the rows were picked from, read again for the distinct names.
    """
    for side in ("a", "b"):
        names = resolved.select(F.col("source").alias("_src"), F.col("name").alias("_name"),
                                F.col("team_id").alias(f"team_{side}"))
        rows = rows.join(names, (F.col("source") == F.col("_src")) & (F.col(f"team_{side}_name") == F.col("_name")),
                         "left").drop("_src", "_name")
    rows = rows.withColumn("gender", F.lower(F.trim("gender")))
    rows = competition_lookup(rows, competitions, raw)
    unreadable = F.col("unreadable") if "unreadable" in rows.columns else F.lit(False)
    date = parse_date(F.col("date_str"))
    rows = rows.withColumns({
        "date": date,
        "stage": stage_of(F.col("stage_str")),
        "team_a_score": F.coalesce("team_a_score", F.lit(0)).cast("int"),
        "team_b_score": F.coalesce("team_b_score", F.lit(0)).cast("int"),
        "neutral": F.coalesce("neutral", F.lit(True)),
        "winner": F.when(F.col("sets_a") > F.col("sets_b"), F.lit("team_a")).otherwise(F.lit("team_b")),
        "match_id": F.concat_ws(":", "source", "source_match_id"),
    })
    reason = F.coalesce(
        F.when(~F.coalesce(F.col("gender").isin(*GENDERS), F.lit(False)), F.lit("unknown gender")),
        F.when(F.col("team_a").isNull(), F.lit("unknown team_a")),
        F.when(F.col("team_b").isNull(), F.lit("unknown team_b")),
        F.when(F.col("competition_id").isNull(), F.lit("unknown competition")),
        F.when(F.col("date").isNull(), F.lit("unknown date format")),
        F.when(~plausible(F.col("date")), F.lit("date out of range")),
        F.when(unreadable, F.lit("unreadable score")),
        match_faults(*[F.col(c) for c in ("sets_a", "sets_b", "team_a_score", "team_b_score", "team_a", "team_b")]),
    )
    return rows.withColumn("reason", reason)


@dataclass
class Cleaned:
    """Outcome of the quality gate."""

    judged: DataFrame
    matches: DataFrame
    rejected: DataFrame
    resolved: DataFrame


def clean(raw: DataFrame, aliases: DataFrame, competitions: DataFrame, overrides: DataFrame | None = None,
          countries: DataFrame | None = None, materialise: bool = True) -> Cleaned:
    """Copies out, names and competitions resolved, rules checked in order, repeats out.

    The judged rows are written once, as every part is read from them; without ``materialise`` all stays lazy.
    """
    unique = first_per_source_id(raw)
    resolved = resolve_names(distinct_names(raw), aliases, overrides, countries)
    judged = judge(unique, resolved, competitions, raw)
    if materialise:
        judged = cut(judged)
    kept = first_per_meeting(judged.filter("reason IS NULL"))
    matches = kept.select("seq", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in MATCH.fields])
    rejected = judged.filter("reason IS NOT NULL").select("source", "source_match_id", "reason")
    used = resolved.join(distinct_names(judged if materialise else unique), ["source", "name"], "left_semi")
    return Cleaned(judged, matches, rejected, used)


def cleaning_report(raw: DataFrame, cleaned: Cleaned) -> DataFrame:
    """Rows per status and reason; raw = valid + rejected + duplicates."""
    def count(df: DataFrame, status: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(status).alias("status"),
                                                      F.lit(None).cast("string").alias("reason"), "n")
    judged = cleaned.judged.groupBy("reason").agg(F.count("*").alias("n"))
    rejected = judged.filter("reason IS NOT NULL").select(F.lit("rejected").alias("status"), "reason", "n")
    total, valid = count(raw, "raw"), count(cleaned.matches, "valid")
    signed = total.select("n").unionAll(valid.select(-F.col("n"))).unionAll(rejected.select(-F.col("n")))
    duplicates = signed.agg(F.sum("n").alias("n")).select(
        F.lit("duplicate").alias("status"), F.lit(None).cast("string").alias("reason"), "n")
    return total.unionAll(valid).unionAll(rejected).unionAll(duplicates)


def competition_faults(competitions: DataFrame) -> DataFrame:
    """Competitions that may not enter the catalogue: unknown gender, clubs."""
    reason = F.coalesce(
        F.when(~F.coalesce(F.col("gender").isin(*GENDERS), F.lit(False)), F.lit("unknown gender")),
        F.when(F.coalesce("is_club_competition", F.lit(False)), F.lit("club competition")))
    return competitions.withColumn("reason", reason).filter("reason IS NOT NULL")


def valid_sets(sets: DataFrame) -> DataFrame:
    """Set rows numbered 1 to 5 with no negative points."""
    return sets.filter(F.col("set_number").between(1, 5) & (F.col("team_a_points") >= 0) & (F.col("team_b_points") >= 0))
