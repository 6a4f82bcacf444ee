"""Landed JSON lines: a tournament header, then its matches, all values text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from courtside.functions.dates import local_date
from courtside.functions.text import canonical_competition, gender_of
from courtside.schemas import columns
from courtside.session import cut
from courtside.sources.files import number_lines

_SET_FIELDS = [f"PointsTeam{side}Set{n}" for n in range(1, 6) for side in "AB"]
LANDING = columns(", ".join(f"{name} string" for name in [
    "_type", "No", "Name", "Gender", "NoInTournament", "DateTimeLocal", "TeamAName", "TeamBName", "MatchPointsA",
    "MatchPointsB", *_SET_FIELDS, "City", "Hall", "Phase"]))


def _present(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def _number(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("int"))


def played_sets() -> Column:
    """Array of (set_number, team_a_points, team_b_points): unplayed and unreadable sets are left out."""
    entries = []
    for n in range(1, 6):
        a, b = F.col(f"PointsTeamASet{n}"), F.col(f"PointsTeamBSet{n}")
        def empty(c):
            return c.isNull() | c.isin("", "0")
        points = [_number(F.when(_present(c), c).otherwise(F.lit("0"))) for c in (a, b)]
        ok = ~(empty(a) & empty(b)) & points[0].isNotNull() & points[1].isNotNull()
        entries.append(F.when(ok, F.struct(F.lit(n).alias("set_number"), points[0].alias("team_a_points"),
                                           points[1].alias("team_b_points"))))
    return F.array_compact(F.array(*entries))


def _total(side: str) -> Column:
    return F.nullif(F.aggregate("sets", F.lit(0), lambda acc, s: acc + s[f"team_{side}_points"]), F.lit(0))


RANGE = 4096           # lines that are looked at together


def with_headers(lines: DataFrame) -> DataFrame:
    """Match lines with the name, gender and number of the last header above them in their file.

    Lines meet the headers of their own range of lines and the last header before it, so a file of any length and with any number of
    headers is many small keys.
    """
    placed = lines.withColumn("_range", F.floor(F.col("line") / RANGE))
    is_header = F.coalesce(F.col("_type") == "tournament", F.lit(False))
    header = F.struct(F.col("line").alias("from"), F.col("No").alias("no"), F.coalesce("Name", F.lit("")).alias("name"), F.col("Gender").alias("gender"))
    own = F.array_sort(F.collect_list(F.when(is_header, header)))
    ranges = placed.groupBy("file", "_range").agg(own.alias("_own"))
    before = Window.partitionBy("file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("_own") > 0, F.element_at("_own", -1))
    # a row for every range: its size is known once it is written, and the lines themselves are then not moved
    ranges = cut(ranges.withColumn("_carried", F.last(last, ignorenulls=True).over(before)))
    above = F.filter("_own", lambda h: h["from"] < F.col("line"))
    found = F.when(F.size(above) > 0, F.element_at(above, -1)).otherwise(F.col("_carried"))
    return (placed.where(~is_header).join(ranges, ["file", "_range"]).withColumn("_header", found).select(
        *lines.columns, F.col("_header.from").alias("_from"), F.col("_header.no").alias("tournament_no"),
        F.col("_header.name").alias("tournament_name"), F.col("_header.gender").alias("tournament_gender")))


def translate(lines: DataFrame, source: str = "landing") -> DataFrame:
    """Match lines as raw rows plus sets and the first reason to discard them (null when usable)."""
    rows = with_headers(lines).withColumns({
        "gender": gender_of(F.col("tournament_gender"), F.col("tournament_name")),
        "competition_name": canonical_competition(F.col("tournament_name")),
        "date_str": local_date(F.col("DateTimeLocal")),
        "sets_a": _number(F.col("MatchPointsA")),
        "sets_b": _number(F.col("MatchPointsB")),
        "sets": played_sets(),
    })
    reason = F.coalesce(
        F.when(F.col("_from").isNull(), F.lit("match before tournament header")),
        F.when(F.col("gender").isNull(), F.lit("unknown tournament gender")),
        F.when(F.col("competition_name").isNull(), F.lit("tournament outside the catalogue")),
        F.when(~_present(F.col("TeamAName")) | ~_present(F.col("TeamBName")), F.lit("missing team name")),
        F.when(F.col("date_str").isNull(), F.lit("missing or unreadable date")),
        F.when(F.col("sets_a").isNull() | F.col("sets_b").isNull(), F.lit("missing or non-numeric set count")))
    none = F.lit(None)
    return rows.select(
        "seq", F.lit(source).alias("source"), F.coalesce("No", F.lit("")).alias("source_match_id"), "date_str", "gender",
        "competition_name", F.col("Phase").alias("stage_str"), F.col("TeamAName").alias("team_a_name"),
        F.col("TeamBName").alias("team_b_name"), _total("a").alias("team_a_score"), _total("b").alias("team_b_score"),
        "sets_a", "sets_b",
        F.coalesce(F.when(_present(F.col("Hall")), F.col("Hall")), F.col("City")).alias("venue"),
        none.cast("string").alias("country_host"), none.cast("boolean").alias("neutral"), "tournament_no",
        _number(F.col("NoInTournament")).alias("no_in_tournament"), "sets", reason.alias("discard_reason"))


def read_landing(spark: SparkSession, path: str, source: str = "landing") -> DataFrame:
    """Every landed match with its discard reason."""
    lines = spark.read.schema(LANDING).option("recursiveFileLookup", True).json(path)
    return translate(number_lines(lines), source)


def usable(translated: DataFrame) -> DataFrame:
    return translated.filter("discard_reason IS NULL").drop("sets", "discard_reason")


def discarded(translated: DataFrame) -> DataFrame:
    return translated.filter("discard_reason IS NOT NULL").select("source_match_id", "discard_reason")


def set_rows(translated: DataFrame) -> DataFrame:
    """Long set table of the usable rows; repeated match lines give each set once."""
    rows = translated.filter("discard_reason IS NULL").select(
        F.concat_ws(":", "source", "source_match_id").alias("match_id"), "seq", F.inline("sets"))
    # both points as one number, which is added up by hash; a struct would be sorted
    both = F.shiftleft(F.col("team_a_points").cast("bigint"), 32) + F.col("team_b_points") + F.lit(1 << 31)
    low = F.col("p").bitwiseAND(F.lit((1 << 32) - 1)) - F.lit(1 << 31)
    return rows.groupBy("match_id", "set_number").agg(F.min_by(both, "seq").alias("p")).select(
        "match_id", "set_number", F.shiftright("p", 32).cast("int").alias("team_a_points"), low.cast("int").alias("team_b_points"))


def accepted_sets(sets: DataFrame, matches: DataFrame) -> DataFrame:
    """Sets of the matches that passed the quality gate."""
    return sets.join(matches.select("match_id"), "match_id", "left_semi")
