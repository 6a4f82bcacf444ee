"""Matches derived from the sample tables: one match per order, one pool per gender."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.operators.ordering import with_position
from courtside.plans.features import build_features
from courtside.schemas import COMPETITION, columns
from courtside.session import small_table

# The competitions of the sample, id prefix and level.
SAMPLE_LEVELS = {
    "OG": "olympic_games",
    "WCH": "world_championship",
    "WC": "world_cup",
    "VNL": "nations_league",
    "EURO": "continental",
}


# Declared, so that reading needs no pass over the files to find the schema.
TABLES = {
    "orders": columns("o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string"),
    "customer": columns("c_custkey bigint, c_nationkey int"),
    "nation": columns("n_nationkey int, n_name string, n_regionkey int"),
    "region": columns("r_regionkey int, r_name string"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def base_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, seq, date, gender, teams, sets, winner, competition_id, stage and scores."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("ka"))
    nations = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "orders").join(customers, "o_custkey").selectExpr(
        "o_orderkey AS seq", "o_custkey AS ck", "CAST(o_orderdate AS date) AS date", "ka",
        "(ka + 1 + (o_orderkey * 7 + o_custkey) % 24) % 25 AS kb", "o_orderpriority AS pr")
    rows = rows.selectExpr(
        "*", "CASE WHEN seq % 2 = 0 THEN 'men' ELSE 'women' END AS gender",
        "(ka - kb) + ((seq * 37) % 21 - 10) > 0 AS a_won",
        "CAST((seq * 11 + ck) % 3 AS int) AS ls",
        "CASE pr WHEN '1-URGENT' THEN 'OG' WHEN '2-HIGH' THEN 'WCH' WHEN '3-MEDIUM' THEN 'WC' "
        "WHEN '4-NOT SPECIFIED' THEN 'VNL' ELSE 'EURO' END AS cp")
    team_a = nations.select(F.col("n_nationkey").alias("ka"), F.col("n_name").alias("team_a"))
    team_b = nations.select(F.col("n_nationkey").cast("bigint").alias("kb"), F.col("n_name").alias("team_b"))
    rows = rows.join(team_a, "ka").join(team_b, "kb").selectExpr(
        "concat('o:', seq) AS match_id", "seq", "date", "gender", "team_a", "team_b",
        "CASE WHEN a_won THEN 3 ELSE ls END AS sets_a", "CASE WHEN a_won THEN ls ELSE 3 END AS sets_b",
        "CASE WHEN a_won THEN 'team_a' ELSE 'team_b' END AS winner",
        "concat(cp, '_', upper(gender)) AS competition_id")
    return rows.selectExpr(
        "*", "concat(competition_id, '-', year(date)) AS tournament_no",
        "CASE seq % 7 WHEN 0 THEN 'pool' WHEN 1 THEN 'preliminary' WHEN 2 THEN 'quarterfinal' "
        "WHEN 3 THEN 'semifinal' WHEN 4 THEN 'bronze' WHEN 5 THEN 'final' ELSE 'other' END AS stage",
        "sets_a * 25 + sets_b * (15 + seq % 9) AS team_a_score",
        "sets_b * 25 + sets_a * (15 + seq % 9) AS team_b_score")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """base_matches plus the running number of each match in its tournament."""
    numbered = with_position(base_matches(spark, sf_dir), ["tournament_no"], out="no_in_tournament")
    return numbered.withColumn("no_in_tournament", F.col("no_in_tournament") + 1)


def feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """build_features over the sample."""
    return build_features(matches(spark, sf_dir), competitions(spark))


def competitions(spark: SparkSession) -> DataFrame:
    rows = [(f"{prefix}_{g.upper()}", f"{prefix}_{g.upper()}", g, level, False)
            for prefix, level in SAMPLE_LEVELS.items() for g in ("men", "women")]
    return small_table(spark, rows, COMPETITION)


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matches as a dirty feed: copies, odd dates, unknown names, loose spelling."""
    m = base_matches(spark, sf_dir)
    plain = m.selectExpr("seq * 10 AS rid", "seq AS s", "match_id AS sid", "team_a AS ta", "team_b AS tb",
                         "sets_a AS sa", "sets_b AS sb", "CAST(date AS string) AS d", "gender AS g",
                         "competition_id AS c")
    copies = plain.filter("s % 50 = 7").withColumn("rid", F.col("rid") + 1)
    mirrored = plain.filter("s % 50 = 9").selectExpr(
        "rid + 2 AS rid", "s", "concat('x', sid) AS sid", "tb AS ta", "ta AS tb", "sb AS sa", "sa AS sb",
        "d", "g", "c")
    return plain.unionByName(copies).unionByName(mirrored).selectExpr(
        "rid AS seq", "'feed' AS source", "sid AS source_match_id",
        "CASE WHEN s % 67 = 0 THEN 'n/a' "
        "WHEN s % 61 = 0 THEN concat(CAST(substr(d, 1, 4) AS int) + 543, substr(d, 5)) "
        "WHEN s % 4 = 1 THEN concat(substr(d, 9, 2), '/', substr(d, 6, 2), '/', substr(d, 1, 4)) "
        "WHEN s % 4 = 3 THEN replace(d, '-', '/') ELSE d END AS date_str",
        "CASE WHEN s % 101 = 0 THEN 'mixed' WHEN s % 5 = 0 THEN concat(' ', upper(g), ' ') ELSE g END AS gender",
        "CASE WHEN s % 103 = 0 THEN 'Local Cup' WHEN s % 2 = 0 THEN lower(c) ELSE c END AS competition_name",
        "CASE s % 6 WHEN 0 THEN 'Pool' WHEN 1 THEN 'QF' WHEN 2 THEN ' Semi-Final ' "
        "WHEN 3 THEN 'Gold Medal Match' WHEN 4 THEN 'odd' END AS stage_str",
        "CASE WHEN s % 97 = 0 THEN 'Atlantis' WHEN s % 3 = 0 THEN concat('  ', lower(replace(ta, '_', ' ')), ' ') "
        "WHEN s % 3 = 1 THEN ta ELSE replace(ta, '_', '  ') END AS team_a_name",
        "CASE WHEN s % 83 = 0 THEN 'Nowhere' WHEN s % 3 = 1 THEN lower(replace(tb, '_', ' ')) ELSE tb END AS team_b_name",
        "CASE WHEN s % 10 = 0 THEN NULL ELSE sa * 25 + sb * (15 + s % 9) END AS team_a_score",
        "CASE WHEN s % 10 = 0 THEN NULL ELSE sb * 25 + sa * (15 + s % 9) END AS team_b_score",
        "CASE WHEN s % 89 = 0 THEN sb ELSE sa END AS sets_a", "sb AS sets_b",
        "CAST(NULL AS string) AS venue", "CAST(NULL AS string) AS country_host",
        "CAST(NULL AS boolean) AS neutral", "CAST(NULL AS string) AS tournament_no",
        "CAST(NULL AS int) AS no_in_tournament")


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias table of the feed: NATION_k and 'NATION k' mean N<k>."""
    nations = table(spark, sf_dir, "nation")
    both = F.explode(F.array(F.col("n_name"), F.regexp_replace("n_name", "_", " ")))
    return nations.select(
        F.concat(F.lit("N"), F.col("n_nationkey")).alias("canonical_team_id"),
        F.lit("feed").alias("source"), both.alias("source_name"),
        F.col("n_nationkey").cast("bigint").alias("ord"))
