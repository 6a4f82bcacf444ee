"""From the name a source writes to the team id: aliases, overrides, country names, near misses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.functions.text import delete_variants, name_candidates, name_key

MAX_DISTANCE = 2


def alias_keys(aliases: DataFrame) -> DataFrame:
    """(source_key, key) -> team_id.  Later aliases win; an id stands for itself unless aliased."""
    if "ord" not in aliases.columns:
        raise ValueError("aliases need an 'ord' column giving their file order")
    base = aliases.select(
        F.lower(F.trim("source")).alias("source_key"), F.col("canonical_team_id").alias("id"), "ord",
        F.explode(F.array(F.struct(F.col("source_name").alias("text"), F.lit(True).alias("explicit")),
                          F.struct(F.col("canonical_team_id").alias("text"), F.lit(False).alias("explicit")))
                  ).alias("v"))
    keyed = base.withColumn("key", name_key(F.col("v.text")))
    return keyed.groupBy("source_key", "key").agg(
        F.coalesce(F.max_by(F.when(F.col("v.explicit"), F.col("id")), F.when(F.col("v.explicit"), F.col("ord"))),
                   F.min_by("id", "ord")).alias("team_id"))


def distinct_names(rows: DataFrame) -> DataFrame:
    """Each (source, name) once; everything below runs on these."""
    return rows.select("source", F.explode(F.array("team_a_name", "team_b_name")).alias("name")).distinct()


def by_alias(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """names plus team_id from the alias table, null when there is none."""
    keyed = names.withColumn("source_key", F.lower(F.trim("source"))).withColumn("key", name_key(F.col("name")))
    return keyed.join(alias_keys(aliases), ["source_key", "key"], "left").drop("source_key", "key")


def by_country(names: DataFrame, overrides: DataFrame, countries: DataFrame) -> DataFrame:
    """names that match an override or a country name or code exactly: source, name, team_id.

    overrides: (key, code); countries: (country, code).  An override on any candidate beats a
    country on any candidate; inside a level the first candidate wins.
    """
    known = (
        overrides.select("key", "code", F.lit(1).alias("level"))
        .unionByName(countries.select(F.lower(F.trim("country")).alias("key"), "code", F.lit(2).alias("level")))
        .unionByName(countries.select(F.lower("code").alias("key"), "code", F.lit(2).alias("level")))
    )
    tries = names.select("source", "name", F.posexplode(name_candidates(F.col("name"))).alias("rank", "candidate"))
    hits = tries.withColumn("key", F.lower(F.trim("candidate"))).join(known, "key")
    return hits.groupBy("source", "name").agg(
        F.min_by("code", F.struct("level", "rank", "code")).alias("team_id"))


def by_near_miss(names: DataFrame, countries: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Country within an edit distance of at most two: source, name, team_id, distance.

    The candidates of a name are tried in their order; of the first with a near country the closest one counts. Two texts that close share a variant with at most two characters left out, so the search is
    an equality join on variants followed by the exact distance, never all names by all countries.
    """
    if not 0 <= max_distance <= 2:
        raise ValueError("max_distance is 0, 1 or 2")
    right = countries.select(F.lower(F.trim("country")).alias("country"), "code").distinct()
    longest = right.agg(F.max(F.length("country"))).first()[0] or 0
    tries = names.select("source", "name", F.posexplode(name_candidates(F.col("name"))).alias("rank", "candidate"))
    left = tries.select("source", "name", "rank", F.lower(F.trim("candidate")).alias("text")).where(
        F.length("text") <= longest + max_distance)  # a longer text is near no country
    pairs = (
        left.select("source", "name", "rank", "text", F.explode(delete_variants(F.col("text"))).alias("variant"))
        .join(right.select("country", "code", F.explode(delete_variants(F.col("country"))).alias("variant")), "variant")
        .select("source", "name", "rank", "code", F.levenshtein("text", "country").alias("distance"))
        .filter(F.col("distance") <= max_distance)
    )
    return pairs.groupBy("source", "name").agg(F.min(F.struct("rank", "distance", "code")).alias("best")).select(
        "source", "name", F.col("best.code").alias("team_id"), F.col("best.distance").alias("distance"))


def resolve_names(names: DataFrame, aliases: DataFrame, overrides: DataFrame | None = None,
                  countries: DataFrame | None = None) -> DataFrame:
    """source, name, team_id, level: alias > override or country > near miss; unresolved stay null."""
    known = by_alias(names, aliases).withColumn("level", F.when(F.col("team_id").isNotNull(), F.lit("alias")))
    if countries is None:
        return known
    if overrides is None:
        overrides = countries.select(F.lit("").alias("key"), "code").limit(0)
    open_names = known.filter("team_id IS NULL").select("source", "name")
    exact = by_country(open_names, overrides, countries).select("source", "name", F.col("team_id").alias("exact_id"))
    near = by_near_miss(open_names.join(exact, ["source", "name"], "left_anti"), countries)
    near = near.select("source", "name", F.col("team_id").alias("near_id"))
    joined = known.join(exact, ["source", "name"], "left").join(near, ["source", "name"], "left")
    return joined.select(
        "source", "name", F.coalesce("team_id", "exact_id", "near_id").alias("team_id"),
        F.coalesce("level", F.when(F.col("exact_id").isNotNull(), F.lit("country")),
                   F.when(F.col("near_id").isNotNull(), F.lit("near miss"))).alias("level"))


def unresolved_names(resolved: DataFrame) -> DataFrame:
    return resolved.filter("team_id IS NULL").select("source", "name").distinct().orderBy("source", "name")


def auto_resolved_names(resolved: DataFrame) -> DataFrame:
    """Names settled without an alias, for review."""
    return (resolved.filter("level IN ('country', 'near miss')").select("source", "name", "team_id")
            .distinct().orderBy("source", "name", "team_id"))
