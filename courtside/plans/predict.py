"""Scoring of matches yet to be played, from stored state, for any number of fixtures at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.functions.scores import combine_scores, confidence_level, decisiveness, explanatory_factors, orient
from courtside.operators.context import add_importance
from courtside.operators.elo import EloConfig
from courtside.operators.form import WINDOWS
from courtside.operators.h2h import PAIR, record_before
from courtside.plans.features import FEATURE_COLUMNS, add_diffs
from courtside.schemas import GENDERS, SCORES

def judge_requests(requests: DataFrame, competitions: DataFrame) -> DataFrame:
    """Requests with the first reason against them (null when they can be scored)."""
    known = competitions.select("competition_id", F.lit(True).alias("_known")).distinct()
    reason = F.coalesce(
        F.when(~F.coalesce(F.col("gender").isin(*GENDERS), F.lit(False)), F.lit("unknown gender")),
        F.when(F.col("team_a") == F.col("team_b"), F.lit("same team")),
        F.when(F.col("_known").isNull(), F.lit("unknown competition")))
    return requests.join(known, "competition_id", "left").withColumn("reason", reason).drop("_known")


def with_state(fixtures: DataFrame, ratings: DataFrame, states: DataFrame, days: DataFrame,
               windows: tuple[int, ...] = WINDOWS, initial_rating: float = EloConfig.initial_rating) -> DataFrame:
    """Fixtures plus rating and form of both sides and the pair's record before the fixture date.

    Unknown teams get the initial rating, no matches and null form.
    """
    out = fixtures
    for side in ("a", "b"):
        mine = states.select(
            "gender", F.col("team").alias(f"team_{side}"), F.col("matches_played").alias("_mp"),
            F.col("current_streak").alias("_st"), F.col("last_match_date").alias("_last"), F.col("recent").alias("_recent"))
        rating = ratings.select("gender", F.col("team").alias(f"team_{side}"), F.col("elo").alias("_elo"))
        out = out.join(mine, ["gender", f"team_{side}"], "left").join(rating, ["gender", f"team_{side}"], "left")
        rolling = {}
        for n in windows:
            tail = F.when(F.size("_recent") > n, F.slice("_recent", -n, n)).otherwise(F.col("_recent"))
            size = F.size(tail)
            wins = F.size(F.filter(tail, lambda r: r["won"]))
            margin = F.aggregate(tail, F.lit(0).cast("bigint"), lambda acc, r: acc + r["sets_for"] - r["sets_against"])
            rolling[f"{side}_win_rate_last{n}"] = F.when(size > 0, wins / size)
            rolling[f"{side}_set_margin_avg_last{n}"] = F.when(size > 0, margin / size)
        out = out.withColumns({
            f"elo_{side}_pre": F.coalesce("_elo", F.lit(initial_rating)),
            f"{side}_matches_played": F.coalesce("_mp", F.lit(0)),
            f"{side}_current_streak": F.coalesce("_st", F.lit(0)),
            f"{side}_days_since_last": F.datediff("date", "_last").cast("bigint"),
            **rolling,
        }).drop("_mp", "_st", "_last", "_recent", "_elo")
    pair = {"lo": F.least("team_a", "team_b"), "hi": F.greatest("team_a", "team_b")}
    out = out.withColumns(pair).join(record_before(fixtures.withColumns(pair), days), [*PAIR, "date"], "left")
    a_wins = F.when(F.col("team_a") == F.col("lo"), F.col("lo_wins")).otherwise(F.col("met") - F.col("lo_wins"))
    return (
        out.withColumn("h2h_matches_played", F.coalesce("met", F.lit(0)))
        .withColumn("h2h_win_rate_a", F.when(F.col("met") > 0, a_wins / F.col("met")))
        .drop("lo", "hi", "met", "lo_wins")
    )


def fixture_features(fixtures: DataFrame, ratings: DataFrame, states: DataFrame, days: DataFrame,
                     competitions: DataFrame, windows: tuple[int, ...] = WINDOWS,
                     initial_rating: float = EloConfig.initial_rating) -> DataFrame:
    """The same feature columns as for history; tournament_progress only where the caller gives it."""
    if "tournament_progress" not in fixtures.columns:
        fixtures = fixtures.withColumn("tournament_progress", F.lit(None).cast("double"))
    out = with_state(fixtures, ratings, states, days, windows, initial_rating).withColumn("stage", F.lit(None).cast("string"))
    return add_diffs(add_importance(out, competitions), windows).drop("stage", "stage_importance", "match_importance")


def eligible_competitions(pairs: DataFrame, competitions: DataFrame, continents: DataFrame) -> DataFrame:
    """Competitions of the pool that two teams can meet in.

    Continental ones need both teams from that continent (the id before its last underscore);
    pairs meet competitions by pool, so each pair yields at most the few competitions of its pool.
    """
    prefix = F.regexp_replace("competition_id", r"_[^_]*$", "")
    offered = competitions.select(
        "gender", "competition_id", (F.col("level") == "continental").alias("_cont"), prefix.alias("_prefix"))
    out = pairs
    for side in ("a", "b"):
        home = continents.select(F.col("team").alias(f"team_{side}"), F.col("continent").alias(f"_{side}"))
        out = out.join(home, f"team_{side}", "left")
    both = (F.col("_a") == F.col("_prefix")) & (F.col("_b") == F.col("_prefix"))
    return (out.join(offered, "gender").filter(~F.col("_cont") | F.coalesce(both, F.lit(False)))
            .drop("_a", "_b", "_cont", "_prefix"))


def pool_competitions(competitions: DataFrame, gender: str) -> DataFrame:
    return competitions.filter(F.col("competition_id").endswith(f"_{gender.upper()}"))


def active_teams(teams: DataFrame, defunct: DataFrame) -> DataFrame:
    """Teams without the dissolved ones (column team on both sides)."""
    return teams.join(defunct, "team", "left_anti")


def display_label(competitions: DataFrame) -> DataFrame:
    return competitions.select("competition_id", F.concat("name", F.lit(" ("), "gender", F.lit(")")).alias("label"))


def with_display_name(teams: DataFrame, names: DataFrame) -> DataFrame:
    """Display name of a team code; the code itself where there is none."""
    dim = names.select(F.col("code").alias("team"), F.col("display").alias("_display"))
    return teams.join(dim, "team", "left").withColumn("display", F.coalesce("_display", "team")).drop("_display")


def prediction_record(scored: DataFrame) -> DataFrame:
    """The full answer for fixtures carrying p, the margin chances a_*/b_* and expected_point_diff."""
    full = decisiveness(combine_scores(scored))
    scores = F.create_map(*[part for s in SCORES for part in (F.lit(s), F.bround(F.col(s), 4))])
    return full.select(
        "gender", "team_a", "team_b", "date", "competition_id",
        F.bround("p", 4).alias("p_team_a_wins"), F.bround(1.0 - F.col("p"), 4).alias("p_team_b_wins"),
        scores.alias("set_score_probabilities"), "most_likely_score", "most_likely_score_probability",
        "score_confidence", "score_confidence_gap", "close_score_alternatives",
        F.bround("expected_point_diff", 1).alias("expected_point_diff"),
        F.bround("elo_a_pre", 1).alias("elo_team_a"), F.bround("elo_b_pre", 1).alias("elo_team_b"),
        confidence_level(F.col("a_matches_played"), F.col("b_matches_played")).alias("confidence"),
        explanatory_factors().alias("explanatory_factors"))


def predict(features: DataFrame, win_model, margin_model, point_model, columns: list[str] = FEATURE_COLUMNS) -> DataFrame:
    """Score fixture features with the three fitted models and return the full records."""
    scored = win_model.transform(features, out="p")
    scored = margin_model.transform(scored, prefix="a")
    flipped = orient(scored.withColumn("_keep", F.struct(*columns)), columns, F.lit(True))
    scored = margin_model.transform(flipped, prefix="b")
    scored = scored.withColumns({c: F.col(f"_keep.{c}") for c in columns}).drop("_keep")
    return prediction_record(point_model.transform(scored, out="expected_point_diff"))
