"""Columns over win chances, margins and exact scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.schemas import MARGINS, SCORES

def flips(name: str) -> bool:
    """Whether a feature changes sign when the match is seen from the other side: every difference does, whatever its window."""
    return name.endswith("_diff")


def complements(name: str) -> bool:
    """Whether a feature is a share of side a's, so that side b has the rest of it."""
    return name == "h2h_win_rate_a" or name.startswith("h2h_last_")


def margin_class(sets_a: Column, sets_b: Column) -> Column:
    return F.concat(F.lit("3-"), F.least(sets_a, sets_b).cast("string"))


def orient(df: DataFrame, columns: list[str], from_b: Column) -> DataFrame:
    """Feature columns seen from side b where ``from_b`` holds."""
    changed = {}
    for name in columns:
        if flips(name):
            changed[name] = F.when(from_b, 0.0 - F.col(name)).otherwise(F.col(name))
        elif complements(name):
            changed[name] = F.when(from_b, 1.0 - F.col(name)).otherwise(F.col(name))
    return df.withColumns(changed)


def margin_training_frame(features: DataFrame, columns: list[str]) -> DataFrame:
    """Every match once, seen from its winner, with its margin class."""
    oriented = orient(features, columns, F.col("winner") == "team_b")
    return oriented.withColumn("margin_class", margin_class(F.col("sets_a"), F.col("sets_b")))


def combine_scores(df: DataFrame, p: str = "p", if_a: str = "a", if_b: str = "b") -> DataFrame:
    """Six score columns from the win chance and the margin chances (<prefix>_3-0 ... of each side)."""
    out = {}
    for margin in MARGINS:
        out[margin] = F.col(p) * F.col(f"`{if_a}_{margin}`")
        out[f"{margin[2]}-3"] = (1.0 - F.col(p)) * F.col(f"`{if_b}_{margin}`")
    return df.withColumns({s: out[s] for s in SCORES})


def score_rows(df: DataFrame, keep: list[str]) -> DataFrame:
    """The six score columns as rows, in their fixed order."""
    entries = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(s).alias("score"), F.col(s).alias("probability"))
                        for i, s in enumerate(SCORES)])
    return df.select(*keep, F.inline(entries))


def ranked_scores() -> Column:
    """The six scores as structs (k = -probability, i, s), most probable first; ties in fixed order."""
    return F.array_sort(F.array(*[
        F.struct((0.0 - F.col(s)).alias("k"), F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(SCORES)]))


def decisiveness(df: DataFrame) -> DataFrame:
    """most_likely_score, its probability, the gap to the next, a level and the close alternatives."""
    ranked = df.withColumn("_r", ranked_scores())
    top, second = 0.0 - F.col("_r")[0]["k"], 0.0 - F.col("_r")[1]["k"]
    gap = top - second
    level = (F.when((top >= 0.40) & (gap >= 0.12), F.lit("high"))
             .when((top >= 0.30) & (gap >= 0.07), F.lit("medium")).otherwise(F.lit("low")))
    floor = F.greatest(second, top - 0.08)
    close = F.slice(F.filter(F.slice("_r", 2, 5), lambda x: (0.0 - x["k"]) >= floor), 1, 2)
    return ranked.withColumns({
        "most_likely_score": F.col("_r")[0]["s"],
        "most_likely_score_probability": F.bround(top, 4),
        "score_confidence": level,
        "score_confidence_gap": F.bround(gap, 4),
        "close_score_alternatives": F.transform(close, lambda x: F.struct(
            x["s"].alias("score"), F.bround(0.0 - x["k"], 4).alias("probability"))),
    }).drop("_r")


def confidence_level(played_a: Column, played_b: Column) -> Column:
    fewest = F.least(played_a, played_b)
    return (F.when(fewest == 0, F.lit("low (at least one team has no history in the dataset)"))
            .when(fewest < 5, F.lit("low")).when(fewest < 15, F.lit("medium")).otherwise(F.lit("high")))


def _whole(x: Column) -> Column:
    return F.bround(x, 0).cast("bigint").cast("string")


def explanatory_factors(windows: tuple[int, ...] = (5, 10)) -> Column:
    """Readable facts about a match, in a fixed order."""
    a, b, elo = F.col("team_a"), F.col("team_b"), F.col("elo_diff")

    def favoured(x: Column) -> Column:
        return F.when(x > 0, a).otherwise(b)

    def streak(team: Column, run: Column) -> Column:
        text = F.concat(team, F.lit(" arrives on a "), F.abs(run).cast("string"), F.lit("-match "))
        return F.when(run >= 2, F.concat(text, F.lit("winning streak"))).when(
            run <= -2, F.concat(text, F.lit("losing streak")))

    met, rate = F.col("h2h_matches_played"), F.col("h2h_win_rate_a")
    share = F.when(rate >= 0.5, rate * 100).otherwise((1 - rate) * 100)
    history = F.when((met > 0) & rate.isNotNull(), F.concat(
        F.lit("Head-to-head: "), F.when(rate >= 0.5, a).otherwise(b), F.lit(" won "), _whole(share),
        F.lit("% of the last "), met.cast("bigint").cast("string"), F.lit(" meetings"))).when(
        met == 0, F.lit("No previous meetings on record between these two teams"))
    form = F.coalesce(*[
        F.when(F.abs(F.col(f"win_rate_last{n}_diff")) >= 0.3, F.concat(
            favoured(F.col(f"win_rate_last{n}_diff")), F.lit(f" in better recent form (last {n} matches)")))
        for n in windows])
    return F.array_compact(F.array(
        F.when(F.abs(elo) >= 30, F.concat(
            F.lit("Elo rating: "), _whole(F.abs(elo)), F.lit(" points in favor of "), favoured(elo))),
        streak(a, F.col("a_current_streak")),
        streak(b, F.col("b_current_streak")),
        history,
        form,
        F.when(F.col("competition_importance") >= 4,
               F.lit("High-stakes match (World Championship / Olympics / World Cup)")),
    ))


def logit(p: Column, clip: float = 1e-6) -> Column:
    q = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), p))
    return F.ln(q / (1 - q))
