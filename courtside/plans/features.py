"""The model input: one row per match with everything known before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.operators.context import add_importance, add_tournament_progress
from courtside.operators.elo import BLOCK_ROWS, EloConfig, elo_history
from courtside.operators.form import WINDOWS, form_by_match, long_form, team_form
from courtside.operators.h2h import head_to_head
from courtside.operators.ordering import ROW_BUDGET, group_sizes
from courtside.session import cut


def feature_columns(windows: tuple[int, ...] = WINDOWS) -> list[str]:
    return [
        "elo_diff", "matches_played_diff", "current_streak_diff", "days_since_last_diff",
        "h2h_matches_played", "h2h_win_rate_a", "competition_importance", "tournament_progress",
        *[f"win_rate_last{n}_diff" for n in windows],
        *[f"set_margin_avg_last{n}_diff" for n in windows],
    ]


FEATURE_COLUMNS = feature_columns()


def add_diffs(df: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Side a minus side b; null where either side is unknown."""
    names = ["matches_played", "current_streak", "days_since_last"]
    for n in windows:
        names += [f"win_rate_last{n}", f"set_margin_avg_last{n}"]
    diffs = {f"{name}_diff": F.col(f"a_{name}") - F.col(f"b_{name}") for name in names}
    if "elo_a_pre" in df.columns:
        diffs["elo_diff"] = F.col("elo_a_pre") - F.col("elo_b_pre")
    return df.withColumns(diffs)


def build_features(matches: DataFrame, competitions: DataFrame, elo: EloConfig = EloConfig(),
                   windows: tuple[int, ...] = WINDOWS, budget: int = ROW_BUDGET,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Matches plus Elo, form, head-to-head, importance, progress and the differences.

    Each part is computed on slim columns and comes back keyed by seq, so the joins below all
    hash on the same key.
    """
    matches = cut(matches)  # read by the sizes, the ratings, form, head-to-head and progress
    sizes = group_sizes(matches)
    form = form_by_match(team_form(long_form(matches), windows, budget, sizes.team), windows)
    result = (
        matches.join(elo_history(matches, elo, block_rows), "seq")
        .join(form, "seq")
        .join(head_to_head(matches, budget, sizes.pair), "seq")
    )
    result = add_importance(result, competitions)
    if "tournament_no" in matches.columns and "no_in_tournament" in matches.columns:
        slim = matches.select("seq", "tournament_no", "no_in_tournament")
        result = result.join(add_tournament_progress(slim).select("seq", "tournament_progress"), "seq")
    else:
        result = add_tournament_progress(result)
    return add_diffs(result, windows)
