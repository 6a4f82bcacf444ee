"""Comparisons out of sample: which features help, and how much of the past to train on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.models.boosting import Settings
from courtside.models.trees import WinTrees, walk_forward_trees
from courtside.operators.evaluation import label
from courtside.operators.folds import assert_no_fold_leak, fold_weights
from courtside.schemas import GENDERS

ELO = ["elo_diff"]
FORM = ["current_streak_diff", "win_rate_last5_diff", "win_rate_last10_diff"]
STATISTICS = ["set_margin_avg_last5_diff", "set_margin_avg_last10_diff", "h2h_matches_played", "h2h_win_rate_a"]
REST = ["days_since_last_diff"]
OTHERS = ["matches_played_diff", "competition_importance", "tournament_progress"]
FEATURE_SETS = {"A": ELO, "B": ELO + FORM, "C": ELO + FORM + STATISTICS, "D": ELO + FORM + STATISTICS + REST,
                "E": ELO + FORM + STATISTICS + REST + OTHERS}
SCHEMES = ("expanding", "rolling", "decayed")


def _long(scored: DataFrame) -> DataFrame:
    return scored.select("gender", "seq", "model", F.col("test_fold").alias("fold"), "p", label().alias("y"))


def ablation(folded: DataFrame, sets: dict[str, list[str]] = FEATURE_SETS, n_folds: int = 5, **settings) -> DataFrame:
    """Out-of-fold predictions of win trees on each feature set: gender, seq, model (the set), fold, p, y.

    The trees of all sets, pools and folds grow in the same passes; columns outside a set are closed to its trees.
    """
    assert_no_fold_leak(folded)
    chosen = Settings(**{**WinTrees.DEFAULTS, **settings})
    return _long(walk_forward_trees(folded, sets, chosen, list(GENDERS), n_folds))


def windows_compared(folded: DataFrame, columns: list[str] = FEATURE_SETS["E"], n_folds: int = 5, days: float = 365.0, **settings) -> DataFrame:
    """Out-of-fold predictions of win trees trained on an expanding, a rolling and a decayed past: gender, seq, model (the scheme), fold, p, y."""
    assert_no_fold_leak(folded)
    rows = folded
    for scheme in SCHEMES:
        rows = fold_weights(rows, scheme, n_folds, days).withColumnRenamed("fold_weights", f"_{scheme}")
    chosen = Settings(**{**WinTrees.DEFAULTS, **settings})
    scored = walk_forward_trees(rows, dict.fromkeys(SCHEMES, columns), chosen, list(GENDERS), n_folds, weights={s: F.col(f"_{s}") for s in SCHEMES})
    return _long(scored)
