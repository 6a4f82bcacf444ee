import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside.functions.scores import combine_scores, decisiveness, logit, margin_training_frame, orient, score_rows
from courtside.operators import evaluation
from courtside.operators.context import add_tournament_progress
from courtside.operators.evaluation import (
    calibration_table, exact_medians, leak_violations, summarize, summarize_across_folds, summarize_regression,
)
from courtside.operators.folds import assert_no_fold_leak, assign_folds, fold_bounds, tail_split, train_rows
from courtside.operators.folds import test_rows as fold_rows
from courtside.operators.imputation import fit_preparation


def _pred(spark, ys, ps):
    return spark.createDataFrame([("g", float(y), float(p)) for y, p in zip(ys, ps)], "g string, y double, p double")


def test_known_metric_values(spark):
    row = summarize(_pred(spark, [1, 0, 1, 0], [0.9, 0.2, 0.4, 0.3]), ["g"]).first()
    assert row["accuracy"] == 0.75 and row["n"] == 4
    assert summarize(_pred(spark, [1, 0], [1, 0]), ["g"]).first()["brier_score"] == 0.0
    assert summarize(_pred(spark, [1, 0], [0, 1]), ["g"]).first()["brier_score"] == 1.0
    assert summarize(_pred(spark, [1], [0]), ["g"]).first()["log_loss"] == pytest.approx(-math.log(1e-15))
    reg = summarize_regression(_pred(spark, [1, 2, 3], [2, 4, 1]), ["g"]).first()
    assert reg["mae"] == pytest.approx(5 / 3) and reg["rmse"] == pytest.approx(math.sqrt(3))


def test_calibration_bins_are_right_closed(spark):
    ps = [0.0, 0.1, 0.1000001, 0.3, 0.30000000000000004, 1.0]
    rows = {r["bin"]: r["count"] for r in calibration_table(_pred(spark, [1] * 6, ps), ["g"]).collect()}
    edges = np.linspace(0, 1, 11)
    want = {}
    for p in ps:
        k = max(int(np.searchsorted(edges, p, side="left")) - 1, 0)
        want[k] = want.get(k, 0) + 1
    assert rows == want


def test_folds_match_positions(spark, crowded):
    men = crowded.filter("gender = 'men'")
    folded = assign_folds(men, n_folds=5)
    rows = sorted(folded.collect(), key=lambda r: (r["date"], r["seq"]))
    n = len(rows)
    start = max(1, int(n * 0.3))
    size = (n - start) // 5
    for i, r in enumerate(rows):
        want = None if i < start else min((i - start) // size, 4)
        assert r["test_fold"] == want
    assert train_rows(folded, 2).count() == start + 2 * size
    assert fold_rows(folded, 4).count() == n - start - 4 * size
    assert_no_fold_leak(folded)
    assert fold_bounds(folded).count() == 5


def test_too_few_rows_for_folds(spark, crowded):
    with pytest.raises(Exception, match="not enough rows"):
        assign_folds(crowded.limit(3)).collect()


def test_tail_split(spark, ladder):
    assert tail_split(ladder, 0.2).filter("held_out").count() == 60 - int(60 * 0.8)


def test_summary_across_folds(spark):
    df = spark.createDataFrame([("m", 0.5, 0.2, 0.7), ("m", 0.7, 0.4, 0.9)],
                               "model string, log_loss double, brier_score double, accuracy double")
    row = summarize_across_folds(df, ["model"]).first()
    assert (row["log_loss_mean"], row["log_loss_std"]) == (0.6, round(math.sqrt(0.02), 4))


@pytest.mark.parametrize("bins", [4096, 3])
def test_exact_medians(spark, bins):
    rng = random.Random(3)
    rows = [(rng.gauss(0, 1) ** 3, float(rng.randrange(4)), None) for _ in range(501)] + [(None, None, None)] * 7
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = exact_medians(df, ["a", "b", "c"], bins=bins)
    assert got["a"] == pytest.approx(float(np.median([r[0] for r in rows if r[0] is not None])), abs=1e-12)
    assert got["b"] == float(np.median([r[1] for r in rows if r[1] is not None]))
    assert got["c"] is None


def test_medians_take_six_passes_at_any_spread(spark, monkeypatch):
    """Values from 1e-300 to 1e300, signed zeros and infinities: the range of a column does not decide how often it is read."""
    rng = random.Random(4)
    rows = [(rng.choice((-1, 1)) * 10.0 ** rng.uniform(-300, 300), rng.choice((0.0, -0.0, math.inf, -math.inf)), 7.5, math.nan) for _ in range(500)]
    passes, plain = [], evaluation._cell_counts
    monkeypatch.setattr(evaluation, "_cell_counts", lambda *a: (passes.append(1), plain(*a))[1])
    df = spark.createDataFrame(rows, "a double, `b.b` double, c double, d double").repartition(30)
    got = exact_medians(df, ["a", "b.b", "c", "d"])
    a, b = (sorted(r[i] for r in rows) for i in (0, 1))
    assert got == {"a": (a[249] + a[250]) / 2, "b.b": (b[249] + b[250]) / 2, "c": 7.5, "d": None} and len(passes) == 6


def test_preparation(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (None, None, 5.0), (3.0, None, 5.0)], "a double, b double, c double")
    prep = fit_preparation(df, ["a", "b", "c"])
    assert prep.medians == {"a": 2.0, "b": 0.0, "c": 5.0} and prep.flagged == ["a", "b"]
    scaled = prep.scale(prep.impute(df))
    assert [round(r["a"], 6) for r in scaled.collect()] == [-1.224745, 0.0, 1.224745]
    assert all(r["c"] == 0.0 for r in scaled.collect())


def test_leak_violations(spark):
    df = spark.sql("SELECT 'm' AS match_id, date'2020-01-02' AS match_date, array(date'2020-01-01', date'2020-01-02', "
                   "date'2020-01-03') AS source_match_dates")
    assert leak_violations(df).count() == 2


def test_tournament_progress(spark):
    df = spark.createDataFrame([("t", 1), ("t", 5), ("t", 10), ("u", 0), (None, 3), ("t", None)], "tournament_no string, no_in_tournament int")
    got = [r["tournament_progress"] for r in add_tournament_progress(df).orderBy("tournament_no", "no_in_tournament").collect()]
    assert got == [None, None, 0.1, 0.5, 1.0, None]
    assert add_tournament_progress(spark.range(2)).filter("tournament_progress IS NULL").count() == 2


def test_score_distribution(spark):
    df = spark.createDataFrame([(0.6, 0.5, 0.3, 0.2, 0.2, 0.3, 0.5)],
                               ["p", "a_3-0", "a_3-1", "a_3-2", "b_3-0", "b_3-1", "b_3-2"])
    scored = combine_scores(df)
    values = {r["score"]: r["probability"] for r in score_rows(scored, []).collect()}
    assert sum(values.values()) == pytest.approx(1.0)
    assert values["3-0"] == pytest.approx(0.3) and values["2-3"] == pytest.approx(0.2)
    row = decisiveness(scored).first()
    assert (row["most_likely_score"], row["score_confidence"], row["score_confidence_gap"]) == ("3-0", "medium", 0.1)
    assert row["close_score_alternatives"] == []


def test_close_alternatives(spark):
    df = spark.createDataFrame([(0.30, 0.24, 0.24, 0.12, 0.05, 0.05)], ["3-0", "3-1", "3-2", "2-3", "1-3", "0-3"])
    row = decisiveness(df).first()
    assert [a["score"] for a in row["close_score_alternatives"]] == ["3-1", "3-2"] and row["score_confidence"] == "low"


def test_orientation(spark):
    df = spark.createDataFrame([(10.0, 0.25, 3.0, "team_b", 1, 3)], ["elo_diff", "h2h_win_rate_a", "competition_importance",
                                                                   "winner", "sets_a", "sets_b"])
    row = margin_training_frame(df, ["elo_diff", "h2h_win_rate_a", "competition_importance"]).first()
    assert (row["elo_diff"], row["h2h_win_rate_a"], row["competition_importance"], row["margin_class"]) == (-10.0, 0.75, 3.0, "3-1")
    assert orient(df, ["elo_diff"], F.lit(False)).first()["elo_diff"] == 10.0


def test_logit_is_clipped(spark):
    got = [r[0] for r in spark.createDataFrame([(0.5,), (0.0,), (1.0,)], ["p"]).select(logit(F.col("p"))).collect()]
    assert got[0] == 0.0 and got[1] == pytest.approx(math.log(1e-6 / (1 - 1e-6))) and got[2] == pytest.approx(-got[1])
