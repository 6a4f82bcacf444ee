import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside.models.baselines import linear_elo, mean_baseline
from courtside.models.ensemble import average_ensemble, average_predictions, calibrated
from courtside.models.isotonic import Isotonic
from courtside.models.linear import BradleyTerry, EloLogistic, Platt
from courtside.models.neural import SmallNetwork
from courtside.models.trees import MarginTrees, PointTrees, WinTrees
from courtside.operators.folds import assign_folds
from courtside.operators.state import team_state
from courtside.plans.features import FEATURE_COLUMNS, build_features
from courtside.plans.predict import fixture_features
from courtside.plans.training import load_bundle, save_bundle, train_all
from courtside.plans.walkforward import elo_predictor, evaluate, fold_metrics
from courtside.operators.h2h import pair_days
from courtside.operators.elo import final_ratings
from courtside.session import cut
from courtside.sources.dimensions import competition_table

SMALL = {"rounds": 3}


@pytest.fixture(scope="module")
def features(spark, ladder):
    rows = ladder.withColumns({
        "competition_id": F.lit("WCH_MEN"), "stage": F.lit("final"), "tournament_no": F.lit("t"),
        "no_in_tournament": (F.col("seq") + 1).cast("int"),
        "team_a_score": F.col("sets_a") * 25, "team_b_score": F.col("sets_b") * 25})
    return cut(build_features(rows, competition_table(spark)))


def _bt_reference(rows):
    """Newton steps on the penalised likelihood, with plain numpy."""
    teams = sorted({r["team_a"] for r in rows} | {r["team_b"] for r in rows})
    x = np.zeros((len(rows), len(teams)))
    y = np.array([1.0 if r["winner"] == "team_a" else 0.0 for r in rows])
    for i, r in enumerate(rows):
        x[i, teams.index(r["team_a"])] += 1
        x[i, teams.index(r["team_b"])] -= 1
    w = np.zeros(len(teams))
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(len(teams)), x.T @ (p - y) + w)
    return dict(zip(teams, w))


def test_bradley_terry_matches_the_penalised_optimum(ladder):
    model = BradleyTerry().fit(ladder)
    got = {r["team"]: r["strength"] for r in model.strengths.collect()}
    want = _bt_reference([r.asDict() for r in ladder.collect()])
    assert got == pytest.approx(want, abs=1e-5)
    assert got["STRONG"] > got["MID"] > got["WEAK"] > got["BOTTOM"]


def test_bradley_terry_unseen_team_and_single_class(spark, ladder):
    model = BradleyTerry().fit(ladder)
    new = spark.createDataFrame([("NEW", "NEWER")], "team_a string, team_b string")
    assert model.transform(new).first()["p"] == 0.5
    one = BradleyTerry().fit(ladder.filter("team_a = 'STRONG' AND winner = 'team_a'"))
    assert {r["strength"] for r in one.strengths.collect()} == {0.0}


def test_elo_logistic_is_monotone_and_falls_back(spark, features):
    rows = EloLogistic().fit(features).transform(features).select((F.col("elo_a_pre") - F.col("elo_b_pre")).alias("d"), "p").orderBy("d").collect()
    ps = [r["p"] for r in rows]
    assert all(a <= b + 1e-12 for a, b in zip(ps, ps[1:]))
    single = EloLogistic().fit(features.filter("winner = 'team_a'"))
    assert {r["p"] for r in single.transform(features).collect()} == {0.5}


def test_calibrators(spark):
    rows = spark.createDataFrame([(0.02 + 0.96 * i / 199, float((i * 7) % 200 < i)) for i in range(200)], "p double, y double")
    for maker in (Platt, Isotonic):
        out = [r["q"] for r in maker().fit(rows).transform(rows, out="q").orderBy("p").collect()]
        assert all(0 <= a <= b + 1e-9 for a, b in zip(out, out[1:]))
        same = maker().fit(rows.filter("y = 1")).transform(rows, out="q").filter("q <> p").count()
        assert same == 0
    ends = spark.createDataFrame([(0.0,), (1.0,)], "p double")
    low, high = [r["p"] for r in Isotonic().fit(rows).transform(ends).orderBy("p").collect()]
    assert low >= 0.02 and high <= 0.98


def test_win_trees_save_load_and_importance(spark, features, tmp_path):
    model = WinTrees(**SMALL, least_rows=1).fit(features, FEATURE_COLUMNS)
    before = model.transform(features).select("seq", "p").orderBy("seq").collect()
    model.save(spark, f"{tmp_path}/m")
    loaded = WinTrees.load(spark, f"{tmp_path}/m")
    assert loaded.feature_columns == FEATURE_COLUMNS
    assert loaded.transform(features).select("seq", "p").orderBy("seq").collect() == before
    weights = [r["importance"] for r in model.feature_importance(spark).collect()]
    assert weights == sorted(weights, reverse=True) and len(weights) == 12


def test_margin_and_point_models(features):
    margin = MarginTrees(rounds=5, depth=3).fit(features, FEATURE_COLUMNS)
    for r in margin.transform(features, "a").select("a_3-0", "a_3-1", "a_3-2").collect():
        assert sum(r) == pytest.approx(1.0)
    assert PointTrees(**SMALL).fit(features, FEATURE_COLUMNS).transform(features).filter("p IS NULL").count() == 0


def test_network_takes_missing_values(features):
    rows = SmallNetwork(iterations=(5,)).fit(features, FEATURE_COLUMNS).transform(features)
    assert rows.filter("p BETWEEN 0 AND 1").count() == 60
    assert rows.filter("h2h_win_rate_a IS NULL").count() == features.filter("h2h_win_rate_a IS NULL").count()


def test_walk_forward_with_ensemble_and_calibration(features):
    folded = cut(assign_folds(features, n_folds=2), "gender", "test_fold")
    models = {"elo": elo_predictor, "mix": average_ensemble({"a": elo_predictor, "b": elo_predictor}),
              "platt": calibrated(elo_predictor, Platt)}
    preds = evaluate(folded, models, n_folds=2).cache()
    metrics = {(r["model"], r["fold"]): r for r in fold_metrics(preds, folded).collect()}
    assert len(metrics) == 6
    assert metrics["mix", 1]["log_loss"] == pytest.approx(metrics["elo", 1]["log_loss"])
    mean = average_predictions(preds.filter("model IN ('elo', 'mix')"))
    both = mean.join(preds.filter("model = 'elo'").select("seq", F.col("p").alias("e")), "seq")
    assert both.filter("abs(p - e) > 1e-12").count() == 0


def test_point_baselines(features):
    folded = assign_folds(features, n_folds=2)
    rows = {r["seq"]: r for r in mean_baseline(folded, 2).collect()}
    train = [r["team_a_score"] - r["team_b_score"] for r in features.orderBy("date", "seq").collect()][:18]
    assert rows[20]["p"] == pytest.approx(sum(train) / 18)
    assert linear_elo(folded, 2).filter("p IS NULL").count() == 0


def test_state_gives_the_features_history_would_have_given(spark, features):
    """Features from the state before the last match equal that match's historical features."""
    last = features.orderBy(F.desc("date"), F.desc("seq")).limit(1)
    row = last.first()
    past = features.filter(F.col("seq") != row["seq"])
    fixture = last.select("gender", "team_a", "team_b", "date", "competition_id", "tournament_progress")
    got = fixture_features(fixture, final_ratings(past, past), team_state(past), pair_days(past), competition_table(spark)).first()
    for c in FEATURE_COLUMNS:
        assert got[c] == pytest.approx(row[c]), c


def test_bundle_round_trip(spark, ladder, tmp_path):
    rows = ladder.withColumns({"competition_id": F.lit("WCH_MEN"), "stage": F.lit("final"),
                               "team_a_score": F.col("sets_a") * 25, "team_b_score": F.col("sets_b") * 25})
    competitions = competition_table(spark)
    bundle = train_all(rows, competitions, SMALL, {"rounds": 3}, SMALL)
    save_bundle(bundle, f"{tmp_path}/b")
    fixtures = spark.sql("SELECT 'men' AS gender, a AS team_a, b AS team_b, date'2016-01-01' AS date, 'OG_MEN' AS competition_id "
                         "FROM VALUES ('STRONG', 'BOTTOM'), ('MID', 'NEW') AS t(a, b)")
    got = {r["team_a"]: r for r in load_bundle(spark, f"{tmp_path}/b").predict(fixtures, competitions).collect()}
    strong, new = got["STRONG"], got["MID"]
    assert strong["p_team_a_wins"] + strong["p_team_b_wins"] == pytest.approx(1.0)
    assert math.isclose(sum(strong["set_score_probabilities"].values()), 1.0, abs_tol=5e-4)
    assert new["confidence"].startswith("low (at least one") and new["elo_team_b"] == 1500.0
    assert "No previous meetings on record between these two teams" in new["explanatory_factors"]
    assert strong["explanatory_factors"][0].startswith("Elo rating:")
    assert bundle.metadata.first()["n_matches"] == 60
