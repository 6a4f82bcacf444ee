"""Models fitted together, stacking, training windows, drift, connected groups and rating blocks against brute force."""

from collections import defaultdict
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside.models import boosting
from courtside.models.boosting import Boosted, Settings, first_gains, fit_boosted, trained_by
from courtside.models.ensemble import simplex_weights, stacked_predictions, stacking_weights
from courtside.models.isotonic import Isotonic
from courtside.models.linear import bradley_terry_by_fold, fit_logistic, logistic_chance, pair_counts, team_strengths
from courtside.operators.drift import drift, merge_sketches, period_sketches
from courtside.operators.elo import _in_blocks, block_levels, block_runs, elo_history, final_ratings
from courtside.operators.folds import assign_folds, fold_weights, train_rows
from courtside.operators.form import long_form
from courtside.operators.graph import connected_groups
from courtside.operators.rolling import form_last_year, schedule_density
from courtside.operators.state import team_state
from courtside.streaming.state import current_state, merge_state


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        a, b, c = rng.normal(), float(rng.integers(0, 4)), rng.normal()
        k = float((a > 0.3) + (b > 1))
        rows.append((i, None if i % 17 == 0 else a, b, float("nan") if i % 23 == 0 else c, k if i % 41 else None, [[0], [1], [0, 1], []][i % 4]))
    return spark.createDataFrame(rows, "seq bigint, a double, b double, c double, y double, m array<int>").cache()


@pytest.mark.parametrize("objective, outputs", [("squared", 1), ("logistic", 1), ("softmax", 3)])
def test_passes_and_whole_models_agree(table, monkeypatch, objective, outputs):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    y = F.col("y") if objective != "logistic" else F.least("y", F.lit(1.0))
    settings = Settings(rounds=5, depth=3, rate=0.3, row_share=0.7, column_share=0.7)
    got = [fit_boosted(table, ["a", "b", "c"], y, F.col("seq"), trained_by(F.col("m")), 3, objective, outputs, settings, whole=n) for n in (0, 10_000)]
    for one, two in zip(got[0].value, got[1].value):
        assert np.allclose(one, two, atol=1e-9)
    for name in ("feature", "bound"):
        assert all(np.array_equal(x, z) for x, z in zip(getattr(got[0], name), getattr(got[1], name)))
    rows = got[1].transform(table, "p", F.when(F.col("seq") % 5 > 0, F.lit(0))).collect()
    assert all((r.p is None) == (r.seq % 5 == 0) for r in rows)
    if objective == "softmax":
        kept = [r for r in rows if r.p and r.y is not None]
        assert all(abs(sum(r.p) - 1) < 1e-12 for r in kept)
        assert -np.mean([np.log(r.p[int(r.y)]) for r in kept]) < 0.8 < np.log(3)
    # the third model has no rows
    assert not got[0].start[2].any() and not got[1].gain[2].any()


@pytest.mark.parametrize("objective, outputs", [("logistic", 1), ("softmax", 3)])
def test_tasks_that_share_the_rows_of_large_models(table, monkeypatch, objective, outputs):
    """Rows dealt to several tasks, in files and one model after the other, give the trees of one task a model."""
    ran, held = [], boosting._fit_held
    monkeypatch.setattr(boosting, "TASK_ROWS", 60)
    monkeypatch.setattr(boosting, "_fit_held", lambda *args: (ran.append(args[-1]), held(*args))[1])
    y = F.col("y") if objective != "logistic" else F.least("y", F.lit(1.0))
    settings = Settings(rounds=3, depth=3, rate=0.3, row_share=0.7, column_share=0.7)
    got = []
    for whole, most in ((10, 1 << 30), (10, 1), (10_000, 1)):
        monkeypatch.setattr(boosting, "HELD", most)
        got.append(fit_boosted(table, ["a", "b", "c"], y, F.col("seq"), trained_by(F.col("m"), F.col("b") + 1), 3, objective, outputs, settings, whole=whole))
    assert ran[0] > 1 and ran[1] > 1 and ran[2:] == [0]
    for other in got[1:]:
        assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(got[0].value, other.value)) and np.allclose(got[0].gain, other.gain)
        for name in ("feature", "bound"):
            assert all(np.array_equal(a, b) for a, b in zip(getattr(got[0], name), getattr(other, name)))
    assert got[0].gain[:2].any() and not got[0].gain[2].any()


def test_a_level_adds_up_the_smaller_siblings_on_open_columns(monkeypatch):
    rng = np.random.default_rng(3)
    n, bins, s = 5000, 16, Settings(rounds=3, depth=3, rate=0.5)
    part = {"x": rng.integers(0, bins, (n, 4)).astype(np.uint8), "key": np.arange(n), "weight": rng.random(n) + 0.5, "model": np.zeros(n, np.int64),
            "score": np.zeros((n, 1))}
    part["y"] = (part["x"][:, 0] + part["x"][:, 2] + rng.normal(0, 3, n) > 15).astype(float)
    may = np.array([[True, False, True, True]])
    added, levels = [], []
    plain, level = boosting._add, boosting._Held.level
    monkeypatch.setattr(boosting, "_add", lambda total, x, node, *rest: (added.append(len(node)), plain(total, x, node, *rest))[1])

    def held(self, me, feature, bound, depth, *rest):
        sums = level(self, me, feature, bound, depth, *rest)
        node = self.node[0] - (2 ** depth - 1)
        for at in range(2 ** depth):  # every row of the node, whichever sibling was added up
            for f in (0, 2, 3):
                mine = part["x"][node == at, f]
                for got, w in zip(sums[:, 0, 0, at, f], (self.slope[0], self.bend[0], np.ones(n))):
                    assert np.allclose(got, np.bincount(mine, w[node == at], bins), atol=1e-9)
        assert not sums[:, :, :, :, 1].any()
        levels.append(depth)
        return sums

    monkeypatch.setattr(boosting._Held, "level", held)
    me = Boosted("logistic", list("abcd"), [], np.zeros((1, 1)))
    boosting._grow(me, boosting._Held(part, 1), s, may, bins)
    assert levels == [0, 1, 2] * 3 and me.gain[0, 0] > 0 and not me.gain[0, 1]
    assert all(k == n for k, d in zip(added, levels) if d == 0) and all(k <= n / 2 for k, d in zip(added, levels) if d)


def test_features_are_added_up_by_their_joint_bins(monkeypatch):
    rng = np.random.default_rng(5)
    n, counted = 40_000, []
    part = {"x": rng.integers(0, [30, 40, 4, 1], (n, 4)).astype(np.uint8), "y": np.zeros(n), "key": np.arange(n), "weight": rng.random(n) + 0.5,
            "model": np.zeros(n, np.int64), "score": np.zeros((n, 1))}
    part["y"] = (part["x"][:, 0] + part["x"][:, 1] + rng.normal(0, 9, n) > 35).astype(float)
    plain = boosting._add_joint
    monkeypatch.setattr(boosting, "_add_joint", lambda total, packs, *rest: (counted.append(packs), plain(total, packs, *rest))[1])
    made = []
    for joint in (boosting.JOINT, 1):
        monkeypatch.setattr(boosting, "JOINT", joint)
        me = Boosted("logistic", list("abcd"), [], np.zeros((1, 1)))
        boosting._grow(me, boosting._Held({c: v.copy() for c, v in part.items()}, 1), Settings(rounds=3, depth=3, row_share=0.9), np.ones((1, 4), bool), 64)
        made.append(me)
    assert sorted(len(p) for p in counted)[0] < 3 and max(len(p) for p in counted) >= 3
    for name in ("feature", "bound"):
        assert all(np.array_equal(a, b) for a, b in zip(getattr(made[0], name), getattr(made[1], name)))
    assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(made[0].value, made[1].value))


@pytest.mark.parametrize("few", [1, 10 ** 9])
def test_scores_are_the_same_by_columns_and_by_rows(monkeypatch, few):
    monkeypatch.setattr(boosting, "FEW", few)
    rng = np.random.default_rng(6)
    n, models, inner = 900, 3, 7
    x, model = rng.integers(0, 64, (n, 5)).astype(np.uint8), rng.integers(0, models, n)
    me = Boosted("softmax", list("abcde"), [], rng.normal(size=(models, 2)))
    for _ in range(4):
        me.feature.append(rng.integers(0, 5, (models, 2, inner)))
        me.bound.append(np.where(rng.random((models, 2, inner)) < 0.2, 255, rng.integers(0, 64, (models, 2, inner))))
        me.value.append(rng.normal(size=(models, 2, inner + 1)))
    got = me.raw(x, model)
    for i in range(0, n, 37):
        for k in range(2):
            want = me.start[model[i], k]
            for feature, bound, value in zip(me.feature, me.bound, me.value):
                node = 0
                while node < inner:
                    node = 2 * node + 1 + int(x[i, feature[model[i], k, node]] > bound[model[i], k, node])
                want += value[model[i], k, node - inner]
            assert abs(got[i, k] - want) < 1e-12
    assert me.raw(x[:0], model[:0]).shape == (0, 2)


def test_columns_closed_to_a_model_and_round_trip(spark, table, tmp_path):
    allowed = np.array([[True, True, True], [False, True, False]])
    model = fit_boosted(table, ["a", "b", "c"], F.col("y"), F.col("seq"), trained_by(F.array(F.lit(0), F.lit(1))), 2, "squared",
                        settings=Settings(rounds=4), allowed=allowed)
    assert model.gain[0, 0] > 0 and not model.gain[1, [0, 2]].any() and model.gain[1, 1] > 0
    model.save(spark, f"{tmp_path}/m")
    loaded = Boosted.load(spark, f"{tmp_path}/m")
    both = loaded.transform(model.transform(table, "p", 1), "q", 1)
    assert both.where("p <> q").count() == 0
    empty = fit_boosted(table.limit(0), ["a"], F.col("y"), F.col("seq"), trained_by(F.array(F.lit(0))), 1, "squared", settings=Settings(rounds=2))
    assert {r.p[0] for r in empty.transform(table, "p").collect()} == {0.0}


def test_first_gains_against_brute_force(table):
    rows = [r for r in table.collect() if r.y is not None and 0 in r.m]
    y = np.array([r.y for r in rows])
    got = first_gains(table, ["b"], F.col("y"), F.col("seq"), trained_by(F.col("m")), 2, "squared", settings=Settings(penalty=2.0, least_rows=5)).where("model = 0").collect()
    g = y.mean() - y
    for r in got:
        left = np.array([x.b <= r.threshold for x in rows])
        part = [g[s].sum() ** 2 / (s.sum() + 2.0) for s in (left, ~left, left | ~left)]
        assert r.gain == pytest.approx(part[0] + part[1] - part[2], abs=1e-9)
    assert [r.threshold for r in got] == [0.0, 1.0, 2.0]


def test_first_gains_at_every_value_of_a_models_own_rows(spark):
    """Model 0 has the even values below 2 000, model 1 the odd ones; far more values than a tree has bins."""
    rows = spark.range(2000).selectExpr("id AS seq", "CAST(id AS double) AS v", "CAST(id % 3 = 0 AS double) AS y", "array(CAST(id % 2 AS int)) AS m")
    got = first_gains(rows, ["v"], F.col("y"), F.col("seq"), trained_by(F.col("m")), 2, settings=Settings(least_rows=20)).collect()
    for model in (0, 1):
        values = list(range(model, 2000, 2))
        assert sorted(r.threshold for r in got if r.model == model) == values[19:-20]


def test_bin_edges_do_not_depend_on_how_rows_are_dealt(spark):
    rows = spark.range(200_000).selectExpr("CASE WHEN id % 50 = 0 THEN NULL WHEN id % 51 = 0 THEN double('nan') ELSE (hash(id) % 100000) / 7D END AS v",
                                           "CAST(hash(id, 1) AS double) * 1e-300 AS w")
    got = [boosting.bin_edges(rows.repartition(n), ["v", "w"]) for n in (3, 40)]
    for a, b in zip(*got):
        assert np.array_equal(a, b) and len(a) == boosting.BINS - 2
    for c, edges in zip(("v", "w"), got[0]):
        x = np.array([r[0] for r in rows.where(f"{c} IS NOT NULL AND NOT isnan({c})").select(c).collect()])
        shares = [(x <= e).mean() for e in edges]
        assert np.abs(np.array(shares) - np.arange(1, 63) / 63).max() < 1e-3


def test_simplex_weights():
    rng = np.random.default_rng(3)
    for k in (1, 2, 3, 4):
        for _ in range(20):
            p, y = rng.random((30, k)), rng.random(30)
            w = simplex_weights(p.T @ p, p.T @ y)
            assert w.min() >= 0 and w.sum() == pytest.approx(1)
            slope = p.T @ (p @ w - y)
            assert (slope >= w @ slope - 1e-6).all()  # no direction of the simplex goes down
    assert simplex_weights(np.ones((2, 2)), np.ones(2)) == pytest.approx([0.5, 0.5])


def test_stacking_uses_earlier_folds_only(spark):
    rng = np.random.default_rng(4)
    rows = []
    for seq in range(90):
        y = float(rng.random() < 0.5)
        good, bad = 0.8 * y + 0.1, rng.random()
        for name, p in (("good", good if seq < 60 else bad), ("bad", bad if seq < 60 else good)):
            rows.append(("men", seq, name, seq // 30, p if seq != 31 else None, y))
    preds = spark.createDataFrame(rows, "gender string, seq bigint, model string, fold int, p double, y double")
    got = {r.fold: r for r in stacking_weights(preds, ["good", "bad"]).collect()}
    assert got[0].weights == [0.5, 0.5] and (got[0].n, got[1].n, got[2].n) == (0, 30, 59)
    assert got[2].weights[0] > 0.9  # the last fold, where the other is good, is not looked at
    out = {r.seq: r.p for r in stacked_predictions(preds, ["good", "bad"]).collect()}
    assert len(out) == 90 and out[31] is None


def test_strengths_by_steps_equal_newton(crowded):
    pairs = pair_counts(crowded.where("seq < 300"), ["gender"])
    whole = {(r.gender, r.team): r.strength for r in team_strengths(pairs, ["gender"]).collect()}
    steps = {(r.gender, r.team): r.strength for r in team_strengths(pairs, ["gender"], whole=0, tolerance=1e-5).collect()}
    assert steps == pytest.approx(whole, abs=1e-3)


def test_bradley_terry_by_fold(crowded):
    folded = assign_folds(crowded, 3).cache()
    got = {r.seq: r.p for r in bradley_terry_by_fold(folded, 3).collect()}
    assert set(got) == {r.seq for r in folded.where("test_fold IS NOT NULL").collect()}
    past = team_strengths(pair_counts(train_rows(folded, 2), ["gender"]), ["gender"])
    want = {(r.gender, r.team): r.strength for r in past.collect()}
    for r in folded.where("test_fold = 2").limit(20).collect():
        gap = want.get((r.gender, r.team_a), 0.0) - want.get((r.gender, r.team_b), 0.0)
        assert got[r.seq] == pytest.approx(1 / (1 + np.exp(-gap)), abs=1e-9)


def test_logistic_models_together(spark):
    rng = np.random.default_rng(5)
    x, z = rng.normal(0, 200, 300), rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-x / 150 + z))).astype(float)
    w = rng.random(300)
    df = spark.createDataFrame([(float(a), float(b), float(c), float(d)) for a, b, c, d in zip(x, z, y, w)], "x double, z double, y double, w double")
    trains = F.array(F.struct(F.lit(0).alias("m"), F.lit(1.0).alias("w")), F.struct(F.lit(1).alias("m"), F.col("w").alias("w")),
                     F.struct(F.lit(2).alias("m"), F.col("y").alias("w")))
    got = fit_logistic(df, [F.col("x"), F.col("z")], F.col("y"), trains, 3)
    design = np.c_[np.ones(300), x, z]
    for m, weight in ((0, np.ones(300)), (1, w)):
        p = 1 / (1 + np.exp(-design @ got[m]))
        assert np.abs(design.T @ (weight * (p - y)) + np.r_[0, got[m][1:]]).max() < 1e-5
    assert np.isnan(got[2]).all()  # one class only
    assert df.select(logistic_chance(got, [F.col("x"), F.col("z")], F.lit(2)).alias("p")).distinct().first().p == 0.5


def test_fold_weights(spark):
    days = [date(2020, 1, 1) + timedelta(days=50 * i) for i in range(20)]
    df = spark.createDataFrame([("men", d, i, None if i < 8 else (i - 8) // 4) for i, d in enumerate(days)], "gender string, date date, seq bigint, test_fold int")
    got = {s: {r.seq: r.fold_weights for r in fold_weights(df, s, 3, 100.0).collect()} for s in ("expanding", "rolling", "decayed")}
    assert got["expanding"][7] == [1.0, 1.0, 1.0] and got["expanding"][8] == [0.0, 1.0, 1.0]
    assert got["rolling"][5] == [0.0, 0.0, 0.0] and got["rolling"][6] == [1.0, 0.0, 0.0]
    assert got["decayed"][6] == pytest.approx([0.5, 0.125, 0.5 ** 5])
    odd = df.withColumn("date", F.when(F.col("seq") != 2, F.col("date")))
    assert {r.seq: r.fold_weights for r in fold_weights(odd, "rolling", 3).collect()}[2] == [0.0] * 3
    with pytest.raises(ValueError):
        fold_weights(df, "other")


def test_drift_within_the_sketch_error(spark):
    rng = np.random.default_rng(6)
    parts = {0: rng.normal(0, 1, 4000), 1: rng.normal(0.5, 1.2, 3000), 2: rng.normal(0.5, 1.2, 200)}
    rows = [("men", p, i % 3, float(v)) for p, values in parts.items() for i, v in enumerate(values)] + [("men", 2, 0, None)] * 50 + [("women", 0, 0, 1.0), ("women", 1, 0, None)]
    df = spark.createDataFrame(rows, "gender string, period int, lot int, x double")

    def exact(new, old):
        cuts = np.quantile(old, np.arange(1, 10) / 10)
        a, e = (np.diff(np.r_[0, np.searchsorted(np.sort(v), cuts, "right") / len(v), 1]) for v in (new, old))
        grid = np.sort(np.r_[new, old])
        ks = np.abs(np.searchsorted(np.sort(new), grid, "right") / len(new) - np.searchsorted(np.sort(old), grid, "right") / len(old)).max()
        return ((a - e) * np.log(a / e)).sum(), ks

    for size in (200, 4096):
        sketches = merge_sketches(period_sketches(df, ["x"], F.col("period"), ["gender", "lot"], size), ["gender"], size)
        got = {(r.gender, r.period): r for r in drift(sketches, ["gender"]).collect()}
        for p in (1, 2):
            psi, ks = exact(parts[p], parts[p - 1])
            bound = 3 * (1.5 / size ** 0.9) + 0.02
            assert got["men", p].psi == pytest.approx(psi, abs=0.25 * psi + 10 * bound) and got["men", p].ks == pytest.approx(ks, abs=bound)
        assert got["men", 2].missing == pytest.approx(0.2) and got["women", 1].psi is None
        first = {(r.gender, r.period): r.base for r in drift(sketches, ["gender"], "first").collect()}
        assert first == {("men", 1): 0, ("men", 2): 0, ("women", 1): 0}


def test_connected_groups(spark):
    links = [("men", f"t{i:02}", f"t{i + 1:02}") for i in range(20)] + [("men", "x", "y"), ("women", "t05", "x"), ("men", "z", "z"), ("men", None, "q")]
    got = {(r.gender, r.node): r.label for r in connected_groups(spark.createDataFrame(links, "gender string, a string, b string"), ["gender"]).collect()}
    assert got["men", "t20"] == "t00" and got["men", "y"] == "x" and got["women", "x"] == "t05" and got["men", "z"] == "z"


def test_block_levels_follow_the_teams(spark):
    rows = [("men", "p", b, t) for b, teams in enumerate(("ab", "cd", "ac", "bd", "ef")) for t in teams]
    got = {r.block: r.level for r in block_levels(spark.createDataFrame(rows, "gender string, part string, block bigint, team string")).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 0}


@pytest.mark.parametrize("block_rows", [60, 7])
def test_rating_blocks_of_unconnected_groups(crowded, block_rows):
    """Two groups of teams that never meet, one with a match without a team."""
    two = crowded.withColumn("team_a", F.when(F.col("seq") != 11, F.col("team_a")))
    two = two.unionByName(two.where("seq < 150").withColumns({"team_a": F.concat(F.lit("Z"), "team_a"), "team_b": F.concat(F.lit("Z"), "team_b"),
                                                             "seq": F.col("seq") + 1000})).where("seq < 150 OR seq >= 1000")
    whole = {r.seq: r[1:] for r in elo_history(two).collect()}
    assert {r.seq: r[1:] for r in elo_history(two, block_rows=block_rows).collect()} == whole


def test_chained_blocks_are_runs_of_bounded_size(spark, crowded):
    rows = [("men", "p", b, t) for b, teams in enumerate(("ab", "bc", "ca", "ad", "ef", "fa", "ab")) for t in teams] + [("men", "q", b, "z") for b in range(3)]
    got = block_runs(spark.createDataFrame(rows, "gender string, part string, block bigint, team string"), 2)
    runs = {(r.part, r.block): r.run for r in got.collect()}
    assert [runs["p", b] for b in range(7)] == [0, 0, 1, 1, 2, 2, 3] and [runs["q", b] for b in range(3)] == [0, 0, 1]
    whole = {r.seq: r[1:] for r in elo_history(crowded).collect()}
    for run_rows in (1, 150):
        assert {r.seq: r[1:] for r in elo_history(crowded, block_rows=50, run_rows=run_rows).collect()} == whole


def test_rows_without_a_date_or_team_stay(crowded):
    odd = crowded.withColumn("date", F.when(F.col("seq") % 50 > 0, F.col("date"))).withColumn("team_a", F.when(F.col("seq") != 3, F.col("team_a")))
    long = long_form(odd)
    for rows in (form_last_year(long), schedule_density(long)):
        assert rows.count() == long.count()
    lost = schedule_density(long).where("date IS NULL")
    assert lost.count() == 28 and lost.where("matches_last_30d > 0").count() == 0


def _slow_isotonic(p, y):
    xs = sorted(set(p))
    w = [sum(a == x for a in p) for x in xs]
    s = [sum(b for a, b in zip(p, y) if a == x) for x in xs]
    return {x: max(min(sum(s[a:b + 1]) / sum(w[a:b + 1]) for b in range(i, len(xs))) for a in range(i + 1)) for i, x in enumerate(xs)}


@pytest.mark.parametrize("piece", [1000, 9])
def test_isotonic_levels_in_ranges(spark, piece):
    rng = np.random.default_rng(9)
    p = [round(float(x), 2) for x in rng.random(400)] + [0.5] * 60
    y = [float(rng.random() < (0.3 if 0.4 < x < 0.7 else x)) for x in p]  # long stretches to pool
    rows = spark.createDataFrame(list(zip(p, y)) + [(None, 1.0), (0.3, None)], "p double, y double")
    model = Isotonic(0.0, 1.0, piece).fit(rows)
    want = _slow_isotonic(p, y)
    got = {r.x: r.p for r in model.transform(rows.where("p IS NOT NULL").selectExpr("p", "p AS x").distinct()).collect()}
    assert got == pytest.approx(want, abs=1e-12)
    xs = sorted(want)
    asked = spark.createDataFrame([(i, v) for i, v in enumerate([None, float("nan"), -1.0, 0.005, (xs[40] + xs[41]) / 2, 0.3333, 2.0])], "i int, p double")
    out = {r.i: r.p for r in model.transform(asked).collect()}
    line = np.interp([-1.0, 0.005, (xs[40] + xs[41]) / 2, 0.3333, 2.0], xs, [want[x] for x in xs])
    assert out[0] is None and out[1] is None and [out[i] for i in range(2, 7)] == pytest.approx(line.tolist(), abs=1e-9)


def test_state_kept_up_by_batches(spark, crowded, tmp_path):
    """Late rows, a repeated batch, a pool that a batch does not touch: the state is that of one run."""
    rows = crowded.where("date IS NOT NULL").cache()
    arrives = F.when(F.col("seq") % 61 == 0, 2).when(F.col("gender") == "women", F.when(F.col("date") < "2020-02-15", 1).otherwise(3)).otherwise(
        F.when(F.col("date") < "2020-01-20", 0).when(F.col("date") < "2020-02-20", 1).when(F.col("date") < "2020-03-10", 2).otherwise(3))
    placed = rows.withColumn("arrives", arrives).cache()
    out = f"{tmp_path}/state"
    for i in (0, 1, 2, 2, 3, 4):
        merge_state(placed.where(F.col("arrives") == i), i, out)
        upto = placed.where(F.col("arrives") <= i).drop("arrives")
        want = {(r.gender, r.team): r.asDict(recursive=True) for r in team_state(upto).collect()}
        got = {(r.gender, r.team): r.asDict(recursive=True) for r in current_state(spark, out).collect()}
        ratings = {(r.gender, r.team): r.elo for r in final_ratings(upto, elo_history(upto)).collect()}
        assert {k: {c: v for c, v in x.items() if c != "elo"} for k, x in got.items()} == want
        assert {k: x["elo"] for k, x in got.items()} == pytest.approx(ratings, abs=1e-9)


def test_team_state_of_odd_rows(spark):
    """Missing winners and days, days with many rows, teams with one row or without a win; against one team's rows in order."""
    rows = []
    for i in range(160):
        a, b = f"t{i % 7}", f"t{(i + 1 + i // 7 % 6) % 7}"
        winner = None if i % 13 == 5 else "team_a" if (i * 7) % 5 < 3 else "team_b"
        rows.append((i, None if i % 31 == 3 else date(2020, 1, 1 + i // 40), "men" if i % 3 else None, a, b, 3, i % 3, winner))
    rows += [(900, date(2020, 2, 1), "men", "once", "t1", 3, 0, "team_a")] + [(901 + i, date(2020, 2, 2), "men", "t0", "never", 3, 0, "team_a") for i in range(20)]
    df = spark.createDataFrame(rows, "seq bigint, date date, gender string, team_a string, team_b string, sets_a int, sets_b int, winner string")
    sides = defaultdict(list)
    for seq, day, gender, a, b, sa, sb, winner in rows:
        for team, mine, other, side in ((a, sa, sb, "team_a"), (b, sb, sa, "team_b")):
            sides[gender, team].append((day or date.min, seq, None if winner is None else winner == side, mine, other))
    for windows in ((5, 10), (1,), ()):
        got = {(r.gender, r.team): r for r in team_state(df, windows).collect()}
        assert got.keys() == sides.keys()
        for key, mine in sides.items():
            mine = sorted(mine, key=lambda r: r[:2])
            streak, place, last = 0, 0, {True: 0, False: 0}
            for _, _, won, _, _ in mine:
                after = max(streak, 0) + 1 if won else min(streak, 0) - 1
                place += 1
                last[won] = place
                streak = 0 if won is None else place - last[False] if won else last[True] - place
            r = got[key]
            assert (r.matches_played, r.current_streak) == (len(mine), after), key
            assert r.last_match_date == max((x[0] for x in mine if x[0] > date.min), default=None)
            depth = max(windows) if windows else 10
            assert [(x.won, x.sets_for, x.sets_against) for x in r.recent] == [x[2:] for x in mine[-depth:]]


def test_elo_blocks_are_found_without_sorting_matches(spark):
    rows = [(i, date(2020, 1, 1) + timedelta(i // 30), "men", f"t{i % 5}", f"t{5 + i % 3}", 3, i % 3, "team_a") for i in range(600)]
    df = spark.createDataFrame(rows, "seq bigint, date date, gender string, team_a string, team_b string, sets_a int, sets_b int, winner string")
    placed = df.withColumn("part", F.lit("p"))
    for size in (7, 50):  # days over the size, and not
        blocks = _in_blocks(placed, size).groupBy("block").agg(F.count("*").alias("n"), F.min(F.struct("date", "seq")).alias("low"), F.max(F.struct("date", "seq")).alias("high")).orderBy("block").collect()
        assert sum(b.n for b in blocks) == 600 and max(b.n for b in blocks) <= 2 * size and [b.block for b in blocks] == list(range(len(blocks)))
        assert all(x.high < y.low for x, y in zip(blocks, blocks[1:]))
    plan = _in_blocks(placed, 50)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan
