"""Fitted models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtside.checks.evaluation import ELO_FOLDS, _elo_rows, _folded
from courtside.checks.registry import COMPETITIONS, ELO, FORM, H2H, LONG, MATCHES, check
from courtside.checks.scoring import FIXTURES, FX, RATING, STATE, fixtures
from courtside.models.baselines import point_diff
from courtside.checks.windows import _IMPORTANCE
from courtside.functions.scores import margin_training_frame
from courtside.models.boosting import Settings, first_gains, fit_boosted, trained_by
from courtside.models.ensemble import average_predictions, calibrated, stacked_predictions, stacking_weights
from courtside.models.isotonic import Isotonic
from courtside.models.linear import EloLogistic, Platt, elo_gap, fit_logistic, logistic_chance, pair_counts, team_strengths
from courtside.models.predictors import bradley_terry_folds, elo_logistic, elo_logistic_folds, per_pool, small_network, win_trees_folds
from courtside.models.trees import MarginTrees, PointTrees, WinTrees, pool_number, row_key
from courtside.operators.drift import drift, merge_sketches, period_sketches, year_period
from courtside.operators.evaluation import label, log_loss, summarize
from courtside.operators.folds import assign_folds, fold_weights
from courtside.plans.comparison import ablation, windows_compared
from courtside.plans.features import FEATURE_COLUMNS
from courtside.plans.sample import base_matches, competitions, feature_frame, matches
from courtside.plans.training import load_bundle, run_metadata, save_bundle, train_all
from courtside.plans.walkforward import elo_predictor, evaluate
from courtside.schemas import GENDERS, MARGINS
from courtside.session import cut, forget, scratch_path

# Models are fitted at the full size of their classes. What SQL cannot fit itself is held against what every right fit must satisfy:
# row counts, first-order conditions, ranges, and being better than a constant.
_POOLS = "select gender, count(*) n, true in_range, true better from matches group by gender"


def _features(spark, sf):
    return cut(feature_frame(spark, sf), "gender")


def _by_pool(rows, score):
    """``score`` is a function of a pool's rows or a fitted model per pool."""
    parts = {g: rows.filter(F.col("gender") == g) for g in GENDERS}
    return reduce(DataFrame.unionByName, [score[g].transform(part) if isinstance(score, dict) else score(part) for g, part in parts.items()])


def _judged(scored, better):
    """Per pool: rows, whether all chances lie inside (0, 1), and ``better``, an aggregate."""
    return scored.groupBy("gender").agg(F.count("*").alias("n"), F.every(F.col("p").between(0.0, 1.0)).alias("in_range"), better.alias("better"))


def _beats_constant():
    """Log loss below that of always giving the share of wins."""
    share = F.avg("y")
    return log_loss(F.col("y"), F.col("p")) < -(share * F.ln(share) + (1 - share) * F.ln(1 - share))


_WINS = """select gender, team, round(sum(won),3) wins from (select gender, team_a team, (winner='team_a')::int::double won from matches
       union all select gender, team_b, (winner='team_b')::int::double from matches) group by gender, team"""


def _wins(spark, sf, **settings):
    """At the optimum a team's expected wins plus its strength (over c = 1) are its wins."""
    m = base_matches(spark, sf)
    strengths = team_strengths(pair_counts(m, ["gender"]), ["gender"], **settings)
    scored = m
    for side in ("a", "b"):
        scored = scored.join(strengths.select("gender", F.col("team").alias(f"team_{side}"), F.col("strength").alias(f"s{side}")), ["gender", f"team_{side}"])
    p = 1.0 / (1.0 + F.exp(F.col("sb") - F.col("sa")))
    sides = scored.withColumn("p", p).select("gender", F.inline(F.array(
        F.struct(F.col("team_a").alias("team"), F.col("p").alias("won")), F.struct(F.col("team_b").alias("team"), (1 - F.col("p")).alias("won")))))
    expected = sides.groupBy("gender", "team").agg(F.sum("won").alias("won"))
    return expected.join(strengths, ["gender", "team"]).select("gender", "team", F.round(F.col("won") + F.col("strength"), 3).alias("wins"))


@check("l1_bradley_terry_strengths", MATCHES, _WINS)
def l1(spark, sf):
    return _wins(spark, sf)


@check("l1_strengths_by_steps", MATCHES, _WINS)
def l1_steps(spark, sf):
    """The same by steps over the whole table, as for groups of very many teams."""
    return _wins(spark, sf, whole=0, tolerance=1e-7)


_EXPECTED = "select gender, count(*) n, round(sum((winner='team_a')::int::double),1) expected_wins from matches group by gender"


def _expected(scored):
    return scored.groupBy("gender").agg(F.count("*").alias("n"), F.round(F.sum("p"), 1).alias("expected_wins"))


@check("l2_elo_logistic", MATCHES, _EXPECTED)
def l2(spark, sf):
    """The intercept has no penalty, so the chances add up to the wins."""
    return _expected(_by_pool(_elo_rows(spark, sf), lambda r: EloLogistic().fit(r).transform(r)))


def _elo_chances(spark, sf):
    return cut(_elo_rows(spark, sf).withColumn("p", F.col("elo_pred_a")).withColumn("y", label()))


@check("l3_platt_calibrator", MATCHES, _EXPECTED)
def l3(spark, sf):
    return _expected(_by_pool(_elo_chances(spark, sf), lambda r: Platt().fit(r).transform(r)))


@check("l4_isotonic_calibrator", MATCHES,
       "select gender, count(*) n, true in_range, true better, true monotone from matches group by gender")
def l4(spark, sf):
    rows = _elo_chances(spark, sf).withColumn("x", F.col("p"))
    scored = cut(_by_pool(rows, lambda r: Isotonic().fit(r).transform(r)))
    order = Window.partitionBy("gender").orderBy("x")
    levels = scored.groupBy("gender", "x").agg(F.max("p").alias("level"))
    rising = levels.withColumn("up", F.coalesce(F.col("level") >= F.lag("level").over(order), F.lit(True)))
    return _judged(scored, _beats_constant()).join(rising.groupBy("gender").agg(F.every("up").alias("monotone")), "gender")


@check("l4_isotonic_levels", MATCHES, ELO,
       """xs as (select gender, round(elo_pred_a, 2) x, count(*)::double w, sum((winner='team_a')::int)::double s from elo group by all),
       run as (select gender, x, sum(w) over o - w wb, sum(w) over o wa, sum(s) over o - s sb, sum(s) over o sa from xs
        window o as (partition by gender order by x rows between unbounded preceding and current row)),
       low as (select i.gender, i.x, a.x ax, min((b.sa - a.sb) / (b.wa - a.wb)) m from run i join run a on a.gender = i.gender and a.x <= i.x
        join run b on b.gender = i.gender and b.x >= i.x group by i.gender, i.x, a.x)""",
       "select gender, x, round(least(0.98, greatest(0.02, max(m))), 9) level from low group by gender, x", recursive=True)
def l4_levels(spark, sf):
    """Levels at hundredths, pooled in ranges of 16, against the largest of the least means."""
    rows = cut(_elo_chances(spark, sf).withColumn("p", F.round("p", 2)))
    asked = rows.select("gender", "p").distinct().withColumn("x", F.col("p"))
    fitted = {g: Isotonic(piece=16).fit(rows.filter(F.col("gender") == g)) for g in GENDERS}
    return _by_pool(asked, fitted).select("gender", "x", F.round("p", 9).alias("level"))


@check("l5_win_trees", MATCHES, _POOLS)
def l5(spark, sf):
    features = _features(spark, sf).withColumn("y", label())
    models = WinTrees().fit_pools(features, FEATURE_COLUMNS, list(GENDERS))
    return _judged(_by_pool(features, models), _beats_constant())


@check("l5_trees_by_passes", MATCHES, "select gender, count(*) n, true alike from matches group by gender")
def l5_passes(spark, sf):
    """Trees grown by passes over all rows, as for large models, predict what those grown in one task a model do."""
    features = _features(spark, sf)
    trains = trained_by(F.array(pool_number(list(GENDERS))))
    settings = Settings(**{**WinTrees.DEFAULTS, "rounds": 5})
    made = [fit_boosted(features, FEATURE_COLUMNS, label(), row_key(), trains, len(GENDERS), settings=settings, whole=n) for n in (0, 1 << 40)]
    scored = features
    for i, model in enumerate(made):
        scored = model.transform(scored, f"p{i}", pool_number(list(GENDERS)))
    return scored.groupBy("gender").agg(F.count("*").alias("n"), F.every(F.abs(F.col("p0")[0] - F.col("p1")[0]) < 1e-9).alias("alike"))


@check("s9_model_round_trip", MATCHES,
       f"select gender, count(*) n, 0::bigint changed, '{','.join(FEATURE_COLUMNS)}' features from matches group by gender")
def s9(spark, sf):
    features = _features(spark, sf)
    path = scratch_path(spark, "model")
    model = WinTrees().fit(features, FEATURE_COLUMNS)
    model.save(spark, path)
    loaded = WinTrees.load(spark, path)
    both = loaded.transform(model.transform(features, out="before"), out="after")
    return both.groupBy("gender").agg(F.count("*").alias("n"), F.count_if(F.col("before") != F.col("after")).alias("changed"),
                                      F.lit(",".join(loaded.feature_columns)).alias("features"))


@check("l6_feature_importance", MATCHES, f"select {len(FEATURE_COLUMNS)}::bigint n, true falling, 1.0::double total")
def l6(spark, sf):
    features = _features(spark, sf)
    found = WinTrees().fit(features, FEATURE_COLUMNS).feature_importance(spark)
    order = Window.orderBy(F.desc("importance"), "feature")  # one row per feature
    return found.withColumn("ok", F.col("importance") <= F.coalesce(F.lag("importance").over(order), F.col("importance"))).agg(
        F.count("*").alias("n"), F.every("ok").alias("falling"), F.round(F.sum("importance"), 6).alias("total"))


@check("l7_margin_trees", MATCHES, "select gender, count(*) n, true sums_to_one, true better from matches group by gender")
def l7(spark, sf):
    """Chances of the winner's margin add up to one; their log loss is below that of equal shares, to which class weights lead without features."""
    features = _features(spark, sf)
    frame = margin_training_frame(features, FEATURE_COLUMNS)
    models = MarginTrees().fit_pools(features, FEATURE_COLUMNS, list(GENDERS))
    scored = reduce(DataFrame.unionByName, [m.transform(frame.filter(F.col("gender") == g), "a") for g, m in models.items()])
    total = sum((F.col(f"`a_{m}`") for m in MARGINS[1:]), F.col(f"`a_{MARGINS[0]}`"))
    hit = F.coalesce(*[F.when(F.col("margin_class") == m, F.col(f"`a_{m}`")) for m in MARGINS])
    return scored.groupBy("gender").agg(F.count("*").alias("n"), F.every(F.abs(total - 1) < 1e-9).alias("sums_to_one"),
                                        (-F.avg(F.ln(hit)) < F.ln(F.lit(float(len(MARGINS))))).alias("better"))


_GAINS = """x as (select gender, cast(y as double) y, feature, cast(v as double) v from (
  select gender, y, unnest([struct_pack(feature := 'competition_importance', v := imp), struct_pack(feature := 'current_streak_diff', v := streak)], recursive := true) from rows0)),
pool as (select gender, sum(y) / count(*) p from rows0 group by gender),
t as (select x.gender, feature, v, sum(y - p) g, count(*) * any_value(p * (1 - p)) h, count(*) n from x join pool using (gender) group by x.gender, feature, v),
cum as (select gender, feature, v threshold, sum(g) over w gl, sum(h) over w hl, sum(n) over w nl,
  sum(g) over p ga, sum(h) over p ha, sum(n) over p na from t
  window w as (partition by gender, feature order by v rows between unbounded preceding and current row), p as (partition by gender, feature))"""
_FIRST = """select gender, feature, threshold, round(gl*gl/(hl+1) + (ga-gl)*(ga-gl)/(ha-hl+1) - ga*ga/(ha+1), 6) gain
 from cum where nl >= 20 and na - nl >= 20"""


@check("l5_first_split_gains", MATCHES, COMPETITIONS, _IMPORTANCE, LONG, FORM,
       """rows0 as (select m.gender, cast(m.winner = 'team_a' as int) y,
        m.ci imp, a.streak - b.streak streak from imp m
        join form a on a.seq = m.seq and a.side = 'a' join form b on b.seq = m.seq and b.side = 'b')""",
       _GAINS, _FIRST)
def l5_gains(spark, sf):
    """What every possible first split of the win trees would save, on two features, for both pools in one pass."""
    columns = ["competition_importance", "current_streak_diff"]
    trains = trained_by(F.array(pool_number(list(GENDERS))))
    found = first_gains(_features(spark, sf), columns, label(), row_key(), trains, len(GENDERS), settings=Settings(least_rows=20))
    pool = F.element_at(F.array(*[F.lit(g) for g in GENDERS]), F.col("model") + 1)
    return found.select(pool.alias("gender"), "feature", "threshold", F.round("gain", 6).alias("gain"))


@check("l7_first_split_gains", MATCHES, COMPETITIONS, _IMPORTANCE,
       """rows0 as (select m.gender, 'competition_importance' feature, least(sets_a, sets_b) k, ci v from imp m),
       sizes as (select gender, k, count(*) n from rows0 group by gender, k), top as (select gender, max(n) top from sizes group by gender),
       w as (select gender, k, top / n weight from sizes join top using (gender)),
       t as (select r.gender, o.output, r.v, sum(weight * (1.0/3 - cast(r.k = o.output as int))) g, sum(weight * 2.0/9) h from rows0 r join w using (gender, k),
        (select unnest([0, 1, 2]) output) o group by r.gender, o.output, r.v),
       cum as (select gender, output, v, sum(g) over q gl, sum(h) over q hl, sum(g) over p ga, sum(h) over p ha, count(*) over p nv, row_number() over q rn from t
        window q as (partition by gender, output order by v rows between unbounded preceding and current row), p as (partition by gender, output))""",
       """select gender, output, cast(v as double) threshold, round(gl*gl/(hl+5) + (ga-gl)*(ga-gl)/(ha-hl+5) - ga*ga/(ha+5), 5) gain
        from cum where rn < nv""")
def l7_gains(spark, sf):
    """First splits of the margin trees, one tree a margin: with weights the classes start with a third each."""
    columns = ["competition_importance"]
    pools = list(GENDERS)
    model = MarginTrees()
    rows, weight = model.frame(_features(spark, sf), columns, pools)
    found = first_gains(rows, columns, model.target(), row_key(), trained_by(F.array(pool_number(pools)), weight), len(pools), "softmax",
                        len(MARGINS), model.settings)
    pool = F.element_at(F.array(*[F.lit(g) for g in pools]), F.col("model") + 1)
    return found.select(pool.alias("gender"), "output", "threshold", F.round("gain", 5).alias("gain"))


@check("l8_point_trees", MATCHES, "select gender, count(*) n, true better from matches group by gender")
def l8(spark, sf):
    """The squared error is below that of the mean."""
    features = _features(spark, sf)
    scored = _by_pool(features, PointTrees().fit_pools(features, FEATURE_COLUMNS, list(GENDERS))).withColumn("y", point_diff())
    return scored.groupBy("gender").agg(F.count("*").alias("n"), (F.avg(F.pow(F.col("y") - F.col("p"), 2)) < F.var_pop("y")).alias("better"))


@check("l10_small_network", MATCHES, _POOLS)
def l10(spark, sf):
    features = _features(spark, sf)
    return _judged(per_pool(small_network())(features)(features).withColumn("y", label()), _beats_constant())


def _models(*names):
    models = ", ".join(f"'{n}'" for n in names)
    return (f"select gender, model, test_fold fold, count(*) n, true finite from folds, (select unnest([{models}]) model) "
            "where test_fold is not null group by gender, model, test_fold")


def _compared(predictions):
    rows = summarize(predictions, ["gender", "model", "fold"])
    return rows.select("gender", "model", "fold", "n", F.col("log_loss").between(0.0, 3.0).alias("finite"))


@check("l11_calibrated_model", MATCHES, ELO, ELO_FOLDS, _models("platt", "isotonic"), recursive=True)
def l11(spark, sf):
    folded = cut(_folded(spark, sf), "gender", "test_fold")
    models = {"platt": per_pool(calibrated(elo_logistic, Platt)), "isotonic": per_pool(calibrated(elo_logistic, Isotonic))}
    return _compared(evaluate(folded, models))


@check("l12_model_comparison", MATCHES, ELO, ELO_FOLDS, _models("elo", "bradley_terry", "elo_logistic", "win_trees", "ensemble"), recursive=True)
def l12(spark, sf):
    """All pools and folds of a model are fitted together; the ensemble averages predictions that are already there."""
    folded = cut(assign_folds(_features(spark, sf)), "gender", "test_fold")
    models = {"elo": elo_predictor, "bradley_terry": bradley_terry_folds, "elo_logistic": elo_logistic_folds, "win_trees": win_trees_folds()}
    single = cut(evaluate(folded, models))
    mixed = average_predictions(single, {"elo": 0.5, "bradley_terry": 0.5})
    return _compared(single.unionByName(mixed))


@check("l15_ablation", MATCHES, ELO, ELO_FOLDS, _models("A", "B", "C", "D", "E"), recursive=True)
def l15(spark, sf):
    """Nested feature sets, all fitted in the same passes and compared out of sample."""
    folded = cut(assign_folds(_features(spark, sf)), "gender", "test_fold")
    return _compared(ablation(folded))


@check("l18_training_windows", MATCHES, ELO, ELO_FOLDS,
       """st as (select gender, test_fold fold, min(date) start from folds where test_fold is not null group by gender, test_fold),
       tr as (select f.gender, k.fold, s.scheme, case when winner='team_a' then 1.0::double else 0.0::double end y,
        case s.scheme when 'expanding' then 1.0::double when 'rolling' then case when date_diff('day', f.date, k.start) <= 365 then 1.0::double else 0.0::double end
         else pow(0.5::double, date_diff('day', f.date, k.start) / 365.0::double) end w
        from folds f join st k on f.gender = k.gender and coalesce(f.test_fold, -1) < k.fold, (select unnest(['expanding','rolling','decayed']) scheme) s)""",
       "select gender, fold, scheme, round(sum(w), 4) weight, round(sum(w * y), 4) expected_wins from tr where w > 0 group by gender, fold, scheme", recursive=True)
def l18(spark, sf):
    """At the weighted optimum the weighted chances of the training rows add up to their weighted wins, for every scheme and fold."""
    folded = _folded(spark, sf)
    return reduce(DataFrame.unionByName, [_window_condition(fold_weights(folded, s), s) for s in ("expanding", "rolling", "decayed")])


def _window_condition(rows, scheme, n_folds=5):
    pool = pool_number(list(GENDERS))
    trains = F.transform(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda f: F.struct(
        (pool * n_folds + f).cast("int").alias("m"), F.element_at("fold_weights", f + 1).alias("w")))
    found = fit_logistic(rows, [elo_gap()], label(), trains, len(GENDERS) * n_folds)
    each = rows.select("gender", elo_gap().alias("gap"), F.inline(trains)).where("w > 0")
    p = logistic_chance(found, [F.col("gap")], F.col("m"))
    return each.groupBy("gender", (F.col("m") % n_folds).cast("int").alias("fold")).agg(
        F.lit(scheme).alias("scheme"), F.round(F.sum("w"), 4).alias("weight"), F.round(F.sum(F.col("w") * p), 4).alias("expected_wins"))


@check("l18_windows_compared", MATCHES, ELO, ELO_FOLDS, _models("expanding", "rolling", "decayed"), recursive=True)
def l18_compared(spark, sf):
    """The same model under the three schemes, out of sample; and so the trees take the weights too."""
    folded = cut(assign_folds(_features(spark, sf)), "gender", "test_fold")
    return _compared(windows_compared(folded))


_STACK = """b0 as (select f.gender, f.test_fold fold, case when winner='team_a' then 1.0::double else 0.0::double end y, f.elo_pred_a p1,
  (coalesce(h.rate, 0) * h.met + 1) / (h.met + 2) p2, coalesce(0.5 + (a.wr10 - b.wr10) / 2, 0.5) p3
  from folds f join h2hr h on h.seq = f.seq join form a on a.seq = f.seq and a.side='a' join form b on b.seq = f.seq and b.side='b' where f.test_fold is not null),
fm as (select gender, fold, count(*) n, sum(p1*p1) g11, sum(p1*p2) g12, sum(p1*p3) g13, sum(p2*p2) g22, sum(p2*p3) g23, sum(p3*p3) g33,
  sum(p1*y) c1, sum(p2*y) c2, sum(p3*y) c3 from b0 group by gender, fold),
mm as (select gender, fold, coalesce(sum(n) over w, 0) n, sum(g11) over w g11, sum(g12) over w g12, sum(g13) over w g13, sum(g22) over w g22, sum(g23) over w g23,
  sum(g33) over w g33, sum(c1) over w c1, sum(c2) over w c2, sum(c3) over w c3 from fm
  window w as (partition by gender order by fold rows between unbounded preceding and 1 preceding)),
d as (select *, g11-2*g13+g33 a11, g12-g13-g23+g33 a12, g22-2*g23+g33 a22, c1-c3-g13+g33 b1, c2-c3-g23+g33 b2 from mm),
cand as (
 select gender, fold, (b1*a22-b2*a12)/(a11*a22-a12*a12) w1, (b2*a11-b1*a12)/(a11*a22-a12*a12) w2 from d
 union all select gender, fold, (c1-c2-g12+g22)/(g11-2*g12+g22), 1-(c1-c2-g12+g22)/(g11-2*g12+g22) from d
 union all select gender, fold, (c1-c3-g13+g33)/(g11-2*g13+g33), 0 from d
 union all select gender, fold, 0, (c2-c3-g23+g33)/(g22-2*g23+g33) from d
 union all select gender, fold, 1, 0 from d union all select gender, fold, 0, 1 from d union all select gender, fold, 0, 0 from d),
ok as (select d.gender, d.fold, w1, w2, 1-w1-w2 w3 from cand join d using (gender, fold) where w1 >= 0 and w2 >= 0 and 1-w1-w2 >= -1e-12 and n > 0),
val as (select ok.*, (w1*w1*g11+w2*w2*g22+w3*w3*g33)/2+w1*w2*g12+w1*w3*g13+w2*w3*g23-w1*c1-w2*c2-w3*c3 v from ok join d using (gender, fold)),
best as (select gender, fold, arg_min(struct_pack(a := w1, b := w2, c := w3), v) w from val group by gender, fold)"""


@check("l17_stacking", MATCHES, ELO, ELO_FOLDS, LONG, FORM, H2H, _STACK,
       """select mm.gender, mm.fold, cast(mm.n as bigint) n, x.model, round(case when mm.n = 0 then 1.0/3 when x.model = 'elo' then best.w.a
        when x.model = 'h2h' then best.w.b else best.w.c end, 3) weight
       from mm left join best on best.gender = mm.gender and best.fold = mm.fold, (select unnest(['elo', 'h2h', 'form']) model) x""", recursive=True)
def l17(spark, sf):
    """Weights of three predictions that need no fitting, from the folds before; SQL tries every face of the simplex."""
    learned = stacking_weights(_simple_predictions(spark, sf), ["elo", "h2h", "form"])
    names = F.array(F.lit("elo"), F.lit("h2h"), F.lit("form"))
    return learned.select("gender", "fold", "n", F.inline(F.arrays_zip(names.alias("model"), F.col("weights").alias("weight")))).select(
        "gender", "fold", "n", F.col("model"), F.round("weight", 3).alias("weight"))


def _simple_predictions(spark, sf):
    features = cut(feature_frame(spark, sf).select("gender", "seq", "date", "winner", "elo_pred_a", "h2h_matches_played", "h2h_win_rate_a",
                                                   "win_rate_last10_diff"), "gender")
    folded = cut(assign_folds(features), "gender", "test_fold")
    forget(features)
    met = F.col("h2h_matches_played")

    def given(p):
        def predict(rows):
            return rows.withColumn("p", p)
        def factory(train):
            return predict
        factory.needs_training = False
        return factory

    single = cut(evaluate(folded, {
        "elo": elo_predictor, "h2h": given((F.coalesce("h2h_win_rate_a", F.lit(0.0)) * met + 1) / (met + 2)),
        "form": given(F.coalesce(0.5 + F.col("win_rate_last10_diff") / 2, F.lit(0.5)))}))
    forget(folded)
    return single


@check("l17_stacked_predictions", MATCHES, ELO, ELO_FOLDS, "select gender, test_fold fold, count(*) n, true inside, true good from folds where test_fold is not null group by gender, test_fold",
       recursive=True)
def l17_predictions(spark, sf):
    """Stacked chances lie between the least and the largest of a row's, and from the second fold on are no worse than the mean of the three by more than a hair."""
    single = _simple_predictions(spark, sf)
    models = ["elo", "h2h", "form"]
    rows = cut(stacked_predictions(single, models).select("gender", "fold", "seq", "y", F.col("p").alias("s"))
               .join(single.groupBy("gender", "fold", "seq").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.avg("p").alias("mean")), ["gender", "fold", "seq"]))
    gap = F.avg(F.pow(F.col("s") - F.col("y"), 2)) - F.avg(F.pow(F.col("mean") - F.col("y"), 2))
    return rows.groupBy("gender", "fold").agg(
        F.count("*").alias("n"), F.every(F.col("s").between(F.col("lo") - 1e-12, F.col("hi") + 1e-12)).alias("inside"), (gap < 1e-3).alias("good"))


_DRIFT = """v as (select gender, cast(floor((year(date) - 1992) / 2) as int) period, feature, cast(x as double) x from (
  select m.gender, m.date, unnest([struct_pack(feature := 'matches_played_diff', x := cast(a.played - b.played as double)),
   struct_pack(feature := 'win_rate_last10_diff', x := a.wr10 - b.wr10), struct_pack(feature := 'h2h_win_rate_a', x := h.rate)], recursive := true)
  from matches m join form a on a.seq = m.seq and a.side = 'a' join form b on b.seq = m.seq and b.side = 'b' join h2hr h on h.seq = m.seq)),
k as (select gender, feature, period, count(*) all_n, count(x) n from v group by all),
o as (select gender, feature, period, x, row_number() over (partition by gender, feature, period order by x) rn from v where x is not null),
q as (select o.gender, o.feature, o.period, i, x from o join k using (gender, feature, period), (select unnest(range(1, 1001)) i) where rn = (i * n + 999) // 1000),
pr as (select c.gender, c.feature, c.period, b.period base, c.n, b.n base_n, c.all_n, b.all_n base_all from k c join k b on b.gender = c.gender and b.feature = c.feature and b.period = c.period - 1),
gr as (select distinct pr.gender, pr.feature, pr.period, pr.base, q.x from pr join q on q.gender = pr.gender and q.feature = pr.feature and q.period in (pr.period, pr.base) where q.i % 10 = 0),
ranked as (select gr.gender, gr.feature, gr.period, gr.base, gr.x, count(*) filter (q.period = gr.period) / 1000 f, count(*) filter (q.period = gr.base) / 1000 g
  from gr join q on q.gender = gr.gender and q.feature = gr.feature and q.period in (gr.period, gr.base) and q.x <= gr.x group by gr.gender, gr.feature, gr.period, gr.base, gr.x),
ks as (select gender, feature, period, max(abs(f - g)) ks from ranked group by all),
cut as (select pr.gender, pr.feature, pr.period, pr.base, q.i // 100 i, q.x from pr join q on q.gender = pr.gender and q.feature = pr.feature and q.period = pr.base and q.i % 100 = 0 and q.i < 1000),
edge as (select c.gender, c.feature, c.period, c.i, ranked.f, ranked.g from cut c join ranked using (gender, feature, period, base, x)
  union all select gender, feature, period, 0, 0, 0 from pr union all select gender, feature, period, 10, 1, 1 from pr),
cell as (select gender, feature, period, greatest(f - lag(f) over w, 1e-4::double) a, greatest(g - lag(g) over w, 1e-4::double) e, i from edge window w as (partition by gender, feature, period order by i)),
psi as (select gender, feature, period, sum((a - e) * ln(a / e)) psi from cell where i > 0 group by all)"""


@check("l16_drift", MATCHES, LONG, FORM, H2H, _DRIFT,
       """select pr.gender, pr.feature, pr.period, pr.base, pr.n, pr.base_n, round(psi, 6) psi, round(ks, 6) ks,
        round((1 - n / all_n) - (1 - base_n / base_all), 6) missing from pr join psi using (gender, feature, period) join ks using (gender, feature, period)""")
def l16(spark, sf):
    """Two-year periods against the ones before. The sketches are made by year and merged; with these sizes they are still exact."""
    features = ["matches_played_diff", "win_rate_last10_diff", "h2h_win_rate_a"]
    rows = _features(spark, sf).withColumn("year", F.year("date"))
    by_year = period_sketches(rows, features, year_period(F.col("date"), 1992, 2), ["gender", "year"], 16384)
    found = drift(merge_sketches(by_year, ["gender"], 16384), ["gender"])
    return found.select("gender", "feature", "period", "base", "n", "base_n", *[F.round(c, 6).alias(c) for c in ("psi", "ks", "missing")])


@check("s10_run_metadata", MATCHES,
       """select gender, count(*) n_matches, min(date) date_min, max(date) date_max,
       (select count(*) from (select team_a t from matches x where x.gender=m.gender union select team_b from matches x where x.gender=m.gender)) n_teams
       from matches m group by gender""")
def s10(spark, sf):
    return run_metadata(base_matches(spark, sf)).drop("feature_columns")


@check("f2_prediction_records", MATCHES, COMPETITIONS, LONG, FORM, STATE, ELO, RATING, FIXTURES, FX,
       """select gender, team_a, team_b, date, competition_id, round_even(ea,1) elo_team_a, round_even(eb,1) elo_team_b,
       case when least(mpa,mpb)=0 then 'low (at least one team has no history in the dataset)' when least(mpa,mpb)<5 then 'low'
        when least(mpa,mpb)<15 then 'medium' else 'high' end confidence, true chances, true scores, 6 n_scores, null::varchar reason from fxx
       union all select 'mixed', 'X', 'Y', date '2020-01-01', 'none', null, null, null, null, null, null, 'unknown gender'""", recursive=True)
def f2(spark, sf):
    """Records of all fixtures and of one that cannot be scored."""
    bundle = train_all(matches(spark, sf), competitions(spark))
    asked = cut(fixtures(base_matches(spark, sf)))
    odd = spark.sql("SELECT 'mixed' AS gender, 'X' AS team_a, 'Y' AS team_b, DATE '2020-01-01' AS date, 'none' AS competition_id")
    got = bundle.predict(asked.unionByName(odd), competitions(spark))
    chances = F.map_values("set_score_probabilities")
    total = F.aggregate(chances, F.lit(0.0), lambda a, x: a + x)
    return got.select(
        "gender", "team_a", "team_b", "date", "competition_id", "elo_team_a", "elo_team_b", "confidence",
        (F.abs(F.col("p_team_a_wins") + F.col("p_team_b_wins") - 1) < 2e-4).alias("chances"), (F.abs(total - 1) < 1e-3).alias("scores"),
        F.when(F.col("reason").isNull(), F.size(chances)).alias("n_scores"), "reason")


@check("l14_train_save_and_score", MATCHES, FIXTURES, "select gender, count(*) n, 0::bigint changed from fx group by gender")
def l14(spark, sf):
    """Predictions of a bundle before and after it was written and read again."""
    path = scratch_path(spark, "bundle")
    bundle = train_all(matches(spark, sf), competitions(spark))
    asked = cut(fixtures(base_matches(spark, sf)))
    save_bundle(bundle, path)
    key = ["gender", "team_a", "team_b", "date"]
    shown = ["p_team_a_wins", "most_likely_score", "expected_point_diff", "confidence"]
    before, after = (b.predict(asked, competitions(spark)).select(*key, F.struct(*shown).alias(n))
                     for b, n in ((bundle, "before"), (load_bundle(spark, path), "after")))
    both = before.join(after, key, "full")
    return both.groupBy("gender").agg(F.count("*").alias("n"), F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("changed"))
