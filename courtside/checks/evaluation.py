"""Folds, metrics, calibration and leak reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtside.checks.registry import ELO, LONG, MATCHES, check
from courtside.functions.scores import combine_scores
from courtside.models.baselines import linear_elo, mean_baseline
from courtside.operators.elo import elo_history
from courtside.operators.evaluation import (
    calibration_table, label, leak_violations, score_frequencies, score_metrics, summarize, summarize_across_folds,
    summarize_regression, verdict,
)
from courtside.operators.folds import assign_folds, fold_bounds, tail_split
from courtside.operators.form import long_form, recent_dates
from courtside.plans.sample import base_matches
from courtside.plans.walkforward import elo_predictor, evaluate, fold_metrics
from courtside.session import cut

FOLDS = """fp as (select *, row_number() over (partition by gender order by date, seq)-1 pos, count(*) over (partition by gender) pn from {src}),
fs as (select *, greatest(1, floor(pn*0.3::double)::bigint) ts from fp),
folds as (select *, case when pos>=ts then least((pos-ts)//((pn-ts)//5), 4)::int end test_fold from fs)"""
MATCH_FOLDS = FOLDS.format(src="matches")
ELO_FOLDS = FOLDS.format(src="elo")

_TRAIN = "tr as (select f.*, k.fold from folds f, (select unnest(range(5))::int fold) k where coalesce(f.test_fold,-1) < k.fold)"
_PREDS = """preds as (select gender, test_fold fold, elo_pred_a p, case when winner='team_a' then 1.0::double else 0.0::double end y
 from folds where test_fold is not null)"""


def _loss(y, p):
    q = f"greatest(1e-15::double, least(1-1e-15::double, {p}))"
    return f"-avg({y}*ln({q})+(1-{y})*ln(1-{q}))"


def _elo_rows(spark, sf):
    m = base_matches(spark, sf)
    return cut(m.join(elo_history(m), "seq"))


def _folded(spark, sf):
    rows = assign_folds(_elo_rows(spark, sf)).withColumn("elo_diff", F.col("elo_a_pre") - F.col("elo_b_pre"))
    return cut(rows)


def _predictions(spark, sf):
    return evaluate(_folded(spark, sf), {"elo": elo_predictor})


@check("w11_walk_forward_folds", MATCHES, MATCH_FOLDS, "select seq, cast(pos as bigint) pos, test_fold from folds")
def w11(spark, sf):
    return assign_folds(base_matches(spark, sf)).select("seq", "pos", "test_fold")


@check("w12_tail_split", MATCHES, MATCH_FOLDS,
       "select seq, pos>=floor(pn*(1-0.2::double)) calibration, pos>=floor(pn*(1-0.15::double)) validation from folds")
def w12(spark, sf):
    m = base_matches(spark, sf).select("seq", "gender", "date")
    calib = tail_split(m, 0.2).select("seq", F.col("held_out").alias("calibration"))
    return calib.join(tail_split(m, 0.15).select("seq", F.col("held_out").alias("validation")), "seq")


@check("v7_leak_audit", MATCHES, LONG,
       """select 'o:'||seq||side match_id, date match_date, d offending_source_date from (
        select seq, side, date, unnest(list(date) over (partition by gender, team order by date, seq rows between 10 preceding and 1 preceding)) d
        from long) where d>=date""")
def v7(spark, sf):
    dated = recent_dates(long_form(base_matches(spark, sf))).select(
        F.concat(F.lit("o:"), "seq", "side").alias("match_id"), F.col("date").alias("match_date"), "source_match_dates")
    return leak_violations(dated)


@check("v8_fold_bounds", MATCHES, MATCH_FOLDS,
       """select gender, k.fold, count(*) filter (coalesce(test_fold,-1)<k.fold) train_size, count(*) filter (test_fold=k.fold) n,
       max(date) filter (coalesce(test_fold,-1)<k.fold) max_train_date, min(date) filter (test_fold=k.fold) min_test_date,
       max(date) filter (coalesce(test_fold,-1)<k.fold) > min(date) filter (test_fold=k.fold) leak
       from folds, (select unnest(range(5))::int fold) k group by gender, k.fold""")
def v8(spark, sf):
    return fold_bounds(assign_folds(base_matches(spark, sf)))


@check("a5_probability_metrics", MATCHES, ELO,
       f"""select gender, count(*) n, round({_loss('y','p')},6) log_loss, round(avg((p-y)*(p-y)),6) brier_score,
       round(avg(cast(cast(p>=0.5 as double)=y as double)),6) accuracy from (
        select gender, elo_pred_a p, case when winner='team_a' then 1.0::double else 0.0::double end y from elo) group by gender""",
       recursive=True)
def a5(spark, sf):
    rows = _elo_rows(spark, sf).select("gender", F.col("elo_pred_a").alias("p"), label().alias("y"))
    return summarize(rows, ["gender"]).select(
        "gender", "n", *[F.round(c, 6).alias(c) for c in ("log_loss", "brier_score", "accuracy")])


@check("a6_regression_metrics", MATCHES, ELO,
       """select gender, count(*) n, round(avg(abs(y-p)),6) mae, round(sqrt(avg((y-p)*(y-p))),6) rmse from (
        select gender, (elo_a_pre-elo_b_pre)/20 p, (team_a_score-team_b_score)::double y from elo) group by gender""", recursive=True)
def a6(spark, sf):
    rows = _elo_rows(spark, sf).selectExpr(
        "gender", "(elo_a_pre - elo_b_pre) / 20 AS p", "CAST(team_a_score - team_b_score AS double) AS y")
    return summarize_regression(rows, ["gender"]).select(
        "gender", "n", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"))


def _bins(src, by):
    number = "+".join(f"(p>({k}*0.1::double))::int" for k in range(1, 10))
    group = f"{by}, bin"
    return f"""select {group}, round(avg(p),6) predicted_mean, round(avg(y),6) actual_rate, count(*) "count"
     from (select {by}, p, y, ({number})::int bin from {src} where p between 0 and 1) group by {group}"""


def _rounded_bins(df):
    return df.withColumn("predicted_mean", F.round("predicted_mean", 6)).withColumn(
        "actual_rate", F.round("actual_rate", 6))


@check("a7_calibration_table", MATCHES, ELO,
       "pa as (select gender, elo_pred_a p, (winner='team_a')::int::double y from elo)", _bins("pa", "gender"), recursive=True)
def a7(spark, sf):
    rows = _elo_rows(spark, sf).select("gender", F.col("elo_pred_a").alias("p"), label().alias("y"))
    return _rounded_bins(calibration_table(rows, ["gender"]))


@check("a8_fold_metrics", MATCHES, ELO, ELO_FOLDS, _PREDS,
       f"""select gender, 'elo' model, fold, (select count(*) from folds f where f.gender=preds.gender and coalesce(f.test_fold,-1)<preds.fold) train_size,
       count(*) n, round({_loss('y','p')},6) log_loss, round(avg((p-y)*(p-y)),6) brier_score,
       round(avg(cast(cast(p>=0.5 as double)=y as double)),6) accuracy from preds group by gender, fold""", recursive=True)
def a8(spark, sf):
    folded = cut(assign_folds(_elo_rows(spark, sf)), "gender", "test_fold")
    metrics = fold_metrics(evaluate(folded, {"elo": elo_predictor}), folded)
    return metrics.select("gender", "model", "fold", "train_size", "n",
                          *[F.round(c, 6).alias(c) for c in ("log_loss", "brier_score", "accuracy")])


@check("a9_summary_across_folds", MATCHES, ELO, ELO_FOLDS, _PREDS,
       f"""select gender, 'elo' model, {', '.join(f"round_even(avg({c}),4) {c}_mean, round_even(stddev_samp({c}),4) {c}_std" for c in ('log_loss','brier_score','accuracy'))}
       from (select gender, fold, {_loss('y','p')} log_loss, avg((p-y)*(p-y)) brier_score,
        avg(cast(cast(p>=0.5 as double)=y as double)) accuracy from preds group by gender, fold) group by gender""", recursive=True)
def a9(spark, sf):
    return summarize_across_folds(summarize(_predictions(spark, sf), ["gender", "model", "fold"]), ["gender", "model"])


_MARGINS = """mg as (select *, elo_pred_a p, 0.3+0.4*elo_pred_a a30, 0.3+0.4*(1-elo_pred_a) b30 from elo),
sc as (select *, p*a30 s30, p*0.6*(1-a30) s31, p*0.4*(1-a30) s32, (1-p)*0.4*(1-b30) s23, (1-p)*0.6*(1-b30) s13, (1-p)*b30 s03 from mg)"""


def score_sample(spark, sf):
    """Elo chance plus simple margin chances: a deterministic score distribution."""
    rows = _elo_rows(spark, sf).withColumn("p", F.col("elo_pred_a"))
    for side, chance in (("a", F.col("p")), ("b", 1 - F.col("p"))):
        first = 0.3 + 0.4 * chance
        rows = rows.withColumns({f"{side}_3-0": first, f"{side}_3-1": 0.6 * (1 - first), f"{side}_3-2": 0.4 * (1 - first)})
    return combine_scores(rows)


_BEST = """case greatest(s30,s31,s32,s23,s13,s03) when s30 then '3-0' when s31 then '3-1' when s32 then '3-2' when s23 then '2-3'
 when s13 then '1-3' else '0-3' end"""


@check("a10_exact_score_metrics", MATCHES, ELO, _MARGINS,
       f"""select gender, count(*) n, round(-avg(ln(case sets_a||'-'||sets_b when '3-0' then s30 when '3-1' then s31 when '3-2' then s32
        when '2-3' then s23 when '1-3' then s13 else s03 end/(s30+s31+s32+s23+s13+s03))),6) log_loss,
       round(avg(cast({_BEST}=sets_a||'-'||sets_b as double)),6) accuracy from sc group by gender""", recursive=True)
def a10(spark, sf):
    return score_metrics(score_sample(spark, sf), ["gender"]).select(
        "gender", "n", F.round("log_loss", 6).alias("log_loss"), F.round("accuracy", 6).alias("accuracy"))


@check("a11_score_frequencies", MATCHES, ELO, _MARGINS,
       """select gender, s.score, round(avg((sets_a||'-'||sets_b=s.score)::int::double),6) actual,
       round(avg(case s.score when '3-0' then s30 when '3-1' then s31 when '3-2' then s32 when '2-3' then s23 when '1-3' then s13 else s03 end),6) predicted
       from sc, (values ('3-0'),('3-1'),('3-2'),('2-3'),('1-3'),('0-3')) s(score) group by gender, s.score""", recursive=True)
def a11(spark, sf):
    return score_frequencies(score_sample(spark, sf), ["gender"]).select(
        "gender", "score", F.round("actual", 6).alias("actual"), F.round("predicted", 6).alias("predicted"))


@check("a12_median_total_points", MATCHES,
       "select gender, median(team_a_score+team_b_score)::double median_points from matches group by gender")
def a12(spark, sf):
    # Totals take few distinct values, so the exact aggregate keeps a small table of counts.
    return base_matches(spark, sf).groupBy("gender").agg(
        F.median(F.col("team_a_score") + F.col("team_b_score")).alias("median_points"))


@check("a13_verdict", MATCHES, ELO, ELO_FOLDS, _TRAIN,
       """mm as (select gender, fold, avg((team_a_score-team_b_score)::double) mu, regr_slope((team_a_score-team_b_score)::double, elo_a_pre-elo_b_pre) b,
        regr_intercept((team_a_score-team_b_score)::double, elo_a_pre-elo_b_pre) a from tr group by gender, fold),
       er2 as (select f.gender, f.test_fold, avg(abs((team_a_score-team_b_score)-(a+b*(elo_a_pre-elo_b_pre)))) lin, avg(abs((team_a_score-team_b_score)-mu)) mean
        from folds f join mm on mm.gender=f.gender and mm.fold=f.test_fold group by f.gender, f.test_fold)""",
       """select gender, round(avg(lin),6) challenger, round(avg(mean),6) incumbent,
       case when avg(lin)<avg(mean) then 'linear_elo' else 'mean_baseline' end winner from er2 group by gender""", recursive=True)
def a13(spark, sf):
    folded = _folded(spark, sf)
    preds = mean_baseline(folded).unionByName(linear_elo(folded))
    metrics = summarize_regression(preds, ["gender", "model", "fold"])
    out = verdict(metrics, ["gender"], "mae", "linear_elo", "mean_baseline")
    return out.select("gender", F.round("challenger", 6).alias("challenger"), F.round("incumbent", 6).alias("incumbent"),
                      "winner")


@check("a15_mean_baseline", MATCHES, MATCH_FOLDS, _TRAIN,
       """select f.seq, f.test_fold fold, round(mu,6) p from folds f join (
        select gender, fold, avg((team_a_score-team_b_score)::double) mu from tr group by gender, fold) t
        on t.gender=f.gender and t.fold=f.test_fold""")
def a15(spark, sf):
    return mean_baseline(cut(assign_folds(base_matches(spark, sf)))).select("seq", "fold", F.round("p", 6).alias("p"))


@check("l9_linear_elo_point_diff", MATCHES, ELO, ELO_FOLDS, _TRAIN,
       """select f.seq, f.test_fold fold, round(a+b*(elo_a_pre-elo_b_pre),6) p from folds f join (
        select gender, fold, regr_slope((team_a_score-team_b_score)::double, elo_a_pre-elo_b_pre) b,
         regr_intercept((team_a_score-team_b_score)::double, elo_a_pre-elo_b_pre) a from tr group by gender, fold) t
        on t.gender=f.gender and t.fold=f.test_fold""", recursive=True)
def l9(spark, sf):
    return linear_elo(_folded(spark, sf)).select("seq", "fold", F.round("p", 6).alias("p"))


@check("l12_walk_forward_predictions", MATCHES, ELO, ELO_FOLDS,
       "select gender, seq, 'elo' model, test_fold fold, round(elo_pred_a,6) p, (winner='team_a')::int::double y from folds where test_fold is not null",
       recursive=True)
def l12(spark, sf):
    return _predictions(spark, sf).select("gender", "seq", "model", "fold", F.round("p", 6).alias("p"), "y")


@check("l13_pooled_calibration", MATCHES, ELO, ELO_FOLDS, _PREDS,
       "pm as (select 'elo' model, p, y from preds)", _bins("pm", "model"), recursive=True)
def l13(spark, sf):
    return _rounded_bins(calibration_table(_predictions(spark, sf), ["model"]))
