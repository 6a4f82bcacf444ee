"""Further form, schedule, rating and evaluation features."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtside.checks.evaluation import _PREDS, _predictions, ELO_FOLDS
from courtside.checks.registry import ELO, LONG, MATCHES, check
from courtside.operators.context import add_stage_flags
from courtside.operators.elo import BY_MARGIN, DECAYING, RECENT, elo_history
from courtside.operators.evaluation import expected_calibration_error, roc_auc
from courtside.operators.folds import year_folds
from courtside.operators.form import long_form, team_form
from courtside.operators.rolling import form_last_year, h2h_last, points_long, rolling_means, schedule_density, schedule_strength
from courtside.plans.sample import base_matches

_TEAM = "partition by gender, team order by date"


def _rows(n):
    return f"over ({_TEAM}, seq rows between {n} preceding and 1 preceding)"


def _days(n):
    return f"over ({_TEAM} range between interval {n} days preceding and interval 1 days preceding)"


def _rounded(df, names):
    return [F.round(c, 6).alias(c) for c in names]


@check("w17_form_windows", MATCHES, LONG,
       f"""select seq, side, team, round(avg(won) {_rows(3)},6) win_rate_last3, round(avg(won) {_rows(20)},6) win_rate_last20,
       round(avg(sf-sa) {_rows(3)},6) set_margin_avg_last3, round(avg(sf-sa) {_rows(20)},6) set_margin_avg_last20,
       round(avg(won) {_days(365)},6) win_rate_365d, count(*) {_days(365)} matches_365d from long""")
def w17(spark, sf):
    form = form_last_year(team_form(long_form(base_matches(spark, sf)), (3, 20)))
    names = [f"{n}_last{k}" for n in ("win_rate", "set_margin_avg") for k in (3, 20)]
    return form.select("seq", "side", "team", *_rounded(form, [*names, "win_rate_365d"]), F.col("matches_365d").cast("bigint").alias("matches_365d"))


_POINTS = """pl as (select gender, date, seq, 'a' side, team_a team, sets_a::double/(sets_a+sets_b) sets_win_rate,
 team_a_score::double/(team_a_score+team_b_score) points_win_rate, team_a_score-team_b_score point_difference from matches union all
 select gender, date, seq, 'b', team_b, sets_b::double/(sets_a+sets_b), team_b_score::double/(team_a_score+team_b_score), team_b_score-team_a_score from matches)"""
_RATES = ["sets_win_rate", "points_win_rate", "point_difference"]


@check("w18_point_rates", MATCHES, _POINTS,
       "select seq, side, team, " + ", ".join(f"round(avg({v}) {_rows(n)},6) {v}_last{n}" for v in _RATES for n in (5, 10)) + " from pl")
def w18(spark, sf):
    rolled = rolling_means(points_long(base_matches(spark, sf)), _RATES, (5, 10))
    return rolled.select("seq", "side", "team", *_rounded(rolled, [f"{v}_last{n}" for v in _RATES for n in (5, 10)]))


@check("w18_point_rates_in_pieces", MATCHES, _POINTS,
       "select seq, side, team, " + ", ".join(f"round(avg({v}) {_rows(n)},6) {v}_last{n}" for v in _RATES for n in (5, 10)) + " from pl")
def w18_pieces(spark, sf):
    """The same with teams cut into pieces of a hundred rows."""
    rolled = rolling_means(points_long(base_matches(spark, sf)), _RATES, (5, 10), budget=100)
    return rolled.select("seq", "side", "team", *_rounded(rolled, [f"{v}_last{n}" for v in _RATES for n in (5, 10)]))


@check("w19_schedule_strength", MATCHES, ELO,
       f"""select seq, side, team, round(avg(o) {_rows(5)},6) opponent_elo_last5, round(avg(o) {_rows(10)},6) opponent_elo_last10 from (
       select gender, date, seq, 'a' side, team_a team, elo_b_pre o from elo union all select gender, date, seq, 'b', team_b, elo_a_pre from elo)""",
       recursive=True)
def w19(spark, sf):
    m = base_matches(spark, sf)
    rated = schedule_strength(long_form(m), elo_history(m))
    return rated.select("seq", "side", "team", *_rounded(rated, ["opponent_elo_last5", "opponent_elo_last10"]))


@check("w20_schedule_density", MATCHES, LONG,
       f"""select seq, side, team, count(*) {_days(7)} matches_last_7d, count(*) {_days(14)} matches_last_14d,
       count(*) {_days(30)} matches_last_30d, (count(*) {_days(1)}) > 0 back_to_back from long""")
def w20(spark, sf):
    dense = schedule_density(long_form(base_matches(spark, sf)))
    return dense.select("seq", "side", "team", *[F.col(f"matches_last_{n}d").cast("bigint").alias(f"matches_last_{n}d") for n in (7, 14, 30)], "back_to_back")


_LAST_H2H = """select seq, round(case when team_a=lo then r3 else 1-r3 end,6) h2h_last_3, round(case when team_a=lo then r5 else 1-r5 end,6) h2h_last_5 from (
 select *, avg(w) over (p rows between 3 preceding and 1 preceding) r3, avg(w) over (p rows between 5 preceding and 1 preceding) r5 from (
  select *, least(team_a,team_b) lo, greatest(team_a,team_b) hi, cast((case when winner='team_a' then team_a else team_b end)=least(team_a,team_b) as int) w from matches)
 window p as (partition by gender, lo, hi order by date, seq))"""


@check("w21_h2h_last_n", MATCHES, _LAST_H2H)
def w21(spark, sf):
    last = h2h_last(base_matches(spark, sf))
    return last.select("seq", *_rounded(last, ["h2h_last_3", "h2h_last_5"]))


@check("w21_h2h_last_n_in_pieces", MATCHES, _LAST_H2H)
def w21_pieces(spark, sf):
    """The same with pairs cut into pieces of ten rows."""
    last = h2h_last(base_matches(spark, sf), budget=10)
    return last.select("seq", *_rounded(last, ["h2h_last_3", "h2h_last_5"]))


@check("m15_stage_flags", MATCHES,
       """select seq, stage in ('quarterfinal','semifinal','bronze','final') is_knockout, stage='quarterfinal' is_quarterfinal,
       stage='semifinal' is_semifinal, stage='bronze' is_bronze, stage='final' is_final from matches""")
def m15(spark, sf):
    return add_stage_flags(base_matches(spark, sf)).select("seq", "is_knockout", "is_quarterfinal", "is_semifinal", "is_bronze", "is_final")


@check("w22_year_folds", MATCHES,
       """select seq, case when y-f-1>=0 then (y-f-1)::int end test_fold from (
       select seq, year(date) y, min(year(date)) over (partition by gender) f from matches)""")
def w22(spark, sf):
    return year_folds(base_matches(spark, sf)).select("seq", "test_fold")


def _variant(k: str, before: str) -> str:
    """The Elo recursion with another factor or another rating before the match (of ra, rb, la, lb: rating and days since)."""
    return f"""em as (select *, row_number() over (partition by gender order by date,seq) rn from matches),
er as (select gender, 0::bigint rn, null::bigint seq, map([]::varchar[],[]::double[]) st, map([]::varchar[],[]::date[]) dt, null::double na, null::double nb
  from (select distinct gender from em)
 union all select gender, rn, seq, map_concat(st, map([team_a,team_b],[ra+k*(y-e), rb-k*(y-e)])), map_concat(dt, map([team_a,team_b],[date,date])),
  ra+k*(y-e), rb-k*(y-e) from (
  select *, 1/(1+pow(10,(rb-ra)/400)) e, case when winner='team_a' then 1.0::double else 0.0::double end y, {k} k from (
   select em.*, st, dt, {before.format(t='team_a')} ra, {before.format(t='team_b')} rb
   from er join em on em.gender=er.gender and em.rn=er.rn+1))),
ev as (select seq, round(na,5) elo_a_post, round(nb,5) elo_b_post from er where rn>0)"""


_PLAIN = "coalesce(st[em.{t}],1500.0)::double"
_DECAYED = ("(case when st[em.{t}] is null then 1500.0::double else 1500.0::double+(st[em.{t}]-1500.0::double)"
            "*pow(0.5::double, date_diff('day', dt[em.{t}], em.date)/730.0::double) end)")


def _elo(spark, sf, config):
    history = elo_history(base_matches(spark, sf), config)
    return history.select("seq", *[F.round(c, 5).alias(c) for c in ("elo_a_post", "elo_b_post")])


@check("w23_elo_margin", MATCHES, _variant("(32.0*(1+0.25*(abs(sets_a-sets_b)-1)))::double", _PLAIN), "select * from ev", recursive=True)
def w23(spark, sf):
    return _elo(spark, sf, BY_MARGIN)


@check("w24_elo_decay", MATCHES, _variant("32.0::double", _DECAYED), "select * from ev", recursive=True)
def w24(spark, sf):
    return _elo(spark, sf, DECAYING)


@check("w25_elo_recent", MATCHES, _variant("64.0::double", _PLAIN), "select * from ev", recursive=True)
def w25(spark, sf):
    return _elo(spark, sf, RECENT)


@check("a16_ece", MATCHES, ELO, ELO_FOLDS, _PREDS,
       """select gender, fold, sum(n)::bigint n, round(sum(n*abs(pm-ar))/sum(n),6) ece, round(max(abs(pm-ar)),6) mce from (
       select gender, fold, greatest(ceil(p*10)::int,1) b, avg(p) pm, avg(y) ar, count(*) n from preds group by all) group by gender, fold""", recursive=True)
def a16(spark, sf):
    done = expected_calibration_error(_predictions(spark, sf), ["gender", "fold"])
    return done.select("gender", "fold", "n", F.round("ece", 6).alias("ece"), F.round("mce", 6).alias("mce"))


@check("a17_auc", MATCHES, ELO, ELO_FOLDS, _PREDS,
       """select gender, fold, count(*) n, round((sum(r) filter (y=1) - c1*(c1+1)/2.0::double)/(c1*c0),6) auc from (
       select *, rank() over (partition by gender, fold order by p) + (count(*) over (partition by gender, fold, p)-1)/2.0::double r,
        count(*) filter (y=1) over (partition by gender, fold) c1, count(*) filter (y=0) over (partition by gender, fold) c0 from preds) group by gender, fold, c1, c0""",
       recursive=True)
def a17(spark, sf):
    return roc_auc(_predictions(spark, sf), ["gender", "fold"]).select("gender", "fold", "n", F.round("auc", 6).alias("auc"))
