"""Point-in-time windows, ratings and the feature frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtside.checks.registry import COMPETITIONS, ELO, FORM, H2H, LONG, MATCHES, check
from courtside.operators.context import add_importance, add_tournament_progress, tournament_sizes
from courtside.operators.elo import elo_history, expected_score, final_ratings
from courtside.operators.form import form_by_match, long_form, team_form
from courtside.operators.h2h import head_to_head
from courtside.plans.features import FEATURE_COLUMNS, add_diffs
from courtside.plans.sample import base_matches, competitions, feature_frame, matches


def _form(spark, sf):
    return team_form(long_form(base_matches(spark, sf)))


@check("w1_matches_played", MATCHES, LONG, FORM,
       "select seq, side, team, cast(played as bigint) matches_played from form")
def w1(spark, sf):
    return _form(spark, sf).select("seq", "side", "team", "matches_played")


@check("w2_current_streak", MATCHES, LONG, FORM,
       "select seq, side, team, cast(streak as bigint) current_streak from form")
def w2(spark, sf):
    return _form(spark, sf).select("seq", "side", "team", "current_streak")


@check("w3_days_since_last", MATCHES, LONG, FORM,
       "select seq, side, team, cast(rest as bigint) days_since_last from form")
def w3(spark, sf):
    return _form(spark, sf).select("seq", "side", "team", "days_since_last")


@check("w4_win_rate_last_n", MATCHES, LONG, FORM,
       "select seq, side, team, wr5 win_rate_last5, wr10 win_rate_last10 from form")
def w4(spark, sf):
    return _form(spark, sf).select("seq", "side", "team", "win_rate_last5", "win_rate_last10")


@check("w5_set_margin_last_n", MATCHES, LONG, FORM,
       "select seq, side, team, sm5 set_margin_avg_last5, sm10 set_margin_avg_last10 from form")
def w5(spark, sf):
    return _form(spark, sf).select("seq", "side", "team", "set_margin_avg_last5", "set_margin_avg_last10")


@check("w6_h2h_matches_played", MATCHES, H2H,
       "select seq, cast(met as bigint) h2h_matches_played from h2hr")
def w6(spark, sf):
    return head_to_head(base_matches(spark, sf)).select("seq", "h2h_matches_played")


@check("w7_h2h_win_rate_a", MATCHES, H2H, "select seq, rate h2h_win_rate_a from h2hr")
def w7(spark, sf):
    return head_to_head(base_matches(spark, sf)).select("seq", "h2h_win_rate_a")


@check("w8_elo_history", MATCHES, ELO,
       """select seq, round(elo_a_pre,6) elo_a_pre, round(elo_b_pre,6) elo_b_pre, round(elo_pred_a,6) elo_pred_a,
       round(elo_a_post,6) elo_a_post, round(elo_b_post,6) elo_b_post from elo""", recursive=True)
def w8(spark, sf):
    history = elo_history(base_matches(spark, sf))
    return history.select("seq", *[F.round(c, 6).alias(c) for c in history.columns if c != "seq"])


@check("w8_elo_blocks", MATCHES, ELO,
       """select seq, round(elo_a_pre,6) elo_a_pre, round(elo_b_pre,6) elo_b_pre, round(elo_pred_a,6) elo_pred_a,
       round(elo_a_post,6) elo_a_post, round(elo_b_post,6) elo_b_post from elo""", recursive=True)
def w8_blocks(spark, sf):
    """The same replay in blocks of 1 000 rows."""
    history = elo_history(base_matches(spark, sf), block_rows=1000)
    return history.select("seq", *[F.round(c, 6).alias(c) for c in history.columns if c != "seq"])


@check("w9_final_ratings", MATCHES, ELO,
       """select gender, team, round(max_by(post, rn),6) elo from (
       select gender, rn, team_a team, elo_a_post post from elo union all select gender, rn, team_b, elo_b_post from elo)
       group by gender, team""", recursive=True)
def w9(spark, sf):
    m = base_matches(spark, sf)
    return final_ratings(m, elo_history(m)).select("gender", "team", F.round("elo", 6).alias("elo"))


@check("w10_tournament_progress", MATCHES,
       """select seq, tournament_no, cast(no_in_tournament as double)/max(no_in_tournament) over
       (partition by tournament_no) tournament_progress from matches""")
def w10(spark, sf):
    return add_tournament_progress(matches(spark, sf)).select("seq", "tournament_no", "tournament_progress")


@check("a4_tournament_max", MATCHES,
       "select tournament_no, max(no_in_tournament) tournament_max from matches group by tournament_no")
def a4(spark, sf):
    return tournament_sizes(matches(spark, sf))


_IMPORTANCE = """imp as (select m.*, case level when 'olympic_games' then 5.0 when 'world_championship' then 5.0
 when 'world_cup' then 4.0 when 'nations_league' then 3.0 when 'continental' then 2.0 else 1.0 end::double ci,
 case stage when 'final' then 4.0 when 'bronze' then 3.0 when 'semifinal' then 2.5 when 'quarterfinal' then 2.0
 when 'preliminary' then 1.5 else 1.0 end::double si
 from matches m left join competitions c using (competition_id))"""


@check("m1_competition_importance", MATCHES, COMPETITIONS, _IMPORTANCE,
       "select seq, ci competition_importance from imp")
def m1(spark, sf):
    return add_importance(base_matches(spark, sf), competitions(spark)).select("seq", "competition_importance")


@check("m2_stage_importance", MATCHES, COMPETITIONS, _IMPORTANCE, "select seq, si stage_importance from imp")
def m2(spark, sf):
    return add_importance(base_matches(spark, sf), competitions(spark)).select("seq", "stage_importance")


@check("m3_match_importance", MATCHES, COMPETITIONS, _IMPORTANCE, "select seq, ci*si match_importance from imp")
def m3(spark, sf):
    return add_importance(base_matches(spark, sf), competitions(spark)).select("seq", "match_importance")


@check("m4_elo_expectation", MATCHES,
       """select seq, round(1/(1+pow(10::double,((sets_b*25+sets_a)-(sets_a*25+sets_b))/400.0::double)),6) expected_a
       from matches""")
def m4(spark, sf):
    rating_a, rating_b = F.expr("sets_a * 25 + sets_b"), F.expr("sets_b * 25 + sets_a")
    return base_matches(spark, sf).select(
        "seq", F.round(expected_score(rating_a, rating_b), 6).alias("expected_a"))


_BOTH = """two as (select a.seq, a.played-b.played mp, a.streak-b.streak st, a.rest-b.rest dy, a.wr5-b.wr5 w5,
 a.wr10-b.wr10 w10, a.sm5-b.sm5 s5, a.sm10-b.sm10 s10 from form a join form b on a.seq=b.seq and a.side='a' and b.side='b')"""


@check("w15_diff_columns", MATCHES, LONG, FORM, _BOTH,
       """select seq, cast(mp as bigint) matches_played_diff, cast(st as bigint) current_streak_diff,
       cast(dy as bigint) days_since_last_diff, round(w5,6) win_rate_last5_diff, round(w10,6) win_rate_last10_diff,
       round(s5,6) set_margin_avg_last5_diff, round(s10,6) set_margin_avg_last10_diff from two""")
def w15(spark, sf):
    diffs = add_diffs(form_by_match(_form(spark, sf)))
    return diffs.select(
        "seq", "matches_played_diff", "current_streak_diff", "days_since_last_diff",
        *[F.round(f"{n}_last{w}_diff", 6).alias(f"{n}_last{w}_diff")
          for n in ("win_rate", "set_margin_avg") for w in (5, 10)])


# All model inputs, unrounded.
FRAME = (COMPETITIONS, LONG, FORM, H2H, ELO, _BOTH, _IMPORTANCE, """ff as (select elo.seq, elo.gender, elo.winner, elo.sets_a, elo.sets_b,
  elo_a_pre-elo_b_pre elo_diff, mp::double matches_played_diff, st::double current_streak_diff, dy::double days_since_last_diff,
  met::double h2h_matches_played, rate h2h_win_rate_a, ci competition_importance,
  cast(elo.no_in_tournament as double)/max(elo.no_in_tournament) over (partition by elo.tournament_no) tournament_progress,
  w5 win_rate_last5_diff, w10 win_rate_last10_diff, s5 set_margin_avg_last5_diff, s10 set_margin_avg_last10_diff
  from elo join two using (seq) join h2hr using (seq) join imp using (seq))""")


@check("w16_feature_frame", MATCHES, COMPETITIONS, LONG, FORM, H2H, ELO, _BOTH, _IMPORTANCE,
       """select elo.seq, elo.match_id, round(elo_a_pre-elo_b_pre,6) elo_diff, cast(mp as double) matches_played_diff,
       cast(st as double) current_streak_diff, cast(dy as double) days_since_last_diff,
       cast(met as double) h2h_matches_played, round(rate,6) h2h_win_rate_a, ci competition_importance,
       round(cast(elo.no_in_tournament as double)/max(elo.no_in_tournament) over (partition by elo.tournament_no),6) tournament_progress,
       round(w5,6) win_rate_last5_diff, round(w10,6) win_rate_last10_diff, round(s5,6) set_margin_avg_last5_diff,
       round(s10,6) set_margin_avg_last10_diff
       from elo join two using (seq) join h2hr using (seq) join imp using (seq)""", recursive=True)
def w16(spark, sf):
    features = feature_frame(spark, sf)
    return features.select("seq", "match_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in FEATURE_COLUMNS])
