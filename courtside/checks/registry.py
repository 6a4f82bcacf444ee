"""Collects the registered queries and the SQL they are compared with."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# The sample matches, in SQL (see courtside.plans.sample for the DataFrame form).
MATCHES = """b as (
 select o_orderkey seq, o_custkey ck, cast(o_orderdate as date) date, c_nationkey ka,
  (c_nationkey + 1 + (o_orderkey*7 + o_custkey) % 24) % 25 kb, o_orderpriority pr
 from orders join customer on o_custkey=c_custkey),
g as (select *, case when seq%2=0 then 'men' else 'women' end gender,
  (ka-kb) + ((seq*37)%21-10) > 0 as a_won, cast((seq*11+ck)%3 as int) ls,
  case pr when '1-URGENT' then 'OG' when '2-HIGH' then 'WCH' when '3-MEDIUM' then 'WC'
   when '4-NOT SPECIFIED' then 'VNL' else 'EURO' end cp from b),
m0 as (select 'o:'||seq match_id, seq, date, gender, na.n_name team_a, nb.n_name team_b,
 case when a_won then 3 else ls end sets_a, case when a_won then ls else 3 end sets_b,
 case when a_won then 'team_a' else 'team_b' end winner, cp||'_'||upper(gender) competition_id
 from g join nation na on na.n_nationkey=ka join nation nb on nb.n_nationkey=kb),
matches as (select *, competition_id||'-'||cast(year(date) as varchar) tournament_no,
 cast(row_number() over (partition by competition_id||'-'||cast(year(date) as varchar) order by date, seq) as bigint) no_in_tournament,
 case seq%7 when 0 then 'pool' when 1 then 'preliminary' when 2 then 'quarterfinal' when 3 then 'semifinal'
  when 4 then 'bronze' when 5 then 'final' else 'other' end stage,
 sets_a*25+sets_b*(15+seq%9) team_a_score, sets_b*25+sets_a*(15+seq%9) team_b_score from m0)"""

COMPETITIONS = """competitions as (select p||'_'||upper(gd) competition_id, p||'_'||upper(gd) name, gd gender, lv as level
 from (values ('OG','olympic_games'),('WCH','world_championship'),('WC','world_cup'),
  ('VNL','nations_league'),('EURO','continental')) c(p, lv), (values ('men'),('women')) x(gd))"""

LONG = """long as (
 select gender, date, seq, 'a' side, team_a team, team_b opponent, cast(winner='team_a' as int) won, sets_a sf, sets_b sa from matches
 union all
 select gender, date, seq, 'b', team_b, team_a, cast(winner='team_b' as int), sets_b, sets_a from matches)"""

FORM = """f0 as (select *, row_number() over w rn, lag(won) over w pw, lag(date) over w pd,
  avg(won) over (w rows between 5 preceding and 1 preceding) wr5, avg(won) over (w rows between 10 preceding and 1 preceding) wr10,
  avg(sf-sa) over (w rows between 5 preceding and 1 preceding) sm5, avg(sf-sa) over (w rows between 10 preceding and 1 preceding) sm10
  from long window w as (partition by gender, team order by date, seq)),
form as (select *, rn-1 played, date_diff('day', pd, date) rest,
  case when pw is null then 0
   when pw=1 then rn-1-coalesce(max(case when won=0 then rn end) over p, 0)
   else coalesce(max(case when won=1 then rn end) over p, 0)-(rn-1) end streak
  from f0 window p as (partition by gender, team order by date, seq rows between unbounded preceding and 1 preceding))"""

H2H = """h0 as (select gender, date, seq, team_a, team_b, least(team_a,team_b) lo, greatest(team_a,team_b) hi,
  case when winner='team_a' then team_a else team_b end wt from matches),
h2h as (select *, count(*) over p met, coalesce(sum(cast(wt=lo as int)) over p, 0) lo_wins
  from h0 window p as (partition by gender, lo, hi order by date, seq rows between unbounded preceding and 1 preceding)),
h2hr as (select *, case when met>0 then cast(case when team_a=lo then lo_wins else met-lo_wins end as double)/met end rate from h2h)"""

ELO = """em as (select *, row_number() over (partition by gender order by date,seq) rn from matches),
er as (select gender, 0::bigint rn, null::bigint seq, map([]::varchar[],[]::double[]) st, null::double pa, null::double pb,
   null::double e, null::double na, null::double nb from (select distinct gender from em)
 union all select gender, rn, seq, map_concat(st, map([team_a,team_b],[ra+32*(y-e), rb-32*(y-e)])), ra, rb, e,
   ra+32*(y-e), rb-32*(y-e) from (
  select *, 1/(1+pow(10,(rb-ra)/400)) e, case when winner='team_a' then 1.0::double else 0.0::double end y from (
   select em.*, er.st, coalesce(er.st[em.team_a],1500.0)::double ra, coalesce(er.st[em.team_b],1500.0)::double rb
   from er join em on em.gender=er.gender and em.rn=er.rn+1))),
elo as (select em.*, er.pa elo_a_pre, er.pb elo_b_pre, er.e elo_pred_a, er.na elo_a_post, er.nb elo_b_post
  from er join em on em.gender=er.gender and em.rn=er.rn)"""


def sql(*parts: str, recursive: bool = False) -> str:
    """Common table expressions followed by the final select."""
    *ctes, final = parts
    return f"with {'recursive ' if recursive else ''}{', '.join(ctes)} {final}"


def check(name: str, *parts: str, recursive: bool = False):
    """Register a query; the remaining arguments are its SQL counterpart, if it has one."""
    def register(fn):
        QUERIES[name] = fn
        if parts:
            ORACLES[name] = sql(*parts, recursive=recursive)
        return fn
    return register
