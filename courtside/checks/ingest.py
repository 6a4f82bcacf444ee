"""Columns over raw text, name resolution and the quality gate (P, V, J, A1-A3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtside.checks.registry import COMPETITIONS, MATCHES, check
from courtside.functions.dates import local_date, parse_date, plausible, date_part
from courtside.functions.text import (
    canonical_competition, gender_of, in_scope, name_candidates, name_key, stage_of,
)
from courtside.operators.cleaning import (
    clean, cleaning_report, competition_faults, competition_lookup, first_per_meeting, first_per_source_id, judge,
)
from courtside.operators.context import with_level
from courtside.operators.names import (
    auto_resolved_names, by_alias, by_country, by_near_miss, distinct_names, resolve_names, unresolved_names,
)
from courtside.plans.sample import aliases, base_matches, competitions, raw_rows, table
from courtside.session import cut

RAW = """raw0 as (select * from (
 select seq*10 rid, seq s, match_id sid, team_a ta, team_b tb, sets_a sa, sets_b sb, cast(date as varchar) d, gender g, competition_id c from matches
 union all select seq*10+1, seq, match_id, team_a, team_b, sets_a, sets_b, cast(date as varchar), gender, competition_id from matches where seq%50=7
 union all select seq*10+2, seq, 'x'||match_id, team_b, team_a, sets_b, sets_a, cast(date as varchar), gender, competition_id from matches where seq%50=9) u),
raw as (select rid, 'feed' source, sid source_match_id,
 case when s%67=0 then 'n/a' when s%61=0 then cast(cast(substr(d,1,4) as int)+543 as varchar)||substr(d,5)
  when s%4=1 then substr(d,9,2)||'/'||substr(d,6,2)||'/'||substr(d,1,4) when s%4=3 then replace(d,'-','/') else d end date_str,
 case when s%101=0 then 'mixed' when s%5=0 then ' '||upper(g)||' ' else g end gender,
 case when s%103=0 then 'Local Cup' else case when s%2=0 then lower(c) else c end end competition_name,
 case s%6 when 0 then 'Pool' when 1 then 'QF' when 2 then ' Semi-Final ' when 3 then 'Gold Medal Match' when 4 then 'odd' end stage_str,
 case when s%97=0 then 'Atlantis' when s%3=0 then '  '||lower(replace(ta,'_',' '))||' ' when s%3=1 then ta else replace(ta,'_','  ') end team_a_name,
 case when s%83=0 then 'Nowhere' when s%3=1 then lower(replace(tb,'_',' ')) else tb end team_b_name,
 case when s%10=0 then null else sa*25+sb*(15+s%9) end team_a_score,
 case when s%10=0 then null else sb*25+sa*(15+s%9) end team_b_score,
 case when s%89=0 then sb else sa end sets_a, sb sets_b from raw0)"""

_KEY = "trim(regexp_replace(lower(trim(strip_accents({0}))), '\\s+', ' ', 'g'))"
_DATE = "cast(try_strptime(trim({0}), ['%Y-%m-%d','%d/%m/%Y','%m/%d/%Y','%Y/%m/%d']) as date)"

ALIASES = """al as (select 'N'||n_nationkey id, unnest([lower(n_name), lower(replace(n_name,'_',' ')), 'n'||n_nationkey]) k
 from nation), ald as (select k, any_value(id) id from al group by k)"""

JUDGED = f"""a1 as (select * from raw qualify row_number() over (partition by source, source_match_id order by rid)=1),
j0 as (select a1.*, xa.id team_a, xb.id team_b, lower(trim(a1.gender)) gd, {_DATE.format('date_str')} dt, co.competition_id,
  case lower(trim(stage_str)) when 'pool' then 'pool' when 'qf' then 'quarterfinal' when 'semi-final' then 'semifinal'
   when 'gold medal match' then 'final' else 'other' end stg
  from a1 left join ald xa on xa.k={_KEY.format('team_a_name')} left join ald xb on xb.k={_KEY.format('team_b_name')}
  left join competitions co on lower(co.name)={_KEY.format('competition_name')} and co.gender=lower(trim(a1.gender))),
judged as (select *, case when gd not in ('men','women') then 'unknown gender' when team_a is null then 'unknown team_a'
  when team_b is null then 'unknown team_b' when competition_id is null then 'unknown competition'
  when dt is null then 'unknown date format' when dt not between date '1990-01-01' and date '2030-12-31' then 'date out of range'
  when team_a=team_b then 'same team'
  when not ((sets_a=3 and sets_b<=2) or (sets_b=3 and sets_a<=2)) then 'not a best-of-five result' end reason from j0),
kept as (select * from judged where reason is null
  qualify row_number() over (partition by gd, dt, least(team_a,team_b), greatest(team_a,team_b) order by rid)=1)"""


def _clean(spark, sf):
    raw = cut(raw_rows(spark, sf))
    return raw, clean(raw, aliases(spark, sf), competitions(spark))


def _tournament_names():
    """Tournament names built from a match: competition wording, noise words and gender wording."""
    return F.expr(
        "concat(CASE seq % 13 WHEN 0 THEN 'Volleyball Nations League' WHEN 1 THEN 'World Championship' "
        "WHEN 2 THEN 'Olympic Games' WHEN 3 THEN 'World Cup' WHEN 4 THEN 'CEV EuroVolley' "
        "WHEN 5 THEN 'European Open Championship' WHEN 6 THEN 'NORCECA Championship' "
        "WHEN 7 THEN 'South American Championship' WHEN 8 THEN 'Asian Mens Championship' "
        "WHEN 9 THEN 'African Championship' WHEN 10 THEN 'World Grand Champions Cup' "
        "WHEN 11 THEN 'Central Asian Championship' ELSE 'Tournament of ' || team_a END, "
        "CASE seq % 11 WHEN 0 THEN ' U21' WHEN 1 THEN ' Club' ELSE '' END, ' ', year(date), "
        "CASE seq % 3 WHEN 0 THEN ' - Women''s' WHEN 1 THEN ' Men' ELSE '' END)")


_NAMES = """tn as (select seq, concat(case seq%13 when 0 then 'Volleyball Nations League' when 1 then 'World Championship'
 when 2 then 'Olympic Games' when 3 then 'World Cup' when 4 then 'CEV EuroVolley' when 5 then 'European Open Championship'
 when 6 then 'NORCECA Championship' when 7 then 'South American Championship' when 8 then 'Asian Mens Championship'
 when 9 then 'African Championship' when 10 then 'World Grand Champions Cup' when 11 then 'Central Asian Championship'
 else 'Tournament of '||team_a end, case seq%11 when 0 then ' U21' when 1 then ' Club' else '' end, ' ', year(date),
 case seq%3 when 0 then ' - Women''s' when 1 then ' Men' else '' end) nm,
 case seq%5 when 0 then 'W' when 1 then ' Male ' when 2 then '1' when 3 then '?' end gfield from matches)"""
_CANON = """case when regexp_matches(l,'\\bnations\\b') and regexp_matches(l,'\\bleague\\b') then 'Volleyball Nations League'
 when regexp_matches(l,'\\bworld\\b') and regexp_matches(l,'\\bchampionship\\b') then 'World Championship'
 when regexp_matches(l,'\\bolympic\\b') then 'Olympic Games'
 when regexp_matches(l,'\\bworld\\b') and regexp_matches(l,'\\bcup\\b') then 'World Cup'
 when regexp_matches(l,'\\beurovolley\\b') then 'EuroVolley'
 when regexp_matches(l,'\\beuropean\\b') and regexp_matches(l,'\\bchampionship\\b') then 'EuroVolley'
 when regexp_matches(l,'\\bnorceca\\b') then 'NORCECA Championship'
 when regexp_matches(l,'\\bsouth\\b') and regexp_matches(l,'\\bamerican\\b') and regexp_matches(l,'\\bchampionship\\b') then 'South American Championship'
 when regexp_matches(l,'\\basian\\b') and regexp_matches(l,'\\bchampionship\\b') then 'Asian Championship'
 when regexp_matches(l,'\\bafrican\\b') and regexp_matches(l,'\\bchampionship\\b') then 'African Championship' end"""
_GENDER = """case when lower(trim(gfield)) in ('men','man','male','m','0') then 'men'
 when lower(trim(gfield)) in ('women','woman','female','w','1') then 'women'
 when regexp_matches(nm,'(?i)\\bwomen''?s?\\b') then 'women' when regexp_matches(nm,'(?i)\\bmen''?s?\\b') then 'men' end"""


def _named(spark, sf):
    return base_matches(spark, sf).select(
        "seq", _tournament_names().alias("nm"),
        F.expr("CASE seq % 5 WHEN 0 THEN 'W' WHEN 1 THEN ' Male ' WHEN 2 THEN '1' WHEN 3 THEN '?' END").alias("gfield"))


@check("p1_name_key", MATCHES, RAW,
       f"select name, {_KEY.format('name')} name_key from (select team_a_name as name from raw union select team_b_name from raw)")
def p1(spark, sf):
    names = distinct_names(raw_rows(spark, sf)).select("name").distinct()
    return names.withColumn("name_key", name_key(F.col("name")))


@check("p2_parse_date", MATCHES, RAW, f"select rid seq, date_str, {_DATE.format('date_str')} as parsed from raw")
def p2(spark, sf):
    return raw_rows(spark, sf).select("seq", "date_str", parse_date(F.col("date_str")).alias("parsed"))


@check("p3_plausible_date", MATCHES, RAW,
       f"""select rid seq, coalesce({_DATE.format('date_str')} between date '1990-01-01' and date '2030-12-31', false) plausible
       from raw""")
def p3(spark, sf):
    ok = F.coalesce(plausible(parse_date(F.col("date_str"))), F.lit(False))
    return raw_rows(spark, sf).select("seq", ok.alias("plausible"))


_STAMPS = """st as (select rid, case when date_str like '____-__-__' then '  '||date_str||'T18:00:00' else date_str||' 18:00' end stamp from raw)"""


def _stamps(spark, sf):
    return raw_rows(spark, sf).selectExpr(
        "seq", "CASE WHEN date_str LIKE '____-__-__' THEN concat('  ', date_str, 'T18:00:00') "
               "ELSE concat(date_str, ' 18:00') END AS stamp")


@check("p4_date_part", MATCHES, RAW, _STAMPS,
       """select rid seq, case when substr(trim(stamp),1,10) like '____-__-__' then substr(trim(stamp),1,10) end as day from st""")
def p4(spark, sf):
    return _stamps(spark, sf).select("seq", date_part(F.col("stamp")).alias("day"))


@check("p5_era_repair", MATCHES, RAW, _STAMPS,
       """select rid seq, case when y>2100 and y-543 between 1990 and 2100 then lpad(cast(y-543 as varchar),4,'0')||substr(d,5) else d end as day
       from (select rid, d, try_cast(substr(d,1,4) as int) y from (select rid, case when substr(trim(stamp),1,10) like '____-__-__'
        then substr(trim(stamp),1,10) end d from st))""")
def p5(spark, sf):
    return _stamps(spark, sf).select("seq", local_date(F.col("stamp")).alias("day"))


@check("p6_stage", MATCHES, RAW,
       """select rid seq, case lower(trim(stage_str)) when 'pool' then 'pool' when 'qf' then 'quarterfinal'
       when 'semi-final' then 'semifinal' when 'gold medal match' then 'final' else 'other' end stage from raw""")
def p6(spark, sf):
    return raw_rows(spark, sf).select("seq", stage_of(F.col("stage_str")).alias("stage"))


@check("p7_gender", MATCHES, _NAMES, f"select seq, {_GENDER} gender from tn")
def p7(spark, sf):
    return _named(spark, sf).select("seq", gender_of(F.col("gfield"), F.col("nm")).alias("gender"))


@check("p8_competition", MATCHES, _NAMES, f"select seq, {_CANON} competition from (select seq, lower(nm) l from tn)")
def p8(spark, sf):
    return _named(spark, sf).select("seq", canonical_competition(F.col("nm")).alias("competition"))


@check("p9_scope", MATCHES, _NAMES,
       f"""select seq, nm as name from (select seq, nm, lower(nm) l from tn) where ({_CANON}) is not null
       and not regexp_matches(l, 'club|u23|u21|u20|u19|u18|u17|u16|u15|u14|youth|junior|beach|military|cism|grand champions cup|zonal|central asian')""")
def p9(spark, sf):
    return _named(spark, sf).filter(in_scope(F.col("nm"))).select("seq", F.col("nm").alias("name"))


@check("p14_name_candidates", MATCHES,
       """select seq, unnest(range(len(c)))::int as rank, unnest(c) candidate from (
        select seq, list_concat([n], case when b not in (n,'') then [b] else [] end,
         case when d not in (n,b,'') then [d] else [] end, case when bd not in (n,b,d,'') then [bd] else [] end) c from (
         select *, trim(replace(b,'.','')) bd from (
          select seq, n, trim(regexp_replace(n,'\\s*\\([^)]*\\)\\s*$','')) b, trim(replace(n,'.','')) d from (
           select seq, case seq%4 when 0 then team_a||' (RED)' when 1 then replace(team_a,'_','.')
            when 2 then replace(team_a,'_','.')||'. (B)' else team_a end n from matches))))""")
def p14(spark, sf):
    name = F.expr("CASE seq % 4 WHEN 0 THEN concat(team_a, ' (RED)') WHEN 1 THEN replace(team_a, '_', '.') "
                  "WHEN 2 THEN concat(replace(team_a, '_', '.'), '. (B)') ELSE team_a END")
    return base_matches(spark, sf).select("seq", F.posexplode(name_candidates(name)).alias("rank", "candidate"))


@check("p15_winner_and_id", MATCHES, RAW, ALIASES, COMPETITIONS, JUDGED,
       """select source||':'||source_match_id match_id, case when sets_a>sets_b then 'team_a' else 'team_b' end winner from judged""")
def p15(spark, sf):
    return _clean(spark, sf)[1].judged.select("match_id", "winner")


@check("p16_defaults", MATCHES, RAW, ALIASES, COMPETITIONS, JUDGED,
       """select rid seq, cast(coalesce(team_a_score,0) as int) team_a_score, cast(coalesce(team_b_score,0) as int) team_b_score,
       true neutral from kept""")
def p16(spark, sf):
    return _clean(spark, sf)[1].matches.select("seq", "team_a_score", "team_b_score", "neutral")


@check("p17_point_difference", MATCHES,
       "select seq, cast(team_a_score-team_b_score as bigint) point_diff from matches")
def p17(spark, sf):
    return base_matches(spark, sf).select("seq", (F.col("team_a_score") - F.col("team_b_score")).alias("point_diff"))


@check("v1_rejected_with_reason", MATCHES, RAW, ALIASES, COMPETITIONS, JUDGED,
       "select source, source_match_id, reason from judged where reason is not null")
def v1(spark, sf):
    return _clean(spark, sf)[1].rejected


@check("v2_match_rules", MATCHES,
       """select seq, case when (seq%17=0 and team_a_score-200<0) then 'negative score' when seq%19=0 then 'sets out of range'
       when seq%23=0 then 'same team' when seq%29=0 then 'not a best-of-five result' end reason from matches""")
def v2(spark, sf):
    from courtside.operators.cleaning import match_faults
    bent = base_matches(spark, sf).selectExpr(
        "seq", "CASE WHEN seq % 17 = 0 THEN team_a_score - 200 ELSE team_a_score END AS score_a", "team_b_score AS score_b",
        "CASE WHEN seq % 19 = 0 THEN 4 ELSE sets_a END AS sets_a",
        "CASE WHEN seq % 29 = 0 THEN sets_a ELSE sets_b END AS sets_b",
        "team_a", "CASE WHEN seq % 23 = 0 THEN team_a ELSE team_b END AS team_b")
    cols = [F.col(c) for c in ("sets_a", "sets_b", "score_a", "score_b", "team_a", "team_b")]
    return bent.select("seq", match_faults(*cols).alias("reason"))


@check("v3_competition_rules", MATCHES,
       """select distinct competition_id, case when seq%2=1 then 'club competition' when gender='women' then 'unknown gender' end reason from (
       select competition_id, gender, case when competition_id like 'WC%' then 1 else 0 end seq from matches)
       where seq=1 or gender='women'""")
def v3(spark, sf):
    rows = base_matches(spark, sf).selectExpr(
        "competition_id", "competition_id AS name", "competition_id LIKE 'WC%' AS is_club_competition",
        "CASE WHEN gender = 'women' AND NOT competition_id LIKE 'WC%' THEN 'x' ELSE gender END AS gender").distinct()
    return competition_faults(rows).select("competition_id", "reason")


@check("v5_cleaning_report", MATCHES, RAW, ALIASES, COMPETITIONS, JUDGED,
       """select 'raw' status, null::varchar reason, count(*) n from raw union all
       select 'valid', null, count(*) from kept union all
       select 'rejected', reason, count(*) from judged where reason is not null group by reason union all
       select 'duplicate', null, (select count(*) from raw)-(select count(*) from kept)-(select count(*) from judged where reason is not null)""")
def v5(spark, sf):
    return cleaning_report(*_clean(spark, sf))


@check("v6_unresolved_names", MATCHES, RAW, ALIASES, COMPETITIONS, JUDGED,
       """select distinct source, name from (select source, team_a_name as name, team_a id from judged union all
       select source, team_b_name, team_b from judged) where id is null""")
def v6(spark, sf):
    return unresolved_names(_clean(spark, sf)[1].resolved)


@check("j1_alias_lookup", MATCHES, RAW, ALIASES,
       f"""select distinct source, name, id team_id from (select source, team_a_name as name from raw union select source, team_b_name from raw)
       left join ald on k={_KEY.format('name')}""")
def j1(spark, sf):
    return by_alias(distinct_names(raw_rows(spark, sf)), aliases(spark, sf))


def _spelled(spark, sf):
    """Names as loosely written country names: brackets, dots, codes, overridden names."""
    name = F.expr("CASE seq % 5 WHEN 0 THEN concat(team_a, ' (RED)') WHEN 1 THEN lower(team_a) "
                  "WHEN 2 THEN concat('n.', substr(team_a, 8)) WHEN 3 THEN concat('Old ', team_a) ELSE team_a END")
    return base_matches(spark, sf).select(F.lit("feed").alias("source"), name.alias("name")).distinct()


_SPELLED = """sp as (select distinct 'feed' source, case seq%5 when 0 then team_a||' (RED)' when 1 then lower(team_a)
 when 2 then 'n.'||substr(team_a,8) when 3 then 'Old '||team_a else team_a end as name from matches)"""


def _countries(spark, sf):
    return table(spark, sf, "nation").select(
        F.col("n_name").alias("country"), F.concat(F.lit("N"), F.col("n_nationkey")).alias("code"))


def _overrides(spark, sf):
    return table(spark, sf, "nation").filter("n_nationkey % 2 = 0").select(
        F.lower(F.concat(F.lit("old "), F.col("n_name"))).alias("key"),
        F.concat(F.lit("X"), F.col("n_nationkey")).alias("code"))


@check("j2_country_cascade", MATCHES, _SPELLED,
       """select source, sp.name, coalesce(min(o.code), min(c.code)) team_id from sp
       left join (select 'old '||lower(n_name) k, 'X'||n_nationkey code from nation where n_nationkey%2=0) o on o.k=lower(sp.name)
       left join (select lower(n_name) k, 'N'||n_nationkey code from nation union all select 'n'||n_nationkey, 'N'||n_nationkey from nation) c
        on c.k in (lower(sp.name), lower(trim(regexp_replace(sp.name,'\\s*\\([^)]*\\)\\s*$',''))), lower(replace(sp.name,'.','')))
       group by source, sp.name having coalesce(min(o.code), min(c.code)) is not null""")
def j2(spark, sf):
    return by_country(_spelled(spark, sf), _overrides(spark, sf), _countries(spark, sf))


@check("j3_near_miss", MATCHES,
       """select source, name, min(row(d, code)).code team_id, cast(min(row(d, code)).d as int) distance from (
        select source, name, levenshtein(lower(name), lower(n_name)) d, 'N'||n_nationkey code from (
         select distinct 'feed' source, case seq%4 when 0 then substr(team_a,2) when 1 then replace(team_a,'TIO','TOI')
          when 2 then team_a||'xx' else 'Far '||team_a end as name from matches), nation)
       where d<=2 group by source, name""".replace("row(d, code)", "{'d': d, 'code': code}"))
def j3(spark, sf):
    name = F.expr("CASE seq % 4 WHEN 0 THEN substr(team_a, 2) WHEN 1 THEN replace(team_a, 'TIO', 'TOI') "
                  "WHEN 2 THEN concat(team_a, 'xx') ELSE concat('Far ', team_a) END")
    names = base_matches(spark, sf).select(F.lit("feed").alias("source"), name.alias("name")).distinct()
    return by_near_miss(names, _countries(spark, sf))


@check("v6_auto_resolved_names", MATCHES, _SPELLED,
       """select source, name, coalesce(min(o.code), min(c.code)) team_id from sp
       left join (select 'old '||lower(n_name) k, 'X'||n_nationkey code from nation where n_nationkey%2=0) o on o.k=lower(sp.name)
       left join (select lower(n_name) k, 'N'||n_nationkey code from nation union all select 'n'||n_nationkey, 'N'||n_nationkey from nation) c
        on c.k in (lower(sp.name), lower(trim(regexp_replace(sp.name,'\\s*\\([^)]*\\)\\s*$',''))), lower(replace(sp.name,'.','')))
       where lower(sp.name) not in (select lower(n_name) from nation)
       group by source, sp.name having coalesce(min(o.code), min(c.code)) is not null""")
def v6_auto(spark, sf):
    resolved = resolve_names(_spelled(spark, sf), aliases(spark, sf), _overrides(spark, sf), _countries(spark, sf))
    return auto_resolved_names(resolved)


@check("j4_competition_by_name", MATCHES, RAW, COMPETITIONS,
       f"""select rid seq, competition_id from raw left join competitions co
       on lower(co.name)={_KEY.format('competition_name')} and co.gender=lower(trim(raw.gender))""")
def j4(spark, sf):
    rows = raw_rows(spark, sf).withColumn("gender", F.lower(F.trim("gender")))
    return competition_lookup(rows, competitions(spark)).select("seq", "competition_id")


@check("j5_competition_level", MATCHES, COMPETITIONS,
       "select seq, competition_id, c.level as level from matches left join competitions c using (competition_id)")
def j5(spark, sf):
    return with_level(base_matches(spark, sf), competitions(spark)).select("seq", "competition_id", "level")


@check("a1_first_per_source_id", MATCHES, RAW,
       "select rid seq, source_match_id from raw qualify row_number() over (partition by source, source_match_id order by rid)=1")
def a1(spark, sf):
    return first_per_source_id(raw_rows(spark, sf)).select("seq", "source_match_id")


@check("a2_first_per_meeting", MATCHES,
       """select seq, match_id from matches qualify row_number() over
       (partition by gender, date, least(team_a,team_b), greatest(team_a,team_b) order by seq)=1""")
def a2(spark, sf):
    return first_per_meeting(base_matches(spark, sf)).select("seq", "match_id")


@check("a3_duplicates_skipped", MATCHES, RAW, ALIASES, COMPETITIONS, JUDGED,
       """select (select count(*) from raw)-(select count(*) from a1) source_copies,
       (select count(*) from judged where reason is null)-(select count(*) from kept) meeting_copies""")
def a3(spark, sf):
    raw, done = _clean(spark, sf)
    source = first_per_source_id(raw).agg(F.count("*").alias("n")).unionAll(
        raw.agg(-F.count("*"))).agg((-F.sum("n")).alias("source_copies"))
    meeting = done.matches.agg(F.count("*").alias("n")).unionAll(
        done.judged.filter("reason IS NULL").agg(-F.count("*"))).agg((-F.sum("n")).alias("meeting_copies"))
    stacked = source.select("source_copies", F.lit(None).cast("bigint").alias("meeting_copies")).unionByName(
        meeting.select(F.lit(None).cast("bigint").alias("source_copies"), "meeting_copies"))
    return stacked.agg(F.max("source_copies").alias("source_copies"), F.max("meeting_copies").alias("meeting_copies"))


@check("s5_clean_matches", MATCHES, RAW, ALIASES, COMPETITIONS, JUDGED,
       """select source||':'||source_match_id match_id, dt as date, gd gender, competition_id, stg stage, team_a, team_b,
       sets_a, sets_b, case when sets_a>sets_b then 'team_a' else 'team_b' end winner, source, source_match_id from kept""")
def s5(spark, sf):
    return _clean(spark, sf)[1].matches.select(
        "match_id", "date", "gender", "competition_id", "stage", "team_a", "team_b", "sets_a", "sets_b", "winner",
        "source", "source_match_id")
