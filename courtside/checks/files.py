"""Sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtside.checks.ingest import ALIASES, JUDGED, RAW, _clean
from courtside.checks.registry import COMPETITIONS, ELO, FORM, LONG, MATCHES, check
from courtside.checks.scoring import FIXTURES, FX, RATING, STATE, fixtures
from courtside.operators.cleaning import clean, valid_sets
from courtside.operators.elo import elo_history, final_ratings
from courtside.operators.evaluation import label, summarize
from courtside.operators.h2h import pair_days
from courtside.operators.names import alias_keys
from courtside.operators.state import team_state
from courtside.plans.predict import fixture_features
from courtside.plans.sample import aliases, base_matches, competitions, matches
from courtside.schemas import COMPETITION, MATCH, columns
from courtside.session import cut, scratch_path, small_table
from courtside.sources.csv_matches import read_csv_matches
from courtside.sources.files import read_aliases, read_competitions, read_table, write_matches, write_report
from courtside.sources.landing import accepted_sets, discarded, read_landing, set_rows, usable
from courtside.streaming.ingest import ingest_available, score_available, stored_matches

# Landed files built from the sample: header, then matches, with faults of every kind.
_LANDED = """ld as (select m.*, year(date) y, case when seq%59=0 then cast(year(date)+543 as varchar)||substr(cast(date as varchar),5)
   when seq%43=0 then 'n/a' else cast(date as varchar) end||'T18:00:00' stamp,
  case when seq%41=0 then '' else team_b end tb, case when seq%47=0 then 'x' else cast(sets_a as varchar) end pa,
  split_part(competition_id,'_',1) pre from matches m),
st as (select seq, n, case when n<=sets_a then case n when 5 then 15 else 25 end else 6+(seq+n)%8 end a,
   case when n<=sets_a then 6+(seq+n)%8 else case n when 5 then 15 else 25 end end b
  from matches, (select unnest([1,2,3,4,5]) n) where n<=sets_a+sets_b),
tot as (select seq, sum(a) ta, sum(b) tb_, sum(case when seq%53<>0 or n<>2 then a end) ta2, sum(case when seq%53<>0 or n<>2 then b end) tb2 from st group by seq),
tr as (select ld.seq, 'o'||ld.seq source_match_id, case when y%7=3 then null else gender end gender,
  case pre when 'OG' then 'Olympic Games' when 'WCH' then 'World Championship' when 'WC' then 'World Cup' when 'VNL' then 'Volleyball Nations League'
   else case when y%4=0 then null else 'EuroVolley' end end as competition_name, team_a, tb,
  case when seq%43=0 and seq%59<>0 then null else cast(date as varchar) end as day, try_cast(pa as int) sets_a, sets_b, tournament_no, no_in_tournament,
  case when seq%53=0 then ta2 else ta end ta, case when seq%53=0 then tb2 else tb_ end tbp, case when seq%3=0 then 'Hall '||seq%5 when seq%3=1 then 'City' end venue
  from ld join tot using (seq)),
trr as (select *, case when gender is null then 'unknown tournament gender' when competition_name is null then 'tournament outside the catalogue'
  when tb='' then 'missing team name' when day is null then 'missing or unreadable date' when sets_a is null then 'missing or non-numeric set count' end reason from tr)"""


PART_ROWS = 100_000


def _land(spark, sf):
    """Write the sample as landed JSON lines. A tournament has as many parts, by ranges of seq, as its matches need at some 100 000
    a part; their names sort in the order of seq."""
    path = scratch_path(spark, "landing")
    m = cut(matches(spark, sf))
    most = m.groupBy("tournament_no").agg(F.count("*").alias("n"), F.max("seq").alias("last")).agg(F.max("n").alias("n"), F.max("last").alias("last")).first()
    parts = max(1, -(-(most["n"] or 0) // PART_ROWS))
    points = {}
    for n in range(1, 6):
        won, lost = ("15" if n == 5 else "25"), f"CAST(6 + (seq + {n}) % 8 AS string)"
        played, a_wins = f"{n} <= sets_a + sets_b", f"{n} <= sets_a"
        bad = f"WHEN seq % 53 = 0 AND {n} = 2 AND {played} THEN 'abc'"
        points[f"PointsTeamASet{n}"] = F.expr(
            f"CASE {bad} WHEN NOT {played} THEN '0' WHEN {a_wins} THEN '{won}' ELSE {lost} END")
        points[f"PointsTeamBSet{n}"] = F.expr(f"CASE WHEN NOT {played} THEN '' WHEN {a_wins} THEN {lost} ELSE '{won}' END")
    part = F.lpad(F.expr(f"seq * {parts}L div {(most['last'] or 0) + 1}L").cast("string"), 9, "0").alias("part")
    body = m.select("tournament_no", part, (F.col("seq") + 1).alias("ord"), F.to_json(F.struct(
        F.lit("match").alias("_type"), F.concat(F.lit("o"), "seq").alias("No"),
        F.col("no_in_tournament").cast("string").alias("NoInTournament"),
        F.expr("concat(CASE WHEN seq % 59 = 0 THEN concat(year(date) + 543, substr(CAST(date AS string), 5)) "
               "WHEN seq % 43 = 0 THEN 'n/a' ELSE CAST(date AS string) END, 'T18:00:00')").alias("DateTimeLocal"),
        F.col("team_a").alias("TeamAName"), F.expr("CASE WHEN seq % 41 = 0 THEN '' ELSE team_b END").alias("TeamBName"),
        F.expr("CASE WHEN seq % 47 = 0 THEN 'x' ELSE CAST(sets_a AS string) END").alias("MatchPointsA"),
        F.col("sets_b").cast("string").alias("MatchPointsB"), *[c.alias(n) for n, c in points.items()],
        F.expr("CASE WHEN seq % 3 = 0 THEN concat('Hall ', seq % 5) ELSE '' END").alias("Hall"),
        F.expr("CASE WHEN seq % 3 < 2 THEN 'City' END").alias("City"))).alias("value"))
    head = m.select("tournament_no", part, F.split("competition_id", "_")[0].alias("pre"), "gender", F.year("date").alias("y")
                    ).distinct().select("tournament_no", "part", F.lit(0).cast("bigint").alias("ord"), F.to_json(F.struct(
                        F.lit("tournament").alias("_type"), F.col("tournament_no").alias("No"),
                        F.expr("concat(CASE pre WHEN 'OG' THEN 'Olympic Games' WHEN 'WCH' THEN 'World Championship' "
                               "WHEN 'WC' THEN 'World Cup' WHEN 'VNL' THEN 'Volleyball Nations League' "
                               "ELSE CASE WHEN y % 4 = 0 THEN 'Local Cup' ELSE 'CEV EuroVolley' END END, ' ', y, "
                               "CASE WHEN y % 2 = 1 AND y % 7 <> 3 THEN concat(' ', initcap(gender)) ELSE '' END)").alias("Name"),
                        F.expr("CASE WHEN y % 7 = 3 THEN '?' WHEN y % 2 = 1 THEN '' WHEN gender = 'men' THEN '0' "
                               "ELSE 'W' END").alias("Gender"))).alias("value"))
    lines = body.unionByName(head)
    (lines.repartition("tournament_no", "part").sortWithinPartitions("tournament_no", "part", "ord")
     .drop("ord").write.partitionBy("tournament_no", "part").text(path))
    return path


@check("s2_landing_scan", MATCHES, _LANDED,
       """select source_match_id, day date_str, gender, competition_name, team_a team_a_name, tb team_b_name, ta::int team_a_score, tbp::int team_b_score,
       sets_a, sets_b, venue, tournament_no, no_in_tournament::int no_in_tournament from trr where reason is null""")
def s2(spark, sf):
    return usable(read_landing(spark, _land(spark, sf))).select(
        "source_match_id", "date_str", "gender", "competition_name", "team_a_name", "team_b_name", "team_a_score",
        "team_b_score", "sets_a", "sets_b", "venue", "tournament_no", "no_in_tournament")


@check("p10_set_rows", MATCHES, _LANDED,
       """select 'landing:o'||st.seq match_id, n::int set_number, a::int team_a_points, b::int team_b_points from st join trr using (seq)
       where reason is null and not (seq%53=0 and n=2)""")
def p10(spark, sf):
    return set_rows(read_landing(spark, _land(spark, sf)))


@check("p11_match_totals", MATCHES, _LANDED,
       "select source_match_id, ta::int team_a_score, tbp::int team_b_score from trr where reason is null")
def p11(spark, sf):
    return usable(read_landing(spark, _land(spark, sf))).select("source_match_id", "team_a_score", "team_b_score")


@check("p12_venue", MATCHES, _LANDED, "select source_match_id, venue from trr where reason is null")
def p12(spark, sf):
    return usable(read_landing(spark, _land(spark, sf))).select("source_match_id", "venue")


@check("p13_discard_reasons", MATCHES, _LANDED,
       "select source_match_id, reason discard_reason from trr where reason is not null")
def p13(spark, sf):
    return discarded(read_landing(spark, _land(spark, sf)))


@check("v4_set_rules", MATCHES, _LANDED,
       """select seq, n::int set_number, (a-(seq%29)*2)::int team_a_points, b::int team_b_points from st where a-(seq%29)*2>=0 and not (seq%31=0)""")
def v4(spark, sf):
    sets = base_matches(spark, sf).selectExpr("seq", "sets_a", "explode(sequence(1, sets_a + sets_b)) AS n").selectExpr(
        "seq", "CASE WHEN seq % 31 = 0 THEN n + 5 ELSE n END AS set_number",
        "CAST(CASE WHEN n <= sets_a THEN CASE WHEN n = 5 THEN 15 ELSE 25 END ELSE 6 + (seq + n) % 8 END - (seq % 29) * 2 AS int) AS team_a_points",
        "CAST(CASE WHEN n <= sets_a THEN 6 + (seq + n) % 8 WHEN n = 5 THEN 15 ELSE 25 END AS int) AS team_b_points")
    return valid_sets(sets)


_GATE = """gate as (select * from trr where reason is null and day between '1990-01-01' and '2030-12-31'),
pass as (select * from gate qualify row_number() over (partition by gender, day, least(team_a,tb), greatest(team_a,tb) order by tournament_no, seq)=1)"""


def _catalogue(spark):
    names = {"OG": ("Olympic Games", "olympic_games"), "WCH": ("World Championship", "world_championship"),
             "WC": ("World Cup", "world_cup"), "VNL": ("Volleyball Nations League", "nations_league"),
             "EURO": ("EuroVolley", "continental")}
    return small_table(spark, [(f"{p}_{g.upper()}", n, g, lv, False) for p, (n, lv) in names.items()
                               for g in ("men", "women")], COMPETITION)


def _landed_aliases(spark, sf):
    return aliases(spark, sf).withColumn("source", F.lit("landing"))


@check("j6_sets_of_accepted_matches", MATCHES, _LANDED, _GATE,
       """select match_id, n::int set_number from (select 'landing:o'||st.seq match_id, st.* from st join pass using (seq)) where not (seq%53=0 and n=2)""")
def s6(spark, sf):
    landed = read_landing(spark, _land(spark, sf))
    done = clean(usable(landed), _landed_aliases(spark, sf), _catalogue(spark))
    return accepted_sets(set_rows(landed), done.matches).select("match_id", "set_number")


@check("s6_sets_sink", MATCHES, _LANDED, _GATE,
       """select count(*) n, count(distinct match_id) n_matches from (select 'landing:o'||st.seq match_id, st.* from st join pass using (seq)) where not (seq%53=0 and n=2)""")
def s6_sink(spark, sf):
    landed = read_landing(spark, _land(spark, sf))
    done = clean(usable(landed), _landed_aliases(spark, sf), _catalogue(spark))
    path = scratch_path(spark, "sets")
    accepted_sets(set_rows(landed), done.matches).write.parquet(path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_distinct("match_id").alias("n_matches"))


@check("s1_csv_scan", MATCHES,
       """select cast(date as varchar) date_str, gender, competition_id competition_name, case when seq%4=0 then null else stage end stage_str,
       team_a team_a_name, team_b team_b_name, case when seq%5=0 then null else team_a_score::int end team_a_score, team_b_score::int team_b_score,
       sets_a, sets_b, null::varchar venue, 'Home' country_host from matches""")
def s1(spark, sf):
    path = scratch_path(spark, "csv")
    base_matches(spark, sf).selectExpr(
        "CAST(date AS string) AS day", "concat(' ', upper(gender)) AS gender", "competition_id AS competition",
        "CASE WHEN seq % 4 = 0 THEN '' ELSE stage END AS stage", "team_a", "team_b",
        "CASE WHEN seq % 5 = 0 THEN '' ELSE concat(team_a_score, '.7') END AS team_a_score", "team_b_score", "sets_a", "sets_b",
        "'' AS venue", "'Home' AS country_host").write.option("header", True).csv(path)
    rows = read_csv_matches(spark, path, column_map={"date": "day"})
    return rows.select("date_str", "gender", "competition_name", "stage_str", "team_a_name", "team_b_name", "team_a_score",
                       "team_b_score", "sets_a", "sets_b", "venue", "country_host")


@check("s1_odd_numbers", MATCHES,
       """select seq%6 kind, count(*) n, count(*) filter (seq%6=1) n_unreadable, count(*) filter (seq%6 in (2,3)) n_no_sets,
       sum(case when seq%6 in (1,4) then 0 else team_a_score end)::bigint scores from matches group by 1""")
def s1_odd(spark, sf):
    """Scores that are not numbers, fractional and wordy set counts, blanks, and a header with a comma in a quoted name."""
    path = scratch_path(spark, "csv")
    base_matches(spark, sf).selectExpr(
        "CAST(seq % 6 AS string) AS `kind, of row`", "CAST(date AS string) AS date", "gender", "competition_id AS competition", "team_a", "team_b",
        "CASE seq % 6 WHEN 1 THEN 'abc' WHEN 4 THEN ' ' ELSE concat(team_a_score, '') END AS team_a_score",
        "CASE seq % 6 WHEN 2 THEN '2.9' WHEN 3 THEN 'two' ELSE concat(sets_a, '') END AS sets_a", "sets_b").write.option("header", True).csv(path)
    rows = read_csv_matches(spark, path, column_map={"stage": "kind, of row"})
    return rows.groupBy(F.col("stage_str").cast("bigint").alias("kind")).agg(
        F.count("*").alias("n"), F.count_if("unreadable").alias("n_unreadable"), F.count_if(F.col("sets_a").isNull()).alias("n_no_sets"),
        F.coalesce(F.sum("team_a_score"), F.lit(0)).cast("bigint").alias("scores"))


@check("s1_csv_row_ids", MATCHES, "select count(*) n, count(*) n_ids, count(*) n_seq from matches")
def s1_ids(spark, sf):
    path = scratch_path(spark, "csv")
    base_matches(spark, sf).select(F.col("date").cast("string").alias("date"), "gender", F.col("competition_id").alias("competition"),
                                   "team_a", "team_b", "sets_a", "sets_b").write.option("header", True).csv(path)
    return read_csv_matches(spark, path).agg(
        F.count("*").alias("n"), F.count_distinct("source_match_id").alias("n_ids"), F.count_distinct("seq").alias("n_seq"))


@check("s3_reload_cleaned", MATCHES, "select gender, count(*) n, sum(sets_a+sets_b)::bigint n_sets from matches group by gender")
def s3(spark, sf):
    path = scratch_path(spark, "cleaned")
    m = base_matches(spark, sf)
    m.select("match_id", "date", "gender", "team_a", "team_b", "sets_a", "sets_b", "winner").write.option("header", True).csv(path)
    schema = columns("match_id string, date date, gender string, team_a string, team_b string, sets_a int, sets_b int, winner string")
    return read_table(spark, path, schema).groupBy("gender").agg(
        F.count("*").alias("n"), F.sum(F.col("sets_a") + F.col("sets_b")).alias("n_sets"))


@check("s4_dimension_scans", MATCHES, ALIASES, COMPETITIONS,
       "select 'alias' kind, k as key, id as value from ald union all select 'competition', competition_id, level from competitions")
def s4(spark, sf):
    alias_path, comp_path = scratch_path(spark, "aliases"), scratch_path(spark, "competitions")
    aliases(spark, sf).drop("ord").write.option("header", True).csv(alias_path)
    competitions(spark).drop("is_club_competition").write.option("header", True).csv(comp_path)
    keys = alias_keys(read_aliases(spark, alias_path)).select(F.lit("alias").alias("kind"), "key", F.col("team_id").alias("value"))
    comps = read_competitions(spark, comp_path).select(
        F.lit("competition").alias("kind"), F.col("competition_id").alias("key"), F.col("level").alias("value"))
    return keys.unionByName(comps)


@check("s5_match_sink", MATCHES, RAW, ALIASES, COMPETITIONS, JUDGED,
       """select source||':'||source_match_id match_id, dt as date, gd gender, competition_id competition, competition_id, stg stage, team_a, team_b,
       coalesce(team_a_score,0)::int team_a_score, coalesce(team_b_score,0)::int team_b_score, sets_a, sets_b,
       case when sets_a>sets_b then 'team_a' else 'team_b' end winner, null::varchar venue, null::varchar country_host, true neutral, source, source_match_id,
       null::varchar tournament_no, null::int no_in_tournament from kept""")
def s5_sink(spark, sf):
    path = scratch_path(spark, "matches")
    write_matches(_clean(spark, sf)[1].matches, path, f"{path}-csv")
    return spark.read.parquet(path).select(*MATCH.fieldNames())


@check("s7_state_round_trip", MATCHES, LONG, FORM, STATE,
       "select gender, team, mp::bigint matches_played, after::bigint current_streak, last last_match_date, least(mp,10)::int n_recent from state")
def s7(spark, sf):
    path = scratch_path(spark, "state")
    team_state(base_matches(spark, sf)).write.partitionBy("gender").parquet(path)
    return spark.read.parquet(path).select("gender", "team", "matches_played", "current_streak", "last_match_date",
                                           F.size("recent").alias("n_recent"))


@check("s8_report_sink", MATCHES,
       "select gender, count(*) n, round(avg((0.5-(winner='team_a')::int)*(0.5-(winner='team_a')::int))::double,6) brier_score from matches group by gender")
def s8(spark, sf):
    path = scratch_path(spark, "report")
    rows = base_matches(spark, sf).withColumn("y", label()).withColumn("p", F.lit(0.5))
    write_report([summarize(rows.filter(F.col("gender") == g), ["gender"]) for g in ("men", "women")], path)
    schema = "gender string, n bigint, log_loss double, brier_score double, accuracy double"
    return spark.read.schema(schema).option("header", True).csv(path).select("gender", "n", F.round("brier_score", 6).alias("brier_score"))


@check("x1_streaming_ingest", MATCHES, _LANDED, _GATE,
       "select gender, cast(day as date) as date, least(team_a,tb) lo, greatest(team_a,tb) hi from pass".replace(
           "least(team_a,tb)", "'N'||least(substr(team_a,8)::int,substr(tb,8)::int)").replace(
           "greatest(team_a,tb)", "'N'||greatest(substr(team_a,8)::int,substr(tb,8)::int)"))
def x1(spark, sf):
    landing, out = _land(spark, sf), scratch_path(spark, "stream")
    ingest_available(spark, landing, out, _landed_aliases(spark, sf), _catalogue(spark), files_per_batch=40)
    number = {s: F.substring(s, 2, 10).cast("int") for s in ("team_a", "team_b")}
    return stored_matches(spark, out).select(
        "gender", "date", F.concat(F.lit("N"), F.least(*number.values())).alias("lo"),
        F.concat(F.lit("N"), F.greatest(*number.values())).alias("hi"))


@check("s11_resume", MATCHES, _LANDED, _GATE, "select count(*) n, count(*) n_seq from pass")
def s11(spark, sf):
    landing, out = _land(spark, sf), scratch_path(spark, "stream")
    for _ in range(2):  # the second run finds nothing new
        ingest_available(spark, landing, out, _landed_aliases(spark, sf), _catalogue(spark), files_per_batch=100)
    return stored_matches(spark, out).agg(F.count("*").alias("n"), F.count_distinct("seq").alias("n_seq"))


@check("x2_streaming_scoring", MATCHES, COMPETITIONS, LONG, FORM, STATE, ELO, RATING, FIXTURES, FX,
       "select gender, team_a, team_b, round(ea-eb,6) elo_diff, met::bigint h2h_matches_played from fxx", recursive=True)
def x2(spark, sf):
    m = cut(base_matches(spark, sf))
    landing, out = scratch_path(spark, "fixtures"), scratch_path(spark, "scored")
    upcoming = fixtures(m)
    upcoming.write.parquet(landing)
    ratings, states, days = final_ratings(m, elo_history(m)), team_state(m), pair_days(m)
    score_available(spark, landing, upcoming.schema, out,
                    lambda df: fixture_features(df, ratings, states, days, competitions(spark)))
    return spark.read.parquet(f"{out}/scored").select("gender", "team_a", "team_b", F.round("elo_diff", 6).alias("elo_diff"),
                                                      "h2h_matches_played")
