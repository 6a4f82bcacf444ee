from datetime import date

import pytest
from pyspark.sql import functions as F

from courtside.functions.dates import local_date, parse_date
from courtside.functions.text import canonical_competition, gender_of, in_scope, name_candidates, name_key, stage_of
from courtside.operators.cleaning import clean, cleaning_report, competition_faults, match_faults, valid_sets
from courtside.operators.names import (
    alias_keys, auto_resolved_names, by_country, by_near_miss, resolve_names, unresolved_names,
)
from courtside.schemas import COMPETITION, RAW_MATCH
from courtside.sources.dimensions import competition_table, override_table

COUNTRIES = [("Brazil", "BRA"), ("Italy", "ITA"), ("Poland", "POL"), ("France", "FRA"), ("Japan", "JPN"),
             ("United States", "USA"), ("Germany", "DEU"), ("Cuba", "CUB"), ("Netherlands", "NLD"), ("Kuwait", "KWT")]


def _raw(spark, rows):
    base = dict.fromkeys(RAW_MATCH.fieldNames())
    base.update(source="csv", gender="men", competition_name="Volleyball Nations League", sets_a=3, sets_b=1,
                date_str="2025-06-11", team_a_name="Italy", team_b_name="Poland")
    full = [{**base, "seq": i, "source_match_id": f"r{i}", **r} for i, r in enumerate(rows)]
    return spark.createDataFrame(full, RAW_MATCH)


def _aliases(spark, rows=()):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)] or [("XXX", "csv", "nobody", 0)],
                                 "canonical_team_id string, source string, source_name string, ord bigint")


def _countries(spark):
    return spark.createDataFrame(COUNTRIES, "country string, code string")


def _values(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_sample_season(spark):
    rows = [
        dict(date_str="2025-06-11", team_a_name="USA", team_b_name="Brazil", stage_str="pool"),
        dict(date_str="2025-06-12", sets_b=2),
        dict(date_str="2025-06-13", team_a_name="France", team_b_name="Japan", sets_a=1, sets_b=3),
        dict(date_str="2025-06-14", team_a_name="USA", team_b_name="Italy", sets_b=0, stage_str="quarterfinal"),
        dict(date_str="2025-06-14", team_a_name="USA", team_b_name="Italy", sets_b=0, stage_str="quarterfinal"),
        dict(date_str="2025-06-15", team_a_name="USA", team_b_name="Atlantis", sets_b=0),
    ]
    raw = _raw(spark, rows)
    done = clean(raw, _aliases(spark, [("USA", "csv", "USA")]), competition_table(spark), override_table(spark),
                 _countries(spark))
    report = {(r["status"], r["reason"]): r["n"] for r in cleaning_report(raw, done).collect()}
    assert report == {("raw", None): 6, ("valid", None): 4, ("duplicate", None): 1, ("rejected", "unknown team_b"): 1}
    assert [r["name"] for r in unresolved_names(done.resolved).collect()] == ["Atlantis"]
    got = {r["match_id"]: r for r in done.matches.collect()}
    assert got["csv:r0"]["team_b"] == "BRA" and got["csv:r0"]["competition_id"] == "VNL_MEN"
    assert got["csv:r2"]["winner"] == "team_b"
    assert got["csv:r3"]["stage"] == "quarterfinal" and got["csv:r1"]["stage"] == "other"
    assert got["csv:r0"]["team_a_score"] == 0 and got["csv:r0"]["neutral"] is True


def test_first_failing_rule_is_the_reason_and_a_rejected_copy_shadows_later_ones(spark):
    rows = [
        dict(gender="mixed", team_a_name="Nowhere"),
        dict(team_a_name="Nowhere", team_b_name="Nobody"),
        dict(competition_name="Local Cup"),
        dict(date_str="11 June"),
        dict(date_str="2568-11-08"),
        dict(team_b_name="Italy"),
        dict(sets_a=2, sets_b=2),
        dict(team_a_score=-1),
        dict(sets_a=None),
        dict(sets_a=4),
        dict(source_match_id="same", date_str="bad"),
        dict(source_match_id="same", date_str="2025-07-01"),
    ]
    done = clean(_raw(spark, rows), _aliases(spark), competition_table(spark), override_table(spark), _countries(spark))
    reasons = {r["source_match_id"]: r["reason"] for r in done.rejected.collect()}
    assert reasons == {
        "r0": "unknown gender", "r1": "unknown team_a", "r2": "unknown competition", "r3": "unknown date format",
        "r4": "date out of range", "r5": "same team", "r6": "not a best-of-five result", "r7": "negative score",
        "r8": "missing sets", "r9": "sets out of range", "same": "unknown date format"}
    assert done.matches.count() == 0


def test_dates(spark):
    texts = ["2025-06-11", "03/04/2025", "12/31/2025", "2025/6/1", "11 June", "2025-13-01", None]
    assert _values(spark, texts, parse_date) == [
        date(2025, 6, 11), date(2025, 4, 3), date(2025, 12, 31), date(2025, 6, 1), None, None, None]
    stamps = ["2026-06-10T18:00:00", "2568-11-08T10:00:00", "3000-01-01T00:00:00", "10/06/2026", "", None]
    assert _values(spark, stamps, local_date) == ["2026-06-10", "2025-11-08", "3000-01-01", None, None, None]


def test_name_keys_and_candidates(spark):
    assert _values(spark, ["  Côte   D'Ivoire ", "Türkiye", "ﬁji", None], name_key) == [
        "cote d'ivoire", "turkiye", "fiji", None]
    assert _values(spark, ["Germany (RED)", "U.S.A.", "St. X. (B)", "Cuba"], name_candidates) == [
        ["Germany (RED)", "Germany"], ["U.S.A.", "USA"], ["St. X. (B)", "St. X.", "St X (B)", "St X"], ["Cuba"]]


def test_stage_gender_competition_and_scope(spark):
    assert _values(spark, [" QF ", "Gold Medal Match", "odd", None], stage_of) == ["quarterfinal", "final", "other", "other"]
    pairs = spark.createDataFrame([("men", "x"), ("1", "x"), (None, "World Championship Women"), (None, "a tournament"),
                                   ("?", "Asian Men's Cup")], "f string, n string")
    got = [r[0] for r in pairs.select(gender_of(F.col("f"), F.col("n"))).collect()]
    assert got == ["men", "women", "women", None, "men"]
    names = ["CEV EuroVolley 2025", "Asian Men's Championship 2023", "Some Unrelated Event", "South American Championship"]
    assert _values(spark, names, canonical_competition) == [
        "EuroVolley", "Asian Championship", None, "South American Championship"]
    scope = {"Volleyball Nations League 2025 - Men": True, "Paris 2024 Olympic Games Men's": True,
             "Club World Championship 2025": False, "U21 World Championship": False,
             "World Grand Champions Cup": False, "Central Asian Volleyball Championship 2022": False, "Local Cup": False}
    assert _values(spark, list(scope), in_scope) == list(scope.values())


def test_alias_order_and_self_alias(spark):
    table = _aliases(spark, [("AAA", "csv", "Alpha"), ("BBB", "csv", "alpha"), ("CCC", "csv", "AAA")])
    got = {r["key"]: r["team_id"] for r in alias_keys(table).collect()}
    assert got == {"alpha": "BBB", "aaa": "CCC", "bbb": "BBB", "ccc": "CCC"}


def test_resolution_levels(spark):
    names = spark.createDataFrame([("csv", n) for n in (
        "Brasil", "Germany (RED)", "Turkez", "cub", "Kuwiat", "Atlantis", "Chinese Taipei", "My team")], "source string, name string")
    resolved = resolve_names(names, _aliases(spark, [("MINE", "csv", "my  TEAM")]), override_table(spark), _countries(spark))
    got = {r["name"]: (r["team_id"], r["level"]) for r in resolved.collect()}
    assert got == {"Brasil": ("BRA", "country"), "Germany (RED)": ("DEU", "country"), "Turkez": ("TUR", "country"),
                   "cub": ("CUB", "country"), "Kuwiat": ("KWT", "near miss"), "Atlantis": (None, None),
                   "Chinese Taipei": ("TPE", "country"), "My team": ("MINE", "alias")}
    assert auto_resolved_names(resolved).count() == 6


def test_near_miss_matches_brute_force(spark):
    import itertools
    words = ["".join(w) for w in itertools.product("ab", repeat=4)] + ["abcde", "bacde", "xx"]
    names = spark.createDataFrame([("s", w) for w in words], "source string, name string")
    countries = spark.createDataFrame([("abab", "C1"), ("bbbb", "C2"), ("abcd", "C3"), ("zzzzzz", "C4")], "country string, code string")
    got = {r["name"]: (r["distance"], r["team_id"]) for r in by_near_miss(names, countries).collect()}
    brute = (names.crossJoin(countries).withColumn("d", F.levenshtein("name", "country")).filter("d <= 2")
             .groupBy("name").agg(F.min(F.struct("d", "code")).alias("b")).collect())
    assert got == {r["name"]: (r["b"]["d"], r["b"]["code"]) for r in brute}


def test_exact_country_beats_nothing_else(spark):
    names = spark.createDataFrame([("s", "congo"), ("s", "Cuba")], "source string, name string")
    got = {r["name"]: r["team_id"] for r in by_country(names, override_table(spark), _countries(spark)).collect()}
    assert got == {"congo": "COG", "Cuba": "CUB"}


def test_competition_and_set_rules(spark):
    rows = spark.createDataFrame([("A", "A", "men", "x", True), ("B", "B", "x", "x", False), ("C", "C", "men", "x", None)], COMPETITION)
    assert {r["competition_id"]: r["reason"] for r in competition_faults(rows).collect()} == {
        "A": "club competition", "B": "unknown gender"}
    sets = spark.createDataFrame([(1, 25, 20), (6, 25, 20), (2, -1, 25), (0, 1, 1)], "set_number int, team_a_points int, team_b_points int")
    assert valid_sets(sets).count() == 1


@pytest.mark.parametrize("sets,ok", [((3, 0), True), ((2, 3), True), ((3, 3), False), ((2, 1), False)])
def test_best_of_five(spark, sets, ok):
    a, b = (F.lit(s) for s in sets)
    reason = spark.range(1).select(match_faults(a, b, F.lit(1), F.lit(1), F.lit("x"), F.lit("y"))).first()[0]
    assert (reason is None) is ok
