import os
import json

import pytest
from pyspark.sql import functions as F

from courtside.schemas import ALL_TABLES, MATCH, columns
from courtside.sources.csv_matches import read_csv_matches
from courtside.sources.dimensions import competition_table
from courtside.sources.files import number_lines, read_aliases, read_competitions, read_table, write_matches
from courtside.sources.landing import discarded, read_landing, set_rows, usable, with_headers
from courtside.streaming.ingest import _SEEN, _earlier, ingest_available, stored_matches


def _land(folder, no, name, gender, matches, header=True):
    lines = [{"_type": "tournament", "No": no, "Name": name, "Gender": gender}] if header else []
    lines += [{"_type": "match", **m} for m in matches]
    (folder / f"tournament_{no}.jsonl").write_text("\n".join(json.dumps(line) for line in lines) + "\n")


def _match(no, a="USA", b="Brazil", stamp="2025-06-11T18:00:00", pa="3", pb="1", **extra):
    return {"No": no, "TeamAName": a, "TeamBName": b, "DateTimeLocal": stamp, "MatchPointsA": pa, "MatchPointsB": pb, **extra}


POINTS = {"PointsTeamASet1": "25", "PointsTeamBSet1": "20", "PointsTeamASet2": "25", "PointsTeamBSet2": "22",
          "PointsTeamASet3": "20", "PointsTeamBSet3": "25", "PointsTeamASet4": "25", "PointsTeamBSet4": "18",
          "PointsTeamASet5": "0", "PointsTeamBSet5": ""}


def test_landed_match(spark, tmp_path):
    _land(tmp_path, "1001", "Volleyball Nations League 2025 - Men", "men", [_match("5001", **POINTS, Hall="Ottawa Arena")])
    rows = read_landing(spark, str(tmp_path))
    r = usable(rows).first()
    assert (r["gender"], r["competition_name"], r["sets_a"], r["sets_b"], r["venue"]) == (
        "men", "Volleyball Nations League", 3, 1, "Ottawa Arena")
    assert (r["team_a_score"], r["team_b_score"], r["tournament_no"]) == (95, 85, "1001")
    sets = set_rows(rows).orderBy("set_number").collect()
    assert [s["team_a_points"] for s in sets] == [25, 25, 20, 25]


def test_landed_faults(spark, tmp_path):
    _land(tmp_path, "1", "World Championship Women", None, [
        _match("a", b=""), _match("b", stamp="soon"), _match("c", pa="x"), _match("d", PointsTeamASet1="abc", PointsTeamBSet1="25")])
    _land(tmp_path, "2", "Local Cup", "men", [_match("e")])
    _land(tmp_path, "3", "World Championship", "?", [_match("f")])
    _land(tmp_path, "4", "", "men", [_match("g")], header=False)
    rows = read_landing(spark, str(tmp_path))
    assert {r[0]: r[1] for r in discarded(rows).collect()} == {
        "a": "missing team name", "b": "missing or unreadable date", "c": "missing or non-numeric set count",
        "e": "tournament outside the catalogue", "f": "unknown tournament gender", "g": "match before tournament header"}
    assert [r["source_match_id"] for r in usable(rows).collect()] == ["d"]
    assert set_rows(rows).count() == 0


def test_last_header_above_counts(spark, tmp_path):
    lines = [{"_type": "tournament", "No": "1", "Name": "World Cup", "Gender": "men"}, {"_type": "match", **_match("a")},
             {"_type": "tournament", "No": "2", "Name": "World Cup", "Gender": "women"}, {"_type": "match", **_match("b")}]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert {r["source_match_id"]: r["gender"] for r in usable(read_landing(spark, str(tmp_path))).collect()} == {"a": "men", "b": "women"}


def test_headers_of_a_long_file_in_many_splits(spark, tmp_path, monkeypatch):
    """One file with all tournaments, more of them than a range of lines, and a tournament over several ranges and splits."""
    from courtside.sources import landing
    monkeypatch.setattr(landing, "RANGE", 16)
    lines, want = [json.dumps({"_type": "match", **_match("early")})], {}
    for t in range(60):
        lines.append(json.dumps({"_type": "tournament", "No": f"t{t}", "Name": "World Cup", "Gender": ["men", "women"][t % 2]}))
        for i in range(70 if t % 20 == 0 else t % 3):
            want[f"{t}-{i}"] = f"t{t}"
            lines.append(json.dumps({"_type": "match", **_match(f"{t}-{i}")}))
    (tmp_path / "all.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "other.jsonl").write_text(json.dumps({"_type": "match", **_match("lost")}) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = read_landing(spark, str(tmp_path))
        assert {r["source_match_id"]: r["tournament_no"] for r in usable(rows).collect()} == want
        assert {r[0] for r in discarded(rows).collect()} == {"early", "lost"}
        seqs = [r["seq"] for r in rows.orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(set(seqs)) == len(want) + 2


def test_csv_rows(spark, tmp_path):
    path = tmp_path / "vnl_2025.csv"
    path.write_text("day,gender,competition,team_a,team_b,team_a_score,sets_a,sets_b\n"
                    "2025-06-11, MEN ,VNL,USA,Brazil,101.9,3,1\n2025-06-12,men,VNL,Italy,Poland,,3,two\n")
    rows = read_csv_matches(spark, str(path), column_map={"date": "day"}).orderBy("seq").collect()
    assert [r["source_match_id"] for r in rows] == ["vnl_2025_0", "vnl_2025_1"]
    assert (rows[0]["gender"], rows[0]["team_a_score"], rows[0]["stage_str"]) == ("men", 101, None)
    assert rows[1]["team_a_score"] is None and rows[1]["sets_b"] is None
    with pytest.raises(ValueError, match="date"):
        read_csv_matches(spark, str(path))


def test_lines_are_numbered_across_splits(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_text("\n".join(f"{name}{i:05d}" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = number_lines(spark.read.text(str(tmp_path))).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["value"] for r in rows] == [f"{n}{i:05d}" for n in ("a", "b") for i in range(3000)]
    assert [r["line"] for r in rows] == list(range(3000)) * 2


def test_tables(spark, tmp_path):
    (tmp_path / "m.csv").write_text("match_id,date,sets_a\nx,2025-01-01,3\ny,bad,\n")
    schema = columns("match_id string, date date, sets_a int")
    rows = read_table(spark, str(tmp_path / "m.csv"), schema).orderBy("match_id").collect()
    assert rows[0]["sets_a"] == 3 and rows[1]["date"] is None
    with pytest.raises(ValueError, match="sets_b"):
        read_table(spark, str(tmp_path / "m.csv"), columns("match_id string, sets_b int"))
    (tmp_path / "c.csv").write_text("competition_id,name,gender,level\nOG_MEN,Olympic Games,men,olympic_games\n")
    assert read_competitions(spark, str(tmp_path / "c.csv")).first()["is_club_competition"] is False
    (tmp_path / "a.csv").write_text("canonical_team_id,source,source_name\nUSA,csv,United States\nBRA,csv,Brasil\n")
    assert [r["ord"] for r in read_aliases(spark, str(tmp_path / "a.csv")).orderBy("ord").collect()] == [0, 1]
    assert len(ALL_TABLES) == 7 and competition_table(spark).count() == 18


def test_match_sink(spark, tmp_path):
    row = {f.name: None for f in MATCH.fields} | {"match_id": "x", "gender": "men"}
    write_matches(spark.createDataFrame([row], MATCH), f"{tmp_path}/p", f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/p").first()["match_id"] == "x"
    text = spark.read.text(f"{tmp_path}/c").collect()[1][0]
    assert text.startswith("x,,men,,")


def test_streaming_resumes_and_drops_repeats(spark, tmp_path):
    landing, out = tmp_path / "in", f"{tmp_path}/out"
    landing.mkdir()
    aliases = spark.createDataFrame([(c, "landing", n, i) for i, (c, n) in enumerate(
        [("USA", "USA"), ("BRA", "Brazil"), ("ITA", "Italy")])], "canonical_team_id string, source string, source_name string, ord bigint")

    def run():
        ingest_available(spark, str(landing), out, aliases, competition_table(spark))
        return {r["source_match_id"] for r in stored_matches(spark, out).collect()}

    _land(landing, "1", "World Cup", "men", [_match("1"), _match("2", b="Atlantis")])
    assert run() == {"1"}
    assert run() == {"1"}
    _land(landing, "2", "World Cup", "men", [
        _match("2", b="Italy"), _match("9", a="Brazil", b="USA", pa="1", pb="3"), _match("3", b="Italy")])
    assert run() == {"1", "3"}  # 2 was seen (and rejected), 9 is the same meeting as 1
    seqs = [r["seq"] for r in stored_matches(spark, out).collect()]
    assert sorted(seqs) == [0, 1]
    assert spark.read.parquet(f"{out}/judged").filter(F.col("reason").isNotNull()).count() == 1
    plan = _earlier(spark, f"{out}/judged", _SEEN, 1, "bucket", [3, 7])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_landed_parts_are_read_in_the_order_of_their_matches(spark, tmp_path, monkeypatch):
    """Keys into the millions, and files of two matches."""
    from courtside.checks import files
    sample = "/root/testdata/sf0.001"
    if not os.path.isdir(sample):
        pytest.skip("sample tables not present")
    for t in ("customer", "nation", "region"):
        os.symlink(f"{sample}/{t}.parquet", tmp_path / f"{t}.parquet")
    orders = spark.read.parquet(f"{sample}/orders.parquet")
    orders.withColumn("o_orderkey", F.col("o_orderkey") * 1001).write.parquet(f"{tmp_path}/orders.parquet")
    for rows in (100_000, 2):
        monkeypatch.setattr(files, "PART_ROWS", rows, raising=False)
        got = read_landing(spark, files._land(spark, str(tmp_path))).select("tournament_no", "seq", "source_match_id").collect()
        assert len(got) == 1500
        placed = sorted((r.tournament_no, r.seq, int(r.source_match_id[1:])) for r in got)
        assert [(t, k) for t, _, k in placed] == sorted((t, k) for t, _, k in placed)


def test_a_batch_writes_each_month_once(spark, tmp_path):
    landing, out = tmp_path / "in", f"{tmp_path}/out"
    landing.mkdir()
    aliases = spark.createDataFrame([(c, "landing", n, i) for i, (c, n) in enumerate(
        [("USA", "USA"), ("BRA", "Brazil")])], "canonical_team_id string, source string, source_name string, ord bigint")
    days = [f"2025-0{m}-{d:02}T18:00:00" for m in (5, 6) for d in range(1, 25)]
    _land(landing, "1", "World Cup", "men", [_match(str(i), stamp=s) for i, s in enumerate(days)])
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")  # as if the batch were large
    try:
        ingest_available(spark, str(landing), out, aliases, competition_table(spark))
    finally:
        spark.conf.set(setting, before)
    for month in ("202505", "202506"):
        assert len(list((tmp_path / "out" / "matches" / "batch=0" / f"month={month}").glob("*.parquet"))) == 1
    assert stored_matches(spark, out).count() == 48


def test_set_rows_are_hashed_and_keep_signs(spark):
    rows = [(1, "landing", "x", None, [(1, 25, -3), (2, -(1 << 31), (1 << 31) - 1)]), (0, "landing", "x", None, [(1, -7, 20)]),
            (2, "landing", "y", "bad", [(1, 1, 1)]), (3, "landing", "y", None, [(1, (1 << 31) - 1, -(1 << 31)), (3, 0, 0)])]
    df = spark.createDataFrame(rows, "seq bigint, source string, source_match_id string, discard_reason string, sets array<struct<set_number:int,team_a_points:int,team_b_points:int>>")
    got = set_rows(df)
    assert {tuple(r) for r in got.collect()} == {("landing:x", 1, -7, 20), ("landing:x", 2, -(1 << 31), (1 << 31) - 1), ("landing:y", 1, (1 << 31) - 1, -(1 << 31)), ("landing:y", 3, 0, 0)}
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_lines_meet_their_headers_without_being_moved(spark):
    lines = spark.range(9000).select(
        F.lit("f").alias("file"), F.col("id").alias("line"), F.when(F.col("id") % 5000 == 10, "tournament").otherwise("match").alias("_type"),
        F.col("id").cast("string").alias("No"), F.lit("n").alias("Name"), F.lit("W").alias("Gender"))
    got = with_headers(lines)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    want = {i: None if i < 10 else "10" if i < 5010 else "5010" for i in range(9000) if i % 5000 != 10}
    assert {r.line: r.tournament_no for r in got.select("line", "tournament_no").collect()} == want
