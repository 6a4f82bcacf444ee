"""Rows and settings that the samples do not have."""

import os
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from courtside.functions.scores import orient
from courtside.models.isotonic import Isotonic
from courtside.operators.context import last_per_key, with_level
from courtside.operators.elo import DECAYING, elo_history
from courtside.operators.evaluation import expected_calibration_error, roc_auc
from courtside.operators.folds import assign_folds, year_folds
from courtside.operators.names import by_near_miss
from courtside.operators.ordering import with_position
from courtside.operators.rolling import h2h_last, rolling_means
from courtside.plans.walkforward import elo_predictor, evaluate
from courtside.session import cut, forget


def test_rows_with_null_keys_keep_a_position(spark):
    rows = [(1, None, date(2020, 1, 1)), (2, "a", None), (3, "a", date(2020, 1, 2)), (4, None, None)]
    df = spark.createDataFrame(rows, "seq bigint, gender string, date date")
    got = {r.seq: r.pos for r in with_position(df, ["gender"]).collect()}
    assert got == {1: 1, 4: 0, 2: 0, 3: 1}


def test_near_misses_try_every_candidate(spark):
    names = spark.createDataFrame([("f", "Brazl (RED)"), ("f", "x" * 3000), ("f", "Braz.il.")], "source string, name string")
    countries = spark.createDataFrame([("Brazil", "BRA"), ("Italy", "ITA")], "country string, code string")
    assert {r.name: (r.team_id, r.distance) for r in by_near_miss(names, countries).collect()} == {
        "Brazl (RED)": ("BRA", 1), "Braz.il.": ("BRA", 2)}


def test_last_catalogue_row_counts_once(spark):
    catalogue = spark.createDataFrame([("A", "world_cup", 0), ("A", "continental", 1), ("B", "world_cup", 2)], "competition_id string, level string, ord bigint")
    assert {tuple(r) for r in last_per_key(catalogue, ["competition_id"], ["level"]).collect()} == {("A", "continental"), ("B", "world_cup")}
    df = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "seq int, competition_id string")
    assert sorted((r.seq, r.level) for r in with_level(df, catalogue).collect()) == [(1, "continental"), (2, "world_cup"), (3, None)]


def test_evaluate_refuses_leaking_folds(spark, ladder):
    rows = assign_folds(ladder.withColumn("elo_pred_a", F.lit(0.5)))
    assert evaluate(rows, {"elo": elo_predictor}).count() > 0
    leaky = rows.withColumn("test_fold", F.when(F.col("test_fold").isNotNull(), 4 - F.col("test_fold")))
    with pytest.raises(AssertionError):
        evaluate(leaky, {"elo": elo_predictor})


def test_isotonic_keeps_nulls(spark):
    rows = spark.createDataFrame([(0.1 * i, float(i > 4)) for i in range(10)], "p double, y double")
    got = Isotonic().fit(rows).transform(spark.createDataFrame([(None,), (0.95,)], "p double")).collect()
    assert got[0].p is None and got[1].p == 0.98


def test_elo_blocks_are_the_ordered_replay(spark, crowded):
    for config in (None, DECAYING):
        args = () if config is None else (config,)
        whole = {r.seq: tuple(r) for r in elo_history(crowded, *args).collect()}
        for size in (30, 250):
            assert {r.seq: tuple(r) for r in elo_history(crowded, *args, block_rows=size).collect()} == whole
    assert elo_history(crowded.limit(0)).count() == 0


def test_rolling_in_pieces_equals_whole(spark, crowded):
    rows = crowded.withColumn("team", F.col("team_a")).withColumn("v", F.when(F.col("seq") % 5 > 0, F.col("seq").cast("double")))
    whole = {r.seq: (r.v_last3, r.v_last7) for r in rolling_means(rows, ["v"], (3, 7)).collect()}
    for budget in (5, 40):
        assert {r.seq: (r.v_last3, r.v_last7) for r in rolling_means(rows, ["v"], (3, 7), budget=budget).collect()} == whole
    assert h2h_last(crowded.limit(0)).count() == 0


def test_auc_and_calibration_error(spark):
    rows = [("m", 0.2, 0.0), ("m", 0.2, 1.0), ("m", 0.7, 1.0), ("m", 0.9, 0.0), ("w", 0.5, 1.0), ("w", None, 0.0)]
    df = spark.createDataFrame(rows, "gender string, p double, y double")
    auc = {r.gender: (r.n, r.auc) for r in roc_auc(df, ["gender"], ranges=3).collect()}
    assert auc == {"m": (4, (0.5 + 0 + 1 + 0) / 4), "w": (1, None)}
    ece = {r.gender: round(r.ece, 9) for r in expected_calibration_error(df, ["gender"]).collect()}
    assert ece == {"m": round((2 * 0.3 + 0.3 + 0.9) / 4, 9), "w": 0.5}


def test_year_folds_and_orientation(spark):
    df = spark.createDataFrame([(1, "m", date(2018, 5, 1)), (2, "m", date(2019, 1, 1)), (3, "m", date(2021, 1, 1)), (4, "m", None)], "seq int, gender string, date date")
    assert {r.seq: r.test_fold for r in year_folds(df).collect()} == {1: None, 2: 0, 3: 2, 4: None}
    turned = orient(spark.createDataFrame([(1.0, 0.25, 3.0)], "win_rate_last3_diff double, h2h_last_3 double, other double"),
                    ["win_rate_last3_diff", "h2h_last_3", "other"], F.lit(True)).first()
    assert tuple(turned) == (-1.0, 0.75, 3.0)


def test_cut_leaves_no_shuffle_files(spark):
    """What a written table was shuffled for is removed with the end of the write, not when the driver next clears its memory."""
    folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]

    def held():
        return {name for _, _, names in os.walk(folder) for name in names if name.startswith("shuffle_")}

    before = held()
    out = cut(spark.range(20_000).groupBy((F.col("id") % 7_000).alias("k")).agg(F.sum("id").alias("s")))
    end = time.time() + 20
    while held() - before and time.time() < end:
        time.sleep(0.1)
    assert not held() - before and out.count() == 7_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_forget_removes_a_written_table(spark):
    kept = cut(spark.range(3))
    path = kept.inputFiles()[0]
    forget(kept)
    assert not spark._jvm.java.io.File(path.removeprefix("file://")).exists()
    forget(spark.range(2))
