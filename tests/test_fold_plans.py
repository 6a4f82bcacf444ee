"""What a pool's rows meet is a table of known size, so no pool is sent to one task."""

from datetime import date, timedelta

from courtside.operators.folds import assign_folds, fold_weights, tail_split
from courtside.session import cut


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pool_tables_do_not_move_the_rows(spark):
    rows = [(i, date(2020, 1, 1) + timedelta(days=i // 4), ["men", "women", None][i % 3]) for i in range(300)]
    folded = cut(assign_folds(spark.createDataFrame(rows, "seq bigint, date date, gender string")))
    for df in (fold_weights(folded, "decayed"), tail_split(folded, 0.2), tail_split(folded.filter("gender = 'men'"), 0.2)):
        assert "SortMergeJoin" not in _plan(df) and "hashpartitioning" not in _plan(df)
    weighed = {(r.gender, r.seq): r for r in fold_weights(folded, "expanding").collect()}
    assert len(weighed) == 300 and all(r.fold_weights[4] == float((-1 if r.test_fold is None else r.test_fold) < 4) for r in weighed.values())
    held = tail_split(folded, 0.2).where("held_out").groupBy("gender").count().collect()
    assert {r.gender: r["count"] for r in held} == {"men": 20, "women": 20, None: 20}
