"""Metrics as aggregates: they combine on the map side, whatever the size of a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.operators.tally import DIRECT, added, in_order, value_of
from courtside.schemas import SCORES

CLIP = 1e-15


def label() -> Column:
    return F.when(F.col("winner") == "team_a", F.lit(1.0)).otherwise(F.lit(0.0))


def log_loss(y: Column, p: Column) -> Column:
    q = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), p))
    return -F.avg(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def brier_score(y: Column, p: Column) -> Column:
    return F.avg((p - y) * (p - y))


def accuracy(y: Column, p: Column, threshold: float = 0.5) -> Column:
    return F.avg(((p >= threshold).cast("double") == y).cast("double"))


def summarize(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    yc, pc = F.col(y), F.col(p)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), log_loss(yc, pc).alias("log_loss"), brier_score(yc, pc).alias("brier_score"),
        accuracy(yc, pc).alias("accuracy"))


def summarize_regression(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    gap = F.col(y) - F.col(p)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"))


def calibration_table(df: DataFrame, by: list[str], y: str = "y", p: str = "p", n_bins: int = 10) -> DataFrame:
    """Equal bins on [0, 1], right-closed, 0 in the first; empty bins are left out."""
    pc, step = F.col(p), 1 / n_bins
    inner = [F.when(pc > F.lit(k * step), F.lit(1)).otherwise(F.lit(0)) for k in range(1, n_bins)]
    number = F.lit(0)
    for part in inner:
        number = number + part
    return (
        df.filter(pc.between(0.0, 1.0)).withColumn("bin", number.cast("int")).groupBy(*by, "bin")
        .agg(F.avg(p).alias("predicted_mean"), F.avg(y).alias("actual_rate"), F.count("*").alias("count"))
    )


def expected_calibration_error(df: DataFrame, by: list[str], y: str = "y", p: str = "p", n_bins: int = 10) -> DataFrame:
    """Mean distance of predicted and actual rate over the bins, weighted by their rows: by, n, ece, mce (the largest distance)."""
    gap = F.abs(F.col("predicted_mean") - F.col("actual_rate"))
    return calibration_table(df, by, y, p, n_bins).groupBy(*by).agg(
        F.sum("count").alias("n"), (F.sum(gap * F.col("count")) / F.sum("count")).alias("ece"), F.max(gap).alias("mce"))


def roc_auc(df: DataFrame, by: list[str], y: str = "y", p: str = "p", ranges: int = 4096) -> DataFrame:
    """Chance that a row with y = 1 has a larger p than one with y = 0, ties counting half: by, n, auc (null for one class).

    Rows are counted per distinct p; negatives below are summed per range of p, of which there is a fixed number, and inside each
    range, so no task sorts all of a group's values. Rows with a null p or y are left out.
    """
    counted = (df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(p).alias("_p"))
               .agg(F.sum(F.col(y)).alias("_pos"), F.sum(1 - F.col(y)).alias("_neg")))
    ranged = counted.withColumn("_range", F.greatest(F.lit(0), F.least(F.lit(ranges), F.floor(F.col("_p") * ranges))))
    key = [*by, "_range"]
    below = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*key).agg(F.sum("_neg").alias("_n")).select(*key, F.coalesce(F.sum("_n").over(below), F.lit(0.0)).alias("_off"))
    inside = Window.partitionBy(*key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_in", F.coalesce(F.sum("_neg").over(inside), F.lit(0.0))).join(offsets, key)
    won = F.sum(F.col("_pos") * (F.col("_off") + F.col("_in") + F.col("_neg") / 2))
    pairs = F.sum("_pos") * F.sum("_neg")
    return placed.groupBy(*by).agg((F.sum("_pos") + F.sum("_neg")).cast("bigint").alias("n"), F.when(pairs > 0, won / pairs).alias("auc"))


def summarize_across_folds(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Mean and sample deviation over the folds, to four places."""
    out = []
    for name in ("log_loss", "brier_score", "accuracy"):
        out.append(F.bround(F.avg(name), 4).alias(f"{name}_mean"))
        out.append(F.bround(F.stddev_samp(name), 4).alias(f"{name}_std"))
    return metrics.groupBy(*by).agg(*out)


def best_score() -> Column:
    """Most probable of the six score columns; ties go to the earlier score."""
    entries = F.array(*[F.struct((0.0 - F.col(s)).alias("k"), F.lit(i).alias("i"), F.lit(s).alias("s"))
                        for i, s in enumerate(SCORES)])
    return F.array_min(entries)["s"]


def score_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """Log loss and accuracy of the exact score; df carries the six columns, sets_a and sets_b."""
    actual = F.concat_ws("-", F.col("sets_a"), F.col("sets_b"))
    total = sum((F.col(s) for s in SCORES[1:]), F.col(SCORES[0]))
    hit = F.coalesce(*[F.when(actual == s, F.col(s)) for s in SCORES]) / total
    clipped = F.greatest(F.lit(2.220446049250313e-16), F.least(F.lit(1 - 2.220446049250313e-16), hit))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), (-F.avg(F.ln(clipped))).alias("log_loss"),
        F.avg((best_score() == actual).cast("double")).alias("accuracy"))


def score_frequencies(df: DataFrame, by: list[str]) -> DataFrame:
    """Actual share of each score beside its mean predicted probability; all six scores appear."""
    actual = F.concat_ws("-", F.col("sets_a"), F.col("sets_b"))
    rows = df.select(*by, F.inline(F.array(*[
        F.struct(F.lit(s).alias("score"), (actual == s).cast("double").alias("hit"), F.col(s).alias("p"))
        for s in SCORES])))
    return rows.groupBy(*by, "score").agg(F.avg("hit").alias("actual"), F.avg("p").alias("predicted"))


def verdict(metrics: DataFrame, by: list[str], metric: str, challenger: str, incumbent: str) -> DataFrame:
    """Mean metric of two models side by side and the lower one's name."""
    wide = metrics.groupBy(*by).pivot("model", [challenger, incumbent]).agg(F.avg(metric))
    better = F.when(F.col(challenger) < F.col(incumbent), F.lit(challenger)).otherwise(F.lit(incumbent))
    return wide.select(*by, F.col(challenger).alias("challenger"), F.col(incumbent).alias("incumbent"),
                       better.alias("winner"))


def leak_violations(provenance: DataFrame) -> DataFrame:
    """One row per contributing date that is not strictly before the match."""
    return (
        provenance.withColumn("offending_source_date", F.explode("source_match_dates"))
        .filter(F.col("offending_source_date") >= F.col("match_date"))
        .select("match_id", "match_date", "offending_source_date")
    )


def exact_medians(df: DataFrame, columns: list[str], bins: int = 4096) -> dict:
    """Medians of columns of any size; None for a column without values (null and NaN count as none).

    Values are read as whole numbers of the same order. Both middle ranks of all columns are narrowed together: a step is one pass
    in which every task counts, for each column's cells that hold a rank, the values by their next bits (``bins`` of them a step). After
    all 64 bits a cell is one value: 6 steps with 4 096 bins, whatever the number of rows.
    """
    each = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    bits = max(1, (bins - 1).bit_length())
    open_: dict[tuple[int, int], tuple[int, int]] = {}   # (column, rank) -> rank inside the cell, leading bits of the cell
    targets, done = [(i, 0) for i in range(len(columns))], 0
    while targets and done < 64:
        width = min(bits, 64 - done)
        counts = _cell_counts(each, targets, done, width)
        if not done:
            for i, n in enumerate(counts.sum(axis=1).astype(int).tolist()):
                open_.update({(i, rank): (rank, 0) for rank in ((n - 1) // 2, n // 2) if n})
        upto, number = np.cumsum(counts, axis=1), {target: t for t, target in enumerate(targets)}
        for key, (rank, lead) in open_.items():
            t = number[key[0], lead]
            cell = int(np.searchsorted(upto[t], rank, "right"))
            open_[key] = (rank - int(upto[t, cell] - counts[t, cell]), (lead << width) + cell)
        done += width
        targets = sorted({(i, lead) for (i, _), (_, lead) in open_.items()})
    out = dict.fromkeys(columns)
    for i, c in enumerate(columns):
        values = [float(value_of(np.array([lead - 2 ** 63]))[0]) for (j, _), (_, lead) in open_.items() if j == i]
        if values:
            out[c] = sum(values) / len(values)
    return out


def _cell_counts(each: DataFrame, targets: list[tuple[int, int]], done: int, width: int) -> np.ndarray:
    """[target, next ``width`` bits]: values of a target's column that begin with its ``done`` bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(targets), 1 << width))
        for batch in batches:
            for i in {i for i, _ in targets}:
                v = np.asarray(batch.column(i).to_numpy(zero_copy_only=False), float)
                key = in_order(v[~np.isnan(v)]).view(np.uint64) ^ np.uint64(2 ** 63)
                for t, (column, lead) in enumerate(targets):
                    if column == i:
                        mine = key[key >> np.uint64(64 - done) == np.uint64(lead)] if done else key
                        cell = (mine >> np.uint64(64 - done - width)) & np.uint64((1 << width) - 1)
                        total[t] += np.bincount(cell.astype(np.int64), minlength=1 << width)
        yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})
    return added(each, run, len(targets) << width, DIRECT + 1).reshape(len(targets), -1)

