"""Drift of features between periods, from mergeable quantile sketches.

A sketch per group, period and feature is one aggregate over the rows and keeps no more than some thousand values. Sketches
of later data merge with kept ones, and every comparison is read from the sketches alone: no values are sorted or read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.operators.ordering import null_safe_join

SKETCH_SIZE = 4096     # exact up to about this many values; beyond, ranks are off by about 1.5 / SKETCH_SIZE ** 0.9
RANKS = 1000           # places at which a sketch is read
CELLS, GRID = 10, 100  # of these, for the index and for the distance
FLOOR = 1e-4           # smallest share of a cell, so that an empty one gives a finite index


def year_period(date: Column, first: int, years: int) -> Column:
    """Number of the period of that many years, 0 from January of ``first``; negative before."""
    return F.floor((F.year(date) - F.lit(first)) / F.lit(years)).cast("int")


def period_sketches(df: DataFrame, features: list[str], period: Column, keys: list[str], size: int = SKETCH_SIZE) -> DataFrame:
    """keys, period, feature, rows, n, sketch: n of the rows have a value (not null, not NaN), and the sketch holds these."""
    value = [F.struct(F.lit(f).alias("feature"), F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(None).cast("double")).alias("v")) for f in features]
    stacked = df.select(*keys, period.alias("period"), F.inline(F.array(*value)))
    return stacked.groupBy(*keys, "period", "feature").agg(
        F.count(F.lit(1)).alias("rows"), F.count("v").alias("n"), F.kll_sketch_agg_double("v", size).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: list[str], size: int = SKETCH_SIZE) -> DataFrame:
    """One sketch per key, period and feature from several, such as those of earlier and of new data."""
    return sketches.groupBy(*keys, "period", "feature").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", size).alias("sketch"))


def drift(sketches: DataFrame, keys: list[str], against: str = "previous") -> DataFrame:
    """keys, feature, period, base, n, base_n, psi, ks, missing: each period against the one before it (or against the first).

    psi: population stability index over the base's deciles. ks: largest distance of the two distribution functions at the
    percentiles of both. missing: change of the share of rows without a value. Periods that have no base are left out; a side
    without any value gives null psi and ks.
    """
    if against not in ("previous", "first"):
        raise ValueError(f"unknown base {against}")
    by = [*keys, "feature"]
    base = sketches.select(*by, F.col("period").alias("base"), F.col("rows").alias("base_rows"), F.col("n").alias("base_n"), F.col("sketch").alias("base_sketch"))
    if against == "previous":
        pairs = null_safe_join(sketches.withColumn("base", F.col("period") - 1), base, [*by, "base"])
    else:
        first = sketches.groupBy(*by).agg(F.min("period").alias("first"))
        pairs = null_safe_join(null_safe_join(sketches, first, by).withColumnRenamed("first", "base").where("period > base"), base, [*by, "base"])
    ranks = F.array(*[F.lit(i / RANKS) for i in range(1, RANKS + 1)])
    full = (F.col("n") > 0) & (F.col("base_n") > 0)
    here, there = F.when(full, F.col("sketch")), F.when(full, F.col("base_sketch"))
    # a sketch gives values at fixed ranks; the rank of a value is the share of these that do not exceed it
    read = pairs.withColumn("_h", F.kll_sketch_get_quantile_double(here, ranks)).withColumn("_t", F.kll_sketch_get_quantile_double(there, ranks))

    def every(values: Column, step: int) -> Column:
        return F.filter(values, lambda x, i: (i + 1) % step == 0)

    def rank(of: Column, among: Column) -> Column:
        return F.transform(of, lambda v: F.size(F.filter(among, lambda x: x <= v)) / F.lit(float(RANKS)))

    cuts = F.slice(every(F.col("_t"), RANKS // CELLS), 1, CELLS - 1)
    grid = F.concat(every(F.col("_h"), RANKS // GRID), every(F.col("_t"), RANKS // GRID))
    ranked = read.withColumns({"_cuts": cuts, "_grid": grid}).withColumns({
        "_a": rank(F.col("_cuts"), F.col("_h")), "_e": rank(F.col("_cuts"), F.col("_t")),
        "_f": rank(F.col("_grid"), F.col("_h")), "_g": rank(F.col("_grid"), F.col("_t"))})

    def share(ranks: Column) -> Column:
        upper = F.concat(ranks, F.array(F.lit(1.0)))
        lower = F.concat(F.array(F.lit(0.0)), ranks)
        return F.zip_with(upper, lower, lambda u, v: F.greatest(u - v, F.lit(FLOOR)))

    cells = F.zip_with(share(F.col("_a")), share(F.col("_e")), lambda a, e: (a - e) * F.ln(a / e))
    apart = F.array_max(F.zip_with("_f", "_g", lambda f, g: F.abs(f - g)))
    return ranked.select(*by, "period", "base", "n", "base_n", F.aggregate(cells, F.lit(0.0), lambda t, x: t + x).alias("psi"), apart.alias("ks"),
                         ((1 - F.col("n") / F.col("rows")) - (1 - F.col("base_n") / F.col("base_rows"))).alias("missing"))
