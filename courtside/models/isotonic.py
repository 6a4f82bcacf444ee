"""Monotone calibration, kept away from 0 and 1.

Distinct probabilities are cut into ranges; a task pools the neighbours that fall in its range and hands on what is left. Ranges are cut anew, at
other places, until no two blocks on either side of a border are in the wrong order, which is the isotonic fit: the order in which neighbours are
pooled does not matter. Levels stay a table, and probabilities find theirs by an equality join on ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtside.session import cut, forget

PIECE = 200_000        # blocks that a task pools at a time
RANGES = 2048          # of the lookup
_BLOCKS = "lo double, hi double, w double, s double, part int, edge boolean"


def pool(lo: np.ndarray, hi: np.ndarray, w: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbouring blocks (first and last value, weight, weighted sum) merged while a mean is not above the one before it."""
    out: list[list[float]] = []
    for block in zip(lo.tolist(), hi.tolist(), w.tolist(), s.tolist()):
        now = list(block)
        while out and out[-1][3] * now[2] >= now[3] * out[-1][2]:
            before = out.pop()
            now = [before[0], now[1], before[2] + now[2], before[3] + now[3]]
        out.append(now)
    return tuple(np.array(x) for x in zip(*out)) if out else (np.zeros(0),) * 4


def _pooled(blocks: DataFrame, parts: int) -> DataFrame:
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = [f for f in frames if len(f)]  # one range: about PIECE blocks
        if mine:
            frame = pd.concat(mine)
            lo, hi, w, s = pool(*(frame[c].to_numpy() for c in ("lo", "hi", "w", "s")))
            edge = np.zeros(len(lo), bool)
            edge[[0, -1]] = True
            yield pd.DataFrame({"lo": lo, "hi": hi, "w": w, "s": s, "part": int(frame["part"].iloc[0]), "edge": edge})

    ranged = blocks.select("lo", "hi", "w", "s")
    ranged = (ranged.repartitionByRange(parts, "lo") if parts > 1 else ranged.repartition(1)).sortWithinPartitions("lo")
    return ranged.withColumn("part", F.spark_partition_id()).mapInPandas(work, _BLOCKS)


def isotonic_blocks(merged: DataFrame, piece: int = PIECE) -> DataFrame:
    """lo, hi, w, s, part, edge from distinct values with weight and weighted sum (p, w, s): the blocks of the isotonic fit.

    ``part`` numbers runs of neighbouring blocks in order, ``edge`` marks each run's first and last one.
    """
    blocks = cut(merged.select(F.col("p").alias("lo"), F.col("p").alias("hi"), "w", "s"))
    turn = 0
    while True:
        parts = max(1, -(-blocks.count() // piece))
        after = cut(_pooled(blocks, parts + (turn % 3 if parts > 1 else 0)))
        forget(blocks)
        blocks = after
        if parts == 1:
            return blocks
        # two rows a range
        ends = Window.orderBy("lo")
        mean = F.col("s") / F.col("w")
        wrong = blocks.where("edge").withColumn("ok", F.coalesce(F.lag(mean).over(ends) < mean, F.lit(True))).where("NOT ok")
        if wrong.isEmpty():
            return blocks
        turn += 1


class Isotonic:
    """Isotonic fit; its levels are clipped first, then interpolated, then held beyond the ends."""

    def __init__(self, low: float = 0.02, high: float = 0.98, piece: int = PIECE):
        self.low, self.high, self.piece = low, high, piece
        self.segments: DataFrame | None = None
        self.splits: list[float] = []

    def fit(self, rows: DataFrame) -> Isotonic:
        """Rows with a null p or y are left out; with one class only the fit is the identity."""
        known = rows.select(F.col("p").cast("double").alias("p"), F.col("y").cast("double").alias("y")).dropna()
        merged = known.groupBy("p").agg(F.count("*").cast("double").alias("w"), F.sum("y").alias("s"))
        if known.agg(F.count_distinct("y")).first()[0] < 2:
            return self
        blocks = isotonic_blocks(merged, self.piece)
        level = F.least(F.greatest(F.col("s") / F.col("w"), F.lit(self.low)), F.lit(self.high))
        table = blocks.select("lo", "hi", level.alias("level"), "part")
        # what follows a block: in its run, or as the first block of the next run (a row a run)
        run = Window.partitionBy("part").orderBy("lo")
        firsts = table.groupBy("part").agg(F.min_by(F.struct("lo", "level"), "lo").alias("first"))
        follows = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("next_run"),
                                (F.row_number().over(Window.orderBy("part")) == 1).alias("start"))
        linked = table.withColumn("next", F.lead(F.struct("lo", "level")).over(run)).withColumn("place", F.row_number().over(run))
        linked = linked.join(follows, "part").withColumn("next", F.coalesce("next", "next_run"))
        begin = F.when(F.col("start") & (F.col("place") == 1), F.lit(float("-inf"))).otherwise(F.col("lo"))
        self.splits = sorted(set(blocks.agg(F.percentile_approx("lo", [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0]))
        ranged = self._range(linked.select(begin.alias("begin"), "hi", "level", F.coalesce(F.col("next.lo"), F.lit(float("inf"))).alias("end"),
                                           F.col("next.level").alias("end_level")), "begin", "from")
        ranged = self._range(ranged, "end", "to")
        self.segments = cut(ranged.withColumn("range", F.explode(F.sequence("from", "to"))).drop("from", "to"))
        forget(blocks)
        return self

    def _range(self, df: DataFrame, column: str, out: str) -> DataFrame:
        """Number of the lookup range of each value."""
        if not self.splits:
            return df.withColumn(out, F.lit(0))
        ranges = Bucketizer(splits=[float("-inf"), *self.splits, float("inf")], inputCol="_v", outputCol="_r", handleInvalid="keep")
        # the last range includes its upper end
        ranged = ranges.transform(df.withColumn("_v", F.col(column).cast("double")))
        return ranged.withColumn(out, F.col("_r").cast("int")).drop("_v", "_r")

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        """A null or NaN p gives null."""
        if self.segments is None:
            return df.withColumn(out, F.col("p"))
        p = F.nanvl(F.col("p").cast("double"), F.lit(None).cast("double"))
        ranged = self._range(df.withColumn("_p", p), "_p", "_range")
        here = (F.col("_range") == F.col("_s.range")) & (F.col("_p") >= F.col("_s.begin")) & (F.col("_p") < F.col("_s.end"))
        met = ranged.join(self.segments.select(F.struct("*").alias("_s")), here, "left")
        slope = F.try_divide(F.col("_p") - F.col("_s.hi"), F.col("_s.end") - F.col("_s.hi"))
        level = F.col("_s.level") + F.when((F.col("_p") > F.col("_s.hi")) & F.col("_s.end_level").isNotNull(),
                                           slope * (F.col("_s.end_level") - F.col("_s.level"))).otherwise(0.0)
        return met.withColumn(out, level).drop("_s", "_p", "_range")
