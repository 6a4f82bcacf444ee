"""Connected components of links, as joins and grouped minima."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.shared import Scratch


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` nodes over the links ``a[i] - b[i]``."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = x[apart], y[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); label is the smallest node reachable.

    Alternating star steps: neighbours above a node are hung on the smallest neighbour, then those below.
    Every step is a grouped minimum (combined before the shuffle) and an equality join, so a node of very
    high degree is never gathered; the links are written after each round. Ends when a round changes no link,
    after a number of rounds that grows with the logarithm of the nodes.
    """
    def hang(pairs: DataFrame) -> DataFrame:
        # pairs (u, v): hang every v of u on the smallest of them
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        hung = pairs.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return hung.where("a <> b").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = state(now)
    while seen[0]:
        # large star: u's larger neighbours go to the smallest of u and its neighbours
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        down = large.select(F.col("a").alias("u"), F.explode(F.array("a", "b")).alias("v"))
        after = scratch.keep(hang(down))
        scratch.drop(now)
        now, before = after, seen
        seen = state(now)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
