"""Connected groups of links, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.operators.ordering import null_safe_join
from courtside.session import cut, forget


def connected_groups(links: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, label for every node of ``links`` (keys, a, b): label is the smallest node that can be reached from it.

    In turn, the larger neighbours of each node are hung on its smallest neighbour, and then its smaller ones, until no link moves: a
    number of rounds that grows with the logarithm of the nodes. Every step is a grouped minimum and an equality join, so a
    node with very many links is not gathered. Links to a null are left out.
    """
    known = links.where("a IS NOT NULL AND b IS NOT NULL")
    nodes = cut(known.select(*keys, F.explode(F.array("a", "b")).alias("node")).distinct())
    now = cut(known.where("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first())

    def hung(pairs: DataFrame) -> DataFrame:
        """(node, to) pairs: every ``to`` above its node goes to the smallest of the node and its neighbours."""
        least = pairs.groupBy(*keys, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return null_safe_join(pairs, least, [*keys, "u"])

    seen = state(now)
    while seen[0]:
        both = now.select(*keys, F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(*keys, F.col("b").alias("u"), F.col("a").alias("v")))
        large = hung(both).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("w")).distinct()
        down = large.select(*keys, "u", F.explode(F.array("u", "w")).alias("v"))
        after = cut(hung(down).where("v <> m").select(*keys, F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        forget(now)
        before, seen, now = seen, state(after), after
        if seen == before:
            break
    label = now.select(*keys, F.col("a").alias("node"), F.col("b").alias("label"))
    return null_safe_join(nodes, label, [*keys, "node"], "left").withColumn("label", F.coalesce("label", "node"))
