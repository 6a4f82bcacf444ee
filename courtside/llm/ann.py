"""Nearest neighbours by learned partitions.

On a bounded sample: the neighbour graph is cut into parts of about equal size with few edges between them, and a small network
learns a vector's part and, apart from that, in which parts its neighbours lie. Every row of the table is put into the part
that the network gives it. A query goes to its most probable parts until their probabilities add up to a
mass that was set on held-out sample rows, and all rows there are ranked by exact inner products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.llm.shared import Scratch

SAMPLE = 16384         # distinct vectors the parts are learned from
PART_ROWS = 2048       # wanted rows of a part; beyond MOST_PARTS parts grow with the table
MOST_PARTS = 256
RECALL = 0.95          # share of held-out neighbours that the routed parts must hold
SLACK = 0.05           # by which parts of the sample may differ from equal size
ROWS, ASKED = 32768, 2048  # vectors and queries that meet in one task


# ---- learning, on the sample -------------------------------------------------------------------------------

def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k largest inner products with other rows, for each row."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        near = x[at:at + 512] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out[at:at + 512] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(near: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Part of every node of the graph node -> near[node]: halves by smoothed values over the graph, then moves that cut fewer edges.

    ``parts`` is a power of two. No part differs from the mean size by more than SLACK.
    """
    n, k = near.shape
    a, b = np.repeat(np.arange(n), k), near.ravel()
    part = np.zeros(n, np.int64)
    level = 1
    while level < parts:
        same = part[a] == part[b]
        u, v = np.r_[a[same], b[same]], np.r_[b[same], a[same]]
        degree = np.bincount(u, minlength=n) + 1.0
        size = np.bincount(part, minlength=level)
        value = rng.standard_normal(n)
        for _ in range(40):  # the second eigenvector of each part's walk, all parts at once
            value = (value + np.bincount(u, value[v], n)) / degree
            value -= (np.bincount(part, value, level) / size)[part]
            value /= np.sqrt(np.bincount(part, value * value, level) / size + 1e-30)[part]
        order = np.lexsort((value, part))
        place = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        upper = np.empty(n, np.int64)
        upper[order] = place >= np.repeat(size // 2, size)
        part = 2 * part + upper
        level *= 2
    most, fewest = int(np.ceil(n / parts * (1 + SLACK))), int(n / parts * (1 - SLACK))
    u, v = np.r_[a, b], np.r_[b, a]
    for _ in range(rounds):
        links = np.bincount(u * parts + part[v], minlength=n * parts).reshape(n, parts)
        own = links[np.arange(n), part].copy()
        links[np.arange(n), part] = -1
        best = links.argmax(axis=1)
        gain = links[np.arange(n), best] - own
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable")[:np.count_nonzero(gain > 0)]:
            # every second mover waits a round, so that neighbours do not change places for ever
            if size[best[i]] < most and size[part[i]] > fewest and rng.random() < 0.5:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


@dataclass
class Router:
    """One hidden layer and two outputs: a vector's own part, and the parts of its neighbours."""

    weights: dict[str, np.ndarray]
    parts: int
    scale: float
    mass: float = 1.0

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x * self.scale @ self.weights["in"] + self.weights["bias"], 0.0)

    def own(self, x: np.ndarray) -> np.ndarray:
        return (self.hidden(x) @ self.weights["own"] + self.weights["own0"]).argmax(axis=1)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return _softmax(self.hidden(x) @ self.weights["near"] + self.weights["near0"])

    def routes(self, x: np.ndarray) -> list[np.ndarray]:
        """For each row the most probable parts that together reach ``mass``."""
        odds = self.odds(x)
        order = np.argsort(-odds, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(odds, order, 1), axis=1) - np.take_along_axis(odds, order, 1)
        return [o[:max(1, np.count_nonzero(b < self.mass))] for o, b in zip(order, before)]


def learn(x: np.ndarray, part: np.ndarray, near: np.ndarray, train: np.ndarray, parts: int, rng: np.random.Generator,
          width: int = 128, epochs: int = 20) -> Router:
    """Fit both outputs on the rows ``train`` by Adam on cross entropy; targets are the own part and the shares of the neighbours' parts."""
    n, d = x.shape
    share = np.zeros((n, parts))
    np.add.at(share, (np.repeat(np.arange(n), near.shape[1]), part[near].ravel()), 1.0 / near.shape[1])
    one = np.eye(parts)[part]
    scale = 1.0 / max(float(np.sqrt((x * x).mean())), 1e-30)
    w = {"in": rng.standard_normal((d, width)) * np.sqrt(2 / d), "bias": np.zeros(width),
         "own": rng.standard_normal((width, parts)) / np.sqrt(width), "own0": np.zeros(parts),
         "near": rng.standard_normal((width, parts)) / np.sqrt(width), "near0": np.zeros(parts)}
    net = Router(w, parts, scale)
    first = {key: np.zeros_like(v) for key, v in w.items()}
    second = {key: np.zeros_like(v) for key, v in w.items()}
    lots = -(-len(train) // 256)
    step, steps = 0, epochs * lots
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(train), lots):
            step += 1
            h = net.hidden(x[rows])
            off_own = (_softmax(h @ w["own"] + w["own0"]) - one[rows]) / len(rows)
            off_near = (_softmax(h @ w["near"] + w["near0"]) - share[rows]) / len(rows)
            back = (off_own @ w["own"].T + off_near @ w["near"].T) * (h > 0)
            grads = {"in": (x[rows] * scale).T @ back, "bias": back.sum(0), "own": h.T @ off_own, "own0": off_own.sum(0),
                     "near": h.T @ off_near, "near0": off_near.sum(0)}
            rate = 3e-3 * (1 - step / (steps + 1))
            for key, g in grads.items():
                first[key] += 0.1 * (g - first[key])
                second[key] += 0.001 * (g * g - second[key])
                w[key] -= rate * (first[key] / (1 - 0.9 ** step)) / (np.sqrt(second[key] / (1 - 0.999 ** step)) + 1e-8)
    return net


def set_mass(net: Router, x: np.ndarray, held: np.ndarray, near: np.ndarray, recall: float) -> None:
    """The smallest mass at which the routed parts hold ``recall`` of the neighbours of the held-out rows."""
    own, odds = net.own(x), net.odds(x[held])
    order = np.argsort(-odds, axis=1, kind="stable")
    sorted_odds = np.take_along_axis(odds, order, 1)
    before = np.empty_like(odds)
    np.put_along_axis(before, order, np.cumsum(sorted_odds, axis=1) - sorted_odds, 1)
    needed = np.sort(np.take_along_axis(before, own[near[held]], 1).ravel())
    # a part is taken if the mass before it is below the bound
    net.mass = float(np.nextafter(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))], 2.0))


def fit(vectors: np.ndarray, rows: int, k: int, recall: float = RECALL, seed: int = 1) -> Router:
    """A router for ``rows`` rows from a sample of them."""
    n, d = vectors.shape
    parts = 1
    while 2 * parts <= min(MOST_PARTS, max(1, rows // PART_ROWS), n // 64):
        parts *= 2
    if parts == 1:
        return Router({"in": np.zeros((d, 1)), "bias": np.zeros(1), "own": np.zeros((1, 1)), "own0": np.zeros(1),
                       "near": np.zeros((1, 1)), "near0": np.zeros(1)}, 1, 1.0)
    rng = np.random.default_rng(seed)
    near = neighbours(vectors, min(k, n - 1))
    part = balanced_parts(near, parts, rng)
    held = rng.random(n) < 0.15
    net = learn(vectors, part, near, np.flatnonzero(~held), parts, rng)
    set_mass(net, vectors, np.flatnonzero(held), near, recall)
    return net


# ---- on Spark ------------------------------------------------------------------------------------------------

def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of an array column of one length and without nulls, as float64."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col("v")
    fine = F.col("id").isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v")).where(F.coalesce(fine, F.lit(False)))


def _shards(counts: DataFrame, parts: int, size: int) -> Column:
    """Shards of each part as an array column, from a table with one row for each part."""
    n = [1] * parts
    for r in counts.collect():
        n[r.p] = -(-r.n // size)
    return F.array(*[F.lit(x) for x in n])


def best(ids: list[np.ndarray], vectors: np.ndarray, asked: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query number, ids, scores) of the k best rows for every query, own ids left out; entries are distinct vectors with their ids."""
    least = np.array([i[0] for i in ids])
    size = np.abs(vectors).sum(axis=1).max()
    for at in range(0, len(asked), 128):
        near = asked[at:at + 128] @ vectors.T
        for q, scores in enumerate(near, at):
            take = min(k + 1, len(scores))
            # products of one block may differ in their last bits from the exact sums below
            edge = np.partition(scores, len(scores) - take)[len(scores) - take] - 1e-12 * size * np.abs(asked[q]).max()
            some = np.flatnonzero(scores >= edge)
            exact = (vectors[some] * asked[q]).cumsum(axis=1)[:, -1]
            some, exact = (x[np.lexsort((least[some], -exact))[:take]] for x in (some, exact))
            all_ids = np.concatenate([ids[i] for i in some])
            all_scores = np.repeat(exact, [len(ids[i]) for i in some])
            other = all_ids != own[q]
            all_ids, all_scores = all_ids[other], all_scores[other]
            first = np.lexsort((all_ids, -all_scores))[:k]
            yield q, all_ids[first], all_scores[first]


def search(df: DataFrame, asked: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE,
           recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that ``asked`` holds for (over ``id_col``), its k best other rows by inner product.

    All rows are indexed; the parts and the router are fitted on at most ``sample`` distinct vectors (those of the smallest
    hashes). Ids are whole numbers. Null ids and vectors that are null, empty, zero or hold a null or a non-finite number take
    no part, and neither do vectors whose length is not the commonest one. Equal vectors are one entry with its
    k + 1 smallest ids, more of which no answer can hold. Ties go to the smaller id. Repeated rows count once; an id with
    several vectors is asked for each of them. Fewer candidates than k are all returned if they lie in the routed parts; with one part, always.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    names = df.withColumn(id_col, F.col(id_col).cast("bigint")).withColumn("_asked", F.coalesce(asked, F.lit(False)))
    found = _usable(names, id_col, vector)
    lengths = found.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if not lengths:
        return spark.createDataFrame([], empty)
    dim = lengths[0].d
    found = found.where(F.size("v") == dim)
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    entries = scratch.keep(found.withColumn("r", place).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")))
    rows = entries.count()
    # the hash picks the sample, so it does not depend on how rows lie in files
    drawn = entries.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).collect()
    net = fit(np.array([r.v for r in drawn], np.float64), rows, k, recall)
    handed = spark.sparkContext.broadcast(net)  # at most (dimension + 2 * MOST_PARTS) * 128 weights

    def own(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(handed.value.own(_matrix(column)) if len(column) else [], pa.int32())

    def routes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(handed.value.routes(_matrix(column)) if len(column) else [], pa.list_(pa.int32()))

    questions = _usable(names.where("_asked"), id_col, vector).where(F.size("v") == dim).distinct()
    questions = scratch.keep(questions.withColumn("qid", F.monotonically_increasing_id()).withColumn(
        "p", F.explode(F.arrow_udf(routes, "array<int>").asNondeterministic()("v"))))
    placed = scratch.keep(entries.withColumn("p", F.arrow_udf(own, "int").asNondeterministic()("v")))
    shards = _shards(placed.groupBy("p").agg(F.count(F.lit(1)).alias("n")), net.parts, ROWS)
    lots = _shards(questions.groupBy("p").agg(F.count(F.lit(1)).alias("n")), net.parts, ASKED)

    def deal(key: str, number: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.element_at(number, F.col("p") + 1)).cast("int")

    def every(number: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), F.element_at(number, F.col("p") + 1) - 1))

    left = placed.select("p", "v", "ids", deal("v", shards).alias("s")).withColumn("b", every(lots))
    right = questions.select("p", "qid", "id", "v", deal("qid", lots).alias("b")).withColumn("s", every(shards))

    def meet(key: tuple[Any, ...], here: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(here) or not len(asking):
            return pd.DataFrame({"qid": [], "query_id": [], "vec_id": [], "score": []})
        query, own_ids = asking["qid"].to_numpy(), asking["id"].to_numpy()
        got = list(best(list(here["ids"]), np.stack(here["v"].to_list()).astype(np.float64),
                        np.stack(asking["v"].to_list()).astype(np.float64), own_ids, k))
        number = np.repeat([q for q, _, _ in got], [len(i) for _, i, _ in got]).astype(np.int64)
        return pd.DataFrame({"qid": query[number], "query_id": own_ids[number], "vec_id": np.concatenate([i for _, i, _ in got]),
                             "score": np.concatenate([s for _, _, s in got])})

    met = left.groupBy("p", "s", "b").cogroup(right.groupBy("p", "s", "b")).applyInPandas(
        meet, "qid bigint, query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
