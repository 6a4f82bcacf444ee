"""Near-duplicates by SimHash fingerprints and BK-trees.

A fingerprint's bit is set if it is set in over half of the hashes of the text's shingles. Fingerprints within a
few differing bits are linked, and a document's component is what can be reached over links.

Shard trees: 64 bits are cut into ``radius + 2`` blocks, of which a linked pair has at least two in common; every choice of
two blocks and their bits names a bucket, and each bucket holds BK-trees over its fingerprints. A bucket
over ``SHARD`` fingerprints is dealt out to several trees, and each tree meets the queries of every shard of
that bucket, so no task holds more than two shards at a time. Equal fingerprints are one entry.
A search goes only along the edges whose distance differs from the query's by at most the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.llm.graph import components, local_labels
from courtside.llm.shared import Scratch, free_name, utf8, with_struct

SHARD = 1024
CHUNK = 32768  # rows of many small buckets that are searched together


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text; zero without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(g, 42) for g in grams]), np.uint8).reshape(-1, 8)
    bits = np.zeros(64, np.int64)
    for part in range(0, len(raw), 65536):
        bits += np.unpackbits(raw[part:part + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(raw)).tobytes(), "big", signed=True)


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "simhash", width: int = 4) -> DataFrame:
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([fingerprint(t, width) for t in utf8(column)], pa.int64())

    return with_struct(df, name, work, "bigint", F.col(text))


class Forest:
    """BK-trees over the groups of an array: ``root[i]`` is the first node of i's group.

    ``child[node, d]`` is the child at distance d, or -1. All trees grow together, a level at a time.
    """

    def __init__(self, prints: np.ndarray, root: np.ndarray, members: np.ndarray):
        self.prints = prints
        self.child = np.full((len(prints), 65), -1, np.int32)
        flat = self.child.reshape(-1)
        left = members[root[members] != members]
        node = root[left]
        while left.size:
            slot = node * 65 + np.bitwise_count(prints[left] ^ prints[node])
            first = np.unique(slot, return_index=True)
            flat[first[0]] = left[first[1]]
            node = flat[slot].astype(np.int64)
            rest = node != left
            left, node = left[rest], node[rest]

    def within(self, query: np.ndarray, start: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) at most ``radius`` apart, each tree searched from ``start``."""
        found, flat = [], self.child.reshape(-1)
        while query.size:
            apart = np.bitwise_count(self.prints[query] ^ self.prints[start]).astype(np.int64)
            hit = (apart <= radius) & (query != start)
            found.append((query[hit], start[hit]))
            nq, nn = [], []
            for edge in range(-radius, radius + 1):
                at = apart + edge
                ok = (at > 0) & (at <= 64)
                below = flat[start[ok] * 65 + at[ok]]
                there = below >= 0
                nq.append(query[ok][there])
                nn.append(below[there].astype(np.int64))
            query, start = np.concatenate(nq), np.concatenate(nn)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _links(unit: np.ndarray, prints: np.ndarray, role: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside the units; role 0 is searched and searches, 1 is searched, 2 searches."""
    n = len(unit)
    in_tree = role != 2
    new = np.r_[True, unit[1:] != unit[:-1]]
    group = np.cumsum(new) - 1
    trees = np.flatnonzero(in_tree)
    first = np.full(group[-1] + 1, -1, np.int64)
    first[group[trees][::-1]] = trees[::-1]
    root = first[group]
    forest = Forest(prints, root, trees)
    asks = np.flatnonzero((role != 1) & (root >= 0))
    size = np.bincount(group[trees], minlength=group[-1] + 1)[group[asks]]
    label = np.arange(n)
    lot = np.cumsum(size) // 500_000  # how many nodes a lot of queries can visit at most
    for part in np.split(asks, np.flatnonzero(np.diff(lot)) + 1):
        if part.size:
            a, b = forest.within(part, root[part], radius)
            label = local_labels(n, np.r_[a, np.arange(n)], np.r_[b, label])
    moved = np.flatnonzero(label != np.arange(n))
    return prints[moved], prints[label[moved]]


def _search(radius: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        def answer(rows):
            a, b = _links(rows[0], rows[1].view(np.uint64), rows[2], radius)
            return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})
        for batch in batches:
            rows = [np.asarray(c) for c in batch.columns]
            held = rows if held is None else [np.r_[x, y] for x, y in zip(held, rows)]
            if len(held[0]) >= CHUNK:  # whole units only: the last one may go on in the next batch
                end = np.searchsorted(held[0], held[0][-1])
                if end:
                    yield answer([x[:end] for x in held])
                    held = [x[end:] for x in held]
        if held is not None and len(held[0]):
            yield answer(held)
    return search


def _buckets(value: Column, radius: int) -> Column:
    """One number for every choice of two of ``radius + 2`` blocks: the choice and the bits of both."""
    count = radius + 2
    edges = [round(i * 64 / count) for i in range(count + 1)]
    block = [(F.shiftrightunsigned(value, lo).bitwiseAND((1 << (hi - lo)) - 1), hi - lo) for lo, hi in zip(edges, edges[1:])]
    keys = []
    for k, (i, j) in enumerate(combinations(range(count), 2)):
        keys.append(F.shiftleft(F.shiftleft(F.lit(k).cast("bigint"), block[i][1]).bitwiseOR(block[i][0]), block[j][1]).bitwiseOR(block[j][0]))
    return F.array(*keys)


def links(prints: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """(a, b): links between the distinct fingerprints (column ``fp``) that join up all that is within the radius."""
    keyed = prints.select("fp", F.explode(_buckets(F.col("fp"), radius)).alias("bucket"))
    crowded = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shards = F.ceil(F.col("n") / SHARD).cast("int")
    met = (keyed.join(crowded, "bucket")
           .withColumn("k", shards).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
           .select("fp", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
                   F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("role")))
    dealt = met.repartition("unit").sortWithinPartitions("unit", "fp").select("unit", "fp", "role")
    return scratch.keep(dealt.mapInArrow(_search(radius), "a bigint, b bigint"))


def _placed(df: DataFrame, id_col: str, text: str, radius: int, width: int, scratch: Scratch) -> DataFrame:
    """(id, row, fp, component): every row with its row key and the fingerprint's component number."""
    read = df.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text).alias("row"), F.col(text).alias("text"))
    made = scratch.keep(with_fingerprint(read, "text", "fp", width).drop("text"))
    own = scratch.keep(made.groupBy("fp").agg(F.min("id").alias("least")))
    found = links(own, radius, scratch)
    labels = components(found, scratch)
    placed = own.join(labels, own.fp == labels.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("top"))
    tops = placed.groupBy("top").agg(F.min("least").alias("component"))
    places = scratch.keep(placed.join(tops, "top").select("fp", "top", "component"))
    scratch.drop(found)
    scratch.drop(own)
    return made.join(places, "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 4, width: int = 4) -> DataFrame:
    """(id, simhash, component): one row per row of ``df``; component is the smallest id reachable over links.

    Null texts and texts without words have fingerprint zero and are linked like any other. Repeated rows stay. A null id is
    passed over when the smallest is taken (null only if a whole component has no id). Other columns are not read.
    """
    out = _placed(df, id_col, text, radius, width, Scratch(df.sparkSession))
    return out.select(F.col("id").alias(id_col), F.col("fp").alias("simhash"), "component")


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 4, width: int = 4) -> DataFrame:
    """One row of ``df`` for each near-duplicate component: the one with the smallest id (rows without an id come last).

    Ties between rows of one id go by a hash of id and text; of wholly repeated rows one stays. All columns are kept.
    """
    placed = _placed(df, id_col, text, radius, width, Scratch(df.sparkSession))
    first = placed.groupBy("top").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"))
    mark = free_name(df, "_row")
    chosen = first.select(F.col("first.row").alias(mark))
    rows = df.withColumn(mark, F.xxhash64(id_col, text)).join(chosen, mark, "left_semi")
    return rows.dropDuplicates([mark]).drop(mark)
