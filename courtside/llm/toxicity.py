"""Toxicity scores: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed character n-grams (3 to 5, with word edges) of its distinct words; a feature's value is
log2(1 + the number of distinct words that hold it). Each is scaled by the log ratio of its smoothed shares of the texts of either
class, which is zero unless the shares differ by ``LEAST_Z`` standard errors; a logistic regression with a
ridge penalty is fitted to the scaled features.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.shared import Scratch, free_name, in_fold, with_struct

BITS = 18
ORDERS = (3, 4, 5)
SAMPLE = (5000, 2500)  # labelled texts without and with the label that the fit sees at most
LEAST_Z = 3.5
_SLOTS = (1 << BITS) - 1


_NONE = np.zeros(0, np.int32)


class Features:
    """Feature numbers of a text with the number of its words that hold each, as ``number << 32 | words``.

    With ``wanted`` (booleans by number) only those are looked at. A word's features are kept, up to a bound on words.
    """

    KEEP = 200_000
    _words = re.compile(r"[^\W_]+").findall

    def __init__(self, wanted: np.ndarray | None = None):
        self.wanted = None if wanted is None else frozenset(np.flatnonzero(wanted).tolist())
        self.known: dict[str, np.ndarray] = {}
        self.telling: set[str] = set()     # known words that have features at all

    def _learn(self, words: set[str]) -> None:
        fresh = words.difference(self.known)
        if len(self.known) + len(fresh) > self.KEEP:
            self.known.clear()
            self.telling.clear()
            fresh = words
        for word in fresh:
            padded = f" {word} ".encode("utf-8", "surrogatepass") if word.isascii() else f" {word} "
            grams = {padded[i:i + n] for n in ORDERS for i in range(len(padded) - n + 1)}
            if isinstance(padded, str):
                grams = {g.encode("utf-8", "surrogatepass") for g in grams}
            slots = {zlib.crc32(g) & _SLOTS for g in grams}
            if self.wanted is not None:
                slots &= self.wanted
            self.known[word] = np.array(sorted(slots), np.int32) if slots else _NONE
            if slots:
                self.telling.add(word)

    def of(self, text: str | None) -> np.ndarray:
        words = set(self._words(text.lower())) if text else set()
        self._learn(words)
        known = self.known
        parts = [known[w] for w in words & self.telling]
        if not parts:
            return np.zeros(0, np.int64)
        seen = np.concatenate(parts)
        seen.sort()
        edge = np.flatnonzero(np.r_[True, seen[1:] != seen[:-1]])
        return seen[edge].astype(np.int64) << 32 | np.diff(np.r_[edge, len(seen)])


_WORDS = (1 << 32) - 1


@dataclass
class Model:
    """Weights already multiplied by the log-count ratios."""

    weight: np.ndarray
    bias: float

    def score(self, found: np.ndarray) -> float:
        z = self.bias + float((self.weight[found >> 32] * np.log2(1 + (found & _WORDS))).sum())
        return float(1 / (1 + np.exp(-min(max(z, -500), 500))))


def fit_rows(rows: list[np.ndarray], label: np.ndarray, ridge: float = 1.0, steps: int = 1500) -> Model:
    """Naive Bayes ratios, then logistic regression by accelerated gradient steps."""
    size, n = 1 << BITS, len(rows)
    if not n or label.min() == label.max():
        return Model(np.zeros(size), 4.0 if n and label[0] == 1 else -4.0)
    with_, without = label.sum(), n - label.sum()
    counts = np.zeros((2, size))  # by label; a text has a feature once
    for r, y in zip(rows, label):
        counts[int(y), r >> 32] += 1
    neg, pos = counts
    share = (pos + neg) / n
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / with_ + 1 / without))
    ratio = np.log((pos + 1) / (with_ + 2)) - np.log((neg + 1) / (without + 2))
    ratio[np.abs(pos / with_ - neg / without) < LEAST_Z * error] = 0
    telling = [r[ratio[r >> 32] != 0] for r in rows]  # few of all, so only these are held as numbers
    found = np.concatenate(telling)
    doc = np.repeat(np.arange(n), [len(r) for r in telling])
    value = ratio[found >> 32] * np.log2(1 + (found & _WORDS))
    kept, index = np.unique(found >> 32, return_inverse=True)
    ridge /= n
    step = 1 / (0.25 * float((value ** 2).sum()) / n + 0.25 + ridge)
    w, b = np.zeros(len(kept)), 0.0
    ahead, ahead_b = w, b
    for k in range(steps):
        z = ahead_b + np.bincount(doc, value * ahead[index], n)
        off = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - label) / n
        nw = ahead - step * (np.bincount(index, value * off[doc], len(kept)) + ridge * ahead)
        nb = ahead_b - step * float(off.sum())
        ahead, ahead_b = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
        w, b = nw, nb
    weight = np.zeros(size)
    weight[kept] = w * ratio[kept]
    return Model(weight, b)


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic",
        sample: tuple[int, int] = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows without and with the label, those first in the order of a hash of the id.

    The bound keeps the fit in one task; features are made where the rows are. Rows with a null id, label or text are
    not learned from. Repeated rows count each; if ids repeat among the documents, those of the smallest hashes of
    their features are taken up to the bound. Without labelled rows of both classes the scores are constant.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    order = F.xxhash64("id")
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(order, "id").limit(sample[y])
        chosen = part if chosen is None else chosen.union(part)
    read = documents.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("text is not null")
    rows = read.join(F.broadcast(chosen), "id").select("y", "text")  # at most sum(sample) ids
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features = Features()
        for column in batches:
            yield pa.array([features.of(t.as_py()).tobytes() for t in column], pa.binary())

    scratch = Scratch(documents.sparkSession)
    found = scratch.keep(with_struct(rows, "f", work, "binary", F.col("text")).select("y", "f"))  # read for both labels
    bounded = None
    for y in (0, 1):  # ids may repeat among the documents
        part = found.where(F.col("y") == y).orderBy(F.xxhash64("f"), "f").limit(sample[y])
        bounded = part if bounded is None else bounded.union(part)
    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["y", "f"], kind="stable")
        model = fit_rows([np.frombuffer(f, np.int64) for f in part["f"]], part["y"].to_numpy(np.float64))
        return pd.DataFrame({"w": [model.weight.astype(np.float32).tobytes()], "b": [model.bias]})

    got = bounded.withColumn("all", F.lit("one")).groupBy("all").applyInPandas(train, "w binary, b double").collect()
    scratch.drop(found)
    if not got:
        return fit_rows([], np.zeros(0))
    return Model(np.frombuffer(got[0].w, np.float32).astype(np.float64), got[0].b)


def with_score(df: DataFrame, model: Model, name: str = "toxicity", text: str = "text") -> DataFrame:
    """Add the score (0 to 1). Null and empty texts have no features and get the score of the bias alone."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        features = Features(model.weight != 0)
        for column in batches:
            yield pa.array([model.score(features.of(t.as_py())) for t in column], pa.float64())

    return with_struct(df, name, work, "double", F.col(text))


def train_fold(documents: DataFrame, labels: DataFrame, mod: int = 5, rest: int = 0, id_col: str = "doc_id") -> Model:
    """Fit on the labelled rows whose id is not in the held-out fold."""
    return fit(documents, labels.where(~in_fold(F.col(id_col), mod, rest)), id_col=id_col)


def clean(df: DataFrame, model: Model, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows that score below ``limit``, all columns kept."""
    mark = free_name(df, "_toxicity")
    return with_score(df, model, mark, text).where(F.col(mark) < limit).drop(mark)
