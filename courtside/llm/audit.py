"""How filters interact: what every order of them removes, from one pass over truth-table words.

A document becomes a 32-bit word with a bit for every subset of five filters: set if the document survives that subset.
Positional popcounts of the words, kept by carry-save adders, give the survivors of all subsets for a part and a label,
and these give every order, step and Shapley value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.llm.shared import Scratch

WIDTH = 5
# Bit s of word f: a document failing the filters of f survives the subset s.
WORDS = np.array([sum(1 << s for s in range(1 << WIDTH) if not f & s) for f in range(1 << WIDTH)], np.uint32)
REPORT = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
          "good_lost bigint, toxic_lost bigint, shapley bigint")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")


# Failure conditions of a text; the fifth filter, E, is the copy rule of ``failures``.
RULES: dict[str, Callable[[Column], Column]] = {
    "A": lambda t: F.size(_words(t)) < 100,
    "B": lambda t: 100 * F.size(F.array_distinct(_words(t))) < 80 * F.size(_words(t)),
    "C": lambda t: 100 * (F.char_length(t) - F.char_length(F.regexp_replace(t, "[A-Z]", ""))).cast("bigint") > 10 * F.char_length(t),
    "D": lambda t: t.rlike(r"[#$%&*|]"),
}


class Tally:
    """Counts of set bits by position: word number b holds bit b of every position's count.

    Three words of one weight become a sum word and a carry word of twice the weight until one word of each weight is left.
    """

    def __init__(self):
        self.level: list[np.uint32] = []

    def add(self, words: np.ndarray, times: np.ndarray) -> None:
        carries: list[np.ndarray] = []
        level = 0
        while level < len(self.level) or carries or (times >> level).any():
            kept = self.level[level:level + 1]
            now = np.concatenate([np.array(kept, np.uint32), words[(times >> level) & 1 == 1], *carries])
            carries = []
            while len(now) > 1:
                third = len(now) // 3
                if third:
                    a, b, c = now[:third], now[third:2 * third], now[2 * third:3 * third]
                    half = a ^ b
                    carries.append((a & b) | (half & c))
                    now = np.concatenate([half ^ c, now[3 * third:]])
                else:
                    carries.append(now[:1] & now[1:])
                    now = now[:1] ^ now[1:]
            value = now[0] if len(now) else np.uint32(0)
            if kept:
                self.level[level] = value
            else:
                self.level.append(value)
            level += 1

    def counts(self) -> np.ndarray:
        total = np.zeros(1 << WIDTH, np.int64)
        for weight, word in enumerate(self.level):
            total += ((int(word) >> np.arange(1 << WIDTH)) & 1) << weight
        return total


def failures(docs: DataFrame, labels: DataFrame, id_col: str, text: str, part: str, rules: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(part, good, toxic, fails, n): rows by the bits of the filters they fail, E being the last bit.

    Equal rows are counted before every shuffle. Texts are told apart by their SHA-256, so a text with very many copies is as many
    rows as it has parts and labels when its smallest id is looked for.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    bits = sum((F.when(rule(F.col("t")), 1 << i).otherwise(0) for i, rule in enumerate(rules.values())), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("t"))
    rows = rows.select("id", "part", bits.alias("fails"), F.unhex(F.sha2("t", 256)).alias("digest"))
    rows = rows.groupBy("id", "part", "fails", "digest").agg(F.count(F.lit(1)).alias("n"))
    # null ids match no label; the second key deals them out
    rows = rows.withColumn("deal", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(0))
    marks = (labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                  F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).withColumn("deal", F.lit(0).cast("bigint")))
    rows = rows.join(marks, ["id", "deal"], "left").select(
        "id", "part", "fails", "digest", "n", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")])
    alike = rows.groupBy("digest", "part", "good", "toxic", "fails").agg(
        F.sum("n").alias("n"), F.min("id").alias("low"), F.min_by("n", "id").alias("n_low"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"))
    least = F.min("low").over(Window.partitionBy("digest"))
    first = F.when(F.col("low") == least, F.col("n_low")).otherwise(0) + F.col("no_id")
    copies = 1 << len(rules)
    split = F.explode(F.array(F.struct(F.col("fails"), F.col("first").alias("n")),
                              F.struct((F.col("fails") + copies).alias("fails"), (F.col("n") - F.col("first")).alias("n"))))
    found = alike.withColumn("first", first).select("part", "good", "toxic", split.alias("s"))
    return found.select("part", "good", "toxic", "s.fails", "s.n").where("n > 0")


def survivors(rows: DataFrame) -> DataFrame:
    """(part, label, subset, n) from (part, good, toxic, fails, n): rows that survive each subset, by part, for the labels all, good and toxic."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[tuple[str, str], Tally] = {}
        for batch in batches:
            frame = batch.to_pandas()
            for part, some in frame.groupby("part", sort=False):
                words, times = WORDS[some["fails"].to_numpy()], some["n"].to_numpy(np.int64)
                for label in ("all", "good", "toxic"):
                    mine = slice(None) if label == "all" else some[label].to_numpy(bool)
                    tallies.setdefault((part, label), Tally()).add(words[mine], times[mine])
        for (part, label), tally in tallies.items():
            yield pa.RecordBatch.from_pydict({"part": [part] * 32, "label": [label] * 32, "subset": pa.array(range(32), pa.int32()),
                                              "n": pa.array(tally.counts(), pa.int64())})

    parts = rows.mapInArrow(count, "part string, label string, subset int, n bigint")
    return parts.groupBy("part", "label", "subset").agg(F.sum("n").alias("n"))


def report(counts: DataFrame, names: str) -> DataFrame:
    """All orders and steps of the filters ``names`` for every part of ``survivors``."""
    full = (1 << WIDTH) - 1
    share = [factorial(bin(s).count("1")) * factorial(WIDTH - 1 - bin(s).count("1")) if s != full else 0 for s in range(full + 1)]

    def orders(rows: pd.DataFrame) -> pd.DataFrame:
        by = {label: some.set_index("subset")["n"].reindex(range(full + 1)).to_numpy() for label, some in rows.groupby("label")}
        every, good, toxic = by["all"], by["good"], by["toxic"]
        value = [sum(share[s] * int(every[s] - every[s | 1 << f]) for s in range(full + 1) if not s >> f & 1) for f in range(WIDTH)]
        out = []
        for order in permutations(range(WIDTH)):
            before = 0
            for step, f in enumerate(order, 1):
                after = before | 1 << f
                removed = every[before] - every[after]
                out.append((rows["part"].iloc[0], "".join(names[i] for i in order), step, every[after], removed,
                            every[0] - every[1 << f] - removed, every[full & ~(1 << f)] - every[full],
                            good[before] - good[after], toxic[before] - toxic[after], value[f]))
                before = after
        return pd.DataFrame(out, columns=[c.split()[0] for c in REPORT.split(", ")])

    return counts.groupBy("part").applyInPandas(orders, REPORT)


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang",
                 rules: dict[str, Callable[[Column], Column]] = RULES) -> DataFrame:
    """One row per part, order and step of the four ``rules`` and the copy rule E.

    A null text is an empty one, a null part the empty string. E fails a row whose text a smaller id has anywhere in the table; rows of
    one id do not fail each other, and a row without an id neither fails nor makes others fail. A label counts if any
    label row of the id has it. No documents give no rows.
    """
    if len(rules) != WIDTH - 1:
        raise ValueError(f"{WIDTH - 1} rules beside the copy rule are needed")
    rows = failures(docs, labels, id_col, text, part, rules)
    return report(Scratch(docs.sparkSession).keep(survivors(rows)), "".join(rules) + "E")
