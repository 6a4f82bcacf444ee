"""Language identification with a bit-sliced Bloom filter over character n-grams.

One row of bits per filter position, one bit per language: the AND of an n-gram's rows gives all languages that contain
it. A text's n-grams are looked up, hits are counted per language, corrected for the share of hits that the filter's
fill would give by chance, and the language with the largest corrected share wins.

A language contains an n-gram if it is a fair part of the language's n-grams and not far rarer there than in the
language where it is commonest, so passages quoted in another language do not fill its filter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.shared import Scratch, free_name, in_fold, with_struct

ORDERS = (2, 3, 4)
POSITIONS = 1 << 19
HASHES = 3
LEAST_SHARE = 2e-5     # of a language's n-grams; so a language has at most 50 000
RIVAL = 0.15           # of the largest share that any language has
UNKNOWN = "und"

# numbers that the class \w takes for letters, such as one half or a Roman eight
_NUMBERS = "".join(c for c in map(chr, range(128, 0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_WORDS = re.compile(rf"[^\W\d_{_NUMBERS}]+").findall
_RUNS = re.compile(r"[^\W\d_]+").findall


def _words(text: str) -> list[str]:
    """Maximal runs of letters. The long class of numbers is slow, and only runs that hold one need it."""
    runs = _RUNS(text)
    return runs if "".join(runs).isalpha() else [w for r in runs for w in ([r] if r.isalpha() else _WORDS(r))]


def gram_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 60-bit number for every n-gram of the words (with a space before and after each), and the word it is in."""
    text = "".join(f" {w} " for w in words)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    word = np.repeat(np.arange(len(words)), size)
    keys, owners = [], []
    for n in ORDERS:
        last = len(code) - n + 1
        inside = np.flatnonzero(word[:max(last, 0)] == word[n - 1:]) if last > 0 else np.zeros(0, np.int64)
        key = np.full(len(inside), n, np.uint64)
        for k in range(n):
            key = key * np.uint64(0x9E3779B97F4A7C15) + code[inside + k]
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(32)
        keys.append((key & np.uint64((1 << 60) - 1)).astype(np.int64))  # sums of positions stay within 63 bits
        owners.append(word[inside])
    return np.concatenate(keys), np.concatenate(owners)


@dataclass
class Filter:
    """``bits[position, lane]``: 63 languages a lane; ``chance[language]``: share of n-grams hit by accident."""

    languages: list[str]
    bits: np.ndarray
    chance: np.ndarray

    def member(self, keys: np.ndarray) -> np.ndarray:
        """(n-grams, languages) booleans: the languages that contain each n-gram."""
        found = self.bits[keys % POSITIONS]
        for k in range(1, HASHES):
            found = found & self.bits[(keys // POSITIONS * (2 * k + 1) + keys * k) % POSITIONS]
        number = np.arange(len(self.languages))
        return (found[:, number // 63] >> (number % 63)) & 1 == 1


class Counts:
    """Popcounts per language of a text, over kept rows of its words."""

    KEEP = 100_000

    def __init__(self, model: Filter):
        self.model, self.row = model, {}
        self.table = np.zeros((1024, len(model.languages) + 1), np.float64)

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.row]
        if len(self.row) + len(new) > self.KEEP:
            self.row, new = {}, list(words)
        if not new:
            return
        keys, word = gram_keys(new)
        hit = self.model.member(keys)
        start = len(self.row)
        while start + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for k in range(hit.shape[1]):
            self.table[start:start + len(new), k] = np.bincount(word[hit[:, k]], minlength=len(new))
        self.table[start:start + len(new), -1] = np.bincount(word, minlength=len(new))
        self.row.update(zip(new, range(start, start + len(new))))

    def of(self, text: str | None) -> np.ndarray | None:
        """Hits per language and the number of n-grams; None without letters."""
        words = _words(text.lower()) if text else []
        if not words:
            return None
        row = self.row
        try:
            at = [row[w] for w in words]
        except KeyError:
            self._learn(set(words))
            row = self.row
            at = [row[w] for w in words]
        return self.table[at].sum(axis=0)


def decide(model: Filter, counts: np.ndarray | None) -> tuple[str, float]:
    """The language and its corrected share of the n-grams; ties go to the first in the alphabet."""
    if counts is None or not model.languages:
        return UNKNOWN, 0.0
    share = np.clip((counts[:-1] / counts[-1] - model.chance) / (1 - model.chance), 0, 1)
    best = int(np.argmax(share))
    return model.languages[best], float(share[best])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, n): occurrences of each n-gram, added up before they leave the task."""
    words: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, count in words.items():
            every = list(count)
            for at in range(0, len(every), 20_000):
                part = every[at:at + 20_000]
                keys, word = gram_keys(part)
                key, back = np.unique(keys, return_inverse=True)
                n = np.bincount(back, np.array([count[w] for w in part], float)[word], len(key))
                held.setdefault(lang, []).append((key, n))
        words.clear()
        for lang, parts in held.items():
            key, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(back, np.concatenate([p[1] for p in parts]), len(key))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(key), pa.string()), "key": pa.array(key, pa.int64()),
                                              "n": pa.array(n.astype(np.int64), pa.int64())})
        held.clear()

    held: dict[str, list] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words.setdefault(lang, Counter()).update(_words((text.as_py() or "").lower()))
        if sum(map(len, words.values())) >= 300_000:
            yield from flush()
    yield from flush()


def fit(documents: DataFrame, text: str = "text", lang: str = "lang") -> Filter:
    """Learn from all rows with a text and a language. Counts are summed on the executors; the driver gets filter rows only,
    of which there are at most ``POSITIONS`` for 63 languages. Without such rows every text is unknown."""
    read = documents.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    counted = read.mapInArrow(_word_counts, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    scratch = Scratch(documents.sparkSession)
    counted = scratch.keep(counted)
    totals = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    lanes = max(1, -(-len(languages) // 63))
    if not languages:
        return Filter([], np.zeros((POSITIONS, 1), np.int64), np.zeros(0))
    spark = documents.sparkSession
    known = spark.createDataFrame([(l, i // 63, 1 << (i % 63), float(totals[l])) for i, l in enumerate(languages)],
                                  "lang string, lane int, bit bigint, total double")
    shares = counted.join(known, "lang").withColumn("share", F.col("n") / F.col("total"))
    top = shares.groupBy("key").agg(F.max("share").alias("top"))
    kept = shares.where(F.col("share") >= LEAST_SHARE).join(top, "key").where(F.col("share") >= RIVAL * F.col("top"))
    key = F.col("key")
    places = F.array(key % POSITIONS, *[
        (F.expr(f"key div {POSITIONS}") * (2 * k + 1) + key * k) % POSITIONS for k in range(1, HASHES)])
    rows = kept.select("lane", "bit", F.explode(places).alias("at")).groupBy("lane", "at").agg(F.bit_or("bit").alias("bits")).toPandas()
    scratch.drop(counted)
    table = np.zeros((POSITIONS, lanes), np.int64)
    table[rows["at"].to_numpy(np.int64), rows["lane"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    fill = np.array([np.mean((table[:, i // 63] >> (i % 63)) & 1) for i in range(len(languages))])
    return Filter(languages, table, fill ** HASHES)


def fit_fold(documents: DataFrame, mod: int = 4, rest: int = 2, id_col: str = "doc_id") -> Filter:
    """Learn from the rows outside the held-out fold; rows without an id are not learned from."""
    return fit(documents.where(F.col(id_col).isNotNull() & ~in_fold(F.col(id_col), mod, rest)))


def with_language(df: DataFrame, model: Filter, name: str = "language", text: str = "text") -> DataFrame:
    """Add a struct (lang, score). Null texts and texts without a letter are ``und`` with score 0."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        counts = Counts(model)
        for column in batches:
            got = [decide(model, counts.of(t.as_py())) for t in column]
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                                             ["lang", "score"])

    return with_struct(df, name, work, "struct<lang:string,score:double>", F.col(text))


def clean(df: DataFrame, model: Filter, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows with a recognised language and a score of at least ``least``, all columns kept."""
    mark = free_name(df, "_language")
    found = with_language(df, model, mark, text)
    return found.where((F.col(mark).lang != UNKNOWN) & (F.col(mark).score >= least)).drop(mark)
