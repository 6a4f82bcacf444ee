"""Benchmark passages in documents, found with an FM-index over each shard of documents.

A benchmark item's windows are its runs of 13 consecutive words (a shorter item is one window). Documents are
indexed, not the benchmark: the words of a shard of documents become a sequence of word numbers, its
suffix array gives the Burrows-Wheeler transform, a wavelet tree over that answers rank queries, and all windows are searched
backward at once. Occurrences are located by stepping back to sampled suffix positions; their spans are
merged per document.

Before indexing, words that no window contains become separators, and runs of words too short to hold
any window with one of their words are left out. Neither can be part of an occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.llm.shared import Scratch, free_name, utf8, with_struct

# Bytes that make up words (digits, letters, everything outside ASCII), A-Z in lower case.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

WINDOW = 13
SHARD_WORDS = 1 << 20
SAMPLE = 16            # every so many positions of a run keep their place
PATTERN_WORDS = 2_000_000  # benchmark words in one broadcast; more are searched in several passes
KIND = "struct<n_words:bigint,items:array<bigint>,spans:array<struct<start:bigint,stop:bigint>>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD).split() if text else []


class Patterns:
    """The distinct windows of some benchmark items as word numbers (1 and up), with the items of each."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], window: int = WINDOW):
        self.word: dict[bytes, int] = {}
        owners: dict[tuple, set] = {}
        for item, text in items:
            ids = tuple(self.word.setdefault(w, len(self.word) + 1) for w in words_of(text))
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(ids[at:at + window], set()).add(item)
        windows = sorted(owners, key=len)
        self.length = np.array([len(w) for w in windows], np.int64)
        self.table = np.zeros((len(windows), window), np.int32)  # aligned right: the last word is in the last column
        for row, w in enumerate(windows):
            self.table[row, window - len(w):] = w
        self.shortest = np.full(len(self.word) + 1, window, np.int64)
        for w in windows:
            for i in w:
                self.shortest[i] = min(self.shortest[i], len(w))
        ids = sorted({i for own in owners.values() for i in own if i is not None})
        self.items = np.array(ids, np.int64)
        place = {i: k for k, i in enumerate(ids)}
        named = [[place[i] for i in owners[w] if i is not None] for w in windows]
        self.own = np.array([i for n in named for i in n], np.int64)
        self.own_end = np.cumsum([len(n) for n in named], dtype=np.int64)


class WaveletTree:
    """Rank queries over a sequence of small numbers, a bit a level, zeros before ones on the next level."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels = []
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = (values >> shift) & 1
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((shift, ones, len(values) - int(ones[-1])))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, value: np.ndarray, end: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How often each value occurs before ``end``; ``start`` is where the value begins on the last level."""
        for shift, ones, zeros in self.levels:
            one = (value >> shift) & 1
            before = ones[end].astype(np.int64)
            end = np.where(one == 1, zeros + before, end - before)
        return end - start

    def starts(self, top: int) -> np.ndarray:
        value = np.arange(top + 1)
        end = np.zeros(top + 1, np.int64)
        for shift, ones, zeros in self.levels:
            before = ones[end].astype(np.int64)
            end = np.where((value >> shift) & 1 == 1, zeros + before, end - before)
        return end


class FMIndex:
    """Index of runs of word numbers; ``seq`` holds runs parted by zeros and ends with a zero."""

    def __init__(self, seq: np.ndarray, top: int):
        n = len(seq)
        zero = seq == 0
        gaps = int(zero.sum())
        # each separator is a symbol of its own, so no comparison reaches past the end of a run
        rank = np.where(zero, np.cumsum(zero) - 1, seq.astype(np.int64) + gaps)
        step = 1
        while True:
            after = np.zeros(n, np.int64)
            after[:n - step] = rank[step:] + 1
            key = rank * (n + gaps + top + 2) + after
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            ordered = key[order]
            rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
            if rank[order[-1]] == n - 1:
                break
            step *= 2
        self.first = np.r_[0, np.cumsum(np.bincount(seq, minlength=top + 1))]  # rows that begin with a symbol
        last = seq[order - 1]
        self.tree = WaveletTree(last, top)
        self.start = self.tree.starts(top)
        self.last = last
        run = np.maximum.accumulate(np.where(np.r_[True, zero[:-1]], np.arange(n), 0))
        kept = ((order - run[order]) % SAMPLE == 0) | zero[order]  # run starts are kept: no step leaves a run
        self.kept = kept
        self.place = np.where(kept, order, -1)

    def back(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.tree.rank(symbol, row, self.start[symbol])

    def search(self, patterns: Patterns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, low row, high row) of the windows that occur."""
        width = patterns.table.shape[1]
        live = np.arange(len(patterns.table))
        symbol = patterns.table[:, -1].astype(np.int64)
        low, high = self.first[symbol], self.first[symbol + 1]
        done = []
        for step in range(1, width + 1):
            some = low < high
            live, low, high = live[some], low[some], high[some]
            over = patterns.length[live] == step
            done.append((live[over], low[over], high[over]))
            live, low, high = live[~over], low[~over], high[~over]
            if not live.size:
                break
            symbol = patterns.table[live, width - 1 - step].astype(np.int64)
            low, high = self.back(symbol, low), self.back(symbol, high)
        return tuple(np.concatenate(x) for x in zip(*done))

    def locate(self, row: np.ndarray) -> np.ndarray:
        """The position in the sequence of each suffix row."""
        at, steps, open_ = np.full(len(row), -1, np.int64), np.zeros(len(row), np.int64), np.arange(len(row))
        row = row.copy()
        while open_.size:
            here = self.kept[row]
            at[open_[here]] = self.place[row[here]] + steps[open_[here]]
            open_, row = open_[~here], row[~here]
            symbol = self.last[row].astype(np.int64)
            row = self.back(symbol, row)
            steps[open_] += 1
        return at


def _runs(ids: np.ndarray, doc: np.ndarray, shortest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs that can hold a window, parted by zeros, and the word position of each entry (-1 for the zeros)."""
    known = np.flatnonzero(ids)
    if not known.size:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    new = np.r_[True, (np.diff(known) != 1) | (doc[known[1:]] != doc[known[:-1]])]
    begin = np.flatnonzero(new)
    length = np.diff(np.r_[begin, len(known)])
    enough = length >= np.minimum.reduceat(shortest[ids[known]], begin)
    keep = np.repeat(enough, length)
    place, size = known[keep], length[enough]
    if not size.size:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    to = np.arange(len(place)) + np.repeat(np.arange(len(size)), size)
    seq, at = np.zeros(len(place) + len(size), np.int32), np.full(len(place) + len(size), -1, np.int64)
    seq[to], at[to] = ids[place], place
    return seq, at


def _shard(docs: list[np.ndarray], patterns: Patterns) -> tuple[list, list]:
    """Items and merged word spans of each document (arrays of word numbers) of a shard."""
    size = np.array([len(d) for d in docs], np.int64)
    base = np.cumsum(size) - size
    items, spans = [[] for _ in docs], [[] for _ in docs]
    ids = np.concatenate(docs) if docs else np.zeros(0, np.int32)
    doc = np.repeat(np.arange(len(docs)), size)
    seq, at = _runs(ids, doc, patterns.shortest)
    if not len(seq) or not len(patterns.table):
        return items, spans
    index = FMIndex(seq, len(patterns.word))
    window, low, high = index.search(patterns)
    many = high - low
    if not many.sum():
        return items, spans
    row = np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
    which = np.repeat(window, many)
    begin = at[index.locate(row)]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + patterns.length[which], -1)
    hit = np.cumsum(edge[:-1]) > 0
    starts = np.flatnonzero(hit & ~np.r_[False, hit[:-1]] | hit & np.r_[True, doc[1:] != doc[:-1]])
    stops = np.flatnonzero(hit & ~np.r_[hit[1:], False] | hit & np.r_[doc[1:] != doc[:-1], True]) + 1
    for d, a, b in zip(doc[starts].tolist(), (starts - base[doc[starts]]).tolist(), (stops - base[doc[starts]]).tolist()):
        spans[d].append({"start": a, "stop": b})
    pair = np.unique(doc[begin] * len(patterns.table) + which)
    d, w = pair // len(patterns.table), pair % len(patterns.table)
    owned = np.diff(np.r_[0, patterns.own_end])[w]
    if owned.sum():
        index = np.repeat(patterns.own_end[w] - np.cumsum(owned), owned) + np.arange(owned.sum())
        named = np.unique(np.repeat(d, owned) * len(patterns.items) + patterns.own[index])
        for d, i in zip((named // len(patterns.items)).tolist(), patterns.items[named % len(patterns.items)].tolist()):
            items[d].append(i)
    return items, spans


def _find(shared) -> object:
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        patterns = shared.value
        get = patterns.word.get
        for column in batches:
            sizes, items, spans, held, count = [], [], [], [], 0
            def close():
                i, s = _shard(held, patterns)
                items.extend(i)
                spans.extend(s)
                held.clear()
            for text in utf8(column):
                words = words_of(text)
                sizes.append(len(words))
                held.append(np.array([get(w, 0) for w in words], np.int32))
                count += len(words)
                if count >= SHARD_WORDS:
                    close()
                    count = 0
            close()
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.StructArray.from_arrays(
                [pa.array(sizes, pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(spans, kind)],
                ["n_words", "items", "spans"])
    return work


def _slices(benchmark: DataFrame, item_id: str, text: str, words: int) -> tuple[int, Iterator[list[tuple]]]:
    """How many parts of a bounded number of words the benchmark has (one item may be longer), and the parts, each collected when asked for."""
    read = benchmark.select(F.col(item_id).alias("item"), F.col(text).alias("text"))
    bytes_ = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-bytes_ // (4 * words)))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    chosen = (read.where(part == k) if parts > 1 else read for k in range(parts))
    return parts, ([(r.item, r.text.encode() if r.text is not None else None) for r in c.collect()] for c in chosen)


def with_hits(df: DataFrame, benchmark: DataFrame, name: str, text: str = "text", item_id: str = "item_id",
              item_text: str = "text", window: int = WINDOW, pattern_words: int = PATTERN_WORDS) -> DataFrame:
    """Add a struct column: n_words, items (ids with an occurring window, in order) and the merged word spans to remove.

    Null and empty texts have no words and no hits; an item without words has no window; items without an id hit but
    are not listed; repeated item ids count once. An empty benchmark hits nothing. The benchmark is broadcast while it is under
    ``pattern_words``; a larger one is dealt out to several passes, each collecting and broadcasting a part, and the spans are merged.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    made = []
    n_parts, parts = _slices(benchmark, item_id, item_text, pattern_words)
    for k in range(n_parts):
        shared = spark.sparkContext.broadcast(Patterns(next(parts), window))
        made.append(free_name(df, f"_hits{k}") if n_parts > 1 else name)
        df = with_struct(df, made[-1], _find(shared), KIND, F.col(text))
        if n_parts > 1:
            df = scratch.keep(df)
            shared.destroy()       # the pass is written
    if n_parts == 1:
        return df
    return df.withColumn(name, F.struct(
        F.col(made[0]).n_words.alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(m)["items"] for m in made])))).alias("items"),
        merged(F.flatten(F.array(*[F.col(m).spans for m in made]))).alias("spans"))).drop(*made)


def merged(spans: Column) -> Column:
    """Overlapping and touching spans joined into one, in order."""
    kind = "array<struct<start:bigint,stop:bigint>>"
    def add(done, s):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            last.start.alias("start"), F.greatest(last.stop, s.stop).alias("stop"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)).stop >= s.start), joined).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.expr(f"cast(array() as {kind})"), add)


def digest(hits: Column) -> dict[str, Column]:
    """The columns that judge a document, from the struct of with_hits."""
    n_hit = F.aggregate(hits.spans, F.lit(0).cast("bigint"), lambda n, s: n + s.stop - s.start)
    ids = F.array_join(F.array_sort(F.transform(hits["items"], lambda i: i.cast("string"))), ",")
    return {"n_words": hits.n_words, "n_hit": n_hit, "n_items": F.size(hits["items"]).cast("bigint"),
            "items_sha256": F.sha2(ids, 256), "contaminated": (n_hit > 0) & (20 * n_hit >= hits.n_words)}


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that are not contaminated (hits in under a twentieth of their words), all columns kept."""
    mark = free_name(df, "_hits")
    found = with_hits(df, benchmark, mark, text)
    return found.where(~digest(F.col(mark))["contaminated"]).drop(mark)
