"""Packing documents into sequences of bounded length: best fit, then swap-based local search.

Token ids come from a public tokenizer; documents are cut only if longer than a sequence. Pieces of full length
are sequences of their own. The rest is dealt out evenly into groups of bounded size; a group is packed by best fit
decreasing, then items are exchanged between underfull bins (moves, one for one, two for one), each exchange
raising the sum of squared fills, until bins empty. Bins that stay underfull in a group are opened again and their
pieces packed together with those of other groups.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.shared import Scratch, with_struct

LENGTH = 2048
GROUP = 32768          # pieces packed in one task
CLOSED = 0.995         # a bin this full stays as it is when groups meet
PIECES = "array<struct<start:bigint,length:bigint,ids_crc32:bigint>>"


# ---- token ids -------------------------------------------------------------------------------------------

class WordTokenizer:
    """Ids of a tokenizer file whose pre-tokenizer keeps letters, single digits and other signs apart.

    The library's merges give the ids of each distinct word, which are kept; texts with characters beyond Latin
    letters or with the file's special strings go through the library whole.
    """

    KEEP = 500_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        # Latin letters, and the small letters of some of them, which lie elsewhere
        latin = sorted({c for i in range(0x250) if i != 0x130 for c in (chr(i), chr(i).lower())})
        def some(kind):
            return "".join(re.escape(c) for c in latin if unicodedata.category(c)[0] == kind)
        letters, numbers, space = some("L"), some("N"), r"\t-\r \x85\xa0"
        # The file's own pattern, its classes spelled out for Latin text.
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+").findall
        self.other = re.compile("[^\x00-\u024f]|<\\||\u0130").search
        self.merge = self.library.model.tokenize
        # Printable bytes stand for themselves in the file, the others for code points from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in shown]
        self.sign = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Merge the bytes of new words, which are in the form that the library gives them."""
        if len(self.known) + len(words) > self.KEEP:
            self.known.clear()
        ids: list[int] = []
        ends = [0]
        for w in words:
            signs = w if w.isascii() and w.isprintable() else "".join([self.sign[b] for b in w.encode()])
            ids += [t.id for t in self.merge(signs)]
            ends.append(4 * len(ids))
        raw = np.array(ids, "<u4").tobytes()
        self.known.update((w, raw[a:b]) for w, a, b in zip(words, ends, ends[1:]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        split = [None if self.other(t) else self.split(t.lower()) for t in texts]
        fresh = set().union(*(s for s in split if s)).difference(self.known)
        if fresh and len(self.known) + len(fresh) > self.KEEP:
            self.known.clear()
            fresh = set().union(*(s for s in split if s))
        if fresh:
            self._learn(list(fresh))
        known = self.known
        return [self._ids(t) if s is None else b"".join([known[w] for w in s]) for t, s in zip(texts, split)]

    def batches(self, column: pa.Array, rows: int = 256) -> Iterator[bytes]:
        """The ids of every row of a string column; null is the empty text."""
        for at in range(0, len(column), rows):
            yield from self.encode([t or "" for t in column.slice(at, rows).to_pylist()])


def with_pieces(df: DataFrame, tokenizer: str, name: str, text: str = "text", length: int = LENGTH) -> DataFrame:
    """Add an array of pieces (start, length, crc32 of the ids): the text's ids and a final 0, cut every ``length``."""
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = WordTokenizer(tokenizer)
        for column in batches:
            ends, start, size, crc = [0], [], [], []
            for ids in words.batches(column):
                ids += b"\0\0\0\0"
                for at in range(0, len(ids), 4 * length):
                    part = ids[at:at + 4 * length]
                    start.append(at // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                ends.append(len(start))
            values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, size, crc)], ["start", "length", "ids_crc32"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    return with_struct(df, name, work, PIECES, F.col(text))


# ---- bins ------------------------------------------------------------------------------------------------

def best_fit(sizes: np.ndarray, room: int) -> list[list[int]]:
    """Best fit decreasing: bins as lists of item numbers."""
    bins: list[list[int]] = []
    by_space: list[list[int]] = [[] for _ in range(room + 1)]
    open_ = 0  # a bit for every amount of space that some bin has
    for item in np.argsort(-sizes, kind="stable").tolist():
        need = int(sizes[item])
        fits = open_ >> need
        if fits:
            space = need + (fits & -fits).bit_length() - 1
            at = by_space[space].pop()
            if not by_space[space]:
                open_ &= ~(1 << space)
        else:
            space, at = room, len(bins)
            bins.append([])
        bins[at].append(item)
        space -= need
        if space:
            by_space[space].append(at)
            open_ |= 1 << space
    return bins


class Search:
    """Exchanges between underfull bins; every one raises the sum of squared fills, so there is an end to them.

    An exchange fills the other bin as far as it goes. What fits is looked up by size, of which there are at most ``room``: bins by their
    free space, and items by the space that there would be in their bin without them.
    """

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], room: int):
        self.size, self.room = sizes.tolist(), room
        fills = [sum(self.size[i] for i in b) for b in bins]
        self.full = [b for b, f in zip(bins, fills) if f >= room]
        self.bins = [b for b, f in zip(bins, fills) if f < room]
        self.free = [room - f for f in fills if f < room]
        self.spaces: list[set[int]] = [set() for _ in range(room + 1)]
        self.open = 0                                       # a bit for every free space that some bin has
        # by space without the item: items by size, and the smallest of these sizes
        self.swaps: list[dict[int, set[tuple[int, int]]]] = [{} for _ in range(room + 1)]
        self.least = np.full(room + 1, room + 1, np.int64)
        for at in range(len(self.bins)):
            self._enter(at)

    def _enter(self, at: int) -> None:
        free = self.free[at]
        self.spaces[free].add(at)
        self.open |= 1 << free
        for item in self.bins[at]:
            u = self.size[item]
            self.swaps[free + u].setdefault(u, set()).add((at, item))
            if u < self.least[free + u]:
                self.least[free + u] = u

    def _leave(self, at: int) -> None:
        free = self.free[at]
        self.spaces[free].discard(at)
        if not self.spaces[free]:
            self.open &= ~(1 << free)
        for item in self.bins[at]:
            u = self.size[item]
            same = self.swaps[free + u]
            same[u].discard((at, item))
            if not same[u]:
                del same[u]
                if self.least[free + u] == u:
                    self.least[free + u] = min(same, default=self.room + 1)

    def _fits(self, size: int) -> int:
        """The bin with the least free space that takes ``size``, or -1."""
        some = self.open >> size
        return next(iter(self.spaces[size + (some & -some).bit_length() - 1])) if some else -1

    def _exchange(self, size: int) -> tuple[int, int] | None:
        """The item, and its bin, smaller than ``size`` whose place ``size`` fills best."""
        if size > self.room:
            return None
        smaller = self.least[size:] < size
        first = int(smaller.argmax())
        if not smaller[first]:
            return None
        return next(iter(self.swaps[size + first][int(self.least[size + first])]))

    def _put(self, source: int, give: list[int], target: int, take: int | None) -> None:
        self._leave(target)
        for item in give:
            self.bins[source].remove(item)
            self.bins[target].append(item)
        if take is not None:
            self.bins[target].remove(take)
            self.bins[source].append(take)
        moved = sum(self.size[i] for i in give) - (0 if take is None else self.size[take])
        self.free[source] += moved
        self.free[target] -= moved
        self._enter(target)

    def _step(self, source: int) -> bool:
        """One exchange out of ``source``: a move, one for one, or two for one."""
        own: dict[int, list[int]] = {}
        for item in self.bins[source]:
            own.setdefault(self.size[item], []).append(item)
        sizes = sorted(own, reverse=True)
        free = self.free[source]
        for u in sizes:
            target = self._fits(u)
            if target >= 0 and self.free[target] - u < free:
                self._put(source, own[u][:1], target, None)
                return True
        for u in sizes:
            found = self._exchange(u)
            if found and self.free[found[0]] + self.size[found[1]] - u < free:
                self._put(source, own[u][:1], *found)
                return True
        tried = set()
        for k, u in enumerate(sizes):
            for v in sizes[k:]:
                if u + v in tried or (u == v and len(own[u]) < 2):
                    continue
                tried.add(u + v)
                found = self._exchange(u + v)
                if found and self.free[found[0]] + self.size[found[1]] - u - v < free:
                    self._put(source, own[u][:2] if u == v else [own[u][0], own[v][0]], *found)
                    return True
        return False

    def run(self) -> list[list[int]]:
        """Go over the bins from the emptiest on, again and again, until the bound is met or no exchange is left."""
        least = -(-sum(self.room - f for f in self.free) // self.room)
        left = len(self.bins)
        moved = True
        while moved and left > least:
            moved = False
            for source in sorted(range(len(self.bins)), key=lambda at: (-self.free[at], at)):
                if not self.bins[source]:
                    continue
                self._leave(source)
                while self.bins[source] and self._step(source):
                    moved = True
                if self.bins[source]:
                    self._enter(source)
                else:
                    left -= 1
                    if left <= least:
                        break
        return self.full + [b for b in self.bins if b]


def pack(sizes: np.ndarray, room: int = LENGTH) -> list[list[int]]:
    """Bins (lists of item numbers) of at most ``room``."""
    if not len(sizes):
        return []
    bins = best_fit(sizes, room)
    if len(bins) > -(-int(sizes.sum()) // room):
        bins = Search(sizes, bins, room).run()
    return bins


# ---- on Spark --------------------------------------------------------------------------------------------

_PLACED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, fill bigint"


def _grouped(rows: DataFrame, groups: int, first: int, room: int) -> DataFrame:
    def one(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable")
        sizes = part["length"].to_numpy(np.int64)
        bins = pack(sizes, room)
        order = [i for b in bins for i in b]
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        out = part.iloc[order].copy()
        run = np.cumsum(sizes[order]) - sizes[order]
        begin = np.r_[0, np.cumsum([sizes[b].sum() for b in bins])]
        out["sequence_id"] = (first + int(key[0])) * GROUP * 4 + number
        out["offset"] = run - begin[number]
        out["fill"] = np.diff(begin)[number]
        return out[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill"]]

    group = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return rows.select(*cols).withColumn("g", group).groupBy("g").applyInPandas(one, _PLACED)


def packed(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    A null or empty text is one piece, the final 0. Repeated rows are packed each; a null id stays null. Ids must be whole
    numbers. Sequences have gapless offsets from 0 and at most ``length`` tokens.
    """
    scratch = Scratch(df.sparkSession)
    read = with_pieces(df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text")), tokenizer, "pieces", "text", length)
    cut = read.select("doc_id", F.posexplode("pieces").alias("piece", "p")).select("doc_id", "piece", "p.start", "p.length", "p.ids_crc32")
    pieces = scratch.keep(cut)
    whole = pieces.where(F.col("length") == length).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = pieces.where(F.col("length") < length)
    groups = max(1, -(-rest.count() // GROUP))
    done = _grouped(rest, groups, 0, length)
    if groups > 1:
        # the hash deals rows out of the written files, so a repeated task gets the same rows
        first = scratch.keep(done)
        again = first.where(F.col("fill") < CLOSED * length)
        more = max(1, -(-again.count() // GROUP))
        done = first.where(F.col("fill") >= CLOSED * length).union(_grouped(again, more, groups, length))
    return whole.union(done.drop("fill"))
