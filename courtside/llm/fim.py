"""Fill-in-the-middle texts: a text is cut at two unit boundaries and its middle put last.

Units are lines. Where a unit ends is looked up in a learned rank index of the text's boundaries: straight segments that
miss no boundary by more than a bound, and for every boundary the small rest by which its segment misses it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOUND = 120            # code points; what is left over fits one signed byte
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
KIND = "struct<n:bigint,form:string,output:string,prefix_chars:bigint,middle_chars:bigint>"


class RankIndex:
    """Exact values of an ascending whole-number sequence by rank, kept as error-bounded segments and residuals.

    A segment starts at a point of the sequence and goes on as long as one slope through that point stays within ``bound`` of
    all points since (the cone of such slopes only narrows). Points are looked at in runs of doubling length.
    """

    def __init__(self, values: np.ndarray, bound: int = BOUND):
        first, base, slope = [], [], []
        at, n = 0, len(values)
        while at < n:
            low, high, end, run = -np.inf, np.inf, at + 1, 32
            while end < n:
                stop = min(n, end + run)
                dx, dy = np.arange(end - at, stop - at), values[end:stop] - values[at]
                lows = np.maximum(np.maximum.accumulate((dy - bound) / dx), low)
                highs = np.minimum(np.minimum.accumulate((dy + bound) / dx), high)
                shut = np.flatnonzero(lows > highs)
                last = shut[0] if len(shut) else stop - end
                if last:
                    low, high = lows[last - 1], highs[last - 1]
                end += last
                if len(shut):
                    break
                run *= 2
            first.append(at)
            base.append(values[at])
            slope.append((low + high) / 2 if end > at + 1 else 0.0)
            at = end
        self.first, self.base, self.slope = np.array(first, np.int64), np.array(base, np.int64), np.array(slope)
        rest = values - self.predict(np.arange(n))
        self.rest = rest.astype(np.int8) if bound < 127 else rest

    def predict(self, rank: np.ndarray) -> np.ndarray:
        piece = np.searchsorted(self.first, rank, "right") - 1
        return self.base[piece] + np.rint(self.slope[piece] * (rank - self.first[piece])).astype(np.int64)

    def value(self, rank: np.ndarray) -> np.ndarray:
        return self.predict(rank) + self.rest[rank]


def boundaries(text: str) -> np.ndarray:
    """Code-point offsets of 0 and of the end of every line, the line feed included."""
    if text.isascii():
        marks = np.frombuffer(text.encode(), np.uint8) == 10
    else:
        marks = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 10
    ends = np.flatnonzero(marks) + 1
    whole = [] if not len(text) or (len(ends) and ends[-1] == len(text)) else [len(text)]
    return np.concatenate([[0], ends, whole]).astype(np.int64)


def draws(key: str) -> list[int]:
    """Four unsigned 32-bit numbers from the SHA-256 of a key."""
    digest = hashlib.sha256(key.encode("utf-8", "surrogatepass")).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4)]


def transform(text: str, key: str, rate: int, spm: int) -> tuple:
    """(units, form, output, prefix length, middle length) of one text."""
    index = RankIndex(boundaries(text))
    n = len(index.rest) - 1
    h1, h2, h3, h4 = draws(key)
    if not text or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", text, None, None
    a, b = index.value(np.array(sorted((h1 % (n + 1), h2 % (n + 1))))).tolist()
    if h4 % 100 < spm:
        return n, "spm", f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}", a, b - a
    return n, "psm", f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}", a, b - a


def with_fim(df: DataFrame, name: str = "fim", id_col: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """Add a struct (n, form, output, prefix_chars, middle_chars); a column of that name is replaced.

    ``rate`` percent of the texts are cut, ``spm`` percent of those with the suffix first. The draws depend only on the seed and
    the id, so equal ids give equal draws; a null id counts as an empty one. A null text is empty. Empty texts and texts
    that hold one of the three marks stay as they are (form plain, lengths null). Each row is treated by itself.
    """
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    names = [part.split(":")[0] for part in KIND[7:-1].split(",")]

    def work(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, keys in batches:
            rows = [transform(t.as_py() or "", k.as_py(), rate, spm) for t, k in zip(texts, keys)]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return df.withColumn(name, F.arrow_udf(work, KIND).asNondeterministic()(F.col(text), key))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No cut text holds a mark, so splitting at the marks gives its parts back."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))
