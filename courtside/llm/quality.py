"""Quality rules: word and line counts, and compression bands.

A text is compressed whole and in fixed chunks. How far plain prose shrinks depends on its length, so the limits
are given per band of UTF-8 length: below the low one a text is repetitive, above the high one it is not language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.llm.shared import free_name, with_struct

LEVEL = 3
CHUNK = 2048           # bytes; a shorter rest is judged if it is at least half as long
# (up to this many bytes, lowest and highest ratio of the whole text)
BANDS = ((64, 0.0, 9.0), (250, 0.45, 1.60), (500, 0.50, 0.95), (1000, 0.48, 0.82), (2000, 0.45, 0.72), (4000, 0.43, 0.68),
         (8000, 0.415, 0.65), (16000, 0.405, 0.65), (32000, 0.385, 0.65), (float("inf"), 0.36, 0.65))
CHUNK_BAND = (0.36, 0.70)
CHUNK_SHARE = 0.25     # of the chunks may lie outside

KIND = ("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
        "ratio:double,n_chunks:bigint,n_odd_chunks:bigint,base_failed:boolean,kept:boolean>")
_SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\v\f\r"


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of ``size`` words that occur at least twice."""
    if len(words) <= size:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    code = ids[:len(ids) - size + 1]
    for k in range(1, size):
        code = code * len(number) + ids[k:len(ids) - size + 1 + k]
        if k < size - 1 and len(number) > 1 << 20:
            code = np.unique(code, return_inverse=True)[1]  # keeps the next product in 63 bits
    _, back, count = np.unique(code, return_inverse=True, return_counts=True)
    twice = count[back] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(size):
        covered[k:len(ids) - size + 1 + k] |= twice
    return int(covered.sum())


class Rules:
    def __init__(self):
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)

    def ratio(self, raw: bytes) -> float:
        return len(self.packer.compress(raw)) / len(raw)

    def bands(self, raw: bytes) -> tuple[float, int, int, bool]:
        """Whole ratio, chunks, chunks outside the band, verdict."""
        if not raw:
            return 0.0, 0, 0, True
        whole = self.ratio(raw)
        low, high = next((lo, hi) for most, lo, hi in BANDS if len(raw) <= most)
        chunks = [self.ratio(raw[i:i + CHUNK]) for i in range(0, len(raw) - CHUNK // 2 + 1, CHUNK)]
        odd = sum(not CHUNK_BAND[0] <= r <= CHUNK_BAND[1] for r in chunks)
        return whole, len(chunks), odd, low <= whole <= high and odd <= CHUNK_SHARE * len(chunks)

    def judge(self, text: str | None) -> tuple:
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        n = len(words)
        chars = len(text) - sum(map(text.count, _BLANKS))
        symbols = sum(map(text.count, _SYMBOLS))
        lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
        repeats = repeated_words(words)
        failed = n < 50 or 100 * repeats > 50 * n
        whole, chunks, odd, fine = self.bands(raw)
        return n, chars, symbols, len(lines) - len(set(lines)), repeats, whole, chunks, odd, failed, not failed and fine


def with_quality(df: DataFrame, name: str = "quality", text: str = "text") -> DataFrame:
    """Add a struct of the counts, the ratios and the verdict. A null text has no words and fails, like an empty one."""
    names = [part.split(":")[0] for part in KIND[7:-1].split(",")]
    kinds = [pa.int64()] * 5 + [pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rules = Rules()
        for column in batches:
            rows = [rules.judge(t.as_py()) for t in column]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return with_struct(df, name, work, KIND, F.col(text))


def clean(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows that the rules keep, all columns kept."""
    mark = free_name(df, "_quality")
    return with_quality(df, mark, text).where(F.col(mark).kept).drop(mark)


def columns(quality: Column) -> list[Column]:
    return [quality[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]
