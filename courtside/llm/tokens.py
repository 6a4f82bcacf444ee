"""Token counts by compiled transducers, without building token lists.

Two deterministic transducers in a row. The first is the pre-tokenizer's pattern: twelve states over eleven classes
of characters, whose transitions say where a piece begins. Texts are cut into chunks of equal length; each chunk's state map (end state for
every start state) is found for all chunks in step, the maps are composed by a parallel prefix scan, and from
each chunk's true start state the outputs are read off. The second reads a piece's bytes and counts its tokens: a state
holds the bytes that may still be part of a longer token together with the last token of every prefix that ends in them,
which is all that byte-pair merges can depend on; a transition carries the change in the number of tokens. Its states are made when first reached, and the
table is emptied when it grows past a bound.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.shared import with_struct

CHUNK = 256             # characters
LOT = 1 << 20           # characters scanned at once
SPECIAL = "<|endoftext|>"

# ---- pieces ----------------------------------------------------------------------------------------------

START, LETTERS, NUMBERS, OTHERS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, SPACE, BLANK, BLANKS_SPACE, BLANKS = range(12)
(LETTER, SHORT, R, E, V, L, NUMBER, OTHER, APOSTROPHE, BLANK_SPACE, BLANK_OTHER, END) = range(12)
_LETTERS = (LETTER, SHORT, R, E, V, L)
HERE, BEFORE = 1, 2     # outputs: a piece begins at this character, at the one before


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output for every state and class."""
    go, out = np.zeros((12, 12), np.uint8), np.zeros((12, 12), np.uint8)
    fresh = {NUMBER: NUMBERS, OTHER: OTHERS, APOSTROPHE: QUOTE, BLANK_SPACE: SPACE, BLANK_OTHER: BLANK, END: START} | dict.fromkeys(_LETTERS, LETTERS)
    joined = {NUMBER: NUMBERS, OTHER: OTHERS, APOSTROPHE: OTHERS} | dict.fromkeys(_LETTERS, LETTERS)
    for state in range(12):
        for kind, to in fresh.items():
            go[state, kind], out[state, kind] = to, HERE
    for kind in _LETTERS:
        go[LETTERS, kind], out[LETTERS, kind] = LETTERS, 0
    go[NUMBERS, NUMBER], out[NUMBERS, NUMBER] = NUMBERS, 0
    for state in (OTHERS, QUOTE):
        for kind in (OTHER, APOSTROPHE):
            go[state, kind], out[state, kind] = OTHERS, 0
    for kind, to in joined.items():
        go[SPACE, kind], out[SPACE, kind] = to, 0
        go[BLANKS_SPACE, kind], out[BLANKS_SPACE, kind] = to, BEFORE
        out[BLANKS, kind] = HERE | BEFORE
    for state in (SPACE, BLANK, BLANKS_SPACE, BLANKS):
        go[state, BLANK_SPACE], out[state, BLANK_SPACE] = BLANKS_SPACE, 0
        go[state, BLANK_OTHER], out[state, BLANK_OTHER] = BLANKS, 0
    go[QUOTE, SHORT], out[QUOTE, SHORT] = START, 0
    for kind, to in ((R, QUOTE_R), (V, QUOTE_V), (L, QUOTE_L)):
        go[QUOTE, kind], out[QUOTE, kind] = to, 0
    for state, ends in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, L)):
        for kind in range(12):  # no contraction: the letter began a piece, go on as from letters
            go[state, kind], out[state, kind] = go[LETTERS, kind], out[LETTERS, kind] | BEFORE
        go[state, ends], out[state, ends] = START, 0
    return go.reshape(-1), out.reshape(-1)


def _classes() -> np.ndarray:
    """The class of every code point."""
    import regex
    from tokenizers import pre_tokenizers
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    kinds = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", BLANK_OTHER)):
        for m in regex.finditer(pattern, every):
            a, b = m.span()
            kinds[ord(every[a]):ord(every[b - 1]) + 1] = kind
    # characters newer than Python's own tables: the library may know fewer of them than the pattern does
    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    for code in np.flatnonzero((kinds == LETTER) | (kinds == NUMBER)).tolist():
        if unicodedata.category(chr(code)) == "Cn":
            kinds[code] = next((kind for sign, kind in (("a", LETTER), ("1", NUMBER)) if len(split(sign + chr(code))) == 1), OTHER)
    for chars, kind in (("stmd", SHORT), ("r", R), ("e", E), ("v", V), ("l", L), ("'", APOSTROPHE), (" ", BLANK_SPACE)):
        for c in chars:
            kinds[ord(c)] = kind
    kinds[0xD800:0xE000] = OTHER
    return kinds


class PieceScanner:
    def __init__(self):
        self.go, self.out = _machine()
        self.kinds = _classes()

    def starts(self, text: str, ends: np.ndarray) -> np.ndarray:
        """Where pieces begin; ``ends`` are the places of one extra character after each segment."""
        n = len(text)
        kind = self.kinds[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        kind[ends] = END
        rows = -(-n // CHUNK)
        grid = np.full(rows * CHUNK, END, np.uint8)
        grid[:n] = kind
        grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
        maps = np.tile(np.arange(12, dtype=np.uint8), (rows, 1))
        for column in grid:
            maps = self.go[maps * np.uint8(12) + column[:, None]]
        step = 1
        while step < rows:  # prefix scan: the map of all chunks up to each
            maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
            step *= 2
        state = np.r_[np.uint8(START), maps[:-1, START]].astype(np.uint8)
        outs = np.empty((CHUNK, rows), np.uint8)
        for j, column in enumerate(grid):
            at = state * np.uint8(12) + column
            outs[j] = self.out[at]
            state = self.go[at]
        outs = outs.T.reshape(-1)[:n]
        begin = (outs & HERE) == HERE
        begin[:-1] |= (outs[1:] & BEFORE) == BEFORE
        return np.flatnonzero(begin)


# ---- tokens of a piece -----------------------------------------------------------------------------------

class Merges:
    """A byte-pair vocabulary: tokens as bytes, how each was merged, and which tokens can stand side by side."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        # Printable bytes stand for themselves in the file, the others for code points from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        def raw(token: str) -> bytes:
            return bytes(byte[c] for c in token)
        self.id: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.rank, self.parts, self.merge = [-1] * 256, [None] * 256, {}
        for pair in model["merges"]:
            left, right = (raw(p) for p in (pair.split(" ") if isinstance(pair, str) else pair))
            a, b, whole = self.id[left], self.id[right], left + right
            rank = len(self.merge)
            if whole not in self.id:
                self.id[whole] = len(self.rank)
                self.rank.append(rank)
                self.parts.append((a, b))
            self.merge.setdefault((a, b), rank)
        self.prefixes = {t[:k] for t in self.id for k in range(1, len(t))}  # of longer tokens
        self.side: tuple[dict, dict] = ({}, {})

    def _spine(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The tokens on one side of a token while it is merged, with the rank at which each is used up."""
        kept = self.side[right]
        if token not in kept:
            spine, until = [], float("inf")
            at = token
            while True:
                spine.append((at, until))
                if self.parts[at] is None:
                    break
                until, at = self.rank[at], self.parts[at][right]
            kept[token] = spine
        return kept[token]

    def stand(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart: no merge across their border comes before those that make them up."""
        for a, a_until in self._spine(left, True):
            for b, b_until in self._spine(right, False):
                rank = self.merge.get((a, b))
                if rank is not None:
                    when = max(rank, self.rank[a], self.rank[b])
                    if when < a_until and when <= b_until:  # of equal merges the left one comes first
                        return False
        return True


NONE, DEAD = -1, -2     # no token before this place; no longer token can begin here


class TokenCounter:
    """The transducer from bytes to numbers of tokens, compiled as far as texts have reached."""

    STATES = 300_000
    PIECES = 300_000

    def __init__(self, merges: Merges):
        self.merges = merges
        self.known: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.edge: dict[int, tuple[int, int]] = {}  # state * 256 + byte: next state, change of the count
        # open bytes; for each place among them the last token before it and the count there, against now
        first = (b"", (NONE,), (0,))
        self.number, self.state = {first: 0}, [first]

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        open_, last, count = self.state[state]
        m = self.merges
        grown = open_ + bytes([byte])
        for k in range(len(grown)):
            token = m.id.get(grown[k:])
            if token is not None and (last[k] == NONE or m.stand(last[k], token)):
                break
        change = count[k] + 1
        last, count = (*last, token), (*(c - change for c in count), 0)
        # a place matters on only if the bytes after it can still become a longer token
        live = [k for k in range(len(grown) + 1) if k == len(grown) or grown[k:] in m.prefixes]
        cut = live[0]
        made = (grown[cut:], tuple(last[k] if k in live else DEAD for k in range(cut, len(grown) + 1)),
                tuple(count[k] if k in live else 0 for k in range(cut, len(grown) + 1)))
        if made not in self.number:
            self.number[made] = len(self.state)
            self.state.append(made)
        got = self.edge[state << 8 | byte] = (self.number[made], change)
        return got

    def count(self, piece: str) -> int:
        """Tokens of one piece."""
        if len(self.state) > self.STATES:
            self._clear()
        if len(self.known) > self.PIECES:
            self.known.clear()
        state = total = 0
        edge = self.edge
        for byte in piece.encode("utf-8", "surrogatepass"):
            state, change = edge.get(state << 8 | byte) or self._compile(state, byte)
            total += change
        self.known[piece] = total
        return total


class TextCounter:
    def __init__(self, path: str):
        self.scan, self.tokens = PieceScanner(), TokenCounter(Merges(path))

    def _lot(self, segments: list[str]) -> np.ndarray:
        text = "\0".join(segments) + "\0"
        ends = np.cumsum([len(s) + 1 for s in segments]) - 1
        at = self.scan.starts(text, ends)
        known = self.tokens.known
        edge = at.tolist()
        out = np.empty(len(edge), np.int64)
        pieces = list(map(text.__getitem__, map(slice, edge, edge[1:] + [len(text)])))
        found = list(map(known.get, pieces))
        if None in found:
            for i, n in enumerate(found):
                if n is None:
                    p = pieces[i]
                    found[i] = self.tokens.known[p] if p in self.tokens.known else self.tokens.count(p)
        out[:] = found
        place = np.searchsorted(ends, at)
        out[at == ends[place]] = 0  # the extra characters
        return np.bincount(place, weights=out, minlength=len(segments)).astype(np.int64)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; the special string counts as one token and parts the text."""
        total, lot, owner, size = np.zeros(len(texts), np.int64), [], [], 0

        def close():
            if lot:
                np.add.at(total, owner, self._lot(lot))
                lot.clear()
                owner.clear()

        for i, text in enumerate(texts):
            parts = text.split(SPECIAL)
            total[i] += len(parts) - 1
            for part in parts:
                if part:
                    lot.append(part)
                    owner.append(i)
                    size += len(part) + 1
            if size >= LOT:
                close()
                size = 0
        close()
        return total.tolist()


def with_tokens(df: DataFrame, tokenizer: str, name: str = "n_tokens", text: str = "text") -> DataFrame:
    """Add the number of tokens that the tokenizer's file gives the text, without added ones. Null and empty texts have none."""
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = TextCounter(tokenizer)
        for column in batches:
            counts: list[int] = []
            for at in range(0, len(column), 512):
                counts += counter.counts([t or "" for t in column.slice(at, 512).to_pylist()])
            yield pa.array(counts, pa.int64())

    return with_struct(df, name, work, "bigint", F.col(text))
