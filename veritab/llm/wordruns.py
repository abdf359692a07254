"""Words of many texts at once: numpy over the bytes of an Arrow column, no loop over texts or words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Classes of a byte: part of a word, a separator of words, a separator that also ends a piece.
WORD, SPACE, BREAK = 0, 1, 2


def byte_table(spaces: bytes, breaks: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """The class of every byte, and the byte with A-Z in lower case."""
    kind = np.full(256, WORD, np.uint8)
    kind[list(spaces)] = SPACE
    kind[list(breaks)] = BREAK
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 32
    return kind, lower


@dataclass
class WordRuns:
    """The words of a column in order, the row of each, and whether a new row or piece starts with it."""

    words: pa.Array
    row: np.ndarray
    first: np.ndarray

    def counts(self, rows: int) -> np.ndarray:
        """Number of words of every row."""
        return np.bincount(self.row, minlength=rows)


def word_runs(column: pa.Array, kind: np.ndarray, lower: np.ndarray) -> WordRuns:
    """The words of every text of an Arrow string column (null: no word)."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    base, total = int(ends[0]), int(ends[-1] - ends[0])
    if not total:
        none = np.zeros(0, np.int64)
        return WordRuns(pa.array([], pa.large_binary()), none, none.astype(bool))
    ends = ends - base
    raw = np.frombuffer(column.buffers()[2], np.uint8, total, base)
    cls = kind[raw]
    word = cls == WORD
    edge = np.zeros(total + 1, bool)
    edge[ends] = True                                  # a row starts here, and the one before ends
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    stop = word.copy()
    stop[:-1] &= ~word[1:] | edge[1:-1]
    at = np.flatnonzero(start)
    sizes = np.flatnonzero(stop) + 1 - at
    row = np.searchsorted(ends[1:], at, side="right")
    breaks = np.cumsum(cls == BREAK, dtype=np.int64)[at]
    first = np.ones(len(at), bool)
    first[1:] = (row[1:] != row[:-1]) | (breaks[1:] != breaks[:-1])
    offsets = np.zeros(len(at) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    letters = lower[raw[word]]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return WordRuns(words, row, first)


def chunks(column: pa.Array, kind: np.ndarray, limit: int, cut_at: int = SPACE):
    """Yield (row numbers, texts) of about ``limit`` bytes each. A longer text is cut into several of them, each time
    after the last byte of class ``cut_at`` or higher, so no word (piece) is broken unless it alone is longer."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(column)] if len(column) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        long = sizes[a:b] > limit
        if long.any():                                 # the last row of a group, or a group of its own
            for i in range(a, b):
                if sizes[i] <= limit:
                    yield np.array([i]), column.slice(i, 1)
                    continue
                text, at = column[i].as_py(), 0
                while at < len(text):
                    end = at + limit
                    while end < len(text):             # look for a separator backwards, in a longer stretch each time
                        ok = np.flatnonzero(kind[np.frombuffer(text, np.uint8, end - at, at)] >= cut_at)
                        if len(ok):
                            end = at + int(ok[-1]) + 1
                            break
                        end += end - at
                    yield np.array([i]), pa.array([text[at:end]], pa.large_binary())
                    at = end
        else:
            yield np.arange(a, b), column.slice(a, b - a)


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x + _MIX[0]
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class KeySet:
    """A set of 64-bit keys as a bit map of fixed size: finds all its members, and now and then a stranger."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = np.uint64(len(words) * 64 - 1)

    def __contains__(self, key: int) -> bool:
        return bool(self.holds(np.array([key], np.uint64))[0])

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in (keys & self.mask, (keys >> np.uint64(32)) & self.mask):
            found &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        return found
