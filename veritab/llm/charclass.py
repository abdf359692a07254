"""Code-point classes and text segments for the vectorised pre-tokenizers."""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Code points of the Unicode property White_Space (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
               0x3000]
#: Letters that may follow an apostrophe in a contraction (fixed values of the public pattern).
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")


@functools.cache
def class_table() -> np.ndarray:
    """Class of every code point: letter ``\\p{L}``, number ``\\p{N}``, white space, other."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)),
                        dtype=np.uint8, count=sys.maxunicode + 1)
    table[WHITE_SPACE] = SPACE
    return table


def code_points(segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the joined segments, and a mark at the first code point of each segment."""
    cp = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    first = np.zeros(len(cp) + 1, dtype=bool)
    first[np.cumsum([0, *map(len, segments)])] = True
    return cp, first[:-1]


def shifted(x: np.ndarray, by: int, fill: int) -> np.ndarray:
    """``out[i] = x[i + by]``, ``fill`` outside."""
    out = np.full_like(x, fill)
    n = len(x)
    if by >= 0:
        out[:max(0, n - by)] = x[by:]
    else:
        out[-by:] = x[:max(0, n + by)]
    return out


def contractions(cp: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Apostrophes followed, in the same segment, by one (two) letters that make a contraction."""
    at = np.flatnonzero(cp == ord("'"))
    two, three = np.zeros(len(cp), bool), np.zeros(len(cp), bool)
    if len(at):
        pad, edge = np.append(cp, [0, 0]), np.append(first, [True, True])
        a, b = pad[at + 1], pad[at + 2]
        in1, in2 = ~edge[at + 1], ~edge[at + 1] & ~edge[at + 2]
        two[at] = in1 & np.isin(a, [ord(c) for c in ONE_LETTER])
        three[at] = in2 & np.logical_or.reduce([(a == ord(x)) & (b == ord(y)) for x, y in TWO_LETTERS])
    return two, three
