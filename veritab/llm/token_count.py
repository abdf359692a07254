"""Operator 3: token counts by compiled finite-state transducers.

Two deterministic transducers give the number of tokens that the tokenizer of ``word_bpe_49k.json`` makes of a text,
without building the tokens:

* The *pre-token machine* reads code-point classes and marks where pre-tokens start. It has 7 states. Texts are cut
  into chunks of equal length; for each chunk the map (entry state -> exit state) is computed for all states at once,
  the maps are composed by a parallel prefix scan, and a second pass from the known entry states sets the marks.
* The *merge machine* reads the bytes of a pre-token. Its state holds, for every place where a vocabulary token may
  still be under way, the last token of the encoding so far and the token count relative to now. Every transition is
  annotated with the change of the token count, and with the change if the pre-token ends there (the last symbol then
  carries the end-of-word mark). States and transitions are compiled when first met and kept in flat tables; the tables
  are dropped and compiled anew when they reach ``MAX_STATES`` (memory only, results do not depend on it). The machine
  starts afresh at each pre-token, so the state map of a chunk that begins there is constant and chunks run side by
  side as lanes of array operations.

A byte-pair encoding is the one segmentation whose neighbouring tokens are all compatible (merging the joined pair
gives back the same two tokens). So for each prefix exactly one last token is possible, which is what a state keeps.

Cases: null or empty text has 0 tokens and 0 bytes; strings of the two special tokens count as one token each;
repeated rows each give their row; null ids stay null; other columns are not read.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .charclass import LETTER, NUMBER, OTHER, SPACE, class_table, code_points, contractions
from .common import map_slices

#: States of the merge machine kept at a time (1.5 kB each).
MAX_STATES = 80_000
#: Bytes of a lane and code points of a chunk.
LANE, CHUNK = 192, 256
#: Prefixes with up to so many tokens keep the set of tokens that fit in place of the previous token.
SET_SIZE = 64
DEFAULT_FILE = "word_bpe_49k.json"

# -- the pre-token machine ---------------------------------------------------------------------------------------
# symbols: 0 space, 1 letter, 2 number, 3 other, 4 / 5 apostrophe of a contraction with one / two letters;
# 6..11 the same as the first code point of a text
S_START, S_LETTERS, S_NUMBER, S_OTHER, S_ONE_LEFT, S_TWO_LEFT, S_CONTRACTED = range(7)


def _pre_token_tables() -> tuple[np.ndarray, np.ndarray]:
    step, starts = np.zeros((12, 7), np.uint8), np.zeros((12, 7), bool)
    for symbol in range(12):
        for state in range(7):
            s, k = (S_START, symbol - 6) if symbol >= 6 else (state, symbol)
            if s == S_TWO_LEFT:
                to, new = S_ONE_LEFT, False
            elif s == S_ONE_LEFT:
                to, new = S_CONTRACTED, False
            elif k == 0:
                to, new = S_START, False
            elif k == 1:
                to, new = S_LETTERS, s != S_LETTERS
            elif k == 2:
                to, new = S_NUMBER, True
            elif k == 3 or s == S_OTHER:
                to, new = S_OTHER, s != S_OTHER
            else:
                to, new = (S_ONE_LEFT, S_TWO_LEFT)[k - 4], True
            step[symbol, state], starts[symbol, state] = to, new
    return step, starts


STEP, STARTS = _pre_token_tables()


def entry_states(maps: np.ndarray) -> np.ndarray:
    """Entry state of every chunk: inclusive prefix scan (doubling) over the chunks' state maps, then a shift."""
    acc, reach = maps.copy(), 1
    while reach < len(acc):
        nxt = acc.copy()
        nxt[reach:] = np.take_along_axis(acc[reach:], acc[:-reach].astype(np.intp), axis=1)
        acc, reach = nxt, reach * 2
    return np.concatenate([[S_START], acc[:-1, S_START]]).astype(np.uint8)


def pre_token_starts(cp: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mark of the first code point of each pre-token, mark of code points outside pre-tokens)."""
    cls = class_table()[cp]
    sym = np.choose(cls, np.array([3, 1, 2, 0], np.uint8)[[OTHER, LETTER, NUMBER, SPACE]]).astype(np.uint8)
    two, three = contractions(cp, first)
    sym[two], sym[three] = 4, 5
    sym[first] += 6
    n = len(sym)
    chunks = max(1, -(-n // CHUNK))
    grid = np.zeros(chunks * CHUNK, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
    maps = np.tile(np.arange(7, dtype=np.uint8), (chunks, 1))
    flat = STEP.reshape(-1)
    for row in grid:
        maps = flat.take((row * np.uint8(7))[:, None] + maps)
    state = entry_states(maps)
    out = np.empty((CHUNK, chunks), bool)
    for k, row in enumerate(grid):
        out[k] = STARTS[row, state]
        state = STEP[row, state]
    return out.T.reshape(-1)[:n], cls == SPACE


# -- the merge machine -------------------------------------------------------------------------------------------
def byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies use for bytes (public convention)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeMachine:
    """Lazily determinised transducer of a byte-pair vocabulary with end-of-word marks."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model, to_byte = spec["model"], byte_alphabet()
        mark = model["end_of_word_suffix"]
        self.special = [t["content"] for t in spec["added_tokens"]]

        def symbol(token: str) -> tuple[bytes, bool]:
            end = token.endswith(mark)
            return bytes(to_byte[c] for c in (token[:-len(mark)] if end else token)), end

        ids: dict[tuple[bytes, bool], int] = {}
        for token in model["vocab"]:
            ids.setdefault(symbol(token), len(ids))
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(model["merges"]):
            x, y = ids[symbol(a)], ids[symbol(b)]
            self.rank[x, y] = r
            self.parts.setdefault(ids[symbol(a)[0] + symbol(b)[0], symbol(b)[1]], (x, y, r))
        self.mid = {s: i for (s, end), i in ids.items() if not end}
        self.end = {s: i for (s, end), i in ids.items() if end}
        self.live = {s[:k] for s, _ in ids for k in range(len(s))}
        self.sorted = sorted((s, i) for (s, _), i in ids.items())
        self._sound: dict[int, bool] = {}
        self._edges: tuple[dict, dict] = ({}, {})
        self._clear()

    def _clear(self) -> None:
        self._fits: dict[tuple[int, int], bool] = {}
        self.sets: dict[frozenset[int], int] = {}
        self.members: list[frozenset[int]] = []
        self._narrow: dict[tuple[bytes, int], int | None] = {}
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        room = 1024
        self.next = np.full(room * 256, -1, np.int32)
        self.gain = np.zeros(room * 512, np.int8)
        self._state(((b"", -1, 0),))

    def _state(self, key: tuple) -> int:
        k = self.states.get(key)
        if k is None:
            k = self.states[key] = len(self.keys)
            self.keys.append(key)
            if (k + 1) * 256 > len(self.next):
                self.next = np.concatenate([self.next, np.full(len(self.next), -1, np.int32)])
                self.gain = np.concatenate([self.gain, np.zeros(len(self.gain), np.int8)])
        return k

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The outermost symbols of a token over time: (symbol, rank of the merge that uses it up)."""
        known = self._edges[side].get(token)
        if known is None:
            known, until, t = [], float("inf"), token
            known.append((t, until))
            while t in self.parts:
                x, y, until = self.parts[t]
                t = y if side else x
                known.append((t, until))
            known.reverse()
            self._edges[side][token] = known
        return known

    def apart(self, u: int, v: int) -> bool:
        """Whether merging the symbols of ``u v`` keeps both tokens: no merge across their border comes first."""
        left, right, rank = self._edge(u, 1), self._edge(v, 0), self.rank
        i = j = 0
        while True:
            (a, used_a), (b, used_b) = left[i], right[j]
            r = rank.get((a, b))
            if r is not None and r < used_a and r <= used_b:
                return False
            if a == u and b == v:
                return True
            if used_a <= used_b:
                i += 1
            else:
                j += 1

    def fits(self, u: int, v: int) -> bool:
        known = self._fits.get((u, v))
        if known is None:
            known = self._fits[u, v] = self.apart(u, v)
        return known

    def sound(self, token: int) -> bool:
        """Whether the token's own string is encoded as this one token."""
        known = self._sound.get(token)
        if known is None:
            if token not in self.parts:
                known = True
            else:
                x, y, r = self.parts[token]
                known = self.sound(x) and self.sound(y) and self._joins(x, y, r)
            self._sound[token] = known
        return known

    def _joins(self, x: int, y: int, rank: int) -> bool:
        """Whether the first merge across the border of ``x y`` is that of the two whole tokens."""
        left, right = self._edge(x, 1), self._edge(y, 0)
        i = j = 0
        while i < len(left) - 1 or j < len(right) - 1:
            (a, used_a), (b, used_b) = left[i], right[j]
            r = self.rank.get((a, b))
            if r is not None and r < used_a and r <= used_b:
                return False
            if used_a <= used_b:
                i += 1
            else:
                j += 1
        return self.rank.get((x, y)) == rank

    def narrowed(self, prefix: bytes, before: int) -> int | None:
        """What may still follow: the previous token, or a set of the tokens with this prefix that fit it.

        States that allow the same tokens become the same state. -1 is the start of the pre-token (all fit), other
        negative numbers stand for sets; None if nothing fits.
        """
        if before == -1:
            return -1 if prefix in self.live else None
        if (prefix, before) in self._narrow:
            return self._narrow[prefix, before]
        found: int | None = None
        if prefix in self.live:
            lo = bisect.bisect_left(self.sorted, (prefix,))
            hi = bisect.bisect_left(self.sorted, (prefix + b"\xff" * 4,))
            if before >= 0 and hi - lo > SET_SIZE:
                found = before
            else:
                tokens = (i for s, i in self.sorted[lo:hi] if len(s) > len(prefix))
                allowed = frozenset(t for t in tokens if (
                    self.sound(t) and self.apart(before, t) if before >= 0 else t in self.members[-2 - before]))
                if allowed:
                    found = self.sets.get(allowed)
                    if found is None:
                        found = self.sets[allowed] = -2 - len(self.members)
                        self.members.append(allowed)
        self._narrow[prefix, before] = found
        return found

    def allowed(self, before: int, token: int | None) -> bool:
        """Whether the token exists and may follow."""
        if token is None or not self.sound(token):
            return False
        return before == -1 or (self.fits(before, token) if before >= 0 else token in self.members[-2 - before])

    def compile(self, state: int, byte: int) -> None:
        """Fill in one transition: next state, change of the count, change if the pre-token ends here."""
        key, c = self.keys[state], bytes([byte])
        last = count = final = None
        nxt = []
        for s, before, n in key:
            p = s + c
            if last is None and self.allowed(before, t := self.mid.get(p)):
                last, count = t, n + 1
            if final is None and self.allowed(before, self.end.get(p)):
                final = n + 1
            if (then := self.narrowed(p, before)) is not None:
                nxt.append((p, then, n))
        if last is None or final is None:
            raise ValueError(f"no encoding of byte {byte} after {key!r}")
        to = self._state((*((p, then, n - count) for p, then, n in nxt), (b"", last, 0)))
        self.next[state * 256 + byte] = to
        self.gain[state * 512 + byte * 2] = count
        self.gain[state * 512 + byte * 2 + 1] = final

    def run(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Count emitted at each byte; ``starts`` marks the first byte of each pre-token (byte 0 included)."""
        n = len(data)
        if len(self.keys) > MAX_STATES or len(self._narrow) > 10 * MAX_STATES:
            self._clear()
        ends = np.append(starts[1:], True)
        code = data.astype(np.int32) | (starts.astype(np.int32) << 8) | (ends.astype(np.int32) << 9)
        at = np.flatnonzero(starts)
        lane0 = at[np.append(True, np.diff(at // LANE) > 0)]
        size = np.diff(np.append(lane0, n))
        order = np.argsort(-size, kind="stable")
        lane0, size = lane0[order], size[order]
        active = np.searchsorted(-size, -np.arange(size[0]), side="left")
        out = np.zeros(n, np.int8)
        state = np.zeros(len(lane0), np.int32)
        for k in range(int(size[0])):
            m = int(active[k])
            pos = lane0[:m] + k
            x = code[pos]
            idx = np.where(x & 256, 0, state[:m]) * 256 + (x & 255)
            to = self.next[idx]
            if to.min() < 0:
                for i in np.unique(idx[to < 0]).tolist():
                    self.compile(i >> 8, i & 255)
                to = self.next[idx]
            out[pos] = self.gain[idx * 2 + (x >> 9)]
            state[:m] = to
        return out


def lowered(text: str) -> str:
    """NFC, then lower case per code point (without the context rule for the final sigma)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return "σ".join(x.lower() for x in text.split("Σ"))


@functools.cache
def machine(file: str) -> MergeMachine:
    return MergeMachine(file)


def count_tokens(texts: list[str | None], m: MergeMachine) -> np.ndarray:
    """Number of tokens of each text."""
    pattern = re.compile("|".join(map(re.escape, m.special)))
    segments, owner, counts = [], [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if not text:
            continue
        if any(s in text for s in m.special):
            parts = pattern.split(text)
            counts[i] += len(parts) - 1
        else:
            parts = [text]
        for part in filter(None, map(lowered, parts)):
            segments.append(part)
            owner.append(i)
    if not segments:
        return counts
    cp, first = code_points(segments)
    starts, gap = pre_token_starts(cp, first)
    width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    data = np.frombuffer("".join(segments).encode("utf-8", "surrogatepass"), dtype=np.uint8)
    at = np.cumsum(width) - width
    byte_start = np.zeros(len(data), bool)
    byte_start[at[starts]] = True
    keep = np.repeat(~gap, width)
    if not keep.any():
        return counts
    gains = np.zeros(len(data), np.int8)
    gains[keep] = m.run(data[keep], byte_start[keep])
    seg_at = np.append(0, np.cumsum([len(s) for s in segments])[:-1])
    per_segment = np.add.reduceat(gains, at[seg_at], dtype=np.int64)
    np.add.at(counts, owner, per_segment)
    return counts


def token_counts(docs: DataFrame, file: str | None = None, limit: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; ``file`` is the tokenizer's JSON (default: public file)."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        import public_tokenizers
        m = machine(file or public_tokenizers.path(DEFAULT_FILE))
        texts = batch.column("text").to_pylist()
        n = count_tokens(texts, m)
        size = pc.binary_length(batch.column("text")).fill_null(0).cast("int64")
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), size, pa.array(n), pa.array(n > limit)],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.selectExpr(f"CAST(`{id_col}` AS bigint) AS doc_id", f"`{text_col}` AS text")
    return map_slices(rows, one, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
