"""Operator 7: best-fit packing after Martello-Toth dominance reduction.

Documents become token ids (byte-level BPE) with the end id 0 after each; a document of more than ``CAPACITY`` ids is
cut into pieces of ``CAPACITY``, the first piece taking what is left over. Full pieces are sequences of their own. What
remains is bin packing of lengths below the capacity, and it depends only on how many pieces have each length: at most
2,047 numbers, however many documents there are. So the plan is made from that histogram:

* Reduction: from the longest length on, a set of at most three pieces is fixed for good if it provably dominates every
  other feasible set with its first piece: alone (nothing fits beside it), with the largest piece that fits if that
  fills the sequence or if no two pieces fit, or with a pair that no other pair beats in both members.
* Best fit, decreasing, for the rest: every piece goes to the fullest open sequence that it fits into; sequences with
  equal contents are handled together, with their number.

The plan is a list of patterns (lengths of one sequence) with multiplicities. It is then carried out on Spark: pieces
get a rank among those of their length (counted in two levels, per task and per length, so that a length shared by very
many pieces is not ranked in one task), and the rank decides the pattern's copy, that is the sequence and the offset.

Cases: null or empty text is the end id alone; repeated rows are packed each; an empty table gives an empty result;
a null id stays null; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .charclass import SPACE, class_table, code_points, contractions, shifted
from .common import map_slices, ship_package, written

CAPACITY = 2048
END_ID = 0
DEFAULT_FILE = "byte_bpe_50k.json"
#: Pre-tokens whose ids a task remembers (memory only).
MEMORY = 1_000_000


# -- tokens --------------------------------------------------------------------------------------------------------
def pre_token_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mark of the first code point of each pre-token of the public byte-level pattern, in all segments at once.

    The pattern: contractions; letters, numbers or others, each with one space before them if there is one; white
    space up to the last character before a word; other white space.
    """
    c = class_table()[cp]
    last = np.append(first[1:], True)
    before, after = shifted(c, -1, 9), shifted(c, 1, 9)
    before[first], after[last] = 9, 9
    space = c == SPACE
    tail = space & (after != SPACE) & (after != 9)
    joins = shifted(tail & (cp == ord(" ")), -1, False) & ~first
    start = np.where(space, tail | (before != SPACE), (before != c) & ~joins)
    two, three = contractions(cp, first)
    for mark, more in ((two, 1), (three, 2)):
        at = np.flatnonzero(mark & start)
        for k in range(1, more + 1):
            start[at + k] = False
        at = at[at + more + 1 < len(cp)]
        start[at + more + 1] |= c[at + more + 1] != SPACE
    return start


class Encoder:
    """Ids of texts: pre-tokens are found side by side in arrays, and each distinct one is encoded by the library once."""

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            self.special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self._forget()

    def _forget(self) -> None:
        """Start with no known pre-tokens; their ids lie one after another in one array."""
        self.known: dict[str, int] = {}
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _learn(self, pieces: set[str]) -> None:
        new = list(pieces.difference(self.known))
        if not new:
            return
        found = [e.ids for e in self.library.encode_batch_fast(new, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(itertools.chain.from_iterable(found), "<u4", int(size.sum()))
        self.known.update(zip(new, range(len(self.size), len(self.size) + len(new)), strict=True))
        self.begin = np.concatenate([self.begin, np.cumsum(size) - size + len(self.flat)])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, the end id last, as little-endian unsigned 32-bit numbers."""
        if len(self.known) > MEMORY:
            self._forget()
        parts: list[list] = [self._split(t or "") for t in texts]
        segments = [p for ps in parts for p in ps if isinstance(p, str)]
        runs = self._runs(segments)
        out = []
        for ps in parts:
            own = [next(runs) if isinstance(p, str) else np.array([p], "<u4") for p in ps]
            out.append(np.concatenate([*own, np.array([END_ID], "<u4")]))
        return out

    def _split(self, text: str) -> list:
        """Text between special strings, and their ids."""
        out, at = [], 0
        for s in self.special:
            if s in text:
                break
        else:
            return [text] if text else []
        while at < len(text):
            found = min(((text.find(s, at), s) for s in self.special if text.find(s, at) >= 0), default=None)
            stop = found[0] if found else len(text)
            if stop > at:
                out.append(text[at:stop])
            if found:
                out.append(self.special[found[1]])
            at = stop + (len(found[1]) if found else 0)
        return out

    def _runs(self, segments: list[str]):
        if not segments:
            return iter(())
        cp, first = code_points(segments)
        at = np.flatnonzero(pre_token_starts(cp, first))
        joined = "".join(segments)
        edges = [*at.tolist(), len(joined)]
        pieces = [joined[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self._learn(set(pieces))
        which = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        n = self.size[which]
        total = np.cumsum(n)
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.begin[which] - (total - n), n)]
        seg_first = np.append(0, np.cumsum([len(s) for s in segments])[:-1])
        cut = np.append(total - n, total[-1])[np.searchsorted(at, seg_first)][1:]
        return iter(np.split(ids, cut))


@functools.cache
def encoder(file: str) -> Encoder:
    return Encoder(file)


def pieces_of(docs: DataFrame, file: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        import public_tokenizers
        enc = encoder(file or public_tokenizers.path(DEFAULT_FILE))
        cols: list[list] = [[] for _ in range(5)]
        for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist()), strict=True):
            start, number = 0, 0
            while start < len(ids):
                size = (len(ids) - start) % capacity or capacity
                row = (doc, number, start, size, zlib.crc32(ids[start:start + size].tobytes()))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
                start, number = start + size, number + 1
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                          ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_slices(rows, one, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


# -- the plan ------------------------------------------------------------------------------------------------------
class Lengths:
    """A multiset of lengths in ascending order of the distinct ones."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.order = sorted(self.n)

    def take(self, length: int, times: int) -> None:
        self.n[length] -= times
        if not self.n[length]:
            del self.n[length]
            self.order.pop(bisect_left(self.order, length))

    def put(self, length: int) -> None:
        self.n[length] = self.n.get(length, 0) + 1
        if self.n[length] == 1:
            insort(self.order, length)

    def largest(self, room: int) -> int | None:
        """The largest length of at most ``room``."""
        i = bisect_right(self.order, room)
        return self.order[i - 1] if i else None

    def smallest_two(self) -> tuple[int | None, int | None]:
        if not self.order:
            return None, None
        a = self.order[0]
        b = a if self.n[a] > 1 else self.order[1] if len(self.order) > 1 else None
        return a, b


def reduced(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[Counter, dict[int, int]]:
    """Martello-Toth reduction: (patterns fixed for good with their numbers, counts of the lengths that are left).

    Passes from the longest length down, until a pass fixes nothing. A set has to dominate all feasible sets of the
    pieces that are left, longer ones that were not fixed included. Equal cases are fixed many at a time.
    """
    fixed: Counter = Counter()
    items = Lengths(counts)
    again = True
    while again:
        again = False
        for w in sorted(items.n, reverse=True):
            while items.n.get(w):
                pattern = _dominating(items, w, capacity - w)
                if pattern is None:
                    break
                need = Counter(pattern)
                times = min(items.n[k] // m for k, m in need.items())
                if len(pattern) > 1:
                    # equal cases in one go, as long as no length runs short: then the next round looks anew
                    times = max(1, min(items.n[k] - m for k, m in need.items()) // max(need.values()))
                fixed[pattern] += times
                for k, m in need.items():
                    items.take(k, m * times)
                again = True
    return fixed, items.n


def _dominating(items: Lengths, w: int, room: int) -> tuple[int, ...] | None:
    """A set with a piece of length w that dominates all feasible sets with it, if one is found."""
    items.take(w, 1)
    try:
        best = items.largest(room)
        if best is None:
            return (w,)
        a, b = items.smallest_two()
        if best == room or b is None or a + b > room:
            return (w, best)
        return _dominating_pair(items, w, best, room)
    finally:
        items.put(w)


def _dominating_pair(items: Lengths, w: int, best: int, room: int) -> tuple[int, ...] | None:
    """A set (w, x) or (w, x, y) that dominates all feasible sets with w, if at most two pieces fit beside w."""
    small = []
    for k in items.order:
        small += [k] * min(items.n[k], 3 - len(small))
        if len(small) == 3:
            break
    if len(small) == 3 and sum(small) <= room:
        return None
    # the longest second member that any pair has, and the largest sum of a pair
    second = most = 0
    for x in reversed(items.order[:bisect_right(items.order, room)]):
        i = bisect_right(items.order, min(x, room - x))
        while i and items.order[i - 1] == x and items.n[x] < 2:
            i -= 1
        if i:
            second, most = max(second, items.order[i - 1]), max(most, x + items.order[i - 1])
    if most <= best:
        return (w, best)
    y = items.largest(room - best)
    if y == best and items.n[best] < 2:
        i = bisect_left(items.order, best)
        y = items.order[i - 1] if i else None
    if y is not None and second <= y:
        return (w, best, y)
    return None


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Counter:
    """Best fit in decreasing order of length; equal sequences are kept as one pattern with their number."""
    open_: dict[int, Counter] = defaultdict(Counter)
    rooms: list[int] = []
    closed: Counter = Counter()

    def put(pattern: tuple[int, ...], times: int) -> None:
        room = capacity - sum(pattern)
        if room == 0:
            closed[pattern] += times
        else:
            if not open_[room]:
                insort(rooms, room)
            open_[room][pattern] += times

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                per = capacity // length
                full, rest = divmod(todo, per)
                if full:
                    put((length,) * per, full)
                if rest:
                    put((length,) * rest, 1)
                break
            room = rooms[i]
            pattern, times = next(iter(open_[room].items()))
            n = min(todo, times)
            open_[room][pattern] -= n
            if not open_[room][pattern]:
                del open_[room][pattern]
            if not open_[room]:
                rooms.pop(i)
            put((*pattern, length), n)
            todo -= n
    for patterns in open_.values():
        closed.update(patterns)
    return closed


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with their numbers; together they use up all lengths. Longest pieces first within a pattern."""
    fixed, left = reduced(counts, capacity)
    fixed.update(best_fit(left, capacity))
    return sorted(((tuple(sorted(p, reverse=True)), n) for p, n in fixed.items()), reverse=True)


def segments(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, past rank, first sequence, offset): which ranks of a length take which place."""
    out, used, sequence = [], Counter(), 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            out.append((length, used[length], used[length] + n, sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return out


# -- on Spark ------------------------------------------------------------------------------------------------------
def packed(docs: DataFrame, file: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    from pyspark.sql import Window

    rows = pieces_of(docs, file, capacity, id_col, text_col)
    rows = written(rows.withColumn("row_no", F.monotonically_increasing_id()), "pieces")
    # rank within (length, task that made the piece), then the tasks' offsets within the length
    rows = rows.withColumn("part", F.shiftright("row_no", 33))
    counts = written(rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "length-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    offsets = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    # the offsets grow with the tasks, so they are not broadcast: the rows lie by (length, part) already for the window
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("row_no")) - 1
    ranked = rows.withColumn("inside", inside).join(offsets.drop("n").hint("merge"), ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inside")).alias("rank"))
    return placed(ranked, segments(plan(histogram, capacity)))


def placed(ranked: DataFrame, places: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Replace the rank of each piece among those of its length by its sequence and offset (binary search).

    The list of places follows from the histogram; its size is bounded by the number of different lengths and patterns.
    """
    ship_package(ranked.sparkSession)
    table = np.array(sorted(places), np.int64).reshape(-1, 5)
    shared = ranked.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        t = shared.value
        keys = (t[:, 0] << 48) | t[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            sequence = t[at, 3] + rank - t[at, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence),
                 pa.array(t[at, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
                                  "sequence_id bigint, offset bigint")
