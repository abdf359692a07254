"""Operator 8: benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``WINDOW`` consecutive words (an item of fewer words is one window). A window
is the set of its word shingles (``SHINGLE`` words; shorter windows are one shingle). Containment must be full, so a
prefix of one shingle is enough: a document can hold a window only if it holds the window's rarest shingle.

1. Rarity: one pass over all documents counts how often each benchmark shingle occurs in the corpus (pre-aggregated in
   the tasks, summed by shingle).
2. Prefix join: each distinct window is filed under its rarest shingle and that shingle's offset. A second pass looks up
   every shingle of every document.
3. Length and positional bounds: the window has to fit into the document at the place that the offset gives.
4. Verification: the candidate's words are compared with the window's words, byte by byte.

The index of windows is given to the tasks as a broadcast value. Its size is bounded: the benchmark is taken in blocks
of about ``BLOCK_BYTES`` bytes and at most ``BLOCK_WINDOWS`` windows of items (a longer item is cut into overlapping runs),
one pair of passes each, and the blocks' hits are merged per document, so any size of benchmark works. The index is flat: a
full block takes less than 300 MB in a worker. Documents are never shuffled; hits (rows of documents that hold a window)
are. A document's words are in memory at once, about 100 bytes for each word of the longest text.

Cases: null and empty texts have no words and are clean; items without words are passed over; null item ids count as the
item ``""``; repeated items and documents are allowed (each document row gives a row); other columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, map_slices, ship_package, written

WINDOW = 10
SHINGLE = 3
#: Bytes and windows of a block of items, and candidates and windows that are looked at together.
BLOCK_BYTES, BLOCK_WINDOWS, RUN, CHUNK = 16 << 20, 1_500_000, 1_000_000, 65_536
#: Width of the bit table that answers most look-ups.
FILTER_BITS = 20


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit number for each word, the same in every process."""
    from xxhash import xxh3_64_intdigest
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of ``size`` words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ h[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Shingles:
    """Look-up of sorted shingle hashes; a bit table turns most strangers away."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[self.hashes >> np.uint64(64 - FILTER_BITS)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, indices) of the hashes that are in the table."""
        at = np.flatnonzero(self.bits[h >> np.uint64(64 - FILTER_BITS)])
        if not len(at) or not len(self.hashes):
            return at[:0], at[:0]
        idx = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        ok = self.hashes[idx] == h[at]
        return at[ok], idx[ok]


class WindowIndex:
    """The distinct windows of a block of items, and after ``order_by`` their prefixes, in flat arrays.

    The block's words stand in one byte string, one space around each; a window is the number of its first word and a size.
    Some 70 bytes a window while it is built, 50 after, besides the text.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW, shingle: int = SHINGLE):
        items = [(item, text) for item, text in items if text]
        self.shingle = shingle
        self.names = [item for item, _ in items]
        self.text = b" " + b" ".join(text for _, text in items) + b" "
        spaces = np.flatnonzero(np.frombuffer(self.text, np.uint8) == 0x20)
        self.begin = spaces  # the space before each word, and after the last one
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *(word_hashes(text.split(b" ")) for _, text in items)])
        many = np.array([text.count(b" ") + 1 for _, text in items], np.int64)
        size = np.minimum(many, window)
        places = many - size + 1
        base = np.cumsum(many) - many
        owner = np.repeat(np.arange(len(items), dtype=np.int32), places)
        at = (np.arange(places.sum()) - np.repeat(np.cumsum(places) - places - base, places)).astype(np.int32)
        sizes = np.repeat(size.astype(np.int32), places)
        self._distinct(at, sizes, owner)
        # shingles of short windows have fewer words, so look-ups go by shingle size
        width = np.minimum(self.size, shingle)
        self.sizes = np.unique(width).tolist()
        self.tables = {}
        for k in self.sizes:
            used = np.zeros(len(self.hashes) + 1, np.int32)
            of = width == k
            np.add.at(used, self.at[of], 1)
            np.add.at(used, self.at[of] + self.size[of] - k + 1, -1)
            self.tables[k] = Shingles(shingle_hashes(self.hashes, k)[np.flatnonzero(np.cumsum(used[:-1]) > 0)])

    def _window(self, at: int, size: int) -> bytes:
        return self.text[self.begin[at]:self.begin[at + size] + 1]

    def _distinct(self, at: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> None:
        """Keep equal windows once (equal hashes are compared byte by byte), with their items."""
        mark = np.zeros(len(at), np.uint64)
        for n in np.unique(sizes).tolist():
            of = np.flatnonzero(sizes == n)
            mark[of] = shingle_hashes(self.hashes, n)[at[of]]
        order = np.argsort(mark, kind="stable").astype(np.int32)
        mark = mark[order]
        new = np.concatenate(([True], mark[1:] != mark[:-1]))[:len(at)]
        first = np.maximum.accumulate(np.where(new, np.arange(len(at), dtype=np.int32), 0))
        for i in np.flatnonzero(~new).tolist():
            x, y = int(order[i]), int(order[first[i]])
            new[i] = sizes[x] != sizes[y] or self._window(int(at[x]), int(sizes[x])) != self._window(int(at[y]), int(sizes[y]))
        # number the different windows by their places, which keeps look-ups near each other
        stays = np.sort(order[new])
        number = np.empty(len(at), np.int32)
        number[order] = order[new][np.cumsum(new) - 1]
        self.at, self.size = at[stays].astype(np.int32), sizes[stays]
        mark[order] = mark.copy()
        self.mark = mark[stays]
        number = np.searchsorted(stays, number)
        items = max(1, len(self.names))
        pairs = np.unique(number * items + owner)
        self.owner = (pairs % items).astype(np.int32)
        self.owners_of = np.searchsorted(pairs // items, np.arange(len(self.at) + 1)).astype(np.int32)

    def order_by(self, counts: dict[int, np.ndarray]) -> None:
        """File each window under its rarest shingle (ties: the smaller hash, then the earlier place). ``counts``: for each
        shingle size the number of places of each shingle of the table; shingles past the end have none."""
        self.offset = np.zeros(len(self.at), np.int32)
        self.lookup, self.filed, self.bounds = {}, {}, {}
        width = np.minimum(self.size, self.shingle)
        for k in self.sizes:
            of = np.flatnonzero(width == k)
            table, known = self.tables[k].hashes, np.zeros(len(self.tables[k].hashes), np.int64)
            given = counts.get(k, known[:0])
            known[:len(given)] = given
            h = shingle_hashes(self.hashes, k)
            often = known[np.minimum(np.searchsorted(table, h), len(table) - 1)]
            best = np.empty(len(of), np.uint64)
            for a in range(0, len(of), CHUNK):
                some = of[a:a + CHUNK]
                span = np.arange(int(self.size[some].max()) - k + 1)
                inside = span <= (self.size[some] - k)[:, None]
                places = np.minimum(self.at[some][:, None] + span, len(h) - 1)
                n = np.where(inside, often[places], np.iinfo(np.int64).max)
                x = np.where(n == n.min(axis=1, keepdims=True), h[places], np.uint64(2**64 - 1))
                self.offset[some] = np.argmin(np.where(inside, x, np.uint64(2**64 - 1)), axis=1)
                best[a:a + CHUNK] = h[self.at[some] + self.offset[some]]
            order = np.argsort(best, kind="stable").astype(np.int32)
            self.lookup[k], self.filed[k] = Shingles(best), of[order].astype(np.int32)
            self.bounds[k] = np.append(np.searchsorted(best[order], self.lookup[k].hashes), len(of))

    def counted(self, words: list[bytes], into: dict[int, np.ndarray]) -> None:
        """Add the places of the benchmark shingles in a word sequence."""
        h = word_hashes(words)
        for k in self.sizes:
            _, idx = self.tables[k].find(shingle_hashes(h, k))
            if len(idx):
                np.add.at(into[k], idx, 1)

    def _candidates(self, h: np.ndarray):
        """(first words, windows) that a prefix proposes and that keep the bounds, in runs of about ``RUN``."""
        for k in self.sizes:
            places, idx = self.lookup[k].find(shingle_hashes(h, k))
            if not len(places):
                continue
            many = self.bounds[k][idx + 1] - self.bounds[k][idx]
            cuts = np.flatnonzero(np.diff(np.cumsum(many) // RUN)) + 1
            for part in np.split(np.arange(len(places)), cuts):
                each = many[part]
                inner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                which = self.filed[k][np.repeat(self.bounds[k][idx[part]], each) + inner]
                start = np.repeat(places[part], each) - self.offset[which]
                ok = (start >= 0) & (start + self.size[which] <= len(h))
                yield start[ok], which[ok]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(start, end) word ranges of all windows in a word sequence, and the items that they come from."""
        h = word_hashes(words)
        joined, begin = None, None
        spans, found, marks = [], set(), {}
        for starts, which in self._candidates(h):
            for n in np.unique(self.size[which]).tolist():
                if n not in marks:
                    marks[n] = shingle_hashes(h, n)
                of = self.size[which] == n
                like = of.nonzero()[0][marks[n][starts[of]] == self.mark[which[of]]]
                for start, w in zip(starts[like].tolist(), which[like].tolist(), strict=True):
                    if joined is None:
                        joined = b" " + b" ".join(words) + b" "
                        begin = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))
                    if joined.startswith(self._window(int(self.at[w]), n), int(begin[start])):
                        spans.append((start, start + n))
                        found.add(w)
        return spans, {self.names[i] for w in found for i in self.owner[self.owners_of[w]:self.owners_of[w + 1]].tolist()}


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of word ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _runs(words: list[bytes], window: int):
    """The words in runs of at most ``BLOCK_WINDOWS`` windows that hold each window once."""
    for k in range(0, max(1, len(words) - window + 1), BLOCK_WINDOWS):
        yield words[k:k + BLOCK_WINDOWS + window - 1]


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int):
    """The items' words, joined, in blocks of bounded size, read through a local iterator (one partition at a time)."""
    rows = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"),
                            F.col(f"`{text_col}`").alias("text"))
    block, size, windows = [], 0, 0
    for r in rows.toLocalIterator():
        for words in _runs(alnum_words(r["text"]), window):
            if block and windows + len(words) > BLOCK_WINDOWS + window:
                yield block
                block, size, windows = [], 0, 0
            block.append((r["item"], b" ".join(words)))
            size += len(block[-1][1])
            windows += max(1, len(words) - window + 1)
            if size >= BLOCK_BYTES:
                yield block
                block, size, windows = [], 0, 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", window: int = WINDOW, carry: str | None = None) -> DataFrame:
    """doc_id, n_words, spans (disjoint word ranges hit), items (ids, sorted as strings) of every row, and ``carry``."""
    spark = docs.sparkSession
    ship_package(spark)
    more = [carry] if carry else []
    base = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *more)
    blocks = _item_blocks(benchmark, item_id_col, "text", window)
    block, following = next(blocks, []), next(blocks, None)
    if following is None:
        return _block_hits(base, block, window, more)
    base = written(base.withColumn("row_no", F.monotonically_increasing_id()), "numbered-texts")
    parts = []
    while block:
        parts.append(written(_block_hits(base, block, window, [*more, "row_no"]), "block-hits"))
        block, following = following, next(blocks, None)
    return _merged(parts, more)


def _block_hits(base: DataFrame, block: list, window: int, more: list[str]) -> DataFrame:
    sc, key = base.sparkSession.sparkContext, uuid.uuid4().hex
    shared = sc.broadcast((block, window))
    return _find(base, key, shared, sc.broadcast(_shingle_counts(base, key, shared)), more)


_INDEX: dict[str, WindowIndex] = {}


def _index(key: str, shared, ordered=None) -> WindowIndex:
    """The index of a broadcast block, built once in each process."""
    if key not in _INDEX:
        _INDEX.clear()
        _INDEX[key] = WindowIndex(*shared.value)
    index = _INDEX[key]
    if ordered is not None and not hasattr(index, "lookup"):
        index.order_by(ordered.value)
    return index


def _shingle_counts(base: DataFrame, key: str, shared) -> dict[int, np.ndarray]:
    """For each shingle size the places of each benchmark shingle of the block in all documents: one number a shingle that
    occurs, gathered on the driver (a block has at most ``BLOCK_WINDOWS`` windows)."""
    def run(batches):
        index = _index(key, shared)
        counts = {k: np.zeros(len(t.hashes), np.int64) for k, t in index.tables.items()}
        for batch in batches:
            for text in batch.column("text"):
                index.counted(alnum_words(text.as_py()), counts)
        for k, n in counts.items():
            found = np.flatnonzero(n)
            for i in range(0, len(found), 100_000):
                some = found[i:i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)),
                                                  pa.array(n[some])], ["size", "shingle", "n"])

    rows = base.select("text").mapInArrow(run, "size int, shingle int, n bigint")
    sums = rows.groupBy("size", "shingle").agg(F.sum("n").alias("n")).toArrow()
    size, shingle, n = (sums.column(c).to_numpy() for c in ("size", "shingle", "n"))
    out = {}
    for k in np.unique(size).tolist():
        of = size == k
        out[k] = np.zeros(int(shingle[of].max()) + 1, np.int64)
        out[k][shingle[of]] = n[of]
    return out


SPANS = "array<struct<first:bigint,past:bigint>>"


def _find(base: DataFrame, key: str, shared, ordered, more: list[str]) -> DataFrame:
    kind = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = _index(key, shared, ordered)
        n, spans, items = [], [], []
        for text in batch.column("text").to_pylist():
            words = alnum_words(text)
            found, who = index.hits(words)
            n.append(len(words))
            spans.append([{"first": a, "past": b} for a, b in covered(found)])
            items.append(sorted(who))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string())),
             *(batch.column(c) for c in more)], ["doc_id", "n_words", "spans", "items", *more])

    schema = f"doc_id bigint, n_words bigint, spans {SPANS}, items array<string>" + "".join(
        f", {c} {base.schema[c].dataType.simpleString()}" for c in more)
    return map_slices(base, one, schema)


def _merged(parts: list[DataFrame], more: list[str]) -> DataFrame:
    """One row for each document row from those of the blocks (hits only are shuffled, by row number)."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    hit = (every.where(F.size("items") > 0).groupBy("row_no")
           .agg(F.flatten(F.collect_list("spans")).alias("more_spans"), F.flatten(F.collect_list("items")).alias("more_items")))
    hit = hit.select("row_no", "more_items", F.array_sort("more_spans").alias("more_spans"))
    joined = F.aggregate("more_spans", F.array().cast(SPANS), lambda out, x: F.when(
        (F.size(out) > 0) & (x["first"] <= F.element_at(out, -1)["past"]),
        F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(
            F.element_at(out, -1)["first"].alias("first"),
            F.greatest(F.element_at(out, -1)["past"], x["past"]).alias("past"))))).otherwise(F.concat(out, F.array(x))))
    hit = hit.select("row_no", joined.alias("spans"), F.array_sort(F.array_distinct("more_items")).alias("items"))
    return parts[0].select("row_no", "doc_id", "n_words", *more).join(hit, "row_no", "left").select(
        "doc_id", "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), *more)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["past"] - x["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without benchmark windows, all columns."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.select("row", F.col("row").getField(id_col).alias("doc_id"), F.col("row").getField(text_col).alias("text"))
    return contaminated(rows, benchmark, carry="row").where(F.size("spans") == 0).select("row.*")
