"""Operator 13: ranked lexical search of many items at once, by evaluating what the items share only once.

1. Items are dealt by a hash of their id into blocks of about ``BLOCK_TERMS`` distinct (item, term) pairs (one block as a
   rule; a single item is never cut, so a block is bounded by that or by the distinct terms of its longest item). Only a
   block at a time is held by the driver and sent to the tasks.
2. The texts are read once for a block: a posting row a document, with its number of terms and the counts of those terms
   that the block's items hold, goes to the shared folder. Document frequencies are sums over it.
3. Shared term sets are mined among the items of the block: terms that stand in the same items are one class; then, round
   after round, pairs of nodes that the most items hold together become a node of their own that replaces both in those
   items, as common subexpressions are found in linear systems. The result is a DAG: classes of terms at the bottom, nodes
   with two parts above, and for each item the few nodes whose union it is.
4. For a run of documents, the accumulator of every class and node is worked out once, level by level of the DAG; an item's
   scores are the sums of its nodes' accumulators. All of it is 64-bit whole numbers, so sharing changes no score.
5. Each task keeps the best ``k`` documents of every item (all documents at the k-th score are looked at before ids decide)
   and hands them on; two windows pick the best of all tasks.

Memory: documents are scored in runs such that nodes x documents stays below ``CELLS`` numbers; longer texts than a slice
are cut between words while they are counted. Recovery: postings are written to the shared folder; the rest is narrow.

Cases: null texts have no terms and are not found; rows with the same item id are one item with the terms of all of them, a
null id too; repeated documents are ranked each; equal scores go by the smaller id, null ids last; items without terms,
empty tables and documents without a common term give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM_TABLE, ship_package, written
from .wordruns import byte_table, chunks, word_runs

TOP = 10
#: Distinct (item, term) pairs of a block of items.
BLOCK_TERMS = 200_000
#: Numbers of an accumulator table: nodes of the DAG times documents of a run.
CELLS = 2 << 20
#: Text bytes that are split into words at once.
SLICE = 8 << 20
#: When pairs are mined, a node is paired with so many neighbours of its item, in the order of frequency.
NEIGHBOURS = 64
ROUNDS = 40
#: Parts in which the best rows of an item, from all tasks, are ordered at the first level.
SALTS = 64
KIND, LOWER = byte_table(bytes(b for b in range(256) if ALNUM_TABLE[b] == 0x20))


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term: the distinct terms of every item."""
    ship_package(items.sparkSession)
    rows = items.select(F.col(f"`{item_col}`").alias("item_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = rows.schema["item_id"].dataType

    def run(batches):
        for batch in batches:
            for at, texts in chunks(batch.column("text"), KIND, SLICE):
                got = word_runs(texts, KIND, LOWER)
                pairs = pa.table({"item_id": batch.column("item_id").take(pa.array(at[got.row])),
                                  "term": got.words.cast(pa.string())})
                yield from pairs.group_by(["item_id", "term"]).aggregate([]).to_batches()
    return rows.mapInArrow(run, f"item_id {kind.simpleString()}, term string").distinct()


def shared_sets(item_sets: list[set[int]]) -> tuple[list[list[int]], list[tuple[int, int]], list[list[int]]]:
    """Mine what the items share. Returns the classes (lists of terms, nodes 0, 1, ...), the nodes made of two others
    (numbered on from there), and each item's nodes; the terms below an item's nodes are its terms, each once."""
    holders = defaultdict(list)
    for i, terms in enumerate(item_sets):
        for t in terms:
            holders[t].append(i)
    groups = defaultdict(list)
    for t in sorted(holders):
        groups[tuple(holders[t])].append(t)
    classes = list(groups.values())
    held = {c: set(items) for c, items in enumerate(groups)}
    nodes = [set() for _ in item_sets]
    for c, items in held.items():
        for i in items:
            nodes[i].add(c)
    pairs: list[tuple[int, int]] = []
    for _ in range(ROUNDS):
        together = Counter()
        for mine in nodes:
            shared = sorted((n for n in mine if len(held[n]) > 1), key=lambda n: (-len(held[n]), n))
            for at, a in enumerate(shared):
                for b in shared[at + 1:at + 1 + NEIGHBOURS]:
                    together[(a, b) if a < b else (b, a)] += 1
        made = 0
        for (a, b), n in sorted((x for x in together.items() if x[1] > 1), key=lambda x: (-x[1], x[0])):
            both = held[a] & held[b]
            if len(both) < 2 or len(both) * 2 < n:     # others took most of them in this round: count again
                continue
            new = len(classes) + len(pairs)
            pairs.append((a, b))
            held[new] = both
            held[a], held[b] = held[a] - both, held[b] - both
            for i in both:
                nodes[i] -= {a, b}
                nodes[i].add(new)
            made += 1
        if not made:
            break
    return classes, pairs, [sorted(x) for x in nodes]


class Evaluation:
    """The DAG of a block in arrays: scores of all items for runs of documents."""

    def __init__(self, terms: int, classes: list, pairs: list, nodes: list):
        self.size = len(classes) + len(pairs)
        self.class_of = np.zeros(terms, np.int64)
        for c, members in enumerate(classes):
            self.class_of[members] = c
        depth = np.zeros(self.size, np.int64)
        for at, (a, b) in enumerate(pairs, len(classes)):
            depth[at] = 1 + max(depth[a], depth[b])
        parts = np.array(pairs, np.int64).reshape(-1, 2)
        self.levels = []
        for level in range(1, int(depth.max(initial=0)) + 1):
            at = np.flatnonzero(depth == level)
            self.levels.append((at, parts[at - len(classes), 0], parts[at - len(classes), 1]))
        self.nodes = np.array([n for mine in nodes for n in mine], np.int64)
        self.starts = np.cumsum([0, *map(len, nodes)])[:-1]
        self.run = max(1, CELLS // max(self.size, len(self.nodes), 1))

    def scores(self, doc: np.ndarray, term: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
        """[items, docs]: the sums of the values of each item's terms."""
        table = np.zeros((self.size, docs), np.int64)
        np.add.at(table, (self.class_of[term], doc), value)
        for at, a, b in self.levels:
            table[at] = table[a] + table[b]
        return np.add.reduceat(table[self.nodes], self.starts, axis=0)


def postings(docs: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, terms, counts of every document: all its terms with repeats, and the counts of the given terms."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast(terms)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def run(batches):
        known = pa.array(share.value, pa.large_string()).cast(pa.large_binary())
        for batch in batches:
            size = batch.num_rows
            n = np.zeros(size, np.int64)
            cells, counts = [], []
            for at, texts in chunks(batch.column("text"), KIND, SLICE):
                got = word_runs(texts, KIND, LOWER)
                row = at[got.row]
                n += np.bincount(row, minlength=size)
                codes = got.words.dictionary_encode()
                place = pc.index_in(codes.dictionary, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
                term = place[codes.indices.to_numpy(zero_copy_only=False)].astype(np.int64)
                cell, c = np.unique(row[term >= 0] * len(known) + term[term >= 0], return_counts=True)
                cells.append(cell)
                counts.append(c)
            cell, place = np.unique(np.concatenate([np.zeros(0, np.int64), *cells]), return_inverse=True)
            count = np.zeros(len(cell), np.int64)      # whole numbers: a cut text has the same cell in several chunks
            np.add.at(count, place, np.concatenate([np.zeros(0, np.int64), *counts]))
            wide = max(len(known), 1)
            ends = pa.array(np.searchsorted(cell // wide, np.arange(size + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.ListArray.from_arrays(ends, pa.array(cell % wide, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(count))], names=["doc_id", "n", "terms", "counts"])
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


def best_of(item: np.ndarray, doc: np.ndarray, null: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of every item: score descending, null ids last, smaller ids first."""
    order = np.lexsort((doc, null, -score, item))
    mine = item[order]
    rank = np.arange(len(mine)) - np.searchsorted(mine, mine)
    return order[rank < k]


def _block_best(posted: DataFrame, weights: np.ndarray, evaluation: Evaluation, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item, doc_id, score: the k best documents of every item in each task."""
    share = posted.sparkSession.sparkContext.broadcast((weights, evaluation))

    def run(batches):
        weights, plan = share.value
        empty = np.zeros(0, np.int64)
        best = (empty, empty, empty.astype(bool), empty)
        for batch in batches:
            for a in range(0, batch.num_rows, plan.run):
                part = batch.slice(a, plan.run)
                docs = part.num_rows
                n = part.column("n").to_numpy(zero_copy_only=False)
                lists = part.column("terms")
                doc = np.repeat(np.arange(docs), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                term = lists.flatten().to_numpy(zero_copy_only=False)
                count = part.column("counts").flatten().to_numpy(zero_copy_only=False)
                m = 100 - 90 + (90 * n * n_docs) // max(n_terms, 1)
                value = weights[term] * ((1_000_000_000 * count) // (1000 * count + 8 * m[doc]))
                scores = plan.scores(doc, term, value, docs)
                # a document can only be among the best if it reaches the k-th score of this run of documents
                floor = np.partition(scores, docs - k, axis=1)[:, docs - k] if docs > k else np.zeros(len(scores), np.int64)
                item, at = np.nonzero((scores > 0) & (scores >= floor[:, None]))
                ids = part.column("doc_id")
                null = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
                rows = [np.concatenate(x) for x in zip(best, (item, ids[at], null[at], scores[item, at]), strict=True)]
                keep = best_of(*rows, k)
                best = tuple(x[keep] for x in rows)
        item, doc, null, score = best
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64(), mask=null), pa.array(score)],
                                         names=["item", "doc_id", "score"])
    return posted.mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item."""
    spark = docs.sparkSession
    pairs = written(item_terms(items, item_col, item_text_col), "search-items")
    blocks = max(1, -(-pairs.count() // block_terms))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    kind = pairs.schema["item_id"].dataType.simpleString()
    found, corpus = None, None
    for b in range(blocks):
        mine = pairs.where(F.col("block") == b).select("item_id", "term").toArrow().to_pydict()
        if not mine["term"]:
            continue
        terms = sorted(set(mine["term"]))
        number = {t: i for i, t in enumerate(terms)}
        sets: dict = defaultdict(set)
        for item, term in zip(mine["item_id"], mine["term"], strict=True):
            sets[item].add(number[term])
        posted = written(postings(docs, terms, id_col, text_col), "search-postings")
        if corpus is None:
            corpus = posted.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"), F.sum("n").alias("l")).first()
        n_docs, n_terms = corpus["n"], corpus["l"] or 0
        df = np.zeros(len(terms), np.int64)
        holding = posted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toArrow()
        df[holding.column("t").to_numpy()] = holding.column("df").to_numpy()
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        plan = Evaluation(len(terms), *shared_sets(list(sets.values())))
        best = _block_best(posted, weights, plan, n_docs, n_terms, k)
        names = spark.createDataFrame(list(enumerate(sets)), f"item int, item_id {kind}")
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        some = best.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        for keys in (("item", "salt"), ("item",)):
            some = some.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        rows = some.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = rows if found is None else found.unionByName(rows)
    return found if found is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
