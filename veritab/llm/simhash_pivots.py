"""Operator 9: SimHash near-duplicates with pivot distance tables.

A fingerprint has 64 bits, a majority vote over the XXH64 hashes of the word shingles. Two fingerprints link if they
differ in at most ``MAX_BITS`` (2) bits; the classes are the connected components of all links.

1. Equal fingerprints are one row from here on (pre-aggregated, so groups of exact copies cost one row each).
2. Candidates: the 64 bits are cut into 5 blocks. If two fingerprints differ in at most 2 bits, at least 3 blocks are
   equal, so each of the 10 choices of 3 blocks is a join key (38 or 39 bits) and no link is lost.
3. Pivot distance table: the Hamming distances of each fingerprint to ``PIVOTS`` fixed reference fingerprints are
   computed once. By the triangle inequality a pair whose distances to some pivot differ by more than 2 cannot link, so
   pairs are discarded by their maximum coordinate difference before the exact distance of the survivors is verified.
4. Keys shared by more than ``PAIR_LIMIT`` fingerprints (large groups of near copies) are not paired at all. Their
   members instead list the 65 values within one bit of them: two fingerprints differ in at most 2 bits if and only if
   they share such a value, and all members of one value link to each other. So each value gives links from its members
   to their smallest one: exact, and linear in the members (a value has 65 members at most).
5. Components: the smallest node of the neighbourhood is taken over along the links and links are moved to it until
   nothing changes (a few rounds; each is written to the shared folder). Only counts reach the driver.

Cases: null, empty and blank texts have fingerprint zero and link like any other; texts of fewer words than a shingle
are one shingle; repeated rows each give a row; null ids are passed over when the smallest id is looked for (a class
without any id has a null component); empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_slices, space_words, written

SHINGLE = 3
MAX_BITS = 2
SEED = 42
PIVOTS = 12
#: Members of a key that are still paired with each other.
PAIR_LIMIT = 24
#: First bit and width of each block.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]


def fingerprint(words: list[bytes], size: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a word sequence as an unsigned number; zero without words."""
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = np.concatenate(([0], ends[:n - 1])).tolist()
    last = (ends[min(size, len(words)) - 1:] - 1).tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(first, last, strict=True)], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        bits = np.unpackbits(hashes[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                 carry: str | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed 64-bit number) and the column ``carry`` of every row."""
    more = [carry] if carry else []

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(space_words(t), size) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64)), *(batch.column(c) for c in more)],
            ["doc_id", "fp", *more])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *more)
    schema = "doc_id bigint, fp bigint" + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in more)
    return map_slices(rows, one, schema)


def pivot_values(n: int = PIVOTS) -> list[int]:
    """The reference fingerprints, signed: fixed pseudo-random values."""
    return [int(x) for x in np.random.default_rng(SEED).integers(-2**63, 2**63 - 1, size=n, dtype=np.int64)]


def _block(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def block_keys() -> Column:
    """The join keys of a fingerprint: one number for each choice of 3 blocks; the choice is in the low bits."""
    keys = []
    for k, chosen in enumerate(combinations(BLOCKS, len(BLOCKS) - MAX_BITS)):
        value = F.lit(0).cast("bigint")
        for first, width in chosen:
            value = F.shiftleft(value, width).bitwiseOR(_block(F.col("fp"), first, width))
        keys.append(F.shiftleft(value, 4).bitwiseOR(F.lit(k).cast("bigint")))
    return F.array(*keys)


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame) -> DataFrame:
    """(a, b), a < b: links whose components are those of all pairs of distinct fingerprints within ``MAX_BITS``."""
    keyed = fps.select("fp", F.explode(block_keys()).alias("key"))
    shared = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "key-counts")
    met = written(keyed.join(shared, "key"), "shared-keys")

    table = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p).cast("bigint"))).cast("tinyint").alias(f"d{i}")
             for i, p in enumerate(pivot_values())]
    few = met.where(F.col("members") <= PAIR_LIMIT).select("key", "fp", *table)
    left = few.select("key", F.col("fp").alias("a"), *(F.col(f"d{i}").alias(f"x{i}") for i in range(PIVOTS)))
    right = few.select("key", F.col("fp").alias("b"), *(F.col(f"d{i}").alias(f"y{i}") for i in range(PIVOTS)))
    apart = F.greatest(*(F.abs(F.col(f"x{i}") - F.col(f"y{i}")) for i in range(PIVOTS)))
    pairs = (left.join(right, "key").where("a < b").where(apart <= MAX_BITS)
             .where(distance("a", "b") <= MAX_BITS).select("a", "b"))

    many = met.where(F.col("members") > PAIR_LIMIT).select("fp").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *(F.lit((1 << i) - (1 << 64) * (i == 63)).cast("bigint") for i in range(64)))
    near = many.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("value"))
    star = (near.groupBy("value").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all"))
            .where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a < b"))
    return pairs.unionByName(star).distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for every node of the links, root the smallest node of its component.

    Rounds of two steps until the links are stable: large star (each node links its larger neighbours to the smallest
    node around it), small star (each node links itself and its smaller neighbours to the smallest). Both keep the
    components, and the links end as stars around the roots. Minima are pre-aggregated and written before they are
    joined back, so that a join with a node of very many links can be split.
    """
    edges = written(edges, "links")
    if edges.isEmpty():
        return edges.selectExpr("a AS node", "b AS root")
    before = None
    for _ in range(rounds):
        both = edges.union(edges.selectExpr("b AS a", "a AS b"))
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "lowest")
        large = written(both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").distinct(), "large-star")
        low = written(large.groupBy("b").agg(F.min("a").alias("m")), "lowest")
        small = large.join(low, "b").where("m < a").select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges = written(small.union(low.select(F.col("m").alias("a"), "b")).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.selectExpr("b AS node", "a AS root")
        before = now
    raise RuntimeError(f"components are not stable after {rounds} rounds")


def class_ids(fps: DataFrame) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint of a table (doc_id, fp)."""
    first = written(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "fingerprints")
    root = components(links(first)).withColumnRenamed("node", "fp")
    rooted = written(first.join(root, "fp", "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root")), "roots")
    small = written(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "component-ids")
    return written(rooted.join(small, "root").select("fp", "component_id"), "class-ids")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    fps = written(fingerprints(docs, id_col, text_col, size), "row-fingerprints")
    return fps.join(class_ids(fps), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, all columns: of each class the row with the smallest id (null ids
    last, then the first row) stays. Rows get a number when they are written to the shared folder, so that repeated rows
    differ and a lost executor changes nothing."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                       F.monotonically_increasing_id().alias("row_no"))
    rows = written(rows, "numbered-rows")
    split = rows.select(F.col("row").getField(id_col).alias("doc_id"), F.col("row").getField(text_col).alias("text"), "row_no")
    fps = written(fingerprints(split, size=size, carry="row_no"), "row-fingerprints")
    kept = (fps.join(class_ids_by_row(fps), "fp").groupBy("class")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no")).alias("best"))
            .select(F.col("best.row_no").alias("row_no")))
    return rows.join(kept, "row_no", "left_semi").select("row.*")


def class_ids_by_row(fps: DataFrame) -> DataFrame:
    """(fp, class): class is the smallest fingerprint of the component, which is never null."""
    first = written(fps.select("fp").distinct(), "fingerprints")
    root = components(links(first)).withColumnRenamed("node", "fp")
    return written(first.join(root, "fp", "left").select("fp", F.coalesce("root", "fp").alias("class")), "classes")
