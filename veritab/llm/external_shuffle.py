"""Operator 6: sharding by a two-pass external shuffle.

Pass 1 scatters the rows uniformly into buckets that fit into memory: the bucket of a row is a seeded hash of its id,
its text and its row number, so equal rows, copies and null ids spread like any others. Pass 2 takes each bucket
into memory, puts it into hash order (the order in which a shuffle delivers rows is not fixed), shuffles it with
Fisher-Yates from a generator seeded by (seed, bucket) and writes it. The concatenated buckets are a random permutation
of the whole table; every row's place in it is the number of rows in earlier buckets plus its place in its own.

Law ``rows``: shard s takes the places from ``ceil(s * n / shards)`` on, so shards are runs of the permutation whose
counts are at most one apart, and the slot is the place within the run.

Only bucket counts (a few bytes a bucket) are summed up front; they are pre-aggregated and kept as a table. The
shuffled buckets are written to the shared folder, from which the result is read, so lost executors change nothing.

Cases: null texts have size 1 and the CRC of an empty text; an empty table gives an empty result; other columns of any
name are carried along unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_package, written

SEED = 20_240_229
SHARDS = 16
#: Text bytes of a bucket.
BUCKET_BYTES = 16 << 20
#: Buckets that are summed in one task when places are counted.
GROUP = 4096
#: Up to so many buckets (16 bytes each) their offsets are broadcast; beyond that they are joined.
BROADCAST_BUCKETS = 500_000


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniformly random order of ``range(n)``: each place, from the last down, swaps with one at or before it."""
    order = np.arange(n)
    picks = rng.integers(0, np.arange(n, 0, -1)) if n else order
    seq, swaps = order.tolist(), picks.tolist()
    for i, j in zip(range(n - 1, -1, -1), swaps, strict=True):
        seq[i], seq[j] = seq[j], seq[i]
    return np.array(seq, dtype=np.int64)


def shuffled_buckets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = SEED,
                     bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """(row, bucket, place): the rows as structs, in the shuffled order of their bucket; and the number of buckets."""
    spark = docs.sparkSession
    ship_package(spark)
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)) + 1
    total = docs.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    buckets = max(-(-total // bucket_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                       F.monotonically_increasing_id().alias("row_no"))
    mix = F.xxhash64(F.lit(seed), F.col("row").getField(id_col), F.col("row").getField(text_col), "row_no")
    rows = rows.select("row", mix.alias("mix")).select(
        "row", "mix", F.pmod(F.xxhash64(F.lit(seed + 1), "mix"), F.lit(buckets)).alias("bucket"))
    kind = rows.schema["row"].dataType.simpleString()

    def shuffle(key, table):
        table = table.sort_by("mix")
        order = fisher_yates(table.num_rows, np.random.default_rng([seed, key[0].as_py()]))
        out = table.select(["row", "bucket"]).take(pa.array(order))
        return out.append_column("place", pa.array(np.arange(table.num_rows), pa.int64()))

    done = rows.groupBy("bucket").applyInArrow(shuffle, f"row {kind}, bucket bigint, place bigint")
    return written(done, "shuffled-buckets"), buckets


def bucket_offsets(rows: DataFrame) -> DataFrame:
    """(bucket, before): rows in earlier buckets. Summed in two levels, so that no task sees more than a group."""
    from pyspark.sql import Window

    counts = written(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket-counts")
    group = F.floor(F.col("bucket") / GROUP).alias("part")
    parts = counts.groupBy(group).agg(F.sum("n").alias("n"))
    earlier = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_before"))
    within = Window.partitionBy("part").orderBy("bucket")
    return (counts.select("bucket", group, "n").withColumn("inside", F.sum("n").over(within) - F.col("n"))
            .join(earlier, "part").select("bucket", (F.col("part_before") + F.col("inside")).alias("before")))


def shard_and_slot(at: str, n: int, shards: int) -> tuple[Column, Column]:
    """Shard and slot of the place in the column ``at`` among ``n`` ones. Whole numbers throughout: a quotient of decimals
    or doubles is rounded, and places near the end of a shard would go to the next one."""
    n = max(n, 1)
    shard = f"({at} * {shards}L) div {n}L"
    return F.expr(f"cast({shard} AS int)"), F.expr(f"{at} - ({shard} * {n}L + {shards - 1}L) div {shards}L")


def external_shuffle(docs: DataFrame, shards: int = SHARDS, text_col: str = "text", id_col: str = "doc_id",
                     seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(row, shard, slot) of every row: the row as a struct of all its columns, slots without gaps from 0."""
    rows, buckets = shuffled_buckets(docs, text_col, id_col, seed, bucket_bytes)
    n = rows.count()
    offsets = bucket_offsets(rows)
    offsets = F.broadcast(offsets) if buckets <= BROADCAST_BUCKETS else offsets
    at = rows.join(offsets, "bucket").select("row", (F.col("before") + F.col("place")).alias("at"))
    shard, slot = shard_and_slot("at", n, shards)
    return at.select("row", shard.alias("shard"), slot.alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the rows as Parquet, one folder a shard, in the order of their slots within each file."""
    sharded.select("row.*", "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(sharded: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    return sharded.select(
        F.col("row").getField(id_col).cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
