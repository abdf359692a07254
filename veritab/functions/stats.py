"""Reusable aggregate building blocks: exact percentiles, guarded correlation, running totals,
long value counts. All are DataFrame compositions; nothing here pulls data rows to the driver
beyond small, bounded summaries (quantile edges, per-key brackets)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .types import as_text, is_complex, is_string, qc

BROADCAST_ROWS = 200_000       # largest side we broadcast after counting it
TASK_ROWS = 250_000            # rows of a task that keeps, or goes over and over, whole rows
FEW_ROWS = TASK_ROWS // 10     # rows below which a task is not worth its start


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when den is 0 or NULL (never raises under ANSI mode)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson r over rows where both sides are present; NULL for constant or too-short input."""
    both = x.isNotNull() & y.isNotNull()
    xs = F.when(both, x.cast("double"))
    ys = F.when(both, y.cast("double"))
    r = F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))
    # clamp rounding overshoot; greatest/least skip NULLs, so keep an undefined r NULL explicitly
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def materialize_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Run ``df`` once. A small result (<= ``limit`` rows, e.g. per-column or per-class summaries) is
    rebuilt as a local relation, which cuts the lineage so later uses never rescan the input; a larger
    result is checkpointed to the shared checkpoint folder instead."""
    rows = df.limit(limit + 1).collect()
    if len(rows) <= limit:
        return df.sparkSession.createDataFrame(rows, df.schema)
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side only after counting it; larger sides go through a shuffle join."""
    return F.broadcast(df) if df.count() <= limit else df


def spread(df: DataFrame, rows: int, key: str) -> DataFrame:
    """The ``rows`` rows, dealt by the hash of a key of different values over as many tasks as hold ``TASK_ROWS`` each, if
    one task has more of them than that. The rows of the tasks are counted: a file is cut by its bytes into as many tasks,
    but all rows of a row group fall to one of them, and the others are empty. There are more tasks, down to ``FEW_ROWS``
    each, until the cores run them in whole rounds: fits go over the rows hundreds of times, each time waiting for the last."""
    tasks = -(-rows // TASK_ROWS)
    if tasks <= 1:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(tasks, min(-(-tasks // cores) * cores, rows // FEW_ROWS))
    most = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return df.repartition(tasks, qc(key)) if most > TASK_ROWS else df


# --------------------------------------------------------------------------------------------
# long value counts
# --------------------------------------------------------------------------------------------

def _per_column(df: DataFrame, columns: Sequence[str] | None, digests: bool) -> DataFrame | None:
    """(ordinal, value, cnt) per distinct non-null value: one typed aggregation per column, in one job. A columnar source
    gives each branch only its own column, so all branches together read the table once; hot values collapse before the
    shuffle. With ``digests`` texts are grouped by their SHA-256 and ``value`` is not their text."""
    out = None
    for i, f in enumerate(df.schema.fields):
        if columns is not None and f.name not in columns:
            continue
        c = qc(f.name)
        text = is_string(f.dataType) or is_complex(f.dataType)
        key = as_text(f.name, f.dataType) if text else c
        grouped = df.where(c.isNotNull()).groupBy((F.sha2(key, 256) if text and digests else key).alias("k")).agg(
            F.count(F.lit(1)).alias("cnt"))
        value = F.col("k") if text else as_text("k", f.dataType)
        part = grouped.select(F.lit(i).alias("ordinal"), value.alias("value"), "cnt")
        out = part if out is None else out.unionByName(part)
    return out


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(ordinal, value, cnt): one row per distinct non-null value of each column, values of every length as they are."""
    out = _per_column(df, columns, digests=False)
    return out if out is not None else df.sparkSession.createDataFrame([], "ordinal int, value string, cnt long")


def _reads_columns(df: DataFrame) -> bool:
    """Whether the frame is a projection or filter of one Parquet or ORC table, which each branch of a job may read anew by
    its own column; anything else (text files, joins, aggregates) is better read once."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().strip().split("\n")
    names = [line.lstrip(" :+-").split(" ", 1)[0] for line in lines]
    return set(names[:-1]) <= {"Project", "Filter"} and names[-1] == "Relation" and lines[-1].rstrip().endswith((" parquet", " orc"))


def _typed_key(f) -> Column:
    """A column as something to hash: texts as they are, complex values as text, one zero for floating numbers."""
    if is_string(f.dataType) or is_complex(f.dataType):
        return as_text(f.name, f.dataType)
    return qc(f.name) + 0.0 if f.dataType.typeName() in ("double", "float") else qc(f.name)


def _one_pass(df: DataFrame, columns: Sequence[str] | None) -> DataFrame | None:
    """(ordinal, cnt) per distinct non-null value of all columns in one scan, by column and 128-bit digest. A task drops its
    own repetitions before the shuffle."""
    keys = [(i, f) for i, f in enumerate(df.schema.fields) if columns is None or f.name in columns]
    if not keys:
        return None
    cells = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.when(qc(f.name).isNotNull(), F.xxhash64(_typed_key(f))).alias("a"),
                               F.xxhash64(F.lit(20_111_213), _typed_key(f)).alias("b")) for i, f in keys])
    rows = df.select(F.explode(cells).alias("v")).select("v.*").where(F.col("a").isNotNull())
    return rows.groupBy("ordinal", "a", "b").agg(F.count(F.lit(1)).alias("cnt"))


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """(ordinal, distinct): distinct non-null values of each column. A columnar table is read column by column, texts are
    shuffled as digests; any other input is read once, with one keyed pass for all columns. With ``approximate`` the counts
    are estimates of sketches (see ``distinct_sketches``), with no shuffle of values at all."""
    if approximate:
        return sketch_estimates(distinct_sketches(df, columns))
    out = _per_column(df, columns, digests=True) if _reads_columns(df) else _one_pass(df, columns)
    if out is None:
        return df.sparkSession.createDataFrame([], "ordinal int, distinct long")
    return out.groupBy("ordinal").agg(F.count(F.lit(1)).alias("distinct"))


#: Size of a sketch: 2^14 registers, a standard error below 0.8 %.
SKETCH_BITS = 14


def distinct_sketches(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(ordinal, sketch): a HyperLogLog sketch of the distinct non-null values of each column, in one scan. Sketches of the
    same columns of several tables can be united: ``sketch_estimates`` takes the union of all rows of an ordinal."""
    keys = [(i, f) for i, f in enumerate(df.schema.fields) if columns is None or f.name in columns]
    if not keys:
        return df.sparkSession.createDataFrame([], "ordinal int, sketch binary")
    sketches = [F.hll_sketch_agg(F.when(qc(f.name).isNotNull(), F.xxhash64(_typed_key(f))), F.lit(SKETCH_BITS)).alias(f"s{i}")
                for i, f in keys]
    cells = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.col(f"s{i}").alias("sketch")) for i, _ in keys])
    return df.agg(*sketches).select(F.explode(cells).alias("v")).select("v.*")


def sketch_estimates(sketches: DataFrame) -> DataFrame:
    """(ordinal, distinct): estimates of the united sketches; ordinals without a value have no row, as exact counts."""
    united = sketches.groupBy("ordinal").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
    return united.where(F.col("distinct") > 0)


def dense_index(df: DataFrame, col: str) -> DataFrame:
    """Adds ``place``: 0, 1, ... in the order of the distinct values ``col``. Rows are sorted by range, counted by
    partition, and numbered within each, so no task sees all of them."""
    ensure_checkpoint_dir(df.sparkSession)
    parts = df.repartitionByRange(qc(col)).sortWithinPartitions(qc(col)).withColumn("_p", F.spark_partition_id()).checkpoint()
    counts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(qc(col))) - 1
    return parts.withColumn("_place", place).join(before, "_p").select(
        *[qc(c) for c in df.columns], (F.col("_before") + F.col("_place")).alias("place"))


def top_k_per_key(df: DataFrame, key: str, order: list[Column], k: int, salt_col: str, salts: int = 64) -> DataFrame:
    """Top-k rows per ``key`` in two levels (per key+salt, then per key), so a key with millions of
    distinct values never sorts in one task. Adds ``rank`` (1-based)."""
    w1 = Window.partitionBy(key, "_salt").orderBy(*order)
    w2 = Window.partitionBy(key).orderBy(*order)
    return (
        df.withColumn("_salt", F.pmod(F.xxhash64(F.col(salt_col)), F.lit(salts)))
        .withColumn("_r1", F.row_number().over(w1))
        .where(F.col("_r1") <= k)
        .withColumn("rank", F.row_number().over(w2))
        .where(F.col("rank") <= k)
        .drop("_salt", "_r1")
    )


# --------------------------------------------------------------------------------------------
# exact percentiles (linear interpolation, the pandas/numpy default)
# --------------------------------------------------------------------------------------------

def _long_numeric(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(i).alias("ordinal"), qc(c).cast("double").alias("x")) for i, c in enumerate(cols)])
    x = F.col("x")
    return (
        df.select(*[qc(b).alias(b) for b in by], F.explode(arr).alias("kv"))
        .select(*by, "kv.ordinal", "kv.x")
        .where(x.isNotNull() & ~F.isnan(x))
    )


#: First pass: buckets of an octave of absolute values. Later passes: buckets of a range.
OCTAVE_BUCKETS, RANGE_BUCKETS = 512, 1 << 14


def _magnitude_bucket(x: Column) -> Column:
    """A whole number that never falls as ``x`` grows: sign, power of two and 512th of it (infinities beyond all)."""
    power = F.greatest(F.lit(-1100.0), F.least(F.lit(1100.0), F.log2(F.abs(x)))) + 1101.0
    step = F.floor(power * OCTAVE_BUCKETS).cast("long")
    return F.when(x > 0, step).when(x < 0, -step).otherwise(F.lit(0).cast("long"))


def _holders(counts: DataFrame, keys: Sequence[str], ranks: Column, before: Column, n: Column) -> DataFrame:
    """(*keys, n, rank, below, lo, hi): the bucket that holds each rank, with the number of smaller values. ``counts`` has
    c, lo and hi of each bucket; the window orders buckets, whose number does not grow with the rows."""
    by_key = Window.partitionBy(*keys)
    below = before + F.sum("c").over(by_key.orderBy("lo")) - F.col("c")
    found = counts.select(*keys, "c", "lo", "hi", n.alias("n"), below.alias("below"), ranks.alias("ranks"))
    mine = F.filter("ranks", lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("c")))
    return found.select(*keys, "n", F.explode(mine).alias("rank"), "below", "lo", "hi")


def exact_percentiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolated percentiles of ``cols`` (optionally per group ``by``), by rank narrowing.

    The first pass counts the values of every column by 512ths of an octave; the bucket that holds a wanted rank is kept with
    its least and greatest value. Each later pass cuts the kept ranges into 2^14 equal buckets, until a bucket holds one
    distinct value: 9 + 14 + 14 + 14 bits of the mantissa at most, so five passes for any data and two or three as a rule.
    All columns, probabilities and groups narrow together; a value of any frequency is one count a task, and what is
    ordered are buckets, never values.

    Returns (*by, column_name, prob, n, value); keys without data have no row.
    """
    by, cols = list(by), list(cols)
    if not cols:
        raise ValueError("exact_percentiles needs at least one column")
    long = _long_numeric(df, cols, by).withColumn("x", F.col("x") + 0.0)      # one zero
    keys = by + ["ordinal"]
    sums = [F.count(F.lit(1)).alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi")]
    first = long.groupBy(*keys, _magnitude_bucket(F.col("x")).alias("b")).agg(*sums)
    n = F.sum("c").over(Window.partitionBy(*keys))
    at = [F.floor(F.lit(float(p)) * (n - 1)) for p in probs]
    ranks = F.array_distinct(F.array(*[k for a in at for k in (a, F.least(a + 1, n - 1))]))
    places = materialize_small(_holders(first, keys, ranks, F.lit(0), n))
    done = places.where("lo = hi")
    while True:
        wide = places.where("lo < hi")
        ranges = materialize_small(wide.groupBy(*keys, "lo", "hi").agg(
            F.first("n").alias("n"), F.first("below").alias("below"), F.collect_list("rank").alias("ranks")))
        n_ranges = ranges.count()
        if not n_ranges:
            break
        side = ranges.select(*keys, F.col("lo").alias("from"), F.col("hi").alias("to"))
        x, low, span = F.col("x"), F.col("from"), F.col("to") - F.col("from")
        bucket = F.least(F.floor((x - low) / span * RANGE_BUCKETS), F.lit(RANGE_BUCKETS - 1))
        inside = long.join(F.broadcast(side) if n_ranges <= BROADCAST_ROWS else side, keys).where((x >= low) & (x <= F.col("to")))
        counts = inside.groupBy(*keys, "from", bucket.alias("b")).agg(*sums)
        known = ranges.select(*keys, F.col("lo").alias("from"), "n", "below", "ranks")
        counts = counts.join(F.broadcast(known) if n_ranges <= BROADCAST_ROWS else known, [*keys, "from"])
        places = materialize_small(_holders(counts, [*keys, "from"], F.col("ranks"), F.col("below"), F.col("n")).drop("from"))
        done = done.unionByName(places.where("lo = hi"))
    values = done.groupBy(*keys).agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("at"))
    wanted = F.array(*[F.struct(F.lit(float(p)).alias("prob"), (F.lit(float(p)) * (F.col("n") - 1)).alias("h")) for p in probs])
    values = values.select("*", F.explode(wanted).alias("w"))
    k = F.floor("w.h")
    a, b = F.element_at("at", k), F.element_at("at", F.least(k + 1, F.col("n") - 1))
    value = F.when(a == b, a).otherwise(a + (b - a) * (F.col("w.h") - k))
    names = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("ordinal") + 1)
    return values.select(*by, names.alias("column_name"), F.col("w.prob").alias("prob"), "n", value.alias("value"))


# --------------------------------------------------------------------------------------------
# running totals over a global order
# --------------------------------------------------------------------------------------------

#: Rows of a range of running totals: what one window sorts.
RANGE_ROWS = 1_000_000


def running_totals(df: DataFrame, order_col: str, value_cols: Sequence[str], descending: bool = False,
                   partition_by: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """Cumulative sums of ``value_cols`` in the order of ``order_col`` (within ``partition_by`` groups). Pre-aggregate first
    so there is one row per distinct order value.

    The rows are counted and dealt by range into partitions of about ``range_rows`` each, whose number grows with the rows;
    a partition's totals (one row each) give the offset of the next ones, and a window within each adds the rest. Rows that
    fit one range need neither. Adds ``cum_<col>`` columns."""
    part = list(partition_by)
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.checkpoint()
    ranges = -(-rows.count() // range_rows)
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    if ranges <= 1:
        w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({"cum_" + c: F.sum(c).over(w) for c in value_cols})
    dealt = rows.repartitionByRange(ranges, *part, order).withColumn("_p", F.spark_partition_id()).checkpoint()
    totals = dealt.groupBy(*part, "_p").agg(*[F.sum(c).alias(c) for c in value_cols])
    earlier = Window.partitionBy(*part).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize_small(totals.select(*part, "_p", *[
        F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias("_off_" + c) for c in value_cols]))
    keys = [F.col("a." + c).eqNullSafe(F.col("b." + c)) for c in [*part, "_p"]]
    within = Window.partitionBy(*part, "_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.alias("a").join(maybe_broadcast(offsets).alias("b"), keys).select("a.*", *["_off_" + c for c in value_cols])
    for c in value_cols:
        joined = joined.withColumn("cum_" + c, F.col("_off_" + c) + F.sum(c).over(within))
    return joined.drop("_p", *["_off_" + c for c in value_cols])
