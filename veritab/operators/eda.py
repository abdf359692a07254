"""Exploratory aggregates: the data behind each chart, computed as Spark aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.blocks import correlations, pair_statistics
from ..functions.stats import exact_percentiles, guarded_corr, maybe_broadcast
from ..functions.types import dtypes, is_floating, present, qc

PAIR_CHUNK = 60     # correlation pairs per aggregate (keeps generated code under the JVM method limit)


# --------------------------------------------------------------------------------------------
# histograms
# --------------------------------------------------------------------------------------------

def _range(df: DataFrame, col: str) -> tuple[float | None, float | None]:
    row = df.agg(F.min(present(col)).alias("lo"), F.max(present(col)).alias("hi")).first()
    lo, hi = row["lo"], row["hi"]
    if lo is not None and lo == hi:          # a constant column gets the unit range around it
        lo, hi = lo - 0.5, hi + 0.5
    return lo, hi


def bin_index(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin of x over [lo, hi]: last bin closed, and the two edge corrections that make a
    value exactly on an edge land in the bin the edge opens."""
    step = (hi - lo) / bins
    norm = bins / (hi - lo)

    def edge(k: Column) -> Column:
        return F.when(k == bins, F.lit(hi)).otherwise(F.lit(lo) + k * F.lit(step))

    k0 = F.least(F.floor((x - F.lit(lo)) * F.lit(norm)), F.lit(bins - 1))
    k1 = F.when(x < edge(k0), k0 - 1).otherwise(k0)
    return F.when((x >= edge(k1 + 1)) & (k1 != bins - 1), k1 + 1).otherwise(k1).cast("int")


def _centres(spark, lo: float, hi: float, bins: int) -> DataFrame:
    step = (hi - lo) / bins
    k = F.col("id").cast("int")
    left = F.lit(lo) + k * F.lit(step)
    right = F.when(k + 1 == bins, F.lit(hi)).otherwise(F.lit(lo) + (k + 1) * F.lit(step))
    return spark.range(bins).select(k.alias("bin"), (F.lit(0.5) * (left + right)).alias("bin_center"))


def histogram(df: DataFrame, col: str, bins: int = R.HIST_BINS) -> DataFrame:
    """(bin, bin_center, count) for all bins, empty ones included."""
    spark = df.sparkSession
    lo, hi = _range(df, col)
    if lo is None:
        return spark.createDataFrame([], "bin int, bin_center double, count long")
    x = present(col)
    counts = df.where(x.isNotNull()).groupBy(bin_index(x, lo, hi, bins).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return (_centres(spark, lo, hi, bins).join(F.broadcast(counts), "bin", "left")
            .select("bin", "bin_center", F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def histogram_by_group(df: DataFrame, col: str, group: str | Column, bins: int = R.HIST_BINS) -> DataFrame:
    """(group, bin, bin_center, count) with bin edges shared by all groups, zero-filled per group."""
    spark = df.sparkSession
    g = group if isinstance(group, Column) else qc(group)
    lo, hi = _range(df, col)
    if lo is None:
        return spark.createDataFrame([], "grp string, bin int, bin_center double, count long")
    x = present(col)
    base = df.select(g.cast("string").alias("grp"), x.alias("x"))
    counts = (base.where(F.col("x").isNotNull())
              .groupBy("grp", bin_index(F.col("x"), lo, hi, bins).alias("bin")).agg(F.count(F.lit(1)).alias("count")))
    grid = (base.select("grp").distinct()
            .select("grp", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
            .join(F.broadcast(_centres(spark, lo, hi, bins)), "bin"))
    return (grid.join(counts, ["grp", "bin"], "left")
            .select("grp", "bin", "bin_center", F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def class_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, count) per class, missing values (NULL, NaN) excluded."""
    there = qc(col).isNotNull()
    if is_floating(dtypes(df)[col]):
        there = there & ~F.isnan(qc(col))
    return df.where(there).groupBy(qc(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def target_distribution(df: DataFrame, target: str, task: str) -> DataFrame:
    """Class counts for Classification or a target with <= 10 distinct values; else a 40-bin histogram.
    Returns (label, bin_center, count): label set for class counts, bin_center for the histogram."""
    few = task == "Classification" or len(class_counts(df, target).limit(11).collect()) <= 10
    if few:
        return class_counts(df, target).select(F.col("value").cast("string").alias("label"),
                                               F.lit(None).cast("double").alias("bin_center"), "count")
    h = histogram(df, target)
    return h.select(F.lit(None).cast("string").alias("label"), "bin_center", "count")


def cluster_sizes(pred: DataFrame, cluster_col: str = "prediction") -> DataFrame:
    return pred.groupBy(qc(cluster_col).alias("cluster")).agg(F.count(F.lit(1)).alias("count")).orderBy("cluster")


# --------------------------------------------------------------------------------------------
# correlation
# --------------------------------------------------------------------------------------------

def _block_pairs(df: DataFrame, cols: list[str], pairs: list[tuple[int, int]], include_diagonal: bool) -> DataFrame:
    stats = pair_statistics(df, cols)
    r = correlations(stats)
    rows = [(i, j, None if np.isnan(r[i, j]) else float(r[i, j])) for i, j in pairs]
    if include_diagonal:
        rows += [(i, i, 1.0 if stats["dev"][i, i] > 0 else None) for i in range(len(cols))]
    return df.sparkSession.createDataFrame(rows, "i int, j int, r double")


def correlation_pairs(df: DataFrame, cols: Sequence[str], include_diagonal: bool = False) -> DataFrame:
    """(i, j, col_i, col_j, r) for i < j: pairwise-complete Pearson r, NULL where undefined. One scan: the pairs of few columns
    are aggregates of one generated program, those of many columns come from matrix products over blocks of rows."""
    cols = list(cols)
    spark = df.sparkSession
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    schema = "i int, j int, r double"
    if len(pairs) > PAIR_CHUNK:
        out = _block_pairs(df, cols, pairs, include_diagonal)
    else:
        found = [(i, j, guarded_corr(qc(cols[i]).cast("double"), qc(cols[j]).cast("double"))) for i, j in pairs]
        if include_diagonal:
            found += [(i, i, F.when(F.stddev_pop(qc(c).cast("double")) > 0, F.lit(1.0))) for i, c in enumerate(cols)]
        structs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), r.alias("r")) for i, j, r in found]
        out = spark.createDataFrame([], schema)
        if structs:
            out = df.agg(F.array(*structs).alias("a")).select(F.explode("a").alias("p")).select("p.i", "p.j", "p.r")
    names = F.array(*[F.lit(c) for c in cols]) if cols else F.array()
    return out.select("i", "j", F.element_at(names, F.col("i") + 1).alias("col_i"),
                      F.element_at(names, F.col("j") + 1).alias("col_j"), "r")


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Full symmetric matrix in long form (col_i, col_j, r), diagonal included."""
    p = correlation_pairs(df, cols, include_diagonal=True)
    mirrored = p.where(F.col("i") != F.col("j")).select(
        F.col("j").alias("i"), F.col("i").alias("j"), F.col("col_j").alias("col_i"), F.col("col_i").alias("col_j"), "r")
    return p.unionByName(mirrored)


# --------------------------------------------------------------------------------------------
# box statistics and the feature/target relation
# --------------------------------------------------------------------------------------------

def box_stats(df: DataFrame, value: str, group: str) -> DataFrame:
    """Per group: exact quartiles (linear interpolation), min, max, whiskers at 1.5 IQR, outliers."""
    base = df.select(qc(group).alias("grp"), present(value).alias("x")).where(
        F.col("grp").isNotNull() & F.col("x").isNotNull())
    q = exact_percentiles(base, ["x"], [0.25, 0.5, 0.75], by=["grp"])
    quart = (q.groupBy("grp").pivot("prob", [0.25, 0.5, 0.75]).agg(F.first("value"))
             .toDF("grp", "q1", "median", "q3"))
    quart = quart.withColumn("lo_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
                 .withColumn("hi_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    j = base.join(maybe_broadcast(quart), "grp")
    x = F.col("x")
    inside = (x >= F.col("lo_fence")) & (x <= F.col("hi_fence"))
    return j.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(x).alias("min"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"), F.max(x).alias("max"),
        F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("long").alias("n_outliers"),
    )


def feature_target_points(df: DataFrame, feature: str, target: str) -> DataFrame:
    """All complete (x, y) pairs for a scatter chart."""
    return df.select(present(feature).alias("x"), present(target).alias("y")).where(
        F.col("x").isNotNull() & F.col("y").isNotNull())


def feature_target_bins(df: DataFrame, feature: str, target: str, bins: int = R.HIST_BINS) -> DataFrame:
    """(x_bin, y_bin, count): the scatter chart of any number of rows as a 2-D binned count, empty cells left out."""
    pts = feature_target_points(df, feature, target)
    (xlo, xhi), (ylo, yhi) = _range(pts, "x"), _range(pts, "y")
    if xlo is None:
        return df.sparkSession.createDataFrame([], "x_bin int, y_bin int, count long")
    return pts.groupBy(bin_index(F.col("x"), xlo, xhi, bins).alias("x_bin"),
                       bin_index(F.col("y"), ylo, yhi, bins).alias("y_bin")).agg(F.count(F.lit(1)).alias("count"))


def ols_trendline(df: DataFrame, feature: str, target: str) -> DataFrame:
    """Least-squares y ~ x over complete pairs; NULL slope when x is constant. No row cap."""
    x, y = present(feature), present(target)
    return df.agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )
