"""Registered queries: exploratory aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import eda as E
from ..operators import profile as P
from .registry import register, rounded
from .tables import table

BINS = R.HIST_BINS


def hist_sql(source: str, col: str, group: str | None = None) -> str:
    """Equal-width 40-bin histogram with edge corrections, zero-filled (per group when given)."""
    g_sel = f"CAST({group} AS VARCHAR) AS grp, " if group else ""
    g_key = "grp, " if group else ""
    grid_src = (f"(SELECT DISTINCT CAST({group} AS VARCHAR) AS grp FROM {source}) gg, range({BINS}) t(k)" if group
                else f"range({BINS}) t(k)")
    return f"""
WITH r0 AS (SELECT MIN({col})::DOUBLE AS lo0, MAX({col})::DOUBLE AS hi0 FROM {source}),
r AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
             CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM r0),
pts AS (SELECT {g_sel}{col}::DOUBLE AS x FROM {source} WHERE {col} IS NOT NULL),
b0 AS (SELECT {g_key}x, lo, hi, (hi - lo) / {BINS} AS step,
              LEAST(CAST(FLOOR((x - lo) * ({BINS} / (hi - lo))) AS BIGINT), {BINS - 1}) AS k0 FROM pts, r),
b1 AS (SELECT {g_key}x, lo, hi, step,
              CASE WHEN x < (CASE WHEN k0 = {BINS} THEN hi ELSE lo + k0 * step END) THEN k0 - 1 ELSE k0 END AS k1 FROM b0),
b2 AS (SELECT {g_key}CASE WHEN x >= (CASE WHEN k1 + 1 = {BINS} THEN hi ELSE lo + (k1 + 1) * step END) AND k1 <> {BINS - 1}
              THEN k1 + 1 ELSE k1 END AS bin FROM b1),
cnt AS (SELECT {g_key}bin, COUNT(*) AS c FROM b2 GROUP BY ALL),
grid AS (SELECT {g_key}CAST(k AS INTEGER) AS bin,
                ROUND(0.5 * ((lo + k * ((hi - lo) / {BINS})) +
                             (CASE WHEN k + 1 = {BINS} THEN hi ELSE lo + (k + 1) * ((hi - lo) / {BINS}) END)), 6) AS bin_center
         FROM {grid_src}, r)
SELECT {'grid.grp, ' if group else ''}grid.bin, grid.bin_center, CAST(COALESCE(cnt.c, 0) AS BIGINT) AS count
FROM grid LEFT JOIN cnt ON grid.bin = cnt.bin {'AND grid.grp = cnt.grp' if group else ''}"""


@register("histogram_40", hist_sql("lineitem", "l_extendedprice"))
def q_histogram(spark, sf):
    return rounded(E.histogram(table(spark, sf, "lineitem"), "l_extendedprice"))


@register("histogram_40_constant", hist_sql("(SELECT l_quantity * 0 + 7 AS c FROM lineitem)", "c"))
def q_histogram_constant(spark, sf):
    df = table(spark, sf, "lineitem").select((F.col("l_quantity") * 0 + 7).alias("c"))
    return rounded(E.histogram(df, "c"))


@register("histogram_by_group", hist_sql("lineitem", "l_extendedprice", "l_returnflag"))
def q_histogram_by_group(spark, sf):
    return rounded(E.histogram_by_group(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag"))


@register("target_distribution",
          "SELECT l_returnflag AS label, NULL::DOUBLE AS bin_center, COUNT(*) AS count FROM lineitem "
          "WHERE l_returnflag IS NOT NULL GROUP BY 1")
def q_target_distribution(spark, sf):
    return E.target_distribution(table(spark, sf, "lineitem"), "l_returnflag", "Classification")


@register("target_distribution_numeric",
          "SELECT NULL::VARCHAR AS label, bin_center, count FROM (" + hist_sql("orders", "o_totalprice") + ")")
def q_target_distribution_numeric(spark, sf):
    return rounded(E.target_distribution(table(spark, sf, "orders"), "o_totalprice", "Regression"))


@register("cluster_sizes", "SELECT label AS cluster, COUNT(*) AS count FROM embeddings GROUP BY 1")
def q_cluster_sizes(spark, sf):
    return E.cluster_sizes(table(spark, sf, "embeddings"), "label")


LI_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _corr_sql(source, cols):
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                parts.append(f"SELECT '{a}' AS col_i, '{a}' AS col_j, CASE WHEN STDDEV_POP({a}) > 0 THEN 1.0::DOUBLE END AS r FROM {source}")
                continue
            parts.append(
                f"SELECT '{a}' AS col_i, '{b}' AS col_j, ROUND(CASE WHEN sa * sb = 0 OR sa IS NULL OR sb IS NULL THEN NULL "
                f"ELSE GREATEST(-1.0::DOUBLE, LEAST(1.0::DOUBLE, cv / (sa * sb))) END, 6) AS r FROM (SELECT COVAR_POP({a}, {b}) AS cv, "
                f"STDDEV_POP(CASE WHEN {b} IS NOT NULL THEN {a} END) AS sa, "
                f"STDDEV_POP(CASE WHEN {a} IS NOT NULL THEN {b} END) AS sb FROM {source})")
    return " UNION ALL ".join(parts)


@register("correlation_matrix", _corr_sql("lineitem", LI_NUMERIC))
def q_correlation_matrix(spark, sf):
    p = P.profile_table(table(spark, sf, "lineitem"))
    num = p.columns_of(R.NUMERIC)
    return rounded(E.correlation_matrix(p.data, num).select("col_i", "col_j", "r"))


@register("correlation_constant_guard", _corr_sql("(SELECT l_quantity, l_tax * 0 AS zero_tax FROM lineitem)",
                                                  ["l_quantity", "zero_tax"]))
def q_correlation_constant(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", (F.col("l_tax") * 0).alias("zero_tax"))
    return rounded(E.correlation_matrix(df, ["l_quantity", "zero_tax"]).select("col_i", "col_j", "r"))


BOX_SQL = """
WITH q AS (SELECT l_returnflag AS grp, quantile_cont(l_extendedprice, 0.25) AS q1,
                  quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3
           FROM lineitem WHERE l_returnflag IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1)
SELECT q.grp, COUNT(*) AS n, ROUND(MIN(l.l_extendedprice), 6) AS min, ROUND(q.q1, 6) AS q1, ROUND(q.median, 6) AS median,
       ROUND(q.q3, 6) AS q3, ROUND(MAX(l.l_extendedprice), 6) AS max,
       ROUND(MIN(CASE WHEN l.l_extendedprice BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1) THEN l.l_extendedprice END), 6) AS whisker_low,
       ROUND(MAX(CASE WHEN l.l_extendedprice BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1) THEN l.l_extendedprice END), 6) AS whisker_high,
       CAST(SUM(CASE WHEN l.l_extendedprice BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1) THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
FROM lineitem l JOIN q ON l.l_returnflag = q.grp WHERE l.l_extendedprice IS NOT NULL
GROUP BY q.grp, q.q1, q.median, q.q3"""


@register("box_stats", BOX_SQL)
def q_box_stats(spark, sf):
    return rounded(E.box_stats(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag"))


@register("box_stats_events",
          BOX_SQL.replace("lineitem", "events").replace("l_returnflag", "event_type").replace("l_extendedprice", "value"))
def q_box_stats_events(spark, sf):
    return rounded(E.box_stats(table(spark, sf, "events"), "value", "event_type"))


@register("feature_target_points",
          "SELECT l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y FROM lineitem "
          "WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")
def q_feature_target_points(spark, sf):
    return E.feature_target_points(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@register("ols_trendline",
          "SELECT CAST(REGR_COUNT(l_extendedprice, l_quantity) AS BIGINT) AS n, "
          "ROUND(REGR_SLOPE(l_extendedprice, l_quantity), 6) AS slope, "
          "ROUND(REGR_INTERCEPT(l_extendedprice, l_quantity), 6) AS intercept, "
          "ROUND(REGR_R2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def q_ols(spark, sf):
    return rounded(E.ols_trendline(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))
