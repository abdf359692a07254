"""Registered queries: column and table profiling, recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import profile as P
from ..operators import recommend as REC
from . import oracle_sql as O
from .registry import register, rounded
from .tables import labeled_documents, table

PROFILE_TABLES = ["lineitem", "orders", "customer", "part", "supplier", "events", "documents", "labels",
                  "conversations", "benchmark", "pages", "nation"]


def _profile(spark, sf, name):
    return P.profile_table(table(spark, sf, name))


def _union_sql(parts):
    return " UNION ALL ".join(f"({p})" for p in parts)


# ---------------------------------------------------------------- semantic types, many tables
def _semantic_sql():
    parts = []
    for t in PROFILE_TABLES:
        parts.append(f"SELECT '{t}' AS table_name, ordinal, column_name, data_type, semantic_type "
                     f"FROM {O.typed_stats(t, O.SCHEMAS[t])}")
    return _union_sql(parts)


def _profiles(spark, sf, names):
    return P.profile_tables({t: table(spark, sf, t) for t in names})


@register("semantic_types", _semantic_sql())
def q_semantic_types(spark, sf):
    profs = _profiles(spark, sf, PROFILE_TABLES)
    out = None
    for t in PROFILE_TABLES:
        df = P.semantic_types(profs[t]).select(F.lit(t).alias("table_name"), "*")
        out = df if out is None else out.unionByName(df)
    return out


@register("id_rule", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, ordinal, column_name, semantic_type = 'ID' AS is_id "
    f"FROM {O.typed_stats(t, O.SCHEMAS[t])}" for t in ["customer", "orders", "part", "supplier", "nation"]))
def q_id_rule(spark, sf):
    out = None
    names = ["customer", "orders", "part", "supplier", "nation"]
    profs = _profiles(spark, sf, names)
    for t in names:
        df = P.id_rule(profs[t]).select(F.lit(t).alias("table_name"), "*")
        out = df if out is None else out.unionByName(df)
    return out


# ---------------------------------------------------------------- date-name rule on text dates
def text_dates(spark, sf):
    """Text date columns derived from orders (the driver tables store dates as timestamps)."""
    o = table(spark, sf, "orders")
    return o.select("o_orderkey",
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date_text"),
                    F.date_format("o_orderdate", "MM/dd/yyyy").alias("ship_month_text"),
                    F.col("o_orderpriority").alias("update_note"))


@register("date_parse_rule",
          "SELECT ordinal, column_name, semantic_type FROM "
          + O.typed_stats(O.TEXT_DATES, O.TEXT_DATES_SCHEMA,
                          {"order_date_text": "TRUE", "ship_month_text": "TRUE", "update_note": "FALSE"})
          + " WHERE kind = 'string'")
def q_date_parse_rule(spark, sf):
    p = P.profile_table(text_dates(spark, sf))
    return p.stats.where(F.col("kind") == "string").select("ordinal", "column_name", "semantic_type")


@register("datetime_stats", _union_sql([
    f"SELECT '{t}' AS table_name, ordinal, column_name, dt_min AS min, dt_max AS max, "
    f"CAST(FLOOR(date_diff('microsecond', dt_min, dt_max) / 86400000000.0) AS BIGINT) AS range_days "
    f"FROM {O.typed_stats(src, sch, ok)} WHERE semantic_type = 'Datetime'"
    for t, src, sch, ok in [
        ("lineitem", "lineitem", O.SCHEMAS["lineitem"], None),
        ("orders", "orders", O.SCHEMAS["orders"], None),
        ("events", "events", O.SCHEMAS["events"], None),
    ]
] + [
    "SELECT 'text_dates' AS table_name, 1 AS ordinal, 'order_date_text' AS column_name, "
    "MIN(strptime(order_date_text, '%Y-%m-%d')) AS min, MAX(strptime(order_date_text, '%Y-%m-%d')) AS max, "
    "CAST(FLOOR(date_diff('microsecond', MIN(strptime(order_date_text, '%Y-%m-%d')), MAX(strptime(order_date_text, '%Y-%m-%d')))"
    " / 86400000000.0) AS BIGINT) AS range_days FROM " + O.TEXT_DATES + " t",
    "SELECT 'text_dates' AS table_name, 2 AS ordinal, 'ship_month_text' AS column_name, "
    "MIN(strptime(ship_month_text, '%m/%d/%Y')) AS min, MAX(strptime(ship_month_text, '%m/%d/%Y')) AS max, "
    "CAST(FLOOR(date_diff('microsecond', MIN(strptime(ship_month_text, '%m/%d/%Y')), MAX(strptime(ship_month_text, '%m/%d/%Y')))"
    " / 86400000000.0) AS BIGINT) AS range_days FROM " + O.TEXT_DATES + " t",
]))
def q_datetime_stats(spark, sf):
    names = ["lineitem", "orders", "events"]
    tables = {t: table(spark, sf, t) for t in names}
    tables["text_dates"] = text_dates(spark, sf)
    profs = P.profile_tables(tables)
    out = None
    for t in names + ["text_dates"]:
        df = P.datetime_stats(profs[t]).select(F.lit(t).alias("table_name"), "*")
        out = df if out is None else out.unionByName(df)
    return out


# ---------------------------------------------------------------- per-column stats on lineitem / documents
LI = O.SCHEMAS["lineitem"]


@register("numeric_stats",
          "SELECT ordinal, column_name, ROUND(num_min, 6) AS min, ROUND(num_max, 6) AS max, ROUND(mean, 6) AS mean, "
          "ROUND(median, 6) AS median, ROUND(CASE WHEN non_null > 1 THEN std ELSE 0.0 END, 6) AS std "
          f"FROM {O.typed_stats('lineitem', LI)} WHERE semantic_type = 'Numeric' AND non_null > 0")
def q_numeric_stats(spark, sf):
    return rounded(P.numeric_stats(_profile(spark, sf, "lineitem")))


@register("categorical_top_values", O.top_values("lineitem", LI))
def q_top_values(spark, sf):
    return _profile(spark, sf, "lineitem").top_values()


@register("missing_profile",
          "SELECT ordinal, column_name, missing_count, missing_percentage, missing_count > 0 AS is_nullable "
          f"FROM {O.typed_stats(O.LABELED_DOCS, O.LABELED_DOCS_SCHEMA)}")
def q_missing_profile(spark, sf):
    return P.missing_profile(P.profile_table(labeled_documents(spark, sf)))


@register("unique_count",
          f"SELECT ordinal, column_name, unique_count FROM {O.typed_stats('lineitem', LI)}")
def q_unique_count(spark, sf):
    return P.unique_profile(_profile(spark, sf, "lineitem")).select("ordinal", "column_name", "unique_count")


@register("unique_ratio",
          f"SELECT ordinal, column_name, ROUND(unique_ratio, 6) AS unique_ratio FROM {O.typed_stats('orders', O.SCHEMAS['orders'])}")
def q_unique_ratio(spark, sf):
    return rounded(P.unique_profile(_profile(spark, sf, "orders")).select("ordinal", "column_name", "unique_ratio"))


@register("avg_string_length",
          f"SELECT ordinal, column_name, ROUND(avg_len, 6) AS avg_len FROM {O.typed_stats('documents', O.SCHEMAS['documents'])} "
          "WHERE kind = 'string'")
def q_avg_string_length(spark, sf):
    return rounded(P.avg_string_length(_profile(spark, sf, "documents")))


def _column_profile_sql(t):
    ts = O.typed_stats(t, O.SCHEMAS[t])
    top = O.top_values(t, O.SCHEMAS[t])
    return (
        "SELECT s.ordinal, s.column_name, s.data_type, s.semantic_type, s.missing_count, s.missing_percentage, "
        "s.unique_count, s.missing_count > 0 AS is_nullable, "
        "ROUND(CASE WHEN s.semantic_type = 'Numeric' THEN s.num_min END, 6) AS min, "
        "ROUND(CASE WHEN s.semantic_type = 'Numeric' THEN s.num_max END, 6) AS max, "
        "ROUND(CASE WHEN s.semantic_type = 'Numeric' THEN s.mean END, 6) AS mean, "
        "ROUND(CASE WHEN s.semantic_type = 'Numeric' THEN s.median END, 6) AS median, "
        "ROUND(CASE WHEN s.semantic_type = 'Numeric' THEN (CASE WHEN s.non_null > 1 THEN s.std ELSE 0.0 END) END, 6) AS std, "
        "t.value AS top_value, t.count AS top_count, t.percentage AS top_percentage, "
        "CASE WHEN s.semantic_type = 'Datetime' THEN s.dt_min END AS dt_min, "
        "CASE WHEN s.semantic_type = 'Datetime' THEN s.dt_max END AS dt_max, "
        "CASE WHEN s.semantic_type = 'Datetime' THEN CAST(FLOOR(date_diff('microsecond', s.dt_min, s.dt_max) / 86400000000.0) AS BIGINT) END AS range_days "
        f"FROM {ts} s LEFT JOIN ({top}) t ON s.ordinal = t.ordinal AND t.rank = 1"
    )


def flat_column_profile(p):
    cp = P.column_profile(p)
    tv0 = F.col("top_values")[0]
    return rounded(cp.select(
        "ordinal", "column_name", "data_type", "semantic_type", "missing_count", "missing_percentage",
        "unique_count", "is_nullable", "min", "max", "mean", "median", "std",
        tv0["value"].alias("top_value"), tv0["count"].alias("top_count"), tv0["percentage"].alias("top_percentage"),
        "dt_min", "dt_max", "range_days"))


@register("column_profile", _column_profile_sql("lineitem"))
def q_column_profile(spark, sf):
    return flat_column_profile(_profile(spark, sf, "lineitem"))


@register("column_profile_orders", _column_profile_sql("orders"))
def q_column_profile_orders(spark, sf):
    return flat_column_profile(_profile(spark, sf, "orders"))


@register("stats_summary",
          "SELECT s.ordinal, s.column_name, s.semantic_type, CASE "
          "WHEN s.semantic_type = 'Numeric' AND s.mean IS NOT NULL THEN printf('Mean:%.2f | [%.2f,%.2f]', s.mean, s.num_min, s.num_max) "
          "WHEN s.semantic_type = 'Categorical' AND t.value IS NOT NULL THEN printf('Top:''%s'' (%d rows)', t.value, t.count) "
          "WHEN s.semantic_type = 'Datetime' AND s.dt_min IS NOT NULL THEN 'Range:' || CAST(s.dt_min AS VARCHAR) || ' → ' || CAST(s.dt_max AS VARCHAR) "
          "ELSE '' END AS summary "
          f"FROM {O.typed_stats('lineitem', LI)} s LEFT JOIN ({O.top_values('lineitem', LI)}) t ON s.ordinal = t.ordinal AND t.rank = 1")
def q_stats_summary(spark, sf):
    return P.stats_summary(_profile(spark, sf, "lineitem")).select("ordinal", "column_name", "semantic_type", "summary")


# ---------------------------------------------------------------- table level
DUP_TABLES = ["lineitem", "orders", "customer", "documents", "events", "conversations"]


@register("table_profile", _union_sql([
    f"SELECT '{t}' AS table_name, (SELECT COUNT(*) FROM {t}) AS n_rows, {len(O.SCHEMAS[t])} AS n_cols, "
    f"CAST((SELECT COUNT(*) FROM {t}) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {t})) AS BIGINT) AS n_duplicates"
    for t in DUP_TABLES]))
def q_table_profile(spark, sf):
    """Rows, columns and duplicate rows of several tables; each table is one count and one grouping,
    submitted concurrently."""
    from concurrent.futures import ThreadPoolExecutor

    def one(t):
        df = table(spark, sf, t)
        return t, df.count(), len(df.columns), P.duplicate_rows(df)

    with ThreadPoolExecutor(max_workers=4) as pool:
        rows = list(pool.map(one, DUP_TABLES))
    return spark.createDataFrame(rows, "table_name string, n_rows long, n_cols int, n_duplicates long")


@register("duplicate_rows",
          "SELECT CAST(COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem)) AS BIGINT) AS n_duplicates FROM lineitem")
def q_duplicate_rows(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    return P.duplicate_rows_frame(li)


@register("completeness",
          "SELECT CAST(SUM(n_rows) AS BIGINT) AS cells, CAST(SUM(missing_count) AS BIGINT) AS null_cells, "
          "ROUND(CASE WHEN SUM(n_rows) = 0 THEN 0.0 ELSE (SUM(n_rows) - SUM(missing_count)) * 100.0 / SUM(n_rows) END, 6) AS completeness "
          f"FROM {O.typed_stats(O.LABELED_DOCS, O.LABELED_DOCS_SCHEMA)}")
def q_completeness(spark, sf):
    return rounded(P.completeness(P.profile_table(labeled_documents(spark, sf))))


@register("type_counts", _union_sql([
    f"SELECT '{t}' AS table_name, CAST(SUM(CASE WHEN semantic_type = 'Numeric' THEN 1 ELSE 0 END) AS BIGINT) AS n_numeric, "
    f"CAST(SUM(CASE WHEN semantic_type = 'Categorical' THEN 1 ELSE 0 END) AS BIGINT) AS n_categorical, "
    f"ROUND(COALESCE(100 - AVG(missing_percentage), 100.0), 6) AS fill_rate FROM {O.typed_stats(src, sch)}"
    for t, src, sch in [("lineitem", "lineitem", LI), ("labeled_documents", O.LABELED_DOCS, O.LABELED_DOCS_SCHEMA)]]))
def q_type_counts(spark, sf):
    a = P.type_counts(_profile(spark, sf, "lineitem")).select(F.lit("lineitem").alias("table_name"), "*")
    b = P.type_counts(P.profile_table(labeled_documents(spark, sf))).select(F.lit("labeled_documents").alias("table_name"), "*")
    return rounded(a.unionByName(b))


# ---------------------------------------------------------------- recommendations
def _scored_sql(source, schema):
    ts = O.typed_stats(source, schema)
    tk = "|".join(R.TARGET_KEYWORDS)
    kk = "|".join(R.KPI_KEYWORDS)
    return (
        "(SELECT ordinal, column_name, semantic_type, missing_percentage, "
        "CASE WHEN semantic_type IN ('ID', 'Text') OR unique_count <= 1 THEN 0 ELSE "
        f"(CASE WHEN regexp_matches(lower(column_name), '{tk}') THEN 3 ELSE 0 END) + "
        "(CASE WHEN semantic_type = 'Categorical' THEN (CASE WHEN unique_count = 2 THEN 3 "
        "WHEN unique_count > 2 AND unique_count <= 10 THEN 2 ELSE 0 END) "
        "WHEN semantic_type = 'Numeric' THEN 1 ELSE 0 END) END AS target_score, "
        "CASE WHEN semantic_type IN ('ID', 'Text') OR unique_count <= 1 THEN 0 ELSE "
        f"(CASE WHEN regexp_matches(lower(column_name), '{kk}') THEN 3 ELSE 0 END) + "
        "(CASE WHEN semantic_type = 'Categorical' THEN 1 WHEN semantic_type = 'Numeric' THEN 2 ELSE 0 END) END AS kpi_score "
        f"FROM {ts} WHERE missing_percentage <= 50)"
    )


def _targets_sql(source, schema):
    return (
        "SELECT ordinal, column_name AS \"column\", semantic_type AS type, "
        "CASE WHEN semantic_type = 'Categorical' THEN 'Classification' ELSE 'Regression' END AS task_suggestion, "
        "target_score AS score, ROW_NUMBER() OVER (ORDER BY target_score DESC, ordinal ASC) AS rank "
        f"FROM {_scored_sql(source, schema)} WHERE target_score >= 2"
    )


def _kpis_sql(source, schema):
    return (
        "SELECT ordinal, column_name AS \"column\", semantic_type AS type, kpi_score AS score, "
        "ROW_NUMBER() OVER (ORDER BY kpi_score DESC, ordinal ASC) AS rank "
        f"FROM {_scored_sql(source, schema)} WHERE kpi_score >= 2"
    )


CAND_TABLES = ["lineitem", "orders", "customer", "part"]


@register("target_candidates", _union_sql([
    f"SELECT '{t}' AS table_name, * FROM ({_targets_sql(t, O.SCHEMAS[t])})" for t in CAND_TABLES]))
def q_target_candidates(spark, sf):
    out = None
    profs = _profiles(spark, sf, CAND_TABLES)
    for t in CAND_TABLES:
        df = REC.target_candidates(profs[t]).select(F.lit(t).alias("table_name"), "*")
        out = df if out is None else out.unionByName(df)
    return out


@register("kpi_candidates", _union_sql([
    f"SELECT '{t}' AS table_name, * FROM ({_kpis_sql(t, O.SCHEMAS[t])})" for t in CAND_TABLES]))
def q_kpi_candidates(spark, sf):
    out = None
    profs = _profiles(spark, sf, CAND_TABLES)
    for t in CAND_TABLES:
        df = REC.kpi_candidates(profs[t]).select(F.lit(t).alias("table_name"), "*")
        out = df if out is None else out.unionByName(df)
    return out


@register("candidate_confidence",
          f"SELECT \"column\", score, CASE WHEN score >= 5 THEN 'High' ELSE 'Medium' END AS confidence FROM ({_targets_sql('lineitem', LI)})")
def q_candidate_confidence(spark, sf):
    return REC.candidate_confidence(REC.target_candidates(_profile(spark, sf, "lineitem"))).select("column", "score", "confidence")


@register("default_target",
          f"SELECT \"column\", type, task_suggestion, score FROM ({_targets_sql('orders', O.SCHEMAS['orders'])}) WHERE rank = 1")
def q_default_target(spark, sf):
    return REC.default_target(_profile(spark, sf, "orders")).select("column", "type", "task_suggestion", "score")


@register("default_features",
          f"SELECT ordinal, column_name, semantic_type FROM {O.typed_stats('lineitem', LI)} "
          "WHERE semantic_type NOT IN ('ID', 'Text') AND non_null > 0 AND column_name <> 'l_returnflag'")
def q_default_features(spark, sf):
    return REC.default_features(_profile(spark, sf, "lineitem"), "l_returnflag")
