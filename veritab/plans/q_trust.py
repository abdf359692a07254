"""Registered queries: trust checks and the trust log, with SQL oracles built from the same
fixed message texts."""

from __future__ import annotations

import re

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions import messages as T
from ..operators import cluster as C
from ..operators import metrics as M
from ..operators import trust as TR
from . import oracle_sql as O
from .q_metrics import _rules_sql, _weighted_sql, rule_metrics, spark_sql
from .registry import register, rounded
from .tables import labeled_documents, priced_lineitem, table

COLS = ["check_order", "status", "check_name", "subject", "value", "message", "details"]


# --------------------------------------------------------------------------------------------
# SQL helpers
# --------------------------------------------------------------------------------------------

def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_fmt(template: str, fields: dict[str, str]) -> str:
    """Python format template -> DuckDB printf call over SQL expressions."""
    args = []

    def rep(m):
        name, spec = m.group(1), m.group(2)
        args.append(fields[name] if spec else f"CAST({fields[name]} AS VARCHAR)")
        return "%" + spec[1:] if spec else "%s"

    body = re.sub(r"\{(\w+)(:[^}]*)?\}", rep, template.replace("%", "%%"))
    if not args:
        return sql_str(template)
    return f"printf({sql_str(body)}, {', '.join(args)})"


def sql_row(order, status, spec, fields, subject="NULL", value="NULL", where="TRUE", src="") -> str:
    name, msg, det = spec
    return (f"SELECT {order} AS check_order, '{status}' AS status, {sql_str(name)} AS check_name, "
            f"CAST({subject} AS VARCHAR) AS subject, CAST({value} AS DOUBLE) AS value, "
            f"{sql_fmt(msg, fields)} AS message, {sql_fmt(det, fields)} AS details {src} WHERE {where}")


def sql_sample(source) -> str:
    src = f"FROM (SELECT COUNT(*) AS n FROM {source} t) s"
    return " UNION ALL ".join([
        sql_row(1, "WARNING", T.SMALL_SAMPLE, {"n": "n"}, value="n", where="n < 100", src=src),
        sql_row(1, "INFO", T.SAMPLE_OK, {"n": "n"}, value="n", where="n >= 100", src=src),
    ])


def sql_missing(source, features) -> str:
    pct = " UNION ALL ".join(
        f"SELECT {i} AS o, '{c}' AS c, (COUNT(*) - COUNT({c}))::DOUBLE / COUNT(*) * 100 AS p FROM {source} t"
        for i, c in enumerate(features))
    lst = "'[' || COALESCE(string_agg('''' || c || '''', ', ' ORDER BY o) FILTER (WHERE p > {t}), '') || ']'"
    src = (f"FROM (SELECT {lst.format(t=50)} AS crit, {lst.format(t=20)} AS high, "
           f"COUNT(*) FILTER (WHERE p > 50) AS nc, COUNT(*) FILTER (WHERE p > 20) AS nh FROM ({pct})) s")
    return " UNION ALL ".join([
        sql_row(2, "CRITICAL", T.EXTREME_MISSING, {"cols": "crit"}, value="nc", where="nc > 0", src=src),
        sql_row(2, "WARNING", T.HIGH_MISSING, {"cols": "high"}, value="nh", where="nc = 0 AND nh > 0", src=src),
        sql_row(2, "INFO", T.MISSING_OK, {}, value="0", where="nh = 0", src=src),
    ])


def sql_target_missing(source, target) -> str:
    src = f"FROM (SELECT COUNT(*) - COUNT({target}) AS k, COUNT(*) AS n FROM {source} t) s"
    return sql_row(3, "WARNING", T.TARGET_MISSING,
                   {"target": sql_str(target), "count": "k", "pct": "k::DOUBLE / n * 100"},
                   subject=sql_str(target), value="k", where="k > 0", src=src)


def _corr(a, b):
    den = f"(STDDEV_POP(CASE WHEN {b} IS NOT NULL THEN {a} END) * STDDEV_POP(CASE WHEN {a} IS NOT NULL THEN {b} END))"
    return (f"CASE WHEN {den} = 0 OR {den} IS NULL THEN NULL "
            f"ELSE GREATEST(-1.0::DOUBLE, LEAST(1.0::DOUBLE, COVAR_POP({a}, {b}) / {den})) END")


def sql_leakage(source, target, numeric_features, test_score_sql="NULL") -> str:
    rs = " UNION ALL ".join(f"SELECT {i} AS o, '{c}' AS c, {_corr(c, target)} AS r FROM {source} t"
                            for i, c in enumerate(numeric_features))
    leak = sql_row(4, "CRITICAL", T.LEAKAGE, {"col": "c", "r": "r", "target": sql_str(target)},
                   subject="c", value="r", where="ABS(r) > 0.95", src=f"FROM ({rs}) s")
    sus = sql_row(5, "WARNING", T.SUSPICIOUS, {"score": "sc"}, value="sc",
                  where=f"sc > 0.999 AND NOT EXISTS (SELECT 1 FROM ({rs}) z WHERE ABS(z.r) > 0.95)",
                  src=f"FROM (SELECT CAST({test_score_sql} AS DOUBLE) AS sc) s")
    return f"{leak} UNION ALL {sus}"


def sql_imbalance(source, target) -> str:
    src = (f"FROM (SELECT FIRST(v ORDER BY c DESC, CAST(v AS VARCHAR)) AS maj, MAX(c) AS mx, MIN(c) AS mn, COUNT(*) AS k, "
           f"(SELECT COUNT(*) FROM {source} t2) AS n FROM (SELECT {target} AS v, COUNT(*) AS c FROM {source} t "
           f"WHERE {target} IS NOT NULL GROUP BY 1)) s")
    f = {"pct": "mn::DOUBLE / n * 100", "ratio": "mx::DOUBLE / mn", "majority": "CAST(maj AS VARCHAR)"}
    p = "mn::DOUBLE / n * 100"
    return " UNION ALL ".join([
        sql_row(6, "CRITICAL", T.SEVERE_IMBALANCE, f, value=p, where=f"k >= 2 AND {p} < 5", src=src),
        sql_row(6, "WARNING", T.MODERATE_IMBALANCE, f, value=p, where=f"k >= 2 AND {p} >= 5 AND {p} < 20", src=src),
        sql_row(6, "INFO", T.BALANCED, f, value=p, where=f"k >= 2 AND {p} >= 20", src=src),
    ])


def sql_collinear(source, numeric) -> str:
    if len(numeric) < 2:
        pairs = "SELECT NULL::INTEGER AS i, NULL::INTEGER AS j, NULL::VARCHAR AS a, NULL::VARCHAR AS b, NULL::DOUBLE AS r WHERE FALSE"
    else:
        pairs = " UNION ALL ".join(
            f"SELECT {i} AS i, {j} AS j, '{a}' AS a, '{b}' AS b, ABS({_corr(a, b)}) AS r FROM {source} t"
            for i, a in enumerate(numeric) for j, b in enumerate(numeric) if i < j)
    src = (f"FROM (SELECT COUNT(*) FILTER (WHERE r > 0.85) AS k, "
           f"{sql_str(T.COLLINEAR_PAIRS)} || string_agg(printf('(%s & %s: r=%.2f)', a, b, r), ', ' ORDER BY j, i) "
           f"FILTER (WHERE r > 0.85) AS pairs FROM ({pairs})) s")
    return " UNION ALL ".join([
        sql_row(7, "WARNING", T.COLLINEAR, {"count": "k", "pairs": "pairs"}, value="k", where="k > 0", src=src),
        sql_row(7, "INFO", T.COLLINEAR_OK, {}, value="0", where="k = 0", src=src),
    ])


def sql_overfit(train_sql, test_sql, metric) -> str:
    src = f"FROM (SELECT CAST({train_sql} AS DOUBLE) AS tr, CAST({test_sql} AS DOUBLE) AS te) s"
    f = {"metric": sql_str(metric), "train": "tr", "test": "te", "gap": "tr - te"}
    return " UNION ALL ".join([
        sql_row(8, "WARNING", T.OVERFIT, f, value="tr - te", where="tr - te > 0.15", src=src),
        sql_row(8, "INFO", T.GENERALIZES, f, value="tr - te", where="tr - te <= 0.15", src=src),
    ])


def sql_cardinality(source, nonnum) -> str:
    cards = " UNION ALL ".join(f"SELECT {i} AS o, '{c}' AS c, COUNT(DISTINCT {c}) AS k FROM {source} t"
                               for i, c in enumerate(nonnum))
    src = (f"FROM (SELECT COUNT(*) FILTER (WHERE k > 30) AS w, string_agg(printf('''%s'' (%s categories)', c, CAST(k AS VARCHAR)), ', ' "
           f"ORDER BY o) FILTER (WHERE k > 30) AS items FROM ({cards})) s")
    return sql_row(9, "WARNING", T.HIGH_CARDINALITY, {"items": "items"}, value="w", where="w > 0", src=src)


def sql_cluster_sizes(source, col) -> str:
    src = f"FROM (SELECT {col} AS c, COUNT(*) AS size, SUM(COUNT(*)) OVER () AS n FROM {source} t GROUP BY 1) s"
    f = {"c": "c", "size": "size", "pct": "size::DOUBLE / n * 100"}
    p = "size::DOUBLE / n * 100"
    return " UNION ALL ".join([
        sql_row(11, "WARNING", T.SMALL_CLUSTER, f, subject="c", value=p, where=f"{p} < 5", src=src),
        sql_row(11, "WARNING", T.DOMINANT_CLUSTER, f, subject="c", value=p, where=f"{p} > 80", src=src),
    ])


def _final(sql: str) -> str:
    return f"SELECT check_order, status, check_name, subject, ROUND(value, 6) AS value, message, details FROM ({sql}) q"


def _spark_rows(log, order=None):
    out = log if order is None else log.where(F.col("check_order") == order)
    return rounded(out.select(*COLS))


# --------------------------------------------------------------------------------------------
# setups
# --------------------------------------------------------------------------------------------

A_TARGET = "l_returnflag"
A_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate"]
A_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
A_NONNUM = ["l_linestatus", "l_shipdate"]
TIME_SPLIT = "l_shipdate < TIMESTAMP '1999-01-01 00:00:00'"


def rule_scores(spark, sf):
    """(train F1, test F1) of the best rule model on a time split of lineitem."""
    test = rule_metrics(spark, sf, f"NOT ({TIME_SPLIT})")
    best = M.champion(test, "Classification").first()
    train = rule_metrics(spark, sf, TIME_SPLIT)
    tr = train.where((F.col("model_order") == best["model_order"]) & (F.col("metric") == M.F1)).first()["value"]
    return float(tr), float(best["score"])


TEST_F1_SQL = (f"(SELECT value FROM ({_weighted_sql(_rules_sql('NOT (' + TIME_SPLIT + ')'), digits=None)}) m WHERE metric = 'F1-Score' "
               f"ORDER BY value DESC, model_order LIMIT 1)")
TRAIN_F1_SQL = (f"(SELECT tr.value FROM ({_weighted_sql(_rules_sql(TIME_SPLIT), digits=None)}) tr WHERE tr.metric = 'F1-Score' AND "
                f"tr.model_order = (SELECT model_order FROM ({_weighted_sql(_rules_sql('NOT (' + TIME_SPLIT + ')'), digits=None)}) m "
                f"WHERE metric = 'F1-Score' ORDER BY value DESC, model_order LIMIT 1))")


def log_a(spark, sf):
    tr, te = rule_scores(spark, sf)
    return TR.run_checks(table(spark, sf, "lineitem"), A_TARGET, A_FEATURES, "Classification", tr, te)


C_SRC = O.LABELED_DOCS
C_TARGET = "quality"
C_FEATURES = ["lang", "source", "n_chars", "toxic"]

PRICED_SQL = ("(SELECT l.*, p.p_retailprice, l.l_quantity * p.p_retailprice AS list_price FROM lineitem l "
              "LEFT JOIN part p ON l.l_partkey = p.p_partkey)")


@register("chk_sample_size", _final(f"({sql_sample('lineitem')}) UNION ALL ({sql_sample('benchmark')})"))
def q_chk_sample_size(spark, sf):
    a = TR.run_checks(table(spark, sf, "lineitem"), None, ["l_quantity"], "Clustering")
    b = TR.run_checks(table(spark, sf, "benchmark"), None, ["text"], "Clustering")
    return _spark_rows(a, TR.SAMPLE).unionByName(_spark_rows(b, TR.SAMPLE))


@register("chk_missing_features", _final(sql_missing(C_SRC, C_FEATURES)))
def q_chk_missing_features(spark, sf):
    log = TR.run_checks(labeled_documents(spark, sf), C_TARGET, C_FEATURES, "Classification")
    return _spark_rows(log, TR.MISSING)


@register("chk_missing_target", _final(sql_target_missing(C_SRC, C_TARGET)))
def q_chk_missing_target(spark, sf):
    log = TR.run_checks(labeled_documents(spark, sf), C_TARGET, C_FEATURES, "Classification")
    return _spark_rows(log, TR.TARGET_MISSING)


B_TARGET = "list_price"
B_FEATURES = ["l_quantity", "p_retailprice", "l_discount", "l_extendedprice"]


@register("chk_target_leakage", _final(sql_leakage(PRICED_SQL, B_TARGET, B_FEATURES)))
def q_chk_target_leakage(spark, sf):
    log = TR.run_checks(priced_lineitem(spark, sf), B_TARGET, B_FEATURES, "Regression")
    return _spark_rows(log, TR.LEAKAGE).unionByName(_spark_rows(log, TR.SUSPICIOUS))


# suspicious score: no leaking feature, and the score of the exact list-price rule on the later rows
S_FEATURES = ["l_discount", "l_tax"]
S_SCORE_SQL = (f"(SELECT CASE WHEN VAR_POP(list_price) = 0 THEN 1.0 ELSE 1 - SUM((list_price - l_quantity * p_retailprice) ^ 2) "
               f"/ (VAR_POP(list_price) * COUNT(*)) END FROM {PRICED_SQL} t WHERE NOT ({TIME_SPLIT}) AND list_price IS NOT NULL)")


@register("chk_suspicious_score", _final(sql_leakage(PRICED_SQL, B_TARGET, S_FEATURES, S_SCORE_SQL)))
def q_chk_suspicious_score(spark, sf):
    df = priced_lineitem(spark, sf)
    later = df.where(spark_sql(f"NOT ({TIME_SPLIT})")).withColumn("rule", F.col("l_quantity") * F.col("p_retailprice"))
    r2 = M.regression_metrics(later, B_TARGET, "rule").where(F.col("metric") == M.R2).first()["value"]
    log = TR.run_checks(df, B_TARGET, S_FEATURES, "Regression", None, r2)
    return _spark_rows(log, TR.LEAKAGE).unionByName(_spark_rows(log, TR.SUSPICIOUS))


@register("chk_class_imbalance", _final(f"SELECT 'lineitem' AS setup, * FROM ({sql_imbalance('lineitem', 'l_returnflag')}) "
                                        f"UNION ALL SELECT 'labeled_documents', * FROM ({sql_imbalance(C_SRC, 'toxic')})")
          .replace("SELECT check_order,", "SELECT setup, check_order,"))
def q_chk_class_imbalance(spark, sf):
    a = TR.run_checks(table(spark, sf, "lineitem"), "l_returnflag", ["l_quantity"], "Classification")
    b = TR.run_checks(labeled_documents(spark, sf), "toxic", ["n_chars"], "Classification")
    return (_spark_rows(a, TR.IMBALANCE).select(F.lit("lineitem").alias("setup"), "*")
            .unionByName(_spark_rows(b, TR.IMBALANCE).select(F.lit("labeled_documents").alias("setup"), "*")))


M_FEATURES = ["l_quantity", "list_price", "l_discount", "p_retailprice"]


@register("chk_multicollinearity", _final(f"SELECT 'lineitem' AS setup, * FROM ({sql_collinear('lineitem', A_NUMERIC)}) "
                                          f"UNION ALL SELECT 'priced', * FROM ({sql_collinear(PRICED_SQL, M_FEATURES)})")
          .replace("SELECT check_order,", "SELECT setup, check_order,"))
def q_chk_multicollinearity(spark, sf):
    a = TR.run_checks(table(spark, sf, "lineitem"), None, A_NUMERIC, "Clustering")
    b = TR.run_checks(priced_lineitem(spark, sf), None, M_FEATURES, "Clustering")
    return (_spark_rows(a, TR.COLLINEAR).select(F.lit("lineitem").alias("setup"), "*")
            .unionByName(_spark_rows(b, TR.COLLINEAR).select(F.lit("priced").alias("setup"), "*")))


@register("chk_overfitting", _final(sql_overfit(TRAIN_F1_SQL, TEST_F1_SQL, "F1-Score")))
def q_chk_overfitting(spark, sf):
    return _spark_rows(log_a(spark, sf), TR.OVERFIT)


@register("chk_high_cardinality", _final(sql_cardinality("lineitem", A_NONNUM)))
def q_chk_high_cardinality(spark, sf):
    return _spark_rows(log_a(spark, sf), TR.CARDINALITY)


@register("chk_cluster_sizes", _final(sql_cluster_sizes("customer", "c_nationkey")))
def q_chk_cluster_sizes(spark, sf):
    cust = table(spark, sf, "customer")
    log = TR.run_checks(cust, None, ["c_acctbal"], "Clustering", best_metrics={}, clusters=cust,
                        cluster_col="c_nationkey")
    return _spark_rows(log, TR.CLUSTER_SIZES)


SILHOUETTE_SQL = """
SELECT AVG(CASE WHEN GREATEST(a, b) = 0 THEN 0 ELSE (b - a) / GREATEST(a, b) END) FROM (
  SELECT r, MAX(CASE WHEN k = label THEN d END) AS a, MIN(CASE WHEN k <> label THEN d END) AS b FROM (
    SELECT r, label, k, SQRT(SUM((v - m) ^ 2)) AS d FROM v JOIN c ON v.i = c.i GROUP BY r, label, k) GROUP BY r)"""


def sql_silhouette() -> str:
    values = ("WITH v AS (SELECT r, label, UNNEST(embedding)::DOUBLE AS v, UNNEST(RANGE(1, LEN(embedding) + 1)) AS i FROM "
              "(SELECT ROW_NUMBER() OVER () AS r, label, embedding FROM embeddings)), "
              "c AS (SELECT label AS k, i, AVG(v) AS m FROM v GROUP BY label, i)")
    src = f"FROM ({values} SELECT ({SILHOUETTE_SQL}) AS s) s"
    return " UNION ALL ".join([
        sql_row(10, "WARNING", T.WEAK_CLUSTERS, {"s": "s"}, value="s", where="s < 0.25", src=src),
        sql_row(10, "INFO", T.STRONG_CLUSTERS, {"s": "s"}, value="s", where="s >= 0.5", src=src),
        sql_row(10, "INFO", T.MODERATE_CLUSTERS, {"s": "s"}, value="s", where="s >= 0.25 AND s < 0.5", src=src)])


@register("chk_silhouette", _final(sql_silhouette()))
def q_chk_silhouette(spark, sf):
    """Silhouette check for the embeddings grouped by their label."""
    emb = table(spark, sf, "embeddings").select(array_to_vector("embedding").alias("features"),
                                                 F.col("label").cast("double").alias("prediction"))
    log = TR.run_checks(table(spark, sf, "embeddings").select("label", "vec_id"), None, ["vec_id"], "Clustering",
                        best_metrics={"Silhouette Score": C.centroid_silhouette(emb)})
    return _spark_rows(log, TR.SILHOUETTE)


A_LOG_SQL = (f"({sql_sample('lineitem')}) UNION ALL ({sql_missing('lineitem', A_FEATURES)}) UNION ALL "
             f"({sql_target_missing('lineitem', A_TARGET)}) UNION ALL ({sql_imbalance('lineitem', A_TARGET)}) UNION ALL "
             f"({sql_collinear('lineitem', A_NUMERIC)}) UNION ALL ({sql_overfit(TRAIN_F1_SQL, TEST_F1_SQL, 'F1-Score')}) "
             f"UNION ALL ({sql_cardinality('lineitem', A_NONNUM)})")


@register("trust_log", f"SELECT ROW_NUMBER() OVER (ORDER BY check_order) - 1 AS seq, * FROM ({_final(A_LOG_SQL)}) l")
def q_trust_log(spark, sf):
    log = log_a(spark, sf)
    return rounded(log.select("seq", *COLS))


@register("trust_summary", f"""
SELECT CAST(SUM(CASE WHEN status = 'CRITICAL' THEN 1 ELSE 0 END) AS BIGINT) AS n_critical,
       CAST(SUM(CASE WHEN status = 'WARNING' THEN 1 ELSE 0 END) AS BIGINT) AS n_warning,
       CAST(SUM(CASE WHEN status = 'INFO' THEN 1 ELSE 0 END) AS BIGINT) AS n_info,
       CASE WHEN SUM(CASE WHEN status = 'CRITICAL' THEN 1 ELSE 0 END) > 0 THEN 'critical'
            WHEN SUM(CASE WHEN status = 'WARNING' THEN 1 ELSE 0 END) > 0 THEN 'warning' ELSE 'clean' END AS headline
FROM ({A_LOG_SQL}) l""")
def q_trust_summary(spark, sf):
    return TR.trust_summary(log_a(spark, sf))
