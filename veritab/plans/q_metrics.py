"""Registered queries: evaluation metrics on rule-based predictions derived from the tables
(deterministic, so every number is checkable against SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import materialize_small
from ..operators import metrics as M
from . import oracle_sql as O
from .registry import register, rounded
from .tables import priced_lineitem, table

# ---- rule "models" over lineitem predicting l_returnflag ----
RULES = [
    ("By status", "CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'R' END"),
    ("By discount", "CASE WHEN l_discount >= 0.05 THEN 'A' ELSE 'R' END"),
    ("By ship date", "CASE WHEN l_shipdate < TIMESTAMP '1998-06-01 00:00:00' THEN 'R' ELSE 'N' END"),
]


def spark_sql(expr: str) -> str:
    """The rules compare the time-zone-free ship date with a literal: make the literal time-zone-free
    in Spark too, so the session time zone never shifts the comparison."""
    return expr.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")


def rule_predictions(spark, sf, where: str | None = None) -> DataFrame:
    """Long frame (model_order, model, actual, predicted) of every rule over lineitem."""
    li = table(spark, sf, "lineitem")
    if where:
        li = li.where(spark_sql(where))
    arr = F.array(*[F.struct(F.lit(i).alias("model_order"), F.lit(n).alias("model"),
                             F.expr(spark_sql(e)).alias("predicted"))
                    for i, (n, e) in enumerate(RULES)])
    return li.select(F.col("l_returnflag").alias("actual"), F.explode(arr).alias("m")).select(
        "m.model_order", "m.model", "actual", "m.predicted")


def rule_metrics(spark, sf, where: str | None = None) -> DataFrame:
    """Metrics of every rule model from one scan: the confusion counts of all models are one aggregate
    (a few rows per model), the metrics are computed from that small frame."""
    preds = rule_predictions(spark, sf, where)
    cm_all = materialize_small(preds.groupBy("model_order", F.col("actual").cast("string").alias("actual"),
                                             F.col("predicted").cast("string").alias("predicted"))
                               .agg(F.count(F.lit(1)).alias("count")))
    out = None
    for i, (n, _) in enumerate(RULES):
        cm = cm_all.where(F.col("model_order") == i).select("actual", "predicted", "count")
        m = M.metrics_from_counts(cm, binary=False)
        m = m.select(F.lit(i).alias("model_order"), F.lit(n).alias("model"), "metric", "value")
        out = m if out is None else out.unionByName(m)
    return out


def _rules_sql(where: str = "TRUE") -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS model_order, '{n}' AS model, l_returnflag AS actual, {e} AS predicted FROM lineitem WHERE {where}"
        for i, (n, e) in enumerate(RULES))


def _weighted_sql(preds: str, by: str = "model_order, model", digits: int | None = 6) -> str:
    """Accuracy and support-weighted precision / recall / F1 per model, in long form."""
    def rnd(e):
        return f"ROUND({e}, {digits})" if digits is not None else e
    return f"""
WITH p AS ({preds}),
cm AS (SELECT {by}, actual, predicted, COUNT(*) AS c FROM p GROUP BY ALL),
lab AS (SELECT DISTINCT {by}, actual AS label FROM cm UNION SELECT DISTINCT {by}, predicted FROM cm),
pc AS (SELECT {', '.join('l.' + x.strip() for x in by.split(','))}, l.label,
              COALESCE((SELECT SUM(c) FROM cm WHERE cm.actual = l.label AND {' AND '.join(f'cm.{x.strip()} = l.{x.strip()}' for x in by.split(','))}), 0) AS support,
              COALESCE((SELECT SUM(c) FROM cm WHERE cm.predicted = l.label AND {' AND '.join(f'cm.{x.strip()} = l.{x.strip()}' for x in by.split(','))}), 0) AS pred_n,
              COALESCE((SELECT SUM(c) FROM cm WHERE cm.actual = l.label AND cm.predicted = l.label AND {' AND '.join(f'cm.{x.strip()} = l.{x.strip()}' for x in by.split(','))}), 0) AS tp
       FROM lab l),
w AS (SELECT {by},
             SUM(CASE WHEN pred_n = 0 THEN 0 ELSE tp::DOUBLE / pred_n END * support) / SUM(support) AS prec,
             SUM(CASE WHEN support = 0 THEN 0 ELSE tp::DOUBLE / support END * support) / SUM(support) AS rec,
             SUM(CASE WHEN 2 * tp + (pred_n - tp) + (support - tp) = 0 THEN 0
                      ELSE 2.0 * tp / (2 * tp + (pred_n - tp) + (support - tp)) END * support) / SUM(support) AS f1
      FROM pc GROUP BY ALL),
a AS (SELECT {by}, SUM(CASE WHEN actual = predicted THEN c ELSE 0 END)::DOUBLE / SUM(c) AS acc FROM cm GROUP BY ALL)
SELECT {by}, 'Accuracy' AS metric, {rnd('acc')} AS value FROM a
UNION ALL SELECT {by}, 'Precision', {rnd('prec')} FROM w
UNION ALL SELECT {by}, 'Recall', {rnd('rec')} FROM w
UNION ALL SELECT {by}, 'F1-Score', {rnd('f1')} FROM w"""


RULE_METRICS_SQL = _weighted_sql(_rules_sql())


@register("classification_metrics", RULE_METRICS_SQL)
def q_classification_metrics(spark, sf):
    return rounded(rule_metrics(spark, sf))


LABELED = ("(SELECT d.doc_id, d.n_chars, l.quality, CAST(d.n_chars >= 3000 AS INTEGER) AS predicted "
           "FROM documents d JOIN labels l ON d.doc_id = l.doc_id)")


def labeled_predictions(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id").withColumn("predicted", (F.col("n_chars") >= 3000).cast("int"))


@register("classification_metrics_binary", f"""
WITH p AS (SELECT CAST(quality AS VARCHAR) AS actual, CAST(predicted AS VARCHAR) AS predicted FROM {LABELED} t),
s AS (SELECT SUM(CASE WHEN actual = '1' AND predicted = '1' THEN 1 ELSE 0 END) AS tp,
             SUM(CASE WHEN actual <> '1' AND predicted = '1' THEN 1 ELSE 0 END) AS fp,
             SUM(CASE WHEN actual = '1' AND predicted <> '1' THEN 1 ELSE 0 END) AS fn,
             SUM(CASE WHEN actual = predicted THEN 1 ELSE 0 END)::DOUBLE / COUNT(*) AS acc FROM p)
SELECT 'Accuracy' AS metric, ROUND(acc, 6) AS value FROM s
UNION ALL SELECT 'Precision', ROUND(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 6) FROM s
UNION ALL SELECT 'Recall', ROUND(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END, 6) FROM s
UNION ALL SELECT 'F1-Score', ROUND(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) FROM s""")
def q_classification_metrics_binary(spark, sf):
    return rounded(M.classification_metrics(labeled_predictions(spark, sf), "quality", "predicted", binary=True, positive=1))


AUC_SQL = f"""
WITH p AS (SELECT quality AS y, n_chars::DOUBLE AS s FROM {LABELED} t),
r AS (SELECT y, RANK() OVER (ORDER BY s) + (COUNT(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM p),
t AS (SELECT SUM(CASE WHEN y = 1 THEN rk ELSE 0 END) AS rs, SUM(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS np,
             SUM(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS nn FROM r)
SELECT ROUND((rs - np * (np + 1) / 2.0) / (np * nn), 6) AS auc FROM t"""


@register("roc_auc", AUC_SQL)
def q_roc_auc(spark, sf):
    p = labeled_predictions(spark, sf)
    return rounded(M.roc_auc(p, F.col("quality") == 1, F.col("n_chars")))


# one-vs-rest AUC per class of l_returnflag with a class-specific score, weighted by support
OVR_SCORES = {"A": "l_discount", "N": "l_tax", "R": "l_quantity"}


@register("roc_auc_ovr", "WITH " + ", ".join(
    f"""r_{c} AS (SELECT (l_returnflag = '{c}') AS y, RANK() OVER (ORDER BY {s}) + (COUNT(*) OVER (PARTITION BY {s}) - 1) / 2.0 AS rk FROM lineitem),
t_{c} AS (SELECT '{c}' AS cls, SUM(CASE WHEN y THEN rk ELSE 0 END) AS rs, SUM(CASE WHEN y THEN 1 ELSE 0 END) AS np,
                 SUM(CASE WHEN y THEN 0 ELSE 1 END) AS nn FROM r_{c})""" for c, s in OVR_SCORES.items()) + """,
u AS (""" + " UNION ALL ".join(f"SELECT * FROM t_{c}" for c in OVR_SCORES) + """)
SELECT cls, ROUND((rs - np * (np + 1) / 2.0) / (np * nn), 6) AS auc, CAST(np AS BIGINT) AS support,
       ROUND(SUM((rs - np * (np + 1) / 2.0) / (np * nn) * np) OVER () / SUM(np) OVER (), 6) AS weighted_auc FROM u""")
def q_roc_auc_ovr(spark, sf):
    li = table(spark, sf, "lineitem")
    arr = F.array(*[F.struct(F.lit(c).alias("cls"), F.col(s).cast("double").alias("score")) for c, s in OVR_SCORES.items()])
    long = li.select("l_returnflag", F.explode(arr).alias("k")).select("l_returnflag", "k.cls", "k.score")
    auc = M.roc_auc(long, F.col("l_returnflag") == F.col("cls"), F.col("score"), by=["cls"])
    sup = li.groupBy(F.col("l_returnflag").alias("cls")).agg(F.count(F.lit(1)).alias("support"))
    j = auc.join(sup, "cls")
    tot = j.agg((F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("w")).first()["w"]
    return rounded(j.select("cls", "auc", "support", F.lit(tot).alias("weighted_auc")))


@register("roc_curve", f"""
WITH p AS (SELECT quality AS y, n_chars::DOUBLE AS s FROM {LABELED} t),
g AS (SELECT s, SUM(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos, SUM(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg FROM p GROUP BY s),
c AS (SELECT s, SUM(pos) OVER (ORDER BY s DESC) AS cp, SUM(neg) OVER (ORDER BY s DESC) AS cn,
             SUM(pos) OVER () AS tp, SUM(neg) OVER () AS tn FROM g)
SELECT 'inf'::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL SELECT s, ROUND(cn::DOUBLE / tn, 6), ROUND(cp::DOUBLE / tp, 6) FROM c""")
def q_roc_curve(spark, sf):
    p = labeled_predictions(spark, sf)
    return rounded(M.roc_curve(p, F.col("quality") == 1, F.col("n_chars")))


@register("confusion_matrix", """
WITH p AS (SELECT l_returnflag AS actual, CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'R' END AS predicted FROM lineitem),
l AS (SELECT actual AS v FROM p UNION SELECT predicted FROM p)
SELECT a.v AS actual, b.v AS predicted, CAST(COUNT(p.actual) AS BIGINT) AS count
FROM l a CROSS JOIN l b LEFT JOIN p ON p.actual = a.v AND p.predicted = b.v GROUP BY a.v, b.v""")
def q_confusion_matrix(spark, sf):
    preds = rule_predictions(spark, sf).where(F.col("model_order") == 0)
    return M.confusion_matrix(preds, "actual", "predicted")


PRICED = "(SELECT l.l_extendedprice, l.l_quantity * p.p_retailprice AS list_price FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey)"


@register("regression_metrics", f"""
WITH e AS (SELECT l_extendedprice AS y, list_price AS yh FROM {PRICED} t WHERE l_extendedprice IS NOT NULL AND list_price IS NOT NULL),
a AS (SELECT AVG(ABS(y - yh)) AS mae, AVG((y - yh) * (y - yh)) AS mse, SUM((y - yh) * (y - yh)) AS sse,
             VAR_POP(y) * COUNT(*) AS sst FROM e)
SELECT 'MAE' AS metric, ROUND(mae, 6) AS value FROM a UNION ALL SELECT 'MSE', ROUND(mse, 6) FROM a
UNION ALL SELECT 'RMSE', ROUND(SQRT(mse), 6) FROM a
UNION ALL SELECT 'R²', ROUND(CASE WHEN sst = 0 THEN (CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END) ELSE 1 - sse / sst END, 6) FROM a""")
def q_regression_metrics(spark, sf):
    return rounded(M.regression_metrics(priced_lineitem(spark, sf), "l_extendedprice", "list_price"))


@register("actual_vs_predicted", f"""
SELECT COUNT(*) AS n, ROUND(LEAST(MIN(l_extendedprice), MIN(list_price)), 6) AS lo,
       ROUND(GREATEST(MAX(l_extendedprice), MAX(list_price)), 6) AS hi FROM {PRICED} t""")
def q_actual_vs_predicted(spark, sf):
    return rounded(M.actual_vs_predicted_range(priced_lineitem(spark, sf), "l_extendedprice", "list_price"))


@register("actual_vs_predicted_pairs",
          f"SELECT ROUND(l_extendedprice, 6) AS actual, ROUND(list_price, 6) AS predicted FROM {PRICED} t "
          "WHERE l_extendedprice IS NOT NULL AND list_price IS NOT NULL")
def q_actual_vs_predicted_pairs(spark, sf):
    return rounded(M.actual_vs_predicted(priced_lineitem(spark, sf), "l_extendedprice", "list_price"))


@register("residuals_range", f"""
SELECT COUNT(*) AS n, ROUND(MIN(list_price), 6) AS lo, ROUND(MAX(list_price), 6) AS hi,
       ROUND(MIN(l_extendedprice - list_price), 6) AS residual_lo, ROUND(MAX(l_extendedprice - list_price), 6) AS residual_hi
FROM {PRICED} t WHERE l_extendedprice IS NOT NULL AND list_price IS NOT NULL""")
def q_residuals_range(spark, sf):
    return rounded(M.residuals_range(priced_lineitem(spark, sf), "l_extendedprice", "list_price"))


@register("residuals", f"SELECT ROUND(list_price, 6) AS predicted, ROUND(l_extendedprice - list_price, 6) AS residual FROM {PRICED} t")
def q_residuals(spark, sf):
    return rounded(M.residuals(priced_lineitem(spark, sf), "l_extendedprice", "list_price"))


@register("champion_model", f"""
SELECT model_order, model, value AS score FROM ({RULE_METRICS_SQL}) m WHERE metric = 'F1-Score'
ORDER BY value DESC, model_order ASC LIMIT 1""")
def q_champion(spark, sf):
    return rounded(M.champion(rule_metrics(spark, sf), "Classification"))


@register("model_comparison", f"""
PIVOT ({RULE_METRICS_SQL}) ON metric IN ('Accuracy', 'Precision', 'Recall', 'F1-Score') USING first(value) GROUP BY model_order, model""")
def q_model_comparison(spark, sf):
    return rounded(M.model_comparison(rule_metrics(spark, sf), ["Accuracy", "Precision", "Recall", "F1-Score"]))


TIME_SPLIT = "l_shipdate < TIMESTAMP '1999-01-01 00:00:00'"


@register("train_score", f"""
WITH champ AS (SELECT model_order FROM ({RULE_METRICS_SQL.replace('WHERE TRUE', 'WHERE NOT (' + TIME_SPLIT + ')')}) m
               WHERE metric = 'F1-Score' ORDER BY value DESC, model_order LIMIT 1),
tr AS ({_weighted_sql(_rules_sql(TIME_SPLIT))})
SELECT tr.model, tr.value AS train_score FROM tr JOIN champ ON tr.model_order = champ.model_order WHERE tr.metric = 'F1-Score'""")
def q_train_score(spark, sf):
    """Champion chosen on the later rows (test), scored on the earlier rows (train): a time split."""
    test = rule_metrics(spark, sf, f"NOT ({TIME_SPLIT})")
    best = M.champion(test, "Classification").first()
    train = rule_metrics(spark, sf, TIME_SPLIT)
    return rounded(train.where((F.col("model_order") == best["model_order"]) & (F.col("metric") == M.F1))
                   .select("model", F.col("value").alias("train_score")))
