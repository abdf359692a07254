"""Evaluation as aggregates over prediction frames: confusion matrix, accuracy / precision / recall / F1,
exact tie-aware ROC-AUC and ROC curve, regression errors, champion choice and comparison tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import materialize_small, running_totals, safe_ratio
from ..functions.types import present, qc

ACCURACY, PRECISION, RECALL, F1, ROC_AUC = "Accuracy", "Precision", "Recall", "F1-Score", "ROC-AUC"
MAE, MSE, RMSE, R2 = "MAE", "MSE", "RMSE", "R²"
CLASSIFICATION_METRICS = [ACCURACY, PRECISION, RECALL, F1, ROC_AUC]
REGRESSION_METRICS = [MAE, MSE, RMSE, R2]


def confusion_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, count) for the pairs that occur; labels compared as text. The predictions are
    scanned once; the pair counts (about one row per class) are kept as a local relation."""
    return materialize_small(
        df.groupBy(qc(actual).cast("string").alias("actual"), qc(predicted).cast("string").alias("predicted"))
        .agg(F.count(F.lit(1)).alias("count")))


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts true x predicted over all labels seen in either column, zero-filled."""
    cm = confusion_counts(df, actual, predicted)
    labels = cm.select(F.col("actual").alias("l")).union(cm.select(F.col("predicted").alias("l"))).distinct()
    grid = labels.agg(F.sort_array(F.collect_list("l")).alias("ls")).select(
        F.explode("ls").alias("actual"), F.col("ls").alias("ls")).select("actual", F.explode("ls").alias("predicted"))
    return (grid.join(cm, ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def _per_class(cm: DataFrame) -> DataFrame:
    sup = cm.groupBy(F.col("actual").alias("label")).agg(F.sum("count").alias("support"))
    prd = cm.groupBy(F.col("predicted").alias("label")).agg(F.sum("count").alias("pred_n"))
    tp = cm.where(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("label"), F.col("count").alias("tp"))
    z = F.lit(0)
    return (sup.join(prd, "label", "full").join(tp, "label", "left")
            .select("label", F.coalesce("support", z).alias("support"), F.coalesce("pred_n", z).alias("pred_n"),
                    F.coalesce("tp", z).alias("tp")))


def _prf(tp, pred_n, support):
    p = F.coalesce(safe_ratio(tp, pred_n), F.lit(0.0))
    r = F.coalesce(safe_ratio(tp, support), F.lit(0.0))
    f = F.coalesce(safe_ratio(2 * tp, 2 * tp + (pred_n - tp) + (support - tp)), F.lit(0.0))
    return p, r, f


def classification_metrics(df: DataFrame, actual: str, predicted: str, binary: bool,
                           positive=None) -> DataFrame:
    """(metric, value) for Accuracy, Precision, Recall, F1-Score. Binary uses the positive class;
    otherwise support-weighted averages over the labels seen in either column; 0 on zero division."""
    return metrics_from_counts(confusion_counts(df, actual, predicted), binary, positive)


def metrics_from_counts(cm: DataFrame, binary: bool, positive=None) -> DataFrame:
    """The same metrics from a confusion-count frame (actual, predicted, count)."""
    pc = _per_class(cm)
    acc = cm.agg(safe_ratio(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0)),
                            F.sum("count")).alias("v"))
    if binary:
        pos = pc.where(F.col("label") == F.lit(str(positive)))
        p, r, f = _prf(F.col("tp"), F.col("pred_n"), F.col("support"))
        prf = pos.select(p.alias("p"), r.alias("r"), f.alias("f"))
        # a positive class absent from both columns gives zeros
        prf = prf.unionByName(pc.sparkSession.createDataFrame([(0.0, 0.0, 0.0)], "p double, r double, f double")) \
                 .agg(F.max("p").alias("p"), F.max("r").alias("r"), F.max("f").alias("f"))
    else:
        p, r, f = _prf(F.col("tp"), F.col("pred_n"), F.col("support"))
        tot = F.sum("support")
        prf = pc.agg(
            F.coalesce(safe_ratio(F.sum(p * F.col("support")), tot), F.lit(0.0)).alias("p"),
            F.coalesce(safe_ratio(F.sum(r * F.col("support")), tot), F.lit(0.0)).alias("r"),
            F.coalesce(safe_ratio(F.sum(f * F.col("support")), tot), F.lit(0.0)).alias("f"),
        )
    return (acc.select(F.lit(ACCURACY).alias("metric"), F.coalesce("v", F.lit(0.0)).alias("value"))
            .unionByName(prf.select(F.explode(F.array(
                F.struct(F.lit(PRECISION).alias("metric"), F.col("p").alias("value")),
                F.struct(F.lit(RECALL).alias("metric"), F.col("r").alias("value")),
                F.struct(F.lit(F1).alias("metric"), F.col("f").alias("value")))).alias("m")).select("m.*")))


def _score_groups(df: DataFrame, is_pos, score, by: Sequence[str]) -> DataFrame:
    return (df.select(*[qc(b).alias(b) for b in by], score.cast("double").alias("score"),
                      is_pos.cast("int").alias("pos"))
            .where(F.col("score").isNotNull())
            .groupBy(*by, "score")
            .agg(F.sum("pos").cast("long").alias("pos"), F.sum(1 - F.col("pos")).cast("long").alias("neg")))


def roc_auc(df: DataFrame, is_pos, score, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve with ties counted half (Mann-Whitney), per group ``by``.
    Scores are grouped first, so the running totals run over distinct scores only. NULL when a
    group lacks positives or negatives."""
    by = list(by)
    g = _score_groups(df, is_pos, score, by)
    rt = running_totals(g, "score", ["neg"], descending=False, partition_by=by)
    below = F.col("cum_neg") - F.col("neg")
    return rt.groupBy(*by).agg(
        safe_ratio(F.sum(F.col("pos") * (below + 0.5 * F.col("neg"))), F.sum("pos") * F.sum("neg")).alias("auc"))


def roc_curve(df: DataFrame, is_pos, score) -> DataFrame:
    """(threshold, fpr, tpr) for each distinct score, highest first, starting at (inf, 0, 0)."""
    g = _score_groups(df, is_pos, score, [])
    tot = g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    rt = running_totals(g, "score", ["pos", "neg"], descending=True)
    pts = rt.select(
        F.col("score").alias("threshold"),
        safe_ratio(F.col("cum_neg"), F.lit(tot["N"] or 0)).alias("fpr"),
        safe_ratio(F.col("cum_pos"), F.lit(tot["P"] or 0)).alias("tpr"))
    origin = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return origin.unionByName(pts)


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(metric, value): MAE, MSE, RMSE, R² (1 - SSE/SST; a constant target gives 1 when exact, else 0)."""
    y, yh = present(actual), present(predicted)
    e = y - yh
    a = df.where(y.isNotNull() & yh.isNotNull()).agg(
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sum(e * e).alias("sse"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("sst"))
    r2 = F.when(F.col("sst") == 0, F.when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))) \
          .otherwise(1 - F.col("sse") / F.col("sst"))
    return a.select(F.explode(F.array(
        F.struct(F.lit(MAE).alias("metric"), F.col("mae").alias("value")),
        F.struct(F.lit(MSE).alias("metric"), F.col("mse").alias("value")),
        F.struct(F.lit(RMSE).alias("metric"), F.sqrt("mse").alias("value")),
        F.struct(F.lit(R2).alias("metric"), r2.alias("value")))).alias("m")).select("m.*")


def champion(metrics: DataFrame, task: str) -> DataFrame:
    """Best model by F1-Score (classification) or R² (regression); the earlier model wins ties.
    ``metrics`` is (model_order, model, metric, value)."""
    key = F1 if task == "Classification" else R2
    return (metrics.where((F.col("metric") == key) & F.col("value").isNotNull() & ~F.isnan("value"))
            .orderBy(F.col("value").desc(), F.col("model_order").asc()).limit(1)
            .select("model_order", "model", F.col("value").alias("score")))


def model_comparison(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """Wide table: one row per model, one column per metric."""
    return metrics.groupBy("model_order", "model").pivot("metric", list(names)).agg(F.first("value"))


def actual_vs_predicted(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted) of every row where both are present."""
    return df.select(present(actual).alias("actual"), present(predicted).alias("predicted")).where(
        F.col("actual").isNotNull() & F.col("predicted").isNotNull())


def actual_vs_predicted_range(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Identity-line extent: min and max over both actual and predicted values."""
    y, yh = present(actual), present(predicted)
    return df.agg(F.count(F.lit(1)).alias("n"), F.least(F.min(y), F.min(yh)).alias("lo"),
                  F.greatest(F.max(y), F.max(yh)).alias("hi"))


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    yh = present(predicted)
    return df.select(yh.alias("predicted"), (present(actual) - yh).alias("residual"))


def residuals_range(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(n, lo, hi): extent of the predicted values, for the zero line of a residual chart."""
    r = residuals(df, actual, predicted).where(F.col("residual").isNotNull())
    return r.agg(F.count(F.lit(1)).alias("n"), F.min("predicted").alias("lo"), F.max("predicted").alias("hi"),
                 F.min("residual").alias("residual_lo"), F.max("residual").alias("residual_hi"))
