"""Report tables: the profile table per audience, the metric table with interpretations, and the
one-line performance headline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import messages as T
from .profile import TableProfile

AUDIENCES_WITH_PROFILE = ("manager", "technical")


def report_profile_table(p: TableProfile, audience: str) -> DataFrame:
    """Column, semantic type, missing % and unique count; executives get no profile table."""
    out = p.stats.select(F.col("column_name").alias("column"), F.col("semantic_type").alias("semantic_type"),
                         F.concat(F.col("missing_percentage").cast("string"), F.lit("%")).alias("missing"),
                         F.col("unique_count").alias("unique"), "ordinal")
    return out if audience in AUDIENCES_WITH_PROFILE else out.where(F.lit(False))


def report_metric_table(metrics: DataFrame) -> DataFrame:
    """(metric, value, value_text, interpretation): a broadcast join to the small fixed lookup."""
    spark = metrics.sparkSession
    lookup = spark.createDataFrame(list(T.METRIC_INTERPRETATION.items()), "metric string, interpretation string")
    return (metrics.join(F.broadcast(lookup), "metric", "left")
            .select("metric", "value", F.format_string("%.4f", "value").alias("value_text"),
                    F.coalesce("interpretation", F.lit(T.METRIC_INTERPRETATION_DEFAULT)).alias("interpretation")))


def report_headline(metrics: DataFrame, task: str) -> DataFrame:
    """Performance sentence of the champion: F1 + accuracy, R² + RMSE, or the silhouette."""
    m = metrics.groupBy().pivot("metric").agg(F.first("value"))
    cols = set(m.columns)

    def val(name):
        return F.coalesce(F.col(f"`{name}`"), F.lit(0.0)) if name in cols else F.lit(0.0)

    if task == "Classification":
        text = F.format_string("with an F1-Score of %.2f%% (Accuracy: %.2f%%)", val("F1-Score") * 100, val("Accuracy") * 100)
    elif task == "Regression":
        text = F.format_string("with an R² of %.2f (RMSE: %.4f)", val("R²"), val("RMSE"))
    else:
        text = F.format_string("with a Silhouette Score of %.3f", val("Silhouette Score"))
    return m.select(F.lit(task).alias("task"), text.alias("headline"))
