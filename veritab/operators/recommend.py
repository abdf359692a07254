"""Target / KPI recommendation and default feature selection over the per-column stats frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from .profile import TableProfile, name_has_any


def _scored(p: TableProfile) -> DataFrame:
    name, st, u = F.col("column_name"), F.col("semantic_type"), F.col("unique_count")
    target = (
        F.when(name_has_any(name, R.TARGET_KEYWORDS), 3).otherwise(0)
        + F.when(st == R.CATEGORICAL,
                 F.when(u == 2, 3).when((u > 2) & (u <= 10), 2).otherwise(0))
        .when(st == R.NUMERIC, 1).otherwise(0)
    )
    kpi = (
        F.when(name_has_any(name, R.KPI_KEYWORDS), 3).otherwise(0)
        + F.when(st == R.CATEGORICAL, 1).when(st == R.NUMERIC, 2).otherwise(0)
    )
    excluded = st.isin(R.ID, R.TEXT) | (u <= 1)
    return (
        p.stats.where(F.col("missing_percentage") <= R.CANDIDATE_MAX_MISSING)
        .select("ordinal", "column_name", "semantic_type",
                F.when(excluded, 0).otherwise(target).alias("target_score"),
                F.when(excluded, 0).otherwise(kpi).alias("kpi_score"))
    )


def target_candidates(p: TableProfile) -> DataFrame:
    """(rank, column, type, task_suggestion, score): score >= 2, by score desc then column order.
    The frame has one row per column, so the global window is tiny."""
    w = Window.orderBy(F.col("score").desc(), F.col("ordinal").asc())
    return (
        _scored(p).where(F.col("target_score") >= 2)
        .select("ordinal", F.col("column_name").alias("column"), F.col("semantic_type").alias("type"),
                F.when(F.col("semantic_type") == R.CATEGORICAL, F.lit("Classification"))
                .otherwise(F.lit("Regression")).alias("task_suggestion"),
                F.col("target_score").alias("score"))
        .withColumn("rank", F.row_number().over(w))
    )


def kpi_candidates(p: TableProfile) -> DataFrame:
    w = Window.orderBy(F.col("score").desc(), F.col("ordinal").asc())
    return (
        _scored(p).where(F.col("kpi_score") >= 2)
        .select("ordinal", F.col("column_name").alias("column"), F.col("semantic_type").alias("type"),
                F.col("kpi_score").alias("score"))
        .withColumn("rank", F.row_number().over(w))
    )


def candidate_confidence(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn(
        "confidence", F.when(F.col("score") >= R.HIGH_CONFIDENCE_SCORE, F.lit("High")).otherwise(F.lit("Medium")))


def default_target(p: TableProfile) -> DataFrame:
    return target_candidates(p).where(F.col("rank") == 1)


def default_features(p: TableProfile, target: str | None) -> DataFrame:
    """Columns that are not ID/Text, not the target and not entirely NULL."""
    cond = ~F.col("semantic_type").isin(R.ID, R.TEXT) & (F.col("non_null") > 0)
    if target is not None:
        cond = cond & (F.col("column_name") != target)
    return p.stats.where(cond).select("ordinal", "column_name", "semantic_type")
