"""Sinks: the dataset without an index column, and the run's result tables / fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import CSV_OPTIONS


def write_dataset(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> str:
    """Write every row (no index column); CSV gets a header row."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true").options(**CSV_OPTIONS)
    w.save(path)
    return path


def write_artifacts(tables: dict[str, DataFrame], base_path: str, run_id: str,
                    models: dict[str, object] | None = None) -> dict[str, str]:
    """Write each result frame under ``base_path/<name>`` partitioned by ``run_id`` (a rerun of a ``run_id``
    replaces its partition, other runs stay) and save models under ``base_path/models/<run_id>/<name>``. Returns the written paths."""
    out = {}
    for name, df in tables.items():
        p = f"{base_path.rstrip('/')}/{name}"
        df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(p)
        out[name] = p
    for name, model in (models or {}).items():
        p = f"{base_path.rstrip('/')}/models/{run_id}/{name}"
        if hasattr(model, "write"):
            model.write().overwrite().save(p)
        else:
            model.save(p)
        out[f"model:{name}"] = p
    return out
