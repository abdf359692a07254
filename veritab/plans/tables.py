"""Access to the driver's parquet tables and a few frames derived from them by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def labeled_documents(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """documents LEFT JOIN labels: the label columns are NULL for unlabeled documents."""
    docs = table(spark, sf_dir, "documents")
    cols = ["doc_id", "lang", "source", "n_chars"] + (["text"] if with_text else [])
    return docs.select(*cols).join(table(spark, sf_dir, "labels"), "doc_id", "left")


def priced_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with a list-price estimate of its extended price (quantity x part retail price)."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return li.join(part, "l_partkey", "left").withColumn(
        "list_price", F.col("l_quantity") * F.col("p_retailprice"))
