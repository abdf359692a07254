"""Registered queries: sources, sinks, preview and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as C
from ..operators import models as MD
from ..operators import prep as PR
from ..operators import profile as P
from ..operators import report as RP
from ..operators import trust as TR
from ..session import scratch_path
from ..sources import readers as RD
from ..sources import sinks as SK
from . import oracle_sql as O
from .q_metrics import RULE_METRICS_SQL, rule_metrics
from .registry import register, rounded
from .tables import labeled_documents, table


def _path(sf, name):
    return f"{sf.rstrip('/')}/{name}.parquet"


@register("load_by_extension", "SELECT * FROM orders")
def q_load_by_extension(spark, sf):
    return RD.load_dataset(spark, _path(sf, "orders"))


@register("load_parquet", "SELECT * FROM lineitem")
def q_load_parquet(spark, sf):
    return RD.load_parquet(spark, _path(sf, "lineitem"))


@register("load_csv",
          "SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(l.quality AS BIGINT) AS quality, "
          "CAST(l.toxic AS BIGINT) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q_load_csv(spark, sf):
    """Whole documents with their labels written as CSV (NULL -> empty field), read back with typing."""
    path = scratch_path(spark, "csv") + "/labeled_documents.csv"
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    SK.write_dataset(docs.join(table(spark, sf, "labels"), "doc_id", "left"), path, "csv")
    return RD.load_dataset(spark, path)


@register("load_json",
          "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def q_load_json(spark, sf):
    path = scratch_path(spark, "json") + "/part.json"
    SK.write_dataset(table(spark, sf, "part"), path, "json")
    return RD.load_dataset(spark, path)


@register("load_fallback_csv",
          "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier")
def q_load_fallback_csv(spark, sf):
    """An explicit but unknown file type falls back to the CSV reader."""
    path = scratch_path(spark, "dat") + "/supplier.dat"
    SK.write_dataset(table(spark, sf, "supplier"), path, "csv")
    return RD.load_dataset(spark, path, file_type="text")


@register("load_table", "SELECT * FROM nation")
def q_load_table(spark, sf):
    table(spark, sf, "nation").createOrReplaceTempView("veritab_nation")
    return RD.load_table(spark, "veritab_nation")


@register("preview",
          "SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, "
          "l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate LIMIT 10")
def q_preview(spark, sf):
    """First 10 rows in a stable order (top-k: each task keeps 10 rows, the driver merges them)."""
    li = table(spark, sf, "lineitem")
    return li.orderBy(*li.columns).limit(10)


@register("sink_dataset", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def q_sink_dataset(spark, sf):
    """Write the documents as CSV without an index column and read them back, typed."""
    path = scratch_path(spark, "sink") + "/documents.csv"
    SK.write_dataset(table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars"), path, "csv")
    return RD.load_dataset(spark, path)


@register("sink_artifacts")
def q_sink_artifacts(spark, sf):
    """Persist a run partitioned by run_id: column profile, trust log, metrics, cluster profile, preprocessing and champion
    model. The profile is written again, as a rerun would, and read back."""
    base = scratch_path(spark, "artifacts")
    li = table(spark, sf, "lineitem")
    p = P.profile_table(li)
    prof = P.column_profile(p)
    log = TR.run_checks(li, "l_returnflag", ["l_quantity", "l_discount", "l_linestatus"], "Classification")
    kinds = {"l_quantity": "numeric", "l_discount": "one_hot", "l_linestatus": "one_hot"}
    model, _ = PR.fit_preprocessing(li, list(kinds), kinds)
    prep = PR.prepare(labeled_documents(spark, sf), "quality", ["n_chars", "lang", "toxic"], "Classification")
    baselines = MD.train_baselines(prep, [MD.LOGISTIC])
    clusters = C.train_clustering(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], only=[C.KMEANS])
    frames = {"column_profile": prof, "trust_log": log, "metrics": baselines.metrics(),
              "cluster_profile": clusters.profile(clusters.results[0]).toDF("cluster", "n", "percent", "c_acctbal", "c_nationkey")}
    paths = SK.write_artifacts(frames, base, "run-1", models={"preprocessing": model, "champion": baselines.champion().model})
    SK.write_artifacts({"column_profile": prof}, base, "run-1")
    PR.Preprocessing.load(spark, paths["model:preprocessing"], list(model.codes)).transform(li)
    baselines.release()
    clusters.release()
    return spark.read.parquet(f"{base}/column_profile").where(F.col("run_id") == "run-1")


@register("report_profile_table",
          f"SELECT column_name AS \"column\", semantic_type, CAST(missing_percentage AS VARCHAR) || '%' AS missing, "
          f"unique_count AS \"unique\", ordinal FROM {O.typed_stats('lineitem', O.SCHEMAS['lineitem'])}")
def q_report_profile_table(spark, sf):
    return RP.report_profile_table(P.profile_table(table(spark, sf, "lineitem")), "manager")


def _interp_sql():
    from ..functions import messages as T
    rows = " UNION ALL ".join(f"SELECT '{k}' AS metric, '{v}' AS interpretation" for k, v in T.METRIC_INTERPRETATION.items())
    return rows


@register("report_metric_table", f"""
SELECT m.metric, m.value, printf('%.4f', m.value) AS value_text,
       COALESCE(i.interpretation, 'Model performance metric.') AS interpretation
FROM ({RULE_METRICS_SQL}) m LEFT JOIN ({_interp_sql()}) i ON m.metric = i.metric WHERE m.model_order = 0""")
def q_report_metric_table(spark, sf):
    met = rounded(rule_metrics(spark, sf)).where(F.col("model_order") == 0).select("metric", "value")
    return RP.report_metric_table(met)


@register("report_headline", f"""
SELECT 'Classification' AS task,
       printf('with an F1-Score of %.2f%% (Accuracy: %.2f%%)',
              MAX(CASE WHEN metric = 'F1-Score' THEN value END) * 100, MAX(CASE WHEN metric = 'Accuracy' THEN value END) * 100) AS headline
FROM ({RULE_METRICS_SQL}) m WHERE model_order = 0""")
def q_report_headline(spark, sf):
    met = rounded(rule_metrics(spark, sf)).where(F.col("model_order") == 0).select("metric", "value")
    return RP.report_headline(met, "Classification")
