"""Registered queries: projection / predicates and feature preparation."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import prep as PR
from . import oracle_sql as O
from .registry import register, rounded
from .tables import labeled_documents, table

LI_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate"]


@register("select_features",
          "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, l_shipdate, l_returnflag FROM lineitem")
def q_select_features(spark, sf):
    return PR.select_features(table(spark, sf, "lineitem"), LI_FEATURES, "l_returnflag")


@register("drop_null_target", f"SELECT * FROM {O.LABELED_DOCS} t WHERE quality IS NOT NULL")
def q_drop_null_target(spark, sf):
    return PR.drop_null_target(labeled_documents(spark, sf), "quality")


@register("valid_features", " UNION ALL ".join(
    f"SELECT {i} AS ordinal, '{c}' AS column_name, COUNT({c}) AS non_null FROM {O.LABELED_DOCS} t HAVING COUNT({c}) > 0"
    for i, c in enumerate(["lang", "source", "n_chars", "toxic"])))
def q_valid_features(spark, sf):
    return PR.valid_features_frame(labeled_documents(spark, sf), ["lang", "source", "n_chars", "toxic"])


@register("cast_to_string",
          "SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS VARCHAR) AS l_linenumber_s, "
          "CAST(l_discount AS VARCHAR) AS l_discount_s, CAST(l_tax AS VARCHAR) AS l_tax_s FROM lineitem")
def q_cast_to_string(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_linenumber").alias("l_linenumber_s"),
        F.col("l_discount").alias("l_discount_s"), F.col("l_tax").alias("l_tax_s"))
    return PR.cast_to_string(li, ["l_linenumber_s", "l_discount_s", "l_tax_s"])


@register("bool_label_binarise",
          "SELECT l_linestatus, CAST(l_linestatus = 'O' AS INTEGER) AS label_bin FROM lineitem")
def q_bool_label_binarise(spark, sf):
    li = table(spark, sf, "lineitem").select("l_linestatus")
    classes = [r[0] for r in li.distinct().collect()]
    return PR.bool_label_binarise(li, "l_linestatus", PR.positive_class(classes))


@register("impute_missing_label",
          f"SELECT doc_id, COALESCE(CAST(quality AS VARCHAR), 'missing') AS quality, "
          f"COALESCE(CAST(toxic AS VARCHAR), 'missing') AS toxic FROM {O.LABELED_DOCS} t")
def q_impute_missing_label(spark, sf):
    df = labeled_documents(spark, sf).select("doc_id", "quality", "toxic")
    return PR.impute_missing_label(df, ["quality", "toxic"])


@register("impute_median",
          f"SELECT doc_id, ROUND(COALESCE(n_chars::DOUBLE, (SELECT MEDIAN(n_chars) FROM {O.LABELED_DOCS} a)), 6) AS n_chars, "
          f"ROUND(COALESCE(quality::DOUBLE, (SELECT MEDIAN(quality) FROM {O.LABELED_DOCS} b)), 6) AS quality, "
          f"ROUND(COALESCE(toxic::DOUBLE, (SELECT MEDIAN(toxic) FROM {O.LABELED_DOCS} c)), 6) AS toxic FROM {O.LABELED_DOCS} t")
def q_impute_median(spark, sf):
    df = labeled_documents(spark, sf).select("doc_id", "n_chars", "quality", "toxic")
    fit = PR.numeric_fit(df, ["n_chars", "quality", "toxic"])
    return rounded(PR.impute_median(df, {c: v[0] for c, v in fit.items()}))


@register("standard_scale",
          "SELECT l_orderkey, l_linenumber, "
          "ROUND((l_quantity - (SELECT AVG(l_quantity) FROM lineitem)) / (SELECT STDDEV_POP(l_quantity) FROM lineitem), 6) AS l_quantity, "
          "ROUND((l_extendedprice - (SELECT AVG(l_extendedprice) FROM lineitem)) / (SELECT STDDEV_POP(l_extendedprice) FROM lineitem), 6) AS l_extendedprice "
          "FROM lineitem")
def q_standard_scale(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    fit = PR.numeric_fit(li, ["l_quantity", "l_extendedprice"])
    return rounded(PR.standard_scale(li, {c: (v[1], v[2]) for c, v in fit.items()}))


FK_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate", "l_suppkey"]


def _feature_kinds_sql():
    parts = []
    for i, c in enumerate(FK_COLS):
        t = dict(O.SCHEMAS["lineitem"])[c]
        num = O.kind(t) in ("integral", "numeric")
        parts.append(
            f"SELECT {i} AS ordinal, '{c}' AS column_name, COUNT(DISTINCT {c}) AS distinct, "
            f"COUNT(DISTINCT {c}) + CASE WHEN COUNT(*) > COUNT({c}) THEN 1 ELSE 0 END AS text_distinct, "
            f"CASE WHEN {'TRUE' if num else 'FALSE'} AND COUNT(DISTINCT {c}) > 10 THEN 'numeric' "
            f"WHEN COUNT(DISTINCT {c}) + CASE WHEN COUNT(*) > COUNT({c}) THEN 1 ELSE 0 END <= 15 THEN 'one_hot' "
            f"ELSE 'ordinal' END AS kind FROM lineitem")
    return " UNION ALL ".join(parts)


@register("feature_kinds", _feature_kinds_sql())
def q_feature_kinds(spark, sf):
    return PR.feature_kinds(table(spark, sf, "lineitem"), FK_COLS)


@register("ordinal_encode",
          "SELECT p_partkey, p_brand, CAST(DENSE_RANK() OVER (ORDER BY p_brand) - 1 AS DOUBLE) AS p_brand_code FROM part")
def q_ordinal_encode(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    return PR.ordinal_encode(part, "p_brand", PR.ordinal_codes(part, "p_brand"), "p_brand_code")


@register("one_hot",
          "SELECT l_orderkey, l_linenumber, " + ", ".join(
              f"CAST({c} = '{v}' AS DOUBLE) AS {c}_{v}" for c, vs in (("l_returnflag", "ANR"), ("l_linestatus", "FO")) for v in vs)
          + " FROM lineitem")
def q_one_hot(spark, sf):
    """One-hot columns of l_returnflag / l_linestatus fitted on lineitem."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    model, names = PR.fit_preprocessing(li, ["l_returnflag", "l_linestatus"], {"l_returnflag": "one_hot", "l_linestatus": "one_hot"})
    x = vector_to_array("features")
    return model.transform(li).select("l_orderkey", "l_linenumber", *[x[i].alias(n) for i, n in enumerate(names)])


@register("feature_vector",
          "SELECT l_orderkey, "
          "ROUND((l_quantity - (SELECT AVG(l_quantity) FROM lineitem)) / (SELECT STDDEV_POP(l_quantity) FROM lineitem), 6) AS l_quantity, "
          "ROUND((l_extendedprice - (SELECT AVG(l_extendedprice) FROM lineitem)) / (SELECT STDDEV_POP(l_extendedprice) FROM lineitem), 6) AS l_extendedprice, "
          "CAST(l_linestatus = 'F' AS DOUBLE) AS \"l_linestatus_F\", CAST(l_linestatus = 'O' AS DOUBLE) AS \"l_linestatus_O\", "
          "CAST(DENSE_RANK() OVER (ORDER BY CAST(l_suppkey AS VARCHAR)) - 1 AS DOUBLE) AS l_suppkey FROM lineitem")
def q_feature_vector(spark, sf):
    """Full preprocessing (scaled numeric + one-hot + ordinal) over lineitem, one column for each entry of the vector."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_linestatus", "l_suppkey")
    kinds = {"l_quantity": "numeric", "l_extendedprice": "numeric", "l_linestatus": "one_hot", "l_suppkey": "ordinal"}
    model, names = PR.fit_preprocessing(li, list(kinds), kinds)
    x = vector_to_array("features")
    return rounded(model.transform(li).select("l_orderkey", *[x[i].alias(n) for i, n in enumerate(names)]))


@register("train_test_split",
          "SELECT 'test' AS _split, CAST(CEIL(0.2::DOUBLE * COUNT(*)) AS BIGINT) AS count FROM lineitem UNION ALL "
          "SELECT 'train' AS _split, COUNT(*) - CAST(CEIL(0.2::DOUBLE * COUNT(*)) AS BIGINT) AS count FROM lineitem")
def q_train_test_split(spark, sf):
    return PR.train_test_split(table(spark, sf, "lineitem")).groupBy("_split").count()


STRAT_SQL = """
WITH c AS (SELECT l_returnflag AS cls, COUNT(*) AS cnt FROM lineitem GROUP BY 1),
t AS (SELECT SUM(cnt) AS n, SUM(cnt) - CAST(CEIL(0.2::DOUBLE * SUM(cnt)) AS BIGINT) AS n_train FROM c),
a AS (SELECT cls, cnt, (n_train * cnt) // n AS base, (n_train * cnt) % n AS rem, n_train FROM c, t),
b AS (SELECT *, ROW_NUMBER() OVER (ORDER BY rem DESC, cls) AS rr, n_train - SUM(base) OVER () AS leftover FROM a),
tr AS (SELECT cls, cnt, base + CASE WHEN rr <= leftover THEN 1 ELSE 0 END AS n_tr FROM b)
SELECT cls AS l_returnflag, 'train' AS _split, CAST(n_tr AS BIGINT) AS count FROM tr
UNION ALL SELECT cls AS l_returnflag, 'test' AS _split, CAST(cnt - n_tr AS BIGINT) AS count FROM tr"""


@register("stratified_split", STRAT_SQL)
def q_stratified_split(spark, sf):
    li = table(spark, sf, "lineitem")
    return PR.train_test_split(li, "l_returnflag", stratify=True).groupBy("l_returnflag", "_split").count()


def nan_quality(spark, sf):
    """doc_id and quality as double, missing as NaN for odd ids and NULL for even ones."""
    d = labeled_documents(spark, sf)
    q = F.col("quality").cast("double")
    return d.select("doc_id", F.when(q.isNull() & (F.col("doc_id") % 2 == 1), F.lit(float("nan"))).otherwise(q).alias("quality"),
                    F.lit(float("nan")).alias("empty"))


@register("valid_features_nan", f"SELECT 0 AS ordinal, 'quality' AS column_name, COUNT(quality) AS non_null FROM {O.LABELED_DOCS} t")
def q_valid_features_nan(spark, sf):
    """NaN counts as missing: a column of NaN only is not valid."""
    return PR.valid_features_frame(nan_quality(spark, sf), ["quality", "empty"])


@register("impute_median_nan",
          f"SELECT doc_id, COALESCE(quality::DOUBLE, (SELECT MEDIAN(quality) FROM {O.LABELED_DOCS} b)) AS quality FROM {O.LABELED_DOCS} t")
def q_impute_median_nan(spark, sf):
    df = nan_quality(spark, sf).select("doc_id", "quality")
    return PR.impute_median(df, {c: v[0] for c, v in PR.numeric_fit(df, ["quality"]).items()})
