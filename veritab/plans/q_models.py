"""Registered queries: baseline models and clustering on MLlib. Model outputs depend on
the training algorithm, so most are rows-only checks; cluster profiles are checked exactly."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..operators import cluster as C
from ..operators import models as MD
from ..operators import prep as PR
from .registry import register, rounded
from .tables import labeled_documents, priced_lineitem, table

CLF_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus"]
REG_FEATURES = ["l_quantity", "p_retailprice", "l_discount", "l_tax", "l_returnflag"]
#: Depth that the registered queries ask of their forests (the library's default grows them to Spark's limit).
FOREST_DEPTH = 12
BIN_FEATURES = ["n_chars", "lang", "source", "toxic"]


def _multiclass(spark, sf, only=None):
    prep = PR.prepare(table(spark, sf, "lineitem"), "l_returnflag", CLF_FEATURES, "Classification")
    return MD.train_baselines(prep, only, FOREST_DEPTH)


def _binary(spark, sf, only=None):
    prep = PR.prepare(labeled_documents(spark, sf), "quality", BIN_FEATURES, "Classification")
    return MD.train_baselines(prep, only, FOREST_DEPTH)


def _regression(spark, sf, only=None):
    prep = PR.prepare(priced_lineitem(spark, sf), "l_extendedprice", REG_FEATURES, "Regression")
    return MD.train_baselines(prep, only, FOREST_DEPTH)


def _preds(b):
    r = b.results[0]
    b.release()          # predictions read the checkpointed test vectors, not the cached train split
    return r.predictions.select(F.lit(r.name).alias("model"), "_rid", "label", "prediction")


@register("clf_logistic")
def q_clf_logistic(spark, sf):
    """Multinomial logistic regression on lineitem -> l_returnflag: test-split predictions."""
    return _preds(_multiclass(spark, sf, [MD.LOGISTIC]))


@register("clf_forest")
def q_clf_forest(spark, sf):
    return _preds(_multiclass(spark, sf, [MD.FOREST]))


@register("clf_boosting")
def q_clf_boosting(spark, sf):
    """Binary gradient-boosted trees on labeled documents -> quality."""
    return _preds(_binary(spark, sf, [MD.BOOSTING]))


@register("clf_boosting_multiclass")
def q_clf_boosting_multiclass(spark, sf):
    """Multi-class boosting (one-vs-rest GBT) on lineitem -> l_returnflag."""
    return _preds(_multiclass(spark, sf, [MD.BOOSTING]))


@register("reg_ridge")
def q_reg_ridge(spark, sf):
    return _preds(_regression(spark, sf, [MD.RIDGE]))


@register("reg_forest")
def q_reg_forest(spark, sf):
    return _preds(_regression(spark, sf, [MD.FOREST]))


@register("reg_boosting")
def q_reg_boosting(spark, sf):
    return _preds(_regression(spark, sf, [MD.BOOSTING]))


@register("train_baselines")
def q_train_baselines(spark, sf):
    """All three classifiers on labeled documents: (model_order, model, metric, value), 15 rows."""
    b = _binary(spark, sf)
    b.release()
    return rounded(b.metrics())


@register("train_baselines_regression")
def q_train_baselines_regression(spark, sf):
    b = _regression(spark, sf)
    b.release()
    return rounded(b.metrics())


@register("feature_importance")
def q_feature_importance(spark, sf):
    """Importances (or mean |coefficients|) of the labeled-documents champion, sorted desc."""
    b = _binary(spark, sf)
    imp = MD.feature_importance(b, b.champion())
    return rounded(imp)


@register("train_score_model")
def q_train_score_model(spark, sf):
    b = _binary(spark, sf)
    ch = b.champion()
    test = b.metrics().where((F.col("model_order") == ch.order) & (F.col("metric") == "F1-Score")).first()["value"]
    return spark.createDataFrame([(ch.name, float(MD.train_score(b, ch)), float(test))],
                                 "model string, train_score double, test_score double")


# ---------------------------------------------------------------- clustering
CUST_FEATURES = ["c_acctbal", "c_nationkey", "c_mktsegment"]


def _clusters(spark, sf, k=3, only=None):
    return C.train_clustering(table(spark, sf, "customer"), CUST_FEATURES, k=k, only=only)


@register("kmeans")
def q_kmeans(spark, sf):
    cl = _clusters(spark, sf, only=[C.KMEANS])
    cl.release()
    return cl.results[0].predictions.select("_rid", "prediction")


@register("gmm")
def q_gmm(spark, sf):
    cl = _clusters(spark, sf, only=[C.GMM])
    cl.release()
    return cl.results[0].predictions.select("_rid", "prediction")


@register("kmeans_embeddings")
def q_kmeans_embeddings(spark, sf):
    """K-Means (k = 10) directly on the embedding vectors (array<float> -> vector)."""
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("_rid"),
                                                 array_to_vector("embedding").alias("features"))
    from pyspark.ml.clustering import KMeans
    m = KMeans(k=10, seed=42, maxIter=300, tol=1e-4).fit(emb)
    return m.transform(emb).select(F.col("_rid").alias("vec_id"), "prediction")


def _metric_frame(spark, sf, metric):
    cl = _clusters(spark, sf)
    return rounded(cl.metrics().where(F.col("metric") == metric))


@register("silhouette")
def q_silhouette(spark, sf):
    return _metric_frame(spark, sf, C.SILHOUETTE)


@register("davies_bouldin")
def q_davies_bouldin(spark, sf):
    return _metric_frame(spark, sf, C.DAVIES_BOULDIN)


@register("calinski_harabasz")
def q_calinski_harabasz(spark, sf):
    return _metric_frame(spark, sf, C.CALINSKI_HARABASZ)


@register("cluster_metrics")
def q_cluster_metrics(spark, sf):
    """Model comparison for clustering: silhouette, DB, CH, inertia / BIC per model."""
    return rounded(_clusters(spark, sf).metrics())


@register("best_clustering")
def q_best_clustering(spark, sf):
    return rounded(C.best_clustering(_clusters(spark, sf).metrics()))


PROFILE_SQL = """
WITH b AS (SELECT 'Cluster ' || p_type AS c, p_size, p_retailprice, p_brand, p_name FROM part),
s AS (SELECT c, COUNT(*) AS n FROM b GROUP BY c),
m AS (SELECT c, ROUND_EVEN(AVG(p_size), 2) AS ms, ROUND_EVEN(AVG(p_retailprice), 2) AS mp FROM b GROUP BY c),
tb AS (SELECT c, v FROM (SELECT c, p_brand AS v, ROW_NUMBER() OVER (PARTITION BY c ORDER BY COUNT(*) DESC, p_brand) AS r
       FROM b WHERE p_brand IS NOT NULL GROUP BY c, p_brand) WHERE r = 1),
tn AS (SELECT c, v FROM (SELECT c, p_name AS v, ROW_NUMBER() OVER (PARTITION BY c ORDER BY COUNT(*) DESC, p_name) AS r
       FROM b WHERE p_name IS NOT NULL GROUP BY c, p_name) WHERE r = 1)
SELECT s.c AS "Cluster", s.n AS "Size (Rows)", ROUND_EVEN(s.n::DOUBLE / SUM(s.n) OVER () * 100, 2) AS "Percentage (%)",
       m.ms AS "p_size (Mean)", m.mp AS "p_retailprice (Mean)", COALESCE(tb.v, 'N/A') AS "p_brand (Top)",
       COALESCE(tn.v, 'N/A') AS "p_name (Top)"
FROM s JOIN m ON s.c = m.c LEFT JOIN tb ON s.c = tb.c LEFT JOIN tn ON s.c = tn.c"""


@register("cluster_profile", PROFILE_SQL)
def q_cluster_profile(spark, sf):
    """Profile of part grouped by p_type taken as the cluster label."""
    part = table(spark, sf, "part")
    return rounded(C.cluster_profile(part, ["p_size", "p_retailprice", "p_brand", "p_name"], "p_type"))


@register("cluster_profile_fitted")
def q_cluster_profile_fitted(spark, sf):
    """Profile of the clusters that K-Means has just found among the customers."""
    cl = _clusters(spark, sf, only=[C.KMEANS])
    return rounded(cl.profile(cl.results[0]))


@register("kmeans_invariants",
          "SELECT COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS not_nearest, CAST(3 AS BIGINT) AS clusters FROM customer")
def q_kmeans_invariants(spark, sf):
    """Every row has a label, and that of its nearest centre."""
    from pyspark.ml.functions import vector_to_array
    cl = _clusters(spark, sf, only=[C.KMEANS])
    r = cl.results[0]
    far = F.array(*[F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)),
                                F.lit(0.0), lambda s, v: s + v) for c in r.model.clusterCenters()])
    d = r.predictions.select("prediction", vector_to_array("features").alias("x")).select("prediction", far.alias("far"))
    cl.release()
    return d.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.sum(F.when(F.get("far", F.col("prediction")) > F.array_min("far") + 1e-9, 1).otherwise(0)).alias("not_nearest"),
                 F.count_distinct("prediction").alias("clusters"))


@register("pca_numeric")
def q_pca_numeric(spark, sf):
    """The report's projection of the numeric customer features."""
    pts, evr = C.pca_numeric(table(spark, sf, "customer"), CUST_FEATURES)
    return rounded(pts.withColumn("evr1", F.lit(evr[0])).withColumn("evr2", F.lit(evr[1])))


@register("pca_2d")
def q_pca_2d(spark, sf):
    cl = _clusters(spark, sf)
    best = cl.best()
    pts, evr = C.pca_2d(best.predictions)
    return rounded(pts.withColumn("evr1", F.lit(evr[0])).withColumn("evr2", F.lit(evr[1])))


@register("k_sweep")
def q_k_sweep(spark, sf):
    vec, _, _ = C.prepare_vectors(table(spark, sf, "customer"), CUST_FEATURES)
    return rounded(C.k_sweep(vec))


# ---------------------------------------------------------------- indices of a fixed labelling (exact check)
LABEL_SQL = """
WITH p AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS c,
                  l_quantity::DOUBLE AS x1, l_discount::DOUBLE AS x2 FROM lineitem),
cs AS (SELECT c, COUNT(*) AS n, AVG(x1) AS m1, AVG(x2) AS m2, AVG(x1 * x1 + x2 * x2) AS q FROM p GROUP BY c),
w AS (SELECT MAX(CASE WHEN c = 0 THEN n END) AS n0, MAX(CASE WHEN c = 1 THEN n END) AS n1, MAX(CASE WHEN c = 2 THEN n END) AS n2,
             MAX(CASE WHEN c = 0 THEN m1 END) AS a0, MAX(CASE WHEN c = 1 THEN m1 END) AS a1, MAX(CASE WHEN c = 2 THEN m1 END) AS a2,
             MAX(CASE WHEN c = 0 THEN m2 END) AS b0, MAX(CASE WHEN c = 1 THEN m2 END) AS b1, MAX(CASE WHEN c = 2 THEN m2 END) AS b2,
             MAX(CASE WHEN c = 0 THEN q END) AS q0, MAX(CASE WHEN c = 1 THEN q END) AS q1, MAX(CASE WHEN c = 2 THEN q END) AS q2 FROM cs),
d AS (SELECT p.c, x1, x2,
             (x1 * x1 + x2 * x2) - 2 * (x1 * a0 + x2 * b0) + q0 AS d0,
             (x1 * x1 + x2 * x2) - 2 * (x1 * a1 + x2 * b1) + q1 AS d1,
             (x1 * x1 + x2 * x2) - 2 * (x1 * a2 + x2 * b2) + q2 AS d2,
             SQRT((x1 - CASE p.c WHEN 0 THEN a0 WHEN 1 THEN a1 ELSE a2 END) ^ 2 + (x2 - CASE p.c WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END) ^ 2) AS e,
             n0, n1, n2 FROM p, w),
s AS (SELECT c, e,
             CASE c WHEN 0 THEN d0 * n0 / (n0 - 1) WHEN 1 THEN d1 * n1 / (n1 - 1) ELSE d2 * n2 / (n2 - 1) END AS a,
             CASE c WHEN 0 THEN LEAST(d1, d2) WHEN 1 THEN LEAST(d0, d2) ELSE LEAST(d0, d1) END AS b FROM d),
sil AS (SELECT AVG((b - a) / GREATEST(a, b)) AS v FROM s),
ed AS (SELECT p.c, SQRT((x1 - a0) ^ 2 + (x2 - b0) ^ 2) AS f0, SQRT((x1 - a1) ^ 2 + (x2 - b1) ^ 2) AS f1,
             SQRT((x1 - a2) ^ 2 + (x2 - b2) ^ 2) AS f2 FROM p, w),
es AS (SELECT CASE c WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END AS a,
             CASE c WHEN 0 THEN LEAST(f1, f2) WHEN 1 THEN LEAST(f0, f2) ELSE LEAST(f0, f1) END AS b FROM ed),
esil AS (SELECT AVG(CASE WHEN GREATEST(a, b) = 0 THEN 0 ELSE (b - a) / GREATEST(a, b) END) AS v FROM es),
si AS (SELECT c, AVG(e) AS sc, SUM(e * e) AS wc FROM s GROUP BY c),
cc AS (SELECT cs.c, cs.n, cs.m1, cs.m2, si.sc, si.wc FROM cs JOIN si ON cs.c = si.c),
db AS (SELECT AVG(mx) AS v FROM (SELECT i.c, MAX((i.sc + j.sc) / SQRT((i.m1 - j.m1) ^ 2 + (i.m2 - j.m2) ^ 2)) AS mx
                                  FROM cc i JOIN cc j ON i.c <> j.c GROUP BY i.c)),
g AS (SELECT SUM(n * m1) / SUM(n) AS g1, SUM(n * m2) / SUM(n) AS g2, SUM(n) AS nn, COUNT(*) AS k, SUM(wc) AS ww FROM cc),
ch AS (SELECT (SUM(cc.n * ((cc.m1 - g1) ^ 2 + (cc.m2 - g2) ^ 2)) * (MAX(nn) - MAX(k))) / (MAX(ww) * (MAX(k) - 1)) AS v FROM cc, g)
SELECT 'Silhouette Score' AS metric, ROUND((SELECT v FROM esil), 6) AS value
UNION ALL SELECT 'Silhouette Score (squared Euclidean)', ROUND((SELECT v FROM sil), 6)
UNION ALL SELECT 'Davies-Bouldin Index', ROUND((SELECT v FROM db), 6)
UNION ALL SELECT 'Calinski-Harabasz Index', ROUND((SELECT v FROM ch), 6)"""


@register("cluster_indices_labels", LABEL_SQL)
def q_cluster_indices_labels(spark, sf):
    """Both silhouettes, Davies-Bouldin and Calinski-Harabasz of lineitem grouped by
    l_returnflag over (l_quantity, l_discount): the index code on a labelling SQL can reproduce."""
    from pyspark.ml.feature import VectorAssembler
    li = table(spark, sf, "lineitem")
    lab = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    vec = VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="features").transform(
        li.select("l_quantity", "l_discount", lab.cast("int").alias("prediction")))
    m = C.quality_indices(vec.select("features", "prediction"))
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in m.items()], "metric string, value double"))


PLAIN_SQL = """
WITH e AS (SELECT vec_id, label AS c, embedding::DOUBLE[] AS x FROM embeddings),
d AS (SELECT a.vec_id, a.c AS own, b.c AS other,
             SUM(list_distance(a.x, b.x)) / CASE WHEN a.c = b.c THEN NULLIF(COUNT(*) - 1, 0) ELSE COUNT(*) END AS m
      FROM e a, e b GROUP BY a.vec_id, a.c, b.c),
s AS (SELECT vec_id, MAX(CASE WHEN own = other THEN m END) AS a, MIN(CASE WHEN own <> other THEN m END) AS b
      FROM d GROUP BY vec_id)
SELECT ROUND(AVG(CASE WHEN a IS NULL OR GREATEST(a, b) = 0 THEN 0 ELSE (b - a) / GREATEST(a, b) END), 6) AS silhouette,
       COUNT(*) > 4096 AS estimated FROM s"""


@register("silhouette_plain", PLAIN_SQL)
def q_silhouette_plain(spark, sf):
    """The plain silhouette of the embeddings by their label: exact up to 4,096 rows, against anchors beyond."""
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("prediction"),
                                                 array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    got = C.plain_silhouette(emb, "vec_id")
    return rounded(spark.createDataFrame([(got.value, got.error > 0)], "silhouette double, estimated boolean"))


# ---------------------------------------------------------------- optimality of the linear fits (zero gradients)
def _gradients(b, result, residuals):
    """For each feature, the sum over the train rows of the feature times each residual, and the sum of its absolute terms."""
    d = len(b.prepared.feature_names)
    pred = result.model.transform(b.train).select(vector_to_array("features").alias("x"), *residuals)
    names = [c for c in pred.columns if c != "x"]
    sums = [F.sum(F.col("x")[j] * F.col(c)) for c in names for j in range(d)] + [
        F.sum(F.abs(F.col("x")[j] * F.col(c))) for c in names for j in range(d)]
    row = pred.agg(F.array(*sums).alias("s"), F.array(*[F.sum(c) for c in names]).alias("r"),
                   F.array(*[F.sum(F.abs(c)) for c in names]).alias("a"), F.count(F.lit(1)).alias("n")).first()
    k = len(names) * d
    return row["s"][:k], row["s"][k:], row["r"], row["a"], row["n"]


#: Columns of the fitted vectors: one a category of a text or of a number of few values, one for any other number.
WIDTH_SQL = " + ".join([
    *(f"(SELECT CASE WHEN COUNT(DISTINCT {c}) <= 10 THEN COUNT(DISTINCT {c}) ELSE 1 END FROM {t})" for c, t in
      [("l_quantity", "lineitem"), ("p_retailprice", "part"), ("l_discount", "lineitem"), ("l_tax", "lineitem")]),
    "(SELECT COUNT(DISTINCT l_returnflag) FROM lineitem)"])


@register("reg_ridge_invariants", f"""
SELECT {WIDTH_SQL} AS n_features, {WIDTH_SQL} AS n_zero_gradients, TRUE AS residuals_sum_to_zero,
       COUNT(*) - CAST(CEIL(0.2 * COUNT(*)) AS BIGINT) AS n_train
FROM lineitem WHERE l_extendedprice IS NOT NULL""")
def q_reg_ridge_invariants(spark, sf):
    """The ridge fit solves its normal equations: at the fitted weights the gradient of the penalised squares is zero."""
    b = _regression(spark, sf, [MD.RIDGE])
    r = b.results[0]
    sums, sizes, total, absolute, n = _gradients(b, r, [(F.col("label") - F.col("prediction")).alias("e")])
    zero = sum(bool(abs(s - w) <= 1e-6 * a + 1e-9) for s, a, w in zip(sums, sizes, r.model.coefficients, strict=True))
    b.release()
    return spark.createDataFrame([(len(sums), zero, abs(total[0]) <= 1e-6 * absolute[0], n)],
                                 "n_features long, n_zero_gradients long, residuals_sum_to_zero boolean, n_train long")


CLF_WIDTH_SQL = " + ".join(
    [f"(SELECT CASE WHEN COUNT(DISTINCT {c}) <= 10 THEN COUNT(DISTINCT {c}) ELSE 1 END FROM lineitem)"
     for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")] + ["(SELECT COUNT(DISTINCT l_linestatus) FROM lineitem)"])


@register("clf_logistic_invariants", f"""
SELECT 3 * ({CLF_WIDTH_SQL}) AS n_weights, 3 * ({CLF_WIDTH_SQL}) AS n_small_gradients, TRUE AS shares_met
FROM lineitem LIMIT 1""")
def q_clf_logistic_invariants(spark, sf):
    """The softmax fit is at its optimum: the gradient of the penalised loss by every weight is at most a thousandth of its
    terms, and the mean probability of each class is its share of the train rows."""
    b = _multiclass(spark, sf, [MD.LOGISTIC])
    r = b.results[0]
    errors = [((F.col("label") == float(k)).cast("double") - vector_to_array("probability")[k]).alias(f"e{k}") for k in range(3)]
    sums, sizes, total, absolute, _ = _gradients(b, r, errors)
    weights = [w for row in r.model.coefficientMatrix.toArray() for w in row]
    small = sum(bool(abs(s - w) <= 1e-3 * a + 1e-9) for s, a, w in zip(sums, sizes, weights, strict=True))
    met = all(abs(t) <= 1e-3 * a for t, a in zip(total, absolute, strict=True))
    b.release()
    return spark.createDataFrame([(len(sums), small, met)], "n_weights long, n_small_gradients long, shares_met boolean")


@register("pca_2d_invariants", """
SELECT COUNT(*) AS n, TRUE AS centred, TRUE AS uncorrelated, TRUE AS falling, TRUE AS shares_met FROM customer""")
def q_pca_2d_invariants(spark, sf):
    """The projection of ``pca_2d``: centred and uncorrelated coordinates of falling variance, whose shares of the whole
    variance are the explained ones."""
    vec, _, _ = C.prepare_vectors(table(spark, sf, "customer"), CUST_FEATURES)
    points, shares = C.pca_2d(vec)
    x = vec.select(vector_to_array("features").alias("x"))
    d = x.select(F.size("x").alias("d")).first()["d"]
    whole = sum(x.agg(F.array(*[F.var_pop(F.col("x")[j]) for j in range(d)]).alias("v")).first()["v"])
    r = points.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}{c}") for c in ("pca1", "pca2") for n, f in (("m", F.avg), ("v", F.var_pop))],
                   F.covar_pop("pca1", "pca2").alias("c")).first()
    v1, v2 = r["vpca1"], r["vpca2"]
    met = all(abs(v / whole - s) < 1e-6 for v, s in zip((v1, v2), shares, strict=True))
    return spark.createDataFrame([(r["n"], max(abs(r["mpca1"]), abs(r["mpca2"])) < 1e-9, abs(r["c"]) < 1e-9 * (v1 + v2) + 1e-12, v1 >= v2, met)],
                                 "n long, centred boolean, uncorrelated boolean, falling boolean, shares_met boolean")
