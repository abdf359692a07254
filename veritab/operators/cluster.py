"""Clustering baselines on MLlib (K-Means, Gaussian mixture) with internal quality indices computed as
aggregates, cluster profiles, a 2-D PCA projection and the K sweep."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.stats import distinct_counts, spread
from ..functions.types import as_text, dtypes, is_numeric_or_bool, normalise, qc
from ..session import ensure_checkpoint_dir, ship_sources
from .prep import feature_kinds, fit_preprocessing, valid_features

KMEANS, GMM = "K-Means", "Gaussian Mixture Model"
SQUARED_SILHOUETTE = "Silhouette Score (squared Euclidean)"
SILHOUETTE, DAVIES_BOULDIN, CALINSKI_HARABASZ = "Silhouette Score", "Davies-Bouldin Index", "Calinski-Harabasz Index"
#: Rows from which first centres are drawn, and tasks whose sums go to the driver without being added up in Spark.
SEED_ROWS, FEW_TASKS = 10_000, 64
#: Anchors of the plain silhouette, and the parts of them that show its error.
ANCHORS, ANCHOR_GROUPS = 4096, 8
INERTIA, BIC = "Inertia (Within Cluster Sum)", "BIC (Bayesian Info Criterion)"


@dataclass
class ClusterResult:
    order: int
    name: str
    model: object
    predictions: DataFrame          # _rid, _row (the input row as a struct), features, prediction
    metrics: dict[str, float] = field(default_factory=dict)


@dataclass
class Clustering:
    vectors: DataFrame              # _rid, _row, features (checkpointed)
    features: list[str]
    feature_names: list[str]
    results: list[ClusterResult] = field(default_factory=list)

    def metrics(self) -> DataFrame:
        spark = self.vectors.sparkSession
        rows = [(r.order, r.name, k, float(v)) for r in self.results for k, v in r.metrics.items()]
        return spark.createDataFrame(rows, "model_order int, model string, metric string, value double")

    def labelled(self, result: ClusterResult, label: str = "prediction") -> DataFrame:
        """The input rows with the fitted cluster of each."""
        return result.predictions.select("_row.*", F.col("prediction").alias(label))

    def profile(self, result: ClusterResult) -> DataFrame:
        """Profile of the clusters just fitted."""
        return cluster_profile(self.labelled(result, "_cluster"), self.features, "_cluster")

    def release(self) -> None:
        """Drop the cached vectors (their checkpoint stays as the lineage root)."""
        self.vectors.unpersist()

    def best(self) -> ClusterResult:
        """Highest silhouette; the earlier model wins ties."""
        return max(self.results, key=lambda r: (r.metrics.get(SILHOUETTE, -1.0), -r.order))


def prepare_vectors(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    """Valid features over the whole table, kinds and preprocessing fitted on the whole table."""
    ensure_checkpoint_dir(df.sparkSession)
    feats = valid_features(df, features)
    base = normalise(df)
    base = base.select(F.struct(*[qc(c) for c in base.columns]).alias("_row"), *[qc(c) for c in feats],
                       F.monotonically_increasing_id().alias("_rid"))
    kinds = {r["column_name"]: r["kind"] for r in feature_kinds(base, feats).collect()}
    model, names = fit_preprocessing(base, feats, kinds)
    vec = spread(model.transform(base).select("_rid", "_row", "features"), base.count(), "_rid").checkpoint()
    return vec, feats, names


def quality_indices(pred: DataFrame, k_expected: int | None = None) -> dict[str, float]:
    """Silhouette, Davies-Bouldin and Calinski-Harabasz, and Spark's squared-Euclidean silhouette under its own name.

    The silhouette is the centroid form in plain Euclidean distance: a row's distance to its own centroid against that
    to the nearest other one, exact in O(n k). Per-cluster centroids are k small vectors."""
    cents = (pred.groupBy("prediction").agg(Summarizer.mean(F.col("features")).alias("c"), F.count(F.lit(1)).alias("n"))
             .collect())
    k = len(cents)
    if k <= 1:
        return {SILHOUETTE: 0.0, SQUARED_SILHOUETTE: 0.0, DAVIES_BOULDIN: 0.0, CALINSKI_HARABASZ: 0.0}
    sil = ClusteringEvaluator(featuresCol="features", predictionCol="prediction",
                              distanceMeasure="squaredEuclidean").evaluate(pred)
    cmap = F.create_map(*[x for r in cents for x in (F.lit(r["prediction"]),
                                                     F.array(*[F.lit(float(v)) for v in r["c"].toArray()]))])
    sq = F.aggregate(F.zip_with(vector_to_array("features"), F.element_at(cmap, F.col("prediction")),
                                lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)
    d = pred.select("prediction", sq.alias("sq"))
    plain = centroid_silhouette(pred, cents)
    per = {r["prediction"]: (r["s"], r["w"]) for r in
           d.groupBy("prediction").agg(F.avg(F.sqrt("sq")).alias("s"), F.sum("sq").alias("w")).collect()}
    C = np.array([r["c"].toArray() for r in cents])
    ns = np.array([r["n"] for r in cents], dtype=float)
    S = np.array([per[r["prediction"]][0] for r in cents])
    W = sum(per[r["prediction"]][1] for r in cents)
    n = ns.sum()
    dist = np.sqrt(((C[:, None, :] - C[None, :, :]) ** 2).sum(-1))
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = (S[:, None] + S[None, :]) / np.where(dist == 0, np.inf, dist)
    np.fill_diagonal(ratio, -np.inf)
    db = float(np.mean(ratio.max(axis=1)))
    mean = (ns[:, None] * C).sum(0) / n
    B = float((ns * ((C - mean) ** 2).sum(1)).sum())
    ch = 1.0 if W == 0 else B * (n - k) / (W * (k - 1.0))
    return {SILHOUETTE: plain, SQUARED_SILHOUETTE: float(sil), DAVIES_BOULDIN: db, CALINSKI_HARABASZ: float(ch)}


def centroid_silhouette(pred: DataFrame, cents: list | None = None) -> float:
    """Mean of (b - a) / max(a, b): a the distance to the own centroid, b that to the nearest other one; 0 if both are 0."""
    if cents is None:
        cents = pred.groupBy("prediction").agg(Summarizer.mean(F.col("features")).alias("c")).collect()
    if len(cents) <= 1:
        return 0.0
    every = F.array(*[F.struct(F.lit(r["prediction"]).alias("k"),
                               F.array(*[F.lit(float(v)) for v in r["c"].toArray()]).alias("c")) for r in cents])
    far = F.transform(every, lambda e: F.struct(e["k"].alias("k"), F.sqrt(F.aggregate(
        F.zip_with(F.col("x"), e["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)).alias("d")))
    d = pred.select("prediction", vector_to_array("features").alias("x")).select("prediction", far.alias("far"))
    a = F.filter("far", lambda e: e["k"] == F.col("prediction"))[0]["d"]
    b = F.array_min(F.transform(F.filter("far", lambda e: e["k"] != F.col("prediction")), lambda e: e["d"]))
    row = d.select(a.alias("a"), b.alias("b")).agg(
        F.avg(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))).first()
    return float(row[0])


def train_clustering(df: DataFrame, features: list[str], k: int = 3, seed: int = R.SEED,
                     only: list[str] | None = None) -> Clustering:
    vec, feats, names = prepare_vectors(df, features)
    vec = vec.persist()
    out = Clustering(vectors=vec, features=feats, feature_names=names)
    if not only or KMEANS in only:
        km = KMeans(k=k, seed=seed, maxIter=300, tol=1e-4).fit(vec)
        kp = km.transform(vec).select("_rid", "_row", "features", "prediction")
        m = quality_indices(kp)
        m[INERTIA] = float(km.summary.trainingCost)
        out.results.append(ClusterResult(0, KMEANS, km, kp, m))
    if only and GMM not in only:
        return out
    gm = GaussianMixture(k=k, seed=seed, maxIter=100, tol=1e-3).fit(vec)
    gp = gm.transform(vec).select("_rid", "_row", "features", "prediction")
    m = quality_indices(gp)
    n = gm.summary.clusterSizes and sum(gm.summary.clusterSizes)
    d = len(vec.first()["features"]) if n else 0
    p = k * d + k * d * (d + 1) / 2 + k - 1
    m[BIC] = float(-2.0 * gm.summary.logLikelihood + p * math.log(n)) if n else float("nan")
    out.results.append(ClusterResult(1, GMM, gm, gp, m))
    return out


def best_clustering(metrics: DataFrame) -> DataFrame:
    return (metrics.where(F.col("metric") == SILHOUETTE)
            .orderBy(F.col("value").desc(), F.col("model_order").asc()).limit(1)
            .select("model_order", "model", F.col("value").alias("silhouette")))


def cluster_profile(df: DataFrame, features: list[str], cluster_col: str) -> DataFrame:
    """Per cluster ('Cluster <label>', sorted as text): rows, % of all rows (2 dp), the mean (2 dp) of
    numeric features with > 10 distinct values, else the most frequent value (smallest on ties, 'N/A')."""
    types = dtypes(df)
    df = normalise(df)
    lab = F.concat(F.lit("Cluster "), qc(cluster_col).cast("string")).alias("Cluster")
    base = df.select(lab, *[qc(c) for c in features])
    distinct = {}
    if features:
        sub = normalise(df.select(*[qc(c) for c in features]))
        got = {int(r["ordinal"]): int(r["distinct"]) for r in distinct_counts(sub).collect()}
        distinct = {c: got.get(i, 0) for i, c in enumerate(features)}
    total = F.sum("Size (Rows)").over(Window.partitionBy())
    sizes = base.groupBy("Cluster").agg(F.count(F.lit(1)).alias("Size (Rows)"))
    out = sizes
    mean_cols = [c for c in features if is_numeric_or_bool(types[c]) and distinct[c] > R.NUMERIC_FEATURE_MIN_DISTINCT]
    if mean_cols:
        means = base.groupBy("Cluster").agg(*[F.bround(F.avg(qc(c).cast("double")), 2).alias(f"{c} (Mean)")
                                              for c in mean_cols])
        out = out.join(means, "Cluster")
    for c in features:
        if c in mean_cols:
            continue
        vc = base.where(qc(c).isNotNull()).groupBy("Cluster", qc(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        salts = int(min(1 << 16, max(64, -(-distinct[c] // 1_000_000))))   # ~1M values per window partition
        w1 = Window.partitionBy("Cluster", F.pmod(F.xxhash64("v"), F.lit(salts))).orderBy(F.col("n").desc(), F.col("v").asc())
        w2 = Window.partitionBy("Cluster").orderBy(F.col("n").desc(), F.col("v").asc())
        top = (vc.withColumn("r1", F.row_number().over(w1)).where("r1 = 1")
               .withColumn("r2", F.row_number().over(w2)).where("r2 = 1")
               .select("Cluster", as_text("v", types[c]).alias(f"{c} (Top)")))
        out = out.join(top, "Cluster", "left").withColumn(f"{c} (Top)", F.coalesce(F.col(f"`{c} (Top)`"), F.lit("N/A")))
    out = out.withColumn("Percentage (%)", F.bround(F.col("`Size (Rows)`") / total * 100, 2))
    order = ["Cluster", "Size (Rows)", "Percentage (%)"] + [
        f"{c} (Mean)" if c in mean_cols else f"{c} (Top)" for c in features]
    return out.select(*[F.col(f"`{c}`") for c in order]).orderBy("Cluster")


def pca_2d(vectors: DataFrame, labels: DataFrame | None = None) -> tuple[DataFrame, list[float]]:
    """Centred 2-component PCA of the feature vectors (one column padded with zeros), with the
    explained-variance ratios. Spark's PCA does not centre, so the vectors are centred first."""
    first = vectors.select("features").first()
    d = len(first["features"]) if first else 0
    v = vectors
    if d < 2:
        v = VectorAssembler(inputCols=["features", "_pad"], outputCol="_f2").transform(v.withColumn("_pad", F.lit(0.0))) \
            .drop("features", "_pad").withColumnRenamed("_f2", "features")
    centred = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="_c").fit(v).transform(v)
    pca = PCA(k=2, inputCol="_c", outputCol="_pc").fit(centred)
    arr = vector_to_array("_pc")
    cols = ["_rid"] + (["prediction"] if "prediction" in vectors.columns else [])
    out = pca.transform(centred).select(*cols, arr[0].alias("pca1"), arr[1].alias("pca2"))
    return out, [float(x) for x in pca.explainedVariance.toArray()]


def pca_numeric(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[float]]:
    """The report's projection: PCA of the numeric features only, missing values replaced by medians, scaled."""
    types = dtypes(df)
    numeric = [c for c in valid_features(df, features) if is_numeric_or_bool(types[c])]
    base = normalise(df.select(*[qc(c) for c in numeric])).withColumn("_rid", F.monotonically_increasing_id())
    model, _ = fit_preprocessing(base, numeric, {c: "numeric" for c in numeric})
    return pca_2d(model.transform(base).select("_rid", "features"))


@dataclass
class PlainSilhouette:
    value: float
    error: float                    # standard error that comes from the anchors; 0 if they are all rows
    anchors: int


def plain_silhouette(pred: DataFrame, id_col: str = "_rid", anchors: int = ANCHORS, seed: int = R.SEED) -> PlainSilhouette:
    """Mean over all rows of (b - a) / max(a, b), a the mean distance to the other rows of the own cluster, b the least mean
    distance to the rows of another one; 0 for a row alone in its cluster.

    Mean distances are taken over anchors: of each cluster its rows of the smallest hashes of (seed, id), ``anchors`` in all
    at most, an equal share a cluster. With anchors for all rows the value is exact; else their error is estimated from
    ``ANCHOR_GROUPS`` values, each from its own part of the anchors. Every row is scored; one scan after the anchors are
    chosen, no pairs of rows leave a task. Ids have to differ between rows."""
    spark = pred.sparkSession
    ship_sources(spark)
    rows = pred.select(qc(id_col).cast("long").alias("id"), F.col("prediction").cast("int").alias("c"),
                       vector_to_array("features").alias("x"))
    sizes = {r["c"]: r["n"] for r in rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) <= 1:
        return PlainSilhouette(0.0, 0.0, 0)
    each = max(2, anchors // len(sizes))
    salted = rows.withColumn("h", F.xxhash64(F.lit(seed), "id")).withColumn("salt", F.pmod("h", F.lit(64)))
    for keys in (("c", "salt"), ("c",)):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("h", "id"))
        salted = salted.withColumn("place", place).where(F.col("place") <= each)
    held = salted.select("id", "c", "x", "place").collect()
    names = sorted(sizes)
    number = {c: i for i, c in enumerate(names)}
    x0 = np.array([r["x"] for r in held], float)
    c0 = np.array([number[r["c"]] for r in held])
    ids = np.array([r["id"] for r in held])
    part = np.array([r["place"] % ANCHOR_GROUPS for r in held])
    whole = len(held) == sum(sizes.values())
    share = spark.sparkContext.broadcast((x0, c0, ids, part))
    k = len(names)

    def scores(d, own, mine, use):
        member = np.eye(k)[c0_of(use)]
        total, n = d[:, use] @ member, member.sum(axis=0)[None, :].repeat(len(d), axis=0)
        at = np.arange(len(d))
        n[at, own] -= mine[:, use].any(axis=1)         # a row is no neighbour of its own; its distance to itself is 0
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(n > 0, total / n, np.inf)
        a = mean[at, own].copy()
        mean[at, own] = np.inf
        b = mean.min(axis=1)
        top = np.maximum(a, b)
        ok = np.isfinite(a) & np.isfinite(b) & (top > 0)
        return np.divide(b - a, top, out=np.zeros(len(d)), where=ok).sum()

    def c0_of(use):
        return share.value[1][use]

    def run(batches):
        x0, _, ids, part = share.value
        uses = [np.arange(len(x0))] + [np.flatnonzero(part == g) for g in range(ANCHOR_GROUPS)]
        total = np.zeros(1 + len(uses))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                x = _matrix(some)
                own = np.array([number[c] for c in some.column("c").to_pylist()])
                mine = some.column("id").to_numpy(zero_copy_only=False)[:, None] == ids[None, :]
                d = np.sqrt(_distances(x, x0))
                d[mine] = 0.0
                total += [len(x), *(scores(d, own, mine, use) for use in uses)]
        yield _sums_batch({0: total})
    found = _summed(rows, run, 0)[0]
    value, parts = found[1] / found[0], found[2:] / found[0]
    error = 0.0 if whole else float(parts.std(ddof=1) / math.sqrt(ANCHOR_GROUPS))
    return PlainSilhouette(float(value), error, len(held))


def first_centres(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """Up to k seeds by k-means++ from at most SEED_ROWS rows (those of the smallest hashes): each next one is drawn in
    proportion to the squared distance from those before, so the first few of them serve a smaller k as well."""
    rows = vectors.select(F.xxhash64(F.lit(seed), "features").alias("h"), "features").orderBy("h").limit(SEED_ROWS).collect()
    x = np.array([r["features"].toArray() for r in rows])
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    far = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k and far.sum() > 0:
        chosen.append(int(rng.choice(len(x), p=far / far.sum())))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """[rows, centres] squared distances."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :], 0.0)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _summed(rows: DataFrame, run, tasks: int) -> dict[int, np.ndarray]:
    """(slot: sums) of the arrays that the tasks yield; those of many tasks are added up in Spark first."""
    parts = rows.mapInArrow(run, "slot int, sums array<double>")
    if tasks > FEW_TASKS:
        parts = parts.select("slot", F.posexplode("sums")).groupBy("slot", "pos").agg(F.sum("col").alias("v"))
        parts = parts.groupBy("slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda e: e["v"]).alias("sums"))
    out: dict[int, np.ndarray] = {}
    for r in parts.collect():
        out[r["slot"]] = out.get(r["slot"], 0) + np.array(r["sums"])
    return out


def _sums_batch(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([list(v) for v in sums.values()], pa.list_(pa.float64()))],
                                      names=["slot", "sums"])


def lloyd_step(rows: DataFrame, sets: list[np.ndarray], tasks: int) -> list[np.ndarray]:
    """For each set of centres, [centres, 1 + d]: the number and the sum of the rows nearest to each centre; one scan."""
    share = rows.sparkSession.sparkContext.broadcast(sets)
    starts = np.cumsum([0, *map(len, sets)])

    def run(batches):
        sets, total = share.value, {}
        for batch in batches:
            x = _matrix(batch)
            one = np.hstack([np.ones((len(x), 1)), x])
            for first, centres in zip(starts.tolist(), sets, strict=False):
                mine = _distances(x, centres).argmin(axis=1)
                for c in range(len(centres)):
                    total[first + c] = total.get(first + c, 0) + one[mine == c].sum(axis=0)
        yield _sums_batch(total)
    found = _summed(rows, run, tasks)
    return [np.array([found[first + c] if first + c in found else np.zeros(1 + s.shape[1]) for c in range(len(s))])
            for first, s in zip(starts.tolist(), sets, strict=False)]


def lloyd_together(rows: DataFrame, sets: list[np.ndarray], tasks: int, max_iter: int = 300, tol: float = 1e-4) -> list[np.ndarray]:
    """Lloyd's algorithm on all sets of centres side by side: one scan an iteration for all that still move; a set whose
    centres have moved by ``tol`` at most is frozen. An empty cluster keeps its centre."""
    sets, moving = list(sets), list(range(len(sets)))
    for _ in range(max_iter):
        sums = lloyd_step(rows, [sets[i] for i in moving], tasks)
        still = []
        for i, s in zip(moving, sums, strict=True):
            new = np.where(s[:, :1] > 0, s[:, 1:] / np.maximum(s[:, :1], 1), sets[i])
            if ((new - sets[i]) ** 2).sum(axis=1).max() > tol ** 2:
                still.append(i)
            sets[i] = new
        moving = still
        if not moving:
            break
    return sets


def silhouettes_together(rows: DataFrame, sets: list[np.ndarray], tasks: int) -> list[float]:
    """The centroid silhouette of each set of centres: rows go to their nearest centre, distances to the means of the rows
    of a centre; two scans for all sets."""
    sums = lloyd_step(rows, sets, tasks)
    means = [np.where(s[:, :1] > 0, s[:, 1:] / np.maximum(s[:, :1], 1), np.inf) for s in sums]
    share = rows.sparkSession.sparkContext.broadcast((sets, means))

    def run(batches):
        sets, means = share.value
        total: dict = {}
        for batch in batches:
            x = _matrix(batch)
            at = np.arange(len(x))
            for i, (centres, mean) in enumerate(zip(sets, means, strict=True)):
                there = np.isfinite(mean[:, 0])
                if there.sum() < 2:
                    continue
                mine = _distances(x, centres).argmin(axis=1)
                d = np.full((len(x), len(mean)), np.inf)
                d[:, there] = np.sqrt(((x[:, None, :] - mean[there][None, :, :]) ** 2).sum(axis=2))
                a = d[at, mine].copy()
                d[at, mine] = np.inf
                b = d.min(axis=1)
                top = np.maximum(a, b)
                s = np.divide(b - a, top, out=np.zeros(len(x)), where=top > 0)
                total[i] = total.get(i, 0) + np.array([len(x), s.sum()])
        yield _sums_batch(total)
    found = _summed(rows, run, tasks)
    return [float(found[i][1] / found[i][0]) if i in found else 0.0 for i in range(len(sets))]


def k_sweep(vectors: DataFrame, k_max: int = 8, seed: int = R.SEED) -> DataFrame:
    """Silhouette for K = 2 .. min(8, n-1) when at least two K values exist. All K are fitted side by side: as many scans as
    the slowest K needs, over the vectors alone."""
    spark = vectors.sparkSession
    ship_sources(spark)
    rows = vectors.select(vector_to_array("features").alias("x")).persist()
    n = rows.count()
    ks = list(range(2, min(k_max + 1, n)))
    if len(ks) < 2:
        rows.unpersist()
        return spark.createDataFrame([], "k int, silhouette double")
    tasks = rows.rdd.getNumPartitions()
    seeds = first_centres(vectors, ks[-1], seed)
    sets = lloyd_together(rows, [seeds[:k] for k in ks], tasks)
    found = silhouettes_together(rows, sets, tasks)
    rows.unpersist()
    return spark.createDataFrame(list(zip(ks, found, strict=True)), "k int, silhouette double")
