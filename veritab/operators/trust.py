"""Rule-based trust checks. All measurements (counts, missing shares, correlations, class and cluster
sizes, cardinalities) are Spark aggregates; only their small results are turned into log lines."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import messages as T
from ..functions import rules as R
from ..functions.stats import distinct_counts, guarded_corr
from ..functions.types import as_text, dtypes, is_numeric_or_bool, normalise, qc
from .eda import correlation_pairs

LOG_SCHEMA = ("check_order int, seq int, status string, check_name string, subject string, value double, "
              "message string, details string")

SAMPLE, MISSING, TARGET_MISSING, LEAKAGE, SUSPICIOUS, IMBALANCE, COLLINEAR, OVERFIT, CARDINALITY, \
    SILHOUETTE, CLUSTER_SIZES = range(1, 12)


@dataclass
class Measurements:
    n: int
    missing_pct: dict[str, float] = field(default_factory=dict)
    target_missing: int = 0
    target_corr: dict[str, float | None] = field(default_factory=dict)
    class_counts: list[tuple[object, int]] = field(default_factory=list)
    pairs: list[tuple[int, int, float | None]] = field(default_factory=list)
    cardinality: dict[str, int] = field(default_factory=dict)
    cluster_sizes: list[tuple[object, int]] = field(default_factory=list)
    n_classes: int = 0


def measure(df: DataFrame, target: str | None, features: list[str], task: str,
            clusters: DataFrame | None = None, cluster_col: str = "prediction") -> Measurements:
    """All data-dependent inputs of the checks, each as one aggregate over the table."""
    data = normalise(df)
    types = dtypes(data)
    numeric = [c for c in features if is_numeric_or_bool(types[c])]
    supervised = task in ("Classification", "Regression") and target is not None
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.count(qc(c)).alias(f"nn{i}") for i, c in enumerate(features)]
    if supervised:
        aggs.append(F.count(qc(target)).alias("tnn"))
        if is_numeric_or_bool(types[target]):
            aggs += [guarded_corr(qc(c), qc(target)).alias(f"tc{i}") for i, c in enumerate(features) if c in numeric]
    row = data.agg(*aggs).first()
    n = int(row["n"])
    m = Measurements(n=n)
    for i, c in enumerate(features):
        m.missing_pct[c] = (n - row[f"nn{i}"]) / n * 100 if n else float("nan")
    if supervised:
        m.target_missing = n - int(row["tnn"])
        if is_numeric_or_bool(types[target]):
            m.target_corr = {c: row[f"tc{i}"] for i, c in enumerate(features) if c in numeric}
    if task == "Classification" and target is not None:
        # class counts stay distributed (a target may have many classes): only the number of classes,
        # the largest and smallest counts and the majority class (ties -> smallest text) come back
        cc = data.where(qc(target).isNotNull()).groupBy(as_text(target, types[target]).alias("v")) \
            .agg(F.count(F.lit(1)).alias("c"))
        s = cc.agg(F.count(F.lit(1)).alias("k"), F.min(F.struct((-F.col("c")).alias("c"), "v")).alias("top"),
                   F.min("c").alias("mn")).first()
        m.n_classes = int(s["k"])
        if m.n_classes:
            m.class_counts = [(s["top"]["v"], -int(s["top"]["c"])), (None, int(s["mn"]))]
    if len(numeric) > 1:
        m.pairs = [(r["i"], r["j"], r["r"]) for r in correlation_pairs(data, numeric).collect()]
    nonnum = [c for c in features if c not in numeric]
    if nonnum:
        cnt = {int(r["ordinal"]): int(r["distinct"]) for r in distinct_counts(data.select(*[qc(c) for c in nonnum])).collect()}
        m.cardinality = {c: cnt.get(i, 0) for i, c in enumerate(nonnum)}
    if clusters is not None:
        cs = clusters.groupBy(qc(cluster_col).alias("c")).agg(F.count(F.lit(1)).alias("k")).collect()
        m.cluster_sizes = sorted(((r["c"], int(r["k"])) for r in cs), key=lambda t: t[0])
    return m


def _row(order, status, spec, subject=None, value=None, **fmt):
    name, msg, det = spec
    return [order, status, name, subject, None if value is None else float(value), msg.format(**fmt), det.format(**fmt)]


def build_log(m: Measurements, target: str | None, features: list[str], numeric: list[str], task: str,
              train_score: float | None = None, test_score: float | None = None,
              best_metrics: dict | None = None, with_clusters: bool = False) -> list[list]:
    rows = []
    supervised = task in ("Classification", "Regression") and target is not None
    # 1. sample size
    if m.n < R.SMALL_SAMPLE_ROWS:
        rows.append(_row(SAMPLE, T.WARNING, T.SMALL_SAMPLE, value=m.n, n=m.n))
    else:
        rows.append(_row(SAMPLE, T.INFO, T.SAMPLE_OK, value=m.n, n=m.n))
    # 2. missing features
    crit = [c for c in features if m.missing_pct[c] > R.MISSING_CRIT_PCT]
    high = [c for c in features if m.missing_pct[c] > R.MISSING_WARN_PCT]
    if crit:
        rows.append(_row(MISSING, T.CRITICAL, T.EXTREME_MISSING, value=len(crit), cols=str(crit)))
    elif high:
        rows.append(_row(MISSING, T.WARNING, T.HIGH_MISSING, value=len(high), cols=str(high)))
    else:
        rows.append(_row(MISSING, T.INFO, T.MISSING_OK, value=0))
    # 2b. missing target
    if supervised and m.target_missing > 0:
        rows.append(_row(TARGET_MISSING, T.WARNING, T.TARGET_MISSING, subject=target, value=m.target_missing,
                         target=target, count=m.target_missing, pct=m.target_missing / m.n * 100))
    # 3. leakage, then a suspicious score when no leakage was found
    if supervised:
        leak = False
        for c in features:
            r = m.target_corr.get(c)
            if r is not None and abs(r) > R.LEAKAGE_ABS_R:
                rows.append(_row(LEAKAGE, T.CRITICAL, T.LEAKAGE, subject=c, value=r, col=c, r=r, target=target))
                leak = True
        if not leak and test_score is not None and test_score > R.SUSPICIOUS_SCORE:
            rows.append(_row(SUSPICIOUS, T.WARNING, T.SUSPICIOUS, value=test_score, score=test_score))
    # 4. class imbalance
    if task == "Classification" and target is not None and m.n_classes >= 2:
        majority, maj_n = m.class_counts[0]
        min_n = m.class_counts[-1][1]
        ratio = maj_n / min_n
        pct = min_n / m.n * 100
        spec = T.SEVERE_IMBALANCE if pct < R.IMBALANCE_CRIT_PCT else (
            T.MODERATE_IMBALANCE if pct < R.IMBALANCE_WARN_PCT else T.BALANCED)
        status = T.CRITICAL if pct < R.IMBALANCE_CRIT_PCT else (T.WARNING if pct < R.IMBALANCE_WARN_PCT else T.INFO)
        rows.append(_row(IMBALANCE, status, spec, value=pct, pct=pct, ratio=ratio, majority=majority))
    # 5. multicollinearity: upper triangle, column by column
    hits = sorted(((j, i, abs(r)) for i, j, r in m.pairs if r is not None and abs(r) > R.COLLINEAR_ABS_R))
    if hits:
        pairs = T.COLLINEAR_PAIRS + ", ".join(T.COLLINEAR_PAIR.format(a=numeric[i], b=numeric[j], r=v) for j, i, v in hits)
        rows.append(_row(COLLINEAR, T.WARNING, T.COLLINEAR, value=len(hits), count=len(hits), pairs=pairs))
    else:
        rows.append(_row(COLLINEAR, T.INFO, T.COLLINEAR_OK, value=0))
    # 6. overfitting
    if supervised and train_score is not None and test_score is not None:
        gap = train_score - test_score
        metric = "F1-Score" if task == "Classification" else "R²"
        spec, status = (T.OVERFIT, T.WARNING) if gap > R.OVERFIT_GAP else (T.GENERALIZES, T.INFO)
        rows.append(_row(OVERFIT, status, spec, value=gap, metric=metric, train=train_score, test=test_score, gap=gap))
    # 7. high-cardinality categoricals
    wide = [(c, m.cardinality[c]) for c in features if c in m.cardinality and m.cardinality[c] > R.HIGH_CARDINALITY]
    if wide:
        items = ", ".join(T.HIGH_CARDINALITY_ITEM.format(col=c, card=k) for c, k in wide)
        rows.append(_row(CARDINALITY, T.WARNING, T.HIGH_CARDINALITY, value=len(wide), items=items))
    # 8. clustering
    if task == "Clustering" and best_metrics is not None:
        s = best_metrics.get("Silhouette Score")
        if s is not None:
            if s < R.SILHOUETTE_WEAK:
                rows.append(_row(SILHOUETTE, T.WARNING, T.WEAK_CLUSTERS, value=s, s=s))
            elif s >= R.SILHOUETTE_STRONG:
                rows.append(_row(SILHOUETTE, T.INFO, T.STRONG_CLUSTERS, value=s, s=s))
            else:
                rows.append(_row(SILHOUETTE, T.INFO, T.MODERATE_CLUSTERS, value=s, s=s))
        if with_clusters:
            for c, size in m.cluster_sizes:
                pct = size / m.n * 100
                if pct < R.CLUSTER_SMALL_PCT:
                    rows.append(_row(CLUSTER_SIZES, T.WARNING, T.SMALL_CLUSTER, subject=str(c), value=pct, c=c, size=size, pct=pct))
                elif pct > R.CLUSTER_DOMINANT_PCT:
                    rows.append(_row(CLUSTER_SIZES, T.WARNING, T.DOMINANT_CLUSTER, subject=str(c), value=pct, c=c, size=size, pct=pct))
    return [[r[0], k] + r[1:] for k, r in enumerate(rows)]


def run_checks(df: DataFrame, target: str | None, features: list[str], task: str,
               train_score: float | None = None, test_score: float | None = None,
               best_metrics: dict | None = None, clusters: DataFrame | None = None,
               cluster_col: str = "prediction") -> DataFrame:
    """The trust log as a DataFrame (one row per finding, in check order)."""
    types = dtypes(df)
    numeric = [c for c in features if is_numeric_or_bool(types[c])]
    m = measure(df, target, features, task, clusters, cluster_col)
    rows = build_log(m, target, features, numeric, task, train_score, test_score, best_metrics,
                     with_clusters=clusters is not None)
    return df.sparkSession.createDataFrame(rows, LOG_SCHEMA)


def trust_summary(log: DataFrame) -> DataFrame:
    """Counts by severity and the headline: critical, else warning, else clean."""
    agg = log.agg(
        F.sum(F.when(F.col("status") == T.CRITICAL, 1).otherwise(0)).cast("long").alias("n_critical"),
        F.sum(F.when(F.col("status") == T.WARNING, 1).otherwise(0)).cast("long").alias("n_warning"),
        F.sum(F.when(F.col("status") == T.INFO, 1).otherwise(0)).cast("long").alias("n_info"))
    return agg.withColumn("headline", F.when(F.col("n_critical") > 0, F.lit("critical"))
                          .when(F.col("n_warning") > 0, F.lit("warning")).otherwise(F.lit("clean")))
