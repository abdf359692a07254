"""Baseline supervised models on MLlib: three classifiers or three regressors fitted on the train split,
scored on the test split; metrics, champion, train score and feature importances."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..session import collect_garbage
from . import metrics as M
from .boosting import SoftmaxBoosting
from .cells import CellBoosting, CellForest
from .prep import BUCKET_ROWS, Prepared

LOGISTIC, FOREST, BOOSTING, RIDGE = "Logistic Regression", "Random Forest", "Gradient Boosting", "Ridge Regression"
FOREST_TREES = 100
FOREST_MAX_DEPTH = 30      # trees grow to purity, as far as Spark lets them; callers may pass less
BOOST_ROUNDS = 100
BOOST_STEP = 0.1
BOOST_MAX_DEPTH = 5        # about 31 leaves, like the 31-leaf histogram boosting default


def classifiers(n_train: int, n_classes: int, forest_depth: int = FOREST_MAX_DEPTH):
    lr = LogisticRegression(maxIter=1000, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                            standardization=False, tol=1e-4)
    rf = RandomForestClassifier(numTrees=FOREST_TREES, maxDepth=forest_depth, featureSubsetStrategy="sqrt",
                                seed=R.SEED, maxMemoryInMB=1024, cacheNodeIds=True)
    boost = SoftmaxBoosting(n_classes, BOOST_ROUNDS, BOOST_MAX_DEPTH, BOOST_STEP)
    # MLlib keeps a weight and a node of each row for each tree, which outgrows the disk
    forest = CellForest(rf, max(n_classes, 2), "sqrt") if n_train > BUCKET_ROWS else rf
    return [(LOGISTIC, lr), (FOREST, forest), (BOOSTING, boost)]


def regressors(n_train: int, label_std: float, forest_depth: int = FOREST_MAX_DEPTH):
    # alpha = 1 ridge on the summed loss == regParam std(y)/n with Spark's normal-equation solver
    ridge = LinearRegression(regParam=(label_std or 0.0) / max(n_train, 1), elasticNetParam=0.0,
                             standardization=False, solver="normal")
    rf = RandomForestRegressor(numTrees=FOREST_TREES, maxDepth=forest_depth, featureSubsetStrategy="all",
                               seed=R.SEED, maxMemoryInMB=1024, cacheNodeIds=True)
    # one shallow tree at a time: walking it costs a level less than caching the node of every row; the trees are the same
    gbt = GBTRegressor(maxIter=BOOST_ROUNDS, stepSize=BOOST_STEP, maxDepth=BOOST_MAX_DEPTH, seed=R.SEED,
                       cacheNodeIds=False)
    if n_train > BUCKET_ROWS:
        binned: dict = {}                                  # both go over the same rows
        return [(RIDGE, ridge), (FOREST, CellForest(rf, binned=binned)), (BOOSTING, CellBoosting(gbt, binned))]
    return [(RIDGE, ridge), (FOREST, rf), (BOOSTING, gbt)]


@dataclass
class ModelResult:
    order: int
    name: str
    model: object
    predictions: DataFrame         # test rows: _rid, label, prediction (+ scores)
    metrics: DataFrame             # (metric, value)


@dataclass
class Baselines:
    prepared: Prepared
    results: list[ModelResult] = field(default_factory=list)
    train: DataFrame | None = None
    test: DataFrame | None = None
    binary: bool = False

    def metrics(self) -> DataFrame:
        out = None
        for r in self.results:
            m = r.metrics.select(F.lit(r.order).alias("model_order"), F.lit(r.name).alias("model"), "metric", "value")
            out = m if out is None else out.unionByName(m)
        return out

    def release(self) -> None:
        """Drop the cached train vectors once the models are fitted and scored."""
        if self.train is not None:
            self.train.unpersist()

    def champion(self) -> ModelResult:
        row = M.champion(self.metrics(), self.prepared.task).first()
        return self.results[row["model_order"]]


def _score_columns(pred: DataFrame, n_classes: int) -> DataFrame:
    """Per-class probabilities as an array."""
    return pred if "scores" in pred.columns else pred.withColumn("scores", vector_to_array(F.col("probability")))


def _auc(pred: DataFrame, n_classes: int, test_classes: int) -> DataFrame:
    """Binary: AUC of the positive (greater) class score. Multi-class: one-vs-rest AUC per class weighted
    by test support; 0.0 when a class is missing from the test split (as the reference's fallback)."""
    if test_classes != n_classes or n_classes < 2:
        return pred.sparkSession.createDataFrame([(M.ROC_AUC, 0.0)], "metric string, value double")
    if n_classes == 2:
        a = M.roc_auc(pred, F.col("label") == 1.0, F.col("scores")[1])
        return a.select(F.lit(M.ROC_AUC).alias("metric"), F.coalesce("auc", F.lit(0.0)).alias("value"))
    long = pred.select("label", F.posexplode("scores").alias("cls", "score"))
    per = M.roc_auc(long, F.col("label") == F.col("cls").cast("double"), F.col("score"), by=["cls"])
    sup = pred.groupBy(F.col("label").cast("int").alias("cls")).agg(F.count(F.lit(1)).alias("support"))
    w = per.join(sup, "cls").agg((F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("v"))
    return w.select(F.lit(M.ROC_AUC).alias("metric"), F.coalesce("v", F.lit(0.0)).alias("value"))


def train_baselines(prep: Prepared, only: list[str] | None = None,
                    forest_depth: int = FOREST_MAX_DEPTH) -> Baselines:
    """Fit each baseline on the train vectors (cached: the models iterate over them) and score the test
    split. The vector frame is checkpointed once, so models never recompute the preprocessing."""
    large = prep.n_train > BUCKET_ROWS
    spark = prep.data.sparkSession
    if large:
        collect_garbage(spark)                             # the rows as they were dealt for the split
    vec = prep.vectors().checkpoint()
    prep.release()
    train = vec.where(F.col("_split") == "train").persist()
    test = vec.where(F.col("_split") == "test")
    out = Baselines(prepared=prep, train=train, test=test)
    if prep.task == "Classification":
        n_classes = prep.n_classes
        train_classes = train.select("label").distinct().count()
        test_classes = test.select("label").distinct().count()
        out.binary = train_classes == 2
        models = classifiers(prep.n_train, n_classes, forest_depth)
    else:
        label_std = train.agg(F.stddev_pop("label")).first()[0]
        models = regressors(prep.n_train, label_std, forest_depth)
    for order, (name, est) in enumerate(models):
        if only and name not in only:
            continue
        if large:
            collect_garbage(spark)                         # what the vectors or the model before have moved
        model = est.fit(train)
        pred = model.transform(test)
        if prep.task == "Classification":
            pred = _score_columns(pred, n_classes)
            if large:                                      # the metrics go over the scores several times
                pred = pred.select("_rid", "label", "prediction", "scores").persist()
            met = M.classification_metrics(pred, "label", "prediction", binary=out.binary,
                                           positive=float(n_classes - 1))
            met = met.unionByName(_auc(pred, n_classes, test_classes))
            if large:
                pred.unpersist()
            pred = pred.select("_rid", "label", "prediction", "scores")
        else:
            met = M.regression_metrics(pred, "label", "prediction")
            pred = pred.select("_rid", "label", "prediction")
        out.results.append(ModelResult(order, name, model, pred, met))
    return out


def train_score(b: Baselines, result: ModelResult) -> float:
    """F1-Score (classification) or R² (regression) of a fitted model on its own train split."""
    pred = result.model.transform(b.train)
    if b.prepared.task == "Classification":
        n_classes = b.prepared.n_classes
        m = M.classification_metrics(pred, "label", "prediction", binary=b.binary, positive=float(n_classes - 1))
        return m.where(F.col("metric") == M.F1).first()["value"]
    m = M.regression_metrics(pred, "label", "prediction")
    return m.where(F.col("metric") == M.R2).first()["value"]


def feature_importance(b: Baselines, result: ModelResult) -> DataFrame | None:
    """(feature, importance) sorted desc: tree importances, or mean |coefficient| over classes."""
    import numpy as np
    model = result.model
    names = b.prepared.feature_names
    imp = None
    if hasattr(model, "featureImportances"):
        imp = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        imp = np.mean(np.abs(model.coefficientMatrix.toArray()), axis=0)
    elif hasattr(model, "coefficients"):
        imp = np.abs(model.coefficients.toArray())
    if imp is None or len(imp) != len(names):
        return None
    spark = b.prepared.data.sparkSession
    rows = [(n, float(v)) for n, v in zip(names, imp)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")
