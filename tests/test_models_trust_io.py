import os
import tempfile

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from veritab.functions import messages as T
from veritab.operators import cluster as C
from veritab.operators import models as MD
from veritab.operators import prep as PR
from veritab.operators import trust as TR
from veritab.sources import readers as RD
from veritab.sources import sinks as SK


def test_ml_pipeline_classification(spark, class_150):
    prep = PR.prepare(class_150, "churn", ["age", "income", "region", "occupation"], "Classification")
    assert (prep.n_train, prep.n_test) == (120, 30)
    b = MD.train_baselines(prep)
    names = [r.name for r in b.results]
    assert names == ["Logistic Regression", "Random Forest", "Gradient Boosting"]
    met = b.metrics().toPandas()
    assert set(met["metric"]) == {"Accuracy", "Precision", "Recall", "F1-Score", "ROC-AUC"}
    assert met["value"].between(0, 1).all()
    champ = b.champion()
    imp = MD.feature_importance(b, champ)
    assert imp is not None and set(imp.columns) == {"feature", "importance"}
    ts = MD.train_score(b, champ)
    assert 0.0 <= ts <= 1.0


def test_ml_pipeline_regression(spark, reg_150):
    prep = PR.prepare(reg_150, "sales", ["marketing_spend", "sales_rep"], "Regression")
    assert (prep.n_train, prep.n_test) == (120, 30)
    b = MD.train_baselines(prep, only=["Ridge Regression", "Random Forest"])
    assert [r.name for r in b.results] == ["Ridge Regression", "Random Forest"]
    met = {(r["model"], r["metric"]): r["value"] for r in b.metrics().collect()}
    assert met[("Ridge Regression", "R²")] > 0.5
    assert ("Random Forest", "RMSE") in met


def test_boosting_of_numbers_keeps_no_node_of_each_row(spark):
    """A level goes over the rows once; caching their nodes takes a second pass and gives the same trees."""
    rows = [(float(i % 17), float(i * 7 % 23), float((i % 17) * (i * 7 % 23) + i % 3)) for i in range(400)]
    train = VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(
        spark.createDataFrame(rows, "x double, z double, label double"))
    boost = dict(MD.regressors(400, 1.0))[MD.BOOSTING]
    assert not boost.getCacheNodeIds()
    few = boost.copy({boost.maxIter: 5})
    plain, kept = few.fit(train), few.copy({few.cacheNodeIds: True}).fit(train)
    assert plain.treeWeights == kept.treeWeights
    assert [t.toDebugString.split("\n", 1)[1] for t in plain.trees] == [t.toDebugString.split("\n", 1)[1] for t in kept.trees]


def test_validation_flags_multicollinearity(spark, class_150):
    log = TR.run_checks(class_150, "churn", ["age", "income", "region", "occupation"], "Classification",
                        train_score=0.85, test_score=0.5)
    names = [r["check_name"] for r in log.orderBy("seq").collect()]
    assert "Multicollinearity (Feature Redundancy)" in names
    assert "Overfitting Risk" in names
    assert "High Cardinality Categoricals" in names            # occupation has 150 values
    assert names[0] == "Sample Size"


def test_missing_target_check(spark, missing_target_5):
    log = TR.run_checks(missing_target_5, "target", ["feature1", "feature2"], "Regression", 0.8, 0.7)
    rows = {r["check_name"]: r for r in log.collect()}
    assert "Missing Values in Target" in rows
    assert rows["Missing Values in Target"]["message"] == "Target column 'target' contains 2 missing values (40.0%)."
    assert rows["Small Sample Size"]["status"] == T.WARNING


def test_missing_thresholds(spark):
    # exactly 20% missing is not > 20; 21% is
    rows = [(None if i < 20 else 1.0, None if i < 21 else 2.0) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, b double")
    log = TR.run_checks(df, None, ["a", "b"], "Clustering")
    r = log.where(F.col("check_order") == TR.MISSING).first()
    assert r["status"] == T.WARNING and r["message"] == "Columns ['b'] have 20-50% missing values."


def test_leakage_and_imbalance(spark):
    rows = [(float(i), float(i) * 2 + 0.001 * (i % 3), "rare" if i < 3 else "common") for i in range(100)]
    df = spark.createDataFrame(rows, "x double, y double, cls string")
    log = TR.run_checks(df, "y", ["x"], "Regression", 0.9, 0.9999)
    names = [r["check_name"] for r in log.collect()]
    assert "Potential Target Leakage" in names and "Suspiciously High Model Score" not in names
    log2 = TR.run_checks(df, "cls", ["x"], "Classification")
    r = log2.where(F.col("check_order") == TR.IMBALANCE).first()
    assert r["status"] == T.CRITICAL and "('common')" in r["details"]


def test_clustering_pipeline(spark, class_150):
    cl = C.train_clustering(class_150, ["age", "income", "region"], k=3)
    assert [r.name for r in cl.results] == ["K-Means", "Gaussian Mixture Model"]
    for r in cl.results:
        assert {"Silhouette Score", "Davies-Bouldin Index", "Calinski-Harabasz Index"} <= set(r.metrics)
    best = cl.best()
    fitted = cl.profile(best)
    assert sum(r["Size (Rows)"] for r in fitted.collect()) == 150 and cl.labelled(best).columns == [*class_150.columns, "prediction"]
    prof = C.cluster_profile(class_150.withColumn("prediction", F.lit(0)), ["age", "region"], "prediction")
    row = prof.first()
    assert row["Cluster"] == "Cluster 0" and row["Size (Rows)"] == 150 and row["Percentage (%)"] == 100.0
    log = TR.run_checks(class_150, None, ["age"], "Clustering", best_metrics=best.metrics,
                        clusters=best.predictions)
    assert log.where(F.col("check_order") == TR.SILHOUETTE).count() == 1
    pts, evr = C.pca_2d(best.predictions)
    assert pts.count() == 150 and len(evr) == 2


def test_load_dataset_csv_and_errors(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "test.csv")
    with open(p, "w") as f:
        f.write("a,b\n1,2\n3,NA\n")
    df = RD.load_dataset(spark, p)
    assert (df.count(), len(df.columns)) == (2, 2)
    assert dict(df.dtypes) == {"a": "bigint", "b": "bigint"}
    assert df.where(F.col("b").isNull()).count() == 1
    try:
        RD.load_dataset(spark, os.path.join(d, "x.unknown"))
        raise AssertionError("expected an error")
    except ValueError as e:
        assert "no reader is known" in str(e)


def test_json_array_and_lines(spark):
    d = tempfile.mkdtemp()
    arr = os.path.join(d, "a.json")
    with open(arr, "w") as f:
        f.write('[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]')
    assert RD.load_dataset(spark, arr).count() == 2
    lines = os.path.join(d, "l.json")
    with open(lines, "w") as f:
        f.write('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    assert RD.load_dataset(spark, lines).count() == 3


def test_sink_roundtrip(spark, class_150):
    d = tempfile.mkdtemp()
    SK.write_dataset(class_150, os.path.join(d, "out.csv"))
    back = RD.load_dataset(spark, os.path.join(d, "out.csv"))
    assert back.count() == 150 and len(back.columns) == 6


def test_csv_keeps_quotes_line_breaks_and_padding(spark):
    d = tempfile.mkdtemp()
    texts = ['he said "hi", ok', "  padded  ", "two\nlines", 'a\\"b', ",", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    SK.write_dataset(df, os.path.join(d, "t.csv"))
    back = RD.load_dataset(spark, os.path.join(d, "t.csv"))
    assert back.dtypes == df.dtypes and sorted(tuple(r) for r in back.collect()) == list(enumerate(texts))


def test_artifacts_are_repeatable(spark):
    d = tempfile.mkdtemp()
    df = spark.range(5)
    for run in ("a", "a", "b"):
        SK.write_artifacts({"t": df}, d, run)
    assert spark.read.parquet(os.path.join(d, "t")).groupBy("run_id").count().count() == 2
    assert spark.read.parquet(os.path.join(d, "t")).count() == 10


def test_csv_typing_like_a_dataframe_reader(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "f.csv")
    with open(p, "w") as f:
        f.write("a,b,c,d,e\n1.5,2,True,x,1e3\n2.0,NA,False,,7\n3,4,true,z,\n")
    df = RD.load_dataset(spark, p)
    assert df.dtypes == [("a", "double"), ("b", "bigint"), ("c", "boolean"), ("d", "string"), ("e", "double")]
    rows = df.collect()
    assert rows[1]["b"] is None and rows[1]["d"] is None and rows[2]["e"] is None
    assert rows[0]["e"] == 1000.0
