import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veritab.operators import metrics as M
from veritab.operators import prep as PR


def allocated(spark, counts, draws):
    df = spark.createDataFrame([(str(k), int(n)) for k, n in counts.items()], "_g string, n long")
    got = {r["_g"]: r["draws"] for r in PR.allocate(df, sum(counts.values()), draws).collect()}
    return {k: got[str(k)] for k in counts}


@pytest.mark.parametrize("n", [7, 10**7 + 3, 10**9 + 1, 10**10 + 19, 3 * 10**15 + 1])
def test_shares_of_many_rows(spark, n):
    def shares(counts, draws):
        floors = {k: c * draws // n for k, c in counts.items()}
        rest = sorted(counts, key=lambda k: (-(counts[k] * draws % n), str(k)))
        return {k: floors[k] + (k in rest[:draws - sum(floors.values())]) for k in counts}
    for parts in ([0.75, 0.125], [0.6, 0.2, 0.1, 0.05], [1 / 7] * 6):
        counts = {k: int(n * p) for k, p in enumerate(parts)}
        counts[len(parts)] = n - sum(counts.values())
        for draws in (n - -(-n // 5), n // 3):
            assert allocated(spark, counts, draws) == shares(counts, draws)


def test_split_with_few_rows_a_bucket_and_identical_rows(spark, monkeypatch):
    monkeypatch.setattr(PR, "BUCKET_ROWS", 50)
    df = spark.range(3000).select((F.col("id") % 900).alias("v"), (F.col("id") % 7).alias("c")).unionByName(
        spark.range(1500).select(F.lit(1).cast("long").alias("v"), F.lit(0).cast("long").alias("c"))).repartition(6)
    s = PR.train_test_split(df)
    assert {r["_split"]: r["count"] for r in s.groupBy("_split").count().collect()} == {"test": 900, "train": 3600}
    st = PR.train_test_split(df, "c", stratify=True)
    sizes = {r["c"]: r["count"] for r in df.groupBy("c").count().collect()}
    train = {r["c"]: r["count"] for r in st.where("_split = 'train'").groupBy("c").count().collect()}
    assert train == allocated(spark, sizes, 3600) and st.count() == 4500


def test_many_classes_and_codes(spark):
    df = spark.range(24_000).select((F.col("id") % 12_000).alias("cls"), F.rand(1).alias("x"),
                                    F.concat(F.lit("v"), F.col("id") % 11_000).alias("t"))
    prep = PR.prepare(df, "cls", ["x", "t"], "Classification")
    assert prep.n_classes == 12_000 and prep.ordinal == ["t"] and prep.n_test == 4800
    assert prep.data.where(F.col("label") != F.col("cls")).count() == 0
    codes = PR.ordinal_codes(df, "t")
    exp = {v: float(i) for i, v in enumerate(sorted({f"v{i}" for i in range(11_000)}))}
    assert {r["value"]: r["code"] for r in codes.collect()} == exp
    other = spark.createDataFrame([("v7",), ("none",), (None,)], "t string")
    assert [r["k"] for r in PR.ordinal_encode(other, "t", codes, "k").collect()] == [exp["v7"], -1.0, -1.0]


def test_nan_counts_as_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, nan, 1.0), (nan, nan, 3.0), (3.0, nan, nan), (None, nan, 5.0)], "a double, b double, y double")
    assert PR.valid_features(df, ["a", "b"]) == ["a"]
    med, mean, std = PR.numeric_fit(df, ["a"])["a"]
    assert (med, mean) == (2.0, 2.0) and std == pytest.approx(math.sqrt(0.5))
    assert [r["a"] for r in PR.impute_median(df, {"a": med}).collect()] == [1.0, 2.0, 3.0, 2.0]
    model, _ = PR.fit_preprocessing(df, ["a"], {"a": "numeric"})
    assert all(math.isfinite(r["features"][0]) for r in model.transform(df).collect())
    got = {r["metric"]: r["value"] for r in M.regression_metrics(df, "y", "a").collect()}
    assert got["MAE"] == 0.0


def test_split_counts_plain_and_stratified(spark, class_150):
    s = PR.train_test_split(class_150)
    counts = {r["_split"]: r["count"] for r in s.groupBy("_split").count().collect()}
    assert counts == {"train": 120, "test": 30}
    st = PR.train_test_split(class_150, "churn", stratify=True)
    per = st.groupBy("churn", "_split").count().toPandas()
    cls = class_150.groupBy("churn").count().toPandas().set_index("churn")["count"]
    train_alloc = allocated(spark, dict(cls), 120)
    for c, k in cls.items():
        got = per[(per.churn == c) & (per._split == "train")]["count"].iloc[0]
        assert got == train_alloc[c]
    assert per["count"].sum() == 150


def test_split_is_deterministic(spark, class_150):
    a = PR.train_test_split(class_150).where("_split = 'test'").select("cust_id").collect()
    b = PR.train_test_split(class_150.repartition(5)).where("_split = 'test'").select("cust_id").collect()
    assert sorted(r[0] for r in a) == sorted(r[0] for r in b)


def test_allocate_largest_remainder(spark):
    assert allocated(spark, {"a": 50, "b": 50, "c": 50}, 120) == {"a": 40, "b": 40, "c": 40}
    got = allocated(spark, {"a": 7, "b": 2, "c": 1}, 8)
    assert sum(got.values()) == 8 and got["a"] >= 5


def test_missing_targets_drop(spark, missing_target_5):
    prep = PR.prepare(missing_target_5, "target", ["feature1", "feature2"], "Regression")
    assert prep.n_train + prep.n_test == 3
    assert prep.data.where(F.col("target").isNull()).count() == 0


def test_all_null_target_raises(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "f double, t double")
    with pytest.raises(ValueError):
        PR.drop_null_target(df, "t")


def test_feature_kinds_and_vector(spark, class_150):
    k = {r["column_name"]: r["kind"] for r in PR.feature_kinds(class_150, ["age", "region", "occupation", "churn"]).collect()}
    assert k == {"age": "numeric", "region": "one_hot", "occupation": "ordinal", "churn": "one_hot"}
    model, names = PR.fit_preprocessing(class_150, ["age", "region"], {"age": "numeric", "region": "one_hot"})
    v = model.transform(class_150).select("features").first()[0]
    assert len(v) == len(names) == 4
    # unseen category -> all-zero one-hot block
    other = class_150.limit(1).withColumn("region", F.lit("Z"))
    z = model.transform(other).select("features").first()[0].toArray()
    assert z[1:].sum() == 0


def test_scaling_population_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "x double")
    fit = PR.numeric_fit(df, ["x"])
    med, mean, std = fit["x"]
    assert med == 2.0 and mean == 2.0
    assert abs(std - math.sqrt(0.5)) < 1e-12          # imputed column [1,2,3,2]: population std


def _brute_auc(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    tot = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return tot / (len(pos) * len(neg))


def test_roc_auc_brute_force(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400) + 0.3 * y, 1)           # many ties
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    a = M.roc_auc(df, F.col("y") == 1, F.col("s")).first()["auc"]
    assert abs(a - _brute_auc(y, s)) < 1e-12


def test_classification_metrics_weighted_and_binary(spark):
    y = ["a", "a", "b", "b", "c", "c", "c"]
    p = ["a", "b", "b", "b", "a", "c", "d"]
    df = spark.createDataFrame(list(zip(y, p)), "y string, p string")
    m = {r["metric"]: r["value"] for r in M.classification_metrics(df, "y", "p", binary=False).collect()}
    # per label (p, r, support): a (.5,.5,2) b (2/3,1,2) c (1,1/3,3) d (0,0,0)
    prec = (0.5 * 2 + 2 / 3 * 2 + 1 * 3) / 7
    rec = (0.5 * 2 + 1 * 2 + 1 / 3 * 3) / 7
    assert abs(m["Accuracy"] - 4 / 7) < 1e-12
    assert abs(m["Precision"] - prec) < 1e-12 and abs(m["Recall"] - rec) < 1e-12
    yb = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "y int, p int")
    mb = {r["metric"]: r["value"] for r in M.classification_metrics(yb, "y", "p", binary=True, positive=1).collect()}
    assert abs(mb["Precision"] - 2 / 3) < 1e-12 and abs(mb["Recall"] - 2 / 3) < 1e-12


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)], "y double, p double")
    m = {r["metric"]: r["value"] for r in M.regression_metrics(df, "y", "p").collect()}
    e = np.array([-0.5, 0.0, 1.0])
    assert abs(m["MAE"] - np.abs(e).mean()) < 1e-12
    assert abs(m["R²"] - (1 - (e ** 2).sum() / 2.0)) < 1e-12


def test_confusion_matrix_zero_filled(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "y string, p string")
    cm = {(r["actual"], r["predicted"]): r["count"] for r in M.confusion_matrix(df, "y", "p").collect()}
    assert cm == {("a", "a"): 1, ("a", "b"): 0, ("b", "a"): 1, ("b", "b"): 0}


def test_roc_curve_endpoints(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "y int, s double")
    c = M.roc_curve(df, F.col("y") == 1, F.col("s")).orderBy(F.col("threshold").desc()).collect()
    assert (c[0]["fpr"], c[0]["tpr"]) == (0.0, 0.0) and (c[-1]["fpr"], c[-1]["tpr"]) == (1.0, 1.0)
