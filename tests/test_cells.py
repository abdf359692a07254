"""Trees grown on cells: the same trees as MLlib's where the bins are the same, forests as good as MLlib's, and their limits."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor

from veritab.operators import boosting as B
from veritab.operators import cells as C
from veritab.operators import models as MD


def rows(n=3000, seed=1, classes=0):
    """Features of 20, 12, 3 and 2 values, a constant, and a label that depends on them."""
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, k, n) for k in (20, 12, 3, 2)] + [np.full(n, 7)], axis=1).astype(float)
    y = x[:, 0] * (x[:, 3] - 0.4) + np.sin(x[:, 1]) * 5 + x[:, 2] + rng.normal(0, 1, n)
    return x, np.digitize(y, np.quantile(y, [0.3, 0.6])).clip(0, classes - 1).astype(float) if classes else y


def frame(spark, x, y, parts=3):
    data = [(i, float(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "id long, label double, x array<double>").select(
        "id", "label", array_to_vector("x").alias("features")).repartition(parts, "id").cache()


def predictions(model, df):
    return {r["id"]: r["prediction"] for r in model.transform(df).select("id", "prediction").collect()}


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_one_tree_is_the_tree_of_mllib(spark, classes):
    x, y = rows(classes=classes)
    df = frame(spark, x, y)
    edges = C.thresholds(df, 5)
    assert [len(e) + 1 for e in edges] == [20, 12, 3, 2, 1]
    bundles = C.Bundles(edges)
    bins = B.to_bins(x, edges)
    codes = bundles.codes(bins)
    assert all((bundles.bin_of[j][codes[:, bundles.group_of[j]]] == bins[:, j]).all() for j in range(5))
    first, cell = C.cell_numbers(codes)
    assert (codes[first][cell] == codes).all() and len(first) == len(np.unique(codes, axis=0))
    sums = np.stack([np.bincount(cell, y == k) for k in range(classes)] if classes else [np.bincount(cell, y)], axis=1)
    tree = C.grow_tree(codes[first], sums, np.bincount(cell).astype(float), bundles, 6, 5, None, classes)
    other = (DecisionTreeClassifier if classes else DecisionTreeRegressor)(maxDepth=6, maxBins=32).fit(df)
    value = tree.value[tree.leaves(bins)]
    want = predictions(other, df)
    got = value.argmax(axis=1) if classes else value[:, 0]
    assert np.mean(np.isclose(got, [want[i] for i in range(len(y))])) > (0.995 if classes else 0.9999)


def test_boosting_of_numbers_is_that_of_mllib(spark):
    x, y = rows()
    df = frame(spark, x, y)
    gbt = GBTRegressor(maxIter=12, stepSize=0.1, maxDepth=4, seed=1)
    want, got = predictions(gbt.fit(df), df), predictions(C.CellBoosting(gbt).fit(df), df)
    assert want.keys() == got.keys() and max(abs(want[i] - got[i]) for i in want) < 1e-6


@pytest.mark.parametrize("classes", [0, 3])
def test_forest_is_as_good_as_that_of_mllib_and_repeats(spark, classes, tmp_path, monkeypatch):
    (x, y), (u, v) = rows(classes=classes), rows(seed=2, classes=classes)
    train, test = frame(spark, x, y), frame(spark, u, v)
    kind, strategy = (RandomForestClassifier, "sqrt") if classes else (RandomForestRegressor, "all")
    rf = kind(numTrees=25, maxDepth=6, featureSubsetStrategy=strategy, seed=42)
    model, other = C.CellForest(rf, classes, strategy).fit(train), rf.fit(train)
    assert len(model.trees) == 25

    def quality(m):
        p = predictions(m, test)
        p = np.array([p[i] for i in range(len(v))])
        return np.mean(p == v) if classes else 1 - np.sum((p - v) ** 2) / np.sum((v - v.mean()) ** 2)
    assert quality(model) > quality(other) - 0.03 and quality(model) > 0.7
    mine, theirs = model.featureImportances.toArray(), other.featureImportances.toArray()
    assert abs(mine.sum() - 1) < 1e-9 and np.abs(mine - theirs).max() < 0.1
    out = model.transform(test)
    assert "features" not in out.columns
    if classes:
        p = np.array([r["probability"].toArray() for r in out.collect()])
        assert np.allclose(p.sum(axis=1), 1) and p.shape[1] == 3
    model.save(str(tmp_path / "m"))
    assert predictions(C.CellModel.load(str(tmp_path / "m")), test) == predictions(model, test)
    monkeypatch.setattr(C, "DRAWN_BYTES", 1)                       # one tree at a time: the same trees
    again = C.CellForest(rf, classes, strategy).fit(frame(spark, x, y, parts=5))
    assert predictions(again, test) == predictions(model, test)


def test_rows_of_a_hot_cell_go_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_ROWS", 500)
    monkeypatch.setattr(C, "HOT_ROWS", 50)
    x, y = np.zeros((4000, 2)), np.arange(4000) % 7.0
    x[:100, 0], x[:50, 1] = 1, 2
    df = frame(spark, x, y)
    edges = C.thresholds(df, 2)
    bundles = C.Bundles(edges)
    blocks = C.dealt_rows(df, 4000, edges, bundles, 0).collect()
    sizes = [len(r["labels"]) // 8 for r in blocks]
    assert sum(sizes) == 4000 and len(sizes) >= 5 and max(sizes) < 1500
    assert sum(np.frombuffer(r["labels"]).sum() for r in blocks) == y.sum()
    got = predictions(C.CellBoosting(GBTRegressor(maxIter=3, maxDepth=2, seed=1)).fit(df), df)
    want = predictions(GBTRegressor(maxIter=3, maxDepth=2, seed=1).fit(df), df)
    assert max(abs(want[i] - got[i]) for i in want) < 1e-6


def test_wide_features_and_cells_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (2000, 3))
    x[:5, 2] = np.inf
    y = x[:, 0] * 3 + (x[:, 1] > 0)
    df = frame(spark, x, y)
    edges = C.thresholds(df, 3)
    assert all(20 < len(e) <= 31 for e in edges)
    bundles = C.Bundles(edges)
    bins = B.to_bins(x, edges)
    assert np.bincount(bins[:, 0]).max() < 2 * 2000 / 32
    first, cell = C.cell_numbers(bundles.codes(bins))
    args = (bundles.codes(bins)[first], np.bincount(cell, y)[:, None], np.bincount(cell).astype(float), bundles, 30, 3, None, 0)
    whole = C.grow_tree(*args)
    monkeypatch.setattr(C, "SLICE_NODES", 16)
    parts = C.grow_tree(*args)
    assert (whole.feature == parts.feature).all() and (whole.cut == parts.cut).all() and np.allclose(whole.value, parts.value)
    value = whole.value[whole.leaves(bins), 0]
    assert np.allclose(value, (np.bincount(cell, y) / np.bincount(cell))[cell])      # grown to purity: each cell its mean


def test_larger_forests_of_classes_are_grown_on_cells_and_others_on_rows():
    assert type(dict(MD.classifiers(400, 3))[MD.FOREST]) is RandomForestClassifier
    forest = dict(MD.classifiers(2_000_000, 3))[MD.FOREST]
    assert type(forest) is C.CellForest and (forest.mllib.getNumTrees(), forest.mllib.getMaxDepth()) == (100, 30)


def test_larger_forests_of_numbers_are_grown_on_cells_and_others_on_rows():
    assert type(dict(MD.regressors(400, 1.0))[MD.FOREST]) is RandomForestRegressor
    assert type(dict(MD.regressors(2_000_000, 1.0))[MD.FOREST]) is C.CellForest


def test_larger_boosting_of_numbers_is_grown_on_cells_unless_there_are_too_many(spark, monkeypatch):
    assert type(dict(MD.regressors(400, 1.0))[MD.BOOSTING]) is GBTRegressor
    boost = dict(MD.regressors(2_000_000, 1.0))[MD.BOOSTING]
    assert type(boost) is C.CellBoosting and boost.mllib.getMaxIter() == 100
    x, y = rows(400)
    monkeypatch.setattr(C, "TREE_CELLS", 100)
    df = frame(spark, x, y)
    gbt = GBTRegressor(maxIter=2, maxDepth=2, seed=1)
    assert predictions(C.CellBoosting(gbt).fit(df), df) == predictions(gbt.fit(df), df)


def test_forest_and_boosting_of_numbers_bin_the_rows_once(spark, monkeypatch):
    x, y = rows(300)
    df, dealt = frame(spark, x, y), []
    deal = C.dealt_rows
    monkeypatch.setattr(C, "dealt_rows", lambda *a: dealt.append(1) or deal(*a))
    models = dict(MD.regressors(2_000_000, 1.0, 4))
    for name in (MD.FOREST, MD.BOOSTING):
        models[name].mllib = models[name].mllib.copy({models[name].mllib.maxDepth: 2})
        assert models[name].fit(df).transform(df).count() == 300
    assert len(dealt) == 1
