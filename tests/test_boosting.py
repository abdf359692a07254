"""Boosted trees: probabilities, agreement of the two ways of counting, and comparison with Spark's own."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from veritab.operators import boosting as B
from veritab.operators import metrics as M


def frame(spark, classes, n=4000, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 4))
    x[:, 3] = rng.integers(0, 3, n)
    angle = np.arctan2(x[:, 0] + 0.3 * rng.normal(0, 1, n), x[:, 1]) + np.pi
    label = np.floor(angle / (2 * np.pi) * classes).clip(0, classes - 1)
    rows = [(i, float(y), [float(v) for v in r]) for i, (y, r) in enumerate(zip(label, x, strict=True))]
    return spark.createDataFrame(rows, "id long, label double, x array<double>").select(
        "id", "label", array_to_vector("x").alias("features")).repartition(3).cache()


Jobs = B._Distributed


def f1(pred):
    return M.classification_metrics(pred, "label", "prediction", binary=False, positive=1.0).where(
        F.col("metric") == M.F1).first()["value"]


@pytest.mark.parametrize("classes", [2, 3])
def test_probabilities_and_accuracy(spark, classes, tmp_path):
    train, test = frame(spark, classes), frame(spark, classes, seed=4)
    model = B.SoftmaxBoosting(classes, rounds=40).fit(train)
    pred = model.transform(test).cache()
    rows = pred.collect()
    assert all(len(r["scores"]) == classes and abs(sum(r["scores"]) - 1) < 1e-9 for r in rows)
    assert all(r["prediction"] == np.argmax(r["scores"]) for r in rows)
    gbt = GBTClassifier(maxIter=40, stepSize=0.1, maxDepth=5, seed=1)
    other = (gbt if classes == 2 else OneVsRest(classifier=gbt)).fit(train).transform(test)
    assert f1(pred) >= f1(other) - 0.01 and f1(pred) > 0.8
    model.save(str(tmp_path / "m"))
    again = B.SoftmaxBoostingModel.load(str(tmp_path / "m")).transform(test)
    assert {r["id"]: r["scores"] for r in again.collect()} == {r["id"]: r["scores"] for r in rows}
    shares = model.featureImportances.toArray()
    assert abs(shares.sum() - 1) < 1e-9 and shares[:2].sum() > 0.8


def test_jobs_for_levels_equal_one_task(spark, monkeypatch):
    train = frame(spark, 3, n=900)
    one = B.SoftmaxBoosting(3, rounds=3, depth=3).fit(train)
    monkeypatch.setattr(B, "LOCAL_CELLS", 0)
    monkeypatch.setattr(B, "BLOCK_ROWS", 100)
    monkeypatch.setattr(B, "CHECKPOINT", 2)
    many = B.SoftmaxBoosting(3, rounds=3, depth=3).fit(train)
    assert len(one.trees) == len(many.trees) == 3
    for a, b in zip(one.trees, many.trees, strict=True):
        for s, t in zip(a, b, strict=True):
            assert (s.feature == t.feature).all() and (s.cut == t.cut).all() and np.allclose(s.value, t.value)


def test_loss_falls_with_every_round(spark):
    train = frame(spark, 3)
    data = [(r["label"], r["features"]) for r in train.collect()]
    y, x = np.array([int(r[0]) for r in data]), np.array([r[1].toArray() for r in data])
    model = B.SoftmaxBoosting(3, rounds=10).fit(train)
    bins, scores, losses = B.to_bins(x, model.edges), np.tile(model.start, (len(y), 1)), []
    for trees in model.trees:
        losses.append(-np.log(B.probabilities(scores)[np.arange(len(y)), y]).mean())
        scores = B.advanced(bins, scores, trees)
    assert all(b < a for a, b in zip(losses, losses[1:], strict=False))


def test_split_against_all_cuts():
    rng = np.random.default_rng(5)
    sums = np.zeros((3, B.BINS + 1, 3))
    sums[:, :12, 0], sums[:, :12, 1] = rng.normal(0, 5, (3, 12)), rng.uniform(1, 9, (3, 12))
    sums[:, :12, 2] = 15
    best = (-np.inf,)
    for f in range(3):
        for cut in range(11):
            (gl, hl, nl), (gr, hr, nr) = sums[f, :cut + 1].sum(0), sums[f, cut + 1:].sum(0)
            if min(nl, nr) >= B.MIN_LEAF_ROWS:
                best = max(best, (gl**2 / hl + gr**2 / hr - (gl + gr)**2 / (hl + hr), f, cut))
    gain, f, cut, _ = B.best_split(sums)
    assert (f, cut) == best[1:] and abs(gain - best[0]) < 1e-9


def test_few_rows_one_class_and_constant_features(spark):
    rows = [(float(i % 2), [1.0, 2.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "label double, x array<double>").select("label", array_to_vector("x").alias("features"))
    got = B.SoftmaxBoosting(2).fit(df).transform(df).collect()
    assert all(abs(r["scores"][0] - 0.5) < 1e-9 for r in got)
    one = df.where("label = 1")
    assert {r["prediction"] for r in B.SoftmaxBoosting(2).fit(one).transform(one).collect()} == {1.0}
    assert B.SoftmaxBoosting(3).fit(df.where("false")).transform(df).count() == 30


@pytest.mark.parametrize("classes", [2, 3])
def test_cells_give_the_trees_of_their_rows(spark, monkeypatch, classes):
    """Rows of the same bins are one cell; in one task or in jobs, with the counts added up by the driver or by tasks."""
    fine = frame(spark, classes, n=3000)
    train = fine.select("id", "label", array_to_vector(F.transform(
        vector_to_array("features"), lambda v: F.round(v * 2) / 2)).alias("features")).cache()
    rows = B.SoftmaxBoosting(classes, rounds=4, depth=3).fit(train)
    monkeypatch.setattr(B, "LOCAL_CELLS", 11_000)
    assert train.count() * 4 > 11_000
    called = []
    monkeypatch.setattr(B, "_Distributed", lambda *a: called.append(1) or Jobs(*a))
    models = [B.SoftmaxBoosting(classes, rounds=4, depth=3).fit(train)]
    assert not called                                        # fewer cells than rows: one task
    monkeypatch.setattr(B, "LOCAL_CELLS", 0)
    for most in (B.DRIVER_BYTES, 0):
        monkeypatch.setattr(B, "DRIVER_BYTES", most)
        models.append(B.SoftmaxBoosting(classes, rounds=4, depth=3).fit(train))
    assert len(called) == 2
    for model in models:
        assert len(model.trees) == len(rows.trees) == 4
        for a, b in zip(rows.trees, model.trees, strict=True):
            for s, t in zip(a, b, strict=True):
                assert (s.feature == t.feature).all() and (s.cut == t.cut).all() and np.allclose(s.value, t.value)


def test_counts_of_cells_are_those_of_their_rows_with_leaves_on_every_level():
    rng = np.random.default_rng(2)
    n, y = 700, rng.integers(0, 3, 700).astype(np.int32)
    x = np.stack([rng.integers(0, 9, n), y + rng.integers(0, 6, n), rng.integers(0, 2, n)], axis=1)
    edges = [np.arange(k) + 0.5 for k in (8, 7, 1)]
    bins, bundles = B.to_bins(x, edges), B.Bundles(edges)
    codes = bundles.codes(bins)
    first, cell = B.cell_numbers(codes)
    rows = np.bincount(cell * 3 + y, minlength=3 * len(first)).reshape(-1, 3).astype(float)
    plain = B._Local([(bins, y, np.zeros((n, 3)))])
    cells = B._Cells(codes[first], rows, np.zeros((len(first), 3)), bundles)
    early = 0
    for _ in range(3):
        trees = [B.Tree.of_depth(5) for _ in range(3)]
        for level in range(5):
            want, got = B.level_counts(plain.bins, plain.labels, plain.scores, trees, level), cells.counts(trees, level)
            assert want.keys() == got.keys()
            early += level > 1 and len(want) < 3 * 2 ** level
            for at, by_feature in got.items():
                for j, sums in enumerate(by_feature):
                    assert np.allclose(want[at][j, :len(sums)], sums, atol=1e-9) and not want[at][j, len(sums):].any()
            for (k, node), sums in want.items():
                if split := B.best_split(sums):
                    t, (gain, f, cut, (gl, hl, gr, hr)) = trees[k], split
                    t.feature[node], t.cut[node], t.gain[node] = f, cut, gain
                    t.value[2 * node + 1], t.value[2 * node + 2] = -gl / hl / 10, -gr / hr / 10
        plain.advance(trees)
        cells.advance(trees)
        assert np.allclose(plain.scores, cells.scores[cell])
    assert early
