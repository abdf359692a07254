"""The joint K sweep against Lloyd's algorithm in numpy, one K at a time."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from veritab.operators import cluster as C


def vectors(spark, x):
    return spark.createDataFrame([([float(v) for v in r],) for r in x], "x array<double>").select(
        array_to_vector("x").alias("features")).repartition(3)


def alone(x, centres, max_iter=300, tol=1e-4):
    steps = 0
    for _ in range(max_iter):
        mine = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        new = np.array([x[mine == c].mean(0) if (mine == c).any() else centres[c] for c in range(len(centres))])
        steps += 1
        moved = ((new - centres) ** 2).sum(1).max()
        centres = new
        if moved <= tol ** 2:
            break
    mine = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
    used = np.unique(mine)
    if len(used) < 2:
        return 0.0, steps
    d = np.sqrt(((x[:, None] - np.array([x[mine == c].mean(0) for c in used])[None]) ** 2).sum(-1))
    own = np.searchsorted(used, mine)
    a = d[np.arange(len(x)), own].copy()
    d[np.arange(len(x)), own] = np.inf
    b = d.min(1)
    top = np.maximum(a, b)
    return float(np.where(top > 0, (b - a) / np.where(top > 0, top, 1), 0).mean()), steps


@pytest.mark.parametrize("few", [64, 0])
def test_joint_sweep_equals_single_fits(spark, monkeypatch, few):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(m, 0.4, (120, 3)) for m in (0, 3, 6, 9)])
    df = vectors(spark, x).cache()
    monkeypatch.setattr(C, "FEW_TASKS", few)
    scans = []
    real = C.lloyd_step
    monkeypatch.setattr(C, "lloyd_step", lambda *a: scans.append(1) or real(*a))
    got = {r["k"]: r["silhouette"] for r in C.k_sweep(df).collect()}
    seeds = C.first_centres(df, 8, C.R.SEED)
    expected = {k: alone(x, seeds[:k]) for k in range(2, 9)}
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k][0]) < 1e-9 for k in got) and max(got, key=got.get) == 4
    assert len(scans) == max(steps for _, steps in expected.values()) + 1


def test_sweep_of_few_and_equal_rows(spark):
    assert C.k_sweep(vectors(spark, np.arange(6.0).reshape(3, 2))).count() == 0
    same = {r["k"]: r["silhouette"] for r in C.k_sweep(vectors(spark, np.ones((30, 2)))).collect()}
    assert same == {k: 0.0 for k in range(2, 9)}
    two = {r["k"]: r["silhouette"] for r in C.k_sweep(vectors(spark, np.repeat([[0.0], [1.0]], 20, axis=0))).collect()}
    assert two[2] == 1.0 and set(two) == set(range(2, 9))


def plain(x, c):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = np.zeros(len(x))
    for i in range(len(x)):
        same = (c == c[i]) & (np.arange(len(x)) != i)
        if same.any():
            a = d[i, same].mean()
            b = min(d[i, c == o].mean() for o in np.unique(c) if o != c[i])
            s[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0
    return s.mean()


def test_plain_silhouette_exact_and_within_its_error(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(m, 1, (n, 3)) for m, n in ((0, 500), (2, 300), (5, 100))] + [np.full((1, 3), 30.0)])
    x[10] = x[11]                                      # equal rows
    c = np.repeat([0, 1, 2, 7], [500, 300, 100, 1])
    df = spark.createDataFrame([(i, int(k), [float(v) for v in r]) for i, (k, r) in enumerate(zip(c, x, strict=True))],
                               "_rid long, prediction int, x array<double>").select(
        "_rid", "prediction", array_to_vector("x").alias("features")).repartition(4)
    expected = plain(x, c)
    exact = C.plain_silhouette(df)
    assert abs(exact.value - expected) < 1e-9 and exact.error == 0 and exact.anchors == len(x)
    some = C.plain_silhouette(df, anchors=160)
    assert some.anchors < 160 and 0 < some.error < 0.1 and abs(some.value - expected) < 4 * some.error + 0.01
    assert C.plain_silhouette(df.where("prediction = 0")).value == 0.0
    assert C.plain_silhouette(df.where("false")).value == 0.0
