"""Forests and boosted regression trees of larger tables, grown on cells instead of on rows.

Trees of at most ``MAX_BINS`` bins a feature see of a row only its bins. Rows of the same bins are one cell, and a cell's
weight and sum of labels (or its rows of each class) are all that the choice of a split needs, so a tree over cells is the
tree over their rows. There are never more cells than the product of the features' bins, however many rows there are.

The binned rows are dealt once by cell over tasks of about ``BLOCK_ROWS`` rows; rows of a cell that has many of them go to
several tasks, each with its own part of the cell. For a forest each task draws the bootstrap of its rows for each tree (as
many draws as a Poisson number of that mean, which gives every row a Poisson(1) weight, as MLlib's bagging does), adds the
drawn rows up by cell, and one task a tree grows it from the cells of all tasks. As many trees are drawn at once as take
``DRAWN_BYTES``. What is kept is the binned rows, not a weight or a node for each row and tree.

A table of more than ``TREE_CELLS`` cells is left to MLlib's own estimator, with the same parameters.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_sources

MAX_BINS = 32                  # as MLlib's trees have by default
BLOCK_ROWS = 1 << 19
HOT_ROWS = 1 << 12             # rows of a cell that a block deals to one task
TREE_CELLS = 4_000_000
DRAWN_BYTES = 1 << 30
CODES = 256
SLICE_NODES = 1 << 12
GAIN = 1e-12                   # of the node's own score: below it a gain is rounding


# --------------------------------------------------------------------------------------------
# bins and their bundles
# --------------------------------------------------------------------------------------------

def thresholds(train: DataFrame, features: int, bins: int = MAX_BINS) -> list[np.ndarray]:
    """The upper edges of each feature's bins: between its values where there are at most ``bins``, else at quantiles."""
    vectors = train.select(vector_to_array("features").alias("x"))

    def values(batches):
        seen: list = [np.empty(0)] * features
        for batch in batches:
            x = _matrix(batch.column("x"), features)
            for j, old in enumerate(seen):
                if old is not None:
                    at = np.minimum(np.searchsorted(old, x[:, j]), max(len(old) - 1, 0))
                    new = x[:, j] if not len(old) else x[old[at] != x[:, j], j]
                    both = np.unique(np.concatenate([old, new[~np.isnan(new)]]))
                    seen[j] = both if len(both) <= bins else None
        rows = [(j, v) for j, old in enumerate(seen) for v in ([None] if old is None else old.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64())],
                                         names=["feature", "value"])
    found = vectors.mapInArrow(values, "feature int, value double").distinct().groupBy("feature").agg(
        F.max(F.col("value").isNull()).alias("many"),
        F.slice(F.array_sort(F.collect_set("value")), 1, bins + 1).alias("few")).collect()
    few = {r["feature"]: np.array(r["few"], float) for r in found if not r["many"] and len(r["few"]) <= bins}
    edges: list = [np.empty(0)] * features
    for j, v in few.items():
        with np.errstate(invalid="ignore"):
            middle = v[:-1] + (v[1:] - v[:-1]) / 2
        edges[j] = np.where(np.isfinite(middle), middle, v[:-1])
    wide = [r["feature"] for r in found if r["feature"] not in few]
    if wide:
        probs, x = [i / bins for i in range(1, bins)], F.col("x")
        row = vectors.agg(*[F.percentile_approx(x[j], probs, 10 * bins).alias(f"q{j}") for j in wide]).first()
        for j in wide:
            edges[j] = np.unique(np.array(row[f"q{j}"], float))
    return edges


def _matrix(column, features: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, features)


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


class Bundles:
    """Features whose bins together have at most ``CODES`` combinations share one code of a byte. Sums by code are the sums
    by the bins of all its features, so a tree counts once a bundle instead of once a feature."""

    def __init__(self, edges: list[np.ndarray]):
        self.sizes = [len(e) + 1 for e in edges]
        self.groups: list[list[int]] = []
        room: list[int] = []
        for j in sorted(range(len(edges)), key=lambda j: (-self.sizes[j], j)):
            g = next((g for g, left in enumerate(room) if left >= self.sizes[j]), len(room))
            if g == len(room):
                self.groups.append([])
                room.append(CODES)
            self.groups[g].append(j)
            room[g] //= self.sizes[j]
        self.shape = [[self.sizes[j] for j in group] for group in self.groups]
        self.width = [int(np.prod(s)) for s in self.shape]
        self.group_of = np.zeros(len(edges), np.int64)
        self.bin_of = np.zeros((len(edges), CODES), np.uint8)     # the feature's bin in each code of its bundle
        for g, (group, shape) in enumerate(zip(self.groups, self.shape, strict=True)):
            for j, b in zip(group, np.unravel_index(np.arange(self.width[g]), shape), strict=True):
                self.group_of[j] = g
                self.bin_of[j, :len(b)] = b
        self.adds = [np.hstack([np.eye(self.sizes[j])[self.bin_of[j, :w]] for j in group])   # code to bins, side by side
                     for group, w in zip(self.groups, self.width, strict=True)]

    def codes(self, bins: np.ndarray) -> np.ndarray:
        """[rows, bundles] of [rows, features]."""
        return np.stack([np.ravel_multi_index(tuple(bins[:, j].astype(np.intp) for j in group), shape)
                         for group, shape in zip(self.groups, self.shape, strict=True)], axis=1).astype(np.uint8)

    def by_feature(self, g: int, sums: np.ndarray):
        """(feature, [nodes, bins, sums]) of each feature of a bundle, from [sums, nodes, codes]."""
        at = 0
        added = sums @ self.adds[g]
        for j in self.groups[g]:
            yield j, np.moveaxis(added[..., at:at + self.sizes[j]], 0, -1)
            at += self.sizes[j]


def cell_numbers(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each cell, the cell of each row); cells are numbered in the order of their codes."""
    cell = np.zeros(len(codes), np.int64)
    for at in range(0, codes.shape[1], 4):
        part = codes[:, at:at + 4].astype(np.int64)
        for b in part.T:
            cell = cell * CODES + b
        _, first, cell = np.unique(cell, return_index=True, return_inverse=True)
    return first, cell


# --------------------------------------------------------------------------------------------
# one tree over cells
# --------------------------------------------------------------------------------------------

@dataclass
class CellTree:
    """Nodes in the order of their levels: feature (leaf: 0), last bin that goes left (leaf: all), left child (leaf: itself; the
    right child is the next node), value (mean label, or share of each class), gain of the split times the node's weight."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    depth: int

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        flat, at = np.ascontiguousarray(bins).ravel(), np.arange(len(bins)) * bins.shape[1]
        feature, left = self.feature.astype(np.intp), self.left.astype(np.intp)
        node = np.zeros(len(bins), np.intp)
        for _ in range(self.depth):
            where = feature.take(node, mode="clip")                # clip: without a check of the bounds
            where += at
            right = flat.take(where, mode="clip") > self.cut.take(node, mode="clip")
            node = left.take(node, mode="clip")
            node += right
        return node


def grow_tree(codes, stats, weights, bundles: Bundles, depth: int, subset: int, rng, classes: int) -> CellTree:
    """A tree of cells: ``stats`` [cells, classes] are the rows of each class, or [cells, 1] the sum of labels; ``weights`` the
    rows. Splits lower the Gini impurity or the variance most, of ``subset`` random features a node; ties go to the first."""
    n_features = len(bundles.sizes)
    columns = [stats[:, k] for k in range(stats.shape[1])] + ([] if classes else [weights])
    codes_t = [np.ascontiguousarray(codes[:, g]) for g in range(codes.shape[1])]
    flat = np.stack(codes_t)
    rows, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
    out, base, n_open, level = [], 0, 1, 0
    total = np.array([[c.sum() for c in columns]])
    while n_open:
        feature, cut, gain = np.zeros(n_open, np.int64), np.full(n_open, CODES, np.int64), np.zeros(n_open)
        split = np.zeros(n_open, bool)
        if level < depth:
            allowed = np.ones((n_open, n_features), bool)
            if subset < n_features:
                places = rng.random((n_open, n_features)).argsort(axis=1).argsort(axis=1)
                allowed = places < subset
            order = np.argsort(node, kind="stable") if n_open > SLICE_NODES else None
            ends = np.searchsorted(node[order], np.arange(0, n_open + SLICE_NODES, SLICE_NODES)) if order is not None else None
            for lo in range(0, n_open, SLICE_NODES):
                hi = min(lo + SLICE_NODES, n_open)
                some = slice(None) if order is None else np.sort(order[ends[lo // SLICE_NODES]:ends[lo // SLICE_NODES + 1]])
                found = _best(rows[some], node[some] - lo, hi - lo, columns, codes_t, bundles, total[lo:hi], allowed[lo:hi], classes)
                split[lo:hi], gain[lo:hi], feature[lo:hi], cut[lo:hi] = found
        n_split = int(split.sum())
        left = base + np.arange(n_open)
        left[split] = base + n_open + 2 * np.arange(n_split)
        whole = total.sum(axis=1, keepdims=True) if classes else total[:, -1:]
        value = total[:, :classes or 1] / np.where(whole > 0, whole, 1)
        out.append((np.where(split, feature, 0), np.where(split, cut, CODES), left, value, np.where(split, gain, 0)))
        if not n_split:
            break
        if n_split < n_open:
            stays = split[node]
            rows, node = rows[stays], node[stays]
        code = flat.take((bundles.group_of[feature] * len(codes)).take(node) + rows)
        right = bundles.bin_of.take((feature * CODES).take(node) + code) > cut.take(node)
        base, n_open, level = base + n_open, 2 * n_split, level + 1
        node = (left - base).take(node) + right
        total = np.stack([np.bincount(node, c[rows], n_open) for c in columns], axis=1)
    parts = [np.concatenate(x) for x in zip(*out, strict=True)]
    return CellTree(parts[0].astype(np.int32), parts[1].astype(np.int16), parts[2].astype(np.int32), parts[3], parts[4], len(out) - 1)


def _best(rows, node, n_nodes, columns, codes_t, bundles, total, allowed, classes):
    """(splits, gain, feature, cut) of each of the nodes."""
    def score(s):
        with np.errstate(divide="ignore", invalid="ignore"):
            if classes:
                return (s * s).sum(axis=-1) / s.sum(axis=-1)
            return s[..., 0] ** 2 / s[..., 1]
    own = score(total)
    best, feature, cut = np.full(n_nodes, -np.inf), np.zeros(n_nodes, np.int64), np.zeros(n_nodes, np.int64)
    every = len(rows) == len(columns[0])             # then in their order: no node of the level above is a leaf
    held = columns if every else [c[rows] for c in columns]
    for g, codes in enumerate(codes_t):
        width = bundles.width[g]
        at = node * width + (codes if every else codes[rows])
        sums = np.stack([np.bincount(at, c, n_nodes * width).reshape(n_nodes, width) for c in held])
        for j, by_bin in bundles.by_feature(g, sums):
            lefts = by_bin.cumsum(axis=1)[:, :-1]
            if not lefts.shape[1]:
                continue
            rights = total[:, None, :] - lefts
            n_left, n_right = ((s.sum(axis=-1) if classes else s[..., -1]) for s in (lefts, rights))
            gains = np.where((n_left > 0.5) & (n_right > 0.5), score(lefts) + score(rights) - own[:, None], -np.inf)
            k = gains.argmax(axis=1)
            gain = np.where(allowed[:, j], gains[np.arange(n_nodes), k], -np.inf)
            # bundles hold features out of order: of equal gains the feature that comes first counts
            better = (gain > best) | ((gain == best) & (gain > -np.inf) & (j < feature))
            best, feature, cut = np.where(better, gain, best), np.where(better, j, feature), np.where(better, k, cut)
    return best > GAIN * np.abs(own), best, feature, cut


# --------------------------------------------------------------------------------------------
# binned rows, dealt by cell
# --------------------------------------------------------------------------------------------

def dealt_rows(train: DataFrame, rows: int, edges: list[np.ndarray], bundles: Bundles, classes: int) -> DataFrame:
    """(codes, labels, cells): blocks of binned rows in the order of their codes and labels, all rows of a cell in few blocks,
    and the number of the block's cells; checkpointed."""
    features, kind = len(edges), np.int32 if classes else np.float64
    tasks = -(-rows // BLOCK_ROWS)
    lots = 8 * tasks                                 # Spark deals lots by their hash: the more, the more evenly
    width = len(bundles.groups)
    odd = np.random.default_rng(width).integers(1, 1 << 62, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def deal(batches):
        for codes, labels in _gathered(((bundles.codes(to_bins(_matrix(b.column("x"), features), edges)),
                                         b.column("label").to_numpy(zero_copy_only=False).astype(kind)) for b in batches), BLOCK_ROWS):
            _, cell = cell_numbers(codes)
            order = np.argsort(cell, kind="stable")
            codes, labels, cell = codes[order], labels[order], cell[order]
            place = np.arange(len(cell)) - np.searchsorted(cell, cell)
            mixed = (codes.astype(np.uint64) * odd).sum(axis=1, dtype=np.uint64) >> np.uint64(33)
            lot = (mixed.astype(np.int64) + place // HOT_ROWS) % lots
            order = np.argsort(lot, kind="stable")
            ends = np.searchsorted(lot[order], np.arange(lots + 1))
            for t in range(lots):
                at = order[ends[t]:ends[t + 1]]
                if len(at):
                    yield _block([(t, codes[at].tobytes(), labels[at].tobytes())], ["lot", "codes", "labels"],
                                 [pa.int32(), pa.binary(), pa.binary()])

    def blocks(batches):
        held = ((np.frombuffer(c.as_py(), np.uint8).reshape(-1, width), np.frombuffer(y.as_py(), kind))
                for b in batches for c, y in zip(b.column("codes"), b.column("labels"), strict=True))
        for codes, labels in _gathered(held, 4 * BLOCK_ROWS):
            first, cell = cell_numbers(codes)
            order = np.lexsort((labels, cell))
            yield _block([(codes[order].tobytes(), labels[order].tobytes(), len(first))], ["codes", "labels", "cells"],
                         [pa.binary(), pa.binary(), pa.int64()])
    pieces = train.select(vector_to_array("features").alias("x"), "label").mapInArrow(deal, "lot int, codes binary, labels binary")
    return pieces.repartition(tasks, "lot").mapInArrow(blocks, "codes binary, labels binary, cells long").checkpoint()


def _gathered(parts, rows: int):
    """The (codes, labels) of several parts together, about so many rows at a time."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[1])
        if n >= rows:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _block(rows, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def unblocked(batches, width: int, kind):
    """(codes, labels) of each block."""
    for b in batches:
        for c, y in zip(b.column("codes"), b.column("labels"), strict=True):
            yield np.frombuffer(c.as_py(), np.uint8).reshape(-1, width), np.frombuffer(y.as_py(), kind)


# --------------------------------------------------------------------------------------------
# estimators
# --------------------------------------------------------------------------------------------

@dataclass
class CellForest:
    """Estimator of bagged trees: ``fit`` a frame with ``features`` (vector) and ``label``. ``mllib`` is the estimator of the same
    parameters for tables of too many cells; ``classes`` 0 means a number is predicted."""

    mllib: object
    classes: int = 0
    subset: str = "all"
    binned: dict = field(default_factory=dict)     # of the last frame, for estimators that share it

    def fit(self, train: DataFrame):
        made = _binned(train, self.classes, self.binned)
        if made is None:
            return self.mllib.fit(train)
        blocks, cells, edges, bundles = made
        n_trees, depth, seed = self.mllib.getNumTrees(), self.mllib.getMaxDepth(), self.mllib.getSeed()
        features, width, classes = len(edges), len(bundles.groups), self.classes
        kind, wide = (np.int32, classes) if classes else (np.float64, 2)
        subset = int(np.ceil(np.sqrt(features))) if self.subset == "sqrt" else features
        at_once = int(max(1, min(n_trees, DRAWN_BYTES // (cells * (width + 8 * wide)))))
        trees: list = []
        for low in range(0, n_trees, at_once):
            drawn = range(low, min(low + at_once, n_trees))

            def draw(batches, drawn=drawn):
                for codes, labels in unblocked(batches, width, kind):
                    first, cell = cell_numbers(codes)
                    n, mark = len(labels), int(np.frombuffer(codes[first].tobytes(), np.uint8).sum())
                    for t in drawn:
                        rng = np.random.default_rng([seed, t, n, len(first), mark])
                        rows = rng.integers(0, n, rng.poisson(n), dtype=np.int32)
                        where = cell[rows]
                        if classes:
                            sums = np.bincount(where * classes + labels[rows], minlength=len(first) * classes).reshape(-1, classes)
                            some = sums.any(axis=1)
                        else:
                            weight = np.bincount(where, minlength=len(first))
                            sums = np.stack([np.bincount(where, labels[rows], len(first)), weight], axis=1)
                            some = weight > 0
                        yield _block([(t, codes[first[some]].tobytes(), sums[some].astype(float).tobytes())],
                                     ["tree", "codes", "sums"], [pa.int32(), pa.binary(), pa.binary()])

            def grow(key, table):
                parts = [(np.frombuffer(c.as_py(), np.uint8).reshape(-1, width), np.frombuffer(s.as_py()).reshape(-1, wide))
                         for c, s in zip(table.column("codes"), table.column("sums"), strict=True)]
                codes, sums = _merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                t = key[0].as_py()
                weights = sums.sum(axis=1) if classes else sums[:, 1]
                tree = grow_tree(codes, sums if classes else sums[:, :1], weights, bundles, depth, subset,
                                 np.random.default_rng([seed, t]), classes)
                return pa.table({"tree": pa.array([t], pa.int32()), "nodes": pa.array([pickle.dumps(tree)], pa.binary())})
            grown = blocks.mapInArrow(draw, "tree int, codes binary, sums binary").repartition(len(drawn), "tree").groupBy(
                "tree").applyInArrow(grow, "tree int, nodes binary").collect()
            trees += [pickle.loads(r["nodes"]) for r in sorted(grown, key=lambda r: r["tree"])]
        return CellModel(trees, [1.0 / len(trees)] * len(trees), edges, classes, features)


def _merged(codes: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts of the same cell added up, in the order of the cells, so that the order in which parts come does not matter."""
    first, cell = cell_numbers(codes)
    order = np.lexsort((*sums.T, cell))
    return codes[first], np.stack([np.bincount(cell[order], s[order], len(first)) for s in sums.T], axis=1)


@dataclass
class CellBoosting:
    """Estimator of gradient boosting of numbers by squared errors as MLlib does it: the first tree has the labels, each later
    one twice what is left of them, and counts ``stepSize``."""

    mllib: object
    binned: dict = field(default_factory=dict)

    def fit(self, train: DataFrame):
        made = _binned(train, 0, self.binned)
        if made is None:
            return self.mllib.fit(train)
        blocks, _, edges, bundles = made
        rounds, depth, step = self.mllib.getMaxIter(), self.mllib.getMaxDepth(), self.mllib.getStepSize()
        width = len(bundles.groups)

        def add_up(batches):
            for codes, labels in unblocked(batches, width, np.float64):
                first, cell = cell_numbers(codes)
                sums = np.stack([np.bincount(cell, labels, len(first)), np.bincount(cell, minlength=len(first))], axis=1)
                yield _block([(codes[first].tobytes(), sums.tobytes())], ["codes", "sums"], [pa.binary(), pa.binary()])

        def boost(batches):
            parts = [(np.frombuffer(c.as_py(), np.uint8).reshape(-1, width), np.frombuffer(s.as_py()).reshape(-1, 2))
                     for b in batches for c, s in zip(b.column("codes"), b.column("sums"), strict=True)]
            if parts:
                trees = boosted(*_merged(*(np.concatenate(x) for x in zip(*parts, strict=True))), bundles, rounds, depth, step)
                yield _block([(pickle.dumps(trees),)], ["trees"], [pa.binary()])
        trees = pickle.loads(blocks.mapInArrow(add_up, "codes binary, sums binary").coalesce(1).mapInArrow(
            boost, "trees binary").first()["trees"])
        return CellModel(trees, [1.0] + [step] * (len(trees) - 1), edges, 0, len(edges))


def boosted(codes, sums, bundles: Bundles, rounds: int, depth: int, step: float) -> list[CellTree]:
    bins = np.stack([bundles.bin_of[j][codes[:, bundles.group_of[j]]] for j in range(len(bundles.sizes))], axis=1)
    n, left, trees = sums[:, 1], sums[:, 0], []
    for r in range(rounds):
        tree = grow_tree(codes, (left if not r else 2 * left)[:, None], n, bundles, depth, len(bundles.sizes), None, 0)
        left = left - (1.0 if not r else step) * n * tree.value[tree.leaves(bins), 0]
        trees.append(tree)
    return trees


def _binned(train: DataFrame, classes: int, held: dict):
    """(blocks, cells, edges, bundles), or None if the table has no feature or too many cells."""
    if held.get("train") is train:
        return held["made"]
    spark = train.sparkSession
    ship_sources(spark)
    ensure_checkpoint_dir(spark)
    first = train.select("features").first()
    features = len(first["features"]) if first else 0
    made = None
    if features:
        edges = thresholds(train, features)
        bundles = Bundles(edges)
        blocks = dealt_rows(train, train.count(), edges, bundles, classes)
        cells = blocks.agg(F.sum("cells")).first()[0]
        made = (blocks, cells, edges, bundles) if cells <= TREE_CELLS else None
    held.update(train=train, made=made)
    return made


@dataclass
class CellModel:
    """The weighted sum of trees, whose bins are between ``edges``."""

    trees: list
    weights: list
    edges: list
    classes: int
    features: int

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802  (the name that fitted trees have in Spark)
        """The mean over the trees of each feature's share in the tree's gain."""
        total = np.zeros(self.features)
        for t, w in zip(self.trees, self.weights, strict=True):
            gain = np.bincount(t.feature, t.gain, self.features)
            total += w * gain / gain.sum() if gain.sum() > 0 else 0
        return DenseVector(total / total.sum() if total.sum() > 0 else total)

    def scores(self, bins: np.ndarray) -> np.ndarray:
        """[rows, classes or 1]."""
        out = np.zeros((len(bins), self.classes or 1))
        for t, w in zip(self.trees, self.weights, strict=True):
            out += w * t.value[t.leaves(bins)]
        return out

    def save(self, path: str) -> None:
        """Write the nodes of all trees, the edges of the bins and the sizes as three small tables."""
        spark = SparkSession.active()
        nodes = [(k, float(w), t.depth, i, int(t.feature[i]), int(t.cut[i]), int(t.left[i]), [float(v) for v in t.value[i]], float(t.gain[i]))
                 for k, (t, w) in enumerate(zip(self.trees, self.weights, strict=True)) for i in range(len(t.feature))]
        tables = {
            "nodes": (nodes, "tree int, weight double, depth int, node int, feature int, cut int, left int, value array<double>, gain double"),
            "edges": ([(j, [float(x) for x in e]) for j, e in enumerate(self.edges)], "feature int, edges array<double>"),
            "sizes": ([(self.classes, self.features)], "classes int, features int")}
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, path: str) -> CellModel:
        spark = SparkSession.active()
        sizes = spark.read.parquet(f"{path}/sizes").first()
        edges = [np.array(r["edges"], float) for r in spark.read.parquet(f"{path}/edges").orderBy("feature").collect()]
        nodes = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toPandas()
        trees, weights = [], []
        for _, t in nodes.groupby("tree"):
            trees.append(CellTree(t["feature"].to_numpy(np.int32), t["cut"].to_numpy(np.int16), t["left"].to_numpy(np.int32),
                                  np.array(t["value"].tolist()), t["gain"].to_numpy(), int(t["depth"].iloc[0])))
            weights.append(float(t["weight"].iloc[0]))
        return cls(trees, weights, edges, sizes["classes"], sizes["features"])

    def transform(self, df: DataFrame) -> DataFrame:
        """The frame (without its vectors) with ``prediction``, and for classes the ``probability`` of each."""
        ship_sources(df.sparkSession)
        share = df.sparkSession.sparkContext.broadcast(self)
        keep = [c for c in df.columns if c != "features"]

        def run(batches):
            model = share.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                p = model.scores(to_bins(_matrix(batch.column("_x"), model.features), model.edges))
                lists = pa.ListArray.from_arrays(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32), pa.array(p.ravel()))
                best = p.argmax(axis=1).astype(float) if model.classes else p[:, 0]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists, pa.array(best)],
                                                 names=[*keep, "_p", "prediction"])
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "features")
        out = df.select(*[F.col(f"`{c}`") for c in keep], vector_to_array("features").alias("_x")).mapInArrow(
            run, f"{kinds}, _p array<double>, prediction double")
        kept = [F.col(f"`{c}`") for c in keep]
        return out.select(*kept, *([array_to_vector("_p").alias("probability")] if self.classes else []), "prediction")
