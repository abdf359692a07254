"""Gradient-boosted trees for any number of classes on binned features, one softmax over all of them.

Features are cut into at most ``BINS`` bins at quantiles. A table of at most ``LOCAL_CELLS`` bins fits a single small task,
which grows the trees level by level without a job for each: for little data, jobs would take all of the time.

Rows of a larger table that have the same bins become one cell with its rows of each class (``cells.py``): they have the same
scores in every round. Cells of at most ``LOCAL_CELLS`` codes are again grown in a single task. More of them become blocks of
bytes (codes, rows of each class, scores) that stay distributed. A level of all trees of a round (one tree a class, or one for
two classes) is one Spark job: each task counts gradients, curvatures and rows by (tree, node, feature, bin) with numpy. The
counts of all tasks are added up by (tree, node, feature), and only the best split of each comes to the driver; counts of at
most ``DRIVER_BYTES`` are added up there. After a round the blocks get their new scores, and count the root of the next one;
every ``CHECKPOINT`` rounds they are checkpointed, so the lineage stays short and lost executors cost little.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_sources
from .cells import Bundles, cell_numbers, dealt_rows, to_bins, unblocked

BINS = 255
BLOCK_ROWS = 1 << 15
CHECKPOINT = 10
LOCAL_CELLS = 4_000_000
MIN_LEAF_ROWS, MIN_CURVATURE = 20, 1e-3
DRIVER_BYTES = 16 << 20
_BLOCK = "bins binary, labels binary, scores binary"
_CELLS = "codes binary, rows binary, scores binary, root binary"


@dataclass
class Tree:
    """Nodes in heap order: the feature (-1: leaf) and last bin that goes left, the value added to the score, the gain."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def of_depth(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n))

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after so many levels; rows stay in leaves."""
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[node]
            inner = f >= 0
            right = bins[rows, np.maximum(f, 0)] > self.cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return node


def probabilities(scores: np.ndarray) -> np.ndarray:
    """[rows, classes]: softmax of the scores; one score is the log-odds of the second of two classes."""
    if scores.shape[1] == 1:
        p = 1 / (1 + np.exp(-np.clip(scores, -500, 500)))
        return np.hstack([1 - p, p])
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def derivatives(labels: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[rows, trees]: gradient and curvature of the loss by each score."""
    p = probabilities(scores)[:, -scores.shape[1]:]
    first = 1 if scores.shape[1] == 1 else 0
    y = labels[:, None] == np.arange(first, first + scores.shape[1])[None, :]
    return p - y, p * (1 - p)


def level_counts(bins, labels, scores, trees: list[Tree], level: int) -> dict[tuple[int, int], np.ndarray]:
    """(tree, node): [features, BINS + 1, 3] sums of gradient, curvature and rows of the open nodes of a level."""
    g, h = derivatives(labels, scores)
    first, width = 2 ** level - 1, 2 ** level
    out = {}
    for k, tree in enumerate(trees):
        if level and not (tree.feature[(first - 1) // 2:first] >= 0).any():
            continue
        node = tree.nodes(bins, level) - first
        rows = np.flatnonzero(node >= 0)
        cell = node[rows] * (BINS + 1)
        sums = np.zeros((width, bins.shape[1], BINS + 1, 3))
        for j in range(bins.shape[1]):
            at = cell + bins[rows, j]
            for s, weight in enumerate((g[rows, k], h[rows, k], None)):
                sums[:, j, :, s] = np.bincount(at, weight, width * (BINS + 1)).reshape(width, BINS + 1)
        for i in np.flatnonzero(sums[:, 0, :, 2].sum(axis=1)).tolist():
            out[k, first + i] = sums[i]
    return out


def best_split(sums: np.ndarray) -> tuple[float, int, int, list[float]] | None:
    """(gain, feature, cut, [g, h of the left; g, h of the right side]) of [features, BINS + 1, 3] sums, or None."""
    left = sums.cumsum(axis=1)
    total = left[:, -1:, :]
    right = total - left
    ok = (left[..., 2] >= MIN_LEAF_ROWS) & (right[..., 2] >= MIN_LEAF_ROWS)
    ok &= (left[..., 1] >= MIN_CURVATURE) & (right[..., 1] >= MIN_CURVATURE)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[..., 0] ** 2 / left[..., 1] + right[..., 0] ** 2 / right[..., 1] - total[..., 0] ** 2 / total[..., 1]
    gain = np.where(ok, gain, -np.inf)
    f, cut = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if not gain[f, cut] > 1e-12:
        return None
    return float(gain[f, cut]), int(f), int(cut), [float(x) for x in (*left[f, cut, :2], *right[f, cut, :2])]


class _Local:
    """Blocks in the memory of one task."""

    def __init__(self, blocks):
        self.bins, self.labels, self.scores = (np.concatenate(x) for x in zip(*blocks, strict=True))

    def splits(self, trees, level):
        counts = level_counts(self.bins, self.labels, self.scores, trees, level)
        found = {at: best_split(sums) for at, sums in counts.items()}
        return {at: s for at, s in found.items() if s}

    def advance(self, trees):
        self.scores = advanced(self.bins, self.scores, trees)


class _Cells:
    """Cells in the memory of one task; the node of each in the trees of the round and the counts are kept from level to level."""

    def __init__(self, codes, rows, scores, bundles: Bundles):
        self.codes, self.rows, self.scores, self.bundles = codes, rows, scores, bundles
        self.columns = [np.ascontiguousarray(codes[:, g]) for g in range(codes.shape[1])]
        self.flat, self.at = np.ascontiguousarray(codes).ravel(), np.arange(len(codes)) * codes.shape[1]
        self.total = rows.sum(axis=1)
        self.known, self.level = None, 0

    def step(self, tree: Tree, node: np.ndarray) -> np.ndarray:
        """The nodes a level further down; cells stay in leaves."""
        leaf, feature = tree.feature < 0, np.maximum(tree.feature, 0).astype(np.intp)
        down = np.where(leaf, np.arange(len(leaf)), 2 * np.arange(len(leaf)) + 1)
        cut = np.where(leaf, BINS + 1, tree.cut).astype(np.int16)
        code = self.bundles.group_of[feature].take(node, mode="clip")        # clip: without a check of the bounds
        code += self.at
        code = (feature * (BINS + 1)).take(node, mode="clip") + self.flat.take(code, mode="clip")
        right = self.bundles.bin_of.take(code, mode="clip") > cut.take(node, mode="clip")
        node = down.take(node, mode="clip")
        node += right
        return node

    def counts(self, trees, level):
        """As ``level_counts``, by the bins that a feature has."""
        if not level or self.known is None:
            p = probabilities(self.scores)[:, -len(trees):]
            self.g = np.ascontiguousarray((p * self.total[:, None] - self.rows[:, -len(trees):]).T)
            self.h = np.ascontiguousarray((p * (1 - p) * self.total[:, None]).T)
            self.known, self.sums = self.walk(trees, level), {}
        else:
            self.known = [self.step(t, node) for t, node in zip(trees, self.known, strict=True)]
        self.level = level
        first, width = 2 ** level - 1, 2 ** level
        out: dict = {}
        for k, tree in enumerate(trees):
            if level and not (tree.feature[(first - 1) // 2:first] >= 0).any():
                continue
            node = np.maximum(self.known[k] - first, -1)    # -1: in a leaf above
            weights = [self.g[k], self.h[k], self.total]
            parents, counted = self.sums.get(k), None
            if level and parents is not None:              # of two children the larger has what the smaller leaves of the parent
                n = np.bincount(node + 1, minlength=width + 1)[1:].reshape(-1, 2)
                counted = np.stack([n[:, 0] <= n[:, 1], n[:, 0] > n[:, 1]], axis=1).ravel()
                rows = np.flatnonzero(np.append(counted, False)[node])
            elif (node < 0).any():
                rows = np.flatnonzero(node >= 0)
            else:
                rows = None
            if rows is not None:
                node, weights = node.take(rows), [w.take(rows) for w in weights]
            self.sums[k] = []
            for g, codes in enumerate(self.columns):
                n = self.bundles.width[g]
                at = node * n
                at += codes if rows is None else codes.take(rows)
                sums = np.stack([np.bincount(at, w, width * n).reshape(width, n) for w in weights])
                if counted is not None:
                    split = np.repeat(tree.feature[(first - 1) // 2:first] >= 0, 2)
                    other = np.arange(width) ^ 1
                    rest = np.repeat(parents[g], 2, axis=1) - sums[:, other]
                    sums = np.where(counted[None, :, None], sums, np.where(split[None, :, None], rest, 0))
                self.sums[k].append(sums)
                for j, by_bin in self.bundles.by_feature(g, sums):
                    for i in np.flatnonzero(by_bin[..., 2].sum(axis=1) > 0.5).tolist():
                        out.setdefault((k, first + i), {})[j] = by_bin[i]
        return {at: [by[j] for j in range(len(by))] for at, by in out.items()}

    def walk(self, trees, levels: int, nodes=None) -> list[np.ndarray]:
        """The node of each cell in each tree after so many levels, from the root or the given ones."""
        nodes = nodes or [np.zeros(len(self.codes), np.int64) for _ in trees]
        for _ in range(levels):
            nodes = [self.step(t, node) for t, node in zip(trees, nodes, strict=True)]
        return nodes

    def splits(self, trees, level):
        found = {at: _best_of(sums) for at, sums in self.counts(trees, level).items()}
        return {at: s for at, s in found.items() if s}

    def advance(self, trees):
        depth = (len(trees[0].feature) + 1).bit_length() - 2
        nodes = self.walk(trees, depth - self.level, self.known)
        self.scores = self.scores + np.stack([t.value.take(node) for t, node in zip(trees, nodes, strict=True)], axis=1)


def _best_of(sums: list[np.ndarray]):
    """The best split of the sums of each feature by its bins; of equal gains that of the first feature."""
    wide = np.zeros((len(sums), max(len(s) for s in sums), 3))
    for j, s in enumerate(sums):
        wide[j, :len(s)] = s
    return best_split(wide)


class _Distributed:
    """Blocks of cells as rows of a cached frame, each with the counts of the root by its scores."""

    def __init__(self, cells: DataFrame, tasks: int, bundles: Bundles, start: np.ndarray, classes: int, depth: int):
        self.tasks, self.bundles, self.n_trees, self.classes, self.depth = tasks, bundles, len(start), classes, depth
        self.rounds, self.before = 0, None
        held, root = self._held, self._with_root

        def begin(batches):
            for codes, rows in held(batches, 2):
                yield root(codes, rows, np.tile(start, (len(rows), 1)))
        self.blocks = cells.mapInArrow(begin, _CELLS).persist(StorageLevel.MEMORY_AND_DISK)

    @property
    def _held(self):
        width, classes, n_trees = len(self.bundles.groups), self.classes, self.n_trees

        def parts(batches, n=3):
            for batch in batches:
                for row in zip(*(batch.column(i) for i in range(n)), strict=True):
                    yield tuple(np.frombuffer(v.as_py(), kind).reshape(-1, w) for v, (kind, w) in zip(
                        row, ((np.uint8, width), (float, classes), (float, n_trees)), strict=False))
        return parts

    @property
    def _with_root(self):
        bundles, n_trees, depth = self.bundles, self.n_trees, self.depth

        def pack(codes, rows, scores):
            root = _Cells(codes, rows, scores, bundles).counts([Tree.of_depth(depth) for _ in range(n_trees)], 0)
            return _batch([(codes.tobytes(), rows.tobytes(), scores.tobytes(), pickle.dumps(root))],
                          ["codes", "rows", "scores", "root"], [pa.binary()] * 4)
        return pack

    def _counts(self, trees, level) -> DataFrame:
        """(tree, node, feature, sums) of each task."""
        held, bundles = self._held, self.bundles

        def count(batches):
            total: dict = {}
            if level:
                found = (_Cells(*parts, bundles).counts(trees, level) for parts in held(batches))
            else:
                found = (pickle.loads(r.as_py()) for batch in batches for r in batch.column(0))
            for counts in found:
                for at, sums in counts.items():
                    total[at] = [a + b for a, b in zip(total[at], sums, strict=True)] if at in total else sums
            rows = [(k, node, j, np.ascontiguousarray(s).tobytes()) for (k, node), sums in total.items() for j, s in enumerate(sums)]
            yield _batch(rows, ["tree", "node", "feature", "sums"], [pa.int32(), pa.int32(), pa.int32(), pa.binary()])
        return (self.blocks if level else self.blocks.select("root")).mapInArrow(count, "tree int, node int, feature int, sums binary")

    def splits(self, trees, level):
        sums = self._counts(trees, level)
        if self.tasks * len(trees) * 2 ** level * sum(self.bundles.sizes) * 24 <= DRIVER_BYTES:
            total: dict = {}
            for r in sums.collect():
                by = total.setdefault((r["tree"], r["node"]), {})
                by[r["feature"]] = by.get(r["feature"], 0) + np.frombuffer(r["sums"]).reshape(-1, 3)
            found = {at: _best_of([by[j] for j in range(len(by))]) for at, by in total.items()}
            return {at: s for at, s in found.items() if s}

        def add(key, batches):
            total = 0
            for batch in batches:
                for x in batch.column("sums").to_pylist():
                    total = total + np.frombuffer(x).reshape(1, -1, 3)
            s = best_split(total)
            rows = [(key[0].as_py(), key[1].as_py(), key[2].as_py(), s[0], s[2], s[3])] if s else []
            yield _batch(rows, ["tree", "node", "feature", "gain", "cut", "sides"],
                         [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.float64())])
        found = sums.groupBy("tree", "node", "feature").applyInArrow(
            _first_batches(add), "tree int, node int, feature int, gain double, cut int, sides array<double>").collect()
        best: dict = {}
        for r in sorted(found, key=lambda r: (-r["gain"], r["feature"])):
            best.setdefault((r["tree"], r["node"]), (r["gain"], r["feature"], r["cut"], r["sides"]))
        return best

    def advance(self, trees):
        held, root, bundles = self._held, self._with_root, self.bundles

        def run(batches):
            for codes, rows, scores in held(batches):
                cells = _Cells(codes, rows, scores, bundles)
                cells.advance(trees)
                yield root(codes, rows, cells.scores)
        self._drop()                                       # the blocks have been made since
        self.before, self.rounds = self.blocks, self.rounds + 1
        new = self.blocks.mapInArrow(run, _CELLS)
        if self.rounds % CHECKPOINT == 0:
            self.blocks = new.checkpoint()
            self._drop()
        else:
            self.blocks = new.persist(StorageLevel.MEMORY_AND_DISK)     # made by the job of the next root

    def _drop(self):
        if self.before is not None:
            self.before.unpersist()
            self.before = None

    def release(self):
        self._drop()
        self.blocks.unpersist()


def _first_batches(add):
    """The grouped function over the whole table of a group, as Spark calls it with a key."""
    def run(key, table):
        return pa.Table.from_batches(list(add(key, table.to_batches())))
    return run


def _batch(rows, names, kinds):
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _blocks(batches, features: int):
    for batch in batches:
        for b, y, s in zip(*(batch.column(i) for i in range(3)), strict=True):
            labels = np.frombuffer(y.as_py(), np.int32)
            yield (np.frombuffer(b.as_py(), np.uint8).reshape(-1, features), labels,
                   np.frombuffer(s.as_py()).reshape(len(labels), -1))


def _packed(bins, labels, scores):
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (bins, labels, scores)],
                                      names=["bins", "labels", "scores"])


def advanced(bins, scores, trees):
    """The scores with the values of a round's trees added."""
    depth = (len(trees[0].feature) + 1).bit_length() - 2
    return scores + np.stack([t.value[t.nodes(bins, depth)] for t in trees], axis=1)


def grow(source, n_trees: int, rounds: int, depth: int, step: float) -> list[list[Tree]]:
    """Rounds of trees, grown level by level for all trees of a round at once; ends when no tree finds a split."""
    out = []
    for _ in range(rounds):
        trees = [Tree.of_depth(depth) for _ in range(n_trees)]
        for level in range(depth):
            found = source.splits(trees, level)
            if not found:
                break
            for (k, node), (gain, feature, cut, (gl, hl, gr, hr)) in found.items():
                t = trees[k]
                t.feature[node], t.cut[node], t.gain[node] = feature, cut, gain
                t.value[2 * node + 1], t.value[2 * node + 2] = -step * gl / hl, -step * gr / hr
        if not any((t.feature >= 0).any() for t in trees):
            break
        out.append(trees)
        source.advance(trees)
    return out


def bin_edges(train: DataFrame, features: int) -> list[np.ndarray]:
    """The upper edges of each feature's bins: quantiles, each once; the last bin is open."""
    probs = [i / BINS for i in range(1, BINS)]
    x = F.col("x")
    row = train.select(vector_to_array("features").alias("x")).agg(
        *[F.percentile_approx(x[j], probs, 10 * BINS).alias(f"q{j}") for j in range(features)]).first()
    return [np.unique(np.array(row[j] or [], float)) for j in range(features)]


@dataclass
class SoftmaxBoosting:
    """Estimator: ``fit`` a frame with ``features`` (vector) and ``label`` (0, 1, ...)."""

    classes: int
    rounds: int = 100
    depth: int = 5
    step: float = 0.1

    def fit(self, train: DataFrame) -> SoftmaxBoostingModel:
        spark = train.sparkSession
        ship_sources(spark)
        ensure_checkpoint_dir(spark)
        first = train.select("features").first()
        features = len(first["features"]) if first else 0
        shares = {int(r["label"]): r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        n = sum(shares.values())
        p = np.array([max(shares.get(k, 0), 1e-9) / max(n, 1) for k in range(max(self.classes, 2))])
        start = np.log(p[1:] / p[:1]) if self.classes <= 2 else np.log(p)
        if not features:
            return SoftmaxBoostingModel([], [], start, self.classes, 0)
        edges = bin_edges(train, features)

        grown = self._on_cells if n * features > LOCAL_CELLS else self._on_rows
        return SoftmaxBoostingModel(grown(train, n, edges, start), edges, start, self.classes, features)

    def _on_rows(self, train: DataFrame, n: int, edges: list, start: np.ndarray) -> list:
        features, n_trees, rounds, depth, step = len(edges), len(start), self.rounds, self.depth, self.step

        def pack(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(at, BLOCK_ROWS)
                    x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, features)
                    labels = part.column("label").to_numpy(zero_copy_only=False).astype(np.int32)
                    yield _packed(to_bins(x, edges), labels, np.tile(start, (len(labels), 1)))

        def run(batches):
            held = list(_blocks(batches, features))
            trees = grow(_Local(held), n_trees, rounds, depth, step) if held else []
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trees)], pa.binary())], names=["trees"])
        blocks = train.select(vector_to_array("features").alias("x"), "label").mapInArrow(pack, _BLOCK).checkpoint()
        return pickle.loads(blocks.coalesce(1).mapInArrow(run, "trees binary").first()["trees"])

    def _on_cells(self, train: DataFrame, n: int, edges: list, start: np.ndarray) -> list:
        bundles, classes = Bundles(edges), max(self.classes, 2)
        width, n_trees, rounds, depth, step = len(bundles.groups), len(start), self.rounds, self.depth, self.step

        def add_up(batches):
            for codes, labels in unblocked(batches, width, np.int32):
                first, cell = cell_numbers(codes)
                rows = np.bincount(cell * classes + labels, minlength=len(first) * classes).reshape(-1, classes).astype(float)
                for at in range(0, len(first), BLOCK_ROWS):
                    yield _batch([(codes[first[at:at + BLOCK_ROWS]].tobytes(), rows[at:at + BLOCK_ROWS].tobytes())],
                                 ["codes", "rows"], [pa.binary(), pa.binary()])

        def run(batches):
            parts = [(np.frombuffer(c.as_py(), np.uint8).reshape(-1, width), np.frombuffer(r.as_py()).reshape(-1, classes))
                     for b in batches for c, r in zip(b.column("codes"), b.column("rows"), strict=True)]
            codes, rows = (np.concatenate(x) for x in zip(*parts, strict=True))
            trees = grow(_Cells(codes, rows, np.tile(start, (len(rows), 1)), bundles), n_trees, rounds, depth, step)
            yield _batch([(pickle.dumps(trees),)], ["trees"], [pa.binary()])
        dealt = dealt_rows(train, n, edges, bundles, classes)
        count = dealt.agg(F.sum("cells"), F.count("cells")).first()
        tasks = max(count[1], min(train.sparkSession.sparkContext.defaultParallelism, -(-count[0] // BLOCK_ROWS)))
        cells = dealt.mapInArrow(add_up, "codes binary, rows binary").repartition(tasks).checkpoint()
        if count[0] * width <= LOCAL_CELLS:
            return pickle.loads(cells.coalesce(1).mapInArrow(run, "trees binary").first()["trees"])
        source = _Distributed(cells, tasks, bundles, start, classes, depth)
        trees = grow(source, n_trees, rounds, depth, step)
        source.release()
        return trees


@dataclass
class SoftmaxBoostingModel:
    trees: list
    edges: list
    start: np.ndarray
    classes: int
    features: int

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802  (the name that fitted trees have in Spark)
        """Share of each feature in the gain of all splits."""
        gain = np.zeros(self.features)
        for t in (t for trees in self.trees for t in trees):
            inner = t.feature >= 0
            np.add.at(gain, t.feature[inner], t.gain[inner])
        return DenseVector(gain / gain.sum() if gain.sum() > 0 else gain)

    def save(self, path: str) -> None:
        """Write the nodes of all trees, the edges of the bins and the start scores as three small tables."""
        spark = SparkSession.active()
        nodes = [(r, k, i, int(t.feature[i]), int(t.cut[i]), float(t.value[i]), float(t.gain[i]))
                 for r, trees in enumerate(self.trees) for k, t in enumerate(trees) for i in range(len(t.feature))]
        tables = {
            "nodes": (nodes, "round int, tree int, node int, feature int, cut int, value double, gain double"),
            "edges": ([(j, [float(x) for x in e]) for j, e in enumerate(self.edges)], "feature int, edges array<double>"),
            "start": ([(self.classes, self.features, [float(x) for x in self.start])], "classes int, features int, start array<double>")}
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, path: str) -> SoftmaxBoostingModel:
        spark = SparkSession.active()
        start = spark.read.parquet(f"{path}/start").first()
        edges = [np.array(r["edges"], float) for r in spark.read.parquet(f"{path}/edges").orderBy("feature").collect()]
        nodes = spark.read.parquet(f"{path}/nodes").orderBy("round", "tree", "node").toPandas()
        trees = [[Tree(*(t[c].to_numpy() for c in ("feature", "cut", "value", "gain"))) for _, t in r.groupby("tree")]
                 for _, r in nodes.groupby("round")]
        return cls(trees, edges, np.array(start["start"], float), start["classes"], start["features"])

    def transform(self, df: DataFrame) -> DataFrame:
        """The frame (without its vectors) with ``scores``, probabilities that sum to 1, and ``prediction``."""
        ship_sources(df.sparkSession)
        share = df.sparkSession.sparkContext.broadcast(self)
        keep = [c for c in df.columns if c != "features"]

        def run(batches):
            model = share.value
            for batch in batches:
                x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                scores = np.tile(model.start, (batch.num_rows, 1))
                if model.trees:
                    bins = to_bins(x, model.edges)
                    for trees in model.trees:
                        scores = advanced(bins, scores, trees)
                p = probabilities(scores)
                lists = pa.ListArray.from_arrays(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists, pa.array(p.argmax(axis=1).astype(float))],
                                                 names=[*keep, "scores", "prediction"])
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "features")
        return df.select(*[F.col(f"`{c}`") for c in keep], vector_to_array("features").alias("_x")).mapInArrow(
            run, f"{kinds}, scores array<double>, prediction double")
