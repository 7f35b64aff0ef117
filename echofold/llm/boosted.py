"""Gradient-boosted trees of logistic loss on binned features, fitted on every row where it lies.

Rows stay in blocks on the executors. A level of a tree is one job: every task adds up the
gradients of its rows by node, feature and bin, and only these sums, of a size that does not
depend on the rows, reach the driver, which picks the splits. Gradients are whole numbers of
1 / UNIT, so the sums, and the trees, do not depend on how the rows are dealt.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echofold.llm.common import written

TREES, DEPTH, RATE, BINS, LEAST = 40, 3, 0.25, 32, 20
UNIT = float(1 << 32)
#: Cuts lie on multiples of this, which bounds the distinct values of a feature.
STEP = 1e-3
#: Partitions, and so partial sums of one level.
PARTS = 64


class Trees:
    """Trees of DEPTH levels: the splits (feature, bin) of each level, and the leaves."""

    def __init__(self, cuts: list[np.ndarray], bias: float):
        self.cuts, self.bias = cuts, bias
        self.trees: list[list[list[tuple[int, int]]]] = []
        self.leaves: list[np.ndarray] = []

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1).astype(np.uint8)

    @staticmethod
    def nodes(b: np.ndarray, splits: list[list[tuple[int, int]]]) -> np.ndarray:
        node = np.zeros(len(b), dtype=np.int64)
        for pick in splits:
            f, c = np.array([s[0] for s in pick]), np.array([s[1] for s in pick])
            node = node * 2 + (b[np.arange(len(b)), f[node]] > c[node])
        return node

    def margin(self, b: np.ndarray) -> np.ndarray:
        z = np.full(len(b), self.bias)
        for splits, leaf in zip(self.trees, self.leaves, strict=True):
            z += leaf[self.nodes(b, splits)]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return 1 / (1 + np.exp(-(self.margin(self.binned(x)) if self.trees else np.full(len(x), self.bias))))


def constant(width: int, y: float) -> Trees:
    """What rows of one class, or none, come to."""
    return Trees([np.zeros(0)] * width, 20.0 if y else -20.0)


def _values(width: int):
    def run(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                x = np.ceil(np.frombuffer(raw, "<f4").reshape(-1, width).astype(float) / STEP).astype(np.int64)
                got = [np.unique(x[:, f], return_counts=True) for f in range(width)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.arange(width), [len(v) for v, _ in got])), pa.array(np.concatenate([v for v, _ in got])), pa.array(np.concatenate([n for _, n in got]))],
                    ["feature", "value", "n"])
    return run


def _cuts(blocks: DataFrame, width: int, n: int) -> list[np.ndarray]:
    """The values at each BINS-th of the n rows, per feature, exact to STEP."""
    counted = blocks.select("x").mapInArrow(_values(width), "feature long, value long, n long").groupBy("feature", "value").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("feature").orderBy("value"))
    k = F.floor((F.col("upto") - F.col("n")) * BINS / n) + 1
    got = counted.withColumn("upto", upto).where((k * n <= F.col("upto") * BINS) & (k < BINS)).select("feature", "value").toPandas()
    return [np.sort(got["value"][got["feature"] == f].to_numpy(float)) * STEP for f in range(width)]


def _sums(rows: RDD, trees: Trees, splits: list) -> np.ndarray:
    """Sums of gradients, hessians and rows by node, feature and bin at the level after these splits."""
    wide, nodes = len(trees.cuts), 1 << len(splits)

    def run(part):
        total = np.zeros((3, nodes * wide * BINS), dtype=np.int64)
        for b, y in part:
            q = 1 / (1 + np.exp(-trees.margin(b)))
            key = ((trees.nodes(b, splits)[:, None] * wide + np.arange(wide)) * BINS + b).ravel()
            for i, v in enumerate((np.rint((y - q) * UNIT), np.rint(q * (1 - q) * UNIT), np.ones(len(y)))):
                total[i] += np.bincount(key, weights=np.repeat(v, wide), minlength=total.shape[1]).astype(np.int64)
        yield total

    return rows.mapPartitions(run).reduce(np.add).reshape(3, nodes, wide, BINS)


def _grown(rows: RDD, trees: Trees) -> tuple[list, np.ndarray]:
    """The splits and leaves of the next tree: all nodes of a level are split at once."""
    splits = []
    for _ in range(DEPTH):
        g, h, n = _sums(rows, trees, splits).cumsum(axis=3)
        g, h = g / UNIT, h / UNIT
        gt, ht, nt = g[..., -1:], h[..., -1:], n[..., -1:]
        gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
        gain = np.where((n >= LEAST) & (nt - n >= LEAST), gain, 0).reshape(len(g), -1)
        at = gain.argmax(axis=1)
        # Without a gain all rows of the node go left.
        splits.append([(int(a) // BINS, int(a) % BINS) if gain[k, a] > 1e-9 else (0, BINS - 1) for k, a in enumerate(at)])
    left = [(g[k, f, c], h[k, f, c]) for k, (f, c) in enumerate(splits[-1])]
    both = [s for k, (a, b) in enumerate(left) for s in ((a, b), (g[k, 0, -1] - a, h[k, 0, -1] - b))]
    return splits, np.array([RATE * a / (b + 1) for a, b in both])


def fit(blocks: DataFrame, width: int) -> Trees:
    """Trees from all rows of (x binary, y binary): blocks of `width` little-endian floats a row, and of one byte."""
    def count(batches):
        for b in batches:
            y = [np.frombuffer(v, np.uint8) for v in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(v) for v in y], pa.int64()), pa.array([int(v.sum()) for v in y], pa.int64())], ["n", "good"])

    n, good = (v or 0 for v in blocks.select("y").mapInArrow(count, "n long, good long").agg(F.sum("n"), F.sum("good")).first())
    if good in (0, n):
        return constant(width, good)
    p = good / n
    trees = Trees(_cuts(blocks, width, n), float(np.log(p / (1 - p))))

    def to_bins(batches):
        for b in batches:
            x = [trees.binned(np.frombuffer(v, "<f4").reshape(-1, width).astype(float)).tobytes() for v in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), b.column(1)], ["b", "y"])

    small = written(blocks.select("x", "y").mapInArrow(to_bins, "b binary, y binary"), "binned")
    rows = small.coalesce(PARTS).rdd.map(lambda r: (np.frombuffer(r.b, np.uint8).reshape(-1, width), np.frombuffer(r.y, np.uint8)))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    for _ in range(TREES):
        splits, leaves = _grown(rows, trees)
        trees.trees.append(splits)
        trees.leaves.append(leaves)
    rows.unpersist()
    return trees
