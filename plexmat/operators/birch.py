"""Birch: clustering features as a sketch of bounded size, a tree a partition, merged by key.

A clustering feature is (number, sum, sum of squares) of the points it stands for; features add up. A tree of nodes with at most ``branching`` entries leads
a point to the nearest leaf feature, which takes it if its radius stays within the threshold; otherwise the point begins a feature of its own, and nodes that
overflow split by their farthest entries. When a tree has more than ``most`` leaf features its threshold doubles and it is built again from them, so a sketch never
outgrows its bound. Every partition of the points builds a tree in one pass; eight trees at a time are merged by inserting their features into one, until one is
left. Its features (at most ``most``) are joined by Ward's method, and every point takes the cluster of the nearest feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexmat.operators import kernels
from plexmat.operators.distance import METRICS
from plexmat.session import materialize

MOST, BRANCHING, FAN_IN = 1000, 50, 8
_FEATURES = "part long, n long, total array<double>, squares double, threshold double"


class _Node:
    """Entries of a node: features, and below an inner one a child each."""

    def __init__(self, leaf: bool):
        self.leaf, self.n, self.total, self.squares, self.children = leaf, [], [], [], []

    def add(self, n: float, total: np.ndarray, squares: float, child: _Node | None = None) -> None:
        self.n.append(n)
        self.total.append(total)
        self.squares.append(squares)
        self.children.append(child)

    def sums(self) -> tuple[float, np.ndarray, float]:
        return sum(self.n), np.sum(self.total, axis=0), sum(self.squares)

    def centres(self) -> np.ndarray:
        return np.array(self.total) / np.array(self.n)[:, None]


class FeatureTree:
    def __init__(self, threshold: float, branching: int = BRANCHING, most: int = MOST):
        self.threshold, self.branching, self.most = threshold, branching, most
        self.root, self.leaves = _Node(True), 0

    def insert(self, n: float, total: np.ndarray, squares: float) -> None:
        halves = self._insert(self.root, n, total, squares)
        if halves:
            self.root = _Node(False)
            for half in halves:
                self.root.add(*half.sums(), half)
        if self.leaves > self.most:
            kept, self.threshold = self.features(), 2 * self.threshold if self.threshold > 0 else self._closest()
            self.root, self.leaves = _Node(True), 0
            for f in kept:
                self.insert(*f)

    def _closest(self) -> float:
        """A first threshold where none was given: the smallest distance between two features."""
        c = np.array([t / n for n, t, _ in self.features()])
        d = METRICS["euclidean"](c, c)
        return float(d[d > 0].min(initial=np.inf)) if (d > 0).any() else 1.0

    def _insert(self, node: _Node, n: float, total: np.ndarray, squares: float) -> tuple[_Node, _Node] | None:
        if node.n:
            i = int(((node.centres() - total / n) ** 2).sum(1).argmin())
            if node.leaf:
                both, s = node.n[i] + n, node.total[i] + total
                if (node.squares[i] + squares) / both - (s @ s) / both**2 <= self.threshold**2 + 1e-12:
                    node.n[i], node.total[i], node.squares[i] = both, s, node.squares[i] + squares
                    return None
            else:
                halves = self._insert(node.children[i], n, total, squares)
                if halves is None:
                    node.n[i], node.total[i], node.squares[i] = node.n[i] + n, node.total[i] + total, node.squares[i] + squares
                    return None
                for part in (node.n, node.total, node.squares, node.children):
                    del part[i]
                for half in halves:
                    node.add(*half.sums(), half)
                return self._split(node)
        node.add(n, total, squares)
        self.leaves += 1
        return self._split(node)

    def _split(self, node: _Node) -> tuple[_Node, _Node] | None:
        if len(node.n) <= self.branching:
            return None
        c = node.centres()
        d = METRICS["sqeuclidean"](c, c)
        i, j = np.unravel_index(d.argmax(), d.shape)
        halves = _Node(node.leaf), _Node(node.leaf)
        second = d[j] < d[i]
        second[i], second[j] = False, i != j
        for k, which in enumerate(second.tolist()):
            halves[which].add(node.n[k], node.total[k], node.squares[k], node.children[k])
        return halves if halves[1].n else None

    def features(self) -> list[tuple[float, np.ndarray, float]]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            todo += [] if node.leaf else node.children
            out += zip(node.n, node.total, node.squares, strict=True) if node.leaf else []
        return out


def _rows(tree: FeatureTree, part: int) -> pd.DataFrame:
    found = sorted(tree.features(), key=lambda f: (f[0], f[1].tolist()))
    return pd.DataFrame({"part": part, "n": [int(f[0]) for f in found], "total": [f[1].tolist() for f in found], "squares": [float(f[2]) for f in found], "threshold": tree.threshold})


def features(points: DataFrame, threshold: float, branching: int = BRANCHING, most: int = MOST) -> DataFrame:
    """(n, total, squares, threshold): the leaf features of one tree of all points."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        tree = FeatureTree(threshold, branching, most)
        for pdf in batches:
            for v in pdf.vec:
                x = np.asarray(v, float)
                tree.insert(1, x, float(x @ x))
        yield _rows(tree, TaskContext.get().partitionId())

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = FeatureTree(float(pdf.threshold.max()), branching, most)
        for n, total, squares in sorted(zip(pdf.n.tolist(), (tuple(t) for t in pdf.total), pdf.squares.tolist(), strict=True)):
            tree.insert(n, np.array(total), squares)
        return _rows(tree, int(pdf.part.iloc[0]) // FAN_IN)

    found = materialize(points.select("cell_id", "vec").repartition("cell_id").sortWithinPartitions("cell_id").mapInPandas(build, _FEATURES), "birch")
    while (found.agg(F.max("part")).first()[0] or 0) > 0:
        found = materialize(found.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(merge, _FEATURES), "birch")
    return found.drop("part")


def birch(points: DataFrame, k: int, threshold: float, branching: int = BRANCHING, most: int = MOST) -> DataFrame:
    """(dataset_id, cell_id, cluster): k clusters of the features by Ward's method; a point takes that of the nearest feature."""
    one = features(points, threshold, branching, most)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "squares"], ignore_index=True)
        size = pdf.n.to_numpy(float)
        centre = np.array(pdf.total.tolist()) / size[:, None]
        ward = METRICS["ward"](np.hstack([centre, size[:, None]]), np.hstack([centre, size[:, None]]))
        merges = kernels.agglomerate(ward, "ward", size)
        return pd.DataFrame({"centre": centre.tolist(), "cluster": kernels.cut_tree(merges, len(size), k)})

    # at most ``most`` features
    named = materialize(one.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(join, "centre array<double>, cluster int"), "birch-clusters")
    listed = F.broadcast(named.agg(F.sort_array(F.collect_list(F.struct("cluster", "centre"))).alias("features")))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                centre, cluster = (np.array([r[c] for r in pdf.features.iloc[0]]) for c in ("centre", "cluster"))
                d = METRICS["sqeuclidean"](np.array(pdf.vec.tolist()), centre)
                yield pd.DataFrame({"dataset_id": pdf.dataset_id, "cell_id": pdf.cell_id, "cluster": cluster[d.argmin(1)]})

    kind = points.schema["dataset_id"].dataType.simpleString()
    return points.select("dataset_id", "cell_id", "vec").join(listed).mapInPandas(nearest, f"dataset_id {kind}, cell_id long, cluster int")
