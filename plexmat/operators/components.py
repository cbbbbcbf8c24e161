"""Distributed connected components over an edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from plexmat.session import materialize


#: So many edges (3 MB) are joined in one task; more of them in rounds of joins.
SMALL_EDGES = 200_000


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest reachable node): roots are hooked to smaller ones along the edges, and paths are cut short."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further


def _in_one_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = list(batches)
    if held:
        edges = pd.concat(held, ignore_index=True)
        node, component = joined(edges.a.to_numpy(), edges.b.to_numpy())
        yield pd.DataFrame({"node": node, "component": component})


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, small: int = SMALL_EDGES) -> DataFrame:
    """Smallest reachable id of every node that has an edge.

    At most ``small`` edges of whole numbers are joined in one task. Otherwise, every round, each node takes the smallest label among itself and its neighbours (an aggregation with map-side
    combine, so a hub costs one row per task) and then jumps to the label of its label, which halves the
    depth; a path of n nodes needs about log2(n) rounds. Labels are written to the shared folder after each round.

    Returns (node, component). Self loops keep their node; null ends are ignored. Raises if it has not
    converged after ``max_rounds``.
    """
    pairs = materialize(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("a"), F.col(dst).alias("b")), "cc-pairs")
    kind = pairs.schema["a"].dataType
    if isinstance(kind, IntegralType) and pairs.schema["b"].dataType == kind and pairs.count() <= small:
        return materialize(pairs.coalesce(1).mapInPandas(_in_one_task, f"node {kind.simpleString()}, component {kind.simpleString()}"), "cc-labels")
    both = (
        pairs
        .select(F.explode(F.array(
            F.struct(F.col("a").alias("node"), F.col("b").alias("peer")),
            F.struct(F.col("b").alias("node"), F.col("a").alias("peer")),
        )).alias("e"))
        .select("e.node", "e.peer")
        .distinct()
    )
    both = materialize(both, "cc-edges")
    labels = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("peer")).alias("component")), "cc-labels")
    for _ in range(max_rounds):
        seen = (
            both.join(labels.select(F.col("node").alias("peer"), F.col("component").alias("c")), "peer")
            .groupBy("node").agg(F.min("c").alias("c"))
        )
        stepped = labels.join(seen, "node").select(
            "node", F.least("component", "c").alias("component"), F.col("component").alias("before"))
        target = stepped.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = stepped.join(target, "component", "left").select(
            "node", F.least("component", F.coalesce("further", "component")).alias("component"), "before")
        # a label that was replaced also pulls its old root along
        pull = jumped.groupBy(F.col("before").alias("node")).agg(F.min("component").alias("pulled"))
        labels = materialize(
            jumped.join(pull, "node", "left").select(
                "node", F.least("component", F.coalesce("pulled", "component")).alias("component"), "before"),
            "cc-labels")
        if labels.where(F.col("component") != F.col("before")).limit(1).count() == 0:
            return labels.select("node", "component")
        labels = labels.select("node", "component")
    raise RuntimeError(f"components have not converged after {max_rounds} rounds")
