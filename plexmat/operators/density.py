"""A density ordering of points: reachability along the spanning tree of mutual reachability.

The core distance of a point is that to its ``min_samples``-th neighbour, itself counted; two points' mutual reachability is the largest of
their distance and both core distances. Walking from the point with the smallest id always over the lightest edge out of what has been
visited, a point's reachability is the weight of the edge by which it is entered: valleys are clusters. The walk never leaves the
spanning tree, so

1. the tree grows in rounds: trees take their lightest edges to other ones, and the trees that these edges join become one. Lists of near points settle
   every tree whose lightest listed edge is lighter than the ends of all its points' lists. Where they settle fewer than half of the trees, the other ones but
   the largest are compared with all points, block pair by block pair; of a tree only those points ask whose lists end before its lightest listed edge;
2. the tree is walked from its heaviest edges down. What is left when the ``PIECE`` heaviest edges of a tree are taken out are parts that the walk
   visits in one go, since all their edges are lighter. One task walks the contracted tree; the parts' sizes give each part its first place, and the edge
   by which it is entered its first point. Then the parts are walked alike, all at once, until they fit a task.

Edges are compared by weight (rounded to nine digits) and ends, so the tree and the walk are the only ones.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexmat.operators.components import connected_components
from plexmat.operators.distance import PAIRS, TILE, Screen, block_pairs, exact_squares, knn, vectors
from plexmat.session import materialize

PIECE = 200_000
#: Length of the lists of near points that settle most trees.
KNOWN = 16


def core_distances(points: DataFrame, min_samples: int = 5) -> DataFrame:
    """(cell_id, core): distance to the min_samples-th neighbour, the point itself counted (the farthest point, if there are fewer)."""
    p = points.select("cell_id", "vec")
    return knn(p, p, min_samples).groupBy(F.col("src").alias("cell_id")).agg(F.max("dist").alias("core"))


def _lightest(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
    """The lightest edge of each asking tree on the left to another one on the right, in one block pair, if it isn't heavier than the tree's bound."""
    if not len(x) or not len(y):
        return pd.DataFrame()
    left, right, core, other_core = vectors(x), vectors(y), x.core.to_numpy(), y.core.to_numpy()
    trees, tree = np.unique(x.comp.to_numpy(), return_inverse=True)
    names, other = x.comp.to_numpy(), y.comp.to_numpy()
    src, dst = x.cell_id.to_numpy(), y.cell_id.to_numpy()
    bound = np.full(len(trees), np.inf)
    np.minimum.at(bound, tree, x.bound.to_numpy())
    screen, out = Screen(left, right), []
    for r0 in range(0, len(x), TILE[0]):
        r = slice(r0, r0 + TILE[0])
        n = len(left[r])
        for c0 in range(0, len(y), TILE[1]):
            c = slice(c0, c0 + TILE[1])
            inner = names[r][:, None] == other[c][None, :]
            if screen.usable:
                low = screen.low(r, c)
                low[inner] = np.inf
                # the likeliest edge of every row first: its weight bounds the tree
                i, j = np.arange(n), low.argmin(axis=1)
                i, j = i[~inner[i, j]], j[~inner[i, j]]
                np.minimum.at(bound, tree[r0 + i], _weights(left, right, core, other_core, r0 + i, c0 + j))
                # half a unit of the ninth digit and more: weights are rounded
                i, j = np.nonzero(low <= screen.bound(r, (bound[tree[r]] + 1e-9) ** 2)[:, None])
            else:
                i, j = np.nonzero(~inner)
            near = (np.maximum(core[r0 + i], other_core[c0 + j]) <= bound[tree[r0 + i]] + 1e-9) & ~inner[i, j]
            i, j = r0 + i[near], c0 + j[near]
            w = _weights(left, right, core, other_core, i, j)
            ok = np.isfinite(w) & (w <= bound[tree[i]])
            i, j, w = i[ok], j[ok], w[ok]
            np.minimum.at(bound, tree[i], w)
            ok = w <= bound[tree[i]]
            i, j, w = i[ok], j[ok], w[ok]
            found = pd.DataFrame({"comp": names[i], "w": w, "a": np.minimum(src[i], dst[j]), "b": np.maximum(src[i], dst[j]), "other": other[j]})
            out.append(found.sort_values(["comp", "w", "a", "b"]).drop_duplicates("comp"))
    return pd.concat(out, ignore_index=True).sort_values(["comp", "w", "a", "b"]).drop_duplicates("comp")


def _weights(x: np.ndarray, y: np.ndarray, core: np.ndarray, other_core: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Mutual reachability of single pairs, rounded to nine digits."""
    return np.round(np.maximum(np.maximum(np.sqrt(exact_squares(x, y, i, j)), core[i]), other_core[j]), 9)


def spanning_tree(points: DataFrame, min_samples: int = 5, rounds: int = 64, known: int = KNOWN) -> DataFrame:
    """(a, b, w): the edges of the spanning tree of mutual reachability, a < b."""
    p, k = points.select("cell_id", "vec"), max(known, min_samples)
    near = materialize(knn(p, p, k).select("src", "dst", "dist", "rank"), "density-near")
    nearest = F.when(F.col("rank") <= min_samples, F.col("dist"))
    # no edge that isn't listed is lighter than the last one of a full list
    cores = near.groupBy(F.col("src").alias("cell_id")).agg(F.max(nearest).alias("core"), F.when(F.count("*") == k, F.round(F.max("dist"), 9)).otherwise(float("inf")).alias("reach"))
    p = materialize(p.join(cores, "cell_id"), "density-points")
    core = lambda x: p.select(F.col("cell_id").alias(x), F.col("core").alias(f"core_{x}"))
    pairs = near.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "dist").groupBy("a", "b").agg(F.min("dist").alias("dist"))
    listed = materialize(pairs.join(core("a"), "a").join(core("b"), "b").select("a", "b", F.round(F.greatest("dist", "core_a", "core_b"), 9).alias("w")), "density-listed")
    comp, tree = materialize(p.select("cell_id", F.col("cell_id").alias("comp")), "density-comp"), None
    for _ in range(rounds):
        of = lambda x: comp.select(F.col("cell_id").alias(x), F.col("comp").alias(f"comp_{x}"))  # noqa: B023, E731
        # edges inside a tree are of no use any more
        listed = materialize(listed.select("a", "b", "w").join(of("a"), "a").join(of("b"), "b").where("comp_a <> comp_b"), "density-listed")
        ways = listed.select(F.col("comp_a").alias("comp"), "w", "a", "b", F.col("comp_b").alias("other")).unionByName(
            listed.select(F.col("comp_b").alias("comp"), "w", "a", "b", F.col("comp_a").alias("other")))
        light = ways.groupBy("comp").agg(F.min(F.struct("w", "a", "b", "other")).alias("e"))
        trees = comp.join(p.select("cell_id", "reach"), "cell_id").groupBy("comp").agg(F.min("reach").alias("reach"), F.count("*").alias("size"))
        trees = materialize(trees.join(light, "comp", "left"), "density-trees")
        settled = F.coalesce(F.col("e.w") < F.col("reach"), F.lit(False))
        found = trees.agg(F.count("*").alias("n"), F.count_if(settled).alias("settled"), F.max(F.struct("size", "comp")).alias("largest")).first()
        if found.n <= 1:
            break
        best = trees.where(settled).select("comp", "e.*")
        if 2 * found.settled < found.n:
            # lists settle too few trees: all but the largest are compared with the points, from those of their own whose lists end before what they know
            others = trees.where((F.col("comp") != found.largest.comp) & ~settled)
            asking = others.select("comp", F.coalesce("e.w", F.lit(float("inf"))).alias("bound"))
            here = p.join(comp, "cell_id")
            left = materialize(here.join(asking, "comp").where("reach <= bound").select("cell_id", "vec", "core", "comp", "bound"), "density-asking")
            right = here.select("cell_id", "vec", "core", "comp", F.lit(None).cast("double").alias("bound"))
            met = block_pairs(left, right, _lightest, "comp long, w double, a long, b long, other long", more=["core", "comp", "bound"], pairs=PAIRS)
            both = met.unionByName(others.where("e IS NOT NULL").select("comp", "e.*")).groupBy("comp").agg(F.min(F.struct("w", "a", "b", "other")).alias("e"))
            best = best.unionByName(both.select("comp", "e.*"))
        best = materialize(best, "density-edges")
        if best.isEmpty():
            break
        fresh = best.select("a", "b", "w").distinct()
        tree = materialize(fresh if tree is None else tree.unionByName(fresh), "density-tree")
        joined = connected_components(best, "comp", "other").select(F.col("node").alias("comp"), "component")
        comp = materialize(comp.join(joined, "comp", "left").select("cell_id", F.coalesce("component", "comp").alias("comp")), "density-comp")
    else:
        raise RuntimeError(f"trees still join after {rounds} rounds")
    return tree if tree is not None else listed.select("a", "b", "w")


def walked(edges: list[tuple[float, int, int, int, int]], start: int, entry: int) -> list[tuple[int, int, float | None]]:
    """(part, point by which it is entered, weight of that edge) in the order of the walk; edges are (w, a, b, part of a, part of b)."""
    near: dict[int, list[tuple[float, int, int, int, int]]] = {}
    for w, a, b, pa, pb in edges:
        near.setdefault(pa, []).append((w, a, b, pb, b))
        near.setdefault(pb, []).append((w, a, b, pa, a))
    out, seen, heap = [(start, entry, None)], {start}, list(near.get(start, []))
    heapq.heapify(heap)
    while heap:
        w, _, _, part, point = heapq.heappop(heap)
        if part not in seen:
            seen.add(part)
            out.append((part, point, w))
            for e in near.get(part, []):
                heapq.heappush(heap, e)
    return out


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """Walks one contracted tree; rows are its edges, each with the tree's first point."""
    entry = int(pdf.entry.iloc[0])
    edges = list(zip(pdf.w.tolist(), pdf.a.tolist(), pdf.b.tolist(), pdf.part_a.tolist(), pdf.part_b.tolist(), strict=True))
    start = int(pdf.start.iloc[0])
    order = walked(edges, start, entry)
    part, point, weight = zip(*order, strict=True)
    return pd.DataFrame({"tree": int(pdf.tree.iloc[0]), "part": part, "point": point, "weight": np.array([np.nan if w is None else w for w in weight]), "nth": np.arange(len(part))})


def ordering(tree: DataFrame, points: DataFrame, piece: int = PIECE) -> DataFrame:
    """(cell_id, place, reachability): the walk over a spanning tree (a, b, w); the first point has no reachability.

    Several trees (no edge between them) follow each other by their smallest ids.
    """
    ids = points.select("cell_id")
    comp = connected_components(tree, "a", "b").select(F.col("node").alias("cell_id"), "component")
    member = materialize(ids.join(comp, "cell_id", "left").select("cell_id", F.coalesce("component", "cell_id").alias("tree")), "walk-member")
    sizes = member.groupBy("tree").agg(F.count("*").alias("n"), F.min("cell_id").alias("entry"))
    # as many rows as trees without an edge between them (one, for points at finite distances)
    first = F.coalesce(F.sum("n").over(Window.orderBy("entry").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    trees = materialize(sizes.select("tree", "entry", "n", first.alias("first"), F.lit(None).cast("double").alias("reachability")), "walk-trees")
    edges = materialize(tree.join(member.select(F.col("cell_id").alias("a"), "tree"), "a"), "walk-edges")
    done = None
    while True:
        alone = trees.where("n = 1").select(F.col("entry").alias("cell_id"), F.col("first").alias("place"), "reachability")
        done = alone if done is None else done.unionByName(alone)
        if edges.isEmpty():
            return materialize(done, "walk-order")
        done = materialize(done, "walk-order")
        heavy_first = Window.partitionBy("tree").orderBy(F.desc("w"), F.desc("a"), F.desc("b"))
        ranked = edges.withColumn("heavy", F.row_number().over(heavy_first) <= piece)
        ranked = materialize(ranked, "walk-ranked")
        light = ranked.where("NOT heavy").select("tree", "a", "b", "w")
        parts = connected_components(light, "a", "b").select(F.col("node").alias("cell_id"), "component")
        open_members = member.join(trees.where("n > 1").select("tree"), "tree")
        placed = materialize(open_members.join(parts, "cell_id", "left").select("cell_id", "tree", F.coalesce("component", "cell_id").alias("part")), "walk-parts")
        part_of = lambda x: placed.select(F.col("cell_id").alias(x), F.col("part").alias(f"part_{x}"))  # noqa: B023, E731
        starts = trees.select("tree", "entry", "first").join(placed.select(F.col("cell_id").alias("entry"), F.col("part").alias("start")), "entry")
        contracted = ranked.where("heavy").join(part_of("a"), "a").join(part_of("b"), "b").join(starts, "tree")
        order = contracted.select("tree", "w", "a", "b", "part_a", "part_b", "entry", "start").groupBy("tree").applyInPandas(_walk, "tree long, part long, point long, weight double, nth long")
        size = placed.groupBy("part").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("tree").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        whole = trees.select("tree", F.col("first").alias("tree_first"), F.col("reachability").alias("tree_reachability"))
        trees = materialize(order.join(size, "part").withColumn("before", before).join(whole, "tree").select(
            F.col("part").alias("tree"), F.col("point").alias("entry"), "n", (F.col("tree_first") + F.col("before")).alias("first"),
            F.when(F.col("nth") == 0, F.col("tree_reachability")).otherwise(F.col("weight")).alias("reachability")), "walk-trees")
        edges = materialize(light.drop("tree").join(placed.select(F.col("cell_id").alias("a"), F.col("part").alias("tree")), "a").select("tree", "a", "b", "w"), "walk-edges")
        member = materialize(placed.select("cell_id", F.col("part").alias("tree")), "walk-member")


def density_ordering(points: DataFrame, min_samples: int = 5, piece: int = PIECE) -> DataFrame:
    """(cell_id, place, reachability) of (cell_id, vec)."""
    return ordering(spanning_tree(points, min_samples), points, piece)


def density_cut(tree: DataFrame, points: DataFrame, eps: float) -> DataFrame:
    """(cell_id, cluster): the tree without its edges heavier than ``eps``; what then is alone is noise (-1), a cluster is named by its smallest id."""
    parts = connected_components(tree.where(F.col("w") <= eps), "a", "b").select(F.col("node").alias("cell_id"), "component")
    return points.select("cell_id").join(parts, "cell_id", "left").select("cell_id", F.coalesce("component", F.lit(-1)).alias("cluster"))
