"""Cheapest matchings of pairs of any size, proved by duals that hold for all pairs of points.

A task holds the edges that may matter (near points, some others) of one pair of point sets, never all costs: it matches along them by an auction whose bids
get finer, down to ``FINEST`` of the mean nearest cost. The prices are then held against all pairs of points, block pair by block pair, and pairs that
would pay join the edges, until there are none. The cost is then at most points * ``FINEST`` times the mean nearest cost above that of a cheapest matching.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plexmat.operators.distance import PAIRS, TILE, Screen, block_pairs, distance, exact_squares, nearest, tiles, vectors
from plexmat.session import materialize

#: Nearest points of either side that start as edges, complete matchings that start as edges, edges that a point may gain in a step.
NEAR, SHIFTS, GAINED = 12, 6, 8
#: Least raise of a bid, as a share of the mean nearest cost: of the first step, the second, and those that settle the matching.
FIRST, SECOND = (0.3, 0.1, 0.03, 0.01, 0.003, 0.001, 3e-4), (1e-3, 3e-4)
FINEST = 1e-12
LATER = (3e-4, 1e-4, 1e-5, 1e-6, 1e-7, 1e-8, 1e-9, 1e-10, 1e-11, FINEST)
#: Pairs whose reduced cost lies below this share of the mean nearest cost join the edges; below ``-WRONG`` of it they refute the prices.
MARGIN, WRONG = 0.02, 1e-9


class Edges:
    """Rows' edges to columns, at most one for each pair."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, cost: np.ndarray, n: int, m: int):
        first = np.unique(rows.astype(np.int64) * m + columns, return_index=True)[1]
        self.columns, self.cost = columns[first], cost[first]
        self.size = np.bincount(rows[first], minlength=n)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edges of the rows one after the other, where each row's begin, their number)."""
        size = self.size[rows]
        begin = np.cumsum(size) - size
        return np.arange(size.sum()) + np.repeat(self.start[rows] - begin, size), begin, size


def auction(edges: Edges, price: np.ndarray, partner: np.ndarray, raises: list[float]) -> None:
    """Match every row to a column of its own, ``price`` and ``partner`` (-1: none) in place: no row could do better at the prices by more than the last raise.

    The larger side's surplus is held by bidders that take any column for nothing, so that its columns end at the least price. Rows without enough edges are left alone
    after many rounds; the prices then show which edges they need.
    """
    n, m = len(partner), len(price)
    everyone = np.arange(n)
    for least in raises:
        at, begin, size = edges.of(everyone)
        value = edges.cost[at] + price[edges.columns[at]]
        best = np.minimum.reduceat(value, begin)
        kept = np.full(n, np.inf)
        own = edges.columns[at] == np.repeat(partner, size)
        kept[np.repeat(everyone, size)[own]] = value[own]
        partner[kept > best + least] = -1
        owner = np.full(m, -1)
        matched = np.flatnonzero(partner >= 0)
        owner[partner[matched]] = matched
        free, idle = np.flatnonzero(partner < 0), 0
        if m > n:
            rest = np.flatnonzero(owner < 0)
            held = rest[price[rest] <= price.min() + least][: m - n]
            owner[held], idle = n, m - n - len(held)
        rounds = 0
        while len(free) or idle:
            rounds += 1
            if rounds > 100 * n + 1_000_000:
                break
            if not len(free):
                low = np.argpartition(price, idle)[: idle + 1]
                low = low[np.argsort(price[low], kind="stable")]
                took, level = low[:-1], price[low[-1]] + least
                out = owner[took]
                owner[took], price[took] = n, level
                idle = int((out == n).sum())
                free = out[(out >= 0) & (out < n)]
                partner[free] = -1
                continue
            at, begin, size = edges.of(free)
            value = edges.cost[at] + price[edges.columns[at]]
            best = np.minimum.reduceat(value, begin)
            ties = np.flatnonzero(value == np.repeat(best, size))
            pick = ties[np.searchsorted(ties, begin)]
            column = edges.columns[at[pick]]
            value[pick] = np.inf
            second = np.minimum.reduceat(value, begin)
            # a row with one edge bids what no other would
            bid = price[column] + np.where(np.isfinite(second), second - best, np.abs(best) + 1.0) + least
            order = np.lexsort((bid, column))
            top = order[np.append(column[order][1:] != column[order][:-1], True)]
            out = owner[column[top]]
            owner[column[top]], price[column[top]], partner[free[top]] = free[top], bid[top], column[top]
            lost = np.ones(len(free), bool)
            lost[top] = False
            idle += int((out == n).sum())
            out = out[(out >= 0) & (out < n)]
            partner[out] = -1
            free = np.concatenate([free[lost], out])


def _settled(nodes: pd.DataFrame, edges: pd.DataFrame, raises: tuple[float, ...]) -> pd.DataFrame:
    """``nodes`` (side, cell_id, partner, dual, dist, scale) of one pair matched along its edges (cell_a, cell_b, dist)."""
    a, b = (nodes[nodes.side == s].sort_values("cell_id", ignore_index=True) for s in (0, 1))
    i, j = np.searchsorted(a.cell_id, edges.cell_a), np.searchsorted(b.cell_id, edges.cell_b)
    turned = len(a) > len(b)
    if turned:
        a, b, i, j = b, a, j, i
    near = Edges(i, j, edges.dist.to_numpy(float), len(a), len(b))
    price, known = -b.dual.to_numpy(float), a.partner.notna().to_numpy()
    partner = np.full(len(a), -1)
    partner[known] = np.searchsorted(b.cell_id, a.partner[known].astype("int64"))
    auction(near, price, partner, [x * float(a.scale.iloc[0]) for x in raises])
    price -= price.min()
    at, begin, size = near.of(np.arange(len(a)))
    pays = np.minimum.reduceat(near.cost[at] + price[near.columns[at]], begin)
    own, who = np.flatnonzero(near.columns[at] == np.repeat(partner, size)), np.repeat(np.arange(len(a)), size)
    cost = np.full(len(a), np.nan)
    cost[who[own]] = near.cost[at[own]]
    back, has = np.full(len(b), -1), np.flatnonzero(partner >= 0)
    back[partner[has]] = has
    one = a.assign(partner=pd.Series(np.where(partner >= 0, b.cell_id.to_numpy()[partner], 0), dtype="Int64").where(partner >= 0), dual=pays, dist=cost)
    two = b.assign(partner=pd.Series(np.where(back >= 0, a.cell_id.to_numpy()[back], 0), dtype="Int64").where(back >= 0), dual=-price, dist=np.where(back >= 0, cost[back], np.nan))
    return pd.concat([one, two], ignore_index=True)


def _near(a: DataFrame, b: DataFrame, pair: str, metric: str) -> DataFrame:
    """(pair, cell_a, cell_b, dist, rank_a, rank_b): the NEAR nearest points of either side."""

    def kernel(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame()
        x, y = x.sort_values("cell_id", ignore_index=True), y.sort_values("cell_id", ignore_index=True)
        u, v = vectors(x), vectors(y)
        i, j, d = nearest(u, v, NEAR, metric)
        q, p, e = nearest(v, u, NEAR, metric)
        out = pd.DataFrame({"cell_a": x.cell_id.to_numpy()[np.concatenate([i, p])], "cell_b": y.cell_id.to_numpy()[np.concatenate([j, q])], "dist": np.concatenate([d, e]), "side": np.repeat([0, 1], [len(i), len(q)])})
        out.insert(0, pair, x[pair].iloc[0])
        return out

    found = block_pairs(a, b, kernel, f"{pair} {a.schema[pair].dataType.simpleString()}, cell_a long, cell_b long, dist double, side int", [pair], pairs=PAIRS)
    own, other = F.when(F.col("side") == 0, F.col("cell_a")).otherwise(F.col("cell_b")), F.when(F.col("side") == 0, F.col("cell_b")).otherwise(F.col("cell_a"))
    rank = F.row_number().over(Window.partitionBy(pair, "side", own).orderBy("dist", other))
    return found.withColumn("rank", rank).where(F.col("rank") <= NEAR)


def _complete(a: DataFrame, b: DataFrame, pair: str, metric: str) -> DataFrame:
    """(pair, cell_a, cell_b, dist) of some complete matchings: points of equal rank by a hash, the larger side's ranks shifted."""
    place = lambda d: d.select(pair, "cell_id", (F.row_number().over(Window.partitionBy(pair).orderBy(F.xxhash64("cell_id"), "cell_id")) - 1).alias("place"))
    sizes = a.groupBy(pair).agg(F.count("*").alias("na")).join(b.groupBy(pair).agg(F.count("*").alias("nb")), pair)

    def side(d: DataFrame, own: str, other: str, first: bool) -> DataFrame:
        moves = F.col(own) <= F.col(other) if first else F.col(own) < F.col(other)
        shifts = F.transform(F.sequence(F.lit(0), F.lit(SHIFTS - 1)), lambda s: (F.col("place") + F.floor(s * F.col(other) / SHIFTS)) % F.col(other))
        at = place(d).join(F.broadcast(sizes), pair).select(pair, "cell_id", F.explode(F.when(moves, shifts).otherwise(F.array(F.col("place").cast("long")))).alias("at"))
        return at.join(d.hint("merge"), [pair, "cell_id"])

    x = side(a, "na", "nb", True).select(pair, "at", F.col("cell_id").alias("cell_a"), F.col("vec").alias("va"))
    y = side(b, "nb", "na", False).select(pair, "at", F.col("cell_id").alias("cell_b"), F.col("vec").alias("vb"))
    return x.join(y.hint("merge"), [pair, "at"]).select(pair, "cell_a", "cell_b", distance("va", "vb", metric).alias("dist"))


def _underpriced(a: DataFrame, b: DataFrame, nodes: DataFrame, pair: str, metric: str, barred: DataFrame | None, most: int) -> DataFrame:
    """(pair, cell_a, cell_b, dist, slack, margin): of all pairs of points those whose distance is less than ``margin`` above their duals, at most ``most`` for each point of a."""

    def priced(points: DataFrame, side: int) -> DataFrame:
        duals = nodes.where(F.col("side") == side).select(pair, "cell_id", "dual", (MARGIN * F.col("scale")).alias("margin"))
        # margin and dual travel as the last components
        return points.join(duals.hint("merge"), [pair, "cell_id"]).select(pair, "cell_id", F.concat("vec", F.array("margin", "dual")).alias("vec"))

    def kernel(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame()
        p, q = vectors(x), vectors(y)
        u, v, margin = p[:, -1], q[:, -1], p[:, -2]
        p, q = np.ascontiguousarray(p[:, :-2]), np.ascontiguousarray(q[:, :-2])
        screen = Screen(p, q) if metric == "euclidean" else None
        out = []
        for r0 in range(0, len(p), TILE[0]):
            r, found = slice(r0, r0 + TILE[0]), []
            for c0 in range(0, len(q), TILE[1]):
                c = slice(c0, c0 + TILE[1])
                reach = (u[r] + margin[r])[:, None] + v[c]
                if screen is not None and screen.usable:
                    i, j = np.nonzero((reach > 0) & (screen.low(r, c) - screen.bound(r, np.zeros(len(u[r])))[:, None] <= reach * reach * (1 + 2 * screen.slack)))
                    d = np.sqrt(exact_squares(p[r], q, i, j + c0))
                else:
                    all_ = next(tiles(p[r], q[c], metric))[2]
                    i, j = np.nonzero(all_ < reach)
                    d = all_[i, j]
                slack = d - u[r0 + i] - v[c0 + j]
                low = slack < margin[r0 + i]
                found.append((i[low] + r0, j[low] + c0, d[low], slack[low]))
            i, j, d, slack = (np.concatenate(z) for z in zip(*found, strict=True))
            order = np.lexsort((j, slack, i))
            i = i[order]
            few = order[np.arange(len(i)) - np.searchsorted(i, i) < most]
            out.append(tuple(np.concatenate([f[k] for f in found])[few] for k in range(4)))
        i, j, d, slack = (np.concatenate(z) for z in zip(*out, strict=True))
        done = pd.DataFrame({"cell_a": x.cell_id.to_numpy()[i], "cell_b": y.cell_id.to_numpy()[j], "dist": d, "slack": slack, "margin": margin[i]})
        done.insert(0, pair, x[pair].iloc[0])
        return done

    schema = f"{pair} {a.schema[pair].dataType.simpleString()}, cell_a long, cell_b long, dist double, slack double, margin double"
    found = block_pairs(priced(a, 0), priced(b, 1), kernel, schema, [pair], pairs=PAIRS)
    if barred is not None:
        found = found.join(barred.hint("merge"), [pair, "cell_a", "cell_b"], "left_anti")
    rank = F.row_number().over(Window.partitionBy(pair, "cell_a").orderBy("slack", "cell_b"))
    return materialize(found.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank"), "match-priced")


def cheapest(a: DataFrame, b: DataFrame, pair: str = "pair", metric: str = "euclidean", barred: DataFrame | None = None, bars: int = 0) -> tuple[DataFrame, DataFrame]:
    """((pair, side, cell_id, partner, dual, dist, scale) of all points, (pair, slack): the least distance above the duals where there is one near 0).

    ``a`` (side 0) and ``b`` (side 1) are (pair, cell_id, vec), pairs without points on one side are left out; ``barred`` are (pair, cell_a, cell_b) that must not be
    matched, at most ``bars`` for a point. Duals bound all pairs that aren't barred, but for ``WRONG`` of the mean nearest cost, the larger side's aren't above 0, and those of its surplus are 0.
    """
    kind = a.schema[pair].dataType.simpleString()
    a, b = (d.select(pair, "cell_id", F.col("vec").cast("array<double>").alias("vec")) for d in (a, b))
    a, b = (materialize(d.join(e.select(pair).distinct(), pair, "left_semi"), "match-points") for d, e in ((a, b), (b, a)))
    near = materialize(_near(a, b, pair, metric), "match-near")
    edges = near.select(pair, "cell_a", "cell_b", "dist").unionByName(_complete(a, b, pair, metric))
    edges = materialize(edges if barred is None else edges.join(barred.hint("merge"), [pair, "cell_a", "cell_b"], "left_anti"), "match-edges")
    mean = near.where("side = 0 AND rank = 1").groupBy(pair).agg(F.avg("dist").alias("s")).join(edges.groupBy(pair).agg(F.avg("dist").alias("t")), pair)
    scale = mean.select(pair, F.when(F.col("s") > 0, F.col("s")).when(F.col("t") > 0, F.col("t")).otherwise(1.0).alias("scale"))
    point = lambda d, side: d.select(pair, F.lit(side).alias("side"), "cell_id")
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    nodes = point(a, 0).unionByName(point(b, 1)).join(F.broadcast(scale), pair).select(pair, "side", "cell_id", none("partner", "long"), F.lit(0.0).alias("dual"), none("dist", "double"), "scale")
    schema = f"{pair} {kind}, side int, cell_id long, partner long, dual double, dist double, scale double"
    columns = [pair, "side", "cell_id", "partner", "dual", "dist", "scale"]

    def settling(raises: tuple[float, ...]):
        return lambda x, y: _settled(x, y, raises)[columns] if len(x) and len(y) else pd.DataFrame()

    done, proofs, step = None, None, 0
    while True:
        raises = (FIRST, SECOND)[step] if step < 2 else LATER
        nodes = materialize(nodes.groupBy(pair).cogroup(edges.groupBy(pair)).applyInPandas(settling(raises), schema), "match-nodes")
        found = _underpriced(a, b, nodes, pair, metric, barred, GAINED + bars)
        step += 1
        if step > 2:
            wrong = found.where(F.col("slack") < -F.col("margin") * (WRONG / MARGIN)).select(pair)
            sizes = nodes.groupBy(pair).agg(F.count_if(F.col("side") == 0).alias("na"), F.count_if(F.col("side") == 1).alias("nb"), F.count_if((F.col("side") == 0) & F.col("partner").isNotNull()).alias("n"))
            open_ = materialize(wrong.unionByName(sizes.where(F.col("n") < F.least("na", "nb")).select(pair)).distinct(), "match-open")
            settled = lambda d: d.join(F.broadcast(open_), pair, "left_anti")
            ready, proof = settled(nodes), settled(found).groupBy(pair).agg(F.min("slack").alias("slack"))
            done, proofs = (ready, proof) if done is None else (done.unionByName(ready), proofs.unionByName(proof))
            if open_.isEmpty():
                return done, proofs
            a, b, nodes, found, edges = (d.join(F.broadcast(open_), pair, "left_semi") for d in (a, b, nodes, found, edges))
        edges = edges.unionByName(found.select(pair, "cell_a", "cell_b", "dist"))
