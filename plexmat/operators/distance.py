"""Distances and exact nearest neighbours between point sets.

Points are dealt into blocks; each pair of blocks meets in one task (an equi-join on the pair of blocks, never a
row-wise cross join) and is compared as matrices, so a task's memory is bounded by the block size. Every group has blocks of its own number, and a point
travels once for each block of the other side, so blocks are as large as a task can hold. Top-k results are cut inside each block
pair before they are merged.

Neighbours by Euclidean distance are screened by a matrix product, whose error is bounded; what may be among the nearest is measured by exact differences, so
results are those of comparing all pairs so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plexmat.session import materialize

#: Rows of a block whose pairs a task gives out one by one, and bytes of vectors in one whose pairs it reduces; up to SPREAD blocks a side are made of SMALL_BLOCK rows, so that small sets keep several tasks busy.
BLOCK = 2048
BLOCK_BYTES = 16 << 20
SMALL_BLOCK, SPREAD = 1024, 6
#: Block pairs of all groups together that neighbours are spread over, by smaller blocks on the left only.
PAIRS = 24
#: Rows and columns compared at a time inside a task.
TILE = (512, 4096)


def _euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(_sqeuclidean(a, b))


def _sqeuclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):  # exact differences: no cancellation between large norms
        d = a[:, k, None] - b[None, :, k]
        out += d * d
    return out


def _l1(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        out += np.abs(a[:, k, None] - b[None, :, k])
    return out


def _canberra(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        x, y = a[:, k, None], b[None, :, k]
        d = np.abs(x) + np.abs(y)
        out += np.divide(np.abs(x - y), d, out=np.zeros_like(d), where=d > 0)
    return out


def _ward(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ward distance of clusters given as centroid with the size as last component; of two single points it is Euclidean."""
    m, n = a[:, -1, None], b[None, :, -1]
    return np.sqrt(2 * m * n / (m + n) * _sqeuclidean(a[:, :-1], b[:, :-1]))


METRICS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"euclidean": _euclidean, "sqeuclidean": _sqeuclidean, "l1": _l1, "canberra": _canberra, "ward": _ward}


def distance(a: str, b: str, metric: str = "euclidean") -> Column:
    """The distance of two array columns as an expression, for pairs that are already joined."""
    x, y = F.col(a), F.col(b)
    add = lambda f: F.aggregate(F.zip_with(x, y, f), F.lit(0.0), lambda s, v: s + v)
    if metric == "l1":
        return add(lambda p, q: F.abs(p - q))
    if metric == "canberra":
        return add(lambda p, q: F.when(F.abs(p) + F.abs(q) > 0, F.abs(p - q) / (F.abs(p) + F.abs(q))).otherwise(0.0))
    square = add(lambda p, q: (p - q) * (p - q))
    return square if metric == "sqeuclidean" else F.sqrt(square)


def _dealt(points: DataFrame, side: str, groups: list[str], blocks: DataFrame, more: list[str] = ()) -> DataFrame:
    own, other = ("ba", "bb") if side == "a" else ("bb", "ba")
    dealt = points.join(blocks, groups) if groups else points.join(F.broadcast(blocks))
    return (
        dealt.withColumn(own, F.pmod(F.xxhash64("cell_id"), F.col(f"n_{own}")).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)))
        # new attributes: two sides of one lineage must not share them in a cogroup
        .select(*(F.col(c).alias(c) for c in (*groups, "ba", "bb", "cell_id", "vec", *more)))
    )


def _blocks(points: DataFrame, groups: list[str], block: int | None, name: str, spread: int = SPREAD) -> DataFrame:
    """(groups..., name): in how many blocks the points of a group are dealt."""
    per = points.groupBy(*groups).agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width"))
    rows = F.lit(block) if block else F.greatest(F.lit(SMALL_BLOCK), F.floor(BLOCK_BYTES / (8 * F.greatest(F.col("width"), F.lit(1)))))
    fewest = F.lit(1) if block else F.least(F.lit(spread), F.ceil(F.col("n") / SMALL_BLOCK))
    return per.select(*groups, F.greatest(F.lit(1), fewest, F.ceil(F.col("n") / rows)).cast("int").alias(name))


def _meeting(a: DataFrame, b: DataFrame, groups: list[str], block: int | None, more: list[str], spread: tuple[int, int], pairs: int | None) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt into blocks ``ba`` and ``bb``, once for each block of the other side."""
    if pairs:
        spread = (1, 1)
    one, two = _blocks(a, groups, block, "n_ba", spread[0]), _blocks(b, groups, block, "n_bb", spread[1])
    blocks = one.join(two, groups) if groups else one.crossJoin(two)
    if pairs:
        per = a.groupBy(*groups).agg(F.count("*").alias("n_a"))
        blocks = blocks.join(per, groups) if groups else blocks.crossJoin(per)
        share = F.ceil(pairs / (F.sum("n_bb").over(Window.partitionBy())))  # a row for each group: fits one task
        blocks = blocks.withColumn("n_ba", F.greatest("n_ba", F.least(share, F.ceil(F.col("n_a") / SMALL_BLOCK))).cast("int")).drop("n_a")
    blocks = materialize(blocks, "blocks")  # a row for each group
    return _dealt(a, "a", groups, blocks, more), _dealt(b, "b", groups, blocks, more)


def block_pairs(a: DataFrame, b: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, groups: list[str] = (), block: int | None = None, more: list[str] = (),
                spread: tuple[int, int] = (SPREAD, SPREAD), pairs: int | None = None) -> DataFrame:
    """Run ``kernel`` on every pair of blocks of (groups..., cell_id, vec, more...) with equal groups.

    Without ``block`` (rows of a block) blocks hold BLOCK_BYTES of vectors: for kernels that work tile by tile and give out fewer rows than pairs; up to
    ``spread`` blocks a side are made of SMALL_BLOCK rows. ``pairs`` takes the place of ``spread``: only blocks on the left are made smaller, until all groups
    together have about so many block pairs. Many groups then keep points from travelling often, and a left row meets few blocks.
    """
    groups = list(groups)
    left, right = _meeting(a, b, groups, block, more, spread, pairs)
    keys = [*groups, "ba", "bb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(kernel, schema)


def vectors(df: pd.DataFrame) -> np.ndarray:
    return np.array(df.vec.tolist(), float)


def tiles(x: np.ndarray, y: np.ndarray, metric: str) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, distances) of bounded parts of a matrix of distances."""
    rows, columns = TILE
    for r in range(0, len(x), rows):
        for c in range(0, len(y), columns):
            yield r, c, METRICS[metric](x[r : r + rows], y[c : c + columns])


class Screen:
    """Lower bounds of squared distances by one matrix product, up to a term of the row: ``low(rows, columns) <= bound(rows, squares)`` holds for every pair whose
    squared distance, as differences give it, isn't above ``squares``. The slack is several times the rounding of both."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.slack = 8 * (x.shape[1] + 8) * np.finfo(float).eps
        nx, ny = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
        self.nx = nx
        self.left = np.hstack([-2 * x, np.ones((len(x), 1))])
        self.right = np.ascontiguousarray(np.hstack([y, (ny * (1 - self.slack))[:, None]]).T)
        # beyond these, squares overflow or vanish
        self.usable = bool(len(x) and len(y)) and bool(np.isfinite(nx).all() and np.isfinite(ny).all()) and max(nx.max(), ny.max()) < 1e290

    def low(self, r: slice, c: slice) -> np.ndarray:
        return self.left[r] @ self.right[:, c]

    def bound(self, r: slice, squares: np.ndarray) -> np.ndarray:
        return squares * (1 + self.slack) - self.nx[r] * (1 - self.slack) + 1e-290


def exact_squares(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of single pairs, added up dimension by dimension as ``METRICS`` does."""
    out = np.zeros(len(i))
    for at in range(0, len(i), 1 << 18):
        part = slice(at, at + (1 << 18))
        for k in range(x.shape[1]):
            d = x[i[part], k] - y[j[part], k]
            out[part] += d * d
    return out


def _nearest_screened(x: np.ndarray, y: np.ndarray, k: int, same: tuple[np.ndarray, np.ndarray] | None, screen: Screen) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, squared distance) of the k nearest columns of every row; equal roots go to the smaller column. ``same`` holds ids of rows and columns that must differ."""
    out, (rows, columns) = [], TILE
    for r0 in range(0, len(x), rows):
        r = slice(r0, r0 + rows)
        n = len(x[r])
        best_i, best_j, best_d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        limit = np.full(n, np.inf)
        for c0 in range(0, len(y), columns):
            low = screen.low(r, slice(c0, c0 + columns))
            if not c0 and low.shape[1] > 4 * k:
                # a first limit from the nearest of a few columns, by their upper bounds
                few = max(512, 4 * k)
                up = low[:, :few] + screen.nx[r][:, None] + 2 * screen.slack * (screen.nx[r][:, None] + screen.right[-1, :few][None, :] / (1 - screen.slack)) + 1e-290
                if same is not None:
                    up[same[0][r][:, None] == same[1][:few][None, :]] = np.inf
                limit = np.partition(up, k - 1, axis=1)[:, k - 1]
            i, j = np.nonzero(low <= screen.bound(r, limit)[:, None])
            j = j + c0
            if same is not None:
                other = same[0][r0 + i] != same[1][j]
                i, j = i[other], j[other]
            if not len(i):
                continue
            d = exact_squares(x[r], y, i, j)
            best_i, best_j, best_d = np.concatenate([best_i, i]), np.concatenate([best_j, j]), np.concatenate([best_d, d])
            order = np.lexsort((best_j, np.sqrt(best_d), best_i))
            best_i, best_j, best_d = best_i[order], best_j[order], best_d[order]
            start = np.searchsorted(best_i, np.arange(n))
            place = np.arange(len(best_i)) - start[best_i]
            kept = place < k
            full = best_i[place == k - 1]
            limit[full] = best_d[place == k - 1]
            # columns come by id: nothing later is nearer than 0
            limit[full[limit[full] == 0]] = -np.inf
            best_i, best_j, best_d = best_i[kept], best_j[kept], best_d[kept]
        out.append((best_i + r0, best_j, best_d))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def nearest(x: np.ndarray, y: np.ndarray, k: int, metric: str, same: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of the k nearest columns of every row at finite distances, ties to the smaller column."""
    if metric in ("euclidean", "sqeuclidean"):
        screen = Screen(x, y)
        if screen.usable:
            i, j, d = _nearest_screened(x, y, k, same, screen)
            return i, j, np.sqrt(d) if metric == "euclidean" else d
    out = []
    for r0 in range(0, len(x), TILE[0]):
        part = slice(r0, r0 + TILE[0])
        near, least = np.empty((len(x[part]), 0), np.int64), np.empty((len(x[part]), 0))
        for c0 in range(0, len(y), TILE[1]):
            d = METRICS[metric](x[part], y[c0 : c0 + TILE[1]])
            if same is not None:
                d[same[0][part][:, None] == same[1][None, c0 : c0 + TILE[1]]] = np.inf
            d = np.hstack([least, d])
            at = np.hstack([near, np.broadcast_to(np.arange(c0, c0 + d.shape[1] - least.shape[1]), (len(d), d.shape[1] - least.shape[1]))])
            order = np.argsort(d, axis=1, kind="stable")[:, :k]
            near, least = np.take_along_axis(at, order, 1), np.take_along_axis(d, order, 1)
        i, slot = np.nonzero(np.isfinite(least))
        out.append((i + r0, near[i, slot], least[i, slot]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def in_reach(x: np.ndarray, y: np.ndarray, eps: float, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of the pairs not farther apart than eps, tile by tile."""
    screen = Screen(x, y) if metric == "euclidean" and eps >= 0 else None
    if screen is None or not screen.usable:
        for r, c, d in tiles(x, y, metric):
            i, j = np.nonzero(d <= eps)
            yield i + r, j + c, d[i, j]
        return
    for r0 in range(0, len(x), TILE[0]):
        r = slice(r0, r0 + TILE[0])
        bound = screen.bound(r, np.full(len(x[r]), eps * eps))[:, None]
        for c0 in range(0, len(y), TILE[1]):
            i, j = np.nonzero(screen.low(r, slice(c0, c0 + TILE[1])) <= bound)
            d = np.sqrt(exact_squares(x[r], y, i, j + c0))
            ok = d <= eps
            yield i[ok] + r0, j[ok] + c0, d[ok]


def _types(df: DataFrame, groups: list[str]) -> str:
    return "".join(f"{g} {df.schema[g].dataType.simpleString()}, " for g in groups)


def pairwise(a: DataFrame, b: DataFrame, metric: str = "euclidean", groups: list[str] = (), once: bool = False, more: list[str] = ()) -> DataFrame:
    """(groups..., src, dst, dist) of all pairs; ``once``: those with src < dst. Columns ``more`` of both sides follow, as src_... and dst_....

    Blocks hold BLOCK_BYTES, so that points travel seldom; the rows of a pair of blocks leave the task tile by tile.
    """
    groups, f = list(groups), METRICS[metric]

    def given(x: pd.DataFrame, y: pd.DataFrame) -> Iterator[pd.DataFrame]:
        u, v, src, dst = vectors(x), vectors(y), x.cell_id.to_numpy(), y.cell_id.to_numpy()
        for r in range(0, len(x), TILE[0]):
            for c in range(0, len(y), BLOCK):
                d = f(u[r : r + TILE[0]], v[c : c + BLOCK])
                i, j = np.nonzero(src[r : r + TILE[0], None] < dst[None, c : c + BLOCK]) if once else np.indices(d.shape).reshape(2, -1)
                out = pd.DataFrame({"src": src[r + i], "dst": dst[c + j], "dist": d[i, j]})
                for name in more:
                    out[f"src_{name}"], out[f"dst_{name}"] = x[name].to_numpy()[r + i], y[name].to_numpy()[c + j]
                for g in reversed(groups):
                    out.insert(0, g, x[g].iloc[0])
                yield out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True)
        left = (pdf.side == 0).to_numpy()
        if left.any() and not left.all():
            yield from given(pdf[left], pdf[~left])

    kinds = "".join(f", src_{c} {a.schema[c].dataType.simpleString()}, dst_{c} {b.schema[c].dataType.simpleString()}" for c in more)
    left, right = _meeting(a, b, groups, None, list(more), (SPREAD, SPREAD), PAIRS)
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    return both.groupBy(*groups, "ba", "bb").applyInPandas(run, _types(a, groups) + "src long, dst long, dist double" + kinds)


def knn(a: DataFrame, b: DataFrame, k: int, metric: str = "euclidean", groups: list[str] = (), exclude_self: bool = False) -> DataFrame:
    """(groups..., src, dst, dist, rank): the k nearest of b for every row of a, ties to the smaller id."""
    groups = list(groups)

    def kernel(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame()
        y = y.sort_values("cell_id", ignore_index=True)
        src, ids = x.cell_id.to_numpy(), y.cell_id.to_numpy()
        i, j, dist = nearest(vectors(x), vectors(y), k, metric, (src, ids) if exclude_self else None)
        out = pd.DataFrame({"src": src[i], "dst": ids[j], "dist": dist})
        for g in reversed(groups):
            out.insert(0, g, x[g].iloc[0])
        return out

    found = block_pairs(a, b, kernel, _types(a, groups) + "src long, dst long, dist double", groups, pairs=PAIRS)
    w = Window.partitionBy(*groups, "src").orderBy("dist", "dst")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def within(a: DataFrame, b: DataFrame, eps: float, metric: str = "euclidean") -> DataFrame:
    """(src, dst, dist) of the pairs not farther apart than eps, self included."""

    def kernel(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame()
        i, j, d = (np.concatenate(z) for z in zip(*in_reach(vectors(x), vectors(y), eps, metric), strict=True))
        return pd.DataFrame({"src": x.cell_id.to_numpy()[i], "dst": y.cell_id.to_numpy()[j], "dist": d})

    return block_pairs(a, b, kernel, "src long, dst long, dist double", block=BLOCK)


def mean_nearest(a: DataFrame, b: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(a_to_b, b_to_a, mean): mean distance to the nearest point of the other set, both ways."""
    one = lambda x, y, name: knn(x, y, 1, metric).agg(F.avg("dist").alias(name))
    return one(a, b, "a_to_b").join(one(b, a, "b_to_a")).withColumn("mean", (F.col("a_to_b") + F.col("b_to_a")) / 2)


def grid_centres(points: DataFrame, n: int) -> DataFrame:
    """The real point nearest to each centre of an n by n grid over the first two dimensions: (gx, gy, cell_id, dist)."""
    x, y = F.col("vec")[0], F.col("vec")[1]
    box = points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    axis = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = box.withColumn("gx", axis).withColumn("gy", axis)
    centre = lambda g, lo, hi: F.col(lo) + (F.col(g) + 0.5) * (F.col(hi) - F.col(lo)) / n
    # n * n rows, a parameter: safe to broadcast
    pairs = points.select("cell_id", x.alias("px"), y.alias("py")).join(F.broadcast(grid))
    d = F.sqrt(F.pow(F.col("px") - centre("gx", "x0", "x1"), 2) + F.pow(F.col("py") - centre("gy", "y0", "y1"), 2))
    return pairs.withColumn("dist", d).groupBy("gx", "gy").agg(F.min_by("cell_id", F.struct("dist", "cell_id")).alias("cell_id"), F.min("dist").alias("dist"))
