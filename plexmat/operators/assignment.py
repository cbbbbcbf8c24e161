"""One-to-one matching of point sets, cheapest by the sum of distances.

A pair of at most ``MAX_SIDE`` points a side is solved by one task with all its costs, the pairs spread over the cluster. Larger pairs are matched along the edges that
matter, with prices that are held against all pairs of points (``pricing``): the same matching, up to ties. ``match_in_rounds`` is quicker and not exact: matched couples are dealt
into blocks of neighbours, every block is solved exactly by a task, and the next round deals them otherwise. The matching is complete after every round and
its cost never rises; it is not proven cheapest, but ``lower_bound`` says how far from it it can be at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plexmat.operators.distance import METRICS, block_pairs, tiles, vectors
from plexmat.operators.pricing import cheapest
from plexmat.session import discard, materialize

MAX_SIDE = 4000
#: Couples solved together in a round, landmarks that say which are neighbours, most rounds, and the gain of two rounds that ends them.
BLOCK = 500
LANDMARKS = 48
ROUNDS = 24
LEAST_GAIN = 0.002
BARRED = 1e18


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a cheapest matching."""
    return solve(cost)[:2]


def _started(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column prices, row of each column or -1): a first matching of rows with their cheapest columns at feasible prices, improved by giving rows their second choice.

    Prices of columns without a row are 0 where columns are left over.
    """
    n, m = cost.shape
    v = cost.min(axis=0) if n == m else np.zeros(m)
    owner = np.full(m, -1)
    taken, first = np.unique((cost - v).argmin(axis=1), return_index=True)
    owner[taken] = first
    free = np.setdiff1d(np.arange(n), first).tolist()
    for _ in range(2):
        left, steps = [], 0
        free.reverse()
        while free:
            i, steps = free.pop(), steps + 1
            if steps > 4 * n:  # near ties pass rows to and fro
                left += [i, *free]
                break
            rest = cost[i] - v
            j = int(rest.argmin())
            best = rest[j]
            rest[j] = np.inf
            k = int(rest.argmin()) if m > 1 else j
            gain = rest[k] - best if m > 1 else 0.0
            strict = bool(gain > 0 and np.isfinite(gain))
            if strict:
                v[j] -= gain
            elif owner[j] >= 0 and m > 1:
                j = k
            out, owner[j] = owner[j], i
            if out >= 0:
                (free if strict else left).append(int(out))
        free = left
    return v, owner


def solve(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, row potentials, column potentials): shortest augmenting paths with potentials, a row vector at a time, for the rows that a first matching leaves out."""
    if cost.shape[0] > cost.shape[1]:
        columns, rows, v, u = solve(cost.T)
        order = np.argsort(rows)
        return rows[order], columns[order], u, v
    n, m = cost.shape
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(0), np.zeros(m)
    cost = np.ascontiguousarray(cost)
    v, owner = _started(cost)
    u, column_of = np.zeros(n), np.full(n, -1)
    at = np.flatnonzero(owner >= 0)
    column_of[owner[at]] = at
    u[owner[at]] = cost[owner[at], at] - v[at]
    way = np.zeros(m, np.int64)
    for start in np.flatnonzero(column_of < 0).tolist():
        u[start] = (cost[start] - v).min()
        least, closed, reached, i, base = np.full(m, np.inf), np.zeros(m), [], start, 0.0
        while True:
            there = cost[i] - v
            there += base - u[i]
            there += closed
            better = there < least
            np.copyto(least, there, where=better)
            way[better] = i
            j = int(least.argmin())
            if not np.isfinite(least[j]):  # nothing can be reached: any free column
                j = int(np.flatnonzero(owner < 0)[0])
                way[j], base, reached = start, 0.0, []
                break
            base = least[j]
            if owner[j] < 0:
                break
            reached.append((j, base))
            least[j], closed[j] = np.inf, np.inf
            i = owner[j]
        u[start] += base
        for k, d in reached:
            u[owner[k]] += base - d
            v[k] -= base - d
        while True:
            i = way[j]
            owner[j], column_of[i], j = i, j, column_of[i]
            if i == start:
                break
    order = np.arange(n)
    return order, column_of[order], u, v


def _cost(x: pd.DataFrame, y: pd.DataFrame, metric: str) -> np.ndarray:
    if max(len(x), len(y)) > MAX_SIDE:
        raise ValueError(f"a side of {max(len(x), len(y))} points is beyond {MAX_SIDE}")
    cost = np.empty((len(x), len(y)))
    for r, c, d in tiles(np.array(x.vec.tolist()), np.array(y.vec.tolist()), metric):
        cost[r : r + d.shape[0], c : c + d.shape[1]] = d
    return cost


def match_pairs(a: DataFrame, b: DataFrame, pair: str = "pair", metric: str = "euclidean", folds: int = 1, max_side: int = MAX_SIDE) -> DataFrame:
    """(pair, cell_a, cell_b, dist, fold): the cheapest matching within every pair; further folds bar the matches of those before.

    ``a`` and ``b`` are (pair, cell_id, vec); with unequal sides the surplus stays unmatched. Pairs of more than ``max_side`` points a side
    are matched by ``pricing``, to the same cost.
    """

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame()
        x, y = x.sort_values("cell_id", ignore_index=True), y.sort_values("cell_id", ignore_index=True)
        cost = _cost(x, y, metric)
        barred, out = cost.copy() if folds > 1 else cost, []
        for fold in range(min(folds, max(cost.shape))):
            r, c = assign(barred)
            ok = np.isfinite(cost[r, c]) & (barred[r, c] < BARRED / 10)
            r, c = r[ok], c[ok]
            out.append(pd.DataFrame({pair: x[pair].iloc[0], "cell_a": x.cell_id.to_numpy()[r], "cell_b": y.cell_id.to_numpy()[c], "dist": cost[r, c], "fold": fold}))
            if fold + 1 < folds:
                barred[r, c] = BARRED
        return pd.concat(out)

    kind = a.schema[pair].dataType.simpleString()
    left, right = (d.select(*(F.col(c).alias(c) for c in (pair, "cell_id", "vec"))) for d in (a, b))
    large = left.select(pair, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(pair, F.lit(0).alias("l"), F.lit(1).alias("r"))).groupBy(pair).agg(
        F.sum("l").alias("l"), F.sum("r").alias("r")).where(F.greatest("l", "r") > max_side)
    beyond = None
    if large.limit(1).count():
        large = materialize(large.select(pair), "match-large")
        beyond = _folds_by_prices(left.join(large, pair, "left_semi"), right.join(large, pair, "left_semi"), pair, metric, folds)
        left, right = left.join(large, pair, "left_anti"), right.join(large, pair, "left_anti")
        left, right = (d.select(*(F.col(c).alias(c) for c in (pair, "cell_id", "vec"))) for d in (left, right))
    exact = left.groupBy(pair).cogroup(right.groupBy(pair)).applyInPandas(run, f"{pair} {kind}, cell_a long, cell_b long, dist double, fold int")
    return exact if beyond is None else exact.unionByName(beyond)


def _nearest_landmarks(landmarks: np.ndarray, metric: str):
    """The two nearest landmarks of a vector as one number."""

    @F.pandas_udf("long")
    def place(vec: pd.Series) -> pd.Series:
        if not len(vec):
            return pd.Series([], dtype="int64")
        near = np.argsort(METRICS[metric](np.array(vec.tolist()), landmarks), axis=1, kind="stable")
        return pd.Series(near[:, 0] * len(landmarks) + near[:, min(1, len(landmarks) - 1)])

    return place


def _solved_couples(pdf: pd.DataFrame, metric: str) -> pd.DataFrame:
    """The points of one block matched anew: couples, the larger side's surplus with null partners, and the duals of b."""
    a, b = pdf[pdf.cell_a.notna()].reset_index(drop=True), pdf[pdf.cell_b.notna()].reset_index(drop=True)
    out = pd.DataFrame({"cell_a": a.cell_a, "vec_a": a.vec_a, "barred": a.barred})
    for c in ("cell_b", "vec_b", "dist"):
        out[c] = None
    out["price_a"], out["price_b"] = 0.0, 0.0
    surplus = b.iloc[:0]
    if len(a) and len(b):
        cost = METRICS[metric](np.array(a.vec_a.tolist()), np.array(b.vec_b.tolist()))
        column = {int(x): j for j, x in enumerate(b.cell_b)}
        for i, barred in enumerate(a.barred):
            for x in barred if barred is not None else ():
                if x in column:
                    cost[i, column[x]] = BARRED
        r, c, u, v = solve(cost)
        partner = np.full(len(a), -1)
        partner[r] = c
        has = partner >= 0
        out.loc[has, "cell_b"] = b.cell_b.to_numpy()[partner[has]]
        out["vec_b"] = pd.Series([b.vec_b[j] if j >= 0 else None for j in partner], dtype=object)
        out.loc[has, "dist"] = cost[np.flatnonzero(has), partner[has]]
        out["price_a"] = u
        out.loc[has, "price_b"] = v[partner[has]]
        surplus = b.drop(index=c)
    elif len(b):
        surplus = b
    if len(surplus):
        rest = pd.DataFrame({"cell_b": surplus.cell_b, "vec_b": surplus.vec_b})
        for c in ("cell_a", "vec_a", "barred", "dist"):
            rest[c] = None
        rest["price_a"], rest["price_b"] = 0.0, 0.0
        out = pd.concat([out, rest], ignore_index=True) if len(out) else rest
    for c in ("cell_a", "cell_b"):
        out[c] = out[c].astype("Int64")
    out["dist"] = out["dist"].astype("Float64")
    return out


def _in_order(points: DataFrame, pair: str, parts: int, by: tuple[str, ...] = ("place", "cell_id")) -> DataFrame:
    """``points`` with their place in the order of ``by`` within the pair: ranks within ranges, and the sizes of the ranges before."""
    d = materialize(points.repartitionByRange(parts, pair, *by).withColumn("part", F.spark_partition_id()), "match-order")
    sizes = d.groupBy(pair, "part").agg(F.count("*").alias("n"))
    before = sizes.select(pair, "part", F.coalesce(F.sum("n").over(Window.partitionBy(pair).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy(pair, "part").orderBy(*by))
    return d.withColumn("rank", rank).join(before, [pair, "part"]).withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before", "place")


def match_in_rounds(a: DataFrame, b: DataFrame, pair: str = "pair", metric: str = "euclidean", block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """(pair, cell_a, vec_a, barred, cell_b, vec_b, dist, price_a, price_b): couples and the surplus of the larger side, whatever the size of the pair.

    ``a`` is (pair, cell_id, vec, barred), barred being cells of b that must not be its partner, ``b`` (pair, cell_id, vec). The start couples points of equal rank in the order of
    their nearest landmarks. A round orders couples by the landmarks nearest to their point of a, the next one to that of b, with landmarks drawn
    anew, and solves runs of ``block`` couples exactly. Rounds end when two of them gain less than ``LEAST_GAIN`` of the cost. Prices are the duals of the last round's blocks.
    """
    spark = a.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    kind = a.schema[pair].dataType.simpleString()
    schema = f"{pair} {kind}, cell_a long, vec_a array<double>, barred array<long>, cell_b long, vec_b array<double>, dist double, price_a double, price_b double"
    columns = [pair, "cell_a", "vec_a", "barred", "cell_b", "vec_b", "dist", "price_a", "price_b"]

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        return _solved_couples(pdf, metric).assign(**{pair: pdf[pair].iloc[0]})[columns]

    def drawn(df: DataFrame) -> np.ndarray:
        """Vectors of points for the landmarks of all rounds: one small table reaches the driver, not the first rows of every task in every round."""
        few = df.select("cell_id", "vec").orderBy(F.xxhash64(F.lit(-1), "cell_id"), "cell_id").limit(LANDMARKS * (rounds // 2 + 2))
        return np.array(list({r.cell_id: r.vec for r in materialize(few, "match-landmarks").collect()}.values()), float)

    def landmarks(i: int, own: str) -> np.ndarray:
        """Those of one round, of side ``own`` (of the other, if it is empty)."""
        points = marks[own] if len(marks[own]) else marks["b" if own == "a" else "a"]
        return points[(i * LANDMARKS + np.arange(min(LANDMARKS, len(points)))) % len(points)]

    a = a.select(pair, "cell_id", F.col("vec").cast("array<double>").alias("vec"), "barred")
    b = b.select(pair, "cell_id", F.col("vec").cast("array<double>").alias("vec"))
    marks = {"a": drawn(a), "b": drawn(b)}
    if not len(marks["a"]) and not len(marks["b"]):
        return spark.createDataFrame([], schema)
    place = _nearest_landmarks(landmarks(0, "a"), metric)
    left = _in_order(a.withColumn("place", place("vec")), pair, parts).select(pair, "rank", F.col("cell_id").alias("cell_a"), F.col("vec").alias("vec_a"), "barred")
    right = _in_order(b.withColumn("place", place("vec")), pair, parts).select(pair, "rank", F.col("cell_id").alias("cell_b"), F.col("vec").alias("vec_b"))
    couples = left.join(right, [pair, "rank"], "full").drop("rank")
    for c in ("dist", "price_a", "price_b"):
        couples = couples.withColumn(c, F.lit(None).cast("double"))
    couples, costs = materialize(couples.select(*columns), "match-round"), []
    for i in range(rounds):
        own, other = ("a", "b") if i % 2 else ("b", "a")
        placed = couples.withColumn("place", _nearest_landmarks(landmarks(i // 2 + 1, own), metric)(F.coalesce(f"vec_{own}", f"vec_{other}"))).withColumn("mix", F.xxhash64(F.lit(i), "cell_a", "cell_b"))
        # by rank: blocks of a partition's rows are as small as there are partitions
        dealt = _in_order(placed, pair, parts, ("place", "mix")).withColumn("blk", F.floor((F.col("rank") - 1) / block))
        fresh = materialize(dealt.select(*columns, "blk").repartition(parts, pair, "blk").groupBy(pair, "blk").applyInPandas(solved, schema), "match-round")
        discard(couples)
        couples = fresh
        costs.append(couples.agg(F.coalesce(F.sum("dist"), F.lit(0.0))).first()[0])
        if i >= 3 and costs[-3] - costs[-1] <= LEAST_GAIN * costs[-3]:
            break
    return couples


def _folds_by_prices(a: DataFrame, b: DataFrame, pair: str, metric: str, folds: int) -> DataFrame:
    """``match_pairs`` of large pairs: every fold is matched without the matches of those before."""
    out = None
    for fold in range(folds):
        nodes, _ = cheapest(a, b, pair, metric, None if out is None else out.select(pair, "cell_a", "cell_b"), fold)
        found = nodes.where("side = 0 AND partner IS NOT NULL").select(pair, F.col("cell_id").alias("cell_a"), F.col("partner").alias("cell_b"), "dist", F.lit(fold).alias("fold"))
        out = found if out is None else out.unionByName(found)
    return out


def lower_bound(couples: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(cost, bound) of the couples of one pair: no matching of all points of the smaller side costs less than ``bound``.

    Weak duality with any prices: each point of the smaller side pays its cheapest difference of distance and price, plus the sum of the prices of the
    larger side, none of which may lie above 0 unless the sides are even. All pairs of points are visited, block by block.
    """
    one = couples.agg(F.count("cell_a").alias("na"), F.count("cell_b").alias("nb")).first()
    small, big = ("a", "b") if one.na <= one.nb else ("b", "a")
    price = F.coalesce(f"price_{big}", F.lit(0.0))
    price = price if one.na == one.nb else F.least(price, F.lit(0.0))
    side = lambda s: couples.where(F.col(f"cell_{s}").isNotNull())
    payers = side(small).select(F.col(f"cell_{small}").alias("cell_id"), F.col(f"vec_{small}").alias("vec"))
    # the price travels as the last component
    priced = side(big).select(F.col(f"cell_{big}").alias("cell_id"), F.concat(f"vec_{big}", F.array(price)).alias("vec"))

    def kernel(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame()
        v, least = vectors(y), np.full(len(x), np.inf)
        for r, c, d in tiles(vectors(x), v[:, :-1], metric):
            part = slice(r, r + len(d))
            least[part] = np.minimum(least[part], (d - v[None, c : c + d.shape[1], -1]).min(axis=1))
        return pd.DataFrame({"cell_id": x.cell_id, "pays": least})

    pays = block_pairs(payers, priced, kernel, "cell_id long, pays double").groupBy("cell_id").agg(F.min("pays").alias("pays")).agg(F.sum("pays").alias("pays"))
    prices = side(big).agg(F.sum(price).alias("prices"))
    return couples.agg(F.sum("dist").alias("cost")).join(pays).join(prices).select("cost", (F.col("pays") + F.col("prices")).alias("bound"))


def match(a: DataFrame, b: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(cell_a, cell_b, dist) of the cheapest matching of two point sets."""
    one = F.lit(0)
    return match_pairs(a.withColumn("pair", one), b.withColumn("pair", one), metric=metric).select("cell_a", "cell_b", "dist")


def duality(a: DataFrame, b: DataFrame, metric: str = "euclidean", max_side: int = MAX_SIDE) -> DataFrame:
    """(cost, dual, least_slack): cost of the matching, value of its potentials, and the least of cost - potentials over all pairs.

    With a least slack of 0 the dual value bounds every matching from below; equal to the cost, it proves that none is cheaper. Potentials of
    unmatched points are 0, and none of the larger side's lies above 0.
    """

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame()
        cost = _cost(x, y, metric)
        r, c, u, v = solve(cost)
        larger = v if len(u) <= len(v) else u
        slack = min(float((cost - u[:, None] - v[None]).min()), float(-larger.max()) if len(u) != len(v) else 0.0)
        return pd.DataFrame({"cost": [cost[r, c].sum()], "dual": [u.sum() + v.sum()], "least_slack": [slack]})

    one = F.lit(0).alias("pair")
    left, right = (d.select(one, *(F.col(c).alias(c) for c in ("cell_id", "vec"))) for d in (a, b))
    na, nb = left.count(), right.count()
    if max(na, nb) > max_side and min(na, nb):
        nodes, proof = cheapest(left, right, metric=metric)
        over = F.lit(0.0) if na == nb else -F.max(F.when(F.col("side") == int(na < nb), F.col("dual")))
        sums = nodes.agg(F.sum(F.when(F.col("side") == 0, F.col("dist"))).alias("cost"), F.sum("dual").alias("dual"), over.alias("over"))
        return sums.join(proof.agg(F.min("slack").alias("slack"))).select("cost", "dual", F.least("slack", "over").alias("least_slack"))
    return left.groupBy("pair").cogroup(right.groupBy("pair")).applyInPandas(run, "cost double, dual double, least_slack double")


def match_edges(matches: DataFrame) -> DataFrame:
    """(src, dst) of a match in both directions."""
    return matches.select(F.col("cell_a").alias("src"), F.col("cell_b").alias("dst")).unionByName(matches.select(F.col("cell_b").alias("src"), F.col("cell_a").alias("dst")))


def slice_matches(points: DataFrame, folds: int = 1, adjacent: bool = True, metric: str = "euclidean") -> DataFrame:
    """(slice_a, slice_b, cell_a, cell_b, dist, fold): matches of adjacent slices, or of all pairs of slices, in one job."""
    s = points.select(F.col("dataset_id").alias("slice_a")).distinct()
    t = s.withColumnRenamed("slice_a", "slice_b")
    pairs = s.join(F.broadcast(t)).where("slice_a + 1 = slice_b" if adjacent else "slice_a < slice_b")
    pairs = pairs.withColumn("pair", F.concat_ws(":", "slice_a", "slice_b"))
    side = lambda c: points.join(F.broadcast(pairs), points.dataset_id == F.col(c)).select("pair", "cell_id", "vec")
    m = match_pairs(side("slice_a"), side("slice_b"), metric=metric, folds=folds)
    return m.join(F.broadcast(pairs), "pair").select("slice_a", "slice_b", "cell_a", "cell_b", "dist", "fold")


def chain(points: DataFrame) -> DataFrame:
    """(dataset_id, cell_id, pos): positions such that the n-th cells of neighbouring slices are matched.

    All adjacent pairs are matched at once; positions then follow the matches from slice to slice. Unmatched surplus has no position.
    """
    m = slice_matches(points)
    slices = [r.dataset_id for r in points.select("dataset_id").distinct().orderBy("dataset_id").collect()]
    at = points.where(F.col("dataset_id") == slices[0]).select("cell_id", F.row_number().over(Window.partitionBy("dataset_id").orderBy("cell_id")).cast("long").alias("pos"))
    out = at.withColumn("dataset_id", F.lit(slices[0]))
    for a, b in zip(slices, slices[1:]):
        at = m.where((F.col("slice_a") == a) & (F.col("slice_b") == b)).join(at.withColumnRenamed("cell_id", "cell_a"), "cell_a").select(F.col("cell_b").alias("cell_id"), "pos")
        out = out.unionByName(at.withColumn("dataset_id", F.lit(b)))
    return out.select("dataset_id", "cell_id", "pos")


def match_labels(canvas: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by..., label_a, label_b, w): the best one-to-one pairing of clusters on a canvas of negative weights.

    A canvas has as many rows as pairs of clusters that share a match.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = sorted(pdf.label_a.unique()), sorted(pdf.label_b.unique())
        cost = np.zeros((len(rows), len(cols)))
        cost[pdf.label_a.map(rows.index).to_numpy(dtype=int), pdf.label_b.map(cols.index).to_numpy(dtype=int)] = pdf.w
        r, c = assign(cost)
        out = pd.DataFrame({"label_a": [rows[i] for i in r], "label_b": [cols[j] for j in c], "w": cost[r, c]})
        for g in reversed(list(by)):
            out.insert(0, g, pdf[g].iloc[0])
        return out[out.w < 0]

    keys = list(by)
    kinds = {f.name: f.dataType.simpleString() for f in canvas.schema}
    schema = "".join(f"{g} {kinds[g]}, " for g in keys) + f"label_a {kinds['label_a']}, label_b {kinds['label_b']}, w double"
    grouped = canvas.groupBy(*keys) if keys else canvas.withColumn("__all", F.lit(0)).groupBy("__all")
    return grouped.applyInPandas(run, schema)


def translate(labels: DataFrame, a: str, b: str) -> DataFrame:
    """``labels`` with column ``translated``: b's labels in a's names by the best pairing, fresh names after the largest for the rest."""
    from plexmat.operators.align import confusion

    c = confusion(labels, a, b).select(F.col(a).alias("label_a"), F.col(b).alias("label_b"), (-F.col("dice")).alias("w"))
    pairs = match_labels(c).select(F.col("label_a").alias("translated"), F.col("label_b").alias(b))
    top = labels.agg(F.max(a).alias("top"))
    rest = labels.select(b).distinct().join(pairs, b, "left_anti").join(F.broadcast(top)).select((F.col("top") + F.row_number().over(Window.orderBy(b))).cast("int").alias("translated"), b)
    return labels.join(F.broadcast(pairs.unionByName(rest)), b)
