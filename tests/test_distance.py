"""Screened neighbours against comparing all pairs, and blocks by group."""

import numpy as np
import pandas as pd
import pytest

from plexmat.operators import distance


def by_all_pairs(x, y, k, metric, same=None):
    d = distance.METRICS[metric](x, y)
    if same is not None:
        d[same[0][:, None] == same[1][None, :]] = np.inf
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return [(i, j, d[i, j]) for i in range(len(x)) for j in order[i] if np.isfinite(d[i, j])]


@pytest.mark.parametrize("metric", ["euclidean", "sqeuclidean", "l1"])
@pytest.mark.parametrize("kind", ["spread", "copies", "far", "grid", "odd"])
def test_nearest_equals_all_pairs(monkeypatch, metric, kind):
    monkeypatch.setattr(distance, "TILE", (7, 600))
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 5))
    y = rng.normal(size=(1900, 5))
    if kind == "copies":
        y[::3] = y[0]
        x[:9] = y[0]
    if kind == "far":
        x, y = x + 1e7, y + 1e7
    if kind == "grid":
        x, y = np.round(x), np.round(y)
    if kind == "odd":
        x[3, 2], y[5, 1], y[6, 0], y[7, 0] = np.nan, np.nan, np.inf, 1e200
    ids = np.arange(40), np.arange(1900) // 2
    for same in (None, ids):
        for k in (1, 6, 3000):
            with np.errstate(all="ignore"):
                got = list(zip(*(v.tolist() for v in distance.nearest(x, y, k, metric, same)), strict=True))
                assert got == by_all_pairs(x, y, k, metric, same)


def test_pairs_in_reach_equal_all_pairs(monkeypatch):
    monkeypatch.setattr(distance, "TILE", (7, 30))
    rng = np.random.default_rng(4)
    x, y = np.round(rng.normal(size=(50, 3)), 1), np.round(rng.normal(size=(90, 3)), 1)
    d = distance.METRICS["euclidean"](x, y)
    eps = float(d[0, 0])
    got = {(i, j, v) for a, b, c in distance.in_reach(x, y, eps, "euclidean") for i, j, v in zip(a.tolist(), b.tolist(), c.tolist(), strict=True)}
    assert got == {(i, j, d[i, j]) for i, j in zip(*(z.tolist() for z in np.nonzero(d <= eps)), strict=True)}


def test_groups_have_blocks_of_their_own(spark):
    """A point of a small group doesn't travel once for each block of all points (it did: 40 copies of every row here)."""
    p = spark.range(0, 2000).selectExpr("id % 40 AS g", "id AS cell_id", "array(cast(id as double)) AS vec")
    n = distance._blocks(p, ["g"], 50, "n_ba")
    assert {r.n_ba for r in n.collect()} == {1}
    found = distance.knn(p, p, 2, groups=["g"], exclude_self=True)
    assert found.where("abs(src - dst) = 40 OR rank = 2").count() == found.count() == 4000


def test_pairs_once_carry_columns(spark):
    p = spark.range(0, 30).selectExpr("id AS cell_id", "array(cast(id as double)) AS vec", "cast(id % 4 AS int) AS slice")
    got = {tuple(r) for r in distance.pairwise(p, p, once=True, more=["slice"]).collect()}
    assert got == {(i, j, float(j - i), i % 4, j % 4) for i in range(30) for j in range(i + 1, 30)}


@pytest.mark.parametrize("dense", [False, True])
def test_density_clusters_equal_all_pairs(spark, monkeypatch, dense):
    """Against a plain search; dense: nearly all pairs are in reach, and block pairs give out no more rows than points (they gave all pairs)."""
    from plexmat.operators import clustering

    monkeypatch.setattr(distance, "SMALL_BLOCK", 60)
    rng = np.random.default_rng(7)
    x = np.round(rng.uniform(0, 0.3 if dense else 4, size=(300, 2)), 2)
    eps, least = 0.25, 5
    d = distance.METRICS["euclidean"](x, x) <= eps
    core = d.sum(1) >= least
    want = np.full(300, -1)
    for i in np.flatnonzero(core):
        if want[i] < 0:
            want[i], heap = i, [i]
            while heap:
                for j in np.flatnonzero(d[heap.pop()] & core & (want < 0)):
                    want[j] = i
                    heap.append(j)
    for i in np.flatnonzero(~core):
        near = np.flatnonzero(d[i] & core)
        want[i] = want[near].min() if len(near) else -1
    p = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "cell_id long, vec array<double>")
    got = {r.cell_id: r.cluster for r in clustering.dbscan(p, eps, least).collect()}
    assert got == dict(enumerate(want.tolist()))
    links = distance.block_pairs(p, p, clustering._joined(eps), "src long, dst long")
    assert 0 < links.count() <= 2 * 25 * 60


def test_hops_compare_with_two_frontiers(spark):
    """A path, a cycle and a tail: distances equal a walk over the graph."""
    from collections import deque

    from plexmat.operators import graph

    edges = [(i, i + 1) for i in range(9)] + [(20 + i, 20 + (i + 1) % 7) for i in range(7)] + [(22, 30), (30, 31)]
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    want = set()
    for s in near:
        at, line = {s: 0}, deque([s])
        while line:
            v = line.popleft()
            for w in near[v]:
                if w not in at:
                    at[w] = at[v] + 1
                    line.append(w)
        want |= {(s, t, h) for t, h in at.items()}
    df = spark.createDataFrame(edges, "src long, dst long")
    got = [tuple(r) for r in graph.hop_distances(df).collect()]
    assert len(got) == len(want) and set(got) == want


def test_ward_rounds_ask_for_stale_clusters_only(spark, monkeypatch):
    """The tree is that of one task; later rounds ask for fewer clusters than there are (they asked for all)."""
    from plexmat.operators import grouped

    rng = np.random.default_rng(11)
    rows = [(g, i, [float(v) for v in rng.normal(size=3)]) for g in range(2) for i in range(150)]
    p = spark.createDataFrame(rows, "dataset_id int, cell_id long, vec array<double>")
    asked, ask = [], grouped._nearest_cluster

    def counted(asking, now, by):
        asked.append((asking.count(), now.count()))
        return ask(asking, now, by)

    monkeypatch.setattr(grouped, "_nearest_cluster", counted)
    tree = lambda bound: sorted((r.dataset_id, r.node, r.left, r.right, round(r.height, 9), r["size"]) for r in grouped.merge_tree(p, bound=bound).collect())
    assert tree(20) == tree(1000)
    assert asked[0] == (300, 300) and len(asked) > 2 and all(a < n for a, n in asked[1:])


def test_neighbours_travel_seldom_in_many_groups(spark, monkeypatch):
    """Block pairs are shared out over all groups: a right row travels once for each left block, a left row meets one block, and the neighbours stay the same."""
    monkeypatch.setattr(distance, "SMALL_BLOCK", 4)
    rng = np.random.default_rng(3)
    rows = [(g, g * 1000 + i, v) for g in range(8) for i, v in enumerate((4 * rng.normal(size=(40, 3))).round().tolist())]
    p = spark.createDataFrame(rows, "g int, cell_id long, vec array<double>")
    met = distance.block_pairs(p, p, lambda x, y: pd.DataFrame({"left": [len(x)], "right": [len(y)]}), "left long, right long", ["g"], pairs=distance.PAIRS).collect()
    assert len(met) == 8 * 3 and {x.right for x in met} == {40} and sum(x.left for x in met) == 8 * 40
    sent, deal = [], distance._dealt
    monkeypatch.setattr(distance, "_dealt", lambda *args: sent.append(deal(*args)) or sent[-1])
    got = {(x.src, x.rank): x.dst for x in distance.knn(p, p, 3, groups=["g"], exclude_self=True).collect()}
    assert sum(x.count() for x in sent) == 8 * 40 * (1 + 3)
    for g in range(8):
        ids, v = zip(*[(i, x) for h, i, x in rows if h == g], strict=True)
        d = np.sqrt(((np.array(v)[:, None] - np.array(v)[None]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        for i, near in zip(ids, np.argsort(d, axis=1, kind="stable")[:, :3], strict=True):
            assert [got[i, k + 1] for k in range(3)] == [ids[x] for x in near]


def test_hops_write_no_pairs_between_steps(spark, monkeypatch):
    """All pairs found were written and shuffled once for every number of hops."""
    from plexmat.operators import graph, hops

    n, rng = 90, np.random.default_rng(4)
    pairs = [(int(i), int(j)) for i, j in rng.integers(0, n, (110, 2)) if i != j]
    written, plain = [], hops.materialize
    monkeypatch.setattr(hops, "materialize", lambda df, label="step": written.append(plain(df, label)) or written[-1])
    monkeypatch.setattr(hops, "PIECE", 32)
    edges = spark.createDataFrame(pairs, "src long, dst long")
    got = {(r.src, r.dst): r.hops for r in graph.hop_distances(edges).collect()}
    away = np.full((n, n), np.inf)
    for i, j in pairs:
        away[i, j] = away[j, i] = 1
    for i in {x for p in pairs for x in p}:
        away[i, i] = 0
    for k in range(n):
        away = np.minimum(away, away[:, k, None] + away[None, k])
    assert got == {(int(i), int(j)): int(away[i, j]) for i, j in zip(*np.nonzero(np.isfinite(away)))}
    assert written and all(w.count() < 300 for w in written) and len(got) > 3000


def test_labels_spread_over_hops_without_a_table_of_pairs(spark):
    from plexmat.operators import graph, hops

    rng = np.random.default_rng(5)
    edges = spark.createDataFrame([(i, i + 1) for i in range(30) if i != 17] + [(int(i), int(j)) for i, j in rng.integers(0, 15, (10, 2)) if i != j], "src long, dst long")
    seeds = spark.createDataFrame([(0, 3), (9, 5), (14, 5), (20, 7), (50, 1)], "node long, label int")
    sim = graph.hop_similarity(graph.hop_distances(edges))
    want = {(r.src, r.dst): r.sim for r in sim.collect()}
    assert {(r.src, r.dst): r.sim for r in hops.similarity(edges).collect()} == want
    got = {r.node: r.label for r in hops.spread_labels(edges, seeds, rounds=6).collect()}
    assert got == {r.node: r.label for r in graph.spread_labels(sim, seeds, rounds=6).collect()}


def test_points_travel_seldom_where_all_pairs_are_given_out(spark, monkeypatch):
    """A point travelled once for each block of as few rows as a task gave out in one piece."""
    from pyspark.sql import functions as F

    dealt, plain = [], distance._dealt
    monkeypatch.setattr(distance, "_dealt", lambda *args: dealt.append(plain(*args)) or dealt[-1])
    monkeypatch.setattr(distance, "BLOCK", 50)
    monkeypatch.setattr(distance, "TILE", (40, 4096))
    p = spark.range(300).select(F.col("id").alias("cell_id"), F.array((F.col("id") % 17).cast("double"), (F.col("id") % 5).cast("double")).alias("vec"))
    got = distance.pairwise(p, p, "l1", once=True).toPandas()
    want = {(i, j): abs(i % 17 - j % 17) + abs(i % 5 - j % 5) for i in range(300) for j in range(i + 1, 300)}
    assert {(r.src, r.dst): r.dist for r in got.itertuples()} == want and len(got) == len(want)
    assert sum(d.count() for d in dealt) <= 4 * 300
