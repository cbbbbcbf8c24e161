import numpy as np
import pytest

from plexmat.operators import density


def plain_walk(ids, x, min_samples):
    """Prim's walk over all pairs."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, min(min_samples, len(x)) - 1]
    w = np.round(np.maximum(np.maximum(d, core[:, None]), core[None]), 9)
    order, seen = [(ids[0], None)], {0}
    while len(seen) < len(ids):
        best = min((w[i, j], min(ids[i], ids[j]), max(ids[i], ids[j]), j) for i in seen for j in range(len(ids)) if j not in seen)
        seen.add(best[3])
        order.append((ids[best[3]], best[0]))
    return order


@pytest.mark.parametrize("piece", [200_000, 4])
def test_order_equals_a_plain_walk(spark, piece):
    """Also where the tree is walked from its heaviest edges down, a few at a time; equal and repeated points tie."""
    rng = np.random.default_rng(4)
    x = np.round(np.concatenate([rng.normal(0, 0.3, (14, 2)), rng.normal(3, 0.6, (10, 2)), np.zeros((4, 2)), [[9, 9], [9, 9]]]), 1)
    ids = [3 * i + 1 for i in range(len(x))]
    p = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "cell_id long, vec array<double>")
    got = [(r.cell_id, r.reachability) for r in density.density_ordering(p, 4, piece).orderBy("place").collect()]
    assert got == plain_walk(ids, x, 4)


@pytest.mark.parametrize("known", [4, 16])
def test_lists_and_comparisons_give_the_tree_of_all_pairs(spark, monkeypatch, known):
    """Groups wider than a list, copies and equal distances: no more than two comparisons of points by blocks, after that of the lists."""
    rng = np.random.default_rng(7)
    x = np.concatenate([np.round(rng.normal(c, s, (n, 3)), 2) for c, s, n in ((0, 0.3, 60), (4, 0.1, 40), (9, 1.0, 30))] + [np.ones((25, 3)), np.indices((4, 4, 1)).reshape(3, -1).T + 20.0])
    ids = [5 * i % 1009 for i in range(1, len(x) + 1)]
    order = np.argsort(ids)
    p = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "cell_id long, vec array<double>")
    met, pairs = [], density.block_pairs
    monkeypatch.setattr(density, "block_pairs", lambda *a, **b: met.append(1) or pairs(*a, **b))
    got = sorted((r.a, r.b, r.w) for r in density.spanning_tree(p, 4, known=known).collect())
    assert (len(met) > 0) == (known == 4) or len(met) <= 2
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, 3]
    w = np.round(np.maximum(np.maximum(d, core[:, None]), core[None]), 9)
    edges = sorted((w[i, j], min(ids[i], ids[j]), max(ids[i], ids[j])) for i in order for j in order if i < j)
    root, tree = {i: i for i in ids}, []
    for e, a, b in edges:
        ra, rb = a, b
        while root[ra] != ra:
            ra = root[ra]
        while root[rb] != rb:
            rb = root[rb]
        if ra != rb:
            root[rb] = ra
            tree.append((a, b, e))
    assert got == sorted(tree)


def test_few_points(spark):
    p = lambda rows: spark.createDataFrame(rows, "cell_id long, vec array<double>")
    assert density.density_ordering(p([])).count() == 0
    assert [tuple(r) for r in density.density_ordering(p([(5, [1.0])])).collect()] == [(5, 0, None)]
    two = density.density_ordering(p([(5, [1.0]), (2, [4.0])])).orderBy("place").collect()
    assert [(r.cell_id, r.place, r.reachability) for r in two] == [(2, 0, None), (5, 1, 3.0)]


def test_a_cut_is_a_set_of_dense_parts(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.2, (30, 2)), rng.normal(5, 0.2, (30, 2)), [[50.0, 50.0]]])
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, vec array<double>")
    got = {r.cell_id: r.cluster for r in density.density_cut(density.spanning_tree(p), p, 1.0).collect()}
    assert {got[i] for i in range(30)} == {0} and {got[i] for i in range(30, 60)} == {30} and got[60] == -1
