import numpy as np
import pytest

from plexmat.operators import constrained, grouped, kernels


def case(seed, n=60):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.8, (n // 3, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    must = [tuple(int(v) for v in rng.integers(0, n, 2)) for _ in range(12)]
    cannot = [(i, i + 1) for i in range(0, 20)] + [tuple(int(v) for v in rng.integers(0, n, 2)) for _ in range(15)]
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in must:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return x, must, [(a, b) for a, b in cannot if root(a) != root(b)]


def frames(spark, x, must, cannot, k):
    ids = lambda i: 3 * i + 2
    p = spark.createDataFrame([(7, ids(i), v.tolist()) for i, v in enumerate(x)], "dataset_id int, cell_id long, vec array<double>")
    links = lambda m: spark.createDataFrame([(7, ids(a), ids(b)) for a, b in m], "dataset_id int, a long, b long")
    centres = spark.createDataFrame([(7, x[:k].tolist())], "dataset_id int, centres array<array<double>>")
    return p, links(must), links(cannot), centres


@pytest.mark.parametrize("seed,k", [(0, 4), (1, 3)])
def test_rounds_equal_deciding_one_after_the_other(spark, seed, k):
    x, must, cannot = case(seed)
    p, m, c, centres = frames(spark, x, must, cannot, k)
    want = kernels.constrained_kmeans(x, k, must, cannot, ids=[3 * i + 2 for i in range(len(x))], centres=x[:k])
    got = [r.cluster for r in constrained.constrained_kmeans(p, m, c, k, centres=centres).orderBy("cell_id").collect()]
    assert got == ([-1] * len(x) if want is None else want.tolist())


def test_large_groups_keep_their_links(spark):
    x, must, cannot = case(5)
    p, m, c, _ = frames(spark, x, must, cannot, 5)
    got = {(r.cell_id - 2) // 3: r.cluster for r in grouped.constrained_kmeans(p, m, c, 5, max_group=50).collect()}
    assert len(got) == len(x) and min(got.values()) >= 0
    assert all(got[a] == got[b] for a, b in must) and all(got[a] != got[b] for a, b in cannot)


def test_what_cannot_be(spark):
    x = np.eye(4)
    p, m, c, _ = frames(spark, x, [], [(0, 1), (1, 2), (0, 2)], 2)
    assert {r.cluster for r in grouped.constrained_kmeans(p, m, c, 2, max_group=0).collect()} == {-1}
    p, m, c, _ = frames(spark, x, [(0, 1)], [(0, 1)], 2)
    with pytest.raises(ValueError):
        constrained.constrained_kmeans(p, m, c, 2)


def test_no_round_sends_groups_to_the_driver(spark, monkeypatch):
    """Joins with tables of must-link groups don't broadcast (small ones were collected in every round)."""
    from plexmat.operators import constrained

    plans, write = [], constrained.materialize

    def kept(df, label="step"):
        plans.append((label, df._jdf.queryExecution().sparkPlan().toString()))
        return write(df, label)

    monkeypatch.setattr(constrained, "materialize", kept)
    p = spark.range(0, 40).selectExpr("0 AS dataset_id", "id AS cell_id", "array(cast(id % 4 AS double), cast(id % 3 AS double)) AS vec")
    links = lambda lo: spark.range(lo, lo + 6).selectExpr("0 AS dataset_id", "id AS a", "id + 11 AS b")
    assert constrained.constrained_kmeans(p, links(0), links(20), 3).count() == 40
    seen = {label: plan for label, plan in plans}
    for label in ("constrained-done", "constrained-open"):
        assert "BroadcastHashJoin" not in seen[label], label


def test_a_round_of_k_means_writes_two_steps_and_decides_alike(spark, monkeypatch):
    """It wrote six and more: at 20,000 points a group most of the time went into starting jobs."""
    from plexmat.operators import constrained

    labels, write = [], constrained.materialize
    monkeypatch.setattr(constrained, "materialize", lambda df, label="step": labels.append(label) or write(df, label))
    p = spark.range(0, 60).selectExpr("cast(id % 2 AS int) AS dataset_id", "id AS cell_id", "array(cast(id * 7 % 13 AS double), cast(id % 5 AS double)) AS vec")
    must = spark.range(0, 40, 10).selectExpr("cast(id % 2 AS int) AS dataset_id", "id AS a", "id + 2 AS b")
    cannot = spark.range(0, 30, 3).selectExpr("cast(id % 2 AS int) AS dataset_id", "id AS a", "id + 6 AS b")
    got = constrained.constrained_kmeans(p, must, cannot, 4).collect()
    assert set(labels) <= {"constrained-points", "constrained-links", "constrained-before", "constrained-linked", "constrained-centres", "constrained-open", "constrained-done"}
    assert labels.count("constrained-open") == labels.count("constrained-done") >= 2 and labels.count("constrained-centres") == 4
    monkeypatch.setattr(constrained, "TOGETHER", 0)
    assert sorted(got) == sorted(constrained.constrained_kmeans(p, must, cannot, 4).collect())
