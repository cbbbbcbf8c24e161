import numpy as np

from plexmat.operators import birch


def frame(spark, x):
    return spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "dataset_id int, cell_id long, vec array<double>").repartition(5)


def test_features_add_up_and_keep_their_radius(spark):
    x = np.random.default_rng(1).normal(size=(400, 3))
    for threshold, most in ((0.4, 1000), (0.05, 40)):  # the second is rebuilt with larger thresholds
        rows = birch.features(frame(spark, x), threshold, branching=5, most=most).collect()
        assert len(rows) <= most and sum(r.n for r in rows) == 400
        assert np.allclose(np.sum([r.total for r in rows], axis=0), x.sum(0)) and np.isclose(sum(r.squares for r in rows), (x * x).sum())
        for r in rows:
            c = np.array(r.total) / r.n
            assert r.squares / r.n - c @ c <= r.threshold**2 + 1e-9
            assert r.threshold >= threshold


def test_planted_clusters(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    got = {r.cell_id: r.cluster for r in birch.birch(frame(spark, x), 3, 0.3).collect()}
    parts = [{got[i] for i in range(a, a + 60)} for a in (0, 60, 120)]
    assert all(len(p) == 1 for p in parts) and len(set.union(*parts)) == 3


def test_points_that_are_all_alike(spark):
    x = np.ones((30, 2))
    assert [r.n for r in birch.features(frame(spark, x), 0.0, most=3).collect()] == [30]
    assert birch.features(frame(spark, x).limit(0), 0.1).count() == 0
