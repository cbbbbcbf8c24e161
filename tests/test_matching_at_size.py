import numpy as np
import pytest
from pyspark.sql import functions as F

from plexmat.operators import assignment, lineage


def test_a_first_matching_leaves_few_rows_to_long_paths():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(300, 64)), rng.normal(size=(300, 64))
    cost = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
    v, owner = assignment._started(cost)
    assert (owner >= 0).sum() > 240 and len(set(owner[owner >= 0])) == (owner >= 0).sum()
    assert all(cost[i, j] - v[j] <= (cost[i] - v).min() + 1e-9 for j, i in enumerate(owner) if i >= 0)


@pytest.mark.parametrize("shape", [(40, 40), (25, 40), (40, 25), (1, 1), (1, 5)])
@pytest.mark.parametrize("ties", [False, True])
def test_potentials_prove_the_matching(shape, ties):
    rng = np.random.default_rng(2)
    cost = rng.integers(0, 4, shape).astype(float) if ties else rng.random(shape)
    r, c, u, v = assignment.solve(cost)
    assert len(set(r)) == len(set(c)) == min(shape)
    assert (cost - u[:, None] - v[None]).min() > -1e-9 and abs(u.sum() + v.sum() - cost[r, c].sum()) < 1e-9
    if shape[0] != shape[1]:
        assert (v if shape[0] < shape[1] else u).max() <= 1e-12


def test_more_than_4000_points_a_side_are_proved(spark):
    p = spark.range(10_256).select(F.col("id").alias("cell_id"), F.array(*(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10_000)) / 1e4 for k in range(8))).alias("vec"))
    d = assignment.duality(p.where("cell_id % 2 = 0"), p.where("cell_id % 2 = 1")).first()
    assert d.least_slack > -1e-9 and abs(d.cost - d.dual) < 1e-7


def test_landmarks_of_all_rounds_are_read_at_once(spark):
    """A round asked every task for its first points."""
    read, plain = [], type(spark.range(0)).collect
    p = spark.range(800).select(F.lit(0).alias("pair"), F.col("id").alias("cell_id"), F.array(*(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1e3 for k in range(3))).alias("vec"))
    kind = type(spark.range(0))
    kind.collect = lambda self: plain(self) if not {"vec", "vec_a", "vec_b"} & set(self.columns) else read.append(1) or plain(self)
    try:
        m = assignment.match_in_rounds(p.where("cell_id % 2 = 0").withColumn("barred", F.lit(None).cast("array<long>")), p.where("cell_id % 2 = 1"), block=100)
    finally:
        kind.collect = plain
    assert len(read) == 2 and m.where("dist IS NOT NULL").select("cell_a").distinct().count() == 400


def test_labels_of_all_points_are_not_broadcast(spark):
    p = spark.range(40).select((F.col("id") % 2).cast("int").alias("dataset_id"), F.col("id").alias("cell_id"), (F.col("id") % 3).cast("int").alias("label"))
    m = spark.range(20).select(F.lit(0).alias("slice_a"), F.lit(1).alias("slice_b"), (2 * F.col("id")).alias("cell_a"), (2 * F.col("id") + 1).alias("cell_b"))
    plan = lineage.slice_canvas(p, m)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2


def _points(spark, n, seed):
    return spark.range(n).select(F.lit(0).alias("pair"), F.col("id").alias("cell_id"), F.array(*(F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1000)) / 1e3 for k in range(6))).alias("vec"))


@pytest.mark.parametrize("sizes", [(180, 220)])
def test_large_pairs_cost_as_little_as_small_ones(spark, sizes):
    """Pairs beyond one task were matched in rounds, above the least cost."""
    a, b = _points(spark, sizes[0], 1), _points(spark, sizes[1], 2)
    got, want = (assignment.match_pairs(a, b, folds=2, max_side=n).groupBy("fold").agg(F.sum("dist").alias("cost"), F.count_distinct("cell_a").alias("na"), F.count_distinct("cell_b").alias("nb")).orderBy("fold").collect() for n in (50, 1000))
    assert [(r.fold, r.na, r.nb) for r in got] == [(0, min(sizes), min(sizes)), (1, min(sizes), min(sizes))]
    assert abs(got[0].cost - want[0].cost) < 1e-8 and abs(got[1].cost - want[1].cost) < 1e-6


@pytest.mark.parametrize("sizes", [(150, 150), (160, 120)])
def test_pairs_beyond_one_task_are_proved(spark, sizes):
    """They stopped with an error."""
    a, b = (_points(spark, n, s).drop("pair") for n, s in zip(sizes, (3, 4)))
    d, want = assignment.duality(a, b, max_side=40).first(), assignment.duality(a, b).first()
    assert d.least_slack > -1e-9 and abs(d.cost - d.dual) < 1e-8 and abs(d.cost - want.cost) < 1e-8


def test_equal_points_are_matched_at_no_cost(spark):
    a = spark.range(120).select(F.lit(0).alias("pair"), F.col("id").alias("cell_id"), F.array((F.col("id") % 3).cast("double")).alias("vec"))
    m = assignment.match_pairs(a, a, max_side=30)
    assert m.agg(F.sum("dist"), F.count_distinct("cell_a"), F.count_distinct("cell_b")).first()[:] == (0.0, 120, 120)


def test_blocks_of_rounds_do_not_shrink_with_partitions(spark):
    """200 partitions left 25 couples a block where 100 were asked for."""
    a, b = _points(spark, 400, 5).withColumn("barred", F.lit(None).cast("array<long>")), _points(spark, 400, 6)
    before, costs = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (2, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            costs.append(assignment.match_in_rounds(a, b, block=100, rounds=3).agg(F.sum("dist")).first()[0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert abs(costs[0] - costs[1]) < 1e-9
