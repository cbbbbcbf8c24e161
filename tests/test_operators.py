"""Small fixtures with answers worked out by hand, and invariants."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexmat.operators import align, assignment, clustering, components, distance, graph, matrix, metrics, models, neighbours, preprocess, selection
from plexmat.sources import readers


def test_dispersion_counts_zeros(spark):
    rows = [(0, c, "g1", x) for c, x in ((1, 1.0), (4, 3.0))] + [(0, 4, "g3", 4.0)] + [(0, c, "g2", 2.0) for c in range(1, 5)]
    logged = preprocess.log1p(spark.createDataFrame(rows, "dataset_id int, cell_id long, gene_id string, x double"))
    n = spark.createDataFrame([(0, 4)], "dataset_id int, n_cells long")
    got = {r.gene_id: r for r in selection.dispersion(logged, n).collect()}
    assert set(got) == {"g1", "g3"}  # the constant gene has no finite score
    assert math.isclose(got["g1"].mean, 1) and math.isclose(got["g1"]["var"], 1.5) and math.isclose(got["g1"].y, 0.405465, abs_tol=1e-6)
    assert math.isclose(got["g3"].y, 1.098612, abs_tol=1e-6) and math.isclose(got["g3"].x, 0.693147, abs_tol=1e-6)


def test_means_that_differ_by_rounding_are_ranked_by_gene(spark):
    rows = [(0, c, g, math.log1p(x)) for g, e in ((1, 1e-12), (2, 0.0)) for c, x in ((1, 1.0 + e), (2, 3.0))]
    logged = spark.createDataFrame(rows, "dataset_id int, cell_id long, gene_id long, x double")
    n = spark.createDataFrame([(0, 2)], "dataset_id int, n_cells long")
    assert {r.gene_id: r.bin for r in selection.hvg_cell_ranger(logged, n, 2).collect()} == {1: 1, 2: 2}


def test_bins_are_open(spark):
    s = spark.createDataFrame([(0, str(x), float(x), 1.0) for x in (0.25, 0.26, 0.5, 0.51)], "dataset_id int, gene_id string, x double, y double")
    got = sorted((r.centre, r.n) for r in selection.bin_statistics(s).collect())
    assert got == [(0.375, 1), (0.625, 1)]


def test_cosine_and_jaccard(spark):
    a, b = [5, 4, 3, 0, 1], [5, 0, 3, 4, 1]
    s = spark.createDataFrame([(d, i, float(v)) for d, x in enumerate((a, b)) for i, v in enumerate(x)], "dataset_id int, gene_id int, score double")
    sim = {(r.ds_a, r.ds_b): r.value for r in metrics.cosine(s).collect()}
    assert math.isclose(sim[0, 1], 0.686275, abs_tol=1e-6) and math.isclose(sim[0, 0], 1)
    jac = {(r.ds_a, r.ds_b): r.value for r in metrics.jaccard(selection.top_genes(s, 3)).collect()}
    assert math.isclose(jac[0, 1], 0.5)


def test_balanced_cosine(spark):
    a, b = [0, 0, 0, 1, 1, 2], [1, 1, 0, 0, 0, 2]
    s = spark.createDataFrame([(d, i, float(v)) for d, x in enumerate((a, b)) for i, v in enumerate(x)], "dataset_id int, gene_id int, score double")
    got = {(r.ds_a, r.ds_b): (r.value, r.n) for r in metrics.cosine_on(s, metrics.balanced_pairs(s, 3)).collect()}
    assert got[0, 1][1] == 3 and math.isclose(got[0, 1][0], 0.8)


def test_canvas_and_cleaning(spark):
    y1, y2 = [0, 0, 0, 0, 1, 1, 1, 1, 2, 2], [5, 5, 5, 6, 6, 6, 7, 7, 7, 7]
    lab = lambda y: spark.createDataFrame(list(enumerate(y)), "cell_id long, label int")
    m = spark.createDataFrame([(i, i, 1.0) for i in range(10)], "cell_a long, cell_b long, dist double")
    c = align.clean(align.canvas(m, lab(y1), lab(y2)))
    got = {(r.label_a, r.label_b): (round(r.w, 6), round(r.cleaned, 6)) for r in c.collect()}
    assert got == {(0, 5): (-0.857143, -0.857143), (0, 6): (-0.285714, 0.0), (1, 6): (-0.571429, -0.571429), (1, 7): (-0.5, 0.0), (2, 7): (-0.666667, -0.666667)}


@pytest.mark.parametrize("a,b,want", [([0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 2, 2], 0.242424), ([0, 0, 1, 1], [1, 1, 0, 0], 1.0)])
def test_adjusted_rand(spark, a, b, want):
    df = spark.createDataFrame(list(zip(a, b)), "a int, b int")
    assert math.isclose(metrics.adjusted_rand(df, "a", "b").first().ari, want, abs_tol=1e-6)


def test_gaussian_similarity(spark):
    p = lambda shift, at: spark.createDataFrame([(at + i, 0, [i + shift]) for i in range(5)], "cell_id long, label int, vec array<double>")
    got = metrics.gaussian_similarity(p(0.0, 0), p(0.5, 100)).first()
    assert math.isclose(got.sim, 0.778801, abs_tol=1e-6)


def test_knee(spark):
    c = spark.createDataFrame(list(enumerate([10.0, 6.0, 3.0, 2.0, 1.5])), "x int, y double")
    assert align.diagonal_knee(c).first().x == 1


def test_unique_labels_over_slices(spark):
    df = spark.createDataFrame([(s, i, i) for s, top in enumerate((2, 1, 3)) for i in range(top + 1)], "dataset_id int, cell_id int, label int")
    got = {r.dataset_id: r.low for r in align.unique_over_slices(df).groupBy("dataset_id").agg(F.min("label").alias("low")).collect()}
    assert got == {0: 0, 1: 3, 2: 5}


def test_far_penalty(spark):
    e = spark.createDataFrame([(0, g, 1.0) for g in (0, 1, 2, 3)], "src_slice int, dst_slice int, dist double")
    assert sorted(r.dist for r in neighbours.far_penalty(e, 2.0).collect()) == [1.0, 1.0, 2.0, 4.0]


@pytest.mark.parametrize("amount,want", [(0.2, 2), (5, 5), (50, 10), (None, 10)])
def test_subsample(spark, amount, want):
    df = spark.createDataFrame([(0, i) for i in range(10)], "dataset_id int, cell_id int")
    assert preprocess.subsample(df, amount, 3).count() == want


def test_must_links(spark):
    must = spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")
    groups, barred = clustering.must_link_closure(must, spark.createDataFrame([(2, 3)], "a long, b long"))
    assert {(r.node, r.group) for r in groups.collect()} == {(0, 0), (1, 0), (2, 0)}
    assert {(r.ga, r.gb) for r in barred.collect()} == {(0, 3)}
    with pytest.raises(ValueError):
        clustering.must_link_closure(spark.createDataFrame([(0, 1), (1, 3)], "a long, b long"), spark.createDataFrame([(0, 3)], "a long, b long"))


@pytest.mark.parametrize("seed", range(4))
def test_assignment_is_optimal(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 7), rng.integers(1, 7)
    cost = rng.random((n, m))
    r, c = assignment.assign(cost)
    assert len(r) == min(n, m) and len(set(r)) == len(r) and len(set(c)) == len(c)
    wide = cost if n <= m else cost.T
    best = min(sum(wide[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
    assert math.isclose(cost[r, c].sum(), best)


def test_folds_never_repeat_a_pair(spark):
    rng = np.random.default_rng(0)
    p = spark.createDataFrame([(i % 2, i, rng.random(3).tolist()) for i in range(12)], "dataset_id int, cell_id long, vec array<double>")
    m = assignment.slice_matches(p, folds=3).collect()
    assert len(m) == 18 and len({(r.cell_a, r.cell_b) for r in m}) == 18


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1001 + i) for i in range(50)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(101)) and all(got[1000 + i] == 1000 for i in range(51)) and len(got) == 152


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.random((60, 4))
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, vec array<double>")
    got = {(r.src, r.rank): r.dst for r in distance.knn(p, p, 3, exclude_self=True).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert all(got[i, k + 1] == j for i in range(60) for k, j in enumerate(np.argsort(d[i], kind="stable")[:3]))


def test_noise_zero_is_identity(spark):
    counts = spark.createDataFrame([(0, c, g, float(c + g)) for c in range(1, 5) for g in range(c)], "dataset_id int, cell_id long, gene_id int, x double")
    obs = counts.select("dataset_id", "cell_id").distinct()
    assert sorted(matrix.noisy(counts, obs, 0.0).collect()) == sorted(counts.collect())


def test_joint_em_is_a_fixed_point(spark):
    rng = np.random.default_rng(3)
    rows = [(d, i, (rng.normal(size=2) + (6 if i % 2 else 0)).tolist()) for d in range(2) for i in range(60)]
    p = spark.createDataFrame(rows, "dataset_id int, pos long, vec array<double>")
    start = spark.createDataFrame([(i, i % 2 if i > 8 else 0) for i in range(60)], "pos long, label int")
    got = {r.pos: r.label for r in models.joint_em(p, start).collect()}
    assert all(got[i] == i % 2 for i in range(60))


def test_label_spreading_on_a_line(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(5)], "src long, dst long")
    sim = graph.hop_similarity(graph.hop_distances(edges))
    got = {r.node: r.label for r in graph.spread_labels(sim, spark.createDataFrame([(0, 0), (5, 1)], "node long, label int"), rounds=5).collect()}
    assert got[0] == 0 and got[1] == 0 and got[4] == 1 and got[5] == 1


def test_readers(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("gene,c1,c2\ng1,1,0\ng2,2,3\n")
    got = sorted((r.cell_id, r.gene_id, r.x) for r in readers.read_wide(spark, str(tmp_path / "wide.csv"), "d").collect())
    assert got == [("c1", "g1", 1.0), ("c1", "g2", 2.0), ("c2", "g2", 3.0)]
    (tmp_path / "genes.tsv").write_text("id1\tA\nid2\tB\n")
    (tmp_path / "barcodes.tsv").write_text("x\ny\nz\n")
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%\n2 3 2\n1 1 5\n2 3 7\n")
    got = sorted((r.cell_id, r.gene_id, r.x) for r in readers.read_mtx(spark, str(tmp_path), "d").collect())
    assert got == [("x", "A", 5.0), ("z", "B", 7.0)]
    (tmp_path / "lines.txt").write_text("ab\n\nc\nde\n")
    assert sorted(r.value for r in readers.read_lines(spark, str(tmp_path / "lines.txt")).collect()) == ["ab", "de"]
    (tmp_path / "labels.csv").write_text("barcode,cluster\nx,3\n")
    assert readers.read_labels(spark, str(tmp_path / "labels.csv"), "d").first().label == "3"


def test_stage_table_round_trip(spark, tmp_path):
    df = spark.range(10)
    readers.write_stage(df, str(tmp_path / "stage"))
    assert spark.read.parquet(str(tmp_path / "stage")).count() == 10


def labelled_slices(spark, shift=0):
    rng = np.random.default_rng(7)
    rows = []
    for s in range(3):
        for i in range(24):
            c = i % 3
            rows.append((s, s * 100 + i, (c + shift * s) % 3, [10.0 * c + rng.normal() * 0.1, float(rng.normal() * 0.1)]))
    return spark.createDataFrame(rows, "dataset_id int, cell_id long, label int, vec array<double>")


def test_continuing_clusters_keep_their_names(spark):
    from plexmat.operators import lineage

    labels, links = lineage.differentiation(labelled_slices(spark, shift=1))
    by_group = {}
    for r in labels.collect():
        by_group.setdefault(r.cell_id % 100 % 3, set()).add(r.label)
    assert all(len(x) == 1 for x in by_group.values()) and len({min(x) for x in by_group.values()}) == 3
    assert {(r.parent, r.child) for r in links.collect()} == {(i, i) for i in range(3)}


def test_split_and_merge_makes_labels_correspond(spark):
    from plexmat.operators import lineage

    p = labelled_slices(spark)
    a = p.where("dataset_id = 0").withColumn("label", F.when(F.col("label") == 2, 1).otherwise(F.col("label")))
    one, two, _ = lineage.split_and_merge(a.select("cell_id", "label", "vec"), p.where("dataset_id = 1").select("cell_id", "label", "vec"))
    x, y = ({r.cell_id % 100: r.label for r in d.collect()} for d in (one, two))
    assert len(set(x.values())) == 3 and x == y


def test_ranked_rand_of_equal_labels_is_one(spark):
    from plexmat.operators import lineage

    p = labelled_slices(spark).where("dataset_id = 0")
    c = clustering.centres(p, ["label"])
    same = p.select(F.col("label").alias("a"), F.col("label").alias("b"))
    assert math.isclose(lineage.ranked_rand(same, "a", "b", c, c).first().rari, 1.0)
    other = p.select(F.col("label").alias("a"), (F.col("cell_id") % 2).cast("int").alias("b"))
    assert lineage.ranked_rand(other, "a", "b", c, c.where("label < 2")).first().rari < 0.5


def test_trees(spark):
    from plexmat.operators import grouped

    p = labelled_slices(spark)
    got = {r.cell_id: r.cluster for r in grouped.hierarchical(p, 3).collect()}
    assert all(got[s * 100 + i] == got[s * 100 + i % 3] for s in range(3) for i in range(24))
    leaves = grouped.leaves(grouped.merge_tree(p)).groupBy("dataset_id", "node").count().collect()
    assert max(r["count"] for r in leaves) == 24 and len(leaves) == 3 * 23


def test_trees_in_rounds_equal_those_of_one_task(spark):
    import numpy as np

    from plexmat.operators import grouped

    g = np.random.default_rng(5)
    rows = [(d, 7 * i + d, g.normal(size=3).tolist()) for d, n in ((0, 60), (1, 30), (2, 6), (3, 1)) for i in range(n)]
    p = spark.createDataFrame(rows, "dataset_id int, cell_id long, vec array<double>")
    tree = lambda bound: sorted((r.dataset_id, r.node, r.left, r.right, round(r.height, 9), r["size"]) for r in grouped.merge_tree(p, bound=bound).collect())
    assert tree(12) == tree(1000)
    cut = lambda k, bound: sorted(tuple(r) for r in grouped.hierarchical(p, k, bound=bound).collect())
    assert cut(4, 12) == cut(4, 1000)


def test_trees_in_rounds_with_equal_points(spark):
    from plexmat.operators import grouped

    p = spark.createDataFrame([(0, i, [float(i % 4), 0.0]) for i in range(40)], "dataset_id int, cell_id long, vec array<double>")
    tree = grouped.merge_tree(p, bound=5).collect()
    assert len(tree) == 39 and sum(r.height > 0 for r in tree) == 3 and sorted(c for r in tree for c in (r.left, r.right)) == list(range(78))
    assert all(r.left < r.node and r.right < r.node for r in tree)
    got = {r.cell_id: r.cluster for r in grouped.hierarchical(p, 4, bound=5).collect()}
    assert all(got[i] == i % 4 for i in range(40))
    empty = p.where("dataset_id > 0")
    assert grouped.merge_tree(empty).count() == 0 and grouped.hierarchical(empty, 3).count() == 0


def test_constrained_kmeans_respects_its_links(spark):
    from plexmat.operators import grouped

    p = labelled_slices(spark).where("dataset_id = 0")
    must = spark.createDataFrame([(0, 0, 1)], "dataset_id int, a long, b long")
    cannot = spark.createDataFrame([(0, 3, 6)], "dataset_id int, a long, b long")
    got = {r.cell_id: r.cluster for r in grouped.constrained_kmeans(p, must, cannot, 3).collect()}
    assert got[0] == got[1] and got[3] != got[6]


def test_communities_of_two_cliques(spark):
    from plexmat.operators import grouped

    edges = [(a + s, b + s, 1.0) for s in (0, 10) for a in range(5) for b in range(a)] + [(0, 10, 0.1)]
    got = {r.node: r.community for r in grouped.louvain(spark.createDataFrame(edges, "src long, dst long, weight double"), levels=2).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i + 10] for i in range(5)}) == 1 and got[0] != got[10]


def test_communities_by_moves_in_one_task_and_in_rounds(spark):
    """Three cliques joined in a ring: both ways find them."""
    from plexmat.operators import grouped

    rows = [(10 * c + i, 10 * c + j, 1.0) for c in range(3) for i in range(6) for j in range(i)] + [(0, 10, 0.1), (10, 20, 0.1), (20, 0, 0.1)]
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    for small in (grouped.SMALL_LEVEL, 0):
        found = {}
        for r in grouped.louvain(edges, small_level=small).collect():
            found.setdefault(r.community, set()).add(r.node)
        assert sorted(map(sorted, found.values())) == [[10 * c + i for i in range(6)] for c in range(3)]


def test_zero_cells_take_part_in_the_regression(spark):
    import numpy as np

    from plexmat.operators import preprocess

    depth = spark.createDataFrame([(0, i, float(d)) for i, d in enumerate((1, 2, 4, 7))], "dataset_id int, cell_id long, depth double")
    counts = spark.createDataFrame([(0, 1, "g", 3.0), (0, 3, "g", 5.0)], "dataset_id int, cell_id long, gene_id string, x double")
    slope, intercept = np.polyfit([1, 2, 4, 7], [0, 3, 0, 5], 1)
    line = preprocess.regression_lines(counts, depth).first()
    assert np.allclose([line.slope, line.intercept, line.n_zero, line.zero_residuals], [slope, intercept, 2, -slope * 5 - 2 * intercept])
    got = {r.cell_id: r.residual for r in preprocess.regress_out(counts, depth).collect()}
    assert np.allclose([got[1], got[3]], [3 - slope * 2 - intercept, 5 - slope * 7 - intercept])


def test_a_cluster_session_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    import pytest

    from plexmat.session import shared_dir

    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, default: default)))


def _cloud(spark, sizes, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(p, i, rng.normal(size=3).tolist()) for p, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "pair int, cell_id long, vec array<double>")


def test_rounds_match_completely_and_near_the_optimum(spark):
    from plexmat.operators import assignment

    none = F.lit(None).cast("array<long>")
    for n_a, n_b in ((120, 120), (90, 150), (150, 90), (1, 40), (0, 5)):
        a, b = _cloud(spark, {0: n_a}), _cloud(spark, {0: n_b}, 6)
        couples = assignment.match_in_rounds(a.withColumn("barred", none), b, block=40)
        got = couples.toPandas()
        assert sorted(got.cell_a.dropna()) == list(range(n_a)) and sorted(got.cell_b.dropna()) == list(range(n_b))
        pairs = got[got.cell_a.notna() & got.cell_b.notna()]
        assert len(pairs) == min(n_a, n_b) and pairs.dist.notna().all()
        if min(n_a, n_b):
            best = assignment.duality(a, b).first().cost
            assert best - 1e-7 <= pairs.dist.sum() <= 1.1 * best
            found = assignment.lower_bound(couples).first()
            assert found.bound <= best + 1e-7


def test_large_pairs_go_in_rounds_beside_small_ones(spark, monkeypatch):
    from plexmat.operators import assignment

    monkeypatch.setattr(assignment, "BLOCK", 30)
    a, b = _cloud(spark, {1: 20, 2: 60, 3: 70, 4: 3}), _cloud(spark, {1: 25, 2: 60, 3: 55, 5: 2}, 6)
    got = assignment.match_pairs(a, b, folds=2, max_side=40).toPandas()
    small = assignment.match_pairs(a.where("pair = 1"), b.where("pair = 1"), folds=2).toPandas()
    want = {(r.cell_a, r.cell_b, r.fold) for r in small.itertuples()}
    assert {(r.cell_a, r.cell_b, r.fold) for r in got[got["pair"] == 1].itertuples()} == want
    assert got.groupby(["pair", "fold"]).size().to_dict() == {(1, 0): 20, (1, 1): 20, (2, 0): 60, (2, 1): 60, (3, 0): 55, (3, 1): 55}
    for keys in (["pair", "fold", "cell_a"], ["pair", "fold", "cell_b"], ["pair", "cell_a", "cell_b"]):
        assert not got.duplicated(keys).any()


def test_lines_keep_their_order_over_blocks_of_a_file(spark, tmp_path):
    lines = [f"cell {i} {'x' * (i % 7)}" for i in range(500)]
    (tmp_path / "barcodes.tsv").write_text("\n".join(lines) + "\n")
    (tmp_path / "genes.tsv").write_text("".join(f"id{i}\tg{i}\n" for i in range(3)))
    # the last triple equals the size line
    triples = [(1 + i % 3, 1 + i, i + 1) for i in range(498)] + [(3, 500, 499)]
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate\n% made\n3 500 499\n" + "".join(f"{g} {c} {x}\n" for g, c, x in triples))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        numbered = readers.numbered_lines(spark, str(tmp_path / "barcodes.tsv"))
        assert sorted((r.position, r.value) for r in numbered.collect()) == list(enumerate(lines))
        got = readers.read_mtx(spark, str(tmp_path), "d").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert sorted((r.gene_id, r.cell_id, r.x) for r in got) == sorted((f"g{g - 1}", lines[c - 1], float(x)) for g, c, x in triples)
