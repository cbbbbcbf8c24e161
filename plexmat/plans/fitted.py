"""Queries of the operators that SQL cannot express: assignment, fitted models, joint clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plexmat.operators import align, assignment, birch, density, distance, grouped, lineage, matrix, meanshift, metrics, models, spectral
from plexmat.plans import basket
from plexmat.plans.basket import r
from plexmat.plans.points import D, W, halves, points
from plexmat.session import materialize
from plexmat.sources import views

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def best_match(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(assignment.match(*halves(spark, sf)), "match")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    a, b = halves(spark, sf)
    m = best_match(spark, sf)
    return m.join(a.select(F.col("cell_id").alias("cell_a"), F.col("label").alias("label_a")), "cell_a").join(b.select(F.col("cell_id").alias("cell_b"), F.col("label").alias("label_b")), "cell_b")


def aligned(spark: SparkSession, sf: str, k: int = 2) -> DataFrame:
    """Points on 5 joint components with matched positions."""
    p = models.joint_pca(points(spark, sf, k), 5)
    p = materialize(p, "pca")
    return materialize(p.join(assignment.chain(p), ["dataset_id", "cell_id"]), "aligned")


@query("joi2_assignment")
def joi2(spark, sf):
    return best_match(spark, sf)


@query("joi3_chain")
def joi3(spark, sf):
    return assignment.chain(points(spark, sf, 5))


@query("joi4_match_distances")
def joi4(spark, sf):
    return assignment.slice_matches(points(spark, sf, 5)).groupBy("slice_a", "slice_b").agg(F.count("*").alias("n"), F.sum("dist").alias("total"))


@query("joi5_match_edges")
def joi5(spark, sf):
    return assignment.match_edges(best_match(spark, sf))


@query("joi7_folds")
def joi7(spark, sf):
    return assignment.slice_matches(points(spark, sf, 5), folds=3)


@query("joi8_all_slices")
def joi8(spark, sf):
    return assignment.slice_matches(points(spark, sf, 5), adjacent=False)


@query("joi10_mean_cost")
def joi10(spark, sf):
    return best_match(spark, sf).agg(F.avg("dist").alias("mean_cost"), F.count("*").alias("n"))


@query("dim1_joint_pca")
def dim1(spark, sf):
    return models.joint_pca(points(spark, sf), 5)


@query("dim2_separate_pca")
def dim2(spark, sf):
    return models.separate_pca(points(spark, sf), 5)


@query("dim6_explained_variance")
def dim6(spark, sf):
    return models.explained_variance(points(spark, sf), 10)


@query("dim7_component_count")
def dim7(spark, sf):
    return align.diagonal_knee(models.explained_variance(points(spark, sf), 20).select(F.col("component").alias("x"), F.col("ratio").alias("y")))


@query("clu1_gaussian_mixture")
def clu1(spark, sf):
    return models.gaussian_mixture(models.joint_pca(points(spark, sf), 5), 6)


@query("clu2_mixture_choice")
def clu2(spark, sf):
    return align.choose_size(models.mixture_curve(models.joint_pca(points(spark, sf), 4), [3, 5, 7, 9]), "uberAIC")


@query("clu5_spectral")
def clu5(spark, sf):
    return spectral.spectral(points(spark, sf), 5)


@query("clu10_spectral_growth")
def clu10(spark, sf):
    return spectral.spectral_by_poison(points(spark, sf))


@query("clu6_kmeans")
def clu6(spark, sf):
    return models.kmeans(points(spark, sf), 8)


@query("clu6_bisecting")
def clu6b(spark, sf):
    return models.bisecting_kmeans(points(spark, sf), 8)


@query("clu6_birch")
def clu6_birch(spark, sf):
    return birch.birch(points(spark, sf), 8, 0.5)


@query("clu16_joint_em")
def clu16(spark, sf):
    p = aligned(spark, sf)
    start = models.kmeans(p.where("dataset_id = 0"), 4).join(p.where("dataset_id = 0").select("cell_id", "pos"), "cell_id").select("pos", F.col("cluster").alias("label"))
    return models.joint_em(p.select("dataset_id", "pos", "vec"), start)


@query("aln4_label_matching")
def aln4(spark, sf):
    a, b = halves(spark, sf)
    return assignment.match_labels(align.canvas(best_match(spark, sf), a, b))


@query("aln5_rename")
def aln5(spark, sf):
    a, b = halves(spark, sf)
    pairs = materialize(assignment.match_labels(align.canvas(best_match(spark, sf), a, b)), "pairs")
    one, two = align.rename_shared(a, b, pairs)
    return one.withColumn("side", F.lit(0)).unionByName(two.withColumn("side", F.lit(1)))


@query("aln17_translate")
def aln17(spark, sf):
    return assignment.translate(labelled(spark, sf), "label_a", "label_b").select("cell_a", "cell_b", "label_a", "label_b", "translated")


@query("gra7_match_transfer")
def gra7(spark, sf):
    return metrics.adjusted_rand(labelled(spark, sf), "label_a", "label_b").select(r("ari"), "n")


@query("gra8_recluster_translate")
def gra8(spark, sf):
    p = points(spark, sf)
    c = models.kmeans(p.where("dataset_id = 1"), 10).join(p.select("cell_id", "label"), "cell_id")
    return assignment.translate(c, "label", "cluster").select("cell_id", "label", "cluster", "translated")


@query("ts5_align_slices")
def ts5(spark, sf):
    """Cluster centres of consecutive slices matched one to one."""
    from plexmat.operators import clustering

    c = clustering.centres(points(spark, sf, 5), ["dataset_id", "label"])
    p = c.select("dataset_id", F.col("label").cast("long").alias("cell_id"), F.col("centre").alias("vec"))
    return assignment.slice_matches(p).select("slice_a", "slice_b", F.col("cell_a").alias("label_a"), F.col("cell_b").alias("label_b"), "dist")


@query("ts6_cluster_match")
def ts6(spark, sf):
    """Cleaned canvases of all consecutive slices in one job."""
    p = points(spark, sf, 5)
    m = materialize(assignment.slice_matches(p), "slice-match")
    lab = lambda c, s, l: p.select(F.col("cell_id").alias(c), F.col("dataset_id").alias(s), F.col("label").alias(l))
    # a row for each point: not for a broadcast
    j = m.join(lab("cell_a", "slice_a", "label_a").hint("merge"), ["cell_a", "slice_a"]).join(lab("cell_b", "slice_b", "label_b").hint("merge"), ["cell_b", "slice_b"])
    n = j.groupBy("slice_a", "slice_b", "label_a", "label_b").agg(F.count("*").alias("n"))
    row, col = Window.partitionBy("slice_a", "slice_b", "label_a"), Window.partitionBy("slice_a", "slice_b", "label_b")
    return n.withColumn("kept", (F.col("n") == F.max("n").over(row)) | (F.col("n") == F.max("n").over(col)))


@query("clu3_louvain")
def clu3(spark, sf):
    return grouped.neighbour_communities(points(spark, sf), 8)


@query("clu3_leiden")
def clu3b(spark, sf):
    return grouped.neighbour_communities(points(spark, sf), 8, 0.5, refined=True)


@query("clu6_mean_shift")
def clu6d(spark, sf):
    return meanshift.mean_shift(models.joint_pca(points(spark, sf), 3), 0.25)


@query("clu7_core_distances", f"{W} SELECT cell_id, round(max(d), 6) AS core FROM (SELECT a.cell_id, {D} AS d, row_number() OVER (PARTITION BY a.cell_id ORDER BY {D}, b.cell_id) AS r FROM emb a, emb b) WHERE r <= 5 GROUP BY 1")
def clu7b(spark, sf):
    return density.core_distances(points(spark, sf)).select("cell_id", r("core"))


#: A walk in SQL: every step takes the unvisited point with the lightest edge from what is visited, and lowers the others' edges by its own.
WALK = f"""{W[:4]} RECURSIVE {W[5:]}, d AS MATERIALIZED (SELECT a.cell_id AS s, b.cell_id AS t, {D} AS d FROM emb a, emb b),
core AS (SELECT s, d AS core FROM (SELECT s, d, row_number() OVER (PARTITION BY s ORDER BY d, t) AS r FROM d) WHERE r = 5),
m AS MATERIALIZED (SELECT d.s, t, [round(greatest(d, x.core, y.core), 9), least(d.s, t), greatest(d.s, t)]::DOUBLE[] AS e FROM d JOIN core x ON x.s = d.s JOIN core y ON y.s = t),
walk AS (SELECT 0 AS step, cell_id AS v, [CASE WHEN cell_id = (SELECT min(cell_id) FROM emb) THEN -1 ELSE 1e300 END, 0, 0]::DOUBLE[] AS e, NULL::INTEGER AS place FROM emb
  UNION ALL
  SELECT step + 1, v, CASE WHEN place IS NULL AND v <> p AND m.e < x.e THEN m.e ELSE x.e END, CASE WHEN v = p THEN step ELSE place END
  FROM (SELECT *, first_value(v) OVER (ORDER BY place IS NOT NULL, e, v) AS p FROM walk WHERE step < (SELECT count(*) FROM emb)) x JOIN m ON m.s = p AND m.t = v)"""


@query("clu7_density_order", f"{WALK} SELECT v AS cell_id, place::BIGINT AS place, CASE WHEN place > 0 THEN round(e[1], 6) END AS reachability FROM walk WHERE step = (SELECT count(*) FROM emb)")
def clu7_order(spark, sf):
    return density.density_ordering(points(spark, sf)).select("cell_id", "place", r("reachability"))


@query("clu8_coclust")
def clu8(spark, sf):
    """Joint clustering of the stacked halves, reported per half."""
    return models.kmeans(points(spark, sf), 6).groupBy("dataset_id", "cluster").agg(F.count("*").alias("n"))


@query("clu13_agglomerative")
def clu13(spark, sf):
    return grouped.hierarchical(points(spark, sf, 5), 6)


@query("clu19_constrained_kmeans")
def clu19(spark, sf):
    p = points(spark, sf, 5)
    must = p.where("cell_id % 30 < 5").select("dataset_id", F.col("cell_id").alias("a"), (F.col("cell_id") + 5).alias("b"))
    cannot = p.where("cell_id % 60 < 5").select("dataset_id", F.col("cell_id").alias("a"), (F.col("cell_id") + 10).alias("b"))
    return grouped.constrained_kmeans(p, must, cannot, 5)


@query("aln13_leaf_sets")
def aln13(spark, sf):
    return grouped.leaves(grouped.merge_tree(points(spark, sf, 5)))


@query("mat6_single_linkage_cut", f"WITH RECURSIVE {basket.COSINE[5:]}, e AS (SELECT ds_a AS s, ds_b AS t FROM sim WHERE value >= 0.99 UNION SELECT ds_b, ds_a FROM sim WHERE value >= 0.99), reach AS (SELECT DISTINCT dataset_id AS node, dataset_id AS root FROM scores UNION SELECT e.t, reach.root FROM reach JOIN e ON e.s = reach.node) SELECT node::BIGINT AS dataset_id, min(root)::BIGINT AS cluster FROM reach GROUP BY 1")
def mat6(spark, sf):
    return grouped.dataset_groups(metrics.cosine(basket.scores(spark, sf)), 0.99)


@query("mat12_ari_by_components")
def mat12(spark, sf):
    """Agreement of matched labels over the number of components."""
    p, out = points(spark, sf), None
    lab = lambda c: p.select(F.col("cell_id").alias(c), F.col("label").alias(f"label_{c[-1]}"))
    full = materialize(models.joint_pca(p, 8), "pca")
    for k in (2, 4, 8):
        q = full.withColumn("vec", F.slice("vec", 1, k))
        m = assignment.match(q.where("dataset_id = 0"), q.where("dataset_id = 1")).join(lab("cell_a"), "cell_a").join(lab("cell_b"), "cell_b")
        row = metrics.adjusted_rand(m, "label_a", "label_b").select(F.lit(k).alias("components"), "ari", "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("met14_tree_vs_class")
def met14(spark, sf):
    """Agreement of cut trees with the classes, per slice, best over the number of clusters."""
    p, out = points(spark, sf, 5), None
    for k in (5, 10, 15):
        c = grouped.hierarchical(p, k).join(p.select("cell_id", "label"), "cell_id")
        row = metrics.adjusted_rand(c, "label", "cluster", ["dataset_id"]).withColumn("k", F.lit(k))
        out = row if out is None else out.unionByName(row)
    return out.groupBy("dataset_id").agg(F.max_by("k", F.struct("ari", -F.col("k"))).alias("k"), F.max("ari").alias("ari"))


@query("noi3_noise_curve")
def noi3(spark, sf):
    """Cosine of the noisy to the clean gene totals over the noise level."""
    c, obs, out = basket.brand_counts(spark, sf), views.basket_obs(spark, sf), None
    sums = lambda d: d.groupBy("dataset_id", "gene_id").agg(F.sum("x").alias("s"))
    clean = sums(c).withColumnRenamed("s", "t")
    for level in (0, 50, 100):
        j = sums(matrix.noisy(c, obs, level / 100, 5)).join(clean, ["dataset_id", "gene_id"], "full").na.fill(0.0)
        row = j.agg(F.lit(level).alias("level"), (F.sum(F.col("s") * F.col("t")) / F.sqrt(F.sum(F.col("s") * F.col("s")) * F.sum(F.col("t") * F.col("t")))).alias("cosine"))
        out = row if out is None else out.unionByName(row)
    return out


@query("gra1_block_graph")
def gra1(spark, sf):
    """Inner neighbours of both halves and their matches across."""
    p = points(spark, sf)
    inner = distance.knn(p, p, 3, groups=["dataset_id"], exclude_self=True).select("src", "dst")
    return inner.unionByName(assignment.match_edges(best_match(spark, sf)))


@query("ts1_slice_models")
def ts1(spark, sf):
    """Mixture size per slice by the knee of the AIC curve."""
    p, out = materialize(models.joint_pca(points(spark, sf, 5), 3), "pca"), None
    for s in (4, 3, 2, 1, 0):
        row = align.choose_size(models.mixture_curve(p.where(F.col("dataset_id") == s), [2, 3, 4], rounds=10), "uberAIC").withColumn("slice", F.lit(s))
        out = row if out is None else out.unionByName(row)
    return out


@query("ts7_continuing_labels")
def ts7(spark, sf):
    p = points(spark, sf, 5)
    return lineage.continuing_labels(p, materialize(lineage.slice_canvas(p), "canvas"))


@query("ts9_differentiation")
def ts9(spark, sf):
    return lineage.differentiation(points(spark, sf, 5))[1]


@query("ts10_slice_canvases")
def ts10(spark, sf):
    return lineage.slice_canvas(points(spark, sf, 5))


@query("aln9_split_and_merge")
def aln9(spark, sf):
    a, b, _ = lineage.split_and_merge(*(h.select("cell_id", "label", "vec") for h in halves(spark, sf)))
    return a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))


@query("aln11_alignment_report")
def aln11(spark, sf):
    return lineage.split_and_merge(*(h.select("cell_id", "label", "vec") for h in halves(spark, sf)))[2]


@query("met2_ranked_rand")
def met2(spark, sf):
    from plexmat.operators import clustering

    a, b = halves(spark, sf)
    c = lambda h: materialize(clustering.centres(h, ["label"]), "centres")
    return lineage.ranked_rand(labelled(spark, sf), "label_a", "label_b", c(a), c(b))


@query("met7_misplaced_matches")
def met7(spark, sf):
    """Matches outside the label pairing, over all matches, with the agreement."""
    l = labelled(spark, sf)
    a, b = halves(spark, sf)
    pairs = materialize(assignment.match_labels(align.canvas(l.select("cell_a", "cell_b", "dist"), a, b)), "pairs").select("label_a", "label_b", F.lit(True).alias("paired"))
    j = l.join(F.broadcast(pairs), ["label_a", "label_b"], "left").agg(F.count_if(F.col("paired").isNull()).alias("misplaced"), F.count("*").alias("n_matches"))
    return j.join(metrics.adjusted_rand(l, "label_a", "label_b").select(r("ari")))


@query("met12_single_vs_joint")
def met12(spark, sf):
    """Best F1 per true label of clustering one half alone and both together."""
    p = points(spark, sf)
    one, joint = models.kmeans(p.where("dataset_id = 0"), 10), models.kmeans(p, 10).where("dataset_id = 0")
    f1 = lambda c, name: metrics.best_f1(c.join(p.select("cell_id", "label"), "cell_id"), "label", "cluster").select("label", F.col("f1").alias(name))
    return f1(one, "alone").join(f1(joint, "together"), "label")


@query("sim5_cluster_similarity")
def sim5(spark, sf):
    """Ranked Rand index of a mixture on the matched halves."""
    from plexmat.operators import clustering

    p = materialize(models.joint_pca(points(spark, sf), 5), "pca")
    c = materialize(models.kmeans(p, 6).join(p, ["dataset_id", "cell_id"]), "clusters")
    m = assignment.match(p.where("dataset_id = 0"), p.where("dataset_id = 1"))
    side = lambda d, x: c.where(f"dataset_id = {d}").select(F.col("cell_id").alias(f"cell_{x}"), F.col("cluster").alias(f"label_{x}"))
    l = materialize(m.join(side(0, "a"), "cell_a").join(side(1, "b"), "cell_b"), "labelled")
    cen = lambda d: materialize(clustering.centres(c.where(f"dataset_id = {d}").withColumnRenamed("cluster", "label"), ["label"]), "centres")
    return lineage.ranked_rand(l, "label_a", "label_b", cen(0), cen(1))
