"""Certificates: what SQL can check of operators that it can't express.

A query here runs the operator over its whole table and returns properties that prove or bound its result (duality, isometry, fixpoints,
one-to-one shapes); the SQL derives the same values from the tables alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plexmat.operators import align, assignment, birch, clustering, distance, graph, grouped, hops, lineage, matrix, models, spectral
from plexmat.plans import basket
from plexmat.plans.basket import r
from plexmat.plans.fitted import best_match, labelled
from plexmat.plans.points import D, HOPS, MATCH, S5, W, graph_edges, halves, points, rank_match
from plexmat.session import materialize
from plexmat.sources import views

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


SIDES = "s AS (SELECT count(*) FILTER (dataset_id = 0) AS na, count(*) FILTER (dataset_id = 1) AS nb FROM emb)"
#: Cells of neighbouring slices, and of all pairs of slices.
SLICES = "n AS (SELECT dataset_id, count(*) AS n FROM emb GROUP BY 1), p AS (SELECT a.dataset_id AS slice_a, b.dataset_id AS slice_b, least(a.n, b.n) AS n FROM n a JOIN n b ON {on})"
NEXT, EVERY = SLICES.format(on="b.dataset_id = a.dataset_id + 1"), SLICES.format(on="a.dataset_id < b.dataset_id")


def one_to_one(matches: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, cells_a, cells_b) of matches."""
    return matches.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("cell_a").alias("cells_a"), F.count_distinct("cell_b").alias("cells_b"))


@query("joi2_optimality", f"{W}, {SIDES} SELECT least(na, nb) AS n, least(na, nb) AS cells_a, least(na, nb) AS cells_b, true AS feasible, true AS tight FROM s")
def joi2_optimality(spark, sf):
    """The matching is one to one, its distances are those of its points, and their sum is the value of duals that are feasible for all pairs: no matching is cheaper."""
    a, b = halves(spark, sf)
    m = best_match(spark, sf)
    both = m.join(a.select(F.col("cell_id").alias("cell_a"), F.col("vec").alias("va")), "cell_a").join(b.select(F.col("cell_id").alias("cell_b"), F.col("vec").alias("vb")), "cell_b")
    cost = both.agg(F.sum(distance.distance("va", "vb")).alias("own"))
    d = assignment.duality(a, b).join(cost).select((F.col("least_slack") > -1e-7).alias("feasible"), (F.abs(F.col("own") - F.col("dual")) <= 1e-7 * (1 + F.col("own"))).alias("tight"))
    return one_to_one(m, []).join(d)


@query("joi2_rounds", f"{W}, {SIDES} SELECT least(na, nb) AS n, least(na, nb) AS cells_a, least(na, nb) AS cells_b, true AS bounded, true AS near FROM s")
def joi2_rounds(spark, sf):
    """The matching of pairs beyond one task, here in small blocks: one to one, complete, and within 15 % of a lower bound of every matching."""
    a, b = halves(spark, sf)
    one = F.lit(0).alias("pair")
    couples = assignment.match_in_rounds(a.select(one, "cell_id", "vec", F.lit(None).cast("array<long>").alias("barred")), b.select(one, "cell_id", "vec"), block=100)
    # prices of blocks bound little where many points are equal; those of a cheapest matching always do
    proved = assignment.duality(a, b).select(F.when(F.col("least_slack") > -1e-7, F.col("dual")).alias("dual"))
    bounds = assignment.lower_bound(couples).join(proved).withColumn("best", F.greatest("bound", "dual"))
    d = bounds.select((F.col("best") <= F.col("cost") + 1e-7 * (1 + F.col("cost"))).alias("bounded"), (F.col("cost") <= 1.15 * F.col("best")).alias("near"))
    return one_to_one(couples.where("dist IS NOT NULL"), []).join(d)


@query("joi3_positions", f"{S5}, n AS (SELECT dataset_id, count(*) AS n FROM emb GROUP BY 1) SELECT dataset_id, min(n) OVER (ORDER BY dataset_id) AS n, min(n) OVER (ORDER BY dataset_id) AS positions FROM n")
def joi3_positions(spark, sf):
    """A slice has a position for each cell that the smallest slice so far could hand on, each position once."""
    return assignment.chain(points(spark, sf, 5)).groupBy("dataset_id").agg(F.count("*").alias("n"), F.count_distinct("pos").alias("positions"))


@query("joi4_matched", f"{S5}, {NEXT} SELECT slice_a, slice_b, n, n AS cells_a, n AS cells_b FROM p")
def joi4_matched(spark, sf):
    return one_to_one(assignment.slice_matches(points(spark, sf, 5)), ["slice_a", "slice_b"])


@query("joi5_both_ways", f"{W}, {SIDES} SELECT 2 * least(na, nb) AS edges, least(na, nb) AS pairs FROM s")
def joi5_both_ways(spark, sf):
    e = assignment.match_edges(best_match(spark, sf))
    return e.agg(F.count("*").alias("edges"), F.count_distinct(F.least("src", "dst"), F.greatest("src", "dst")).alias("pairs"))


@query("joi7_disjoint_folds", f"{S5}, {NEXT} SELECT slice_a, slice_b, fold::INT AS fold, n, n AS cells_a, n AS cells_b, 3 * n AS pairs FROM p, range(3) t(fold)")
def joi7_disjoint_folds(spark, sf):
    """Every fold is one to one and no pair comes twice."""
    m = materialize(assignment.slice_matches(points(spark, sf, 5), folds=3), "folds")
    pairs = m.groupBy("slice_a", "slice_b").agg(F.count_distinct("cell_a", "cell_b").alias("pairs"))
    return one_to_one(m, ["slice_a", "slice_b", "fold"]).join(F.broadcast(pairs), ["slice_a", "slice_b"])


@query("joi8_matched", f"{S5}, {EVERY} SELECT slice_a, slice_b, n, n AS cells_a, n AS cells_b FROM p")
def joi8_matched(spark, sf):
    return one_to_one(assignment.slice_matches(points(spark, sf, 5), adjacent=False), ["slice_a", "slice_b"])


@query("joi10_cost_bounds", f"{MATCH}, near AS (SELECT a.cell_id, min({D}) AS d FROM emb a JOIN emb b ON a.dataset_id = 0 AND b.dataset_id = 1 GROUP BY 1) SELECT count(*) AS n, true AS above_nearest, true AS below_ranks, round(avg(dist), 6) AS rank_cost FROM m")
def joi10_cost_bounds(spark, sf):
    """The mean cost lies between that of nearest neighbours and that of the match by rank."""
    a, b = halves(spark, sf)
    few, many = (a, b) if a.count() <= b.count() else (b, a)  # every point of the smaller side is matched
    near = distance.knn(few.select("cell_id", "vec"), many.select("cell_id", "vec"), 1).agg(F.sum("dist").alias("nearest"))
    ranks = rank_match(spark, sf).agg(F.sum("dist").alias("ranks"), F.avg("dist").alias("rank_cost"))
    own = best_match(spark, sf).agg(F.sum("dist").alias("cost"), F.count("*").alias("n"))
    return own.join(near).join(ranks).select("n", (F.col("cost") >= F.col("nearest") - 1e-9).alias("above_nearest"), (F.col("cost") <= F.col("ranks") + 1e-9).alias("below_ranks"), r("rank_cost"))


NORMS = "m AS (SELECT {g} dim, avg(v) AS m FROM long GROUP BY ALL) SELECT l.dataset_id, cell_id, round(sum((v - m) ** 2), 6) AS norm FROM long l JOIN m USING ({k}) GROUP BY 1, 2"
LONG = "long AS (SELECT dataset_id, cell_id, unnest(vec) AS v, generate_subscripts(vec, 1) AS dim FROM emb)"


def norms(p: DataFrame) -> DataFrame:
    return p.select("dataset_id", "cell_id", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


def dimension(p: DataFrame) -> int:
    return len(p.select("vec").first().vec)


@query("dim1_isometry", f"{W}, {LONG}, {NORMS.format(g='', k='dim')}")
def dim1_isometry(spark, sf):
    """On all components every point keeps its distance from the joint mean."""
    p = points(spark, sf)
    return norms(models.joint_pca(p, dimension(p)))


@query("dim2_isometry", f"{W}, {LONG}, {NORMS.format(g='dataset_id,', k='dataset_id, dim')}")
def dim2_isometry(spark, sf):
    """The same with a model of its own for each dataset."""
    p = points(spark, sf)
    return norms(models.separate_pca(p, dimension(p)))


@query("dim6_total_variance", f"{W}, {LONG}, v AS (SELECT dim, var_samp(v) AS v FROM long GROUP BY 1) SELECT count(*) AS components, round(sum(v), 6) AS total, true AS descending, true AS uncorrelated, true AS ratios FROM v")
def dim6_total_variance(spark, sf):
    """Components are uncorrelated, their variances descend, add up to the total, and are the reported ratios of it."""
    p = points(spark, sf)
    k = dimension(p)
    q = materialize(models.joint_pca(p, k), "pca")
    long = q.select("cell_id", F.posexplode("vec").alias("i", "x"))
    var = long.groupBy("i").agg(F.var_samp("x").alias("v"))
    total = var.agg(F.sum("v").alias("total"), F.count("*").alias("components"))
    order = var.withColumn("before", F.lag("v").over(Window.orderBy("i"))).agg(F.coalesce(F.bool_and(F.col("v") <= F.col("before") + 1e-9), F.lit(True)).alias("descending"))  # a row a component
    cross = q.select(F.posexplode("vec").alias("i", "x"), "vec").select("i", "x", F.posexplode("vec").alias("j", "y")).where("i < j").groupBy("i", "j").agg(F.corr("x", "y").alias("c"))
    ratio = models.explained_variance(p, k).join(var.withColumn("component", F.col("i") + 1), "component").join(F.broadcast(total))
    return total.select("components", r("total")).join(order).join(cross.agg((F.max(F.abs("c")) < 1e-6).alias("uncorrelated"))).join(
        ratio.agg((F.max(F.abs(F.col("ratio") - F.col("v") / F.col("total"))) < 1e-6).alias("ratios")))


def fixpoint(p: DataFrame, c: DataFrame) -> DataFrame:
    """(n, misplaced): points that are nearer to another cluster's mean than to their own."""
    own = p.select("cell_id", "vec").join(c.select("cell_id", F.col("cluster").alias("label")), "cell_id")
    cen = materialize(clustering.centres(own, ["label"]), "centres")
    d = own.join(F.broadcast(cen.select(F.col("label").alias("c"), "centre"))).withColumn("d", distance.distance("vec", "centre"))
    per = d.groupBy("cell_id").agg(F.min("d").alias("least"), F.min(F.when(F.col("c") == F.col("label"), F.col("d"))).alias("own"))
    return per.agg(F.count("*").alias("n"), F.count_if(F.col("own") > F.col("least") + 1e-3).alias("misplaced"))


@query("clu6_fixpoint", "SELECT count(*) AS n, 0::BIGINT AS misplaced FROM embeddings")
def clu6_fixpoint(spark, sf):
    p = points(spark, sf)
    return fixpoint(p, models.kmeans(p, 8))


@query("clu6_features", f"{W}, {LONG} SELECT dim, count(*) AS n, round(sum(v), 6) AS total, true AS within FROM long GROUP BY 1")
def clu6_features(spark, sf):
    """The features of Birch's tree add up to the number and the sum of all points in every dimension, and each keeps within its radius."""
    f = materialize(birch.features(points(spark, sf), 0.5), "features")
    centre = F.aggregate("total", F.lit(0.0), lambda s, x: s + x * x) / (F.col("n") * F.col("n"))
    within = f.agg(F.bool_and(F.col("squares") / F.col("n") - centre <= F.col("threshold") * F.col("threshold") + 1e-9).alias("within"))
    sums = f.select("n", F.posexplode("total").alias("i", "v")).groupBy((F.col("i") + 1).cast("long").alias("dim")).agg(F.sum("n").alias("n"), F.round(F.sum("v"), 6).alias("total"))
    return sums.join(F.broadcast(within)).select("dim", "n", "total", "within")


@query("clu8_totals", f"{W} SELECT dataset_id, count(*) AS n FROM emb GROUP BY 1")
def clu8_totals(spark, sf):
    """Joint clusters hold every point of either half once."""
    p = points(spark, sf)
    return models.kmeans(p, 6).groupBy("dataset_id").agg(F.count_distinct("cell_id").alias("n"))


KNN8 = f"k AS (SELECT src, dst, d FROM (SELECT a.cell_id AS src, b.cell_id AS dst, {D} AS d, row_number() OVER (PARTITION BY a.cell_id ORDER BY {D}, b.cell_id) AS r FROM emb a JOIN emb b ON a.cell_id <> b.cell_id) WHERE r <= 8)"


@query("clu3_connected", f"{W}, {KNN8} SELECT (SELECT count(*) FROM emb) AS n, round(sum(1 / (1 + d)), 6) AS weight, true AS connected, true AS settled FROM k")
def clu3_connected(spark, sf):
    """Leiden communities hold every point of the weighted graph once, are connected inside, and no point has links below the resolution's bound to the rest of its own."""
    from plexmat.operators import leiden
    from plexmat.operators.components import connected_components

    p = points(spark, sf)
    e = grouped.neighbour_edges(p, 8)
    c = materialize(leiden.leiden(e, 0.5), "communities")
    of = lambda x: c.select(F.col("node").alias(x), F.col("community").alias(f"c{x}"))
    inner = materialize(e.join(of("src"), "src").join(of("dst"), "dst").where("csrc = cdst"), "inner")
    parts = connected_components(inner).select("node", "component")
    own = c.join(parts, "node", "left").groupBy("community").agg(F.count_distinct(F.coalesce("component", "node")).alias("parts"), F.count_distinct("node").alias("n"))
    both = leiden.both_ways(leiden.one_weight_a_pair(e))
    k = materialize(leiden.degrees(both), "degrees")
    mass = k.join(c, "node").groupBy("community").agg(F.sum("k").alias("mass"), F.count("*").alias("size"))
    reach = inner.select(F.explode(F.array("src", "dst")).alias("node"), "weight").groupBy("node").agg(F.sum("weight").alias("reach"))
    total = k.agg(F.sum("k").alias("total"))
    loose = k.join(c, "node").join(mass, "community").join(reach, "node", "left").join(F.broadcast(total)).where("size > 1").agg(
        F.count_if(F.coalesce("reach", F.lit(0.0)) < 0.5 * F.col("k") * (F.col("mass") - F.col("k")) / F.col("total") - 1e-9).alias("loose"))
    weight = e.agg(F.round(F.sum("weight"), 6).alias("weight"))
    return own.agg(F.sum("n").alias("n"), (F.max("parts") == 1).alias("connected")).join(weight).join(loose).select("n", "weight", "connected", (F.col("loose") == 0).alias("settled"))


@query("clu5_residuals", f"{W}, k AS (SELECT src, dst FROM (SELECT a.cell_id AS src, b.cell_id AS dst, row_number() OVER (PARTITION BY a.cell_id ORDER BY {D}, b.cell_id) AS r FROM emb a JOIN emb b ON a.cell_id <> b.cell_id) WHERE r <= 10), w AS (SELECT src, dst, sum(0.5) AS w FROM (SELECT * FROM k UNION ALL SELECT dst, src FROM k) GROUP BY 1, 2), d AS (SELECT src, sum(w) AS d FROM w GROUP BY 1) SELECT (SELECT count(*) FROM d) AS n, round(sum(w * w / (x.d * y.d)), 6) AS squares, true AS residuals, true AS orthonormal, true AS first FROM w JOIN d x ON x.src = w.src JOIN d y ON y.src = w.dst")
def clu5_residuals(spark, sf):
    """The graph's matrix has SQL's sum of squares; five vectors are orthonormal eigenvectors of it, the first with eigenvalue 1."""
    graph = spectral.neighbour_graph(points(spark, sf))
    matrix, degree = spectral.normalised(graph)
    vectors, values, off = spectral.embedding(graph, 5)
    names = [f"x{i}" for i in range(5)]
    gram = spectral.gram(vectors, names, names)
    good = max(abs(gram[i][j] - (i == j)) for i in range(5) for j in range(5)) < 1e-6
    sums = matrix.agg(F.round(F.sum(F.col("s") * F.col("s")), 6).alias("squares")).join(degree.agg(F.count("*").alias("n")))
    return sums.select("n", "squares", F.lit(bool(max(off) < 1e-6)).alias("residuals"), F.lit(bool(good)).alias("orthonormal"), F.lit(bool(abs(values[0] - 1) < 1e-9)).alias("first"))


@query("clu13_tree_shape", f"{S5} SELECT dataset_id, count(*) - 1 AS merges, count(*) AS root_size, 2 * (count(*) - 1) AS children, true AS rising FROM emb GROUP BY 1")
def clu13_tree_shape(spark, sf):
    """A merge tree has n - 1 nodes over n leaves, every node but the root is a child once, and heights rise."""
    t = materialize(grouped.merge_tree(points(spark, sf, 5)), "tree")
    up = t.select("dataset_id", F.explode(F.array("left", "right")).alias("child"), F.col("height").alias("above"))
    low = up.join(t.select("dataset_id", F.col("node").alias("child"), "height"), ["dataset_id", "child"]).groupBy("dataset_id").agg(F.bool_and(F.col("height") <= F.col("above") + 1e-9).alias("rising"))
    return t.groupBy("dataset_id").agg(F.count("*").alias("merges"), F.max("size").alias("root_size")).join(
        up.groupBy("dataset_id").agg(F.count_distinct("child").alias("children")), "dataset_id").join(low, "dataset_id")


@query("aln13_leaf_counts", f"{S5} SELECT dataset_id, count(*) AS leaves, true AS by_size FROM emb GROUP BY 1")
def aln13_leaf_counts(spark, sf):
    """Every inner node has as many leaves as its size says, the root all of them."""
    t = materialize(grouped.merge_tree(points(spark, sf, 5)), "tree")
    n = grouped.leaves(t).groupBy("dataset_id", "node").agg(F.count_distinct("leaf").alias("n"))
    return n.join(t.select("dataset_id", "node", "size"), ["dataset_id", "node"]).groupBy("dataset_id").agg(F.max("n").alias("leaves"), F.bool_and(F.col("n") == F.col("size")).alias("by_size"))


@query("clu19_constraints_kept", f"{S5} SELECT dataset_id, count(*) AS n, true AS feasible, 0::BIGINT AS broken FROM emb GROUP BY 1")
def clu19_constraints_kept(spark, sf):
    """Every point has a cluster and no must-link or cannot-link is broken."""
    p = points(spark, sf, 5)
    must = p.where("cell_id % 30 < 5").select("dataset_id", F.col("cell_id").alias("a"), (F.col("cell_id") + 5).alias("b"))
    cannot = p.where("cell_id % 60 < 5").select("dataset_id", F.col("cell_id").alias("a"), (F.col("cell_id") + 10).alias("b"))
    c = materialize(grouped.constrained_kmeans(p, must, cannot, 5), "constrained")
    broken = clustering.violations(c, must.select("a", "b"), cannot.select("a", "b")).agg(F.count("*").alias("broken"))
    return c.groupBy("dataset_id").agg(F.count_distinct("cell_id").alias("n"), F.bool_and(F.col("cluster") >= 0).alias("feasible")).join(F.broadcast(broken))


def subset_steps(n: int) -> str:
    """CTEs of a dynamic program over sets of columns: the best total of a one-to-one pairing of rows and columns."""
    steps = ["b0 AS (SELECT 0 AS mask, 0.0::DOUBLE AS w)"]
    for i in range(n):
        steps.append(f"b{i + 1} AS (SELECT mask, min(w) AS w FROM (SELECT mask, w FROM b{i} UNION ALL SELECT b.mask | (1 << c.j), b.w + c.w FROM b{i} b JOIN cell c ON c.i = {i} AND (b.mask & (1 << c.j)) = 0) GROUP BY 1)")
    return ", ".join(steps)


CELLS = """na AS (SELECT label AS label_a, count(*) AS n_a FROM emb WHERE dataset_id = 0 GROUP BY 1), nb AS (SELECT label AS label_b, count(*) AS n_b FROM emb WHERE dataset_id = 1 GROUP BY 1),
cell AS (SELECT (dense_rank() OVER (ORDER BY label_a) - 1)::INT AS i, (dense_rank() OVER (ORDER BY label_b) - 1)::INT AS j, -2.0 * n / (n_a + n_b) AS w FROM (SELECT label_a, label_b, count(*) AS n FROM m GROUP BY 1, 2) JOIN na USING (label_a) JOIN nb USING (label_b))"""


@query("aln4_pairing_total", f"{MATCH}, {CELLS}, {subset_steps(12)} SELECT round(min(w), 6) AS total FROM b12")
def aln4_pairing_total(spark, sf):
    """The weight of the best pairing of at most 12 labels, on the match by rank; SQL finds it by a dynamic program over sets."""
    a, b = halves(spark, sf)
    return assignment.match_labels(align.canvas(rank_match(spark, sf).select("cell_a", "cell_b", "dist"), a, b)).agg(F.round(F.sum("w"), 6).alias("total"))


@query("aln5_names", f"{W}, l AS (SELECT dataset_id, label, count(*) AS n FROM emb GROUP BY 1, 2) SELECT a.label AS old_a, a.label AS old_b, (row_number() OVER (ORDER BY a.label) - 1)::INT AS new, a.n AS n_a, b.n AS n_b FROM l a JOIN l b USING (label) WHERE a.dataset_id = 0 AND b.dataset_id = 1")
def aln5_names(spark, sf):
    """Names for labels that are paired with themselves."""
    a, b = halves(spark, sf)
    pairs = a.select(F.col("label").alias("label_a")).distinct().join(b.select(F.col("label").alias("label_b")).distinct(), F.col("label_a") == F.col("label_b"))
    one, two = align.rename_shared(a, b, pairs)
    size = lambda d, n: d.groupBy("label").agg(F.count("*").alias(n))
    return one.select(F.col("old").alias("old_a"), "new").join(two.select(F.col("old").alias("old_b"), "new"), "new").join(
        size(a, "n_a"), F.col("old_a") == F.col("label")).drop("label").join(size(b, "n_b"), F.col("old_b") == F.col("label")).select("old_a", "old_b", "new", "n_a", "n_b")


RENAMED = "l AS (SELECT dataset_id AS side, label AS old, count(*) AS n FROM emb GROUP BY 1, 2), p AS (SELECT DISTINCT old FROM l WHERE side = 0 AND old < 5 INTERSECT SELECT DISTINCT old FROM l WHERE side = 1 AND old < 5), k AS (SELECT count(*) AS k FROM p)"


@query("aln6_rename_log", f"{W}, {RENAMED}, f AS (SELECT side, old, row_number() OVER (ORDER BY side, old) - 1 AS place FROM l WHERE old NOT IN (SELECT old FROM p)) SELECT side, old, coalesce(f.place + k, (SELECT count(*) FROM p q WHERE q.old < l.old))::INT AS new, f.place IS NULL AS shared, n FROM l LEFT JOIN f USING (side, old), k")
def aln6_rename_log(spark, sf):
    """What became of every label: its new name, whether the other side shares it, and how many cells carry it."""
    a, b = halves(spark, sf)
    low = lambda d, c: d.where("label < 5").select(F.col("label").alias(c)).distinct()
    pairs = low(a, "label_a").join(low(b, "label_b"), F.col("label_a") == F.col("label_b"))
    return align.rename_log(a, b, pairs)


def slice_ranks(spark, sf) -> DataFrame:
    """The n-th cells of neighbouring slices."""
    p = points(spark, sf, 5).withColumn("pos", F.row_number().over(Window.partitionBy("dataset_id").orderBy("cell_id")))
    a = p.select(F.col("dataset_id").alias("slice_a"), F.col("cell_id").alias("cell_a"), "pos", F.col("vec").alias("va"))
    b = p.select(F.col("dataset_id").alias("slice_b"), (F.col("dataset_id") - 1).alias("slice_a"), F.col("cell_id").alias("cell_b"), "pos", F.col("vec").alias("vb"))
    return a.join(b, ["slice_a", "pos"]).select("slice_a", "slice_b", "cell_a", "cell_b", distance.distance("va", "vb").alias("dist"))


RANKS5 = f"""{S5}, p AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY cell_id) AS pos FROM emb), m AS (SELECT a.dataset_id AS slice_a, a.label AS label_a, b.label AS label_b FROM p a JOIN p b ON b.dataset_id = a.dataset_id + 1 AND a.pos = b.pos),
c AS (SELECT slice_a, label_a, label_b, count(*) AS n FROM m GROUP BY ALL), z AS (SELECT dataset_id, label, count(*) AS n FROM emb GROUP BY 1, 2)"""


@query("ts10_rank_canvases", f"{RANKS5} SELECT c.slice_a, label_a, label_b, round(-2.0 * c.n / (a.n + b.n), 6) AS w FROM c JOIN z a ON a.dataset_id = c.slice_a AND a.label = label_a JOIN z b ON b.dataset_id = c.slice_a + 1 AND b.label = label_b")
def ts10_rank_canvases(spark, sf):
    """The canvases of consecutive slices, on matches by rank."""
    return lineage.slice_canvas(points(spark, sf, 5), slice_ranks(spark, sf)).select("slice_a", "label_a", "label_b", r("w"))


@query("ts5_shape", f"{S5}, n AS (SELECT dataset_id, count(DISTINCT label) AS n FROM emb GROUP BY 1) SELECT a.dataset_id AS slice_a, b.dataset_id AS slice_b, least(a.n, b.n) AS n, least(a.n, b.n) AS labels_a, least(a.n, b.n) AS labels_b FROM n a JOIN n b ON b.dataset_id = a.dataset_id + 1")
def ts5_shape(spark, sf):
    """Centres of consecutive slices are matched one to one."""
    c = clustering.centres(points(spark, sf, 5), ["dataset_id", "label"])
    m = assignment.slice_matches(c.select("dataset_id", F.col("label").cast("long").alias("cell_id"), F.col("centre").alias("vec")))
    return m.groupBy("slice_a", "slice_b").agg(F.count("*").alias("n"), F.count_distinct("cell_a").alias("labels_a"), F.count_distinct("cell_b").alias("labels_b"))


@query("gra1_degrees", f"{W}, {SIDES}, n AS (SELECT dataset_id, count(*) AS n FROM emb GROUP BY 1) SELECT (SELECT sum(n * least(3, n - 1)) FROM n)::BIGINT AS inside, 2 * least(na, nb) AS across FROM s")
def gra1_degrees(spark, sf):
    """Edges inside the halves and across them."""
    from plexmat.plans.fitted import gra1

    half = points(spark, sf).select("cell_id", "dataset_id")
    e = gra1(spark, sf).join(half.select(F.col("cell_id").alias("src"), F.col("dataset_id").alias("da")), "src").join(half.select(F.col("cell_id").alias("dst"), F.col("dataset_id").alias("db")), "dst")
    return e.agg(F.count_if(F.col("da") == F.col("db")).alias("inside"), F.count_if(F.col("da") != F.col("db")).alias("across"))


@query("met7_counts", f"{W}, {SIDES} SELECT least(na, nb) AS n_matches, true AS within FROM s")
def met7_counts(spark, sf):
    from plexmat.plans.fitted import met7

    return met7(spark, sf).select("n_matches", ((F.col("misplaced") >= 0) & (F.col("misplaced") <= F.col("n_matches")) & (F.col("ari") <= 1)).alias("within"))


@query("gra7_counts", f"{W}, {SIDES} SELECT least(na, nb) AS n, true AS within FROM s")
def gra7_counts(spark, sf):
    from plexmat.operators import metrics

    return metrics.adjusted_rand(labelled(spark, sf), "label_a", "label_b").select("n", F.col("ari").between(-1.0, 1.0).alias("within"))


def spread_steps(rounds: int, alpha: float) -> str:
    """CTEs of label spreading over s (src, dst, sim)."""
    head = f"""off AS (SELECT src, dst, sim FROM raw WHERE src <> dst AND sim > 0), deg AS (SELECT src, sum(sim) AS d FROM off GROUP BY 1),
s AS MATERIALIZED (SELECT o.src, o.dst, o.sim / sqrt(a.d * b.d) AS s FROM off o JOIN deg a ON a.src = o.src JOIN deg b ON b.src = o.dst), f0 AS (SELECT cell_id AS node, label, 1.0::DOUBLE AS f FROM emb WHERE dataset_id = 0)"""
    steps = [f"f{i + 1} AS (SELECT node, label, sum(f) AS f FROM (SELECT s.src AS node, f.label, {alpha} * sum(s.s * f.f) AS f FROM s JOIN f{i} f ON f.node = s.dst GROUP BY 1, 2 UNION ALL SELECT node, label, {1 - alpha}::DOUBLE FROM f0) GROUP BY 1, 2)" for i in range(rounds)]
    return ", ".join([head, *steps]) + f" SELECT node, label FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(f, 9) DESC, label) AS place FROM f{rounds}) WHERE place = 1"


@query("gra4_spread_rounds", f"{HOPS}, t AS (SELECT src, dst, (max(hops) OVER () - hops) / (max(hops) OVER () - min(hops) OVER ()) AS s FROM h), md AS (SELECT median(s) AS m FROM (SELECT DISTINCT s FROM t)), raw AS (SELECT src, dst, CASE WHEN s < m THEN 0 ELSE s * s END AS sim FROM t, md), {spread_steps(10, 0.2)}")
def gra4_spread_rounds(spark, sf):
    """Ten rounds of label spreading on hop similarities."""
    return hops.spread_labels(graph_edges(spark, sf), halves(spark, sf)[0].select(F.col("cell_id").alias("node"), "label"), rounds=10)


@query("gra5_radial_spreading", f"{W}, k AS (SELECT src, dst, d FROM (SELECT a.cell_id AS src, b.cell_id AS dst, {D} AS d, row_number() OVER (PARTITION BY a.cell_id ORDER BY {D}, b.cell_id) AS r FROM emb a JOIN emb b ON a.cell_id <> b.cell_id) WHERE r <= 8), raw AS (SELECT src, dst, exp(-1.0 * min(d) ** 2) AS sim FROM (SELECT src, dst, d FROM k UNION ALL SELECT dst, src, d FROM k) GROUP BY 1, 2), {spread_steps(10, 0.2)}")
def gra5_radial_spreading(spark, sf):
    """Label spreading with a radial kernel on the neighbour graph, not on all pairs."""
    p = points(spark, sf).select("cell_id", "vec")
    sim = materialize(graph.radial_similarity(distance.knn(p, p, 8, exclude_self=True), 1.0), "radial")
    return graph.spread_labels(sim, halves(spark, sf)[0].select(F.col("cell_id").alias("node"), "label"), rounds=10)


NOISE = basket.ORACLES["noi1_noise"].replace("CASE WHEN ua < 0.3", "CASE WHEN ua < level / 100.0").replace("'3a:'", "'5a:'").replace("'3b:'", "'5b:'")
NOISE = NOISE.replace("d AS (SELECT dataset_id, gene_id, cell_id,", "levels AS (SELECT unnest([0, 50, 100])::INT AS level), d AS (SELECT level, dataset_id, gene_id, cell_id,").replace("AS donor FROM u)", "AS donor FROM u, levels)")
NOISE = NOISE[: NOISE.rindex("SELECT d.dataset_id")]


@query("noi3_noise_levels", f"""{NOISE}, t AS (SELECT dataset_id, gene_id, sum(x) AS t FROM small GROUP BY 1, 2), s AS (SELECT level, d.dataset_id, d.gene_id, sum(s.x) AS s FROM d JOIN c ON c.dataset_id = d.dataset_id AND c.pos = d.donor JOIN small s ON s.dataset_id = d.dataset_id AND s.cell_id = c.cell_id AND s.gene_id = d.gene_id GROUP BY 1, 2, 3)
SELECT level, round(sum(coalesce(s, 0) * t) / sqrt(sum(coalesce(s, 0) ** 2) * sum(t ** 2)), 6) AS cosine FROM (SELECT * FROM levels, t) LEFT JOIN s USING (level, dataset_id, gene_id) GROUP BY 1""")
def noi3_noise_levels(spark, sf):
    from plexmat.plans.fitted import noi3

    return noi3(spark, sf).select("level", r("cosine"))
