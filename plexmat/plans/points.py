"""Queries over the embedding points: distances, neighbours, clustering steps, alignment, lineages, graphs, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plexmat.operators import align, clustering, distance, graph, hops, metrics, neighbours, preprocess
from plexmat.plans.basket import r
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


def points(spark: SparkSession, sf: str, k: int = 2) -> DataFrame:
    return views.embedding_points(spark, sf, k)


def halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = points(spark, sf)
    return p.where("dataset_id = 0"), p.where("dataset_id = 1")


def rank_match(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed one-to-one match: the n-th point of either half by id, with its distance."""
    p = points(spark, sf).withColumn("pos", F.row_number().over(Window.partitionBy("dataset_id").orderBy("cell_id")))
    a = p.where("dataset_id = 0").select("pos", F.col("cell_id").alias("cell_a"), F.col("vec").alias("va"), F.col("label").alias("label_a"))
    b = p.where("dataset_id = 1").select("pos", F.col("cell_id").alias("cell_b"), F.col("vec").alias("vb"), F.col("label").alias("label_b"))
    return a.join(b, "pos").select("pos", "cell_a", "cell_b", distance.distance("va", "vb").alias("dist"), "label_a", "label_b")


W = f"WITH {views.EMB_SQL.format(k=2)}"
S5 = f"WITH {views.EMB_SQL.format(k=5)}"
D = "list_distance(a.vec, b.vec)"
MATCH = f"""{W}, p AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY cell_id) AS pos FROM emb),
m AS (SELECT pos, a.cell_id AS cell_a, b.cell_id AS cell_b, {D} AS dist, a.label AS label_a, b.label AS label_b FROM p a JOIN p b USING (pos) WHERE a.dataset_id = 0 AND b.dataset_id = 1)"""
SQ = "list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) ** 2))"
L1 = "list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: abs(z[1] - z[2])))"
CANBERRA = "list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: CASE WHEN abs(z[1]) + abs(z[2]) > 0 THEN abs(z[1] - z[2]) / (abs(z[1]) + abs(z[2])) ELSE 0 END))"


def _pairwise(metric: str, sql: str):
    name = {"euclidean": "l2"}.get(metric, metric)

    @query(f"joi1_pairwise_{name}", f"{W} SELECT a.cell_id AS src, b.cell_id AS dst, round({sql}, 6) AS dist FROM emb a JOIN emb b ON a.dataset_id = 0 AND b.dataset_id = 1")
    def run(spark, sf):
        a, b = halves(spark, sf)
        return distance.pairwise(a, b, metric).withColumn("dist", F.round("dist", 6))


for _m, _s in (("euclidean", D), ("sqeuclidean", SQ), ("l1", L1), ("canberra", CANBERRA)):
    _pairwise(_m, _s)


@query("joi6_knn", f"{W} SELECT src, dst, round(dist, 6) AS dist, rank::INT AS rank FROM (SELECT a.cell_id AS src, b.cell_id AS dst, {D} AS dist, row_number() OVER (PARTITION BY a.cell_id ORDER BY {D}, b.cell_id) AS rank FROM emb a JOIN emb b ON a.dataset_id = 0 AND b.dataset_id = 1) WHERE rank <= 5")
def joi6(spark, sf):
    a, b = halves(spark, sf)
    return distance.knn(a, b, 5).select("src", "dst", r("dist"), "rank")


@query("joi9_mean_nearest", f"{W}, d AS (SELECT a.cell_id AS ca, b.cell_id AS cb, {D} AS dist FROM emb a JOIN emb b ON a.dataset_id = 0 AND b.dataset_id = 1), x AS (SELECT avg(m) AS a_to_b FROM (SELECT min(dist) AS m FROM d GROUP BY ca)), y AS (SELECT avg(m) AS b_to_a FROM (SELECT min(dist) AS m FROM d GROUP BY cb)) SELECT round(a_to_b, 6) AS a_to_b, round(b_to_a, 6) AS b_to_a, round((a_to_b + b_to_a) / 2, 6) AS mean FROM x, y")
def joi9(spark, sf):
    m = distance.mean_nearest(*halves(spark, sf))
    return m.select(r("a_to_b"), r("b_to_a"), r("mean"))


@query("joi11_graph", f"{W} SELECT src, dst, rank::INT AS rank FROM (SELECT a.cell_id AS src, b.cell_id AS dst, row_number() OVER (PARTITION BY a.cell_id ORDER BY {D}, b.cell_id) AS rank FROM emb a JOIN emb b ON a.cell_id <> b.cell_id) WHERE rank <= 3")
def joi11(spark, sf):
    p = points(spark, sf)
    return distance.knn(p, p, 3, exclude_self=True).select("src", "dst", "rank")


@query("joi12_grid_centres", f"""{W}, b AS (SELECT min(vec[1]) x0, max(vec[1]) x1, min(vec[2]) y0, max(vec[2]) y1 FROM emb), g AS (SELECT gx, gy, x0 + (gx + 0.5) * (x1 - x0) / 4 AS cx, y0 + (gy + 0.5) * (y1 - y0) / 4 AS cy FROM b, range(4) t(gx), range(4) u(gy)),
d AS (SELECT gx, gy, cell_id, sqrt((vec[1] - cx) ** 2 + (vec[2] - cy) ** 2) AS dist FROM g, emb) SELECT gx::INT AS gx, gy::INT AS gy, cell_id, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY dist, cell_id) AS r FROM d) WHERE r = 1""")
def joi12(spark, sf):
    return distance.grid_centres(points(spark, sf), 4).select("gx", "gy", "cell_id", r("dist"))


SLICE_GRAPH = f"""{S5}, hi AS (SELECT max(dataset_id) AS hi FROM emb),
d AS (SELECT a.dataset_id AS src_slice, a.cell_id AS src, b.dataset_id AS dst_slice, b.cell_id AS dst, {D} AS dist, CASE WHEN a.dataset_id = b.dataset_id THEN 8 WHEN a.dataset_id IN (0, (SELECT hi FROM hi)) THEN 6 ELSE 3 END AS k
 FROM emb a JOIN emb b ON abs(a.dataset_id - b.dataset_id) <= 1 AND a.cell_id <> b.cell_id),
e AS (SELECT src_slice, src, dst_slice, dst, dist, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src, dst_slice ORDER BY dist, dst) AS rank FROM d) WHERE rank <= k)"""


def slice_edges(spark, sf):
    return materialize(neighbours.slice_graph(points(spark, sf, 5), 3, 8), "slice-edges")


@query("knn1_slice_graph", f"{SLICE_GRAPH} SELECT src_slice, src, dst_slice, dst, round(dist, 6) AS dist, rank FROM e")
def knn1(spark, sf):
    return slice_edges(spark, sf).withColumn("dist", F.round("dist", 6))


@query("knn3_far_penalty", f"{W} SELECT a.cell_id AS src, b.cell_id AS dst, round({D} * CASE WHEN abs(a.label - b.label) > 0 THEN 2.0 ** (abs(a.label - b.label) - 1) ELSE 1 END, 6) AS dist FROM emb a JOIN emb b ON a.cell_id < b.cell_id")
def knn3(spark, sf):
    """The label plays the slice, so that gaps larger than one occur."""
    p = points(spark, sf).withColumnRenamed("label", "slice")
    return neighbours.far_penalty(distance.pairwise(p, p, once=True, more=["slice"])).select("src", "dst", r("dist"))


def _adjusted(how: str, name: str, statistic: str):
    @query(f"knn4_{name}", f"{SLICE_GRAPH}, s AS ({statistic}) SELECT src_slice, src, dst_slice, dst, round(CASE WHEN src_slice = dst_slice THEN dist ELSE s.v END, 6) AS dist FROM e JOIN s USING (src_slice)")
    def run(spark, sf):
        return neighbours.adjust_distances(slice_edges(spark, sf), how).select("src_slice", "src", "dst_slice", "dst", r("dist"))


for _h, _n, _e in (("max", "max", "max(dist)"), ("median", "median", "median(dist)"), ("3quartile", "q75", "quantile_cont(dist, 0.75)")):
    _adjusted(_h, _n, f"SELECT src_slice, {_e} AS v FROM e WHERE src_slice = dst_slice GROUP BY 1")


@query("knn4_normmeans", f"""{SLICE_GRAPH}, o AS (SELECT src, avg(dist) AS own FROM e WHERE src_slice = dst_slice GROUP BY 1), i AS (SELECT *, avg(dist) OVER (PARTITION BY src, dst_slice) AS m FROM e)
SELECT src_slice, src, dst_slice, dst, round(CASE WHEN src_slice = dst_slice THEN dist ELSE dist * own / m END, 6) AS dist FROM i JOIN o USING (src)""")
def knn4_norm(spark, sf):
    return neighbours.adjust_distances(slice_edges(spark, sf), "normMeans").select("src_slice", "src", "dst_slice", "dst", r("dist"))


@query("knn4_first_k_means", f"""{SLICE_GRAPH}, o AS (SELECT src_slice, rank, avg(dist) AS own FROM e WHERE src_slice = dst_slice GROUP BY 1, 2)
SELECT src_slice, src, dst_slice, dst, round(CASE WHEN src_slice = dst_slice THEN dist ELSE own END, 6) AS dist FROM e JOIN o USING (src_slice, rank)""")
def knn4_first(spark, sf):
    return neighbours.adjust_distances(slice_edges(spark, sf), "firstKMeans").select("src_slice", "src", "dst_slice", "dst", r("dist"))


@query("knn5_sorted", f"{SLICE_GRAPH} SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY dist, dst) AS dst FROM e GROUP BY 1")
def knn5(spark, sf):
    return neighbours.sorted_neighbours(slice_edges(spark, sf)).select("src", F.array_join(F.transform("dst", lambda x: x.cast("string")), ",").alias("dst"))


@query("knn6_padded", f"{SLICE_GRAPH}, l AS (SELECT src, list(dst ORDER BY dist, dst) AS d FROM e GROUP BY 1), w AS (SELECT max(len(d)) AS w FROM l) SELECT src, w::INT AS width, array_to_string(list_concat(d, list_transform(range(w - len(d)), lambda i: d[-1])), ',') AS dst FROM l, w")
def knn6(spark, sf):
    p = neighbours.padded_neighbours(neighbours.sorted_neighbours(slice_edges(spark, sf)))
    return p.select("src", F.size("dst").alias("width"), F.array_join(F.transform("dst", lambda x: x.cast("string")), ",").alias("dst"))


@query("clu4_random", f"{W} SELECT cell_id, (('0x' || substr(md5('5:' || cell_id), 1, 8))::BIGINT % 7)::INT AS cluster FROM emb")
def clu4(spark, sf):
    return clustering.random_labels(points(spark, sf), 7, 5).select("cell_id", "cluster")


@query("clu7_dbscan", f"""WITH RECURSIVE {views.EMB_SQL.format(k=2)}, near AS (SELECT a.cell_id AS s, b.cell_id AS t FROM emb a JOIN emb b ON {D} <= 1.05),
core AS (SELECT s FROM near GROUP BY 1 HAVING count(*) >= 4), link AS (SELECT n.s, n.t FROM near n JOIN core a ON n.s = a.s JOIN core b ON n.t = b.s),
reach AS (SELECT s AS node, s AS root FROM core UNION SELECT l.t, r.root FROM reach r JOIN link l ON l.s = r.node), comp AS (SELECT node, min(root) AS c FROM reach GROUP BY 1),
border AS (SELECT n.s, min(c) AS c FROM near n JOIN comp ON n.t = comp.node GROUP BY 1) SELECT cell_id, coalesce(comp.c, border.c, -1) AS cluster FROM emb LEFT JOIN comp ON node = cell_id LEFT JOIN border ON border.s = cell_id""")
def clu7(spark, sf):
    return clustering.dbscan(points(spark, sf), 1.05, 4)


CURVE = "curve AS (SELECT label AS x, avg(list_sum(vec)) + 3.0 / (label + 1) AS y FROM emb GROUP BY label)"


def curve(spark, sf):
    p = points(spark, sf)
    return p.groupBy(F.col("label").alias("x")).agg((F.avg(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v)) + 3.0 / (F.first("label") + 1)).alias("y"))


@query("clu9_diag_knee", f"""{W}, {CURVE}, e AS (SELECT *, first_value(x) OVER w AS x1, first_value(y) OVER w AS y1, last_value(x) OVER w AS x2, last_value(y) OVER w AS y2 FROM curve WINDOW w AS (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
c AS (SELECT x, y, ((y2 - y1) * x - (x2 - x1) * y + x2 * y1 - y2 * x1) / sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS chord FROM e) SELECT x, round(y, 6) AS y, round(chord, 6) AS chord FROM c ORDER BY abs(y * chord) DESC, x LIMIT 1""")
def clu9(spark, sf):
    return align.diagonal_knee(curve(spark, sf)).select("x", r("y"), r("chord"))


@query("clu11_poison", f"""{W}, k AS (SELECT a.label AS la, b.label AS lb, row_number() OVER (PARTITION BY a.cell_id ORDER BY {D}, b.cell_id) AS rank FROM emb a, emb b)
SELECT la AS label, round(count(*) FILTER (la <> lb AND rank <= 6) / (count(*) FILTER (rank = 1)), 6) AS poison FROM k GROUP BY 1""")
def clu11(spark, sf):
    return clustering.poison(points(spark, sf)).select("label", r("poison"))


CENTRES = "long AS (SELECT dataset_id, cell_id, label, unnest(vec) AS v, generate_subscripts(vec, 1) AS dim FROM emb), cen AS (SELECT dataset_id, label, dim, avg(v) AS v, count(*) AS n FROM long GROUP BY 1, 2, 3)"


@query("clu12_centres", f"{W}, {CENTRES} SELECT dataset_id, label, dim::INT AS dim, round(v, 6) AS v, n FROM cen")
def clu12(spark, sf):
    c = clustering.centres(points(spark, sf), ["dataset_id", "label"])
    return c.select("dataset_id", "label", F.posexplode("centre").alias("dim", "v"), "n").select("dataset_id", "label", (F.col("dim") + 1).alias("dim"), r("v"), "n")


def _joint(k: int) -> str:
    return f"""WITH {views.EMB_SQL.format(k=k)}, p0 AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY cell_id) AS pos FROM emb), p AS (SELECT * FROM p0 WHERE pos <= (SELECT min(n) FROM (SELECT count(*) AS n FROM emb GROUP BY dataset_id))),
lab AS (SELECT pos, label FROM p WHERE dataset_id = 0), long AS (SELECT dataset_id, pos, unnest(vec) AS v, generate_subscripts(vec, 1) AS dim FROM p), cen AS (SELECT dataset_id, label, dim, avg(v) AS v FROM long JOIN lab USING (pos) GROUP BY 1, 2, 3),
cv AS (SELECT dataset_id, label AS c, list(v ORDER BY dim) AS vec FROM cen GROUP BY 1, 2), d AS (SELECT a.pos, a.dataset_id, b.c, {D} AS d FROM p a JOIN cv b USING (dataset_id)),
one AS (SELECT pos, dataset_id, arg_min(c, d) AS c, min(d) AS d FROM d GROUP BY 1, 2) SELECT pos, arg_min(c, d) AS label, min(c) = max(c) AS agree FROM one GROUP BY 1"""


def _kmeans_step(name: str, k: int):
    @query(name, _joint(k))
    def run(spark, sf):
        p = points(spark, sf, k)
        pos = p.withColumn("pos", F.row_number().over(Window.partitionBy("dataset_id").orderBy("cell_id")).cast("long"))
        n = p.groupBy("dataset_id").count().agg(F.min("count").alias("n"))
        pos = materialize(pos.join(F.broadcast(n)).where("pos <= n").drop("n"), "aligned")
        return clustering.joint_kmeans_step(pos.select("dataset_id", "pos", "vec"), pos.where("dataset_id = 0").select("pos", "label"))


_kmeans_step("clu14_two_set_kmeans", 2)
_kmeans_step("clu15_multi_set_kmeans", 5)


@query("clu19b_tolerance", f"{W}, {CENTRES} SELECT round(avg(v) * 1e-4, 10) AS tolerance FROM (SELECT var_pop(v) AS v FROM long GROUP BY dim)")
def clu19b(spark, sf):
    return clustering.tolerance(points(spark, sf)).select(r("tolerance", 10))


@query("clu20_mustlink_closure", f"""WITH RECURSIVE {views.EMB_SQL.format(k=2)}, l AS (SELECT a, b FROM (SELECT cell_id AS a, lead(cell_id) OVER (PARTITION BY label ORDER BY cell_id) AS b FROM emb) WHERE b - a <= 8), both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a AS node, a AS root FROM both_ways UNION SELECT t.b, r.root FROM reach r JOIN both_ways t ON t.a = r.node) SELECT node, min(root) AS "group" FROM reach GROUP BY 1""")
def clu20(spark, sf):
    """Must-links join points of one label whose ids follow closely."""
    following = F.lead("cell_id").over(Window.partitionBy("label").orderBy("cell_id"))
    must = points(spark, sf).select(F.col("cell_id").alias("a"), following.alias("b")).where("b - a <= 8")
    return clustering.must_link_closure(must, must.select("a", (-1 - F.col("b")).alias("b")))[0]


@query("clu21_nearest_centres", f"""{W}, long AS (SELECT label, unnest(vec) AS v, generate_subscripts(vec, 1) AS dim FROM emb), cv AS (SELECT label, list(v ORDER BY dim) AS vec FROM (SELECT label, dim, avg(v) AS v FROM long GROUP BY 1, 2) GROUP BY 1)
SELECT a.cell_id, b.label, round({D}, 6) AS dist, (row_number() OVER (PARTITION BY a.cell_id ORDER BY {D}, b.label))::INT AS place FROM emb a, cv b""")
def clu21(spark, sf):
    p = points(spark, sf)
    return clustering.nearest_centres(p.select("cell_id", "vec"), clustering.centres(p, ["label"])).select("cell_id", "label", r("dist"), "place")


@query("clu22_must_links", f"{MATCH} SELECT label_a AS label, cell_a, cell_b, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY label_a ORDER BY dist, cell_a) AS r, count(*) OVER (PARTITION BY label_a) AS n FROM m) WHERE r <= floor(n * 0.5)")
def clu22(spark, sf):
    m = rank_match(spark, sf).select("cell_a", "cell_b", "dist")
    return align.must_links(m, halves(spark, sf)[0]).select("label", "cell_a", "cell_b", r("dist"))


CANVAS = f"""{MATCH}, c AS (SELECT label_a, label_b, count(*) AS n, 1 - var_pop(dist) / avg(dist) ** 2 AS spread FROM m GROUP BY 1, 2), na AS (SELECT label AS label_a, count(*) AS n_a FROM emb WHERE dataset_id = 0 GROUP BY 1),
nb AS (SELECT label AS label_b, count(*) AS n_b FROM emb WHERE dataset_id = 1 GROUP BY 1), canvas AS (SELECT label_a, label_b, n, n_a, n_b, spread, -2.0 * n / (n_a + n_b) AS w FROM c JOIN na USING (label_a) JOIN nb USING (label_b))"""


def canvas(spark, sf, **kw):
    a, b = halves(spark, sf)
    return align.canvas(rank_match(spark, sf).select("cell_a", "cell_b", "dist"), a, b, **kw)


@query("aln1_canvas", f"{CANVAS} SELECT label_a, label_b, n, n_a, n_b, round(w, 6) AS w FROM canvas")
def aln1(spark, sf):
    return canvas(spark, sf).withColumn("w", F.round("w", 6))


@query("aln2_spread", f"{CANVAS} SELECT label_a, label_b, round(w * spread, 6) AS w FROM canvas")
def aln2(spark, sf):
    return canvas(spark, sf, spread=True).select("label_a", "label_b", r("w"))


@query("aln3_clean", f"""{CANVAS}, s AS (SELECT *, min(w) OVER a AS ra, min(w) OVER b AS rb, w / sum(w) OVER a AS sa, w / sum(w) OVER b AS sb FROM canvas WINDOW a AS (PARTITION BY label_a), b AS (PARTITION BY label_b))
SELECT label_a, label_b, round(w, 6) AS w, round(CASE WHEN (w > ra AND w > rb) OR (sa < 0.3 AND sb < 0.3) THEN 0.0 ELSE w END, 6) AS cleaned FROM s""")
def aln3(spark, sf):
    return align.clean(canvas(spark, sf)).select("label_a", "label_b", r("w"), r("cleaned"))


@query("aln10_report", f"{CANVAS} SELECT label_a, label_b, n_a, n_b, n, round(n / least(n_a, n_b), 6) AS ratio FROM canvas")
def aln10(spark, sf):
    return align.match_report(canvas(spark, sf)).withColumn("ratio", F.round("ratio", 6))


@query("aln16_dice_confusion", f"{MATCH}, c AS (SELECT label_a, label_b, count(*) AS n FROM m GROUP BY 1, 2) SELECT label_a, label_b, n, round(2.0 * n / (sum(n) OVER (PARTITION BY label_a) + sum(n) OVER (PARTITION BY label_b)), 6) AS dice FROM c")
def aln16(spark, sf):
    return align.confusion(rank_match(spark, sf), "label_a", "label_b").withColumn("dice", F.round("dice", 6))


@query("aln18_relative_confusion", f"{MATCH}, c AS (SELECT label_a, label_b, count(*) AS n FROM m GROUP BY 1, 2) SELECT label_a, label_b, n, round(n / sum(n) OVER (PARTITION BY label_a), 6) AS share FROM c")
def aln18(spark, sf):
    c = align.confusion(rank_match(spark, sf), "label_a", "label_b")
    return c.select("label_a", "label_b", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("label_a")), 6).alias("share"))


@query("aln19_joint_labels", f"{W} SELECT label, (dense_rank() OVER (ORDER BY label) - 1)::INT AS code FROM (SELECT DISTINCT label FROM emb WHERE label % 2 = dataset_id UNION SELECT DISTINCT label FROM emb WHERE label > 6)")
def aln19(spark, sf):
    p = points(spark, sf)
    return align.joint_labels([p.where("label % 2 = dataset_id"), p.where("label > 6")])


@query("ts2_choose_size", "WITH c AS (SELECT label + 2 AS k, sum(l_) AS aic FROM (SELECT label, list_sum(embedding::DOUBLE[]) * 10 AS l_ FROM embeddings) GROUP BY 1), v AS (SELECT k, round(aic, 6) + 3 * k * ln(500) AS v FROM c) SELECT k FROM v ORDER BY v, k LIMIT 1")
def ts2(spark, sf):
    """The curve is made of the embeddings' sums per label."""
    p = points(spark, sf)
    c = p.groupBy((F.col("label") + 2).alias("k")).agg(F.sum(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v) * 10).alias("aic")).select("k", r("aic"), F.lit(500).alias("n"))
    return align.choose_size(c.withColumn("bic", F.col("aic")), "AdjAIC")


@query("ts3_small_slices", f"{S5} SELECT dataset_id, min(n) AS smallest, min(n) < 9 AS below FROM (SELECT dataset_id, label, count(*) AS n FROM emb GROUP BY 1, 2) GROUP BY 1")
def ts3(spark, sf):
    return align.small_slices(points(spark, sf, 5), 9)


@query("ts4_make_unique", f"{S5}, m AS (SELECT dataset_id, max(label) + 1 AS w FROM emb GROUP BY 1), o AS (SELECT dataset_id, coalesce(sum(w) OVER (ORDER BY dataset_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM m) SELECT dataset_id, cell_id, (label + o)::INT AS label FROM emb JOIN o USING (dataset_id)")
def ts4(spark, sf):
    return align.unique_over_slices(points(spark, sf, 5)).select("dataset_id", "cell_id", "label")


@query("ts8_compact", f"{S5} SELECT cell_id, label * 3 + 1 AS label, (dense_rank() OVER (ORDER BY label) - 1)::INT AS compact FROM emb")
def ts8(spark, sf):
    return align.compact(points(spark, sf, 5).withColumn("label", F.col("label") * 3 + 1)).select("cell_id", "label", "compact")


LINEAGE = "lin AS (SELECT DISTINCT a.dataset_id AS slice, a.label AS parent, b.label AS child FROM emb a JOIN emb b ON b.dataset_id = a.dataset_id + 1 AND b.cell_id = a.cell_id + 1)"


@query("ts11_trace", f"WITH RECURSIVE {views.EMB_SQL.format(k=5)}, {LINEAGE}, t AS (SELECT 0 AS slice, 0 AS label UNION SELECT t.slice + 1, child FROM t JOIN lin ON lin.slice = t.slice AND parent = t.label) SELECT slice, label FROM t")
def ts11(spark, sf):
    p = points(spark, sf, 5)
    a = p.select(F.col("dataset_id").alias("slice"), F.col("label").alias("parent"), (F.col("cell_id") + 1).alias("next"))
    b = p.select(F.col("dataset_id").alias("later"), F.col("cell_id").alias("next"), F.col("label").alias("child"))
    return align.trace(materialize(a.join(b, "next").where("later = slice + 1").select("slice", "parent", "child").distinct(), "lineage"), 0)


AFFINITY = f"""WITH {views.EVENTS_SQL}, n AS (SELECT dataset_id, sqrt(sum(x * x)) AS n FROM ev GROUP BY 1), aff AS (SELECT a.dataset_id AS ds_a, b.dataset_id AS ds_b, round(sum(a.x * b.x) / (any_value(na.n) * any_value(nb.n)), 9) AS value
FROM ev a JOIN ev b ON a.cell_id = b.cell_id AND a.gene_id = b.gene_id JOIN n na ON na.dataset_id = a.dataset_id JOIN n nb ON nb.dataset_id = b.dataset_id GROUP BY 1, 2)"""


def affinity(spark, sf):
    ev = views.event_counts(spark, sf)
    g = ev.select("dataset_id", F.concat_ws(":", F.col("cell_id").cast("string"), "gene_id").alias("gene_id"), F.col("x").alias("score"))
    from plexmat.operators.matrix import mirror

    return mirror(metrics.cosine(materialize(g, "events")).withColumn("value", F.round("value", 9)))


@query("ts13_affinity", f"{AFFINITY} SELECT ds_a, ds_b, round(value, 6) AS value FROM aff")
def ts13(spark, sf):
    return affinity(spark, sf).select("ds_a", "ds_b", r("value"))


@query("ts12_order_score", f"{AFFINITY}, g AS (SELECT ds_a, abs(ds_a - ds_b) AS gap, lag(abs(ds_a - ds_b)) OVER (PARTITION BY ds_a ORDER BY value DESC, ds_b) AS before FROM aff WHERE ds_a <> ds_b) SELECT ds_a, count(*) FILTER (before > gap) AS violations, count(*) AS n FROM g GROUP BY 1")
def ts12(spark, sf):
    return align.order_score(affinity(spark, sf))


HOPS = f"""WITH RECURSIVE {views.EMB_SQL.format(k=2)}, e0 AS (SELECT src AS s, dst AS t FROM (SELECT a.cell_id AS src, b.cell_id AS dst, row_number() OVER (PARTITION BY a.cell_id ORDER BY {D}, b.cell_id) AS rank FROM emb a JOIN emb b ON a.cell_id <> b.cell_id) WHERE rank <= 3),
e AS (SELECT s, t FROM e0 UNION SELECT t, s FROM e0), w AS (SELECT DISTINCT s AS src, s AS dst, 0 AS hops FROM e UNION SELECT w.src, e.t, w.hops + 1 FROM w JOIN e ON e.s = w.dst WHERE w.hops < 16), h AS (SELECT src, dst, min(hops) AS hops FROM w GROUP BY 1, 2)"""


def graph_edges(spark, sf):
    """The three nearest neighbours of every point."""
    p = points(spark, sf)
    return materialize(distance.knn(p, p, 3, exclude_self=True).select("src", "dst"), "graph")


@query("gra2_hops", f"{HOPS} SELECT src, dst, hops::INT AS hops FROM h")
def gra2(spark, sf):
    return graph.hop_distances(graph_edges(spark, sf))


@query("gra3_hop_similarity", f"{HOPS}, s AS (SELECT src, dst, (max(hops) OVER () - hops) / (max(hops) OVER () - min(hops) OVER ()) AS s FROM h), m AS (SELECT median(s) AS m FROM (SELECT DISTINCT s FROM s)) SELECT src, dst, round(CASE WHEN s < m THEN 0 ELSE s * s END, 6) AS sim FROM s, m")
def gra3(spark, sf):
    return hops.similarity(graph_edges(spark, sf)).withColumn("sim", F.round("sim", 6))


@query("gra4_label_spreading")
def gra4(spark, sf):
    seeds = halves(spark, sf)[0].select(F.col("cell_id").alias("node"), "label")
    return hops.spread_labels(graph_edges(spark, sf), seeds, rounds=10)


@query("gra6_1nn_transfer", f"""{W}, k AS (SELECT a.cell_id, a.label AS truth, b.label AS label, row_number() OVER (PARTITION BY a.cell_id ORDER BY {D}, b.cell_id) AS rank FROM emb a JOIN emb b ON a.dataset_id = 1 AND b.dataset_id = 0)
SELECT cell_id, truth, label FROM k WHERE rank = 1""")
def gra6(spark, sf):
    a, b = halves(spark, sf)
    k = distance.knn(b, a, 1)
    return k.join(b.select(F.col("cell_id").alias("src"), F.col("label").alias("truth")), "src").join(a.select(F.col("cell_id").alias("dst"), "label"), "dst").select(F.col("src").alias("cell_id"), "truth", "label")


ARI = """c AS (SELECT {g} label_a, label_b, count(*) AS n FROM m GROUP BY ALL), i AS (SELECT {g} sum(n * (n - 1) / 2.0) AS i, sum(n) AS n FROM c GROUP BY ALL), ra AS (SELECT {g} sum(n * (n - 1) / 2.0) AS ra FROM (SELECT {g} label_a, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL),
rb AS (SELECT {g} sum(n * (n - 1) / 2.0) AS rb FROM (SELECT {g} label_b, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL)"""


@query("met1_ari", f"{MATCH}, {ARI.format(g='')} SELECT round((i - ra * rb / (n * (n - 1) / 2.0)) / ((ra + rb) / 2 - ra * rb / (n * (n - 1) / 2.0)), 6) AS ari, n::BIGINT AS n FROM i, ra, rb")
def met1(spark, sf):
    return metrics.adjusted_rand(rank_match(spark, sf), "label_a", "label_b").select(r("ari"), "n")


@query("met3_dense_labels", f"{S5} SELECT dataset_id, cell_id, label * 2 + dataset_id AS label, (dense_rank() OVER (PARTITION BY dataset_id ORDER BY label) - 1)::INT AS dense FROM emb")
def met3(spark, sf):
    return metrics.dense_labels(points(spark, sf, 5).withColumn("label", F.col("label") * 2 + F.col("dataset_id")), "label", ["dataset_id"]).select("dataset_id", "cell_id", "label", "dense")


@query("met4_gausssim", f"""{W}, d AS (SELECT a.label, a.dataset_id AS da, b.dataset_id AS db, a.cell_id, min({D}) AS d FROM emb a JOIN emb b ON a.label = b.label AND a.cell_id <> b.cell_id GROUP BY ALL),
g AS (SELECT label, avg(d) FILTER (da = 0 AND db = 0) AS aa, avg(d) FILTER (da = 1 AND db = 1) AS bb, (avg(d) FILTER (da = 0 AND db = 1) + avg(d) FILTER (da = 1 AND db = 0)) / 2 AS ab FROM d GROUP BY 1) SELECT label, round(exp(-(ab ** 2) / ((aa + bb) / 2) ** 2), 6) AS sim FROM g""")
def met4(spark, sf):
    return metrics.gaussian_similarity(*halves(spark, sf)).select("label", r("sim"))


def _purity(name: str, on: str, same: bool):
    @query(name, f"{W}, k AS (SELECT a.label AS la, b.label AS lb, row_number() OVER (PARTITION BY a.cell_id ORDER BY {D}, b.cell_id) AS rank FROM emb a JOIN emb b ON {on}) SELECT round(avg(CASE WHEN la = lb THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM k WHERE rank = 1")
    def run(spark, sf):
        a, b = halves(spark, sf)
        p = points(spark, sf)
        return metrics.nearest_label_agreement(*((p, p) if same else (a, b)), same).withColumn("accuracy", F.round("accuracy", 6))


_purity("met5_purity", "a.cell_id <> b.cell_id", True)
_purity("met6_cross_1nn", "a.dataset_id = 0 AND b.dataset_id = 1", False)


@query("met11_best_f1", f"""{MATCH}, c AS (SELECT label_a, label_b, count(*) AS n FROM m GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY label_a) AS na, sum(n) OVER (PARTITION BY label_b) AS nb FROM c)
SELECT label_a, label_b, round(2.0 * n / (na + nb), 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY label_a ORDER BY n / nb DESC, n DESC, label_b) AS r FROM s) WHERE r = 1""")
def met11(spark, sf):
    return metrics.best_f1(rank_match(spark, sf), "label_a", "label_b").withColumn("f1", F.round("f1", 6))


@query("met10_label_distance", f"{MATCH} SELECT label_a AS label, round(avg(dist), 6) AS dist, count(*) AS n FROM m GROUP BY 1")
def met10(spark, sf):
    return rank_match(spark, sf).groupBy(F.col("label_a").alias("label")).agg(F.round(F.avg("dist"), 6).alias("dist"), F.count("*").alias("n"))


@query("pre2_flows", f"{MATCH} SELECT label_a, label_b, count(*) AS matches FROM m GROUP BY 1, 2")
def pre2(spark, sf):
    return align.flows(rank_match(spark, sf), "label_a", "label_b")


@query("nrm6_standardise", f"{W}, long AS (SELECT cell_id, unnest(vec) AS v, generate_subscripts(vec, 1) AS dim FROM emb), z AS (SELECT cell_id, dim, (v - avg(v) OVER (PARTITION BY dim)) / stddev_pop(v) OVER (PARTITION BY dim) AS z FROM long) SELECT cell_id, dim::INT AS dim, round(z, 6) AS z FROM z")
def nrm6(spark, sf):
    s = preprocess.standardise(points(spark, sf))
    return s.select("cell_id", F.posexplode("vec").alias("dim", "z")).select("cell_id", (F.col("dim") + 1).alias("dim"), r("z"))


@query("aln8_vote", f"""{W}, k AS (SELECT a.cell_id, b.label, {D} AS d, row_number() OVER (PARTITION BY a.cell_id ORDER BY {D}, b.cell_id) AS rank FROM emb a JOIN emb b ON a.dataset_id = 1 AND b.dataset_id = 0), v AS (SELECT cell_id, label, sum(CASE WHEN d > 0 THEN 1 / d ELSE 1e18 END) AS w FROM k WHERE rank <= 5 GROUP BY 1, 2)
SELECT cell_id, label FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY w DESC, label) AS r FROM v) WHERE r = 1""")
def aln8(spark, sf):
    a, b = halves(spark, sf)
    return clustering.vote(b, a)
