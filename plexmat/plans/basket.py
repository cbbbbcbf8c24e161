"""Queries over the basket matrices: filters, normalisation, scoring, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexmat.operators import matrix, metrics, preprocess, selection
from plexmat.session import materialize, table
from plexmat.sources import readers, views

MIN_GENES, MIN_COUNTS, TOP = 20, 3, 100
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


def counts(spark: SparkSession, sf: str) -> DataFrame:
    return views.basket_counts(spark, sf)


def kept(spark: SparkSession, sf: str) -> DataFrame:
    """The filtered counts, written once: every query reads them more than once."""
    return materialize(preprocess.basic_filter(counts(spark, sf), MIN_GENES, MIN_COUNTS), "kept")


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Dispersion y as the score, genes inside the mean range."""
    k = kept(spark, sf)
    d = selection.dispersion(preprocess.normlog(k), preprocess.cell_numbers(k))
    # written once: most queries join the scores with themselves
    return materialize(selection.in_range(d).withColumn("score", F.round("y", 9)), "scores")


W = f"WITH {views.BASKET_SQL}"
FILTERED = f"""{W},
cells AS (SELECT b.* FROM basket b SEMI JOIN (SELECT dataset_id, cell_id FROM basket GROUP BY ALL HAVING count(*) >= {MIN_GENES}) g USING (dataset_id, cell_id)),
good AS (SELECT gene_id FROM (SELECT dataset_id, gene_id FROM cells GROUP BY ALL HAVING sum(x) >= {MIN_COUNTS}) GROUP BY gene_id
  HAVING count(*) = (SELECT count(DISTINCT dataset_id) FROM cells)),
kept AS (SELECT c.* FROM cells c SEMI JOIN good USING (gene_id)),
norm AS (SELECT dataset_id, cell_id, gene_id, x * 1e4 / sum(x) OVER (PARTITION BY dataset_id, cell_id) AS v FROM kept),
ncells AS (SELECT dataset_id, count(DISTINCT cell_id) AS n FROM kept GROUP BY 1),
moments AS (SELECT dataset_id, gene_id, sum(v) / any_value(n) AS mean, sum(v * v) / any_value(n) AS q2 FROM norm JOIN ncells USING (dataset_id) GROUP BY 1, 2),
disp AS (SELECT dataset_id, gene_id, mean, q2 - mean * mean AS var, ln(1 + mean) AS x, ln((q2 - mean * mean) / mean) AS y FROM moments WHERE mean > 0 AND q2 - mean * mean > 1e-12 * q2),
scores AS (SELECT dataset_id, gene_id, mean, x, y, round(y, 9) AS score FROM disp WHERE x > 0.015 AND x < 4),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY score DESC, gene_id) AS place FROM scores)"""


@query("fil3_min_genes", f"{W} SELECT dataset_id, count(DISTINCT cell_id) AS cells, sum(x) AS total FROM basket SEMI JOIN (SELECT dataset_id, cell_id FROM basket GROUP BY ALL HAVING count(*) >= {MIN_GENES}) g USING (dataset_id, cell_id) GROUP BY 1")
def fil3(spark, sf):
    return preprocess.cells_with_features(counts(spark, sf), MIN_GENES).groupBy("dataset_id").agg(F.count_distinct("cell_id").alias("cells"), F.sum("x").alias("total"))


@query("fil4_gene_counts_all", f"{FILTERED} SELECT dataset_id, cell_id, gene_id, x FROM kept")
def fil4(spark, sf):
    return kept(spark, sf)


@query("fil5_filter_report", f"""{FILTERED}, a AS (SELECT dataset_id, count(DISTINCT cell_id) cells_before, count(DISTINCT gene_id) genes_before FROM basket GROUP BY 1),
b AS (SELECT dataset_id, count(DISTINCT cell_id) cells_after, count(DISTINCT gene_id) genes_after FROM kept GROUP BY 1)
SELECT dataset_id, cells_before, genes_before, coalesce(cells_after, 0) AS cells_after, coalesce(genes_after, 0) AS genes_after,
 coalesce(cells_after, 0) < 200 OR coalesce(genes_after, 0) < 4000 OR 2 * coalesce(cells_after, 0) < cells_before AS suspicious FROM a LEFT JOIN b USING (dataset_id)""")
def fil5(spark, sf):
    return preprocess.filter_report(counts(spark, sf), kept(spark, sf))


@query("fil2_low_share", f"""{W}, s AS (SELECT dataset_id, cell_id, sum(CASE WHEN gene_id % 20 = 0 THEN x ELSE 0 END) / sum(x) AS share FROM basket GROUP BY 1, 2)
SELECT dataset_id, count(DISTINCT cell_id) AS cells, sum(x) AS total FROM basket SEMI JOIN (SELECT * FROM s WHERE share < 0.05) g USING (dataset_id, cell_id) GROUP BY 1""")
def fil2(spark, sf):
    """The flagged features are every twentieth part."""
    return preprocess.low_share_cells(counts(spark, sf), F.col("gene_id") % 20 == 0).groupBy("dataset_id").agg(F.count_distinct("cell_id").alias("cells"), F.sum("x").alias("total"))


@query("fil1_drop_unlabelled", f"WITH {views.EMB_SQL.format(k=2)} SELECT dataset_id, cell_id, label FROM emb WHERE label <> 0")
def fil1(spark, sf):
    """Label 0 plays the unknown label."""
    return preprocess.drop_unlabelled(views.embedding_points(spark, sf), 0).select("dataset_id", "cell_id", "label")


@query("fil6_subsample", f"{W} SELECT dataset_id, cell_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY md5('7:' || cell_id), cell_id) AS r FROM obs) WHERE r <= 40")
def fil6(spark, sf):
    return preprocess.subsample(views.basket_obs(spark, sf), 40, 7).select("dataset_id", "cell_id")


@query("fil6_subsample_share", f"{W} SELECT dataset_id, cell_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY md5('7:' || cell_id), cell_id) AS r, count(*) OVER (PARTITION BY dataset_id) AS n FROM obs) WHERE r <= floor(n * 0.2)")
def fil6_share(spark, sf):
    return preprocess.subsample(views.basket_obs(spark, sf), 0.2, 7).select("dataset_id", "cell_id")


@query("fil7_make_even", f"{W} SELECT dataset_id, cell_id, label FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY md5('0:' || cell_id), cell_id) AS r FROM obs) WHERE r <= (SELECT min(n) FROM (SELECT count(*) n FROM obs GROUP BY dataset_id))")
def fil7(spark, sf):
    return preprocess.make_even(views.basket_obs(spark, sf))


@query("fil8_preselected", f"{W} SELECT b.* FROM basket b SEMI JOIN (SELECT p_partkey AS gene_id FROM part WHERE p_size < 10) p USING (gene_id)")
def fil8(spark, sf):
    genes = table(spark, sf, "part").where("p_size < 10").select(F.col("p_partkey").alias("gene_id"))
    return preprocess.preselected(counts(spark, sf), genes)


@query("fil9_name_predicate", f"{W} SELECT dataset_id, gene_id, sum(x) AS total FROM basket JOIN part ON gene_id = p_partkey WHERE p_brand NOT LIKE 'Brand#1%' AND p_type IS NOT NULL GROUP BY 1, 2")
def fil9(spark, sf):
    names = table(spark, sf, "part").where(~F.col("p_brand").startswith("Brand#1") & F.col("p_type").isNotNull()).select(F.col("p_partkey").alias("gene_id"))
    return preprocess.preselected(counts(spark, sf), names).groupBy("dataset_id", "gene_id").agg(F.sum("x").alias("total"))


@query("fil10_resample", f"WITH {views.EMB_SQL.format(k=2)} SELECT dataset_id, cell_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY md5('42:' || cell_id), cell_id) AS r FROM emb) WHERE r <= 100")
def fil10(spark, sf):
    return preprocess.subsample(views.embedding_points(spark, sf), 100, 42).select("dataset_id", "cell_id")


@query("fil11_dataset_stats", f"""{W}, c AS (SELECT dataset_id, cell_id, count(*) AS genes, sum(x) AS reads FROM basket GROUP BY 1, 2)
SELECT dataset_id, rich_cells, round(mean_reads, 6) AS mean_reads, genes, labelled FROM
 (SELECT dataset_id, count(*) FILTER (genes > 40) AS rich_cells, avg(reads) AS mean_reads FROM c GROUP BY 1) JOIN (SELECT dataset_id, count(DISTINCT gene_id) AS genes FROM basket GROUP BY 1) USING (dataset_id)
 JOIN (SELECT dataset_id, count(label) AS labelled FROM obs GROUP BY 1) USING (dataset_id)""")
def fil11(spark, sf):
    return preprocess.dataset_stats(counts(spark, sf), views.basket_obs(spark, sf), 40).withColumn("mean_reads", F.round("mean_reads", 6))


@query("fil12_class_members", "SELECT name, class, members FROM (SELECT n_name AS name, substr(n_name, 1, 1) AS class, count(*) OVER (PARTITION BY substr(n_name, 1, 1)) AS members FROM nation) WHERE members >= 3")
def fil12(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.substring("n_name", 1, 1).alias("class"))
    return preprocess.classes_with_members(names, 3)


@query("fil13_dataset_pruning", f"{W}, c AS (SELECT dataset_id, cell_id FROM basket GROUP BY 1, 2 HAVING count(*) >= 30) SELECT dataset_id, count(*) AS cells FROM c WHERE dataset_id NOT IN (0) GROUP BY 1 HAVING count(*) > 20")
def fil13(spark, sf):
    c = preprocess.cells_with_features(counts(spark, sf), 30).select("dataset_id", "cell_id").distinct()
    return c.where(~F.col("dataset_id").isin(0)).groupBy("dataset_id").agg(F.count("*").alias("cells")).where("cells > 20")


@query("src6_pair_union", f"{W} SELECT dataset_id, count(*) AS n FROM basket WHERE dataset_id IN (1, 3) GROUP BY 1")
def src6(spark, sf):
    c = counts(spark, sf)
    return c.where("dataset_id = 1").unionByName(c.where("dataset_id = 3")).groupBy("dataset_id").agg(F.count("*").alias("n"))


@query("src12_truth_by_batch", f"{W} SELECT b.dataset_id, b.gene_id, o.label, sum(b.x) AS total FROM basket b JOIN obs o USING (dataset_id, cell_id) WHERE b.dataset_id IN (1, 2) GROUP BY ALL")
def src12(spark, sf):
    obs = views.basket_obs(spark, sf).where("dataset_id IN (1, 2)")
    c = readers.split_by_batch(counts(spark, sf), obs.select("cell_id", F.col("dataset_id").alias("batch")))
    return c.join(obs, ["dataset_id", "cell_id"]).groupBy("dataset_id", "gene_id", "label").agg(F.sum("x").alias("total"))


@query("src14_catalog", "SELECT n_name AS name, substr(n_name, 1, 5) AS class FROM nation WHERE n_name NOT LIKE 'A%' AND n_name NOT LIKE 'I%'")
def src14(spark, sf):
    return readers.catalog(table(spark, sf, "nation").select(F.col("n_name").alias("dataset_id")), 5, ("A", "I"))


@query("src16_filtered_sample", f"WITH {views.EMB_SQL.format(k=2)} SELECT dataset_id, cell_id, label FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY md5('1:' || cell_id), cell_id) AS r FROM emb WHERE label <> 0) WHERE r <= 50")
def src16(spark, sf):
    return preprocess.subsample(preprocess.drop_unlabelled(views.embedding_points(spark, sf), 0), 50, 1).select("dataset_id", "cell_id", "label")


@query("src17_encode_labels", f"{W} SELECT dataset_id, cell_id, label, (dense_rank() OVER (ORDER BY label) - 1)::INT AS label_id FROM obs")
def src17(spark, sf):
    return readers.encode_labels(views.basket_obs(spark, sf)).select("dataset_id", "cell_id", "label", "label_id")


@query("snk1_attach_labels", f"{W} SELECT o.dataset_id, o.cell_id, coalesce(c.cluster, -1) AS cluster FROM obs o LEFT JOIN (SELECT o_custkey AS cell_id, (count(*) % 4)::INT AS cluster FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) c USING (cell_id)")
def snk1(spark, sf):
    c = table(spark, sf, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("cell_id")).agg((F.count("*") % 4).cast("int").alias("cluster"))
    return readers.attach_labels(views.basket_obs(spark, sf), c).select("dataset_id", "cell_id", "cluster")


@query("snk3_concatenate", "SELECT dataset_id, cell_id, cell_id || CASE WHEN r > 1 THEN '-' || (r - 1) ELSE '' END AS unique_id FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY dataset_id) AS r FROM (SELECT 0 AS dataset_id, s_suppkey AS cell_id FROM supplier UNION ALL SELECT 1, c_custkey FROM customer))")
def snk3(spark, sf):
    a = table(spark, sf, "supplier").select(F.lit(0).alias("dataset_id"), F.col("s_suppkey").alias("cell_id"))
    b = table(spark, sf, "customer").select(F.lit(1).alias("dataset_id"), F.col("c_custkey").alias("cell_id"))
    return readers.concatenate([a, b])


@query("nrm1_total", f"{FILTERED} SELECT dataset_id, cell_id, gene_id, round(v, 6) AS x FROM norm")
def nrm1(spark, sf):
    return preprocess.normalize_total(kept(spark, sf)).withColumn("x", F.round("x", 6))


@query("nrm2_log1p", f"{FILTERED} SELECT dataset_id, cell_id, gene_id, round(ln(1 + v), 6) AS x FROM norm")
def nrm2(spark, sf):
    return preprocess.normlog(kept(spark, sf)).withColumn("x", F.round("x", 6))


@query("nrm5_scale_clip", f"""{FILTERED}, s AS (SELECT gene_id, sqrt((sum(v * v) - sum(v) * sum(v) / (SELECT sum(n) FROM ncells)) / ((SELECT sum(n) FROM ncells) - 1)) AS sd FROM norm GROUP BY 1)
SELECT dataset_id, cell_id, gene_id, round(CASE WHEN sd > 0 THEN least(v / sd, 10.0) ELSE v END, 6) AS x FROM norm JOIN s USING (gene_id)""")
def nrm5(spark, sf):
    k = kept(spark, sf)
    return preprocess.scale_clip(preprocess.normalize_total(k), preprocess.cell_numbers(k)).withColumn("x", F.round("x", 6))


DEPTH = f"""{W}, depth AS (SELECT dataset_id, cell_id, sum(x) AS depth FROM basket GROUP BY 1, 2), every AS (SELECT gene_id, d.dataset_id, d.cell_id, depth FROM (SELECT DISTINCT p_brand AS gene_id FROM part) g, depth d),
small AS (SELECT dataset_id, cell_id, p_brand AS gene_id, sum(x) AS x FROM basket JOIN part ON gene_id = p_partkey GROUP BY ALL), j AS (SELECT e.*, coalesce(x, 0) AS x FROM every e LEFT JOIN small USING (dataset_id, cell_id, gene_id)),
f AS (SELECT gene_id, regr_slope(x, depth) AS s, regr_intercept(x, depth) AS i FROM j GROUP BY 1)"""


def regressed(spark, sf):
    c = brand_counts(spark, sf)
    depth = materialize(c.groupBy("dataset_id", "cell_id").agg(F.sum("x").alias("depth")), "depth")
    return preprocess.regress_out(c, depth), preprocess.regression_lines(c, depth)


@query("nrm7_regress_out", f"{DEPTH} SELECT dataset_id, cell_id, gene_id, round(x - s * depth - i, 6) AS residual FROM j JOIN f USING (gene_id) WHERE x > 0")
def nrm7(spark, sf):
    """Residuals of the stored entries; every cell takes part in the fit, the zero ones by sums."""
    return regressed(spark, sf)[0].withColumn("residual", F.round("residual", 6))


@query("nrm7_zero_cells", f"{DEPTH} SELECT gene_id, round(any_value(s), 6) AS slope, round(any_value(i), 6) AS intercept, count(*) FILTER (x = 0) AS n_zero, round(coalesce(sum(x - s * depth - i) FILTER (x = 0), 0), 4) AS zero_residuals FROM j JOIN f USING (gene_id) GROUP BY 1")
def nrm7_zero(spark, sf):
    """The lines, which give a zero cell its residual, and the sums of the zero cells' residuals."""
    return regressed(spark, sf)[1].select("gene_id", r("slope"), r("intercept"), "n_zero", r("zero_residuals", 4))


@query("nrm8_min_max", f"{W} SELECT dataset_id, cell_id, round((s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w), 6) AS s FROM (SELECT dataset_id, cell_id, sum(x) AS s FROM basket GROUP BY 1, 2) WINDOW w AS (PARTITION BY dataset_id)")
def nrm8(spark, sf):
    s = counts(spark, sf).groupBy("dataset_id", "cell_id").agg(F.sum("x").alias("s"))
    return preprocess.min_max(s, "s", ["dataset_id"]).withColumn("s", F.round("s", 6))


@query("sel1_dispersion", f"{FILTERED} SELECT dataset_id, gene_id, round(mean, 6) AS mean, round(x, 6) AS x, round(y, 6) AS y FROM disp")
def sel1(spark, sf):
    k = kept(spark, sf)
    d = selection.dispersion(preprocess.normlog(k), preprocess.cell_numbers(k))
    return d.select("dataset_id", "gene_id", r("mean"), r("x"), r("y"))


@query("sel2_mean_range", f"{FILTERED} SELECT dataset_id, gene_id, round(x, 6) AS x FROM scores")
def sel2(spark, sf):
    return scores(spark, sf).select("dataset_id", "gene_id", r("x"))


@query("sel3_bin_stats", f"""{FILTERED}, b AS (SELECT dataset_id, floor((x - 0.25) / 0.25)::INT AS bin, x, y FROM scores WHERE x > 0.25 AND x < 4)
SELECT dataset_id, bin, (0.25 + bin * 0.25 + 0.125)::DOUBLE AS centre, round(median(y), 6) AS median, round(stddev_pop(y), 6) AS std, count(*) AS n FROM b WHERE x <> 0.25 + bin * 0.25 GROUP BY 1, 2""")
def sel3(spark, sf):
    b = selection.bin_statistics(scores(spark, sf))
    return b.select("dataset_id", "bin", F.col("centre").cast("double").alias("centre"), r("median"), r("std"), "n")


@query("sel5_zscores")
def sel5(spark, sf):
    s = scores(spark, sf)
    z = selection.zscores(s, selection.expected_lines(selection.bin_statistics(s)))
    return selection.top_genes(z, TOP)


@query("sel6_seurat", f"""{FILTERED}, e AS (SELECT *, min(x) OVER w AS lo, max(x) OVER w AS hi FROM disp WINDOW w AS (PARTITION BY dataset_id)),
b AS (SELECT *, CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * 20), 19) ELSE 0 END::BIGINT AS bin FROM e)
SELECT dataset_id, gene_id, bin, round(CASE WHEN stddev_samp(y) OVER w > 0 THEN (y - avg(y) OVER w) / stddev_samp(y) OVER w ELSE 1.0 END, 5) AS score FROM b WINDOW w AS (PARTITION BY dataset_id, bin)""")
def sel6(spark, sf):
    k = kept(spark, sf)
    h = selection.hvg_seurat(preprocess.normlog(k), preprocess.cell_numbers(k))
    return h.select("dataset_id", "gene_id", F.col("bin").cast("long").alias("bin"), r("score", 5))


@query("sel6_cell_ranger", f"""{FILTERED}, b AS (SELECT *, exp(y) AS d, ntile(20) OVER (PARTITION BY dataset_id ORDER BY round(mean, 9), gene_id) AS bin FROM disp),
m AS (SELECT *, median(d) OVER (PARTITION BY dataset_id, bin) AS med FROM b), a AS (SELECT *, median(abs(d - med)) OVER (PARTITION BY dataset_id, bin) AS mad FROM m)
SELECT dataset_id, gene_id, bin::INT AS bin, round(CASE WHEN mad > 0 THEN (d - med) / mad ELSE 0 END, 5) AS score FROM a""")
def sel6_cell_ranger(spark, sf):
    k = kept(spark, sf)
    return selection.hvg_cell_ranger(preprocess.normlog(k), preprocess.cell_numbers(k)).select("dataset_id", "gene_id", "bin", r("score", 5))


@query("sel6_variance_stabilised")
def sel6_v3(spark, sf):
    k = kept(spark, sf)
    return selection.top_genes(selection.hvg_variance_stabilised(k, preprocess.cell_numbers(k)), TOP)


@query("sel7_thresholds", f"{FILTERED} SELECT dataset_id, gene_id FROM scores WHERE x > 0.0125 AND x < 3 AND score > 5")
def sel7(spark, sf):
    return selection.between(scores(spark, sf), 0.0125, 3.0, 5.0).select("dataset_id", "gene_id")


@query("sel8_unioncut", f"{FILTERED} SELECT dataset_id, count(DISTINCT gene_id) AS genes, count(*) AS n, sum(x) AS total FROM kept SEMI JOIN (SELECT DISTINCT gene_id FROM ranked WHERE place <= {TOP}) u USING (gene_id) GROUP BY 1")
def sel8(spark, sf):
    u = selection.unioncut(kept(spark, sf), scores(spark, sf), TOP)
    return u.groupBy("dataset_id").agg(F.count_distinct("gene_id").alias("genes"), F.count("*").alias("n"), F.sum("x").alias("total"))


@query("sel9_last_slice", f"{FILTERED} SELECT gene_id, round(score, 6) AS score FROM scores WHERE dataset_id = (SELECT max(dataset_id) FROM scores)")
def sel9(spark, sf):
    return selection.last_slice_scores(scores(spark, sf)).select("gene_id", r("score"))


@query("sel10_annotate", f"""{FILTERED}, alln AS (SELECT dataset_id, cell_id, gene_id, x * 1e4 / sum(x) OVER (PARTITION BY dataset_id, cell_id) AS v FROM basket),
m AS (SELECT dataset_id, gene_id, sum(v) / any_value(n) AS mean, sum(v * v) / any_value(n) AS q2 FROM alln SEMI JOIN kept USING (dataset_id, cell_id, gene_id) JOIN ncells USING (dataset_id) GROUP BY 1, 2)
SELECT dataset_id, gene_id, round(ln((q2 - mean * mean) / mean), 6) AS y FROM m WHERE mean > 0 AND q2 - mean * mean > 1e-12 * q2 AND ln(1 + mean) > 0.015 AND ln(1 + mean) < 4""")
def sel10(spark, sf):
    return selection.annotated_scores(counts(spark, sf), MIN_GENES, MIN_COUNTS, normalise_first=True).select("dataset_id", "gene_id", r("y"))


@query("sel11_merge", f"""{FILTERED}, u AS (SELECT k.* FROM kept k SEMI JOIN (SELECT DISTINCT gene_id FROM ranked WHERE place <= {TOP}) g USING (gene_id)),
o AS (SELECT DISTINCT dataset_id, cell_id FROM kept), e AS (SELECT dataset_id, cell_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY md5('0:' || cell_id), cell_id) r FROM o)
 WHERE r <= (SELECT min(n) FROM (SELECT count(*) n FROM o GROUP BY dataset_id))) SELECT u.* FROM u SEMI JOIN e USING (dataset_id, cell_id)""")
def sel11(spark, sf):
    k = kept(spark, sf)
    even = preprocess.make_even(k.select("dataset_id", "cell_id").distinct())
    return selection.unioncut(k, scores(spark, sf), TOP).join(even, ["dataset_id", "cell_id"], "left_semi").select("dataset_id", "cell_id", "gene_id", "x")


@query("sel12_booltopx", f"{FILTERED} SELECT dataset_id, gene_id, round(score, 6) AS score FROM (SELECT *, rank() OVER (PARTITION BY dataset_id ORDER BY score DESC) AS r FROM scores) WHERE r <= 50")
def sel12(spark, sf):
    return selection.top_genes(scores(spark, sf), 50, ties=True).select("dataset_id", "gene_id", r("score"))


@query("sel13_reproducibility", f"""{FILTERED}, t AS (SELECT dataset_id, gene_id, floor(x / 0.5)::INT AS bin FROM ranked WHERE place <= {TOP}), d AS (SELECT DISTINCT dataset_id AS ds_b FROM t)
SELECT a.dataset_id AS ds_a, ds_b, a.bin, round(avg(CASE WHEN b.gene_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS share, count(*) AS n FROM t a JOIN d ON ds_b <> a.dataset_id
LEFT JOIN t b ON b.dataset_id = ds_b AND b.gene_id = a.gene_id GROUP BY 1, 2, 3""")
def sel13(spark, sf):
    return selection.reproducibility(scores(spark, sf), TOP).withColumn("share", F.round("share", 6))


@query("sel14_overlap", f"{FILTERED} SELECT a.dataset_id AS ds_a, b.dataset_id AS ds_b, count(*) AS common FROM ranked a JOIN ranked b USING (gene_id) WHERE a.place <= {TOP} AND b.place <= {TOP} AND a.dataset_id <= b.dataset_id GROUP BY 1, 2")
def sel14(spark, sf):
    return selection.overlap(scores(spark, sf), TOP)


@query("sel15_binarize", f"{FILTERED} SELECT dataset_id, gene_id, place <= {TOP} AS top FROM ranked")
def sel15(spark, sf):
    s = scores(spark, sf)
    t = selection.top_genes(s, TOP).select("dataset_id", "gene_id", F.lit(True).alias("top"))
    return s.select("dataset_id", "gene_id").join(t, ["dataset_id", "gene_id"], "left").na.fill(False, ["top"])


COSINE = f"""{FILTERED}, nn AS (SELECT dataset_id, sqrt(sum(score * score)) AS norm FROM scores GROUP BY 1),
sim AS (SELECT a.dataset_id AS ds_a, b.dataset_id AS ds_b, sum(a.score * b.score) / (any_value(na.norm) * any_value(nb.norm)) AS value
 FROM scores a JOIN scores b USING (gene_id) JOIN nn na ON na.dataset_id = a.dataset_id JOIN nn nb ON nb.dataset_id = b.dataset_id WHERE a.dataset_id <= b.dataset_id GROUP BY 1, 2)"""


@query("sim1_cosine", f"{COSINE} SELECT ds_a, ds_b, round(value, 6) AS value FROM sim")
def sim1(spark, sf):
    return metrics.cosine(scores(spark, sf)).select("ds_a", "ds_b", r("value"))


PAIRS = "pairs AS (SELECT a.d AS ds_a, b.d AS ds_b FROM (SELECT DISTINCT dataset_id d FROM scores) a JOIN (SELECT DISTINCT dataset_id d FROM scores) b ON a.d <= b.d)"
ON_CHOSEN = """SELECT c.ds_a, c.ds_b, round(sum(coalesce(a.score, 0) * coalesce(b.score, 0)) / sqrt(sum(coalesce(a.score, 0) ** 2) * sum(coalesce(b.score, 0) ** 2)), 6) AS value, count(*) AS n
FROM chosen c LEFT JOIN scores a ON a.dataset_id = c.ds_a AND a.gene_id = c.gene_id LEFT JOIN scores b ON b.dataset_id = c.ds_b AND b.gene_id = c.gene_id GROUP BY 1, 2"""


@query("sim2_cosine_balanced", f"""{FILTERED}, {PAIRS},
u AS (SELECT p.ds_a, p.ds_b, g.gene_id, a.place AS pa, b.place AS pb FROM pairs p JOIN (SELECT DISTINCT dataset_id, gene_id FROM ranked WHERE place <= {TOP}) g ON g.dataset_id IN (p.ds_a, p.ds_b)
 LEFT JOIN ranked a ON a.dataset_id = p.ds_a AND a.gene_id = g.gene_id AND a.place <= {TOP} LEFT JOIN ranked b ON b.dataset_id = p.ds_b AND b.gene_id = g.gene_id AND b.place <= {TOP}),
e AS (SELECT DISTINCT *, CASE WHEN pa IS NOT NULL AND pb IS NOT NULL THEN 'both' WHEN pa IS NOT NULL THEN 'a' ELSE 'b' END AS kind FROM u),
k AS (SELECT *, floor(({TOP} - count(*) FILTER (kind = 'both') OVER (PARTITION BY ds_a, ds_b)) / 2) AS m, row_number() OVER (PARTITION BY ds_a, ds_b, kind ORDER BY coalesce(pa, pb), gene_id) AS r FROM e),
chosen AS (SELECT ds_a, ds_b, gene_id FROM k WHERE kind = 'both' OR r <= m) {ON_CHOSEN}""")
def sim2(spark, sf):
    s = scores(spark, sf)
    return metrics.cosine_on(s, metrics.balanced_pairs(s, TOP)).withColumn("value", F.round("value", 6))


@query("sim3_cosine_each", f"""{FILTERED}, {PAIRS}, chosen AS (SELECT DISTINCT ds_a, ds_b, gene_id FROM pairs JOIN ranked ON dataset_id IN (ds_a, ds_b) AND place <= {TOP}) {ON_CHOSEN}""")
def sim3(spark, sf):
    s = scores(spark, sf)
    return metrics.cosine_on(s, metrics.union_top_pairs(s, TOP)).withColumn("value", F.round("value", 6))


JACCARD = f"""{FILTERED}, t AS (SELECT dataset_id, gene_id FROM ranked WHERE place <= {TOP}), c AS (SELECT a.dataset_id AS ds_a, b.dataset_id AS ds_b, count(*) AS c FROM t a JOIN t b USING (gene_id) WHERE a.dataset_id <= b.dataset_id GROUP BY 1, 2),
n AS (SELECT dataset_id, count(*) AS n FROM t GROUP BY 1), jac AS (SELECT a.dataset_id AS ds_a, b.dataset_id AS ds_b, coalesce(c.c, 0) / (a.n + b.n - coalesce(c.c, 0)) AS value
FROM n a JOIN n b ON a.dataset_id <= b.dataset_id LEFT JOIN c ON c.ds_a = a.dataset_id AND c.ds_b = b.dataset_id)"""


@query("sim4_jaccard", f"{JACCARD} SELECT ds_a, ds_b, round(value, 6) AS value FROM jac")
def sim4(spark, sf):
    return metrics.jaccard(selection.top_genes(scores(spark, sf), TOP)).select("ds_a", "ds_b", r("value"))


@query("sim6_jaccard_from_overlap", f"{FILTERED} SELECT a.dataset_id AS ds_a, b.dataset_id AS ds_b, round(count(*) / (200.0 - count(*)), 6) AS value FROM ranked a JOIN ranked b USING (gene_id) WHERE a.place <= {TOP} AND b.place <= {TOP} AND a.dataset_id <= b.dataset_id GROUP BY 1, 2")
def sim6(spark, sf):
    return selection.overlap(scores(spark, sf), TOP).select("ds_a", "ds_b", F.round(metrics.jaccard_from_overlap(F.col("common"), TOP), 6).alias("value"))


@query("sim7_blend", f"{COSINE.replace('ranked AS', 'rk AS')}, {JACCARD[JACCARD.index('ranked AS'):]} SELECT ds_a, ds_b, round(sim.value + jac.value * (SELECT sum(value) FROM sim) / (SELECT sum(value) FROM jac), 6) AS value FROM sim JOIN jac USING (ds_a, ds_b)")
def sim7(spark, sf):
    s = scores(spark, sf)
    return metrics.blend(metrics.cosine(s), metrics.jaccard(selection.top_genes(s, TOP))).select("ds_a", "ds_b", r("value"))


@query("sim8_self_normalised", f"{JACCARD}, d AS (SELECT ds_a AS d, value AS own FROM jac WHERE ds_a = ds_b) SELECT ds_a, ds_b, round(value / ((a.own + b.own) / 2), 6) AS value FROM jac JOIN d a ON a.d = ds_a JOIN d b ON b.d = ds_b")
def sim8(spark, sf):
    return metrics.by_self_similarity(metrics.jaccard(selection.top_genes(scores(spark, sf), TOP))).select("ds_a", "ds_b", r("value"))


@query("met8_markers", f"""{FILTERED}, l AS (SELECT n.dataset_id, n.gene_id, o.label, ln(1 + v) AS x FROM norm n JOIN obs o USING (dataset_id, cell_id)), ob AS (SELECT o.label FROM obs o SEMI JOIN kept USING (dataset_id, cell_id)),
z AS (SELECT label, count(*) AS n FROM ob GROUP BY 1), s AS (SELECT label, gene_id, sum(x) AS s, sum(x * x) AS q FROM l GROUP BY 1, 2), t AS (SELECT gene_id, sum(s) AS ts, sum(q) AS tq FROM s GROUP BY 1),
j AS (SELECT label, gene_id, n, tn - n AS m, s / n AS m1, (ts - s) / (tn - n) AS m2, s, q, tq FROM s JOIN t USING (gene_id) JOIN z USING (label), (SELECT count(*) AS tn FROM ob)),
e AS (SELECT label, gene_id, m1 - m2 AS d, (q - n * m1 * m1) / (n - 1) / n + (tq - q - m * m2 * m2) / (m - 1) / m AS se FROM j), f AS (SELECT label, gene_id, d / sqrt(se) AS t FROM e WHERE se > 1e-12)
SELECT label, gene_id, round(t, 6) AS t, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(t, 9) DESC, gene_id) AS place FROM f) WHERE place <= 20""")
def met8(spark, sf):
    k = kept(spark, sf)
    obs = views.basket_obs(spark, sf).join(k.select("dataset_id", "cell_id").distinct(), ["dataset_id", "cell_id"], "left_semi")
    return metrics.markers(preprocess.normlog(k), obs, 20).select("label", "gene_id", r("t"), "place")


@query("met9_score_difference", f"""{FILTERED}, lows AS (SELECT dataset_id, min(score) AS low FROM scores GROUP BY 1)
SELECT a.dataset_id AS ds_a, l.dataset_id AS ds_b, a.gene_id, round(abs(a.score - coalesce(b.score, low)), 6) AS diff
FROM scores a JOIN lows l ON l.dataset_id <> a.dataset_id LEFT JOIN scores b ON b.dataset_id = l.dataset_id AND b.gene_id = a.gene_id""")
def met9(spark, sf):
    return metrics.score_differences(scores(spark, sf)).select("ds_a", "ds_b", "gene_id", r("diff"))


FULL = f"{COSINE}, full_sim AS (SELECT ds_a, ds_b, round(value, 9) AS value FROM sim UNION ALL SELECT ds_b, ds_a, round(value, 9) FROM sim WHERE ds_a <> ds_b)"


def full_sim(spark, sf):
    return matrix.mirror(metrics.cosine(scores(spark, sf)).withColumn("value", F.round("value", 9)))


@query("met13_precision_at_k", f"""{FULL} SELECT round(avg(CASE WHEN ds_a % 2 = ds_b % 2 THEN 1.0 ELSE 0.0 END), 6) AS precision, count(*) AS n FROM
(SELECT *, row_number() OVER (PARTITION BY ds_a ORDER BY value DESC, ds_b) AS r FROM full_sim WHERE ds_a <> ds_b) WHERE r <= 2""")
def met13(spark, sf):
    m = full_sim(spark, sf)
    classes = m.select(F.col("ds_a").alias("dataset_id"), (F.col("ds_a") % 2).alias("class")).distinct()
    return metrics.precision_at_k(m, classes, 2).withColumn("precision", F.round("precision", 6))


@query("mat1_all_pairs", f"{W}, d AS (SELECT DISTINCT dataset_id FROM obs) SELECT a.dataset_id AS ds_a, b.dataset_id AS ds_b, rep::INT AS rep FROM d a JOIN d b ON a.dataset_id <= b.dataset_id, range(3) t(rep)")
def mat1(spark, sf):
    return matrix.pair_jobs(views.basket_obs(spark, sf).select("dataset_id").distinct(), 3)


REPS = f"""{W}, d AS (SELECT DISTINCT dataset_id, (('0x' || substr(md5('rep:' || cell_id), 1, 8))::BIGINT % 3)::INT AS rep, gene_id FROM basket),
n AS (SELECT dataset_id, rep, count(*) AS n FROM d GROUP BY 1, 2), tensor AS (SELECT a.dataset_id AS ds_a, b.dataset_id AS ds_b, a.rep::INT AS rep,
 round(count(*) / (any_value(na.n) + any_value(nb.n) - count(*)), 9) AS value FROM d a JOIN d b ON a.gene_id = b.gene_id AND a.rep = b.rep AND a.dataset_id <= b.dataset_id
 JOIN n na ON na.dataset_id = a.dataset_id AND na.rep = a.rep JOIN n nb ON nb.dataset_id = b.dataset_id AND nb.rep = b.rep GROUP BY 1, 2, 3),
med AS (SELECT ds_a, ds_b, median(value) AS value FROM tensor GROUP BY 1, 2), fullm AS (SELECT * FROM med UNION ALL SELECT ds_b, ds_a, value FROM med WHERE ds_a <> ds_b)"""


def tensor(spark, sf):
    """Jaccard of the parts bought in each region by thirds of the customers, a full split by md5 of the id."""
    rep = F.conv(F.substring(F.md5(F.concat(F.lit("rep:"), F.col("cell_id").cast("string"))), 1, 8), 16, 10).cast("long") % 3
    g = materialize(counts(spark, sf).select("dataset_id", rep.cast("int").alias("rep"), "gene_id").distinct(), "tensor")
    n = g.groupBy("dataset_id", "rep").agg(F.count("*").alias("n"))
    a, b = g.withColumnRenamed("dataset_id", "ds_a"), g.withColumnRenamed("dataset_id", "ds_b")
    common = a.join(b, ["rep", "gene_id"]).where("ds_a <= ds_b").groupBy("ds_a", "ds_b", "rep").agg(F.count("*").alias("c"))
    na, nb = (n.withColumnsRenamed({"dataset_id": x, "n": f"n{x}"}) for x in ("ds_a", "ds_b"))
    j = common.join(F.broadcast(na), ["ds_a", "rep"]).join(F.broadcast(nb), ["ds_b", "rep"])
    return j.select("ds_a", "ds_b", "rep", F.round(F.col("c") / (F.col("nds_a") + F.col("nds_b") - F.col("c")), 9).alias("value"))


@query("mat3_repeats", f"{REPS} SELECT * FROM tensor")
def mat3(spark, sf):
    return tensor(spark, sf)


@query("mat2_median_matrix", f"{REPS} SELECT ds_a, ds_b, round(value, 6) AS value FROM fullm")
def mat2(spark, sf):
    return matrix.median_matrix(tensor(spark, sf)).select("ds_a", "ds_b", r("value"))


@query("mat4_nearest_datasets", f"{REPS} SELECT ds_a, ds_b, round(value, 6) AS value, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY ds_a ORDER BY value DESC, ds_b) AS place FROM fullm WHERE ds_a <> ds_b) WHERE place <= 2")
def mat4(spark, sf):
    return matrix.nearest_datasets(tensor(spark, sf), 2).select("ds_a", "ds_b", r("value"), "place")


@query("mat5_class_codes", "SELECT n_name AS name, substr(n_name, 1, 2) AS class, (dense_rank() OVER (ORDER BY substr(n_name, 1, 2)) - 1)::INT AS code FROM nation")
def mat5(spark, sf):
    return matrix.class_codes(table(spark, sf, "nation").select(F.col("n_name").alias("name")), 2)


@query("mat7_mirror", f"{REPS} SELECT * FROM tensor UNION ALL SELECT ds_b, ds_a, rep, value FROM tensor WHERE ds_a <> ds_b")
def mat7(spark, sf):
    return matrix.mirror(tensor(spark, sf))


@query("mat8_cdf", f"""{REPS}, v AS (SELECT CASE WHEN ds_a = ds_b THEN 'same' WHEN ds_a % 2 = ds_b % 2 THEN 'class' ELSE 'other' END AS kind, value FROM tensor)
SELECT kind, i / 10 AS threshold, round(avg(CASE WHEN value < i / 10 THEN 1.0 ELSE 0.0 END), 6) AS share FROM v, range(11) t(i) GROUP BY 1, 2""")
def mat8(spark, sf):
    kind = F.when(F.col("ds_a") == F.col("ds_b"), "same").when(F.col("ds_a") % 2 == F.col("ds_b") % 2, "class").otherwise("other")
    return matrix.coverage(tensor(spark, sf), kind).withColumn("share", F.round("share", 6))


@query("mat9_cutoff", f"{REPS} SELECT relation, round(median(perf), 6) AS median, count(*) AS n FROM (SELECT CASE WHEN ds_a = ds_b THEN 'self' ELSE 'pair' END AS relation, value * 2 AS perf, value FROM tensor) WHERE value >= 0.2 GROUP BY 1")
def mat9(spark, sf):
    t = tensor(spark, sf).withColumn("perf", F.col("value") * 2)
    return matrix.cutoff_performance(t, F.when(F.col("ds_a") == F.col("ds_b"), "self").otherwise("pair"), "perf", 0.2).withColumn("median", F.round("median", 6))


@query("mat10_spread", f"{REPS} SELECT ds_a, ds_b, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(var_pop(value), 6) AS var, count(*) AS n FROM tensor GROUP BY 1, 2")
def mat10(spark, sf):
    return matrix.spread_statistics(tensor(spark, sf), ["ds_a", "ds_b"]).select("ds_a", "ds_b", r("mean"), r("std"), r("var"), "n")


@query("mat11_sweep", f"""{FILTERED}, p AS (SELECT unnest([50, 100, 200]) AS top), t AS (SELECT top, dataset_id, gene_id FROM ranked JOIN p ON place <= top)
SELECT a.top::INT AS top, a.dataset_id AS ds_a, b.dataset_id AS ds_b, count(*) AS common FROM t a JOIN t b ON a.top = b.top AND a.gene_id = b.gene_id AND a.dataset_id < b.dataset_id GROUP BY 1, 2, 3""")
def mat11(spark, sf):
    """All settings of the sweep in one pass: a parameter column instead of repeated runs."""
    ranked = selection.top_genes(scores(spark, sf), 200)
    t = ranked.withColumn("top", F.explode(F.array(*map(F.lit, (50, 100, 200))))).where("place <= top").select("top", "dataset_id", "gene_id")
    a, b = t.withColumnRenamed("dataset_id", "ds_a"), t.withColumnRenamed("dataset_id", "ds_b")
    return a.join(b, ["top", "gene_id"]).where("ds_a < ds_b").groupBy("top", "ds_a", "ds_b").agg(F.count("*").alias("common"))


@query("mat13_greedy_order", f"{FULL}, s AS (SELECT ds_a FROM full_sim WHERE ds_a <> ds_b GROUP BY 1 ORDER BY round(sum(value), 8), ds_a LIMIT 1) SELECT ds_b AS dataset_id, round(value, 6) AS value, row_number() OVER (ORDER BY value, ds_b)::INT AS place FROM full_sim WHERE ds_a = (SELECT ds_a FROM s)")
def mat13(spark, sf):
    return matrix.order_by_similarity(full_sim(spark, sf)).select("dataset_id", r("value"), "place")


def brand_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities by region, customer and brand."""
    brand = table(spark, sf, "part").select(F.col("p_partkey").alias("gene_id"), "p_brand")
    return materialize(counts(spark, sf).join(brand, "gene_id").groupBy("dataset_id", "cell_id", F.col("p_brand").alias("gene_id")).agg(F.sum("x").alias("x")), "brands")


@query("noi1_noise", f"""{W}, small AS (SELECT dataset_id, cell_id, p_brand AS gene_id, sum(x) AS x FROM basket JOIN part ON gene_id = p_partkey GROUP BY ALL), c AS (SELECT dataset_id, cell_id, row_number() OVER (PARTITION BY dataset_id ORDER BY cell_id) - 1 AS pos FROM obs), n AS (SELECT dataset_id, count(*) AS n FROM c GROUP BY 1),
u AS (SELECT g.dataset_id, g.gene_id, cell_id, pos, n, ('0x' || substr(md5('3a:' || g.dataset_id || ':' || cell_id || ':' || gene_id), 1, 8))::BIGINT / 4294967296.0 AS ua,
 ('0x' || substr(md5('3b:' || g.dataset_id || ':' || cell_id || ':' || gene_id), 1, 8))::BIGINT / 4294967296.0 AS ub FROM (SELECT DISTINCT dataset_id, gene_id FROM small) g JOIN c USING (dataset_id) JOIN n USING (dataset_id)),
d AS (SELECT dataset_id, gene_id, cell_id, CASE WHEN ua < 0.3 THEN floor(ub * n)::BIGINT ELSE pos END AS donor FROM u)
SELECT d.dataset_id, d.cell_id, d.gene_id, s.x FROM d JOIN c ON c.dataset_id = d.dataset_id AND c.pos = d.donor JOIN small s ON s.dataset_id = d.dataset_id AND s.cell_id = c.cell_id AND s.gene_id = d.gene_id""")
def noi1(spark, sf):
    """Noise on the matrix of brands."""
    return matrix.noisy(brand_counts(spark, sf), views.basket_obs(spark, sf), 0.3, 3)


@query("pre1_venn", f"{FILTERED}, s AS (SELECT gene_id, string_agg(dataset_id::VARCHAR, '+' ORDER BY dataset_id) AS members FROM ranked WHERE place <= {TOP} GROUP BY 1) SELECT members, count(*) AS n FROM s GROUP BY 1")
def pre1(spark, sf):
    from plexmat.operators.align import set_regions

    return set_regions(selection.top_genes(scores(spark, sf), TOP).select(F.col("dataset_id").alias("set_id"), F.col("gene_id").alias("item")))


@query("pre3_quartiles", f"{W} SELECT dataset_id, min(s) AS low, quantile_cont(s, 0.25) AS q1, median(s) AS median, quantile_cont(s, 0.75) AS q3, max(s) AS high FROM (SELECT dataset_id, cell_id, sum(x) AS s FROM basket GROUP BY 1, 2) GROUP BY 1")
def pre3(spark, sf):
    from plexmat.operators.align import quartiles

    return quartiles(counts(spark, sf).groupBy("dataset_id", "cell_id").agg(F.sum("x").alias("s")), "dataset_id", "s")
