"""Agreement metrics and dataset similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plexmat.functions.expressions import choose2
from plexmat.operators.distance import knn


def adjusted_rand(labels: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    """(by..., ari, n) of two label columns; 1 where both are one cluster or all singletons."""
    by = list(by)
    cells = labels.groupBy(*by, a, b).agg(F.count("*").alias("n"))
    rows, cols = cells.groupBy(*by, a).agg(F.sum("n").alias("n")), cells.groupBy(*by, b).agg(F.sum("n").alias("n"))
    s = lambda df, name, *more: df.groupBy(*by).agg(F.sum(choose2(F.col("n"))).alias(name), *more)
    i, r, c = s(cells, "i", F.sum("n").alias("n")), s(rows, "r"), s(cols, "c")
    j = i.join(r, by).join(c, by) if by else i.join(r).join(c)
    e, m = F.col("r") * F.col("c") / choose2(F.col("n")), (F.col("r") + F.col("c")) / 2
    return j.select(*by, F.when(m == e, 1.0).otherwise((F.col("i") - e) / (m - e)).alias("ari"), "n")


def dense_labels(labels: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """Labels renumbered 0..n-1 without holes."""
    codes = labels.select(*by, column).distinct().withColumn("dense", (F.dense_rank().over(Window.partitionBy(*by).orderBy(column)) - 1).cast("int"))
    return labels.join(codes, [*by, column])


def gaussian_similarity(a: DataFrame, b: DataFrame, least: int = 5) -> DataFrame:
    """(label, sim): exp(-d^2 / avg^2) of mean nearest distances within and across; labels with few members are skipped."""
    keep = lambda p: p.withColumn("__n", F.count("*").over(Window.partitionBy("label"))).where(F.col("__n") >= least)
    a, b = keep(a).select("label", "cell_id", "vec"), keep(b).select("label", "cell_id", "vec")
    mean = lambda x, y, same, name: knn(x, y, 1, groups=["label"], exclude_self=same).groupBy("label").agg(F.avg("dist").alias(name))
    j = mean(a, a, True, "aa").join(mean(b, b, True, "bb"), "label").join(mean(a, b, False, "ab"), "label").join(mean(b, a, False, "ba"), "label")
    d, avg = (F.col("ab") + F.col("ba")) / 2, (F.col("aa") + F.col("bb")) / 2
    return j.select("label", F.exp(-d * d / (avg * avg)).alias("sim"))


def nearest_label_agreement(a: DataFrame, b: DataFrame, same: bool) -> DataFrame:
    """Share of points whose nearest neighbour has their label: (accuracy, n)."""
    k = knn(a.select("cell_id", "vec"), b.select("cell_id", "vec"), 1, exclude_self=same)
    j = k.join(a.select(F.col("cell_id").alias("src"), F.col("label").alias("own")), "src").join(b.select(F.col("cell_id").alias("dst"), F.col("label").alias("near")), "dst")
    return j.agg(F.avg((F.col("own") == F.col("near")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def markers(logged: DataFrame, obs: DataFrame, top: int) -> DataFrame:
    """(label, gene_id, t, place): Welch's t of each gene in a cluster against the rest, zeros counted.

    One aggregation per (label, gene); the rest is the total minus the cluster, so clusters are not compared one by one.
    """
    sizes = obs.groupBy("label").agg(F.count("*").alias("n"))
    x = logged.join(obs.select("dataset_id", "cell_id", "label"), ["dataset_id", "cell_id"])
    s = x.groupBy("label", "gene_id").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    total = s.groupBy("gene_id").agg(F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    n_all = sizes.agg(F.sum("n").alias("tn"))
    j = s.join(total, "gene_id").join(F.broadcast(sizes), "label").join(F.broadcast(n_all)).where("n > 1 AND tn - n > 1")
    m1, m2 = F.col("s") / F.col("n"), (F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))
    v1 = (F.col("q") - F.col("n") * m1 * m1) / (F.col("n") - 1)
    v2 = (F.col("tq") - F.col("q") - (F.col("tn") - F.col("n")) * m2 * m2) / (F.col("tn") - F.col("n") - 1)
    se = v1 / F.col("n") + v2 / (F.col("tn") - F.col("n"))
    t = j.select("label", "gene_id", F.when(se > 1e-12, (m1 - m2) / F.sqrt(se)).alias("t")).where("t IS NOT NULL")
    w = Window.partitionBy("label").orderBy(F.desc(F.round("t", 9)), "gene_id")
    return t.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def score_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(gene_id, diff): absolute score difference; a gene that b lacks takes b's smallest score."""
    low = b.agg(F.min("score").alias("low"))
    return a.select("gene_id", F.col("score").alias("sa")).join(b.select("gene_id", F.col("score").alias("sb")), "gene_id", "left").join(F.broadcast(low)).select(
        "gene_id", F.abs(F.col("sa") - F.coalesce("sb", "low")).alias("diff"))


def score_differences(scores: DataFrame) -> DataFrame:
    """(ds_a, ds_b, gene_id, diff) of all ordered pairs of datasets, in one join; a gene that ds_b lacks takes its smallest score."""
    lows = scores.groupBy(F.col("dataset_id").alias("ds_b")).agg(F.min("score").alias("low"))  # a row a dataset
    a = scores.select(F.col("dataset_id").alias("ds_a"), "gene_id", F.col("score").alias("sa"))
    b = scores.select(F.col("dataset_id").alias("ds_b"), "gene_id", F.col("score").alias("sb"))
    return a.join(F.broadcast(lows), F.col("ds_a") != F.col("ds_b")).join(b, ["ds_b", "gene_id"], "left").select(
        "ds_a", "ds_b", "gene_id", F.abs(F.col("sa") - F.coalesce("sb", "low")).alias("diff"))


def best_f1(labels: DataFrame, truth: str, cluster: str) -> DataFrame:
    """(truth, cluster, f1): for each true label the cluster that consists of it most, and the F1 of that pair."""
    cells = labels.groupBy(truth, cluster).agg(F.count("*").alias("n"))
    cells = cells.withColumn("nt", F.sum("n").over(Window.partitionBy(truth))).withColumn("nc", F.sum("n").over(Window.partitionBy(cluster)))
    w = Window.partitionBy(truth).orderBy(F.desc(F.col("n") / F.col("nc")), F.desc("n"), cluster)
    return cells.withColumn("r", F.row_number().over(w)).where("r = 1").select(truth, cluster, (2.0 * F.col("n") / (F.col("nt") + F.col("nc"))).alias("f1"))


def precision_at_k(sim: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(precision, n): share of the k most similar other datasets that have the row's class; ``sim`` is (ds_a, ds_b, value)."""
    w = Window.partitionBy("ds_a").orderBy(F.desc("value"), "ds_b")
    near = sim.where("ds_a <> ds_b").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    c = lambda name: classes.select(F.col("dataset_id").alias(name), F.col("class").alias(f"class_{name}"))
    j = near.join(F.broadcast(c("ds_a")), "ds_a").join(F.broadcast(c("ds_b")), "ds_b")
    return j.agg(F.avg((F.col("class_ds_a") == F.col("class_ds_b")).cast("double")).alias("precision"), F.count("*").alias("n"))


# similarity of gene scores: one self-join on the gene serves all pairs ---------------------------------------------------


def _pairs(scores: DataFrame) -> DataFrame:
    a = scores.select(F.col("dataset_id").alias("ds_a"), "gene_id", F.col("score").alias("sa"))
    b = scores.select(F.col("dataset_id").alias("ds_b"), "gene_id", F.col("score").alias("sb"))
    return a.join(b, "gene_id").where("ds_a <= ds_b")


def cosine(scores: DataFrame) -> DataFrame:
    """(ds_a, ds_b, value): cosine of the score vectors; genes without a score count as 0."""
    dots = _pairs(scores).groupBy("ds_a", "ds_b").agg(F.sum(F.col("sa") * F.col("sb")).alias("dot"))
    norms = scores.groupBy("dataset_id").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))
    na, nb = norms.select(F.col("dataset_id").alias("ds_a"), F.col("norm").alias("na")), norms.select(F.col("dataset_id").alias("ds_b"), F.col("norm").alias("nb"))
    return dots.join(F.broadcast(na), "ds_a").join(F.broadcast(nb), "ds_b").select("ds_a", "ds_b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("value"))


def jaccard(selected: DataFrame) -> DataFrame:
    """(ds_a, ds_b, value): shared share of selected genes, (dataset_id, gene_id)."""
    g = selected.select("dataset_id", "gene_id").distinct().withColumn("score", F.lit(1.0))
    common = _pairs(g).groupBy("ds_a", "ds_b").agg(F.count("*").alias("c"))
    n = g.groupBy("dataset_id").agg(F.count("*").alias("n"))
    a, b = n.select(F.col("dataset_id").alias("ds_a"), F.col("n").alias("n_a")), n.select(F.col("dataset_id").alias("ds_b"), F.col("n").alias("n_b"))
    every = a.join(F.broadcast(b)).where("ds_a <= ds_b")
    return every.join(common, ["ds_a", "ds_b"], "left").na.fill(0, ["c"]).select("ds_a", "ds_b", (F.col("c") / (F.col("n_a") + F.col("n_b") - F.col("c"))).alias("value"))


def cosine_on(scores: DataFrame, chosen: DataFrame) -> DataFrame:
    """Cosine per pair over a gene set of the pair: ``chosen`` is (ds_a, ds_b, gene_id)."""
    a = scores.select(F.col("dataset_id").alias("ds_a"), "gene_id", F.col("score").alias("sa"))
    b = scores.select(F.col("dataset_id").alias("ds_b"), "gene_id", F.col("score").alias("sb"))
    j = chosen.join(a, ["ds_a", "gene_id"], "left").join(b, ["ds_b", "gene_id"], "left").na.fill(0.0, ["sa", "sb"])
    return j.groupBy("ds_a", "ds_b").agg(
        (F.sum(F.col("sa") * F.col("sb")) / F.sqrt(F.sum(F.col("sa") * F.col("sa")) * F.sum(F.col("sb") * F.col("sb")))).alias("value"), F.count("*").alias("n"))


def _places(scores: DataFrame) -> DataFrame:
    return scores.withColumn("place", F.row_number().over(Window.partitionBy("dataset_id").orderBy(F.desc("score"), "gene_id")))


def union_top_pairs(scores: DataFrame, n: int) -> DataFrame:
    """(ds_a, ds_b, gene_id): genes among the n best of either dataset."""
    top = _places(scores).where(F.col("place") <= n).select("dataset_id", "gene_id")
    ids = top.select("dataset_id").distinct()
    pairs = ids.select(F.col("dataset_id").alias("ds_a")).join(F.broadcast(ids.select(F.col("dataset_id").alias("ds_b")))).where("ds_a <= ds_b")
    one = pairs.join(top.withColumnRenamed("dataset_id", "ds_a"), "ds_a")
    two = pairs.join(top.withColumnRenamed("dataset_id", "ds_b"), "ds_b")
    return one.unionByName(two.select(*one.columns)).distinct()


def balanced_pairs(scores: DataFrame, n: int) -> DataFrame:
    """Common genes of both top n, and the best floor((n - common) / 2) others of each."""
    top = _places(scores).where(F.col("place") <= n).select("dataset_id", "gene_id", "place")
    a = top.select(F.col("dataset_id").alias("ds_a"), "gene_id", F.col("place").alias("pa"))
    b = top.select(F.col("dataset_id").alias("ds_b"), "gene_id", F.col("place").alias("pb"))
    ids = top.select("dataset_id").distinct()
    pairs = ids.select(F.col("dataset_id").alias("ds_a")).join(F.broadcast(ids.select(F.col("dataset_id").alias("ds_b")))).where("ds_a <= ds_b")
    left = pairs.join(a, "ds_a").join(b, ["ds_b", "gene_id"], "left").select("ds_a", "ds_b", "gene_id", "pa", "pb")
    right = pairs.join(b, "ds_b").join(a, ["ds_a", "gene_id"], "left_anti").select("ds_a", "ds_b", "gene_id", F.lit(None).cast("int").alias("pa"), "pb")
    every = left.unionByName(right)
    w = Window.partitionBy("ds_a", "ds_b")
    common = F.sum(F.when(F.col("pa").isNotNull() & F.col("pb").isNotNull(), 1).otherwise(0)).over(w)
    kind = F.when(F.col("pa").isNotNull() & F.col("pb").isNotNull(), "both").when(F.col("pa").isNotNull(), "a").otherwise("b")
    ranked = every.withColumn("m", F.floor((F.lit(n) - common) / 2)).withColumn("kind", kind).withColumn(
        "r", F.row_number().over(Window.partitionBy("ds_a", "ds_b", "kind").orderBy(F.coalesce("pa", "pb"), "gene_id")))
    return ranked.where((F.col("kind") == "both") | (F.col("r") <= F.col("m"))).select("ds_a", "ds_b", "gene_id")


def jaccard_from_overlap(x: Column, size: int) -> Column:
    """Jaccard similarity of two sets of equal size from their overlap."""
    return x / (2.0 * size - x)


def blend(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of two similarity matrices after scaling b to the mass of a."""
    t = a.agg(F.sum("value").alias("ma")).join(b.agg(F.sum("value").alias("mb")))
    return a.join(b.withColumnRenamed("value", "vb"), ["ds_a", "ds_b"]).join(F.broadcast(t)).select("ds_a", "ds_b", (F.col("value") + F.col("vb") * F.col("ma") / F.col("mb")).alias("value"))


def by_self_similarity(sim: DataFrame) -> DataFrame:
    """Each value divided by the mean of the two self-similarities."""
    d = sim.where("ds_a = ds_b").select(F.col("ds_a").alias("d"), F.col("value").alias("own"))
    a, b = d.select(F.col("d").alias("ds_a"), F.col("own").alias("oa")), d.select(F.col("d").alias("ds_b"), F.col("own").alias("ob"))
    return sim.join(F.broadcast(a), "ds_a").join(F.broadcast(b), "ds_b").select("ds_a", "ds_b", (F.col("value") / ((F.col("oa") + F.col("ob")) / 2)).alias("value"))
