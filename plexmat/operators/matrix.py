"""Dataset-by-dataset matrices over repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plexmat.functions.expressions import md5_uniform


def pair_jobs(datasets: DataFrame, repeats: int) -> DataFrame:
    """(ds_a, ds_b, rep): the upper triangle with its diagonal times the repeats."""
    a, b = datasets.select(F.col("dataset_id").alias("ds_a")), datasets.select(F.col("dataset_id").alias("ds_b"))
    return a.join(F.broadcast(b)).where("ds_a <= ds_b").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))


def mirror(tri: DataFrame) -> DataFrame:
    """Both halves of a symmetric matrix from its upper triangle."""
    swap = {"ds_a": "ds_b", "ds_b": "ds_a"}
    return tri.unionByName(tri.where("ds_a <> ds_b").select(*(F.col(swap.get(c, c)).alias(c) for c in tri.columns)))


def median_matrix(tensor: DataFrame) -> DataFrame:
    """(ds_a, ds_b, value): the median over repeats, mirrored."""
    return mirror(tensor.groupBy("ds_a", "ds_b").agg(F.median("value").alias("value")))


def nearest_datasets(tensor: DataFrame, k: int) -> DataFrame:
    """(ds_a, ds_b, value, place): the k most similar other datasets by the median over repeats."""
    w = Window.partitionBy("ds_a").orderBy(F.desc("value"), "ds_b")
    return median_matrix(tensor).where("ds_a <> ds_b").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def class_codes(names: DataFrame, prefix: int = 5) -> DataFrame:
    """(name, class, code): the class is the first characters of the name."""
    c = names.withColumn("class", F.substring("name", 1, prefix))
    codes = c.select("class").distinct().withColumn("code", (F.dense_rank().over(Window.orderBy("class")) - 1).cast("int"))
    return c.join(F.broadcast(codes), "class").select("name", "class", "code")


def spread_statistics(tensor: DataFrame, by: list[str]) -> DataFrame:
    """Mean, population deviation and variance over repeats."""
    return tensor.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.var_pop("value").alias("var"), F.count("*").alias("n"))


def coverage(values: DataFrame, kind: Column, steps: int = 10) -> DataFrame:
    """(kind, threshold, share): share of each kind's values below thresholds from 0 to 1."""
    t = values.withColumn("kind", kind).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    return t.groupBy("kind", "i").agg(F.avg((F.col("value") < F.col("i") / steps).cast("double")).alias("share")).select(
        "kind", (F.col("i") / steps).alias("threshold"), "share")


def cutoff_performance(sim: DataFrame, relation: Column, performance: str, cutoff: float) -> DataFrame:
    """(relation, median, n): the median performance of each relation among pairs above the cutoff."""
    return sim.where(F.col("value") >= cutoff).withColumn("relation", relation).groupBy("relation").agg(F.median(performance).alias("median"), F.count("*").alias("n"))


def order_by_similarity(sim: DataFrame) -> DataFrame:
    """(dataset_id, value, place): the dataset least similar to all others starts, the others follow by rising similarity to it."""
    total = sim.where("ds_a <> ds_b").groupBy("ds_a").agg(F.sum("value").alias("s"))
    start = total.agg(F.min_by("ds_a", F.struct("s", "ds_a")).alias("start"))
    return sim.join(F.broadcast(start), F.col("ds_a") == F.col("start")).select(
        F.col("ds_b").alias("dataset_id"), "value", F.row_number().over(Window.partitionBy("start").orderBy("value", "ds_b")).alias("place"))


def noisy(counts: DataFrame, obs: DataFrame, p: float, seed: int = 0) -> DataFrame:
    """Counts where each (cell, gene) is redrawn with probability p from its gene's values in the dataset, zeros included.

    Draws are md5 hashes of seed, dataset, cell and gene: the first decides whether, the second names the donor cell. A pair of a cell and a gene that
    nobody expresses stays zero, so only expressed genes are gridded.
    """
    u = lambda salt: md5_uniform(f"{seed}{salt}", "dataset_id", "cell_id", "gene_id")
    cells = obs.select("dataset_id", "cell_id", (F.row_number().over(Window.partitionBy("dataset_id").orderBy("cell_id")) - 1).alias("at"))
    n = cells.groupBy("dataset_id").agg(F.count("*").alias("n"))
    genes = counts.select("dataset_id", "gene_id").distinct()
    grid = genes.join(cells, "dataset_id").join(F.broadcast(n), "dataset_id").withColumn("donor", F.when(u("a") < p, F.floor(u("b") * F.col("n"))).otherwise(F.col("at")))
    donor = cells.select("dataset_id", F.col("at").alias("donor"), F.col("cell_id").alias("donor_cell"))
    values = counts.select("dataset_id", F.col("cell_id").alias("donor_cell"), "gene_id", "x")
    return grid.join(donor, ["dataset_id", "donor"]).join(values, ["dataset_id", "donor_cell", "gene_id"]).select("dataset_id", "cell_id", "gene_id", "x")
