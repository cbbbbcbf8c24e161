"""Filters, sampling and normalisation of matrices in long form; zeros are absent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def seeded_rank(seed: int, key: str) -> list[Column]:
    """A stable random order: md5 of seed and key, then the key."""
    return [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)]


# filters -----------------------------------------------------------------------------------------------------------


def cells_with_features(counts: DataFrame, min_genes: int = 200) -> DataFrame:
    """Rows of cells that have at least ``min_genes`` non-zero genes."""
    good = counts.groupBy("dataset_id", "cell_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_genes)
    return counts.join(good.select("dataset_id", "cell_id"), ["dataset_id", "cell_id"], "left_semi")


def genes_in_all(counts: DataFrame, min_counts: float = 3) -> DataFrame:
    """Rows of genes whose counts sum to at least ``min_counts`` in every dataset."""
    per = counts.groupBy("dataset_id", "gene_id").agg(F.sum("x").alias("s")).where(F.col("s") >= min_counts)
    n = counts.select("dataset_id").distinct().agg(F.count("*").alias("n_datasets"))
    # one row of one number: safe to broadcast
    good = per.groupBy("gene_id").agg(F.count("*").alias("n")).join(F.broadcast(n)).where("n = n_datasets").select("gene_id")
    return counts.join(good, "gene_id", "left_semi").select("dataset_id", "cell_id", "gene_id", "x")


def basic_filter(counts: DataFrame, min_genes: int = 200, min_counts: float = 3) -> DataFrame:
    """Cells first, then genes over the cells that are left."""
    return genes_in_all(cells_with_features(counts, min_genes), min_counts)


def filter_report(before: DataFrame, after: DataFrame, min_cells: int = 200, min_genes: int = 4000) -> DataFrame:
    """Per dataset: cells and genes before and after, and whether little is left."""
    count = lambda df, tag: df.groupBy("dataset_id").agg(F.count_distinct("cell_id").alias(f"cells_{tag}"), F.count_distinct("gene_id").alias(f"genes_{tag}"))
    both = count(before, "before").join(count(after, "after"), "dataset_id", "left").na.fill(0)
    return both.withColumn("suspicious", (F.col("cells_after") < min_cells) | (F.col("genes_after") < min_genes) | (2 * F.col("cells_after") < F.col("cells_before")))


def low_share_cells(counts: DataFrame, feature: Column, max_share: float = 0.05) -> DataFrame:
    """Rows of cells whose share of counts in the flagged features is below the bound."""
    share = counts.groupBy("dataset_id", "cell_id").agg((F.sum(F.when(feature, F.col("x")).otherwise(0.0)) / F.sum("x")).alias("share"))
    return counts.join(share.where(F.col("share") < max_share).drop("share"), ["dataset_id", "cell_id"], "left_semi")


def drop_unlabelled(obs: DataFrame, unknown: int = -1) -> DataFrame:
    return obs.where(F.col("label").isNotNull() & (F.col("label") != unknown))


def subsample(obs: DataFrame, amount: float | None, seed: int = 0) -> DataFrame:
    """None or 0: all rows; below 1: that share of each dataset; else that many rows of each dataset."""
    if not amount:
        return obs
    rank = F.row_number().over(Window.partitionBy("dataset_id").orderBy(*seeded_rank(seed, "cell_id")))
    if amount >= 1:
        return obs.withColumn("__r", rank).where(F.col("__r") <= int(amount)).drop("__r")
    n = obs.groupBy("dataset_id").agg(F.floor(F.count("*") * amount).alias("__n"))
    return obs.withColumn("__r", rank).join(n, "dataset_id").where("__r <= __n").drop("__r", "__n")


def make_even(obs: DataFrame, seed: int = 0) -> DataFrame:
    """Every dataset cut to the size of the smallest one by the seeded order."""
    least = obs.groupBy("dataset_id").agg(F.count("*").alias("n")).agg(F.min("n").alias("__n"))
    rank = F.row_number().over(Window.partitionBy("dataset_id").orderBy(*seeded_rank(seed, "cell_id")))
    return obs.withColumn("__r", rank).join(F.broadcast(least)).where("__r <= __n").drop("__r", "__n")


def preselected(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """Rows of a given gene list."""
    return counts.join(genes.select("gene_id").distinct(), "gene_id", "left_semi").select("dataset_id", "cell_id", "gene_id", "x")


def dataset_stats(counts: DataFrame, obs: DataFrame, many: int = 1000) -> DataFrame:
    """Per dataset: cells with more than ``many`` genes, labelled cells, seen genes, mean counts per cell."""
    cells = counts.groupBy("dataset_id", "cell_id").agg(F.count("*").alias("genes"), F.sum("x").alias("reads"))
    a = cells.groupBy("dataset_id").agg(F.count_if(F.col("genes") > many).alias("rich_cells"), F.avg("reads").alias("mean_reads"))
    b = counts.groupBy("dataset_id").agg(F.count_distinct("gene_id").alias("genes"))
    c = obs.groupBy("dataset_id").agg(F.count("label").alias("labelled"))
    return a.join(b, "dataset_id").join(c, "dataset_id")


def classes_with_members(catalog: DataFrame, least: int = 4) -> DataFrame:
    """Datasets whose class has at least ``least`` members."""
    return catalog.withColumn("members", F.count("*").over(Window.partitionBy("class"))).where(F.col("members") >= least)


# normalisation -----------------------------------------------------------------------------------------------------


def normalize_total(counts: DataFrame, target: float = 1e4) -> DataFrame:
    """Counts scaled so that each cell sums to the target."""
    total = counts.groupBy("dataset_id", "cell_id").agg(F.sum("x").alias("__t"))
    return counts.join(total, ["dataset_id", "cell_id"]).withColumn("x", F.col("x") * target / F.col("__t")).drop("__t")


def log1p(counts: DataFrame) -> DataFrame:
    return counts.withColumn("x", F.log1p("x"))


def normlog(counts: DataFrame, target: float = 1e4) -> DataFrame:
    return log1p(normalize_total(counts, target))


def cell_numbers(counts: DataFrame) -> DataFrame:
    """(dataset_id, n_cells): cells with any count."""
    return counts.groupBy("dataset_id").agg(F.count_distinct("cell_id").alias("n_cells"))


def scale_clip(counts: DataFrame, n_cells: DataFrame, limit: float = 10.0) -> DataFrame:
    """Per gene over all datasets: divide by the sample standard deviation (zeros counted), clip; no centring."""
    n = n_cells.agg(F.sum("n_cells").alias("__n"))
    s = counts.groupBy("gene_id").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).join(F.broadcast(n))
    sd = s.select("gene_id", F.sqrt((F.col("q") - F.col("s") * F.col("s") / F.col("__n")) / (F.col("__n") - 1)).alias("sd"))
    out = counts.join(sd, "gene_id")
    return out.withColumn("x", F.when(F.col("sd") > 0, F.least(F.col("x") / F.col("sd"), F.lit(limit))).otherwise(F.col("x"))).select("dataset_id", "cell_id", "gene_id", "x")


def standardise(points: DataFrame) -> DataFrame:
    """Centre and scale every dimension over all datasets (population deviation; constant dimensions become 0)."""
    long = points.select("dataset_id", "cell_id", F.posexplode("vec").alias("dim", "v"))
    m = long.groupBy("dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    z = long.join(F.broadcast(m), "dim").withColumn("z", F.when(F.col("s") > 0, (F.col("v") - F.col("m")) / F.col("s")).otherwise(0.0))
    return z.groupBy("dataset_id", "cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "z"))), lambda x: x["z"]).alias("vec"))


def regression_lines(counts: DataFrame, depth: DataFrame) -> DataFrame:
    """(gene_id, slope, intercept, n_zero, zero_residuals): each gene's values regressed on the depth of all cells, zeros included.

    Only stored entries are read: the zero cells enter through the number of cells, the sum of depths and that of their squares.
    """
    d = depth.agg(F.count("*").alias("n"), F.sum("depth").alias("sd"), F.sum(F.col("depth") * F.col("depth")).alias("sdd"))
    g = counts.join(depth, ["dataset_id", "cell_id"]).groupBy("gene_id").agg(
        F.count("*").alias("k"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("depth")).alias("sxd"), F.sum("depth").alias("kd")).join(F.broadcast(d))
    spread = F.col("n") * F.col("sdd") - F.col("sd") * F.col("sd")
    slope = F.when(spread > 0, (F.col("n") * F.col("sxd") - F.col("sx") * F.col("sd")) / spread).otherwise(0.0)
    out = g.withColumn("slope", slope).withColumn("intercept", (F.col("sx") - F.col("slope") * F.col("sd")) / F.col("n")).withColumn("n_zero", F.col("n") - F.col("k"))
    return out.select("gene_id", "slope", "intercept", "n_zero", (-F.col("slope") * (F.col("sd") - F.col("kd")) - F.col("intercept") * F.col("n_zero")).alias("zero_residuals"))


def regress_out(counts: DataFrame, depth: DataFrame) -> DataFrame:
    """Residuals of the stored entries on the cells' depth; a zero cell's residual is minus its gene's line (``regression_lines``)."""
    both = counts.join(depth, ["dataset_id", "cell_id"]).join(regression_lines(counts, depth), "gene_id")
    return both.withColumn("residual", F.col("x") - F.col("slope") * F.col("depth") - F.col("intercept")).select("dataset_id", "cell_id", "gene_id", "residual")


def min_max(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Values moved to 0..1 within groups."""
    w = Window.partitionBy(*by)
    return df.withColumn(value, (F.col(value) - F.min(value).over(w)) / (F.max(value).over(w) - F.min(value).over(w)))
