"""Gene scoring and selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plexmat.operators.preprocess import basic_filter, cell_numbers, normlog


def dispersion(logged: DataFrame, n_cells: DataFrame) -> DataFrame:
    """(dataset_id, gene_id, mean, var, x, y): y = ln(var / mean), x = ln(1 + mean) of expm1 values, zeros counted.

    Genes without variance have no finite score and are left out.
    """
    raw = logged.withColumn("v", F.expm1("x"))
    s = raw.groupBy("dataset_id", "gene_id").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).join(F.broadcast(n_cells), "dataset_id")
    m = s.select("dataset_id", "gene_id", (F.col("s") / F.col("n_cells")).alias("mean"), (F.col("q") / F.col("n_cells")).alias("q2"))
    v = m.withColumn("var", F.col("q2") - F.col("mean") * F.col("mean")).where("mean > 0 AND var > 1e-12 * q2")
    return v.select("dataset_id", "gene_id", "mean", "var", F.log1p("mean").alias("x"), F.log(F.col("var") / F.col("mean")).alias("y"))


def in_range(scores: DataFrame, low: float = 0.015, high: float = 4.0) -> DataFrame:
    """Genes whose mean expression lies strictly inside the range."""
    return scores.where((F.col("x") > low) & (F.col("x") < high))


def bin_statistics(scores: DataFrame, step: float = 0.25, low: float = 0.25, high: float = 4.0) -> DataFrame:
    """Per dataset and bin of x (open on both sides): centre, median and population deviation of y, members."""
    b = F.floor((F.col("x") - low) / step)
    inside = scores.where((F.col("x") > low) & (F.col("x") < high) & (F.col("x") != low + b * step)).withColumn("bin", b.cast("int"))
    return inside.groupBy("dataset_id", "bin").agg(
        F.median("y").alias("median"), F.stddev_pop("y").alias("std"), F.count("*").alias("n")
    ).select("dataset_id", "bin", (low + F.col("bin") * step + step / 2).alias("centre"), "median", "std", "n")


def huber_line(x: np.ndarray, y: np.ndarray, epsilon: float = 1.35, rounds: int = 100) -> tuple[float, float]:
    """Slope and intercept of a robust line (iterated weights, scale by the median deviation)."""
    w = np.ones(len(x))
    slope = intercept = 0.0
    for _ in range(rounds):
        mx, my = np.average(x, weights=w), np.average(y, weights=w)
        d = (w * (x - mx) ** 2).sum()
        new = ((w * (x - mx) * (y - my)).sum() / d) if d > 0 else 0.0
        a = my - new * mx
        r = np.abs(y - new * x - a)
        scale = max(np.median(r) / 0.6745, 1e-9)
        w = np.where(r <= epsilon * scale, 1.0, epsilon * scale / np.maximum(r, 1e-12))
        if abs(new - slope) + abs(a - intercept) < 1e-12:
            break
        slope, intercept = new, a
    return slope, intercept


def expected_lines(bins: DataFrame) -> DataFrame:
    """Robust lines of median and deviation over the at most 15 bins of each dataset, and the first bin's values."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[np.isfinite(pdf["median"]) & np.isfinite(pdf["std"])].sort_values("centre")
        if not len(pdf):
            return pd.DataFrame()
        x = pdf.centre.to_numpy()
        (a, b), (c, d) = huber_line(x, pdf["median"].to_numpy()), huber_line(x, pdf["std"].to_numpy())
        first = pdf.iloc[0]
        return pd.DataFrame([{"dataset_id": first.dataset_id, "first_centre": first.centre, "first_median": first["median"], "first_std": first["std"],
                              "slope": a, "intercept": b, "std_slope": c, "std_intercept": d}])

    key = bins.schema["dataset_id"].dataType.simpleString()
    return bins.groupBy("dataset_id").applyInPandas(
        fit, f"dataset_id {key}, first_centre double, first_median double, first_std double, slope double, intercept double, std_slope double, std_intercept double")


def zscores(scores: DataFrame, lines: DataFrame) -> DataFrame:
    """Standardised dispersion; below the first bin's centre the larger of line and first bin counts."""
    s = scores.join(F.broadcast(lines), "dataset_id")
    line = F.col("slope") * F.col("x") + F.col("intercept")
    spread = F.col("std_slope") * F.col("x") + F.col("std_intercept")
    below = F.col("x") < F.col("first_centre")
    y = F.when(below, F.greatest(line, "first_median")).otherwise(line)
    sd = F.when(below, F.greatest(spread, "first_std")).otherwise(spread)
    return s.select("dataset_id", "gene_id", ((F.col("y") - y) / F.when(sd > 0, sd)).alias("score"))


def top_genes(scores: DataFrame, n: int, ties: bool = False) -> DataFrame:
    """The n best genes of each dataset; with ``ties`` all that reach the n-th score."""
    order = [F.desc_nulls_last("score")] if ties else [F.desc_nulls_last("score"), F.col("gene_id")]
    rank = (F.rank() if ties else F.row_number()).over(Window.partitionBy("dataset_id").orderBy(*order))
    return scores.withColumn("place", rank).where(F.col("place") <= n)


def annotated_scores(counts: DataFrame, min_genes: int = 200, min_counts: float = 3, normalise_first: bool = False) -> DataFrame:
    """Filter, normalise and score; ``normalise_first`` normalises over all genes before genes are dropped."""
    kept = basic_filter(counts, min_genes, min_counts)
    logged = normlog(counts).join(kept.select("dataset_id", "cell_id", "gene_id"), ["dataset_id", "cell_id", "gene_id"], "left_semi") if normalise_first else normlog(kept)
    return in_range(dispersion(logged, cell_numbers(kept)))


def hvg_seurat(logged: DataFrame, n_cells: DataFrame, bins: int = 20) -> DataFrame:
    """Normalised dispersion: z within equal-width bins of ln(1 + mean) (sample deviation; single members score 1)."""
    d = dispersion(logged, n_cells)
    r = d.groupBy("dataset_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    b = d.join(F.broadcast(r), "dataset_id").withColumn(
        "bin", F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0))
    w = Window.partitionBy("dataset_id", "bin")
    sd = F.stddev_samp("y").over(w)
    return b.withColumn("score", F.when(sd > 0, (F.col("y") - F.avg("y").over(w)) / sd).otherwise(1.0)).select("dataset_id", "gene_id", "bin", "score")


def hvg_cell_ranger(logged: DataFrame, n_cells: DataFrame, bins: int = 20) -> DataFrame:
    """Normalised dispersion: distance from the bin's median over its median absolute deviation; bins by rank of mean.

    Means are ranked by nine digits: sums of equal values may differ in the last place, and such ties go by gene.
    """
    d = dispersion(logged, n_cells).withColumn("disp", F.exp("y"))
    b = d.withColumn("bin", F.ntile(bins).over(Window.partitionBy("dataset_id").orderBy(F.round("mean", 9), "gene_id")))
    m = b.join(b.groupBy("dataset_id", "bin").agg(F.median("disp").alias("med")), ["dataset_id", "bin"])
    mad = m.groupBy("dataset_id", "bin").agg(F.median(F.abs(F.col("disp") - F.col("med"))).alias("mad"))
    return m.join(mad, ["dataset_id", "bin"]).select(
        "dataset_id", "gene_id", "bin", F.when(F.col("mad") > 0, (F.col("disp") - F.col("med")) / F.col("mad")).otherwise(0.0).alias("score"))


def between(scores: DataFrame, min_mean: float = 0.0125, max_mean: float = 3.0, min_disp: float = 0.5) -> DataFrame:
    """Threshold selection on mean and score."""
    return scores.where((F.col("x") > min_mean) & (F.col("x") < max_mean) & (F.col("score") > min_disp))


def union_of_top(scores: DataFrame, n: int) -> DataFrame:
    """gene_id of every gene among the n best of any dataset."""
    return top_genes(scores, n).select("gene_id").distinct()


def unioncut(counts: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """Counts of all datasets on the union of their best genes."""
    return counts.join(union_of_top(scores, n), "gene_id", "left_semi").select("dataset_id", "cell_id", "gene_id", "x")


def last_slice_scores(scores: DataFrame) -> DataFrame:
    """The scores of the last dataset for all of them."""
    last = scores.agg(F.max("dataset_id").alias("last"))
    return scores.join(F.broadcast(last), scores.dataset_id == last["last"]).select("gene_id", "score")


def overlap(scores: DataFrame, n: int) -> DataFrame:
    """(ds_a, ds_b, common): common genes of the n best of each pair of datasets."""
    t = top_genes(scores, n).select("dataset_id", "gene_id")
    a, b = t.withColumnRenamed("dataset_id", "ds_a"), t.withColumnRenamed("dataset_id", "ds_b")
    return a.join(b, "gene_id").where("ds_a <= ds_b").groupBy("ds_a", "ds_b").agg(F.count("*").alias("common"))


def reproducibility(scores: DataFrame, n: int, step: float = 0.5) -> DataFrame:
    """Per pair of datasets and bin of mean expression: share of a's best genes that b selects too."""
    t = top_genes(scores, n).select("dataset_id", "gene_id", F.floor(F.col("x") / step).cast("int").alias("bin"))
    b = t.select(F.col("dataset_id").alias("ds_b"), "gene_id", F.lit(1).alias("hit"))
    datasets = t.select(F.col("dataset_id").alias("ds_b")).distinct()
    a = t.withColumnRenamed("dataset_id", "ds_a").join(F.broadcast(datasets)).where("ds_a <> ds_b")
    return a.join(b, ["ds_b", "gene_id"], "left").groupBy("ds_a", "ds_b", "bin").agg(
        F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("share"), F.count("*").alias("n"))


def hvg_variance_stabilised(counts: DataFrame, n_cells: DataFrame) -> DataFrame:
    """(dataset_id, gene_id, score): variance of clipped standardised counts, raw counts in.

    The expected variance is a quadratic of log10 variance on log10 mean per dataset (one regression over all genes, from sums on Spark);
    standardised values are clipped at the square root of the number of cells, zeros included.
    """
    s = counts.groupBy("dataset_id", "gene_id").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("nnz"))
    m = s.join(F.broadcast(n_cells), "dataset_id").withColumn("mean", F.col("s") / F.col("n_cells")).withColumn(
        "var", (F.col("q") - F.col("s") * F.col("mean")) / (F.col("n_cells") - 1)).where("mean > 0 AND var > 0")
    m = m.withColumn("u", F.log10("mean")).withColumn("v", F.log10("var"))
    powers = [F.sum(F.pow("u", F.lit(i))).alias(f"u{i}") for i in range(5)] + [F.sum(F.pow("u", F.lit(i)) * F.col("v")).alias(f"v{i}") for i in range(3)]
    sums = m.groupBy("dataset_id").agg(*powers)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        a = np.array([[r[f"u{i + j}"] for j in range(3)] for i in range(3)], float)
        c = np.linalg.lstsq(a, np.array([r[f"v{i}"] for i in range(3)], float), rcond=None)[0]
        return pd.DataFrame([{"dataset_id": r.dataset_id, "c0": c[0], "c1": c[1], "c2": c[2]}])

    key = counts.schema["dataset_id"].dataType.simpleString()
    fit = sums.groupBy("dataset_id").applyInPandas(solve, f"dataset_id {key}, c0 double, c1 double, c2 double")
    e = m.join(F.broadcast(fit), "dataset_id").withColumn("sd", F.sqrt(F.pow(F.lit(10.0), F.col("c0") + F.col("c1") * F.col("u") + F.col("c2") * F.col("u") * F.col("u"))))
    z = F.least((F.col("x") - F.col("mean")) / F.col("sd"), F.sqrt("n_cells"))
    own = counts.join(e.select("dataset_id", "gene_id", "mean", "sd", "n_cells"), ["dataset_id", "gene_id"]).groupBy("dataset_id", "gene_id").agg(F.sum(z * z).alias("zz"))
    zero = F.pow(F.col("mean") / F.col("sd"), 2) * (F.col("n_cells") - F.col("nnz"))
    return e.join(own, ["dataset_id", "gene_id"]).select("dataset_id", "gene_id", ((F.col("zz") + zero) / (F.col("n_cells") - 1)).alias("score"))
