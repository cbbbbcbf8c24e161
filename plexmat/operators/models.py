"""Fitted models on point sets: joint PCA, Gaussian mixtures and k-means through Spark ML, and joint EM over datasets.

Sufficient statistics are summed on Spark; only parameters (clusters x dimensions) reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from plexmat.session import materialize


def _with_vectors(points: DataFrame) -> DataFrame:
    return points.withColumn("features", array_to_vector("vec"))


def centred(points: DataFrame) -> DataFrame:
    """Points with the joint mean taken off."""
    long = points.select("dataset_id", "cell_id", F.posexplode("vec").alias("dim", "v"))
    mean = long.groupBy("dim").agg(F.avg("v").alias("m"))
    mean = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda x: x["m"]).alias("mean"))
    return points.join(F.broadcast(mean)).withColumn("vec", F.zip_with("vec", "mean", lambda x, m: x - m)).drop("mean")


def joint_pca(points: DataFrame, k: int) -> DataFrame:
    """Points of all datasets on the first k components of their union; signs make each component's largest loading positive."""
    c = _with_vectors(centred(points))
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(c)
    w = model.pc.toArray()
    sign = np.sign(w[np.abs(w).argmax(axis=0), np.arange(w.shape[1])])
    signs = F.array(*(F.lit(float(s)) for s in sign))
    return model.transform(c).select("dataset_id", "cell_id", F.zip_with(vector_to_array("pc"), signs, lambda x, s: x * s).alias("vec"))


def separate_pca(points: DataFrame, k: int) -> DataFrame:
    """The same with one model per dataset."""
    ids = [r.dataset_id for r in points.select("dataset_id").distinct().orderBy("dataset_id").collect()]
    parts = [joint_pca(points.where(F.col("dataset_id") == i), k) for i in ids]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def explained_variance(points: DataFrame, k: int) -> DataFrame:
    """(component, ratio, cumulative) of the joint components."""
    c = _with_vectors(centred(points))
    ratio = PCA(k=k, inputCol="features", outputCol="pc").fit(c).explainedVariance.toArray()
    rows = [(i + 1, float(x), float(s)) for i, (x, s) in enumerate(zip(ratio, np.cumsum(ratio), strict=True))]
    return points.sparkSession.createDataFrame(rows, "component int, ratio double, cumulative double")


def gaussian_mixture(points: DataFrame, k: int, seed: int = 1, rounds: int = 50) -> DataFrame:
    """(dataset_id, cell_id, cluster) of a full-covariance mixture over the union."""
    model = GaussianMixture(k=k, seed=seed, maxIter=rounds).fit(_with_vectors(points))
    return model.transform(_with_vectors(points)).select("dataset_id", "cell_id", F.col("prediction").cast("int").alias("cluster"))


def mixture_curve(points: DataFrame, sizes: list[int], seed: int = 1, rounds: int = 30) -> DataFrame:
    """(k, loglik, aic, bic, n) of mixtures of several sizes."""
    data = _with_vectors(points).cache()
    n, d = data.count(), len(data.first().vec)
    rows = []
    for k in sizes:
        loglik = float(GaussianMixture(k=k, seed=seed, maxIter=rounds).fit(data).summary.logLikelihood)
        free = k - 1 + k * d + k * d * (d + 1) / 2
        rows.append((k, loglik, 2 * free - 2 * loglik, free * float(np.log(n)) - 2 * loglik, n))
    data.unpersist()
    return points.sparkSession.createDataFrame(rows, "k int, loglik double, aic double, bic double, n long")


def kmeans(points: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """(dataset_id, cell_id, cluster) of k-means over the union."""
    v = _with_vectors(points)
    return KMeans(k=k, seed=seed, maxIter=200, tol=1e-9).fit(v).transform(v).select("dataset_id", "cell_id", F.col("prediction").cast("int").alias("cluster"))


def bisecting_kmeans(points: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """A hierarchical summary clustering (in the place of a CF tree)."""
    v = _with_vectors(points)
    return BisectingKMeans(k=k, seed=seed, maxIter=200).fit(v).transform(v).select("dataset_id", "cell_id", F.col("prediction").cast("int").alias("cluster"))


def _moments(own: DataFrame, weights: str) -> pd.DataFrame:
    """Per (dataset, label): weight, weighted sums and cross products, as one array each, summed on Spark."""
    stats = own.withColumn("w", F.col(weights))
    first = stats.select("dataset_id", "label", "w", F.posexplode("vec").alias("i", "x")).groupBy("dataset_id", "label", "i").agg(F.sum(F.col("w") * F.col("x")).alias("s"), F.sum("w").alias("w"))
    cross = (
        stats.select("dataset_id", "label", "w", "vec", F.posexplode("vec").alias("i", "x"))
        .select("dataset_id", "label", "i", "w", "x", F.posexplode("vec").alias("j", "y")).where("j >= i")
        .groupBy("dataset_id", "label", "i", "j").agg(F.sum(F.col("w") * F.col("x") * F.col("y")).alias("q"))
    )
    return first.toPandas(), cross.toPandas()


def joint_em(points: DataFrame, labels: DataFrame, rounds: int = 100, ridge: float = 1e-6) -> DataFrame:
    """(pos, label, agree): labels shared over aligned datasets.

    Per dataset and label a Gaussian is fitted to the hard labels; the log densities of a position are summed over datasets and the best
    label wins, until no label changes. ``points`` is (dataset_id, pos, vec), ``labels`` (pos, label); agree says
    whether every dataset alone prefers the winner.
    """
    current = materialize(labels.select("pos", "label"), "em")
    for _ in range(rounds):
        own = points.join(current, "pos").withColumn("one", F.lit(1.0))
        first, cross = _moments(own, "one")
        params = {}
        for (ds, label), g in first.groupby(["dataset_id", "label"]):
            g = g.sort_values("i")
            n, mean = g.w.iloc[0], (g.s / g.w).to_numpy()
            q = cross[(cross.dataset_id == ds) & (cross.label == label)]
            cov = np.zeros((len(mean), len(mean)))
            cov[q.i, q.j] = cov[q.j, q.i] = q.q / n
            cov += ridge * np.eye(len(mean)) - np.outer(mean, mean)
            values, vectors = np.linalg.eigh(cov)
            values = np.maximum(values, ridge)
            params.setdefault(ds, {})[int(label)] = (mean, vectors / np.sqrt(values), -0.5 * np.log(values).sum() + np.log(n))
        names = sorted({l for p in params.values() for l in p})

        def densities(batches, params=params, names=names):
            for pdf in batches:
                out = np.full((len(pdf), len(names)), -np.inf)
                x = np.array(pdf.vec.tolist()) if len(pdf) else np.zeros((0, 0))
                for ds, rows in pdf.groupby("dataset_id").indices.items():
                    for c, name in enumerate(names):
                        if name in params.get(ds, {}):
                            mean, white, const = params[ds][name]
                            out[rows, c] = const - 0.5 * (((x[rows] - mean) @ white) ** 2).sum(axis=1)
                yield pd.DataFrame({"pos": pdf.pos, "dataset_id": pdf.dataset_id, "logp": list(out)})

        kind = points.schema["dataset_id"].dataType.simpleString()
        scored = points.select("pos", "dataset_id", "vec").mapInPandas(densities, f"pos long, dataset_id {kind}, logp array<double>")
        long = scored.select("pos", "dataset_id", F.posexplode("logp").alias("c", "p"))
        best = long.groupBy("pos", "c").agg(F.sum("p").alias("p")).groupBy("pos").agg(F.max_by("c", F.struct("p", -F.col("c"))).alias("c"))
        alone = long.groupBy("pos", "dataset_id").agg(F.max_by("c", F.struct("p", -F.col("c"))).alias("own")).groupBy("pos").agg(F.min("own").alias("lo"), F.max("own").alias("hi"))
        code = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (i, n)))
        new = materialize(best.join(alone, "pos").select("pos", code[F.col("c")].cast(IntegerType()).alias("label"), ((F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("c"))).alias("agree")), "em")
        if new.join(current.withColumnRenamed("label", "old"), "pos").where("label <> old").limit(1).count() == 0:
            return new
        current = new.select("pos", "label")
    raise RuntimeError(f"labels still change after {rounds} rounds")
