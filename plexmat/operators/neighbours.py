"""Neighbour graphs over ordered slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plexmat.operators.distance import knn


def slice_graph(points: DataFrame, k_neighbours: int = 6, k_same: int = 16, metric: str = "euclidean") -> DataFrame:
    """(src_slice, src, dst_slice, dst, dist, rank): neighbours in the own and the adjacent slices.

    The first and the last slice take twice as many neighbours from their only adjacent slice. Adjacent slices meet by an
    equi-join on the pair of slices.
    """
    slices = points.select(F.col("dataset_id").alias("s")).distinct().agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    own = points.select(F.col("dataset_id").alias("src_slice"), F.col("dataset_id").alias("dst_slice"), "cell_id", "vec")
    intra = knn(own, own, k_same, metric, ["src_slice", "dst_slice"], exclude_self=True)
    from_a = points.select(F.col("dataset_id").alias("src_slice"), F.explode(F.array(F.col("dataset_id") - 1, F.col("dataset_id") + 1)).alias("dst_slice"), "cell_id", "vec")
    to_b = points.select(F.explode(F.array(F.col("dataset_id") - 1, F.col("dataset_id") + 1)).alias("src_slice"), F.col("dataset_id").alias("dst_slice"), "cell_id", "vec")
    inter = knn(from_a, to_b, 2 * k_neighbours, metric, ["src_slice", "dst_slice"]).join(F.broadcast(slices))
    edge = (F.col("src_slice") == F.col("lo")) | (F.col("src_slice") == F.col("hi"))
    inter = inter.where(F.col("rank") <= F.when(edge, 2 * k_neighbours).otherwise(k_neighbours)).drop("lo", "hi")
    return intra.unionByName(inter).select("src_slice", "src", "dst_slice", "dst", "dist", "rank")


def far_penalty(edges: DataFrame, penalty: float = 2.0) -> DataFrame:
    """Distances between slices multiplied by penalty ^ (gap - 1)."""
    gap = F.abs(F.col("src_slice") - F.col("dst_slice"))
    return edges.withColumn("dist", F.when(gap > 0, F.col("dist") * F.pow(F.lit(penalty), gap - 1)).otherwise(F.col("dist")))


def adjust_distances(edges: DataFrame, how: str = "max", coefficient: float = 1.0) -> DataFrame:
    """Re-map the distances between slices.

    max, median, 3quartile: the statistic of the source slice's inner distances; normMeans: scale each row's mean to its inner
    mean; firstKMeans, lastKMeans: the mean inner distance of the same rank, from the front or the back; euclidean: multiply only.
    """
    intra, inter = edges.where("src_slice = dst_slice"), edges.where("src_slice <> dst_slice")
    statistics = {"max": F.max("dist"), "median": F.median("dist"), "3quartile": F.percentile("dist", F.lit(0.75))}
    if how == "euclidean":
        moved = inter.withColumn("dist", F.col("dist") * coefficient)
    elif how in statistics:
        per = intra.groupBy("src_slice").agg(statistics[how].alias("s"))
        moved = inter.join(F.broadcast(per), "src_slice").withColumn("dist", F.col("s") * coefficient).drop("s")
    elif how == "normMeans":
        own = intra.groupBy("src_slice", "src").agg(F.avg("dist").alias("own"))
        mean = F.avg("dist").over(Window.partitionBy("src_slice", "src", "dst_slice"))
        moved = inter.withColumn("m", mean).join(own, ["src_slice", "src"]).withColumn(
            "dist", F.when(F.col("m") > 0, F.col("dist") * F.col("own") / F.col("m")).otherwise(0.0) * coefficient).drop("m", "own")
    elif how in ("firstKMeans", "lastKMeans"):
        rank = F.col("rank") if how == "firstKMeans" else F.max("rank").over(Window.partitionBy("src_slice", "src")) - F.col("rank") + 1
        per = intra.withColumn("r", rank).groupBy("src_slice", "r").agg(F.avg("dist").alias("s"))
        moved = inter.withColumn("r", F.col("rank")).join(F.broadcast(per), ["src_slice", "r"]).withColumn("dist", F.col("s") * coefficient).drop("s", "r")
    else:
        raise ValueError(f"unknown re-mapping {how!r}")
    return intra.unionByName(moved.select(*intra.columns))


def sorted_neighbours(edges: DataFrame) -> DataFrame:
    """(src, neighbours): each source's neighbours by distance, then id."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dist", "dst"))).alias("n")).select(
        "src", F.transform("n", lambda x: x["dst"]).alias("dst"), F.transform("n", lambda x: x["dist"]).alias("dist"))


def padded_neighbours(lists: DataFrame) -> DataFrame:
    """Lists made equally long by repeating the farthest neighbour."""
    longest = lists.agg(F.max(F.size("dst")).alias("w"))
    pad = lambda c: F.concat(c, F.array_repeat(F.element_at(c, -1), F.col("w") - F.size(c)))
    return lists.join(F.broadcast(longest)).select("src", pad(F.col("dst")).alias("dst"), pad(F.col("dist")).alias("dist"))
