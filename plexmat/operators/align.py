"""Cluster correspondence across datasets: canvases of matched pairs, cleaning, confusion, renaming, lineages in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def canvas(match: DataFrame, labels_a: DataFrame, labels_b: DataFrame, normalize: bool = True, max_err: float = 0.0, spread: bool = False) -> DataFrame:
    """(label_a, label_b, n, n_a, n_b, w) of matched pairs (cell_a, cell_b, dist).

    w is -2n / (n_a + n_b), or -n; with ``spread`` it is weighted by 1 - var(d) / mean(d)^2; weights above -max_err are dropped.
    """
    a = labels_a.select(F.col("cell_id").alias("cell_a"), F.col("label").alias("label_a"))
    b = labels_b.select(F.col("cell_id").alias("cell_b"), F.col("label").alias("label_b"))
    cells = match.join(a, "cell_a").join(b, "cell_b").groupBy("label_a", "label_b").agg(
        F.count("*").alias("n"), (1 - F.var_pop("dist") / F.pow(F.avg("dist"), 2)).alias("spread"))
    sizes = lambda df, c: df.groupBy(c).agg(F.count("*").alias(f"n_{c[-1]}"))
    j = cells.join(F.broadcast(sizes(a, "label_a")), "label_a").join(F.broadcast(sizes(b, "label_b")), "label_b")
    w = -2.0 * F.col("n") / (F.col("n_a") + F.col("n_b")) if normalize else -F.col("n").cast("double")
    w = w * F.coalesce(F.col("spread"), F.lit(1.0)) if spread else w
    out = j.select("label_a", "label_b", "n", "n_a", "n_b", w.alias("w"))
    return out.where(F.col("w") < -max_err) if max_err else out


def clean(canvas_df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Cells that are neither optimum of their row nor of their column become 0, and so do cells below the threshold in both shares."""
    row, col = Window.partitionBy("label_a"), Window.partitionBy("label_b")
    no_optimum = (F.col("w") > F.min("w").over(row)) & (F.col("w") > F.min("w").over(col))
    little = (F.col("w") / F.sum("w").over(row) < threshold) & (F.col("w") / F.sum("w").over(col) < threshold)
    return canvas_df.withColumn("cleaned", F.when(no_optimum | little, 0.0).otherwise(F.col("w")))


def rename_shared(labels_a: DataFrame, labels_b: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shared ids for matched labels, fresh ids after them for all others: (old, new) for each side.

    ``pairs`` is (label_a, label_b), one to one.
    """
    order = Window.orderBy("label_a", "label_b")  # as many rows as there are clusters
    shared = pairs.select("label_a", "label_b", (F.row_number().over(order) - 1).cast("int").alias("new"))
    n = shared.agg(F.count("*").alias("n"))
    side = lambda df, c: df.select(F.col("label").alias(c)).distinct()
    rest_a = side(labels_a, "label_a").join(shared, "label_a", "left_anti")
    rest_b = side(labels_b, "label_b").join(shared, "label_b", "left_anti")
    fresh_a = rest_a.join(F.broadcast(n)).select(F.col("label_a").alias("old"), (F.col("n") + F.row_number().over(Window.orderBy("label_a")) - 1).cast("int").alias("new"))
    n2 = fresh_a.agg(F.count("*").alias("m")).join(n).select((F.col("n") + F.col("m")).alias("n"))
    fresh_b = rest_b.join(F.broadcast(n2)).select(F.col("label_b").alias("old"), (F.col("n") + F.row_number().over(Window.orderBy("label_b")) - 1).cast("int").alias("new"))
    return shared.select(F.col("label_a").alias("old"), "new").unionByName(fresh_a), shared.select(F.col("label_b").alias("old"), "new").unionByName(fresh_b)


def rename_log(labels_a: DataFrame, labels_b: DataFrame, pairs: DataFrame) -> DataFrame:
    """(side, old, new, shared, n): what ``rename_shared`` makes of every label of both sides, and how many cells carry it."""
    out = None
    for side, (labels, names, own) in enumerate(zip((labels_a, labels_b), rename_shared(labels_a, labels_b, pairs), ("label_a", "label_b"), strict=True)):
        n = labels.groupBy(F.col("label").alias("old")).agg(F.count("*").alias("n"))
        both = pairs.select(F.col(own).alias("old"), F.lit(True).alias("paired"))
        rows = names.join(n, "old").join(both, "old", "left").select(F.lit(side).alias("side"), "old", "new", F.coalesce("paired", F.lit(False)).alias("shared"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def match_report(canvas_df: DataFrame) -> DataFrame:
    """Per pair of labels: sizes, matches and their share of the smaller cluster."""
    return canvas_df.select("label_a", "label_b", "n_a", "n_b", "n", (F.col("n") / F.least("n_a", "n_b")).alias("ratio"))


def confusion(labels: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, dice): co-occurrence counts and 2n / (n_a + n_b)."""
    c = labels.groupBy(a, b).agg(F.count("*").alias("n"))
    na, nb = F.sum("n").over(Window.partitionBy(a)), F.sum("n").over(Window.partitionBy(b))
    return c.withColumn("dice", 2.0 * F.col("n") / (na + nb))


def joint_labels(frames: list[DataFrame]) -> DataFrame:
    """(label, code): one dense dictionary over all label columns."""
    out = frames[0].select("label")
    for f in frames[1:]:
        out = out.union(f.select("label"))
    return out.distinct().withColumn("code", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("int"))


def must_links(match: DataFrame, labels: DataFrame, share: float = 0.5) -> DataFrame:
    """The closest share of each class's matches: (label, cell_a, cell_b, dist)."""
    j = match.join(labels.select(F.col("cell_id").alias("cell_a"), "label"), "cell_a")
    w = Window.partitionBy("label")
    r = F.row_number().over(w.orderBy("dist", "cell_a"))
    return j.withColumn("r", r).withColumn("m", F.floor(F.count("*").over(w) * share)).where("r <= m").select("label", "cell_a", "cell_b", "dist")


# lineages in time -------------------------------------------------------------------------------------------------------


def unique_over_slices(labels: DataFrame) -> DataFrame:
    """Labels shifted so that no two slices share one: each slice starts after the largest of the one before."""
    per = labels.groupBy("dataset_id").agg((F.max("label") + 1).alias("width"))
    before = Window.orderBy("dataset_id").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    offset = per.select("dataset_id", F.coalesce(F.sum("width").over(before), F.lit(0)).cast("int").alias("offset"))
    return labels.join(F.broadcast(offset), "dataset_id").withColumn("label", F.col("label") + F.col("offset")).drop("offset")


def compact(labels: DataFrame) -> DataFrame:
    """Labels renumbered 0..n-1 over all slices."""
    codes = labels.select("label").distinct().withColumn("compact", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("int"))
    return labels.join(F.broadcast(codes), "label")


def small_slices(labels: DataFrame, least: int) -> DataFrame:
    """(dataset_id, smallest, below): whether a slice has a cluster below the size."""
    n = labels.groupBy("dataset_id", "label").agg(F.count("*").alias("n"))
    return n.groupBy("dataset_id").agg(F.min("n").alias("smallest"), (F.min("n") < least).alias("below"))


#: Model-size rules over a curve of (k, aic, bic, n): what is minimised.
RULES = ("BIC", "AIC", "AdjBIC", "AdjAIC", "BICSlope", "AICSlope", "uberAIC")


def choose_size(curve: DataFrame, rule: str = "uberAIC", penalty: float = 10.0, by: list[str] = ()) -> DataFrame:
    """(by..., k): the model size that a rule picks; unknown rules are refused."""
    k, n = F.col("k"), F.log("n")
    w = Window.partitionBy(*by).orderBy("k")
    values = {
        "BIC": F.col("bic") - k * n + k * n / F.log(F.lit(penalty)), "AIC": F.col("aic"), "AdjBIC": F.col("bic") + 3 * k * n, "AdjAIC": F.col("aic") + 3 * k * n,
        "BICSlope": -F.lead("bic").over(w) / F.col("bic"), "AICSlope": -F.lead("aic").over(w) / F.col("aic"),
    }
    if rule == "uberAIC":
        return diagonal_knee(curve.withColumnRenamed("k", "x").withColumn("y", F.col("aic")), by).withColumnRenamed("x", "k").select(*by, "k")
    if rule not in values:
        raise ValueError(f"unknown rule {rule!r}; one of {RULES}")
    scored = curve.withColumn("value", values[rule]).where("value IS NOT NULL")
    best = F.min_by("k", F.struct("value", "k")).alias("k")
    return scored.groupBy(*by).agg(best) if by else scored.agg(best)


def diagonal_knee(curve: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by..., x, y, chord): the point of (x, y) with the largest |y * distance to the chord from first to last|."""
    w = Window.partitionBy(*by).orderBy("x").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x1, y1, x2, y2 = F.first("x").over(w), F.first("y").over(w), F.last("x").over(w), F.last("y").over(w)
    dx, dy = x2 - x1, y2 - y1
    chord = (dy * F.col("x") - dx * F.col("y") + x2 * y1 - y2 * x1) / F.sqrt(dx * dx + dy * dy)
    scored = curve.withColumn("chord", chord)
    best = F.max_by(F.struct("x", "y", "chord"), F.struct(F.abs(F.col("y") * F.col("chord")), -F.col("x"))).alias("b")
    return (scored.groupBy(*by).agg(best) if by else scored.agg(best)).select(*by, "b.x", "b.y", "b.chord")


def trace(lineage: DataFrame, start: int) -> DataFrame:
    """(slice, label): clusters that descend from a cluster of the first slice; ``lineage`` is (slice, parent, child)."""
    first = lineage.agg(F.min("slice")).first()[0]
    last = lineage.agg(F.max("slice")).first()[0]
    spark = lineage.sparkSession
    at = spark.createDataFrame([(first, start)], "slice int, label int")
    out = at
    for s in range(first or 0, (last or -1) + 1):  # as many steps as there are slices
        at = lineage.where(F.col("slice") == s).join(F.broadcast(at.withColumnRenamed("label", "parent").drop("slice")), "parent").select(
            (F.col("slice") + 1).alias("slice"), F.col("child").alias("label")).distinct()
        out = out.unionByName(at)
    return out


def order_score(affinity: DataFrame) -> DataFrame:
    """(slice_a, violations): how often similarity does not fall with the gap in time; ``affinity`` is (ds_a, ds_b, value), both ways."""
    gap = F.abs(F.col("ds_a") - F.col("ds_b"))
    w = Window.partitionBy("ds_a").orderBy(F.desc("value"), "ds_b")
    r = affinity.where("ds_a <> ds_b").withColumn("gap", gap).withColumn("before", F.lag("gap").over(w))
    return r.groupBy("ds_a").agg(F.count_if(F.col("before") > F.col("gap")).alias("violations"), F.count("*").alias("n"))


def flows(labels: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, matches) in falling order of matches: the table behind a flow diagram."""
    return labels.groupBy(a, b).agg(F.count("*").alias("matches")).orderBy(F.desc("matches"), a, b)


def set_regions(sets: DataFrame) -> DataFrame:
    """(members, n): how many items lie in exactly these sets; ``sets`` is (set_id, item)."""
    per = sets.groupBy("item").agg(F.array_join(F.array_sort(F.collect_set(F.col("set_id").cast("string"))), "+").alias("members"))
    return per.groupBy("members").agg(F.count("*").alias("n"))


def quartiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, low, q1, median, q3, high): the table behind a box plot."""
    p = lambda q: F.percentile(value, F.lit(q))
    return df.groupBy(by).agg(F.min(value).alias("low"), p(0.25).alias("q1"), F.median(value).alias("median"), p(0.75).alias("q3"), F.max(value).alias("high"))
