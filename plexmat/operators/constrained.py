"""Constrained k-means on Spark, for groups of any size.

Points that must go together form must-link groups (connected components), which move as one: a group's cost for a centre is the sum over its points. Groups
under cannot-links are decided in an order (most links first, then by a hash of the id): up to ``TOGETHER`` groups
that links join in one task, more of them in rounds, where every group decides whose predecessors among its cannot-link partners all have decided, and takes the cheapest centre that none of these has. That gives what deciding one group after the other in
that order gives, in as many rounds as the longest chain of predecessors, which is short under a random order. Centres are the means of their points; one without points is
placed on the point farthest from its own centre. All values of ``by`` run at once; what a task sees is rows, and k centres of its own ``by``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexmat.operators.components import connected_components
from plexmat.operators.distance import METRICS
from plexmat.session import materialize

MIX, MODULUS = 2654435761, 1 << 32
#: Must-link groups that cannot-links join, directly or not, up to which one task decides them.
TOGETHER = 100_000
#: Shares that the parts of linked groups are dealt into.
DEALS = 64


def _unsent(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the groups and is met in every round: never sent through the driver for a broadcast."""
    return df.hint("merge")


def mixed(x: int) -> int:
    """A fixed permutation of ids, for an order that doesn't follow them."""
    return (x % (1 << 31)) * MIX % MODULUS


def mixed_column(x: Column) -> Column:
    return F.pmod(F.pmod(x, F.lit(1 << 31)) * MIX, F.lit(MODULUS))


def _square(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def linked_groups(points: DataFrame, must: DataFrame, by: str) -> DataFrame:
    """(by, cell_id, vec, g): g is the smallest id of the must-link group."""
    own = points.select(by, "cell_id", "vec")
    at = own.select(by, "cell_id")
    links = must.select(by, "a", "b").join(at.withColumnRenamed("cell_id", "a"), [by, "a"]).join(at.withColumnRenamed("cell_id", "b"), [by, "b"])
    node = lambda x: F.to_json(F.struct(F.col(by).alias("s"), F.col(x).alias("i")))
    parts = connected_components(links.select(node("a").alias("a"), node("b").alias("b")), "a", "b")
    named = own.withColumn("node", node("cell_id")).join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    first = named.groupBy("part").agg(F.min("cell_id").alias("g"))
    return materialize(named.join(first, "part").select(by, "cell_id", "vec", "g"), "constrained-points")


def seeded(points: DataFrame, k: int, by: str, start: str, seed: int) -> DataFrame:
    """(by, centres): k points, drawn alike or by squared distance from those drawn before (a weighted draw by hash)."""
    luck = lambda i: F.log((F.pmod(F.xxhash64("cell_id", F.lit(seed), F.lit(i)), F.lit(1 << 30)) + 0.5) / float(1 << 30))
    if start == "random":
        place = Window.partitionBy(by).orderBy(F.desc(luck(0)), "cell_id")
        chosen = points.withColumn("r", F.row_number().over(place)).where(F.col("r") <= k).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("r", "vec"))).alias("c"))
        return materialize(chosen.select(by, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get("c", F.pmod(i, F.size("c")))["vec"]).alias("centres")), "constrained-centres")
    centres = materialize(points.groupBy(by).agg(F.max_by("vec", F.struct(luck(0), "cell_id")).alias("v")).select(by, F.array("v").alias("centres")), "constrained-centres")
    for i in range(1, k):
        w = F.array_min(F.transform("centres", lambda c: _square(F.col("vec"), c)))
        drawn = points.join(centres, by).withColumn("w", w)
        # a point on a centre is drawn only if all are
        best = drawn.groupBy(by).agg(F.max_by("vec", F.struct(F.col("w") > 0, F.when(F.col("w") > 0, luck(i) / F.col("w")).otherwise(luck(i)), "cell_id")).alias("v"))
        centres = materialize(centres.join(best, by).select(by, F.concat("centres", F.array("v")).alias("centres")), "constrained-centres")
    return centres


def assigned(points: DataFrame, before: DataFrame, centres: DataFrame, k: int, by: str, rounds: int) -> DataFrame:
    """(by, g, label): one decision of every must-link group; label is null where a group finds no centre left. ``before`` is (by, g, o): o decides before g."""
    cost = F.transform("centres", lambda c: _square(F.col("vec"), c))
    each = points.join(centres, by).select(by, "g", cost.alias("cost")).groupBy(by, "g").agg(F.array(*(F.sum(F.col("cost")[c]) for c in range(k))).alias("cost"))
    ranked = each.select(by, "g", F.transform(F.array_sort(F.transform("cost", lambda x, i: F.struct(x.alias("cost"), i.alias("c")))), lambda x: x["c"]).alias("choice"))
    ranked = materialize(ranked, "constrained-cost")
    waits = before.groupBy(by, "g").agg(F.count("*").alias("n_before"))
    open_ = materialize(ranked.join(_unsent(waits), [by, "g"], "left").fillna(0, ["n_before"]), "constrained-open")
    done = materialize(open_.where("n_before = 0").select(by, "g", F.col("choice")[0].alias("label")), "constrained-done")
    rest = open_.where("n_before > 0")
    for _ in range(rounds):
        if rest.isEmpty():
            return done
        met = before.join(_unsent(done.select(by, F.col("g").alias("o"), "label")), [by, "o"]).groupBy(by, "g").agg(F.count("*").alias("n"), F.collect_set("label").alias("taken"))  # at most k labels
        ready = rest.join(_unsent(met), [by, "g"]).where("n = n_before").select(by, "g", F.get(F.array_except("choice", "taken"), F.lit(0)).alias("label"))
        done = materialize(done.unionByName(ready), "constrained-done")
        rest = materialize(rest.join(_unsent(done.select(by, "g")), [by, "g"], "left_anti"), "constrained-open")
    raise RuntimeError(f"groups still wait for each other after {rounds} rounds")


def _costs(at: dict, k: int):
    """Squared distances of a vector to the centres of its own ``by``."""

    @F.pandas_udf("array<double>")
    def cost(own: pd.Series, vec: pd.Series) -> pd.Series:
        out = np.empty((len(vec), k))
        for value in own.unique():
            here = (own == value).to_numpy()
            out[here] = METRICS["sqeuclidean"](np.array(vec[here].tolist(), float), at[value])
        return pd.Series(list(out))

    return cost


def _deciding(by: str):
    """The groups that cannot-links join, decided one after the other: the cheapest centre that none before has."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, label = pdf.sort_values("place", ignore_index=True), {}
        for b, g, before, choice in zip(pdf[by], pdf.g, pdf.before, pdf.choice, strict=True):
            taken = {label.get((b, o), -1) for o in before}
            label[b, g] = next((int(c) for c in choice if c not in taken), -1)
        return pd.DataFrame({by: pdf[by], "g": pdf.g, "label": pd.Series([label[at] for at in zip(pdf[by], pdf.g, strict=True)], dtype="Int32").where(lambda x: x >= 0)})

    return run


def _linked(before: DataFrame, by: str) -> DataFrame:
    """(by, g, before, place, part, deal): of every group under cannot-links those that decide before it, its place in an order that keeps to that, and the groups it is joined with.

    ``deal`` takes many parts together: most hold few groups, and a task's call for each would cost more than its work.
    """
    node = lambda x: F.to_json(F.struct(F.col(by).alias("s"), F.col(x).alias("i")))
    parts = connected_components(before.select(node("g").alias("a"), node("o").alias("b")), "a", "b")
    degree = before.select(by, "g").unionByName(before.select(by, F.col("o").alias("g"))).groupBy(by, "g").agg(F.count("*").alias("degree"))
    own = before.groupBy(by, "g").agg(F.collect_list("o").alias("before"))
    all_ = degree.join(_unsent(own), [by, "g"], "left").withColumn("node", node("g")).join(_unsent(parts), "node").withColumnRenamed("component", "part")
    place = F.row_number().over(Window.partitionBy(by, "part").orderBy(F.desc("degree"), mixed_column(F.col("g")), "g"))
    return materialize(all_.select(by, "g", F.coalesce("before", F.array().cast("array<bigint>")).alias("before"), place.alias("place"), "part", F.pmod(F.xxhash64(by, "part"), F.lit(DEALS)).alias("deal")), "constrained-linked")


def decided(points: DataFrame, linked: DataFrame, at: dict, k: int, by: str) -> DataFrame:
    """(by, g, label) as ``assigned`` gives it, without rounds: groups that cannot-links join meet in a task."""
    each = points.select(by, "g", _costs(at, k)(by, "vec").alias("cost")).groupBy(by, "g").agg(F.array(*(F.sum(F.col("cost")[c]) for c in range(k))).alias("cost"))
    choice = F.transform(F.array_sort(F.transform("cost", lambda x, i: F.struct(x.alias("cost"), i.alias("c")))), lambda x: x["c"])
    ranked = materialize(each.select(by, "g", choice.alias("choice")).join(_unsent(linked), [by, "g"], "left"), "constrained-open")
    alone = ranked.where("part IS NULL").select(by, "g", F.col("choice")[0].cast("int").alias("label"))
    schema = f"{by} {points.schema[by].dataType.simpleString()}, g long, label int"
    return alone.unionByName(ranked.where("part IS NOT NULL").groupBy("deal").applyInPandas(_deciding(by), schema))


def _sums(placed: DataFrame, by: str) -> dict:
    """{(by, label): (points, sum)} of (by, label, vec); a row for each task and cluster reaches the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                rows = [(*key, len(d), np.sum(d.vec.tolist(), axis=0)) for key, d in pdf.groupby([by, "label"])]
                yield pd.DataFrame(rows, columns=[by, "label", "n", "s"])

    schema = f"{by} {placed.schema[by].dataType.simpleString()}, label int, n long, s array<double>"
    some = placed.select(by, "label", "vec").mapInPandas(run, schema)
    at = some.select(by, "label", "n", F.posexplode("s").alias("i", "x")).groupBy(by, "label", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).groupBy(by, "label").agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    return {(r[by], r.label): (r.n, np.array([x.x for x in r.s])) for r in at.collect()}


def constrained_kmeans(points: DataFrame, must: DataFrame, cannot: DataFrame, k: int, by: str = "dataset_id", start: str = "k-means++", seed: int = 0,
                       rounds: int = 100, centres: DataFrame | None = None) -> DataFrame:
    """(by, cell_id, cluster): k-means within every value of ``by`` under must-links and cannot-links (by, a, b); -1 throughout where a group finds no centre left."""
    own = linked_groups(points, must, by)
    group = own.select(by, "cell_id", "g")
    end = lambda x: group.select(by, F.col("cell_id").alias(x), F.col("g").alias(f"g_{x}"))
    links = materialize(cannot.select(by, "a", "b").join(end("a"), [by, "a"]).join(end("b"), [by, "b"]).select(by, "g_a", "g_b").distinct(), "constrained-links")
    if not links.where("g_a = g_b").isEmpty():
        raise ValueError("a cannot-link contradicts the must-links")
    both = links.select(by, F.col("g_a").alias("g"), F.col("g_b").alias("o")).unionByName(links.select(by, F.col("g_b").alias("g"), F.col("g_a").alias("o"))).distinct()
    degree = both.groupBy(by, "g").agg(F.count("*").alias("degree"))
    order = lambda x: F.struct(-F.col(f"degree_{x}"), mixed_column(F.col(x)), F.col(x))
    d = lambda x: degree.select(by, F.col("g").alias(x), F.col("degree").alias(f"degree_{x}"))
    before = materialize(both.join(d("g"), [by, "g"]).join(d("o"), [by, "o"]).where(order("o") < order("g")).select(by, "g", "o"), "constrained-before")
    linked = _linked(before, by)
    together = (linked.groupBy(by, "part").count().agg(F.max("count")).first()[0] or 0) <= TOGETHER
    centres = seeded(own, k, by, start, seed) if centres is None else centres
    at = {r[by]: np.array(r.centres, float) for r in centres.select(by, "centres").collect()}
    kind, label = own.schema[by].dataType.simpleString(), None
    for _ in range(rounds):
        if together:
            new = materialize(decided(own, linked, at, k, by), "constrained-done")
        else:
            known = own.sparkSession.createDataFrame([(b, c.tolist()) for b, c in at.items()], f"{by} {kind}, centres array<array<double>>")
            new = assigned(own, before, known, k, by, rounds * 10)
        failed = [r[by] for r in new.where("label IS NULL").select(by).distinct().collect()]
        if failed:
            new = materialize(new.select(by, "g", F.when(F.col(by).isin(failed), -1).otherwise(F.col("label")).alias("label")), "constrained-labels")
        if label is not None and new.join(_unsent(label.withColumnRenamed("label", "old")), [by, "g"]).where("label <> old").isEmpty():
            break
        label = new
        placed = own.join(_unsent(label), [by, "g"]).where("label >= 0")
        sums = _sums(placed, by)
        empty = {b: [c for c in range(k) if (b, c) not in sums] for b in at if b not in failed}
        for (b, c), (n, total) in sums.items():
            at[b][c] = total / n
        if any(empty.values()):
            off = F.element_at(_costs(at, k)(by, "vec"), F.col("label") + 1)
            far = Window.partitionBy(by).orderBy(F.desc("off"), "cell_id")
            spare = placed.where(F.col(by).isin([b for b in empty if empty[b]])).withColumn("off", off).withColumn("r", F.row_number().over(far)).where(F.col("r") <= k)
            rows = sorted((r.r, r[by], r.vec) for r in spare.select("r", by, "vec").collect())
            for b in empty:
                spares = [v for _, value, v in rows if value == b]
                for place, c in enumerate(empty[b]):
                    at[b][c] = spares[place] if place < len(spares) else spares[0]
    return group.join(_unsent(label), [by, "g"]).select(by, "cell_id", F.col("label").cast("int").alias("cluster"))
