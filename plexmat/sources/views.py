"""The supplied tables seen as matrix collections: counts, obs and points in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexmat.session import table


def basket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """counts(dataset_id, cell_id, gene_id, x): quantities by region, customer and part."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return (
        lines.join(orders, "l_orderkey")
        .groupBy(F.col("o_custkey").alias("cell_id"), F.col("l_partkey").alias("gene_id")).agg(F.sum("l_quantity").alias("x"))
        .join(_regions(spark, sf_dir), "cell_id")
        .select("dataset_id", "cell_id", "gene_id", "x")
    )


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("dataset_id"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"), "c_nationkey")
    return customer.join(nation, "c_nationkey").select("cell_id", "dataset_id")


def basket_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs(dataset_id, cell_id, label): every customer, labelled by market segment."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("label"))
    return customer.join(_regions(spark, sf_dir), "cell_id").select("dataset_id", "cell_id", "label")


def embedding_points(spark: SparkSession, sf_dir: str, datasets: int = 2) -> DataFrame:
    """points(dataset_id, cell_id, label, vec): embeddings dealt into datasets or slices by id."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        (F.col("vec_id") % datasets).cast("int").alias("dataset_id"), F.col("vec_id").alias("cell_id"), "label",
        F.col("embedding").cast("array<double>").alias("vec"))


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """counts by week of the events: slice, user, event type."""
    e = table(spark, sf_dir, "events")
    week = F.floor(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")) / 7).cast("int")
    return e.groupBy(week.alias("dataset_id"), F.col("user_id").alias("cell_id"), F.col("event_type").alias("gene_id")).agg(
        F.count("*").cast("double").alias("x"))


#: The same views for the oracle.
BASKET_SQL = """basket AS (
  SELECT n.n_regionkey AS dataset_id, o.o_custkey AS cell_id, l.l_partkey AS gene_id, sum(l.l_quantity) AS x
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY ALL),
obs AS (SELECT n.n_regionkey AS dataset_id, c.c_custkey AS cell_id, c.c_mktsegment AS label
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)"""
EMB_SQL = "emb AS (SELECT (vec_id % {k})::INT AS dataset_id, vec_id AS cell_id, label, embedding::DOUBLE[] AS vec FROM embeddings)"
EVENTS_SQL = """ev AS (SELECT floor(epoch(ts) / 604800)::INT AS dataset_id, user_id AS cell_id, event_type AS gene_id, count(*)::DOUBLE AS x
  FROM events GROUP BY ALL)"""
