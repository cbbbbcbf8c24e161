"""Sources and sinks: matrices in long form from text, CSV, TSV and MatrixMarket files, and Parquet stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-trivial lines (longer than one character) of a text file, compressed files included."""
    return spark.read.text(path).where(F.length("value") > 1)


def _placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, at, value): lines with the start of their block of the file; ``at`` rises within a block."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(position, value): lines in file order, from 0; several files follow each other by path.

    Lines are numbered within their block of the file, by as many tasks as there are blocks; only the sizes of the blocks are summed in order.
    """
    lines = _placed_lines(spark, path)
    within = F.row_number().over(Window.partitionBy("file", "start").orderBy("at"))
    sizes = lines.groupBy("file", "start").agg(F.count("*").alias("n"))
    before = sizes.select("file", "start", F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return lines.withColumn("within", within).join(before, ["file", "start"]).select((F.col("before") + F.col("within") - 1).alias("position"), "value")


def read_mtx(spark: SparkSession, directory: str, dataset_id: str, genes_file: str = "genes.tsv", barcodes_file: str = "barcodes.tsv", matrix_file: str = "matrix.mtx") -> DataFrame:
    """counts(dataset_id, cell_id, gene_id, x) of a MatrixMarket directory (genes x cells triples, 1-based).

    Cells are named by their barcode, genes by the last column of the gene file (the symbol).
    """
    parts = F.split(F.trim("value"), r"\s+")
    body = _placed_lines(spark, f"{directory}/{matrix_file}").where(~F.col("value").startswith("%"))
    # the size line is the first that is no comment: one row, found by an aggregate and dropped by its place
    size_line = body.agg(F.min(F.struct("start", "at")).alias("size_line"))
    triples = body.join(F.broadcast(size_line)).where(F.struct("start", "at") != F.col("size_line")).select(parts.alias("p")).where(F.size("p") == 3).select(
        F.col("p")[0].cast("long").alias("g"), F.col("p")[1].cast("long").alias("c"), F.col("p")[2].cast("double").alias("x"))
    genes = numbered_lines(spark, f"{directory}/{genes_file}").select((F.col("position") + 1).alias("g"), F.element_at(F.split("value", "\t"), -1).alias("gene_id"))
    cells = numbered_lines(spark, f"{directory}/{barcodes_file}").select((F.col("position") + 1).alias("c"), F.col("value").alias("cell_id"))
    return triples.join(genes, "g").join(cells, "c").select(F.lit(dataset_id).alias("dataset_id"), "cell_id", "gene_id", "x")


def read_wide(spark: SparkSession, path: str, dataset_id: str, sep: str = ",", features_in_rows: bool = True, keep_zeros: bool = False) -> DataFrame:
    """counts of a wide CSV or TSV (gzip is read as is): one header line, the first column names the rows."""
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    key, values = df.columns[0], df.columns[1:]
    long = df.unpivot([key], values, "column", "x").select(F.col(key).alias("row"), "column", F.col("x").cast("double").alias("x"))
    gene, cell = ("row", "column") if features_in_rows else ("column", "row")
    out = long.select(F.lit(dataset_id).alias("dataset_id"), F.col(cell).alias("cell_id"), F.col(gene).alias("gene_id"), "x")
    return out if keep_zeros else out.where("x <> 0")


def read_labels(spark: SparkSession, path: str, dataset_id: str, column: str | None = None, sep: str = ",") -> DataFrame:
    """(dataset_id, cell_id, label): barcode and cluster columns of a header CSV; ``column`` names the label."""
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    return df.select(F.lit(dataset_id).alias("dataset_id"), F.col(df.columns[0]).alias("cell_id"), F.col(column or df.columns[-1]).alias("label"))


def split_by_batch(counts: DataFrame, batches: DataFrame) -> DataFrame:
    """Counts of one simulation as one dataset per batch; ``batches`` is (cell_id, batch)."""
    return counts.drop("dataset_id").join(batches, "cell_id").select(F.col("batch").alias("dataset_id"), "cell_id", "gene_id", "x")


def read_vectors(spark: SparkSession, path: str, dataset_id: str, sep: str = "\t") -> DataFrame:
    """points(dataset_id, cell_id, vec) of a latent table: a name and then coordinates, no header."""
    df = spark.read.option("sep", sep).csv(path)
    return df.select(F.lit(dataset_id).alias("dataset_id"), F.col(df.columns[0]).alias("cell_id"), F.array(*(F.col(c).cast("double") for c in df.columns[1:])).alias("vec"))


def encode_labels(labels: DataFrame, label_col: str = "label") -> DataFrame:
    """Dense label codes in label order, from 0; null becomes -1."""
    codes = labels.select(label_col).where(F.col(label_col).isNotNull()).distinct()
    codes = codes.withColumn("label_id", (F.dense_rank().over(Window.orderBy(label_col)) - 1).cast("int"))
    return labels.join(codes, label_col, "left").withColumn("label_id", F.coalesce("label_id", F.lit(-1)))


def attach_labels(obs: DataFrame, labels: DataFrame, key: str = "cell_id", default: int = -1) -> DataFrame:
    """Left join of cluster ids with a default for cells without one."""
    return obs.join(labels, key, "left").withColumn("cluster", F.coalesce("cluster", F.lit(default)))


def concatenate(frames: list[DataFrame], key: str = "cell_id") -> DataFrame:
    """Union of datasets with row names made unique by a counter."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    nth = F.row_number().over(Window.partitionBy(key).orderBy("dataset_id")) - 1
    return out.withColumn("unique_id", F.concat_ws("-", F.col(key).cast("string"), F.when(nth > 0, nth.cast("string"))))


def catalog(counts: DataFrame, prefix: int = 5, without: tuple[str, ...] = ()) -> DataFrame:
    """datasets(name, class): distinct names with their class, the first characters, without some prefixes."""
    names = counts.select(F.col("dataset_id").cast("string").alias("name")).distinct()
    for p in without:
        names = names.where(~F.col("name").startswith(p))
    return names.withColumn("class", F.substring("name", 1, prefix))


def write_stage(df: DataFrame, path: str, codec: str = "zstd") -> None:
    """A stage table as compressed Parquet."""
    df.write.mode("overwrite").option("compression", codec).parquet(path)


POINT_SCHEMA = T.StructType([
    T.StructField("dataset_id", T.IntegerType()), T.StructField("cell_id", T.LongType()), T.StructField("vec", T.ArrayType(T.DoubleType()))])
