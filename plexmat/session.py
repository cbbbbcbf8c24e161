"""Session helpers: a local session for tests and benches, tables, and materialised intermediates."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "plexmat") -> SparkSession:
    """A local session; on a cluster the caller brings its own."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it, if it isn't installed for them."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One supplied table; always through Spark's reader, so any path scheme works."""
    find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. Only a local session may go without: it gets a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="plexmat-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def written_dir(spark: SparkSession) -> str:
    """Where this application's written steps lie."""
    return f"{shared_dir(spark)}/plexmat/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write a DataFrame into the shared folder and read it back.

    Cuts the lineage with a written table, so a lost executor never forces the upstream job to rerun. ``clean_up`` removes the tables.
    """
    spark = df.sparkSession
    path = f"{written_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, column: str, label: str = "step") -> DataFrame:
    """As ``materialize``, dealt into buckets by one column: joins on it move only the other side."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{label}-{uuid.uuid4().hex}"
    table_name = name.replace("-", "_")
    df.repartition(n, column).write.bucketBy(n, column).option("path", f"{written_dir(spark)}/{name}").saveAsTable(table_name)
    return spark.table(table_name)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Remove one written step that nothing reads any more (a loop's former round)."""
    files = df.inputFiles()
    if files:
        _delete(df.sparkSession, files[0].rsplit("/", 1)[0])


def release_shuffles(spark: SparkSession) -> None:
    """Let the driver collect plans that nothing refers to any more, so that Spark deletes the shuffle files of steps that are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clean_up(spark: SparkSession) -> None:
    """Remove this application's written steps; results that still read them can't be used any more."""
    _delete(spark, written_dir(spark))
