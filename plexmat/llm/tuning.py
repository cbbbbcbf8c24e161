"""Session settings that the Arrow operators rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def bounded_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 8) -> SparkSession:
    """Bound what an Arrow batch holds, so that very long texts never fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))
    return spark


def unused(docs: DataFrame, *names: str) -> list[str]:
    """These names, lengthened until ``docs`` has no such column."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def by_place(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with plain column names by place (Arrow functions look columns up by name, and a dot would be read as a path), and what ``names`` are called then."""
    plain = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*plain), [plain[docs.columns.index(name)] for name in names]
