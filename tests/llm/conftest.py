import pytest

LONG = "many words stand here once more and again " * 3000


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    from plexmat.llm.tuning import bounded_batches

    bounded_batches(spark)
    base = "Le chat dort sur la table et le chien mange dans la cuisine avec les enfants de la maison"
    rows = [
        (0, None, None, "a"), (1, "", "fr", None), (2, "   \n\t", "en", "a"), (3, base, "fr", "a"), (4, base, "fr", "b"), (4, base, "fr", "b"),
        (5, base + " demain", "fr", "a"), (None, base, None, "a"), (6, "12 34 !!", "en", "b"), (7, LONG, "en", "b"), (8, "one", "en", "a"),
        (9, "The dog sleeps on the table and the cat eats in the kitchen with the children of the house", "en", None), (10, "é" * 250 + " fin", "fr", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    clash = {c: F.lit(7) for c in ("n", "key", "rep", "shard", "item", "spans", "uid", "length", "sig", "id", "hash", "held_out", "score", "bits", "size", "block", "word", "component_id")}
    return df.withColumns(clash).withColumn("meta.src", F.lit("x")).withColumn("c0", F.lit(1))


@pytest.fixture(scope="session")
def nothing(tricky):
    return tricky.limit(0)
