"""What joins of shingle sets share: sets of texts, classes of equal sets, confirmation on full sets, and components.

A class is the set of one or more rows, known by its size and a 128-bit digest; ``rep`` numbers the classes. Links are found between
classes and confirmed on the full sets of one row of each, which is looked up by its id and the hash of its text, so that rows that repeat an id
never stand in for each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexmat.llm.textkit import LOWER, U, combine_rows, mix64, span_hashes, text_bytes, text_chunks, words
from plexmat.operators.components import connected_components
from plexmat.session import materialize, materialize_bucketed

DIGEST = ["n", "d1", "d2"]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased."""
    n = len(offsets) - 1
    data = LOWER[data]
    starts, ends, rows = words(data, offsets)
    grams, owner = combine_rows(span_hashes(data, starts, ends), rows, n, width)
    order = np.argsort(owner, kind="stable")
    grams, bounds = grams[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    return [np.unique(grams[bounds[i] : bounds[i + 1]]) for i in range(n)]


def digests(sets: list[np.ndarray]) -> list[pa.Array]:
    """Size and two checksums of each set."""
    with np.errstate(over="ignore"):
        d1 = np.array([mix64(s).sum(dtype=U) for s in sets], U).view(np.int64)
        d2 = np.array([mix64(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U) for s in sets], U).view(np.int64)
    return [pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(d1), pa.array(d2)]


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, text): key tells rows apart that repeat an id."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).alias("text"))


def set_classes(rows: DataFrame, *carried: str) -> DataFrame:
    """(rep, n, d1, d2, doc_id, key, n_exact, carried): one row for each distinct non-empty set, with its smallest id."""
    first = F.min(F.struct("doc_id", "key"))
    found = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy(*DIGEST).agg(first.alias("first"), F.count("*").alias("n_exact"), *(F.min_by(c, "doc_id").alias(c) for c in carried))
    return materialize(found.select(F.monotonically_increasing_id().alias("rep"), *DIGEST, "first.doc_id", "first.key", "n_exact", *carried), "set-classes")


def texts_of(needed: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(rep, text) of the classes in ``needed``, written in buckets, so that later joins move pairs and not texts. Identical rows count once."""
    wanted = classes.select("rep", "doc_id", "key").join(needed.select("rep").distinct(), "rep")
    return materialize_bucketed(texts.join(wanted, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("rep", "text"), "rep", "set-texts")


def _confirm(percent: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                left, right = (shingle_sets(*text_bytes(part.column(c)), width) for c in ("text_a", "text_b"))
                ok = np.zeros(part.num_rows, bool)
                for i, (x, y) in enumerate(zip(left, right, strict=True)):
                    both = int(np.isin(x, y, assume_unique=True).sum())
                    ok[i] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(ok)], ["a", "b", "ok"])

    return run


def confirm(pairs: DataFrame, own: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs (a, b) of classes whose full shingle sets reach the threshold; ``own`` is (rep, text)."""
    return (
        pairs.select("a", "b")
        .join(own.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
        .join(own.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
        .mapInArrow(_confirm(percent, width), "a long, b long, ok boolean")
        .where("ok").select("a", "b")
    )


def size_fits(n_a: Column, n_b: Column, percent: int) -> Column:
    """Sets of these sizes can reach the threshold."""
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def linking(left: np.ndarray, n_left: int, sets: list[np.ndarray], sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of ``sets`` reach the threshold with ``left``."""
    if not len(sets):
        return np.zeros(0, bool)
    values = np.concatenate(sets)
    inside = left[np.minimum(np.searchsorted(left, values), len(left) - 1)] == values
    both = np.add.reduceat(inside.astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * both >= percent * (n_left + sizes - both)


def _blobs(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [rows.column("rep"), pa.array([s.tobytes() for s in shingle_sets(data, offsets, width)], pa.binary())], ["rep", "shingles"])

    return run


def set_blobs(needed: DataFrame, own: DataFrame, width: int) -> DataFrame:
    """(rep, shingles): the full sets of the classes in ``needed``, 8 bytes a shingle."""
    return own.join(needed.select("rep").distinct(), "rep", "left_semi").mapInArrow(_blobs(width), "rep long, shingles binary")


def same_id_edges(rows: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links between the classes of rows that repeat an id with other sets, a star for each id; None if there are none."""
    known = rows.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", *DIGEST)
    several = materialize(known.groupBy("doc_id").agg(F.min(F.struct(*DIGEST)).alias("lo"), F.max(F.struct(*DIGEST)).alias("hi")).where("lo <> hi").select("doc_id"), "set-several")
    if several.isEmpty():
        return None
    owned = materialize(known.join(several, "doc_id").distinct().join(classes.select("rep", *DIGEST), DIGEST).select("doc_id", "rep"), "set-owned")
    hubs = owned.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return owned.join(hubs, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))


def components(rows: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, n, component_id, n_exact) of every row: the smallest id reachable by links, by equal sets and by rows of the same id."""
    more = same_id_edges(rows, classes)
    labels = connected_components(edges if more is None else edges.unionByName(more), "a", "b").select(F.col("node").alias("rep"), "component")
    linked = classes.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    lowest = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    final = linked.select("component", "n_exact", *DIGEST).join(lowest, "component").select(*DIGEST, "n_exact", "component_id")
    out = rows.select("doc_id", *DIGEST).join(final, DIGEST, "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n", component.alias("component_id"), F.coalesce("n_exact", F.lit(1)).alias("n_exact"))


def linked_sql(width: int, percent: int) -> str:
    """DuckDB SQL up to the tables n (doc_id, n), l (links x < y) and comp (node, c), by exact set joins, for small tables."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y, c, a.n AS na, b.n AS nb FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {percent} * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
reach AS (SELECT x AS node, x AS root FROM e UNION SELECT e.y, reach.root FROM reach JOIN e ON e.x = reach.node),
comp AS (SELECT node, min(root) AS c FROM reach GROUP BY 1)"""
