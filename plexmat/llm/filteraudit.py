"""How five document filters interact, counted from a sparse document-term matrix.

The matrix has a row for each document and a column for each distinct word of the corpus. It is built in CSR shards:

1. every task cuts its documents into chunks of about 2 MB of text; a chunk gives one shard: row pointers, local word numbers and counts, and the
   chunk's distinct words, dealt into buckets by hash (a bucket for each ``BUCKET_BYTES`` of the corpus, so that none outgrows a task);
2. a bucket's words of all shards meet in one task, which numbers the distinct ones in order; the bucket's offset makes that the word's column.
   What is shuffled are compressed lists of a shard's distinct words, never tokens: a word that stands in every document comes once a shard;
3. the columns go back to their shard and replace the local numbers.

Row sums of the matrix are numbers of words (filter A), nonzero counts of a row are numbers of distinct words (filter B). Flags C and D are counted from the
text's bytes as the shards are built, E from the smallest id of each text (by SHA-256); equal texts are counted per text, part, label and id
before they meet, so that a text with a third of all rows is few rows. What is left is one count for each part, set of failed
filters and labels; all orders are read from these.

Filters: A under 200 words; B fewer than half of the words distinct; C more than 3 % capitals A-Z; D any of ``#$%&*|``; E same text
as a smaller id. Words are runs of bytes outside space and 0x09-0x0D, case-sensitive.

Edge cases: a null text is empty, so null and empty texts are equal; a null language is the part ''. A row without an id has no labels, fails no E and makes no other
row fail it; rows that repeat an id are documents of their own, and none of them is a copy of another. Labels that repeat an id hold if any
row says so. An empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexmat.llm.textkit import U, span_hashes, text_chunks, words
from plexmat.session import materialize

FILTERS = "ABCDE"
BUCKET_BYTES, MIN_BUCKETS = 16 << 20, 8
MARKS = np.isin(np.arange(256), np.frombuffer(b"#$%&*|", np.uint8))
_ROWS = [("doc_id", pa.int64(), "bigint"), ("part", pa.string(), "string"), ("same", pa.binary(), "binary"), ("n_points", pa.int64(), "bigint"), ("n_upper", pa.int64(), "bigint"), ("marked", pa.bool_(), "boolean")]
_MATRIX = ["indptr", "local", "counts"]
_LOCAL = "shard long, " + ", ".join(f"{n} array<{t}>" for n, _, t in _ROWS) + ", indptr binary, local binary, counts binary, words array<binary>"


def packed(x: np.ndarray) -> bytes:
    """Compressed, with the size in front."""
    raw = np.ascontiguousarray(x).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True), kind)


def packed_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words as their number, their lengths and their bytes, compressed."""
    size = ends - starts
    at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return packed(np.concatenate([np.concatenate([[len(size)], size]).astype("<u4").view(np.uint8), data[at]]))


def unpacked_words(blob: bytes) -> pa.Array:
    raw = unpacked(blob, np.uint8)
    n = int(raw[:4].view("<u4")[0])
    offsets = np.concatenate([[0], np.cumsum(raw[4 : 4 + 4 * n].view("<u4"))]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw[4 + 4 * n :])])


def per_row(hit: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are hit."""
    return np.diff(np.concatenate([[0], np.cumsum(hit)])[offsets])


def local_matrix(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(indptr, local word numbers, counts, packed distinct words of each bucket) of a chunk of texts; words are numbered bucket by bucket."""
    starts, ends, row = words(data, offsets)
    found, first, code = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    bucket = (found % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    number = np.empty(len(found), np.int64)
    number[order] = np.arange(len(found))
    cell, counts = np.unique(row * max(1, len(found)) + number[code], return_counts=True)
    at, local = np.divmod(cell, max(1, len(found)))
    indptr = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(offsets) - 1))])
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    listed = [first[order[s:e]] for s, e in zip(bounds, bounds[1:], strict=False)]
    return indptr, local, counts, [packed_words(data, starts[x], ends[x]) if len(x) else b"" for x in listed]


def _build(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 33
        for rows, data, offsets in text_chunks(batches, "text"):
            indptr, local, counts, found = local_matrix(data, offsets, buckets)
            mine = [rows.column("doc_id"), rows.column("part"), rows.column("same"), pa.array(per_row((data & 0xC0) != 0x80, offsets)),
                    pa.array(per_row((data >= 65) & (data <= 90), offsets)), pa.array(per_row(MARKS[data], offsets) > 0)]
            blobs = [packed(x.astype("<i4")) for x in (indptr, np.diff(local, prepend=0), counts)]
            listed = [pa.array([x.to_pylist()], pa.list_(t)) for x, (_, t, _) in zip(mine, _ROWS, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard]), *listed, *(pa.array([x], pa.binary()) for x in blobs), pa.array([found], pa.list_(pa.binary()))],
                ["shard", *(n for n, _, _ in _ROWS), *_MATRIX, "words"])
            shard += 1

    return run


def _number(pdf: pd.DataFrame) -> pd.DataFrame:
    """Numbers a bucket's distinct words, in order."""
    lists = [unpacked_words(x) for x in pdf.words]
    coded = pa.chunked_array(lists).combine_chunks().dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int32)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    numbers = np.split(rank[coded.indices.to_numpy()], np.cumsum([len(x) for x in lists])[:-1])
    return pd.DataFrame({"bucket": pdf.bucket, "shard": pdf.shard, "size": len(rank), "ranks": [packed(x.astype("<i4")) for x in numbers]})


def local_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row a chunk of texts: its documents, and its matrix by local word numbers. Written."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), text.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    return materialize(rows.mapInArrow(_build(max(MIN_BUCKETS, -(-total // BUCKET_BYTES))), _LOCAL), "matrix-shards")


def columns_of(shards: DataFrame) -> DataFrame:
    """(shard, columns): for each bucket of a shard's words their ranks and the bucket's offset; together the columns, dense over the whole corpus."""
    found = shards.select("shard", F.posexplode("words").alias("bucket", "words")).where(F.length("words") > 0)
    ranked = materialize(found.groupBy("bucket").applyInPandas(_number, "bucket int, shard long, size long, ranks binary"), "matrix-columns")
    sizes = ranked.groupBy("bucket").agg(F.max("size").alias("size"))
    # as many rows as buckets
    before = F.coalesce(F.sum("size").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = ranked.drop("size").join(sizes.select("bucket", before.alias("offset")), "bucket")
    return numbered.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("bucket", "offset", "ranks"))).alias("columns"))


def joined(shards: DataFrame) -> DataFrame:
    return shards.drop("words").join(columns_of(shards), "shard", "left")


def _matrix(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indptr, columns, counts) of one shard, local numbers replaced."""
    indptr, step, counts = (unpacked(b.column(c)[i].as_py(), np.int32) for c in _MATRIX)
    known = [unpacked(x["ranks"], np.int32).astype(np.int64) + x["offset"] for x in b.column("columns")[i].as_py() or []]
    return indptr, np.concatenate(known)[np.cumsum(step, dtype=np.int64)] if known else np.zeros(0, np.int64), counts


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            kinds = (pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("shard").slice(i, 1), b.column("doc_id").slice(i, 1), *(pa.array([x], pa.list_(t)) for x, t in zip(_matrix(b, i), kinds, strict=True))],
                ["shard", "doc_id", "indptr", "columns", "counts"])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            indptr, columns, counts = _matrix(b, i)
            # a row's columns are distinct, since each is one word's
            n_words, n_distinct = (np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[indptr]) for x in (counts, columns >= 0))
            mine = [b.column(n)[i].values for n, _, _ in _ROWS]
            yield pa.RecordBatch.from_arrays([*mine, pa.array(n_words), pa.array(n_distinct)], [*(n for n, _, _ in _ROWS), "n_words", "n_distinct"])


def csr_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(shard, doc_id, indptr, columns, counts): the document-term matrix, rows in the order of ``doc_id``."""
    shards = local_shards(docs, id_col, text_col, lang_col)
    return joined(shards).mapInArrow(_encoded, "shard long, doc_id array<long>, indptr array<int>, columns array<long>, counts array<int>")


def document_totals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, part, same, n_points, n_upper, marked, n_words, n_distinct) of every row."""
    schema = ", ".join(f"{n} {t}" for n, _, t in _ROWS) + ", n_words long, n_distinct long"
    return joined(local_shards(docs, id_col, text_col, lang_col)).mapInArrow(_totals, schema)


def bit(f: str) -> int:
    return 1 << FILTERS.index(f)


def failed(rows: DataFrame) -> DataFrame:
    """(doc_id, part, same, fails): the filters A to D that a document fails, as bits."""
    tests = {"A": F.col("n_words") < 200, "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"), "C": 100 * F.col("n_upper") > 3 * F.col("n_points"), "D": F.col("marked")}
    fails = sum((F.when(t, bit(f)).otherwise(0) for f, t in tests.items()), F.lit(0))
    return rows.select("doc_id", "part", "same", fails.alias("fails"))


def failure_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic, n): documents by failed filters, E included, and labels."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.coalesce(F.max("good"), F.lit(False)).alias("good"), F.coalesce(F.max("toxic"), F.lit(False)).alias("toxic"))
    kind = ["same", "part", "fails", "good", "toxic"]
    labelled = rows.join(known, "doc_id", "left").fillna(False, ["good", "toxic"])
    by_id = labelled.groupBy(*kind, "doc_id").agg(F.count("*").alias("n"))
    named = F.col("doc_id").isNotNull()
    groups = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(named, F.col("n"))), F.lit(0)).alias("n_named"), F.min(F.when(named, F.struct("doc_id", "n"))).alias("first"))
    lowest = F.min("first.doc_id").over(Window.partitionBy("same"))  # a row for each part and label of a text
    copies = F.col("n_named") - F.when(F.col("first.doc_id") == lowest, F.col("first.n")).otherwise(0)
    split = groups.withColumn("copies", copies).select("part", "good", "toxic", F.explode(F.array(
        F.struct("fails", (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("fails") + bit("E")).alias("fails"), F.col("copies").alias("n")))).alias("x"))
    return split.where("x.n > 0").groupBy("part", F.col("x.fails").alias("fails"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def orders() -> Column:
    """All steps of all orders of the filters as one literal array."""
    steps = []
    for order in permutations(FILTERS):
        for i, f in enumerate(order):
            steps.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(bit(f)).alias("own"), F.lit(sum(bit(x) for x in order[:i])).alias("before")))
    return F.array(*steps)


def interaction(counts: DataFrame) -> DataFrame:
    """One row for each part, order and step."""
    rows = counts.withColumn("o", F.explode(orders())).select("*", "o.*")
    own, early = F.col("fails").bitwiseAND(F.col("own")) != 0, F.col("fails").bitwiseAND(F.col("before")) != 0
    n = F.col("n")
    here = own & ~early
    total = lambda test, x=n: F.sum(F.when(test, x).otherwise(0)).cast("long")
    share = n * F.expr("120 div greatest(bit_count(fails), 1)")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~own & ~early).alias("kept"), total(here).alias("removed"), total(own & early).alias("redundant"), total(F.col("fails") == F.col("own")).alias("unique_fails"),
        total(here & F.col("good")).alias("good_lost"), total(here & F.col("toxic")).alias("toxic_lost"), total(own, share).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    rows = failed(document_totals(docs, id_col, text_col, lang_col))
    return interaction(materialize(failure_counts(rows, labels), "filter-counts"))


def oracle() -> str:
    """The same audit in DuckDB SQL, document by document."""
    return r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lows AS (SELECT text, min(doc_id) AS lo FROM w GROUP BY text),
labelled AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) < 200 AS "A", 100 * len(list_distinct(w)) < 50 * len(w) AS "B",
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS "C", regexp_matches(text, '[#$%&*|]') AS "D", coalesce(doc_id > lo, false) AS "E"
  FROM w JOIN lows USING (text) LEFT JOIN labelled USING (doc_id)),
s AS (SELECT part, good, toxic, (CASE WHEN "A" THEN 'A' ELSE '' END) || (CASE WHEN "B" THEN 'B' ELSE '' END) || (CASE WHEN "C" THEN 'C' ELSE '' END) || (CASE WHEN "D" THEN 'D' ELSE '' END) || (CASE WHEN "E" THEN 'E' ELSE '' END) AS fails FROM d),
c AS (SELECT part, good, toxic, fails, count(*) AS n FROM s GROUP BY ALL),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM o, range(1, 6) r(step)),
x AS (SELECT c.*, filter_order, step, contains(fails, own) AS hit, fails = own AS alone, before <> '' AND regexp_matches(fails, '[' || before || 'x]') AS early FROM c, steps)
SELECT part, filter_order, step::INTEGER AS step, coalesce(sum(n) FILTER (NOT hit AND NOT early), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT early), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (hit AND early), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (hit AND NOT early AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (hit AND NOT early AND toxic), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(length(fails), 1)) FILTER (hit), 0)::BIGINT AS shapley
FROM x GROUP BY part, filter_order, step"""
