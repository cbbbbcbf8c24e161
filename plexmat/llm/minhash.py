"""MinHash near-duplicate detection with HyperMinHash registers.

A document is the set of its distinct five-word shingles (hashed to 64 bits). Each set is sketched into 125 registers of
16 bits: the hash's top bits choose a bucket, the smallest remainder of a bucket is kept as its count of leading
zeros (6 bits) and the 10 bits that follow the leading one. Empty buckets borrow a filled one along a fixed
probe sequence (optimal densification), so that two registers agree with the sets' Jaccard similarity.

Plan, all of it on Spark:

1. exact copies of a set collapse into a class by a 128-bit digest (partial aggregation, so a hot text costs one
   row a task);
2. bands of compressed registers (25 of 5 at 0.85, 31 of 4 at 0.80) give bucket keys; a bucket links its members to its smallest member (a star, never
   all pairs); the collision-corrected estimate screens the links and the full sets confirm them;
3. buckets whose members are still in different components are compared across components only, every pair in the first
   band that it shares, so that no link between different texts is lost. Buckets of up to ``SMALL`` members report the
   screened pairs, which the full sets then confirm; in larger ones the full sets are compared inside blocks of
   ``BLOCK`` members and ``BLOCK_BYTES`` bytes of sets, and only links that join two components leave a block, so a hot group never becomes all its pairs.

A pair at the threshold of 0.85 misses all bands with probability 4e-7 (0.80: 8e-8), and is screened out by the estimate
(bound 0.69, five standard deviations; 0.80: 0.62) with probability 3e-7.

Edge cases: a null or empty text, or one without words, has an empty set: n_shingles 0 and linked with nothing.
Rows that repeat a doc_id are one node: their sets are linked, and every row has the node's component (a row without words stays
apart, whatever its id). A row without doc_id is returned unlinked, with a null component and kept. Other columns of the input are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from plexmat.llm.setlinks import components, confirm, digests, keyed_texts, linked_sql, linking, set_blobs, set_classes, shingle_sets, size_fits, texts_of
from plexmat.llm.textkit import U, mix64, text_chunks
from plexmat.llm.tuning import unused
from plexmat.operators.components import connected_components
from plexmat.session import discard, materialize

BUCKETS = 128
USED = 125
#: A pair at the threshold may miss all bands with this probability.
MISS = 1e-6
MANTISSA_BITS = 10
SHINGLE = 5
#: Estimates below the bound are five standard deviations away from the threshold.
ESTIMATE_MARGIN_SD = 5.0
BLOCK = 1000
BLOCK_BYTES = 16 << 20
SMALL = 128
PROBES = np.random.default_rng(7).integers(0, BUCKETS, (BUCKETS, 96))


def banding(percent: int) -> tuple[int, int]:
    """(bands, registers a band): the longest bands by which a pair at the threshold is missed with probability ``MISS`` at most."""
    rows = next((r for r in range(USED, 1, -1) if (1 - (percent / 100) ** r) ** (USED // r) <= MISS), 1)
    return USED // rows, rows


def banded(sig: np.ndarray, percent: int) -> np.ndarray:
    """Rows of registers as (row, band, register)."""
    bands, rows = banding(percent)
    return sig[:, : bands * rows].reshape(-1, bands, rows)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of compressed registers for each non-empty set; rows of empty sets are zero."""
    out = np.zeros((len(sets), BUCKETS), np.uint16)
    filled = np.zeros((len(sets), BUCKETS), bool)
    for i, s in enumerate(sets):
        if not len(s):
            filled[i] = True
            continue
        bucket = (s >> U(57)).astype(np.int64)
        first = np.ones(len(s), bool)
        first[1:] = bucket[1:] != bucket[:-1]
        rest = (s[first] << U(7)) | U(64)  # never zero
        exponent = np.frexp(rest.astype(np.float64))[1]
        zeros = np.clip(64 - exponent, 0, 63).astype(np.uint64)
        # rounding to double can lift a run of ones to the next power of two; read the bit itself
        zeros += ((rest << zeros) >> U(63)) == 0
        mantissa = ((rest << zeros) << U(1)) >> U(64 - MANTISSA_BITS)
        out[i, bucket[first]] = ((zeros << U(MANTISSA_BITS)) | mantissa).astype(np.uint16)
        filled[i, bucket[first]] = True
    base, have = out.copy(), filled.copy()
    for t in range(PROBES.shape[1]):
        open_rows = np.flatnonzero(~filled.all(axis=1))
        if not len(open_rows):
            return out
        donor, there = base[open_rows][:, PROBES[:, t]], have[open_rows][:, PROBES[:, t]]
        take = ~filled[open_rows] & there
        out[open_rows] = np.where(take, donor, out[open_rows])
        filled[open_rows] |= take
    for t in range(1, BUCKETS):  # very small sets: the next filled bucket
        open_rows = np.flatnonzero(~filled.all(axis=1))
        if not len(open_rows):
            break
        take = ~filled[open_rows] & np.roll(have[open_rows], -t, axis=1)
        out[open_rows] = np.where(take, np.roll(base[open_rows], -t, axis=1), out[open_rows])
        filled[open_rows] |= take
    return out


def collision_rate(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Chance that registers of two disjoint sets agree: equal leading-zero counts and equal mantissas."""
    depth = np.arange(40)
    upper, lower = 2.0**-depth, 2.0 ** -(depth + 1)

    def minimum_in(n: np.ndarray) -> np.ndarray:
        per = np.maximum(n[:, None] / BUCKETS, 1.0)
        return (1 - lower) ** per - (1 - upper) ** per

    return (minimum_in(np.asarray(n_a, float)) * minimum_in(np.asarray(n_b, float))).sum(axis=1) / 2**MANTISSA_BITS


def estimate(sig_a: np.ndarray, sig_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimate of aligned rows of registers."""
    agree = (sig_a == sig_b).mean(axis=1)
    by_chance = collision_rate(n_a, n_b)
    return np.clip((agree - by_chance) / (1 - by_chance), 0, 1)


def unpack(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint16).reshape(-1, USED)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_chunks(batches, "text"):
        sets = shingle_sets(data, offsets, SHINGLE)
        sig = registers(sets)[:, :USED]
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), rows.column("key"), *digests(sets), pa.array([x.tobytes() for x in sig], pa.binary())],
            ["doc_id", "key", "n", "d1", "d2", "sig"])


def _bands(percent: int):
    bands, rows = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            regs = banded(unpack(b.column("sig").to_pylist()), percent).astype(U)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=U), regs.shape[:2]).copy()
            for i in range(rows):
                key = mix64((key << U(1)) ^ (key >> U(33)) ^ (regs[:, :, i] + U(1)) * U(0xD6E8FEB86659FD93))
            rep = np.repeat(b.column("rep").to_numpy(zero_copy_only=False), bands)
            band = np.tile(np.arange(bands, dtype=np.int32), b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(band), pa.array(rep)], ["key", "band", "rep"])

    return run


@F.pandas_udf(DoubleType())
def _estimate_udf(sig_a: pd.Series, sig_b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    if not len(sig_a):
        return pd.Series([], dtype=float)
    return pd.Series(estimate(unpack(list(sig_a)), unpack(list(sig_b)), n_a.to_numpy(), n_b.to_numpy()))


def first_shared_band(sig_a: np.ndarray, sig_b: np.ndarray, percent: int) -> np.ndarray:
    """The first band in which aligned rows of registers agree (they share one at least)."""
    return (banded(sig_a, percent) == banded(sig_b, percent)).all(axis=2).argmax(axis=1)


def screened(left: np.ndarray, right: np.ndarray, n_l: np.ndarray, n_r: np.ndarray, band: int, bound: float, percent: int) -> np.ndarray:
    """Which aligned pairs of one bucket are to be confirmed here."""
    ok = 100 * np.minimum(n_l, n_r) >= percent * np.maximum(n_l, n_r)
    at = np.flatnonzero(ok)
    if len(at):
        ok[at] &= estimate(left[at], right[at], n_l[at], n_r[at]) >= bound
        at = np.flatnonzero(ok)
        if len(at):
            ok[at] &= first_shared_band(left[at], right[at], percent) == band
    return ok


def _small_buckets(bound: float, percent: int):
    """Streams rows sorted by key; pairs across components that pass the screen."""

    def pairs(band: int, reps: list, comps: list, ns: list, sigs: list) -> tuple[np.ndarray, np.ndarray]:
        rep, comp, n, sig = np.array(reps), np.array(comps), np.array(ns), unpack(sigs)
        i, j = np.triu_indices(len(rep), 1)
        apart = comp[i] != comp[j]
        i, j = i[apart], j[apart]
        ok = screened(sig[i], sig[j], n[i], n[j], band, bound, percent)
        return np.minimum(rep[i], rep[j])[ok], np.maximum(rep[i], rep[j])[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, band, held = None, 0, ([], [], [], [])
        for b in batches:
            out = []
            columns = [b.column(c).to_pylist() for c in ("key", "band", "rep", "comp", "n", "sig")]
            for k, at, *row in zip(*columns, strict=True):
                if k != key:
                    if len(held[0]) > 1:
                        out.append(pairs(band, *held))
                    key, band, held = k, at, ([], [], [], [])
                for column, x in zip(held, row, strict=True):
                    column.append(x)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["a", "b"])
        if len(held[0]) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs(band, *held)], ["a", "b"])

    return run


def _large_bucket(bound: float, percent: int):
    """Confirmed links that join components within one block pair of a bucket."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, band = int(pdf.bi.iloc[0]), int(pdf.bj.iloc[0]), int(pdf.band.iloc[0])
        left, right = pdf[pdf.block == i], pdf[pdf.block == j]
        sig_l, sig_r = unpack(list(left.sig)), unpack(list(right.sig))
        n_l, n_r = left.n.to_numpy(), right.n.to_numpy()
        rep_l, rep_r = left.rep.to_numpy(), right.rep.to_numpy()
        parent = {c: c for c in pd.unique(pdf.comp).tolist()}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        comp_l, comp_r = left.comp.tolist(), right.comp.tolist()
        sets_r = [np.frombuffer(x, U) for x in right.shingles]
        sets_l = [np.frombuffer(x, U) for x in left.shingles]
        # a member that resembles many comes first: it joins most of the others at once
        near = [int((estimate(np.broadcast_to(s, sig_r.shape), sig_r, np.full(len(n_r), n), n_r) >= percent / 100).sum()) for s, n in zip(sig_l, n_l, strict=True)]
        links = []
        for k in np.argsort(-np.array(near), kind="stable"):
            own = root(comp_l[k])
            at = np.array([x for x in range(len(rep_r)) if root(comp_r[x]) != own and (i != j or rep_r[x] != rep_l[k])], np.int64)
            if not len(at):
                continue
            at = at[screened(np.broadcast_to(sig_l[k], (len(at), USED)), sig_r[at], np.full(len(at), n_l[k]), n_r[at], band, bound, percent)]
            for part in np.array_split(at, max(1, len(at) // 200)):
                if not len(part):
                    continue
                for x in part[linking(sets_l[k], n_l[k], [sets_r[x] for x in part], n_r[part], percent)]:
                    if root(comp_r[x]) != root(comp_l[k]):
                        parent[root(comp_r[x])] = root(comp_l[k])
                        links.append((min(rep_l[k], rep_r[x]), max(rep_l[k], rep_r[x])))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, n_exact) of every row of ``docs``.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets;
    component_id is the smallest doc_id reachable and kept marks the document that stays. n_exact counts the
    documents of the same set.
    """
    spark = docs.sparkSession
    source = keyed_texts(docs, id_col, text_col)
    sketches = materialize(source.mapInArrow(_sketch, "doc_id long, key long, n long, d1 long, d2 long, sig binary"), "minhash-sketch")
    classes = set_classes(sketches, "sig")
    reps = classes.select("rep", "n", "sig")
    bands = materialize(reps.mapInArrow(_bands(percent), "key long, band int, rep long"), "minhash-bands")
    hubs = bands.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("size")).where("size > 1")
    members = materialize(bands.join(hubs, "key").select("key", "band", "rep", "hub", "size"), "minhash-members")
    own = texts_of(members, classes, source)
    bound = percent / 100 - ESTIMATE_MARGIN_SD * (percent / 100 * (1 - percent / 100) / USED) ** 0.5

    def signed(pairs: DataFrame) -> DataFrame:
        a = reps.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
        b = reps.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
        return (
            pairs.join(a, "a").join(b, "b")
            .where(size_fits(F.col("n_a"), F.col("n_b"), percent))
            .withColumn("est", _estimate_udf("sig_a", "sig_b", "n_a", "n_b"))
            .where(F.col("est") >= bound)
        )

    stars = members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    # the likeliest hub of each document first; what this leaves apart is compared below
    best = signed(stars).groupBy("b").agg(F.max_by("a", F.struct("est", -F.col("a"))).alias("a")).select("a", "b")
    tested = materialize(best, "minhash-tested")
    edges = materialize(confirm(tested, own, percent, SHINGLE), "minhash-edges")
    labels = connected_components(edges, "a", "b")
    comp = members.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "key", "band", "rep", "size", F.coalesce("component", "rep").alias("comp"))
    comp = materialize(comp, "minhash-comp")
    discard(members)
    open_keys = comp.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    # written: small buckets, large ones and their weights read the same rows
    apart = materialize(comp.join(open_keys, "key").join(reps, "rep"), "minhash-apart")
    discard(comp)
    small = (
        apart.where(F.col("size") <= SMALL).select("key", "band", "rep", "comp", "n", "sig")
        .repartition("key").sortWithinPartitions("key").mapInArrow(_small_buckets(bound, percent), "a long, b long")
    )
    fresh = materialize(small.join(tested, ["a", "b"], "left_anti"), "minhash-cross")
    weights = apart.where(F.col("size") > SMALL).groupBy("key").agg(F.sum("n").alias("weight"))
    large = apart.where(F.col("size") > SMALL).join(weights, "key")
    own_sets = set_blobs(large, own, SHINGLE)
    n_blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("weight") * 8 / BLOCK_BYTES))
    # a member meets every block once: as the left side of (block, x) and the right side of (x, block)
    dealt = (
        large.join(own_sets, "rep").withColumn("n_blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64("rep"), "n_blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
        .select("key", "band", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "rep", "comp", "n", "sig", "shingles")
    )
    joins = dealt.groupBy("key", "bi", "bj").applyInPandas(_large_bucket(bound, percent), "a long, b long")
    edges = edges.unionByName(materialize(confirm(fresh, own, percent, SHINGLE).unionByName(joins), "minhash-edges"))
    out = components(sketches, classes, edges)
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "n_exact")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with the smallest id; all columns stay."""
    links = near_duplicates(docs, id_col, text_col, percent)
    (gone_id,) = unused(docs, "copy_id")
    gone = links.where(~F.col("kept")).select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(gone_id), "left_anti")


def oracle() -> str:
    """The same result from exact set joins in DuckDB SQL, for small tables."""
    return linked_sql(SHINGLE, 85) + """,
same AS (SELECT node, count(*) AS k FROM (SELECT x AS node FROM l WHERE c = na AND c = nb UNION ALL SELECT y FROM l WHERE c = na AND c = nb) GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id, coalesce(comp.c, d.doc_id) = d.doc_id AS kept, 1 + coalesce(same.k, 0) AS n_exact
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.node = d.doc_id LEFT JOIN same ON same.node = d.doc_id"""
