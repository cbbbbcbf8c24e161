"""Periodic runs of words: seeds on diagonals, extended once.

A run is a stretch of consecutive words with smallest period q, at least ``max(MIN_LENGTH, MIN_EXPONENT * q)`` words long, that no neighbouring
word extends. Such a stretch overlaps itself, shifted by q, in at least ``max(24 - q, 2 * q)`` words; over all q that is never less than 16,
and for periods of [k / 2, k) with k = 32, 64, ... never less than k. So in every document

1. the k-grams of k = 16 are indexed for lags below 16, and those of k = 32, 64, ... for lags of [k / 2, k); a k-gram that doesn't come twice ends the
   doubling at its place, so that most documents stop after the first step;
2. pairs of consecutive occurrences of a k-gram are the seeds, on the diagonal of their lag. Consecutive ones suffice: if the k-gram at i and
   i + q (q <= k) also stood between them, at i + d, it would have the periods d and q - d, hence (periodicity lemma) their greatest common divisor,
   and so would the run: q would not be its smallest period. For the same reason no seed has a lag that is a multiple of the run's period. Seeds are
   therefore at most as many as words for each k;
3. seeds are taken in order on each diagonal; a table of the furthest covered place of each lag skips those that an extension has covered,
   and each other one is extended to both sides word by word (64-bit hashes of the words).

Everything happens in the document's own task: one pass over the table, no shuffle. Words are runs of bytes outside space and 0x09-0x0D, compared
as they are.

Edge cases: a null or empty text, or one without words, has no run and an empty collapsed text; rows that repeat an id are rows of their own; a null
id stays; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexmat.llm.textkit import U, mix64, span_hashes, text_chunks, words

MIN_LENGTH, MIN_EXPONENT = 24, 3
#: The least overlap of a run with itself one period on.
GRAM = min(max(MIN_LENGTH - q, (MIN_EXPONENT - 1) * q) for q in range(1, MIN_LENGTH))
_RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _doubled(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the 2k words from each place, from those of k words."""
    return mix64(h[at] * U(0x9E3779B97F4A7C15) + h[at + k])


def seeds(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, lag, place, k) of consecutive occurrences of k-grams whose lag is one that k answers for, sorted."""
    n = len(codes)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    room = bounds[owner + 1] - np.arange(n)
    h, k = codes.copy(), 1
    at = np.arange(n)
    while k < GRAM:
        at = np.flatnonzero(room >= 2 * k)
        h[at] = _doubled(h, at, k)
        k *= 2
    found, lowest = [], 1
    while len(at):
        key = mix64(h[at] + mix64(owner[at].astype(U) + U(1)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        first, second = at[order][:-1][same], at[order][1:][same]
        lag = second - first
        fit = (lag >= lowest) & (lag < k)
        found.append((owner[first[fit]], lag[fit], first[fit], np.full(int(fit.sum()), k)))
        again = np.zeros(n, bool)
        again[first] = again[second] = True
        at = at[again[at] & (room[at] >= 2 * k)]
        at = at[again[at + k]]
        h[at] = _doubled(h, at, k)
        lowest, k = k, 2 * k
    doc, lag, place, size = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
    order = np.lexsort((place, lag, doc))
    return doc[order], lag[order], place[order], size[order]


def _matching(codes: np.ndarray, i: int, lag: int, stop: int, step: int) -> int:
    """How many words from i on (backwards for step -1) equal those ``lag`` further, up to ``stop`` places."""
    done, width = 0, 64
    while done < stop:
        m = min(width, stop - done)
        if step > 0:
            differ = codes[i + done : i + done + m] != codes[i + lag + done : i + lag + done + m]
        else:
            hi = i - done + 1
            differ = (codes[hi - m : hi] != codes[hi - m + lag : hi + lag])[::-1]
        if differ.any():
            return done + int(differ.argmax())
        done, width = done + m, width * 2
    return stop


def find_runs(codes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, start, length, period) of every run, sorted; ``codes`` are the words of all documents, ``bounds`` where each begins."""
    doc, lag, place, size = seeds(codes, bounds)
    out = []
    if not len(doc):
        return out
    edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (lag[1:] != lag[:-1])]))
    for a, b in zip(edge, [*edge[1:], len(doc)], strict=True):
        d, q, begin, end = int(doc[a]), int(lag[a]), int(bounds[doc[a]]), int(bounds[doc[a] + 1])
        while a < b:
            i = int(place[a])
            e = i + int(size[a])
            e += _matching(codes, e, q, end - q - e, 1)
            s = i - _matching(codes, i - 1, q, i - begin, -1)
            if e + q - s >= max(MIN_LENGTH, MIN_EXPONENT * q):
                out.append((d, s - begin, e + q - s, q))
            a += int(np.searchsorted(place[a:b], e))  # up to e this diagonal is covered
    return sorted(out, key=lambda r: (r[0], r[1], r[3]))


def collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words that are in no run past its first period, joined by one space. ``bytes.split`` cuts at the same six bytes."""
    kept = text.split()
    if runs:
        keep = np.ones(len(kept), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        kept = [kept[i] for i in np.flatnonzero(keep)]
    return b" ".join(kept)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_chunks(batches, "text"):
        starts, ends, owner = words(data, offsets)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows.num_rows))])
        runs: list[list[tuple[int, int, int]]] = [[] for _ in range(rows.num_rows)]
        for d, *run in find_runs(span_hashes(data, starts, ends), bounds):
            runs[d].append(tuple(run))
        buffer = data.tobytes()
        texts = [collapsed(buffer[offsets[i] : offsets[i + 1]], r) for i, r in enumerate(runs)]
        named = [[dict(zip(("start", "length", "period"), x, strict=True)) for x in r] for r in runs]
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array(np.diff(bounds)), pa.array(named, _RUN_TYPE), pa.array(texts, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: runs by start and period, and the text without what repeats."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan, f"doc_id long, n_words long, runs {_RUNS}, collapsed string")


def with_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) where a tenth of the documents, by checksum of the id, repeats a part of itself.

    With h = crc32 of the id and g = h div 10, the words i >= a of documents with h % 10 = 0 become word a + (i - a) % p, where a = g % n and
    p = 1 + (n - a) div (3 + g % 8).
    """
    h = F.crc32(F.col(id_col).cast("long").cast("string"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), h.alias("h"))
    found = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size("w").cast("long"), F.expr("h div 10")
    planted = rows.where("h % 10 = 0 AND text IS NOT NULL").select("doc_id", "text", found.alias("w"), g.alias("g"))
    planted = planted.select("doc_id", "text", "w", "g", n.alias("n"), F.expr("g % greatest(size(w), 1)").alias("a"))
    planted = planted.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.expr("slice(flatten(array_repeat(slice(w, int(a) + 1, int(p)), int(ceil((n - a) / p)))), 1, int(n - a))")
    text = F.when(F.col("n") > 0, F.array_join(F.concat(F.expr("slice(w, 1, int(a))"), repeated), " ")).otherwise(F.col("text"))
    return planted.select("doc_id", text.alias("text")).unionByName(rows.where("NOT coalesce(h % 10 = 0 AND text IS NOT NULL, false)").select("doc_id", "text"))


def digest(found: DataFrame) -> DataFrame:
    """The runs of every row in numbers: how many, the one of greatest exponent, and checksums of all of them and of the collapsed text."""
    best = F.reduce(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda x, y: F.when(y.length * x.period > x.length * y.period, y).otherwise(x))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    checksum = lambda text: F.sha2(text, 256)
    part = lambda name: F.col("best")[name]
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), checksum(lines).alias("runs_sha256"), checksum(F.col("collapsed")).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", part("start").alias("start"), part("length").alias("length"), part("period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def oracle() -> str:
    """The same digest in DuckDB SQL: all pairs of equal 16-grams of a document, islands on each diagonal, smallest periods by comparison."""
    return r"""
WITH crc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
  xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda x, v: CASE WHEN v >= 0 THEN xor(x, v) ELSE xor(x >> 1, (x & 1) * 3988292384) END), 4294967295) AS h FROM documents),
w AS (SELECT r, doc_id, h, h // 10 AS g, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM crc),
a AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a FROM w),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM p),
g AS (SELECT r, i, array_to_string(w[i + 1:i + 16], ' ') AS g FROM (SELECT r, w, unnest(range(n - 15)) AS i FROM t WHERE n >= 24)),
d AS (SELECT x.r, y.i - x.i AS q, x.i FROM g x JOIN g y ON x.r = y.r AND x.g = y.g AND x.i < y.i),
k AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM d),
s AS (SELECT r, q, min(i) AS s, max(i) + 16 - min(i) + q AS l FROM k GROUP BY r, q, island HAVING max(i) + 16 - min(i) + q >= greatest(24, 3 * q)),
runs AS (SELECT * FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.r = x.r AND y.q < x.q AND x.q % y.q = 0 AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
best AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY l::DOUBLE / q DESC, s, q) AS nth FROM runs),
sums AS (SELECT r, count(*) AS n_runs, sha256(string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q)) AS told FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
lost AS (SELECT r, list(i) AS l FROM gone GROUP BY r),
kept AS (SELECT t.r, array_to_string(CASE WHEN l IS NULL THEN w ELSE list_transform(list_filter(range(n), lambda i: NOT list_contains(l, i)), lambda i: w[i + 1]) END, ' ') AS k FROM t LEFT JOIN lost USING (r))
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, b.l::BIGINT AS length, q::BIGINT AS period, (1000 * b.l // q)::BIGINT AS exponent_milli,
  coalesce(told, sha256('')) AS runs_sha256, sha256(k) AS collapsed_sha256
FROM t LEFT JOIN sums USING (r) LEFT JOIN (SELECT * FROM best WHERE nth = 1) b USING (r) JOIN kept USING (r)"""
