"""Language-model scoring by context-tree weighting over bytes.

A text is its UTF-8 bytes with A-Z lower-cased, an end mark, and contexts of the last ``DEPTH`` bytes (end marks before the start). Every byte
is eight binary decisions; for each decision (a node of the byte's binary tree) the contexts of all depths form a
context tree. A context's Krichevsky-Trofimov estimate is mixed with its children's weighted estimates, half and half,
which gives each context the weight of stopping there; a prediction mixes the estimates along the path from depth 0 to the deepest
context seen. The code length in bits divided by the bytes is the usual code length per byte.

Learning runs on Spark: byte n-grams and words are counted per task, then summed by key. The weighted trees below each pair of last
bytes are independent, so one group per pair computes its part; the root and the first level follow from
at most 65,536 pairs of summaries. The group of a pair also has the n-grams of the held-out texts (with no count), and writes the code length of every
n-gram of the table under the whole trees: no context is left out, and no model is collected. The code lengths of the at most ``FREQUENT_GRAMS``
most frequent n-grams and the counts of the at most ``FREQUENT_WORDS`` most frequent words are broadcast; all others are joined with the written tables, so nothing is left out
and no key is hot.

Edge cases: a null or empty text has only the end token and end mark; without training rows every count is 0 and the byte model is
uniform over bits; a null doc_id is held out; repeated rows count each time; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexmat.llm.textkit import LOWER, U, mix64, span_hashes, text_chunks, words
from plexmat.session import materialize

DEPTH = 5
END = 0xFF
FREQUENT_GRAMS = 2_000_000
FREQUENT_WORDS = 800_000
CACHE_BITS = 22
END_WORD = np.int64(-0x123456789ABCDEF)
SMOOTH = 0.1


def byte_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram, row) of every coded byte: newest context byte first, the coded byte last."""
    sizes = np.diff(offsets)
    n = len(sizes)
    padded = np.full(int(sizes.sum()) + (DEPTH + 1) * n, END, np.uint8)
    rows = np.repeat(np.arange(n), sizes)
    padded[np.arange(len(data)) + (DEPTH + 1) * rows + DEPTH] = LOWER[data]
    wide = padded.astype(U)
    gram = np.zeros(len(padded) - DEPTH, U) if len(padded) else np.zeros(0, U)
    for back in range(1, DEPTH + 1):
        gram = (gram << U(8)) | wide[DEPTH - back : len(wide) - back]
    gram = (gram << U(8)) | wide[DEPTH:]
    starts = offsets[:-1] + (DEPTH + 1) * np.arange(n)
    owner = np.repeat(np.arange(n), sizes + 1)
    place = np.arange(len(owner)) - (offsets[:-1] + np.arange(n))[owner] + starts[owner]
    return gram[place], owner


def _tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.concatenate([at, [len(keys)]]))


class _Sums:
    """Running counts of keys with a bounded buffer."""

    def __init__(self, limit: int = 2_000_000):
        self.limit, self.size = limit, 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.parts.append(_distinct(keys))
        self.size += len(self.parts[-1][0])
        if self.size > self.limit:
            kept = self.total()
            self.parts, self.size = [kept], len(kept[0])
            if self.size > self.limit // 2:  # many distinct keys: hand them on, Spark adds them up
                self.parts, self.size = [], 0
                yield kept

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        return _tally(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["kind", "key", "n"])

    grams, vocabulary, ends = _Sums(), _Sums(), 0
    for rows, data, offsets in text_chunks(batches, "text", 1_000_000):
        ends += rows.num_rows
        for k, c in grams.add(byte_grams(data, offsets)[0]):
            yield out(0, k, c)
        low = LOWER[data]
        starts, stops, _ = words(low, offsets)
        for k, c in vocabulary.add(span_hashes(low, starts, stops)):
            yield out(1, k, c)
    for kind, sums in ((0, grams), (1, vocabulary)):
        if sums.parts:
            yield out(kind, *sums.total())
    if ends:
        yield out(1, np.array([END_WORD], np.int64).view(U), np.array([ends]))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, seen) of the n-grams of texts that are not learned."""
    grams = _Sums()

    def out(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(keys), np.int32)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["kind", "key", "seen"])

    for _, data, offsets in text_chunks(batches, "text", 1_000_000):
        for k, c in grams.add(byte_grams(data, offsets)[0]):
            yield out(k, c)
    if grams.parts:
        yield out(*grams.total())


_LGAMMA = np.vectorize(math.lgamma, otypes=[float])
_SMALL = _LGAMMA(np.arange(4096) + 0.5), _LGAMMA(np.arange(8192) + 1.0)


def _lgamma(n: np.ndarray, half: bool) -> np.ndarray:
    """log gamma of n + 1/2 or n + 1 for counts n, by table and by Stirling's series."""
    table = _SMALL[0 if half else 1]
    x = n + (0.5 if half else 1.0)
    big = np.maximum(x, 100.0)
    series = (big - 0.5) * np.log(big) - big + 0.5 * math.log(2 * math.pi) + 1 / (12 * big) - 1 / (360 * big**3)
    return np.where(n < len(table), table[np.minimum(n, len(table) - 1).astype(np.int64)], series)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability."""
    return _lgamma(n0, True) + _lgamma(n1, True) - math.log(math.pi) - _lgamma(n0 + n1, False)


class Level:
    """The nodes of one depth: key = context * 256 + binary node, sorted."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, children: np.ndarray | None):
        self.key, self.n0, self.n1 = key, n0, n1
        own = log_kt(n0, n1)
        if children is None:
            self.weighted, self.stop = own, np.ones(len(key))
        else:
            self.weighted = np.logaddexp(own, children) - math.log(2)
            self.stop = np.exp(np.minimum(own - math.log(2) - self.weighted, 0))

    def parent(self) -> Level:
        """One byte shorter contexts, with the sums of what lies below."""
        key = ((self.key >> U(16)) << U(8)) | (self.key & U(255))
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        add = lambda x: np.add.reduceat(x[order], at)
        return Level(key[at], add(self.n0), add(self.n1), add(self.weighted))


def deepest(gram: np.ndarray, n: np.ndarray) -> Level:
    context, byte = gram >> U(8), gram & U(255)
    keys, zero, one = [], [], []
    for bit in range(8):
        keys.append((context << U(8)) | (U(1 << bit) | (byte >> U(8 - bit))))
        up = (byte >> U(7 - bit)) & U(1)
        one.append(np.where(up == 1, n, 0))
        zero.append(np.where(up == 1, 0, n))
    key, n0, n1 = (np.concatenate(x) for x in (keys, zero, one))
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return Level(key[at], np.add.reduceat(n0[order], at).astype(float), np.add.reduceat(n1[order], at).astype(float), None)


def mixed_down(level: Level, above: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, mixed so far, what is left, chance of a 1 if the path ends here) of a level, from its parents' values."""
    estimate = (level.n1 + 0.5) / (level.n0 + level.n1 + 1)
    if above is None:
        mixed, left = np.zeros(len(level.key)), np.ones(len(level.key))
    else:
        key, a, r = above
        at = np.searchsorted(key, ((level.key >> U(16)) << U(8)) | (level.key & U(255)))
        mixed, left = a[at], r[at]
    return level.key, mixed + left * level.stop * estimate, left * (1 - level.stop), mixed + left * estimate


def _levels(pdf: pd.DataFrame) -> list[Level]:
    """Levels DEPTH down to 2 of one pair of last bytes."""
    pdf = pdf.sort_values("key", ignore_index=True)
    levels = [deepest(pdf.key.to_numpy(dtype=np.int64).view(U), pdf.n.to_numpy(dtype=np.int64))]
    while len(levels) < DEPTH - 1:
        levels.append(levels[-1].parent())
    return levels


def _summary(pdf: pd.DataFrame) -> pd.DataFrame:
    top = _levels(pdf)[-1]
    return pd.DataFrame({"key": top.key.view(np.int64), "n0": top.n0, "n1": top.n1, "weighted": top.weighted})


Table = tuple[np.ndarray, np.ndarray]
NO_NODES: Table = np.zeros(0, U), np.zeros(0)


def _solved(pdf: pd.DataFrame, above: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[Table]:
    """(key, chance) of the nodes of one pair at depths 2 to DEPTH."""
    tables, parents = [], above
    for level in reversed(_levels(pdf)):
        key, mixed, left, chance = mixed_down(level, parents)
        parents = (key, mixed, left)
        tables.append((key, chance))
    return tables


def _nodes(above: tuple[np.ndarray, np.ndarray, np.ndarray]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(
            [pd.DataFrame({"depth": np.int32(depth), "key": key.view(np.int64), "chance": chance}) for depth, (key, chance) in enumerate(_solved(pdf, above), 2)])

    return run


def _lengths(top: list[Table], above: tuple[np.ndarray, np.ndarray, np.ndarray] | None):
    """Code lengths of one pair's n-grams (key, n learned, seen)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        learned = pdf[pdf.n > 0]
        below = _solved(learned, above) if len(learned) else [NO_NODES] * (DEPTH - 1)
        bits = ContextModel([*top, *below]).bits_of(pdf.key.to_numpy(dtype=np.int64).view(U))
        return pd.DataFrame({"key": pdf.key, "bits": bits, "seen": pdf.seen})

    return run


class ContextModel:
    """Chance of a 1 at (context, binary node) for every depth, and code lengths of grams."""

    def __init__(self, tables: list[Table]):
        self.tables = tables

    def bits_of(self, grams: np.ndarray) -> np.ndarray:
        """Code length in bits of distinct grams."""
        bits = np.zeros(len(grams))
        byte = grams & U(255)
        for bit in range(8):
            node = U(1 << bit) | (byte >> U(8 - bit))
            up = ((byte >> U(7 - bit)) & U(1)) == 1
            chance = np.full(len(grams), 0.5)
            todo = np.arange(len(grams))
            for depth in range(DEPTH, -1, -1):  # the deepest context seen at this node
                key, p = self.tables[depth]
                if not len(key) or not len(todo):
                    continue
                want = ((grams[todo] >> U(8 * (DEPTH - depth + 1))) << U(8)) | node[todo]
                at = np.minimum(np.searchsorted(key, want), len(key) - 1)
                hit = key[at] == want
                chance[todo[hit]] = p[at[hit]]
                todo = todo[~hit]
            bits -= np.log2(np.where(up, chance, 1 - chance))
        return bits


class GramTable:
    """Code lengths of the frequent grams (sorted keys)."""

    def __init__(self, key: np.ndarray, bits: np.ndarray):
        self.key, self.bits = key, bits
        self.cache: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return {"key": self.key, "bits": self.bits, "cache": None}

    def bits_of(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.full(len(grams), np.nan)
        at = np.minimum(np.searchsorted(self.key, grams), len(self.key) - 1)
        return np.where(self.key[at] == grams, self.bits[at], np.nan)

    def code_lengths(self, grams: np.ndarray) -> np.ndarray:
        """Code length in bits of each gram, NaN of one that isn't frequent, through a cache of the grams met before."""
        if self.cache is None:
            self.cache = np.zeros(1 << CACHE_BITS, U), np.zeros(1 << CACHE_BITS)
        keys, values = self.cache
        places = self.places(grams)
        hits = [keys[p] == grams + U(1) for p in places]
        out = np.where(hits[0], values[places[0]], values[places[1]])
        missing = np.flatnonzero(~(hits[0] | hits[1]))
        if len(missing):
            fresh, back = np.unique(grams[missing], return_inverse=True)
            bits = self.bits_of(fresh)
            out[missing] = bits[back]
            first, second = self.places(fresh)
            put = np.where(keys[first] == 0, first, second)
            keys[put], values[put] = fresh + U(1), bits
        return out

    @staticmethod
    def places(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two slots of the cache where a gram may stand."""
        h = mix64(grams)
        return (h >> U(64 - CACHE_BITS)).astype(np.int64), (h & U((1 << CACHE_BITS) - 1)).astype(np.int64)


def _arrays(df: DataFrame) -> dict[str, np.ndarray]:
    """A bounded result as columns, over Arrow (rows of Python objects would take ten times the memory)."""
    t = df.toArrow()
    return {c: t.column(c).to_numpy() for c in t.column_names}


def _by_pair(counted: DataFrame):
    return counted.withColumn("pair", F.shiftrightunsigned("key", 8 * (DEPTH - 1))).groupBy("pair")


def _top(counted: DataFrame) -> tuple[list[Table], tuple[np.ndarray, np.ndarray, np.ndarray] | None]:
    """(key, chance) of the nodes at depths 0 and 1 of counted grams (key, n), and what the deeper ones need of them."""
    summary = _arrays(_by_pair(counted).applyInPandas(_summary, "key long, n0 double, n1 double, weighted double"))
    if not len(summary["key"]):
        return [NO_NODES, NO_NODES], None
    order = np.argsort(summary["key"].view(U))
    second = Level.__new__(Level)
    second.key = summary["key"].view(U)[order]
    second.n0, second.n1, second.weighted = (summary[c][order] for c in ("n0", "n1", "weighted"))
    first = second.parent()
    root = first.parent()
    key, mixed, left, chance = mixed_down(root, None)
    tables = [(key, chance)]
    key, mixed, left, chance = mixed_down(first, (key, mixed, left))
    return [*tables, (key, chance)], (key, mixed, left)


def fit(counted: DataFrame) -> ContextModel:
    """The whole model of counted grams (key, n) in one place, for small tables; ``score`` never collects it."""
    tables, above = _top(counted)
    if above is None:
        return ContextModel([*tables, *[NO_NODES] * (DEPTH - 1)])
    nodes = _arrays(_by_pair(counted).applyInPandas(_nodes(above), "depth int, key long, chance double"))
    for depth in range(2, DEPTH + 1):
        key, chance = (nodes[c][nodes["depth"] == depth] for c in ("key", "chance"))
        order = np.argsort(key.view(U))
        tables.append((key.view(U)[order], chance[order]))
    return ContextModel(tables)


def _frequent(counted: DataFrame, most: int, count: str = "n") -> int:
    """The smallest count that at most ``most`` keys reach."""
    steps = counted.groupBy(F.least(F.col(count), F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("keys")).toPandas().sort_values("n", ascending=False)
    fits = steps[steps["keys"].cumsum() <= most]
    return int(fits.n.min()) if len(fits) else 1 << 62


def held_out(doc_id, folds: int):
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(True))


def score(docs: DataFrame, folds: int = 10, id_col: str = "doc_id", text_col: str = "text",
          frequent_grams: int = FREQUENT_GRAMS, frequent_words: int = FREQUENT_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_coded, bits_per_byte) of every row.

    base_score is the smoothed unigram log10 probability of the tokens, score the model's log10 probability of the text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn(
        "held_out", held_out(F.col("doc_id"), folds))
    learned = rows.where("NOT held_out").select("text").mapInArrow(_learn, "kind int, key long, n long").withColumn("seen", F.col("n"))
    others = rows.where("held_out").select("text").mapInArrow(_grams, "kind int, key long, seen long").withColumn("n", F.lit(0).cast("long"))
    counted = materialize(
        learned.unionByName(others).groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")), "ctw-counts")
    grams = counted.where("kind = 0").select("key", "n", "seen")
    lengths = materialize(
        _by_pair(grams).applyInPandas(_lengths(*_top(grams.where("n > 0").select("key", "n"))), "key long, bits double, seen long"), "ctw-lengths")
    least_seen = _frequent(lengths, frequent_grams, "seen")
    frequent = _arrays(lengths.where(F.col("seen") >= least_seen).select("key", "bits"))
    order = np.argsort(frequent["key"].view(U))
    model = GramTable(frequent["key"].view(U)[order], frequent["bits"][order])
    vocabulary = counted.where("kind = 1").select("key", "n")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    scale = total + SMOOTH * (distinct + 1)
    least = _frequent(vocabulary, frequent_words)
    table = _arrays(vocabulary.where(F.col("n") >= least).select("key", "n"))
    order = np.argsort(table["key"].view(U))
    shared = spark.sparkContext.broadcast((model, table["key"].view(U)[order], table["n"][order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known, counts = shared.value
        for b, data, offsets in text_chunks(batches, "text", 500_000):
            grams, owner = byte_grams(data, offsets)
            lengths = own.code_lengths(grams)
            bits = np.bincount(owner, np.nan_to_num(lengths), b.num_rows)
            far = np.flatnonzero(np.isnan(lengths))  # to be looked up among the other grams
            far_ends = np.concatenate([[0], np.cumsum(np.bincount(owner[far], minlength=b.num_rows))]).astype(np.int32)
            low = LOWER[data]
            starts, stops, at = words(low, offsets)
            hashes = np.concatenate([span_hashes(low, starts, stops), np.full(b.num_rows, END_WORD, np.int64).view(U)])
            of = np.concatenate([at, np.arange(b.num_rows)])
            c = np.zeros(len(hashes), np.int64)
            if len(known):
                k = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                c = np.where(known[k] == hashes, counts[k], 0)
            base = np.bincount(of, np.where(c > 0, np.log10((c + SMOOTH) / scale), 0), b.num_rows)
            rare = np.flatnonzero(c == 0)  # to be looked up among the other words
            rare = rare[np.argsort(of[rare], kind="stable")]
            ends = np.concatenate([[0], np.cumsum(np.bincount(of[rare], minlength=b.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(np.bincount(of, minlength=b.num_rows)), pa.array(np.diff(offsets) + 1), pa.array(bits),
                 pa.array(np.bincount(of, c > 0, b.num_rows).astype(np.int64)), pa.array(base), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[rare].view(np.int64))),
                 pa.ListArray.from_arrays(pa.array(far_ends), pa.array(grams[far].view(np.int64)))],
                ["doc_id", "held_out", "n_tokens", "n_coded", "bits", "known", "base", "rare", "far"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_coded long, bits double, known long, base double, rare array<long>, far array<long>"
    scored = materialize(rows.mapInArrow(run, schema).withColumn("uid", F.monotonically_increasing_id()), "ctw-scored")
    # a rare word has fewer than ``least`` occurrences in training, so no key of this join is hot but words never learned
    rare = scored.select("uid", F.explode("rare").alias("key")).join(vocabulary.where(F.col("n") < least), "key", "left").groupBy("uid").agg(
        F.count("n").alias("more"), F.sum(F.log10((F.coalesce("n", F.lit(0)) + SMOOTH) / F.lit(scale))).alias("rest"))
    # every gram has its code length, and one that isn't frequent occurs fewer than ``least_seen`` times in the whole table
    far = scored.select("uid", F.explode("far").alias("key")).join(lengths.where(F.col("seen") < least_seen).select("key", F.col("bits").alias("length")), "key").groupBy(
        "uid").agg(F.sum("length").alias("far_bits"))
    bits = F.col("bits") + F.coalesce("far_bits", F.lit(0.0))
    return scored.drop("rare", "far").join(rare, "uid", "left").join(far, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), (-bits * math.log10(2)).alias("score"), "n_coded",
        (bits / F.col("n_coded")).alias("bits_per_byte"))
