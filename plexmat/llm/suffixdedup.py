"""Exact substring de-duplication with an enhanced suffix array, anchored so that it spreads over a cluster.

Every window of ``MIN_LENGTH`` bytes picks an anchor, the leftmost of its 32-byte grams with the smallest hash, so equal windows pick
the same anchor at the same place. The suffixes that matter for one anchor gram then lie in one group:

1. pass one counts anchor hashes (partial aggregation); only hashes that occur twice can carry a repeat;
2. pass two cuts, for those anchors, the bytes of the windows they stand for (their context). A bitmap of the repeated
   hashes is broadcast while it is below ``MAX_SIEVE_BITS``; beyond that the places of the anchors are joined to the counts and go back to
   their texts. Contexts that a text has twice, as in a run of equal bytes, are settled there and then and only the first travels;
3. each group collapses equal contexts, sorts the suffixes that start at the anchor (the suffix array), takes the longest
   common prefixes of neighbours and stack-scans them into the tree of common-prefix intervals. The members of an interval are
   scanned in the same way by what stands to their left (left-extension diversity); every set of two or more that can be extended to neither
   side is a maximal repeat, with all its occurrences, and all but the earliest are marked;
4. anchors that occur more than ``GROUP`` times are salted by document and place; each part also reports its distinct windows, whose
   earliest owner over all parts is found by one aggregation, so no hot passage meets in one task.

``repeat_groups`` gives the maximal repeats as a table: repeats of neighbouring anchors with the same occurrences are joined into one.

Edge cases: a null text is empty; texts shorter than ``MIN_LENGTH`` bytes lose nothing; rows that repeat a doc_id with the same text
are one document (both are cut alike, neither for the other's sake); rows that repeat a doc_id with other texts are documents of their own, ordered by a hash of
the text; a null doc_id is neither compared nor changed; an empty table gives an empty result; other columns are not read (``deduplicate`` keeps them,
whatever their names).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexmat.llm.textkit import BYTE_CODE, U, mix64, powers, span_hashes, text_bytes, text_chunks
from plexmat.llm.tuning import by_place
from plexmat.session import materialize

MIN_LENGTH = 100
GRAM = 32
GROUP = 4096
BITS_PER_HASH = 32
MAX_SIEVE_BITS = 1 << 29
PAGE_BITS = 1 << 16


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = MIN_LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, anchor, first window, last window) of every anchor; places count from the start of ``data``."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return np.zeros(0, U), empty, empty, empty, empty
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_CODE[data] * up[:-1], out=total[1:])
    value = mix64((total[gram:] - total[:-gram]) * down[: len(data) - gram + 1])
    least, place = value, np.arange(len(value), dtype=np.int64)
    width, span = length - gram + 1, 1
    while span < width:  # sliding minimum by doubling; the leftmost of equal grams wins
        step = min(span, width - span)
        take = least[step:] < least[:-step]
        place = np.where(take, place[step:], place[:-step])
        least = np.where(take, least[step:], least[:-step])
        span += step
    n_windows = np.maximum(np.diff(offsets) - length + 1, 0)
    rows = np.repeat(np.arange(len(offsets) - 1), n_windows)
    first = np.cumsum(n_windows) - n_windows
    start = np.arange(len(rows)) - first[rows] + offsets[:-1][rows]
    if not len(start):
        return np.zeros(0, U), empty, empty, empty, empty
    at = place[start]
    begin = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (rows[1:] != rows[:-1])]))
    last = np.concatenate([begin[1:], [len(start)]]) - 1
    return value[at[begin]], rows[begin], at[begin], start[begin], start[last]


Places = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def joined(row: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of spans, overlapping ones as one."""
    order = np.lexsort((s, row))
    row, s, e = row[order], s[order], e[order]
    wide = np.int64(1 + (e.max() if len(e) else 0))
    reach = np.maximum.accumulate(row * wide + e)  # rows ascend, so this never reaches into the next one
    first = np.ones(len(s), bool)
    first[1:] = (row[1:] != row[:-1]) | (row[1:] * wide + s[1:] > reach[:-1])
    at = np.flatnonzero(first)
    return row[at], s[at], np.maximum.reduceat(e, at) if len(at) else e


def own_repeats(data: np.ndarray, buffer: bytes, places: Places) -> tuple[Places, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The places whose context doesn't occur earlier in its text, and the spans (row, start, end) of all others."""
    value, row, at, s1, s2 = places
    none = np.zeros(0, np.int64)
    mixed = mix64(value ^ (row.astype(U) * U(0x9E3779B97F4A7C15)))
    order = np.argsort(mixed, kind="stable")
    twice = np.zeros(len(mixed), bool)
    same = mixed[order][1:] == mixed[order][:-1]
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    near = np.flatnonzero(twice)
    if not len(near):
        return places, (none, none, none)
    whole = span_hashes(data, s1[near], s2[near] + MIN_LENGTH) ^ mix64(mixed[near] + (at - s1)[near].astype(U))
    order = np.argsort(whole, kind="stable")  # equal ones stay in text order
    near, whole = near[order], whole[order]
    begin = np.concatenate([[True], whole[1:] != whole[:-1]])
    head = near[np.maximum.accumulate(np.where(begin, np.arange(len(near)), 0))]
    size = s2 + MIN_LENGTH - s1
    gone = [x for x, h in zip(near[~begin].tolist(), head[~begin].tolist(), strict=True)
            if row[x] == row[h] and buffer[s1[x] : s1[x] + size[x]] == buffer[s1[h] : s1[h] + size[h]]]
    left = np.ones(len(value), bool)
    left[gone] = False
    return (value[left], row[left], at[left], s1[left], s2[left]), joined(row[gone], s1[gone], s2[gone] + MIN_LENGTH)


def _read(batches: Iterator[pa.RecordBatch], collapse: bool):
    """(rows, bytes, offsets, places, settled spans) of each chunk of texts."""
    none = np.zeros(0, np.int64)
    for rows, data, offsets in text_chunks(batches, "text"):
        buffer, places, settled = data.tobytes(), anchors(data, offsets), (none, none, none)
        if collapse and len(places[0]):
            places, settled = own_repeats(data, buffer, places)
        yield rows, buffer, offsets, places, settled


def _hashes(collapse: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, places, _ in _read(batches, collapse):
            yield pa.RecordBatch.from_arrays([pa.array(places[0].view(np.int64))], ["hash"])

    return run


def _integers(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _places(collapse: bool):
    """(hash, doc_id, key, nth) of every place: the nth of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _, (value, row, *_), _ in _read(batches, collapse):
            first = np.searchsorted(row, row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.view(np.int64)), pa.array(_integers(rows, "doc_id")[row]), pa.array(_integers(rows, "key")[row]), pa.array((np.arange(len(row)) - first).astype(np.int32))],
                ["hash", "doc_id", "key", "nth"])

    return run


#: A context to be compared, or (``e`` is set) a span that its own text has settled.
_CONTEXT = "hash long, salt int, parts int, doc_id long, key long, s1 long, lead int, context binary, e long"


def _contexts(sieve: np.ndarray | None, hot: np.ndarray | None, parts_of: np.ndarray | None, collapse: bool):
    """Contexts of the places that the sieve lets through or, without a sieve, of those named in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buffer, offsets, (value, row, at, s1, s2), (row_e, s_e, e) in _read(batches, collapse):
            parts = np.ones(len(value), np.int64)
            if sieve is None:
                wanted = rows.column("wanted")
                lists = wanted.to_pylist()
                first = np.searchsorted(row, np.arange(rows.num_rows))
                near = [int(first[i]) + w["nth"] for i, ws in enumerate(lists) for w in ws or ()]
                parts[near] = [w["parts"] for ws in lists for w in ws or ()]
                near = np.sort(np.array(near, np.int64))
            else:
                bit = (value & U(len(sieve) * 8 - 1)).astype(np.int64)
                near = np.flatnonzero((sieve[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
            value, row, at, s1, s2, parts = (x[near] for x in (value, row, at, s1, s2, parts))
            if hot is not None and len(hot) and len(value):
                k = np.minimum(np.searchsorted(hot, value), len(hot) - 1)
                parts = np.where(hot[k] == value, parts_of[k], 1)
            doc, key = _integers(rows, "doc_id"), _integers(rows, "key")
            spot = mix64((doc ^ key).view(U)[row] + ((s1 - offsets[row]) >> 12).astype(U))
            salt = (spot % parts.astype(U)).astype(np.int32)
            context = [buffer[a:b] for a, b in zip(s1.tolist(), (s2 + MIN_LENGTH).tolist(), strict=True)]
            n, m = len(value), len(row_e)
            both = np.concatenate([row, row_e])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([value.view(np.int64), mix64(doc.view(U)[row_e] + s_e.astype(U)).view(np.int64)])),
                 pa.array(np.concatenate([salt, np.zeros(m, np.int32)])), pa.array(np.concatenate([parts, np.ones(m, np.int64)]).astype(np.int32)),
                 pa.array(doc[both]), pa.array(key[both]), pa.array(np.concatenate([s1 - offsets[row], s_e - offsets[row_e]])),
                 pa.array(np.concatenate([at - s1, np.zeros(m, np.int64)]).astype(np.int32)), pa.array([*context, *[None] * m], pa.binary()),
                 pa.array([*[None] * n, *(e - offsets[row_e]).tolist()], pa.int64())],
                ["hash", "salt", "parts", "doc_id", "key", "s1", "lead", "context", "e"])

    return run


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n if not differ else n - 1 - (differ.bit_length() - 1) // 8


def intervals(suffixes: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
    """Stack-scan of a sorted list of suffixes: (common prefix, first, last, parent's common prefix) of each interval."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(suffixes) + 1):
        here = common_prefix(suffixes[i - 1], suffixes[i]) if i < len(suffixes) else -1
        left = i - 1
        while stack and stack[-1][0] > here:
            depth, left = stack.pop()
            yield depth, left, i - 1, max(here, stack[-1][0] if stack else -1)
        if i < len(suffixes) and (not stack or stack[-1][0] < here):
            stack.append((here, left))


Occurrence = tuple[int, int, int]


def repeats(group: list[tuple[int, int, int, int, bytes]], length: int = MIN_LENGTH) -> Iterator[tuple[int, list[Occurrence]]]:
    """Every maximal repeat around one anchor: (length, all its occurrences as sorted (doc_id, key, start)).

    ``group`` holds (doc_id, key, start of the context, bytes before the anchor, context). Extension is judged inside the contexts.
    """
    alike: dict[tuple[int, bytes], set[Occurrence]] = defaultdict(set)
    for doc_id, key, s1, lead, context in group:
        alike[lead, context].add((doc_id, key, s1 + lead))
    for (_, context), places in alike.items():
        if len(places) > 1 and len(alike) == 1:
            lead = next(iter(alike))[0]
            yield len(context), sorted((d, k, at - lead) for d, k, at in places)
    if len(alike) < 2:
        return
    members = sorted((context[lead:], context[:lead][::-1], places) for (lead, context), places in alike.items())
    for right, left, places in members:
        if len(places) > 1:
            yield len(left) + len(right), sorted((d, k, at - len(left)) for d, k, at in places)
    suffixes = [m[0] for m in members]
    for depth, lo, hi, _ in intervals(suffixes):
        order = sorted(range(lo, hi + 1), key=lambda i: members[i][1])
        for before, a, b, _ in intervals([members[i][1] for i in order]):
            if before + depth < length:
                continue
            own = order[a : b + 1]
            if common_prefix(suffixes[min(own)], suffixes[max(own)]) == depth:  # else a deeper interval has it
                yield before + depth, sorted({(d, k, at - before) for i in own for d, k, at in members[i][2]})


_FOUND = "doc_id long, key long, s long, e long, hash long, before int, f1 long, f2 long"


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    spans.sort()
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def _groups(of_group, kinds: list[pa.DataType], names: list[str]):
    """Streams sorted contexts; ``of_group`` turns (hash, parts, members of one anchor and part) into rows. Settled spans pass."""

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, many, group, out = None, 1, [], []
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("hash", "salt", "parts", "doc_id", "key", "s1", "lead", "context", "e")]
            for h, salt, parts, doc_id, key, s1, lead, context, e in zip(*columns, strict=True):
                if e is not None:
                    out.append((doc_id, key, s1, e, *[None] * (len(kinds) - 4)))
                    continue
                if (h, salt) != current:
                    if group:
                        out.extend(of_group(current[0], many, group))
                    current, many, group = (h, salt), parts, []
                group.append((doc_id, key, s1, lead, context))
                if len(out) > 20_000:
                    yield batch(out)
                    out = []
        if group:
            out.extend(of_group(current[0], many, group))
        if out:
            yield batch(out)

    return run


def _marks(anchor: int, parts: int, group: list) -> Iterator[tuple]:
    """Marked spans of one group, and the distinct windows of a salted one."""
    marked: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    if len(group) > 1:
        for size, places in repeats(group):
            for doc_id, key, s in places[1:]:
                marked[doc_id, key].append((s, s + size))
        for (doc_id, key), spans in marked.items():
            for s, e in _merge(spans):
                yield doc_id, key, s, e, None, None, None, None
    if parts > 1:
        seen: dict[tuple[int, bytes], Occurrence] = {}
        for doc_id, key, s1, lead, context in group:
            if (lead, context) not in seen or (doc_id, key, s1) < seen[lead, context]:
                seen[lead, context] = (doc_id, key, s1)
        owner: dict[tuple[int, bytes], Occurrence] = {}
        for (lead, context), (doc_id, key, s1) in seen.items():
            for k in range(len(context) - MIN_LENGTH + 1):
                window = (lead - k, context[k : k + MIN_LENGTH])
                if window not in owner or (doc_id, key, s1 + k) < owner[window]:
                    owner[window] = (doc_id, key, s1 + k)
        for (before, window), (doc_id, key, s) in owner.items():
            digest = hashlib.blake2b(window, digest_size=16).digest()
            yield doc_id, key, s, s + MIN_LENGTH, anchor, before, int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _scan():
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return _groups(_marks, kinds, ["doc_id", "key", "s", "e", "hash", "before", "f1", "f2"])


_LISTED = "doc_id long, key long, s long, e long, shape binary, s0 long, nth long"


def _listed(anchor: int, parts: int, group: list) -> Iterator[tuple]:
    """One row for each occurrence of each maximal repeat. ``shape`` is the same for repeats with the same occurrences but for a shift."""
    if len(group) > 1:
        for size, places in repeats(group):
            s0 = places[0][2]
            shape = hashlib.blake2b(np.array([(d, k, s - s0) for d, k, s in places], np.int64).tobytes(), digest_size=16).digest()
            for nth, (doc_id, key, s) in enumerate(places):
                yield doc_id, key, s, s + size, shape, s0, nth


def _page(pdf: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(PAGE_BITS, np.uint8)
    bits[pdf["place"].to_numpy()] = 1
    return pd.DataFrame({"page": pdf["page"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


def _sieve(repeated: DataFrame, n: int) -> np.ndarray:
    """A bitmap of the repeated hashes, made page by page on Spark; only its bytes reach the driver."""
    bits = 1 << max(PAGE_BITS.bit_length() - 1, (n * BITS_PER_HASH - 1).bit_length())
    bit = F.col("hash").bitwiseAND(F.lit(bits - 1))
    pages = repeated.select(F.floor(bit / PAGE_BITS).cast("long").alias("page"), (bit % PAGE_BITS).cast("int").alias("place"))
    out = np.zeros(bits // 8, np.uint8)
    for row in pages.groupBy("page").applyInPandas(_page, "page long, bits binary").toLocalIterator():
        out[row.page * PAGE_BITS // 8 : (row.page + 1) * PAGE_BITS // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, text): the key tells apart the texts that share a doc_id."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))


def _candidates(texts: DataFrame, max_sieve_bits: int, group: int, collapse: bool) -> DataFrame:
    """Contexts of all anchors that occur twice, those of one anchor and part together and in order."""
    counted = materialize(texts.select("text").mapInArrow(_hashes(collapse), "hash long").groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "suffix-repeated")
    n = counted.count()
    hot = counted.where(F.col("n") > group)
    if n * BITS_PER_HASH <= max_sieve_bits and hot.count() * 64 * 16 <= max_sieve_bits:
        table = hot.toPandas()
        keys = table.hash.to_numpy(dtype=np.int64).view(U)
        order = np.argsort(keys)
        contexts = texts.mapInArrow(_contexts(_sieve(counted, n), keys[order], -(-table.n.to_numpy(dtype=np.int64)[order] // group), collapse), _CONTEXT)
    else:
        parts = F.ceil(F.col("n") / group).cast("int").alias("parts")
        wanted = texts.mapInArrow(_places(collapse), "hash long, doc_id long, key long, nth int").join(counted.select("hash", parts), "hash").distinct().groupBy(
            "doc_id", "key").agg(F.collect_list(F.struct("nth", "parts")).alias("wanted"))
        contexts = texts.join(wanted, ["doc_id", "key"], "left").mapInArrow(_contexts(None, None, None, collapse), _CONTEXT)
    return contexts.repartition("hash", "salt").sortWithinPartitions("hash", "salt")


def repeated_spans(docs: DataFrame, max_sieve_bits: int = MAX_SIEVE_BITS, group: int = GROUP) -> DataFrame:
    """(doc_id, key, spans): for each document with any, the merged spans of bytes whose repeat starts earlier; ``docs`` as ``keyed`` gives them."""
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "key", "text")
    found = materialize(_candidates(texts, max_sieve_bits, group, True).mapInArrow(_scan(), _FOUND), "suffix-found")
    local = found.where("hash IS NULL").select("doc_id", "key", "s", "e")
    owner = Window.partitionBy("hash", "before", "f1", "f2")
    place = F.struct("doc_id", "key", "s")
    across = found.where("hash IS NOT NULL").withColumn("first", F.min(place).over(owner)).where(place > F.col("first")).select("doc_id", "key", "s", "e")
    return local.unionByName(across).groupBy("doc_id", "key").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_sieve_bits: int = MAX_SIEVE_BITS, group: int = GROUP) -> DataFrame:
    """(repeat_id, length, n_occurrences, doc_id, start): the maximal repeats of at least ``MIN_LENGTH`` bytes, a row for each occurrence.

    Repeats around neighbouring anchors that have the same occurrences and overlap are one. Around an anchor that occurs more than
    ``group`` times, repeats are maximal among the occurrences of one part.
    """
    texts = keyed(docs, id_col, text_col).where("doc_id IS NOT NULL AND text IS NOT NULL").distinct()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    listed = materialize(_candidates(texts, max_sieve_bits, group, False).mapInArrow(
        _groups(_listed, kinds, ["doc_id", "key", "s", "e", "shape", "s0", "nth"]), _LISTED).distinct(), "suffix-groups")
    along = Window.partitionBy("shape").orderBy("s", "e")  # the anchors inside one passage
    ends = F.max("e").over(along.rowsBetween(Window.unboundedPreceding, -1))
    sizes = listed.groupBy("shape", "s0").agg((F.max("nth") + 1).alias("n_occurrences"))
    chains = listed.where("nth = 0").withColumn("fresh", F.coalesce(F.col("s") > ends, F.lit(True)).cast("int")).withColumn(
        "chain", F.sum("fresh").over(along)).groupBy("shape", "chain").agg(F.min("s").alias("s0"), (F.max("e") - F.min("s")).alias("length"))
    return listed.select("shape", "s0", "doc_id", "key", "s").distinct().join(chains, ["shape", "s0"]).join(sizes, ["shape", "s0"]).select(
        F.xxhash64("shape", "s0").alias("repeat_id"), "length", "n_occurrences", "doc_id", F.col("s").alias("start"))


def _cut(data: bytes, spans: list[dict] | None) -> tuple[bytes, list[tuple[int, int]]]:
    merged = _merge([(x["s"], x["e"]) for x in spans]) if spans else []
    kept, at = [], 0
    for s, e in merged:
        kept.append(data[at:s])
        at = e
    kept.append(data[at:])
    return b"".join(kept), merged


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = text_bytes(b.column("text"))
        buffer, out = data.tobytes(), []
        for i, spans in enumerate(b.column("spans").to_pylist()):
            text = buffer[offsets[i] : offsets[i + 1]]
            kept, merged = _cut(text, spans)
            out.append((len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest()))
        n, gone, runs, sha = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _rewrite(spans_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = b.schema.get_field_index(text_col)
            data, offsets = text_bytes(b.column(place))
            buffer = data.tobytes()
            kept = []
            for i, (text, spans) in enumerate(zip(b.column(place), b.column(spans_col).to_pylist(), strict=True)):
                # a cut inside a character drops the rest of that character
                kept.append(_cut(buffer[offsets[i] : offsets[i + 1]], spans)[0].decode("utf-8", "ignore") if text.is_valid else None)
            yield b.set_column(place, text_col, pa.array(kept, pa.string())).drop_columns([spans_col])

    return run


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    own = keyed(docs, id_col, text_col)
    return own.join(repeated_spans(own), ["doc_id", "key"], "left").mapInArrow(
        _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated bytes cut from the text; all columns and rows stay."""
    spans = repeated_spans(keyed(docs, id_col, text_col)).select(F.col("doc_id").alias("cut_id"), F.col("key").alias("cut_key"), "spans")
    plain, (own_id, text) = by_place(docs, id_col, text_col)
    marked = plain.join(spans, (F.col(own_id).cast("long") == F.col("cut_id")) & (F.xxhash64(text) == F.col("cut_key")), "left").drop("cut_id", "cut_key")
    return marked.mapInArrow(_rewrite("spans", text), plain.schema).toDF(*docs.columns)
