"""Benchmark decontamination by template canonicalisation.

Tokens are runs of letters, digits and non-ASCII bytes (a ``.`` or ``,`` between digits belongs to the number), lower-cased. A token with
a digit becomes the placeholder NUMBER, a unit word after a number UNIT, and capitalised tokens become NAME, a run of them ("New York") one
NAME; the replaced values are the slots. Capitals tell little at the start of a sentence and nothing in lower-cased copies, so every text is read
in three ways: NAME inside sentences only, NAME at their start too, and no NAME. Windows of 8 template tokens are hash-joined with the
windows of the benchmark items in the same reading; a window of nothing but placeholders is compared by its values. Matches are put together along
their diagonal (position in the text minus position in the item); diagonals up to 4 tokens apart count together, so that a word put in or left out doesn't
break a match. A text is contaminated by an item if ``MIN_WINDOWS`` of its windows match there (13 running tokens),
or all windows of a shorter item, and the slots are consistent: an item's value is replaced by one and the same
value all along (at most ``MAX_CONFLICTS`` of the slot values may break this).

Benchmark windows are broadcast only while they are below ``BROADCAST_WINDOWS``; a larger benchmark is joined by a shuffle on
the window's hash.

Edge cases: null or empty texts match nothing; an item with 5 to 7 tokens is one window of all its tokens, and is found where these run; an item
of 1 to 4 tokens is found in texts of the same tokens and nothing else, and one without a token never; repeated items and
rows count once each; a null doc_id is never contaminated; empty tables give no match; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexmat.llm.textkit import LOWER, U, combine, mix64, span_hashes, text_chunks
from plexmat.llm.tuning import unused
from plexmat.session import materialize

WINDOW = 8
MIN_WINDOWS = 6
MIN_ITEM = 5
MAX_CONFLICTS = 0.2
BROADCAST_WINDOWS = 2_000_000
NUMBER, UNIT, NAME = (mix64(np.array([x], U))[0] for x in (101, 102, 103))
#: Unit words.
UNITS = ("mm cm m km kg g mg lb lbs oz ml l litre litres liter liters metre metres meter meters mile miles foot feet inch inches yard yards "
         "second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents "
         "pound pounds degree degrees kilometre kilometres kilometer kilometers gram grams kilogram kilograms").split()  # fmt: skip


def _spans(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = flags.copy()
    first[1:] &= ~flags[:-1]
    cut = offsets[1:-1][offsets[1:-1] < len(flags)]
    first[cut] = flags[cut]
    last = flags.copy()
    last[:-1] &= ~flags[1:]
    before = offsets[1:-1][offsets[1:-1] > 0] - 1
    last[before] |= flags[before]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?:\n"]] = True
_U = "".join(UNITS).encode()
_UNIT_ENDS = np.cumsum([len(u) for u in UNITS])
UNIT_HASHES = np.sort(span_hashes(np.frombuffer(_U, np.uint8), _UNIT_ENDS - [len(u) for u in UNITS], _UNIT_ENDS))


Template = tuple[np.ndarray, np.ndarray, np.ndarray]
READINGS = 3
#: Join codes are the reading times this, plus the window's width; texts of fewer than ``MIN_ITEM`` tokens have a reading of their own.
CODE = 16


def templates(data: np.ndarray, offsets: np.ndarray) -> list[Template]:
    """(template hash, slot value or 0, row) of every token, in each reading; the last list is that of plain values."""
    none = np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)
    if not len(data):
        return [none] * (READINGS + 1)
    token, digit = _ALNUM[data], _DIGIT[data]
    joint = np.zeros(len(data), bool)
    joint[1:-1] = digit[:-2] & digit[2:] & ((data[1:-1] == 46) | (data[1:-1] == 44))
    starts, ends = _spans(token | joint, offsets)
    if not len(starts):
        return [none] * (READINGS + 1)
    rows = np.searchsorted(offsets, starts, "right") - 1
    low = LOWER[data]
    latin = np.zeros(len(data), bool)  # capitals of Latin-1 in UTF-8
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low[latin] += 32
    value = span_hashes(low, starts, ends)
    digits, stops = (np.concatenate([[0], np.cumsum(x)]) for x in (digit, _END[data] & ~joint))
    number = digits[ends] > digits[starts]
    second = np.minimum(starts + 1, len(data) - 1)
    capital = ((data[starts] >= 65) & (data[starts] <= 90)) | latin[second] & (data[starts] == 0xC3)
    same = np.zeros(len(starts), bool)
    same[1:] = rows[1:] == rows[:-1]
    inner = np.zeros(len(starts), bool)
    inner[1:] = same[1:] & (stops[starts[1:]] == stops[ends[:-1]])
    near = np.zeros(len(starts), bool)  # one space behind the token before
    near[1:] = same[1:] & (starts[1:] - ends[:-1] == 1) & (data[starts[1:] - 1] == 0x20)
    unit = np.zeros(len(starts), bool)
    unit[1:] = number[:-1] & same[1:]
    at = np.minimum(np.searchsorted(UNIT_HASHES, value), len(UNIT_HASHES) - 1)
    unit &= ~number & (UNIT_HASHES[at] == value)
    capital &= ~number & ~unit
    plain = np.where(number, NUMBER, np.where(unit, UNIT, value))
    slot = np.where(number | unit, value, U(0))

    def named(name: np.ndarray) -> Template:
        follows = np.zeros(len(name), bool)
        follows[1:] = name[1:] & name[:-1] & near[1:]
        left = np.flatnonzero(~follows)
        last = np.concatenate([left[1:], [len(name)]]) - 1
        is_name, kind, values = name[left], plain[left].copy(), slot[left].copy()
        kind[is_name] = NAME
        values[is_name] = span_hashes(low, starts[left[is_name]], ends[last[is_name]])
        return kind, values, rows[left]

    return [named(capital & inner), named(capital), (plain, slot, rows), (value, np.zeros(len(value), U), rows)]


def _windows(template_hash: np.ndarray, slots: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first token of each window inside one row."""
    grams = combine(template_hash, width)
    if not len(grams):
        return grams, np.zeros(0, np.int64)
    held = np.concatenate([[0], np.cumsum(slots != 0)])
    only = np.flatnonzero(held[width:] - held[:-width] == width)
    if len(only):
        grams = grams.copy()
        grams[only] = mix64(combine(slots, width)[only])
    at = np.flatnonzero(rows[: len(grams)] == rows[width - 1 :])
    return grams[at], at


_SCHEMA = "id long, width int, window long, pos long, slots array<long>, n_tokens long"


def _emit(rows: pa.RecordBatch, owner: np.ndarray, begin: np.ndarray, counts: np.ndarray, reading: int, width: int, grams: np.ndarray, at: np.ndarray, slots: np.ndarray):
    ids = rows.column("id").to_numpy(zero_copy_only=False)
    taken = slots[at[:, None] + np.arange(width)].view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[owner[at]].astype(np.int64)), pa.array(np.full(len(at), reading * CODE + width, np.int32)), pa.array(grams.view(np.int64)),
         pa.array((at - begin[owner[at]]).astype(np.int64)), pa.array(list(taken), pa.list_(pa.int64())), pa.array(counts[owner[at]].astype(np.int64))],
        ["id", "width", "window", "pos", "slots", "n_tokens"])


def _fitting(reading: int, width: int, counts: np.ndarray, of_item: bool) -> np.ndarray | bool:
    """Which windows count: whole texts of few tokens, all tokens of a short item, else any."""
    if reading == READINGS or of_item and width < WINDOW:
        return counts == width
    return True


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_chunks(batches, "text"):
        for reading, (kind, slots, owner) in enumerate(templates(data, offsets)):
            counts = np.bincount(owner, minlength=rows.num_rows)
            begin = np.concatenate([[0], np.cumsum(counts)])
            for width in range(1, MIN_ITEM) if reading == READINGS else range(MIN_ITEM, WINDOW + 1):
                grams, at = _windows(kind, slots, owner, width)
                keep = np.flatnonzero(_fitting(reading, width, counts[owner[at]], True) & np.ones(len(at), bool))
                yield _emit(rows, owner, begin, counts, reading, width, grams[keep], at[keep], slots)


SIEVE_BITS = 24


def _doc_windows(codes: list[int], wanted: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if wanted is not None:
            sieve = np.zeros(1 << SIEVE_BITS, bool)
            sieve[(wanted & U((1 << SIEVE_BITS) - 1)).astype(np.int64)] = True
        for rows, data, offsets in text_chunks(batches, "text"):
            for reading, (kind, slots, owner) in enumerate(templates(data, offsets)):
                counts = np.bincount(owner, minlength=rows.num_rows)
                begin = np.concatenate([[0], np.cumsum(counts)])
                for width in (c % CODE for c in codes if c // CODE == reading):
                    grams, at = _windows(kind, slots, owner, width)
                    if wanted is not None and len(grams):
                        near = np.flatnonzero(sieve[(grams & U((1 << SIEVE_BITS) - 1)).astype(np.int64)])
                        there = np.minimum(np.searchsorted(wanted, grams[near]), len(wanted) - 1)
                        near = near[wanted[there] == grams[near]]
                        grams, at = grams[near], at[near]
                    keep = np.flatnonzero(_fitting(reading, width, counts[owner[at]], False) & np.ones(len(at), bool))
                    if len(keep):
                        yield _emit(rows, owner, begin, counts, reading, width, grams[keep], at[keep], slots)

    return run


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, item_id, counts, n_windows, n_item_windows, n_slots, n_changed, n_conflicts) of the best aligned match of a text and an item.

    ``counts`` tells whether it makes the text contaminated; the best match is one that counts, with the most windows and the fewest conflicts.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    item_windows = materialize(items.mapInArrow(_item_windows, _SCHEMA).dropDuplicates(["id", "width", "window", "pos"]), "template-items")
    codes = sorted(r.width for r in item_windows.select("width").distinct().collect())
    small = item_windows.count() <= broadcast_windows
    wanted = None
    if small:
        keys = item_windows.select("window").distinct().toPandas().window.to_numpy(dtype=np.int64)
        wanted = np.sort(keys.view(U))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    if not codes:
        texts = texts.limit(0)
    found = texts.mapInArrow(_doc_windows(codes, wanted), _SCHEMA).select(
        F.col("id").alias("doc_id"), "width", "window", F.col("pos").alias("at"), F.col("slots").alias("doc_slots"))
    own = item_windows.select(F.col("id").alias("item_id"), "width", "window", "pos", F.col("slots").alias("item_slots"), "n_tokens")
    diagonal = F.col("at") - F.col("pos")
    # two sets of bands of 8 diagonals, 4 apart: diagonals that lie up to 4 apart share a band
    joined = found.join(F.broadcast(own) if small else own, ["width", "window"]).withColumn("reading", F.floor(F.col("width") / CODE)).withColumn(
        "band", F.explode(F.array(2 * F.floor(diagonal / 8), 2 * F.floor((diagonal + 4) / 8) + 1)))
    slots = F.filter(
        F.transform(F.arrays_zip("item_slots", "doc_slots"), lambda x: F.struct(x["item_slots"].alias("i"), x["doc_slots"].alias("d"))),
        lambda x: x["i"] != 0)
    # a window's slot values: at most 8 of them, and a band has 8 times as many windows as the item at most
    aligned = joined.groupBy("doc_id", "item_id", "reading", "band").agg(
        F.count_distinct("pos").alias("n_windows"),
        F.greatest(F.first("n_tokens") - WINDOW + 1, F.lit(1)).alias("n_item_windows"),
        F.array_distinct(F.flatten(F.collect_set(slots))).alias("pairs"),
    ).select(
        "doc_id", "item_id", "n_windows", "n_item_windows",
        F.size("pairs").cast("long").alias("n_slots"),
        F.size(F.filter("pairs", lambda p: p["i"] != p["d"])).cast("long").alias("n_changed"),
        (F.size("pairs") - F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"])))).cast("long").alias("n_conflicts"))
    counts = (F.col("n_windows") >= F.least(F.lit(MIN_WINDOWS), F.col("n_item_windows"))) & (F.col("n_conflicts") <= MAX_CONFLICTS * F.col("n_slots"))
    best = F.max(F.struct(counts.alias("counts"), "n_windows", (-F.col("n_conflicts")).alias("few"), (-F.col("n_changed")).alias("same"), "n_slots", "n_item_windows")).alias("best")
    return aligned.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.counts", "best.n_windows", "best.n_item_windows", "best.n_slots", (-F.col("best.same")).alias("n_changed"), (-F.col("best.few")).alias("n_conflicts"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """The matches that count: enough windows and consistent slots."""
    return matches(docs, benchmark, **columns).where("counts")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: (doc_id, contaminated, n_items, item_id, n_windows, reworded).

    item_id is the smallest matching item, n_windows the most windows of a match, reworded whether every match has changed slots.
    """
    hits = contaminated(docs, benchmark, id_col=id_col).groupBy("doc_id").agg(
        F.count_distinct("item_id").alias("n_items"), F.min("item_id").alias("item_id"), F.max("n_windows").alias("n_windows"),
        (F.min("n_changed") > 0).alias("reworded"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    return ids.join(hits, "doc_id", "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        "item_id", F.coalesce("n_windows", F.lit(0)).alias("n_windows"), F.coalesce("reworded", F.lit(False)).alias("reworded"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the contaminated ones; all columns stay."""
    (gone_id,) = unused(docs, "leaked_id")
    gone = contaminated(docs, benchmark, id_col=id_col).select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(gone_id), "left_anti")
