"""Best-fit packing of token sequences with a grouping genetic algorithm.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens; full pieces are sequences of their own and the rest
is packed. A chromosome is a set of bins. Crossover injects whole well-filled bins of one parent into another,
bins that share a document with them are dissolved (no duplicates), and the displaced documents take the places of smaller ones where that fills
a bin better and are then placed by best fit, longest first; a mutation dissolves the emptiest and some other bins in the same way.

Items are dealt at random into blocks of about ``BLOCK_ITEMS``. Best fit gives each block's first chromosome; a block at its lower bound,
ceil(tokens / capacity), is done (before the last level, one bin above it). All others are evolved on ``ISLANDS`` islands, one task a block and island, for ``EPOCHS`` epochs of ``GENERATIONS``
generations; between epochs every island's elite migrates to both of its neighbours, and a block ends as soon as one of its islands reaches the bound. A
population travels as one row, written after each epoch, so a lost executor repeats one epoch of a few blocks.
Bins filled to ``ACCEPT`` are final; the items of all other
bins go on to the next level, where they meet the left-overs of other blocks, so that the waste of many blocks ends in one.

Words are tokenised once: pre-tokens of Latin texts are looked up in a bounded cache (same ids as the
tokenizer gives for the whole text); every other text goes through the tokenizer as a whole.

Edge cases: a null or empty text is the single end token; ties and repeated rows are packed like any others (an inner row number
tells them apart); a null doc_id is allowed; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexmat.session import materialize

CAPACITY = 2048
BLOCK_ITEMS = 2000
ISLANDS = 4
POPULATION = 8
GENERATIONS = 4
EPOCHS = 4
WELL_FILLED = 0.97
ACCEPT = 0.995
#: Bins of more items are not searched for replacements.
REPLACE_UP_TO = 12
LEVELS = 4
CACHE_RUNS, CACHE_WORDS = 700_000, 200_000
END_ID = 0
#: Pre-tokens of the public vocabulary, and the characters for which the cache is exact (no case or normal-form surprises).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = r"[\t\n\r\x20-\x7e\xa1-ɏ]*"


class WordTokenizer:
    """Little-endian uint32 ids of whole texts; ``<|`` and characters beyond Latin take the tokenizer itself.

    No pre-token reaches over white space, so ids are looked up by run of other characters, then by pre-token.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.find = regex.compile(PRETOKEN).findall
        self.plain = regex.compile(PLAIN).fullmatch
        self.runs: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte-level alphabet: other bytes follow from 256
        other = [b for b in range(256) if b not in set(printable)]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(other)}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, w: str) -> bytes:
        """The ids of one pre-token, straight from the merges."""
        found = self.words.get(w)
        if found is None:
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            spelled = w if w.isascii() else "".join(self.letters[b] for b in w.encode())
            found = self.words[w] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled)])
        return found

    def ids(self, text: str) -> bytes:
        if "<|" in text or not self.plain(text):
            return self.whole(text)
        runs, cache = text.lower().split(), self.runs
        try:
            return b"".join([cache[r] for r in runs])
        except KeyError:
            if len(cache) >= CACHE_RUNS:
                cache.clear()
            for r in runs:
                if r not in cache:
                    cache[r] = b"".join([self.word(w) for w in self.find(r)])
            return b"".join([cache[r] for r in runs])


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = WordTokenizer(path)
        tokenizer = _TOKENIZERS[path]
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                blob = (tokenizer.ids(text) if text else b"") + end
                for k, at in enumerate(range(0, len(blob), 4 * capacity)):
                    part = blob[at : at + 4 * capacity]
                    doc.append(doc_id)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document: (doc_id, piece, start, length, ids_crc32[, ids]); ids are little-endian uint32."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return rows.mapInArrow(_pieces(vocabulary, capacity, with_ids), schema)


class Bins:
    """A chromosome: bins of item numbers, with an index of residual capacities for best fit."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.residual: list[int] = []
        self.by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add_bin(self, items: list[int]) -> None:
        left = self.capacity - sum(self.lengths[i] for i in items)
        self.bins.append(items)
        self.residual.append(left)
        self.by_residual[left].append(len(self.bins) - 1)
        self.mask |= 1 << left

    def replace(self, items: list[int]) -> list[int]:
        """Let displaced items take the place of one or two smaller ones where that fills a bin better; returns who is displaced then."""
        out = sorted((self.lengths[i], i) for i in items)
        for b, left in enumerate(self.residual):
            if not left or not out:
                continue
            own = self.bins[b]
            if len(own) > REPLACE_UP_TO:
                continue
            best, gain = None, 0
            for x, i in enumerate(own):
                for y in range(x, len(own)):
                    size = self.lengths[i] + (self.lengths[own[y]] if y > x else 0)
                    k = bisect_right(out, (size + left, 1 << 60)) - 1
                    if k >= 0 and out[k][0] - size > gain:
                        best, gain = (x, y, k), out[k][0] - size
            if best:
                x, y, k = best
                _, new = out.pop(k)
                for z in {x, y}:
                    insort(out, (self.lengths[own[z]], own[z]))
                self.move(b, left - gain)
                self.bins[b] = [i for z, i in enumerate(own) if z not in (x, y)] + [new]
        return [i for _, i in out]

    def move(self, b: int, left: int) -> None:
        """Bin b has another residual capacity."""
        slot = self.by_residual[self.residual[b]]
        slot.remove(b)
        if not slot:
            self.mask &= ~(1 << self.residual[b])
        self.residual[b] = left
        self.by_residual[left].append(b)
        self.mask |= 1 << left

    def best_fit(self, items: list[int]) -> Bins:
        """Place items, longest first, each into the fullest bin that takes it."""
        for i in sorted(items, key=lambda k: -self.lengths[k]):
            need = self.lengths[i]
            above = self.mask >> need
            if not above:
                self.add_bin([i])
                continue
            left = need + (above & -above).bit_length() - 1
            slot = self.by_residual[left]
            b = slot.pop()
            if not slot:
                self.mask &= ~(1 << left)
            self.bins[b].append(i)
            left -= need
            self.residual[b] = left
            self.by_residual[left].append(b)
            self.mask |= 1 << left
        return self

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones."""
        return len(self.bins), -sum((1 - r / self.capacity) ** 2 for r in self.residual)


def crossover(a: Bins, b: Bins, rng: np.random.Generator) -> Bins:
    """Inject well-filled bins of ``b`` into ``a``."""
    bound = (1 - WELL_FILLED) * b.capacity
    good = [k for k, r in enumerate(b.residual) if r <= bound]
    chosen = [k for k, u in zip(good, rng.random(len(good)), strict=True) if u < 0.5]
    child = Bins(a.lengths, a.capacity)
    taken: set[int] = set()
    for k in chosen:
        child.add_bin(list(b.bins[k]))
        taken.update(b.bins[k])
    displaced: list[int] = []
    for items in a.bins:
        kept = [i for i in items if i not in taken]
        if len(kept) == len(items):
            child.add_bin(list(items))
        else:
            displaced += kept
    return child.best_fit(child.replace(displaced))


def mutate(a: Bins, rng: np.random.Generator) -> Bins:
    """Dissolve the emptiest bins and a few others."""
    n = max(1, len(a.bins) // 20)
    gone = set(np.argsort(a.residual)[::-1][:n].tolist()) | set(rng.integers(0, len(a.bins), n).tolist())
    child = Bins(a.lengths, a.capacity)
    displaced: list[int] = []
    for k, items in enumerate(a.bins):
        if k in gone:
            displaced += items
        else:
            child.add_bin(list(items))
    return child.best_fit(child.replace(displaced))


def evolve(lengths: list[int], capacity: int, seed: int, people: list[Bins], generations: int = GENERATIONS, spare: int = 0) -> list[Bins]:
    """Some generations of one island, from the chromosomes that are here; the best comes first and never gets worse."""
    rng = np.random.default_rng(seed)
    least = -(-sum(lengths) // capacity) + spare
    people = list(people)
    while len(people) < POPULATION:  # other starts: a random part is placed before the rest
        order = rng.permutation(len(lengths)).tolist()
        cut = len(order) // 3
        people.append(Bins(lengths, capacity).best_fit(order[:cut]).best_fit(order[cut:]))
    for _ in range(generations):
        people.sort(key=Bins.fitness)
        if len(people[0].bins) <= least:
            break
        parents = people[: POPULATION // 2]
        pick = lambda: parents[int(rng.integers(len(parents)))]
        children = [crossover(pick(), pick(), rng) for _ in range(POPULATION // 4)]
        children += [mutate(pick(), rng) for _ in range(POPULATION - len(parents) - len(children))]
        people = [*parents, *children]
    people.sort(key=Bins.fitness)
    return people[:POPULATION]


def coded(person: Bins) -> bytes:
    """The bin of each item."""
    bin_of = np.zeros(len(person.lengths), np.int32)
    for k, items in enumerate(person.bins):
        bin_of[items] = k
    return bin_of.tobytes()


def decoded(blob: bytes, lengths: list[int], capacity: int) -> Bins:
    bin_of = np.frombuffer(blob, np.int32)
    person = Bins(lengths, capacity)
    order = np.argsort(bin_of, kind="stable")
    for items in np.split(order, np.flatnonzero(np.diff(bin_of[order])) + 1):
        person.add_bin(items.tolist())
    return person


_STATE = "block long, island int, uids binary, lengths binary, people array<binary>, bins long, waste double, done boolean"


def _state(block: int, island: int, uids: bytes, lengths: bytes, people: list[Bins], spare: int) -> dict:
    bins, waste = people[0].fitness()
    done = bins <= -(-sum(people[0].lengths) // people[0].capacity) + spare
    return {"block": block, "island": island, "uids": uids, "lengths": lengths, "people": [coded(p) for p in people], "bins": bins, "waste": waste, "done": done}


def _start(capacity: int, spare: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)
        lengths = pdf.length.tolist()
        first = Bins(lengths, capacity).best_fit(list(range(len(lengths))))
        return pd.DataFrame([_state(int(pdf.block.iloc[0]), 0, pdf.uid.to_numpy(np.int64).tobytes(), pdf.length.to_numpy(np.int64).tobytes(), [first], spare)])

    return run


def _epoch(capacity: int, epoch: int, spare: int):
    """One epoch of each island: its people, and the elites that came from its neighbours."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for row in pdf.itertuples():
                lengths = np.frombuffer(row.lengths, np.int64).tolist()
                blobs = list(dict.fromkeys([*(b for b in (row.before, row.after) if b is not None), *row.people]))[:POPULATION]
                people = evolve(lengths, capacity, (int(row.block) * ISLANDS + int(row.island)) * EPOCHS + epoch, [decoded(b, lengths, capacity) for b in blobs], spare=spare)
                yield pd.DataFrame([_state(int(row.block), int(row.island), row.uids, row.lengths, people, spare)])

    return run


def _placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each item of the best chromosome of each block."""
    for pdf in parts:
        for row in pdf.itertuples():
            bin_of, length = np.frombuffer(row.person, np.int32), np.frombuffer(row.lengths, np.int64)
            fill = np.bincount(bin_of, length).astype(np.int64)
            yield pd.DataFrame({"block": row.block, "uid": np.frombuffer(row.uids, np.int64), "length": length, "bin": bin_of, "fill": fill[bin_of]})


def evolved(items: DataFrame, capacity: int, epochs: int = EPOCHS, spare: int = 0) -> DataFrame:
    """(block, uid, length, bin, fill) of items (block, uid, length): the best chromosome that each block's islands find.

    A block is done within ``spare`` bins of its lower bound.
    """
    start = materialize(items.groupBy("block").applyInPandas(_start(capacity, spare), _STATE), "pack-start")
    ended = start
    if epochs and start.where("NOT done").limit(1).count():
        ended, state = start.where("done"), start.where("NOT done").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
        none = F.lit(None).cast("binary")
        state = state.withColumns({"before": none, "after": none})
        for epoch in range(epochs):
            # as many tasks as islands: each is a row
            state = materialize(state.repartition("block", "island").mapInPandas(_epoch(capacity, epoch, spare), _STATE), "pack-epoch")
            finished = state.where("done").select("block").distinct()
            last = epoch == epochs - 1
            ended = ended.unionByName(state if last else state.join(finished, "block", "left_semi"))
            state = state.join(finished, "block", "left_anti")
            if last or not state.limit(1).count():
                break
            elite = state.select("block", "island", F.col("people")[0].alias("elite"))
            for name, step in (("before", 1), ("after", ISLANDS - 1)):
                state = state.join(elite.select("block", F.pmod(F.col("island") + step, F.lit(ISLANDS)).alias("island"), F.col("elite").alias(name)), ["block", "island"])
    best = ended.groupBy("block").agg(F.min(F.struct("bins", "waste", "island", F.col("people")[0].alias("person"), "uids", "lengths")).alias("best"))
    return best.select("block", "best.person", "best.uids", "best.lengths").mapInPandas(_placed, "block long, uid long, length long, bin int, fill long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns, ``length`` among them) with sequence_id and offset."""
    # the row number is written with the pieces, so that it never changes
    numbered = materialize(pieces.withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    items = numbered.where(F.col("length") < capacity).select("uid", "length")
    placed = None
    left = items
    for level in range(LEVELS):
        n = left.count()
        if not n:
            break
        blocks = -(-n // BLOCK_ITEMS)
        dealt = left.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(blocks)))
        last = blocks == 1 or level == LEVELS - 1
        # before the last level one bin over the bound will do: its items and those of all under-filled bins are packed again
        final = materialize(evolved(dealt, capacity, spare=0 if last else 1).select(
            "uid", "length", "fill", (F.lit(level << 50) + F.col("block") * (BLOCK_ITEMS * 8) + F.col("bin")).alias("sequence_id")), "pack-level")
        done = final if last else final.where(F.col("fill") >= ACCEPT * capacity)
        placed = done if placed is None else placed.unionByName(done)
        if last:
            break
        left = final.where(F.col("fill") < ACCEPT * capacity).select("uid", "length")
    whole = numbered.where(F.col("length") >= capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"))
    if placed is not None:
        whole = whole.unionByName(placed.select("uid", "sequence_id"))
    joined = numbered.join(whole, "uid")
    # a sequence holds at most ``capacity`` pieces
    before = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "uid").rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("uid")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece."""
    return pack(token_pieces(docs, vocabulary, capacity, id_col, text_col, with_ids), capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
