"""Exact Jaccard join of n-gram sets by adaptive multi-match prefixes.

All shingles have one global order, frequent ones last. Let a set of n shingles need ``need = ceil(0.85 * n)`` common ones with any partner. Its l-prefix is its
first n - need + l shingles: two sets that reach the threshold share at least l shingles inside their l-prefixes, since the l-th
common one leaves at least need - l behind it. A longer prefix costs postings and demands more matches, so it leaves fewer candidates. Each
set chooses its own l from 1, 2, 4, ... by estimated cost; a pair is held to the smaller l of its two sides, which both prefixes cover.

1. Equal sets collapse into a class. The order comes from ``SLOTS`` counters of all shingles of all texts (a table of fixed size): the counter's
   binary logarithm against the mean, then the shingle's hash.
2. Postings of the 1-prefixes are counted by shingle. A set whose 1-prefix meets no other has no partner and goes. For the others the number
   of meetings S gives the cost of each l: ``POSTING * length + S * length / length_1 * (1 + VERIFY * n / l)``. The last term is
   what verifying costs if S meetings make at most S / l candidates (a candidate takes l of them).
3. Postings of the chosen prefixes are written. In each list the member with the most meetings is the hub; a member is verified against the hub that it
   shares most shingles with. That gives most components, by one candidate a set.
   Before a pair's full sets are compared, the parities of its sets bound their difference from below: a set's hashes are dealt into twice as many
   slots as it has shingles, and each slot keeps whether it got an odd number. Slots whose parities differ hold a shingle of one side only.
4. Lists whose members are still in different components are searched across components, whole. In lists of up to ``SMALL`` members the matches of
   each pair are counted, by hub first and then over all lists; pairs with enough of them are verified on full sets. In longer lists a count
   would need all pairs: there members meet block pair by block pair with their sizes and parities, and only a few likely pairs leave a task for
   each two components that they would join. If verification rejects some, they are barred and the next round takes others.

The result is exact: no link between different sets is lost, whatever the order and the costs are.

Edge cases: a null or empty text, or one without words, has an empty set and is linked with nothing; with fewer words than a shingle the whole sequence is
one. Rows that repeat a doc_id are one node: their sets are linked (a row without words stays apart). A row without doc_id is returned
unlinked with a null component. An empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexmat.llm.setlinks import components, confirm, digests, keyed_texts, linked_sql, set_classes, shingle_sets, texts_of
from plexmat.llm.textkit import U, text_chunks
from plexmat.operators.components import connected_components
from plexmat.session import discard, materialize, release_shuffles

SHINGLE = 4
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
MATCHES = [1, 2, 4, 8, 16, 32]
#: Costs in units of one meeting of two postings: a posting, and verifying a candidate for each shingle of its set.
POSTING, VERIFY = 4.0, 0.125
SMALL = 64
#: Postings of short lists that are held at once.
LISTED = 50_000
BLOCK = 1000
#: Pairs of a long list that are verified at once: likely ones for a member and a component, and doubtful ones for a member.
CHOICES, DOUBTFUL = 4, 64
#: Rounds of verification that take likely pairs for links beforehand.
PATIENT = 2
#: A pair is likely a link if its expected difference is at most this part of what the threshold allows.
SURE = 0.9


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, np.int64)
    for _, data, offsets in text_chunks(batches, "text"):
        sets = shingle_sets(data, offsets, SHINGLE)
        if sets:
            total += np.bincount((np.concatenate(sets) >> U(64 - SLOT_BITS)).astype(np.int64), minlength=SLOTS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "n"])


def slot_levels(texts: DataFrame) -> np.ndarray:
    """How frequent the shingles of each slot are: the binary logarithm of the slot's count against the mean, 0 for what lies below it."""
    counted = texts.select("text").mapInArrow(_slot_counts, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SLOTS)
    counts[counted.slot.to_numpy(dtype=np.int64)] = counted.n.to_numpy(dtype=float)
    return np.log2(np.maximum(1, counts / max(counts.mean(), 1e-9))).astype(np.int8)


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with any partner."""
    return -(-percent * n // 100)


def parities(s: np.ndarray) -> bytes:
    """One bit for each of 2n slots (the next power of two, 2 ** 16 at most): whether it holds an odd number of hashes."""
    slots = min(1 << 16, 1 << max(6, int(2 * len(s) - 1).bit_length()))
    return np.packbits(np.bincount((s & U(slots - 1)).astype(np.int64), minlength=slots) & 1, bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of how many hashes only one of two sets has; the longer row of parities is folded to the shorter one's slots."""
    x, y = (np.frombuffer(v, np.uint8) for v in sorted((a, b), key=len))
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _possible(percent: int):
    """Pairs whose parities allow the threshold: with difference d the overlap is at most (n_a + n_b - d) / 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            differ = np.array([least_difference(x, y) for x, y in zip(b.column("bits_a").to_pylist(), b.column("bits_b").to_pylist(), strict=True)], np.int64)
            both = b.column("n_a").to_numpy() + b.column("n_b").to_numpy()
            ok = 100 * (both - differ) >= percent * (both + differ)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], ["a", "b"])

    return run


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_possible(percent), "a long, b long")


def _prefixes(levels: np.ndarray, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches, "text"):
            sets = shingle_sets(data, offsets, SHINGLE)
            first = []
            for s in sets:
                length = len(s) - int(needed(len(s), percent)) + MATCHES[-1]
                order = np.argsort(levels[(s >> U(64 - SLOT_BITS)).astype(np.int64)], kind="stable")  # equal levels stay in the order of the hashes
                first.append(s[order[:length]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("key"), *digests(sets), pa.array(first, pa.list_(pa.int64())), pa.array([parities(s) for s in sets], pa.binary())],
                ["doc_id", "key", "n", "d1", "d2", "tokens", "bits"])

    return run


def prefix_length(matches: Column | int, percent: int) -> Column:
    """n - need + l of the set in columns n, l."""
    return (F.col("n") - F.expr(f"({percent} * n + 99) div 100") + matches).cast("int")


def chosen_matches(percent: int) -> Column:
    """The l of least estimated cost from n and the number of meetings of the 1-prefix; no more than the least overlap."""
    first = prefix_length(1, percent)
    options = []
    for m in MATCHES:
        length = F.least(prefix_length(m, percent), F.col("n").cast("int"))
        cost = POSTING * length + F.col("meetings") * length / first * (1 + VERIFY * F.col("n") / m)
        options.append(F.when(F.lit(m) <= F.expr(f"({percent} * n + 99) div 100"), F.struct(cost.alias("cost"), F.lit(m).alias("matches"))))
    return F.array_min(F.array_compact(F.array(*options)))["matches"]


def met_pairs(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(a, b, least, met): the pairs across components that meet in whole lists, inside both l-prefixes, with their meetings."""
    token, pos, rep, n, matches, comp = (pdf[c].to_numpy() for c in ("token", "pos", "rep", "n", "matches", "comp"))
    edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
    after = np.repeat(edge[1:], np.diff(edge)) - np.arange(len(token)) - 1  # members of its list behind each one
    i = np.repeat(np.arange(len(token)), after)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
    ok = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
    i, j = i[ok], j[ok]
    least = np.minimum(matches[i], matches[j])
    ok = np.ones(len(i), bool)
    for k in (i, j):
        ok &= pos[k] < n[k] - needed(n[k], percent) + least
    i, j, least = i[ok], j[ok], least[ok]
    a, b = np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])
    order = np.lexsort((b, a))
    a, b, least = a[order], b[order], least[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return pd.DataFrame({"a": a[first], "b": b[first], "least": least[first].astype(np.int32), "met": np.diff(np.concatenate([first, [len(a)]]))})


def _small_lists(percent: int):
    """Streams postings sorted by hub and shingle, some whole lists at a time: lists of one hub are neighbours, so a pair's meetings mostly add up here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size >= LISTED:
                whole = pd.concat(held, ignore_index=True)
                cut = int((whole.token != whole.token.iloc[-1]).to_numpy().nonzero()[0].max(initial=-1)) + 1  # the last list may go on
                if cut:
                    yield met_pairs(whole.iloc[:cut], percent)
                held, size = [whole.iloc[cut:]], len(whole) - cut
        if size:
            yield met_pairs(pd.concat(held, ignore_index=True), percent)

    return run


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Rows of parities over fewer slots."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, size), axis=1)


def _large_list(percent: int, nth: int = 0):
    """Pairs within one block pair of a long list that parities allow: for a member and each component that it likely joins the ``CHOICES`` likeliest, and doubtful ones.

    From round ``PATIENT`` on what was rejected tells that likely pairs mislead: no component is taken for joined, and a round tries twice as many as the one before.
    """
    more = max(0, nth - PATIENT + 1)
    choices, doubts = CHOICES << more, DOUBTFUL << more

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf.bi.iloc[0]), int(pdf.bj.iloc[0])
        left, right = (pdf[pdf.block == x].sort_values("rep", ignore_index=True) for x in (i, j))
        rep, n, comp = right.rep.to_numpy(), right.n.to_numpy(), right.comp.to_numpy().copy()
        own_comp = left.comp.to_numpy().copy()
        sizes = np.array([len(x) for x in right.bits], np.int64)
        rows = {s: np.frombuffer(b"".join(right.bits[sizes == s]), np.uint8).reshape(-1, s) for s in np.unique(sizes).tolist()}
        place = np.zeros(len(rep), np.int64)
        for s in rows:
            place[sizes == s] = np.arange((sizes == s).sum())
        links = []
        for k in range(len(left)):
            mine, size = int(left.rep[k]), int(left.n[k])
            ok = (comp != own_comp[k]) & (100 * np.minimum(size, n) >= percent * np.maximum(size, n))
            if i == j:
                ok &= rep > mine
            if left.barred[k] is not None:
                ok &= ~np.isin(rep, left.barred[k])
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            bits, differ = np.frombuffer(left.bits[k], np.uint8)[None], np.zeros(len(at), np.int64)
            for s in np.unique(sizes[at]).tolist():
                those, short = sizes[at] == s, min(s, bits.shape[1])
                differ[those] = np.bitwise_count(folded(rows[s][place[at[those]]], short) ^ folded(bits, short)).sum(axis=1)
            both = size + n[at]
            fits = 100 * (both - differ) >= percent * (both + differ)
            at, both, differ = at[fits], both[fits], differ[fits]
            # slots hide some differences; their expected number tells likely links from doubtful ones
            slots = 8 * np.minimum(sizes[at], bits.shape[1])
            expected = -slots / 2 * np.log(np.maximum(1 - 2 * differ / slots, 1e-9))
            likely = expected <= SURE * both * (100 - percent) / (100 + percent)
            given: dict[int, int] = {}
            doubtful = 0
            for x in np.argsort(differ / both, kind="stable"):
                c = int(comp[at[x]])
                if likely[x]:
                    given[c] = given.get(c, 0) + 1
                elif c in given or doubtful == doubts:
                    continue
                else:
                    doubtful += 1
                if given.get(c, 0) <= choices:
                    links.append((mine, int(rep[at[x]])))
            if given and not more:  # taken for one component from here on
                joined = [*given, int(own_comp[k])]
                one = own_comp[k]
                own_comp[np.isin(own_comp, joined)] = one
                comp[np.isin(comp, joined)] = one
        pairs = pd.DataFrame(links, columns=["a", "b"]).astype("int64")
        return pd.DataFrame({"a": pairs.min(axis=1), "b": pairs.max(axis=1)}).astype("int64")

    return run


def joins_of_long_lists(large: DataFrame, classes: DataFrame, edges: DataFrame, own: DataFrame, percent: int, rounds: int) -> DataFrame:
    """``edges`` and the links that join components within long lists (token, rep, n, size).

    A round takes for granted that likely pairs join their components, and verifies some of each; doubtful pairs are verified without joining
    anything beforehand. Those that are no links are barred, and rounds go on until no possible pair across components is left. Rounds from ``PATIENT`` on take
    nothing for granted and try more pairs each time, so that many rejected pairs between two components don't take as many rounds.
    """
    rejected, labels = None, connected_components(edges, "a", "b")
    for nth in range(rounds):
        comp = large.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
        of_list = Window.partitionBy("token")
        apart = comp.withColumn("lo", F.min("comp").over(of_list)).withColumn("hi", F.max("comp").over(of_list)).where("lo <> hi").join(classes.select("rep", "bits"), "rep")
        if rejected is None:
            apart = apart.withColumn("barred", F.lit(None).cast("array<long>"))
        else:
            ends = rejected.select("a", "b").unionByName(rejected.select(F.col("b").alias("a"), F.col("a").alias("b")))
            apart = apart.join(ends.groupBy(F.col("a").alias("rep")).agg(F.collect_list("b").alias("barred")), "rep", "left")
        n_blocks = F.ceil(F.col("size") / BLOCK)
        # a member meets every block once: as the left side of (block, x) and the right side of (x, block)
        dealt = apart.withColumn("block", F.pmod(F.xxhash64("rep"), n_blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1))).select(
            "token", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "rep", "n", "comp", "bits", "barred")
        tried = materialize(dealt.groupBy("token", "bi", "bj").applyInPandas(_large_list(percent, nth), "a long, b long").distinct(), "join-tried")
        if tried.isEmpty():
            return edges
        found = materialize(confirm(tried, own, percent, SHINGLE), "join-found")
        wrong = materialize(tried.join(found, ["a", "b"], "left_anti"), "join-wrong")
        edges = edges.unionByName(found)
        if wrong.isEmpty():
            return edges
        if not found.isEmpty():
            labels = connected_components(edges, "a", "b")
        rejected = wrong if rejected is None else rejected.unionByName(wrong)
    raise RuntimeError(f"long lists still have likely pairs after {rounds} rounds")


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, rounds: int = 200) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets; component_id is the smallest doc_id reachable by links.
    """
    texts = keyed_texts(docs, id_col, text_col)
    sketched = materialize(texts.mapInArrow(_prefixes(slot_levels(texts), percent), "doc_id long, key long, n long, d1 long, d2 long, tokens array<long>, bits binary"), "join-rows")
    classes = set_classes(sketched, "tokens", "bits")
    rows = materialize(sketched.drop("tokens", "bits"), "join-rows")
    discard(sketched)
    release_shuffles(docs.sparkSession)
    postings = lambda sets, length: sets.select("*", F.posexplode(F.slice("tokens", 1, length)).alias("pos", "token"))

    single = postings(classes.select("rep", "n", "tokens"), prefix_length(1, percent)).select("rep", "token")
    met = single.withColumn("size", F.count("*").over(Window.partitionBy("token"))).where("size > 1")
    meetings = met.groupBy("rep").agg(F.sum(F.col("size") - 1).alias("meetings"))
    active = materialize(classes.select("rep", "n").join(meetings, "rep").withColumn("matches", chosen_matches(percent)), "join-active")
    own = texts_of(active, classes, texts)
    release_shuffles(docs.sparkSession)

    sets = classes.select("rep", "tokens").join(active, "rep")
    listed = postings(sets, prefix_length(F.col("matches"), percent)).select("token", "pos", "rep", "n", "meetings", "matches")
    of_list = Window.partitionBy("token")
    hubs = listed.withColumn("size", F.count("*").over(of_list)).withColumn("top", F.max(F.struct("meetings", "rep", "n", "matches")).over(of_list))
    members = materialize(hubs.where("size > 1"), "join-members")
    release_shuffles(docs.sparkSession)

    # the best hub of each set first; what this leaves apart is compared below
    fits = (F.col("rep") != F.col("top.rep")) & (100 * F.least("n", "top.n") >= percent * F.greatest("n", "top.n"))
    stars = members.where(fits).groupBy("rep", "top.rep").agg(F.count("*").alias("met"), F.first(F.least("matches", "top.matches")).alias("least")) \
        .toDF("rep", "hub", "met", "least").where("met >= least")
    best = stars.groupBy("rep").agg(F.max_by("hub", F.struct("met", "hub")).alias("hub"))
    tested = materialize(best.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct(), "join-tested")
    edges = materialize(confirm(materialize(possible(tested, classes, percent), "join-likely"), own, percent, SHINGLE), "join-edges")

    labels = connected_components(edges, "a", "b")
    placed = members.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "token", "pos", "rep", "n", "meetings", "matches", "size", F.col("top.rep").alias("hub"), F.coalesce("component", "rep").alias("comp"))
    ends = placed.withColumn("lo", F.min("comp").over(of_list)).withColumn("hi", F.max("comp").over(of_list))
    apart = materialize(ends.where("lo <> hi").drop("lo", "hi"), "join-open")
    discard(members)
    release_shuffles(docs.sparkSession)

    small = apart.where(F.col("size") <= SMALL).select("hub", "token", "pos", "rep", "n", "matches", "comp")
    counted = small.repartition("hub").sortWithinPartitions("hub", "token").mapInPandas(_small_lists(percent), "a long, b long, least int, met long")
    enough = counted.groupBy("a", "b").agg(F.sum("met").alias("met"), F.first("least").alias("least")).where("met >= least")
    fresh = materialize(possible(enough.select("a", "b").join(tested, ["a", "b"], "left_anti"), classes, percent), "join-fresh")

    edges = edges.unionByName(materialize(confirm(fresh, own, percent, SHINGLE), "join-edges"))
    large = apart.where(F.col("size") > SMALL).select("token", "rep", "n", "size")
    if not large.isEmpty():
        edges = joins_of_long_lists(large, classes, edges, own, percent, rounds)
    return components(rows, classes, edges).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def oracle() -> str:
    """Components and set sizes from exact set joins in DuckDB SQL, for small tables."""
    return linked_sql(SHINGLE, 85) + """
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.node = d.doc_id"""
