"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Equal vectors form one node (its smallest ids suffice, since ties go to the smaller id), so a vector that
thousands of rows share is one row in a graph. Nodes are dealt into shards of about ``SHARD_NODES`` by a hash; every shard builds its
graph in one task of bounded size, with the largest inner product turned into the nearest Euclidean distance by one more
dimension (single precision, scaled to the largest component, serves the walk only). A shard's index is one row: original vectors, levels and
flat neighbour arrays. One task loads a shard's index once and streams all queries through it with a beam, and the shards' results are merged by one
aggregation of at most ``k + 1`` rows per query and shard. Scores are computed in double precision on the original vectors.

Edge cases: null, zero or empty vectors and vectors with null or non-finite components take no part, nor do rows without an id; vectors of different
lengths never meet (only those of the most frequent length take part); of rows that repeat an id the smallest vector (component by component) stands for it;
with fewer candidates than ``k`` all are returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexmat.session import materialize

SHARD_NODES = 8192
M, M0 = 16, 32
EF_BUILD, EF_SEARCH = 72, 96
BATCH = 256
EXPAND = 4


def unit_scale(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    """Divided by the largest component, of all or of each row: ranks stay and no square leaves the range of a float."""
    return x / np.maximum(np.abs(x).max(axis=axis, keepdims=True, initial=0), np.finfo(float).tiny)


def lift(x: np.ndarray) -> np.ndarray:
    """One more dimension that gives all vectors the same norm: inner products then rank like distances."""
    x = unit_scale(x)
    norms = (x * x).sum(axis=1)
    return np.hstack([x, np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))[:, None]]).astype(np.float32)


class Graph:
    """Flat neighbour arrays, one per level, padded with -1."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, neighbours: list[np.ndarray], entry: int):
        self.vectors, self.levels, self.neighbours, self.entry = vectors, levels, neighbours, entry

    def beam(self, queries: np.ndarray, start: np.ndarray, level: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ef best nodes of a level for each query (ids padded with -1, and inner products), best first."""
        v, links = self.vectors, self.neighbours[level]
        b, n = len(queries), len(v)
        rows = np.arange(b)[:, None]
        seen = np.zeros((b, n + 1), bool)
        seen[:, n] = True
        ids = np.full((b, ef), -1, np.int64)
        sims = np.full((b, ef), -np.inf, np.float32)
        done = np.ones((b, ef), bool)
        width = min(ef, start.shape[1])
        start = start[:, :width]
        ids[:, :width] = start
        sims[:, :width] = np.where(start >= 0, np.einsum("bkd,bd->bk", v[start], queries), -np.inf)
        done[:, :width] = start < 0
        seen[rows, np.where(start >= 0, start, n)] = True
        while True:
            active = np.flatnonzero(~done.all(axis=1))
            if not len(active):
                break
            open_sims = np.where(done[active], -np.inf, sims[active])
            pick = np.argsort(-open_sims, axis=1, kind="stable")[:, : min(EXPAND, ef)]
            real = np.take_along_axis(open_sims, pick, 1) > -np.inf
            chosen = np.where(real, np.take_along_axis(ids[active], pick, 1), -1)
            done[active[:, None], pick] = True
            near = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(active), -1)
            near = np.where(near >= 0, near, n)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            fresh = ~seen[active[:, None], near]
            near = np.where(fresh, near, n)
            seen[active[:, None], near] = True
            found = np.full(near.shape, -np.inf, np.float32)
            r, c = np.nonzero(near < n)
            found[r, c] = np.einsum("nd,nd->n", v[near[r, c]], queries[active[r]])
            all_sims = np.hstack([sims[active], found])
            all_ids = np.hstack([ids[active], np.where(near < n, near, -1)])
            all_done = np.hstack([done[active], near >= n])
            top = np.argsort(-all_sims, axis=1, kind="stable")[:, :ef]
            sims[active], ids[active], done[active] = (np.take_along_axis(x, top, 1) for x in (all_sims, all_ids, all_done))
        return ids, sims

    def search(self, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.full((len(queries), 1), self.entry, np.int64)
        for level in range(len(self.neighbours) - 1, 0, -1):
            at = self.beam(queries, at, level, 4)[0]
        return self.beam(queries, at, 0, ef)


def select(vectors: np.ndarray, base: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
    """Diverse neighbours: a candidate is taken if it is nearer to the base than to every one taken before."""
    b, c = candidates.shape
    safe = np.where(candidates >= 0, candidates, 0)
    v = vectors[safe]
    to_base = np.where(candidates >= 0, np.einsum("bcd,bd->bc", v, vectors[base]), -np.inf)
    order = np.argsort(-to_base, axis=1, kind="stable")
    candidates, to_base = np.take_along_axis(candidates, order, 1), np.take_along_axis(to_base, order, 1)
    v = np.take_along_axis(v, order[:, :, None], 1)
    between = np.matmul(v, v.transpose(0, 2, 1))
    taken = np.zeros((b, c), bool)
    count = np.zeros(b, np.int64)
    closest = np.full((b, c), -np.inf, np.float32)  # to any neighbour taken
    for k in range(c):
        ok = (candidates[:, k] >= 0) & (to_base[:, k] > closest[:, k]) & (count < most)
        taken[:, k] = ok
        count += ok
        closest = np.where(ok[:, None], np.maximum(closest, between[:, k, :]), closest)
    # fill up with the nearest that are left, so that no node stays nearly alone
    rank = np.where(candidates < 0, 3 * c, np.where(taken, 0, c)) + np.arange(c)
    first = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(candidates, first, 1)
    return np.pad(out, ((0, 0), (0, max(0, most - out.shape[1]))), constant_values=-1)


def build(x: np.ndarray, seed: int = 0) -> Graph:
    """Insert all vectors in batches; a batch sees the graph before it and its own members."""
    n = len(x)
    v = lift(x)
    rng = np.random.default_rng(seed)
    levels = np.minimum((-np.log(rng.random(n)) / np.log(M)).astype(int), 4)
    order = np.argsort(-levels, kind="stable")  # upper levels first: the entry point never changes
    neighbours = [np.full((n, M0 if l == 0 else M), -1, np.int64) for l in range(int(levels.max(initial=0)) + 1)]
    graph = Graph(v, levels, neighbours, int(order[0]))
    done = 0
    while done < n:
        size = min(BATCH, n - done, max(32, done))
        batch = order[done : done + size]
        inner = v[batch] @ v[batch].T
        for level in range(len(neighbours) - 1, -1, -1):
            own = np.flatnonzero(levels[batch] >= level)
            if not len(own):
                continue
            nodes, most = batch[own], neighbours[level].shape[1]
            peers = np.where(levels[batch][None, :] >= level, inner[own], -np.inf)
            peers[np.arange(len(own)), own] = -np.inf
            k = min(len(batch), most)
            close = np.argsort(-peers, axis=1, kind="stable")[:, :k]
            near = np.where(np.take_along_axis(peers, close, 1) > -np.inf, batch[close], -1)
            if done:
                at = np.full((len(nodes), 1), graph.entry, np.int64)
                for upper in range(len(neighbours) - 1, level, -1):
                    at = graph.beam(v[nodes], at, upper, 4)[0]
                near = np.hstack([graph.beam(v[nodes], at, level, EF_BUILD)[0], near])
            chosen = select(v, nodes, near, most)
            neighbours[level][nodes] = chosen
            # links back, pruned where a list overflows
            src, dst = np.repeat(nodes, most), chosen.reshape(-1)
            src, dst = src[dst >= 0], dst[dst >= 0]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            targets, begin, counts = np.unique(dst, return_index=True, return_counts=True)
            place = np.arange(len(dst)) - np.repeat(begin, counts)
            for part in np.array_split(np.arange(len(targets)), max(1, len(targets) // BATCH)):
                if not len(part):
                    continue
                extra = np.full((len(part), int(counts[part].max())), -1, np.int64)
                inside = np.flatnonzero(np.isin(dst, targets[part]))
                extra[np.searchsorted(targets[part], dst[inside]), place[inside]] = src[inside]
                old = neighbours[level][targets[part]]
                extra = np.where((extra[:, :, None] == old[:, None, :]).any(axis=2), -1, extra)
                neighbours[level][targets[part]] = select(v, targets[part], np.hstack([old, extra]), most)
        done += size
    return graph


_INDEX = "n int, dim int, entry int, n_levels int, vectors binary, ids binary, offsets binary, levels binary, neighbours binary"


def _index(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The index of each shard in a partition: one row."""
    held = list(parts)
    for shard, pdf in pd.concat(held).groupby("shard") if held else ():
        pdf = pdf.sort_values("rep", ignore_index=True)
        x = np.array(pdf.vector.tolist(), np.float64)
        graph = build(x, int(shard))
        ids = [np.asarray(i, np.int64) for i in pdf.ids]
        yield pd.DataFrame([{
            "shard": int(shard), "n": len(x), "dim": x.shape[1], "entry": graph.entry, "n_levels": len(graph.neighbours), "vectors": x.tobytes(),
            "ids": np.concatenate(ids).tobytes(), "offsets": np.cumsum([0, *map(len, ids)]).astype(np.int64).tobytes(), "levels": graph.levels.astype(np.int8).tobytes(),
            "neighbours": b"".join(a.astype(np.int32).tobytes() for a in graph.neighbours)}])


def load(row: pd.Series) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """(graph, original vectors, ids, offsets into the ids) of an index row."""
    n, dim = int(row["n"]), int(row["dim"])
    x = np.frombuffer(row["vectors"], np.float64).reshape(n, dim)
    flat, links, at = np.frombuffer(row["neighbours"], np.int32), [], 0
    for level in range(int(row["n_levels"])):
        size = n * (M0 if level == 0 else M)
        links.append(flat[at : at + size].reshape(n, -1).astype(np.int64))
        at += size
    graph = Graph(lift(x), np.frombuffer(row["levels"], np.int8), links, int(row["entry"]))
    return graph, x, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["offsets"], np.int64)


def search_block(index: tuple[Graph, np.ndarray, np.ndarray, np.ndarray], names: np.ndarray, q: np.ndarray, k: int, ef: int) -> pd.DataFrame:
    """The k + 1 best rows of one shard for each query, with scores in double precision on the original vectors."""
    graph, x, ids, offsets = index
    lifted = np.hstack([unit_scale(q, axis=1), np.zeros((len(q), 1))]).astype(np.float32)
    out = []
    for i, nodes in enumerate(graph.search(lifted, max(ef, k + 1))[0]):
        nodes = nodes[nodes >= 0]
        exact = x[nodes] @ q[i]
        size = offsets[nodes + 1] - offsets[nodes]
        scores = np.repeat(exact, size)
        own = np.concatenate([ids[offsets[c] : offsets[c + 1]] for c in nodes])
        best = np.lexsort((own, -scores))[: k + 1]  # one more: the query's own row goes later
        out.append(pd.DataFrame({"query": names[i], "vec_id": own[best], "score": scores[best]}))
    return pd.concat(out)


def _search(k: int, ef: int):
    """Streams a shard's rows: its index comes first and is loaded once, the queries follow."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, index = None, None
        for pdf in parts:
            for at, rows in pdf.groupby("shard", sort=False):
                whole = rows[rows.n.notna()]
                if len(whole):
                    shard, index = at, load(whole.iloc[0])
                asked = rows[rows.n.isna()]
                if at != shard or not len(asked):
                    continue
                names, q = asked["query"].to_numpy(dtype=np.int64), np.array(asked.vector.tolist(), np.float64)
                for begin in range(0, len(q), BATCH):
                    yield search_block(index, names[begin : begin + BATCH], q[begin : begin + BATCH], k, ef)

    return run


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    whole = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False)) & F.coalesce(F.exists("vector", lambda c: c != 0), F.lit(False)))


def neighbours(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
               shard_nodes: int = SHARD_NODES, ef: int = EF_SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every row whose id is divisible by ``every``."""
    rows = materialize(valid(df, id_col, vector_col), "hnsw-rows")
    dims = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dims is not None:
        rows = rows.where(F.size("vector") == dims.dim)
    if not rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        rows = materialize(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")), "hnsw-rows")
    by_vector = Window.partitionBy("vector").orderBy("vec_id")
    # the k + 1 smallest ids of equal vectors are all that a result can hold; the limit also applies before the shuffle
    nodes = rows.withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= k + 1).groupBy("vector").agg(
        F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = materialize(nodes, "hnsw-nodes")
    n = nodes.count()
    shards = max(1, -(-n // shard_nodes))
    # one partition a shard, both for the graphs and for the search
    index = materialize(
        nodes.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int")).repartitionById(shards, "shard").mapInPandas(_index, "shard int, " + _INDEX), "hnsw-index")
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = materialize(asked.groupBy("vector").agg(F.min("vec_id").alias("query")), "hnsw-queries")
    dealt = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = dealt.unionByName(index, allowMissingColumns=True).repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("n").isNull())
    found = both.mapInPandas(_search(k, ef), "query long, vec_id long, score double")
    # k + 1 rows per distinct query and shard: merge them, then hand them to the rows that share the vector
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    merged = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).select("query", "vec_id", "score")
    asked_by = asked.join(queries, "vector").select(F.col("vec_id").alias("query_id"), "query")
    mine = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked_by.join(merged, "query").where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
