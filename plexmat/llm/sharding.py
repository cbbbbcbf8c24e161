"""Sharding by vector bin packing.

Documents fall into groups of equal texts; a group is a vector (bytes, tokens, rows). Groups are placed, largest
first, where the dot product of their vector with the residual capacity is highest among the shards whose
residual in bytes is largest enough, so that bytes, tokens and rows fill up together.

Groups above ``1 / (SHARE * shards)`` of a total, of which there are at most ``3 * SHARE * shards``, are placed on the driver. All
others are placed on Spark, each group by itself: they are dealt into cells of about ``CELL_GROUPS`` groups, and a
cell fills its part of what the large groups left of each shard. A cell's loads differ by less than one of its small groups, and cells
begin at different shards, so the sum stays even.

Groups stay whole. Only where whole groups would leave a shard more than ``SLACK`` above the mean in bytes are the largest dealt into pieces: those
over one shard's share first, then over a half, a quarter and so on, as long as that lowers the excess by more than ``SLACK``. A single row is never cut.
Slots are numbered inside (shard, part), with the parts' offsets added, so that no task sorts a whole shard or a hot group.

Edge cases: a null text has size 1 and checksum 0, the same as an empty text; rows that repeat a doc_id are placed and numbered
like any other row; a null doc_id is allowed; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexmat.session import materialize

SHARE = 1024
CELL_GROUPS = 20_000
SLOT_ROWS = 100_000
SLACK = 0.02
TOKEN = r"[^\x20\x09-\x0D]+"


def place(items: np.ndarray, residual: np.ndarray, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each item, what is left of ``residual``); items are rows of (bytes, tokens, rows) as shares of a shard."""
    residual = np.roll(residual, -first, axis=0)
    shards = len(residual)
    out = np.zeros(len(items), np.int32)
    for i in np.argsort(-items.max(axis=1, initial=0), kind="stable"):
        # bytes are the law: only shards that stay within this item of the emptiest one compete
        eligible = residual[:, 0] >= residual[:, 0].max() - items[i, 0] * 0.5 - 1e-12
        fit = np.where(eligible, residual @ items[i], -np.inf)
        out[i] = int(np.argmax(fit))
        residual[out[i]] -= items[i]
    return (out + first) % shards, np.roll(residual, first, axis=0)


def place_large(items: np.ndarray, rows: np.ndarray, shards: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The shards of the pieces of each large group (one piece unless bytes force more), and what is left of each shard."""
    best = None
    for limit in (np.inf, 1.0, 0.5, 0.25, 0.125, 1 / 16, 1 / 32):
        pieces = np.where(items[:, 0] > limit, np.minimum(np.ceil(items[:, 0] / limit), rows), 1).astype(np.int64)
        at, left = place(np.repeat(items / pieces[:, None], pieces, axis=0), np.ones((shards, 3)))
        over = max(SLACK, -left[:, 0].min(initial=0))
        if best is None or over < best[0] - SLACK:  # a finer split has to be worth it
            best = over, pieces, at, left
        if over <= SLACK:
            break
    _, pieces, at, left = best
    return np.split(at, np.cumsum(pieces)[:-1]), left


def _place_small(left: np.ndarray, shards: int):
    """Place the groups of one cell; ``left`` is what the large groups left, as shares of a shard's part of the small ones."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        items = pdf[["bytes", "tokens", "n"]].to_numpy(dtype=float)
        items = items / np.maximum(items.sum(axis=0), 1) * shards
        return pd.DataFrame({"text_key": pdf.text_key, "shard": place(items, left, int(pdf.cell.iloc[0]) % shards)[0]})

    return run


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens) of every row; the law is ``bytes``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = materialize(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.regexp_count(text, F.lit(TOKEN)).cast("long").alias("tokens"),
        F.xxhash64(text).alias("text_key"), F.xxhash64(F.monotonically_increasing_id()).alias("deal")), "shard-base")
    names = ["bytes", "tokens", "n"]
    groups = materialize(base.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "shard-groups")
    total = groups.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names), F.count("*").alias("groups")).first()
    share = np.maximum(np.array([total[c] for c in names], float), 1) / shards
    large = F.greatest(*(F.col(c) / F.lit(max(1.0, x / SHARE)) for c, x in zip(names, share.tolist(), strict=True))) > 1
    # at most 3 * SHARE * shards rows: each takes more than a 1 / (SHARE * shards) share of one of three totals
    top = groups.where(large).orderBy("text_key").toPandas()
    items = top[names].to_numpy(dtype=float) / share
    pieces, left = place_large(items, top.n.to_numpy(dtype=np.int64), shards) if len(top) else ([], np.ones((shards, 3)))
    plan = spark.createDataFrame(list(zip(top.text_key.tolist(), top.n.tolist(), [p.tolist() for p in pieces], strict=True)), "text_key long, n long, shards array<int>")
    rest = np.maximum(shards - items.sum(axis=0), 1e-9) / shards  # the small groups' part of each total
    cells = max(1, -(-int(total.groups) // CELL_GROUPS))
    small = groups.where(~large).withColumn("cell", F.pmod(F.xxhash64(F.lit(2), "text_key"), F.lit(cells))).groupBy("cell").applyInPandas(
        _place_small(left / rest, shards), "text_key long, shard int")
    columns = ["doc_id", "size", "text_crc32", "tokens", "deal"]
    tagged = base.join(F.broadcast(plan), "text_key")
    # the rows of a split group are dealt in turn, within parts of bounded size
    turn = Window.partitionBy("text_key", "sub").orderBy("deal")
    split = tagged.where(F.size("shards") > 1).withColumn("sub", F.pmod("deal", F.ceil(F.col("n") / SLOT_ROWS))).withColumn(
        "piece", F.pmod(F.row_number().over(turn) + F.col("sub"), F.size("shards")))
    placed = tagged.where(F.size("shards") == 1).select(*columns, F.col("shards")[0].alias("shard")).unionByName(
        split.select(*columns, F.element_at("shards", (F.col("piece") + 1).cast("int")).alias("shard"))).unionByName(
        base.join(F.broadcast(plan), "text_key", "left_anti").join(small, "text_key").select(*columns, "shard"))
    parts = max(64, -(-int(total.n) // (shards * SLOT_ROWS)))
    placed = materialize(placed.withColumn("part", F.pmod(F.xxhash64("deal"), F.lit(parts))), "shard-placed")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    offsets = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_slot"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "deal"))
    return placed.withColumn("place", inside).join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first_slot") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens")
