"""Sharding as vector bin packing: bytes, tokens and rows are balanced jointly.

Rows with equal texts form a group.  Large groups are packed one by one;
all others are dealt by hash into a fixed number of packets of geometrically
falling size.  Items are placed in order of size, each in the shard where the
dot product of its vector with the shard's residual capacity is highest, the
dimension that the law names weighing most.  A group of more than half a
shard is split over its rows.  What reaches the driver is bounded: packets,
and groups above a fixed fraction of the whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.llm.common import Scratch

#: Packets of each of LEVELS sizes; each level's packets hold a quarter of the level's before.
PACKETS, LEVELS = 1024, 6
#: A group counts as large from this part of a shard's share in any dimension on.
LARGE = 1 / 64
#: A group of more than this part of a shard's share is split into pieces of SPLIT_TO of it.
SPLIT_FROM, SPLIT_TO = 1 / 2, 1 / 8
#: Weights of bytes, tokens and rows in the dot product.
WEIGHTS = (8.0, 1.0, 1.0)


def place(items: np.ndarray, shards: int, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """The shard of each item (rows: bytes, tokens, rows), by highest dot product with the residual capacity.

    Ties go to the lowest shard.  Items are taken by falling size; a shard's
    capacity is an equal share of every total, and residuals may fall below 0.
    """
    total = np.maximum(items.sum(axis=0), 1)
    unit = items / (total / shards)
    w = np.asarray(weights)
    residual = np.ones((shards, items.shape[1]))
    out = np.empty(len(items), dtype=np.int64)
    for i in np.argsort(-(unit * w).max(axis=1), kind="stable"):
        out[i] = s = int(np.argmax(residual @ (unit[i] * w)))
        residual[s] -= unit[i]
    _level(items[:, 0], out, shards)
    return out


def _level(size: np.ndarray, shard: np.ndarray, shards: int, moves: int = 2000) -> None:
    """Move single items from the fullest to the emptiest shard while that brings the two nearer."""
    load = np.bincount(shard, weights=size, minlength=shards)
    for _ in range(moves):
        hi, lo = int(load.argmax()), int(load.argmin())
        at = np.flatnonzero(shard == hi)
        gap = load[hi] - load[lo]
        fits = at[(size[at] > 0) & (size[at] < gap)]
        if not len(fits):
            return
        best = fits[np.argmin(np.abs(size[fits] - gap / 2))]
        shard[best] = lo
        load[hi] -= size[best]
        load[lo] += size[best]


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's shard and its slot there, under the law ``bytes``: shard sizes near equal.

    Null text has size 8 and the checksum of no bytes, as an empty text has;
    both fall in one group.  Null ids and repeated rows keep a row each.  An
    empty table gives no rows.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("text_key"), (F.length(text) - F.length(F.translate(text, " \n\t\r", "")) + 1).cast("long").alias("tokens"))
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = scratch.table("rows", rows)
    groups = scratch.table("groups", rows.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")))
    dims = ["bytes", "tokens", "rows"]
    total = np.array([float(v or 0) for v in groups.agg(*[F.sum(d) for d in dims]).first()])
    share = np.maximum(total / shards, 1e-9)
    at_least = F.greatest(*[F.col(d) / F.lit(float(s)) for d, s in zip(dims, share, strict=True)])
    large = groups.filter(at_least >= LARGE).orderBy("text_key").collect()  # at most 3 * shards / LARGE rows
    h = F.xxhash64("text_key")
    level = sum((F.pmod(h, F.lit(4**k)) == 0).cast("int") for k in range(1, LEVELS))
    packet = level * PACKETS + F.pmod(F.xxhash64("text_key", F.lit(1)), F.lit(PACKETS)).cast("int")
    # an item is a packet, numbered from 0, or a piece of a large group, numbered below 0
    pieces: list[tuple[str, int, int]] = []
    first = -1
    for g in large:
        part = max(g[d] / s for d, s in zip(dims, share, strict=True))
        n = min(g["rows"], int(np.ceil(part / SPLIT_TO))) if part > SPLIT_FROM else 1
        pieces.append((g["text_key"], first, n))
        first -= n
    known = docs.sparkSession.createDataFrame(pieces, "large_key string, first int, n int")
    rows = rows.join(F.broadcast(known), rows["text_key"] == known["large_key"], "left")
    piece = F.col("first") - F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int")
    rows = rows.select("doc_id", "size", "text_crc32", "tokens", F.coalesce(piece, packet).alias("item"))
    sums = rows.groupBy("item").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).orderBy("item").collect()  # packets and pieces
    vectors = np.array([[r[d] for d in dims] for r in sums], dtype=np.float64).reshape(-1, 3)
    shard = place(vectors, shards)
    begin, plan = [0] * shards, []
    for r, s in zip(sums, shard.tolist(), strict=True):
        plan.append((r["item"], s, begin[s]))
        begin[s] += r["rows"]
    plan_df = docs.sparkSession.createDataFrame(plan, "item int, shard int, begin long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy("doc_id", "text_crc32", "size"))
    out = rows.join(F.broadcast(plan_df), "item")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begin") + rank - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
