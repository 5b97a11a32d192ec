"""Balanced label propagation: linked documents move to their neighbours' shards under capacity quotas.

Documents with equal texts are linked.  All links of a group are summed up by one row for each (group, shard): the
votes.  In each round the documents that stand outside their group's strongest shard ask to move
there; the driver sees only the matrix of requests between shards, solves the quotas that keep every
shard within its capacity, and each request is granted by a hash of group and round against the granted share.
Documents without links have no preference and fill what is left.  At the end a shard that is over its
size gives its last documents, unlinked ones first, to the free slots of the others, so that counts
are at most one apart.

A group that is larger than a shard is spread over the shards it fills.  No group is gathered anywhere:
votes are partial sums, and ranks come from a range sort that ends on the document id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, numbered, partitions_for


SALTS = 16


def quotas(sizes: np.ndarray, requests: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """Shares (0..1) of the requests from shard i to shard j to grant.

    ``sizes`` counts linked documents by shard.  Starting from granting all, the requests into a
    shard that would pass its capacity are cut back, which keeps more documents in the shards they
    come from; this is repeated until all shards fit or nothing is granted any more.
    """
    share = (requests > 0).astype(float)
    for _ in range(100):
        moved = requests * share
        after = sizes + moved.sum(0) - moved.sum(1)
        over = after - capacity
        if (over <= 0.5).all():
            break
        for j in np.flatnonzero(over > 0.5):
            inflow = moved[:, j].sum()
            if inflow > 0:
                share[:, j] *= max(0.0, 1 - over[j] / inflow)
    return np.where(share < 1e-3, 0.0, share)


def shard(docs: DataFrame, shards: int = 8, rounds: int = 8, slack: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every document into one of ``shards`` shards by the law ``rows``: counts are at most one apart.

    ``slack`` is how far over its size linked documents may fill a shard between rounds; the last step takes the excess out.
    Returns doc_id, size (UTF-8 bytes + 1; a null text has none), text_crc32 (0 for null), law, shard, slot (0-based
    within the shard, without gaps) and grown_shard (null under this law).  Null and empty texts are one
    group.  Repeated rows are documents of their own; null ids are kept, and sort first.  Other columns are not
    read.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("g"),
    )
    base = scratch.save(base, "docs")
    linked = base.groupBy("g").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    n = base.count()
    target = np.array([n // shards + (s < n % shards) for s in range(shards)], dtype=np.int64)
    tasks = partitions_for(spark, n, 1_000_000)
    start = F.pmod(F.xxhash64("doc_id", "g"), F.lit(shards)).cast("int")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")  # a group's row once for each salt, so that a large group is several tasks
    cur = base.withColumn("salt", salt).join(linked.select("g", "members", every), ["g", "salt"], "left").withColumn("label", start)
    cur = scratch.save(cur.withColumn("linked", F.col("members").isNotNull()).drop("members"), "labels")
    for k in range(rounds):
        votes = cur.filter("linked").groupBy("g", "label").agg(F.count(F.lit(1)).alias("c"))
        order = Window.partitionBy("g").orderBy(F.col("c").desc(), F.pmod(F.xxhash64("g", "label"), F.lit(1 << 20)), "label")
        votes = scratch.save(votes.withColumn("to", F.first("label").over(order)), "votes")
        requests, sizes = np.zeros((shards, shards)), np.zeros(shards)
        for r in votes.groupBy("label", "to").agg(F.sum("c").alias("c")).collect():  # at most shards^2 rows
            sizes[r["label"]] += r["c"]
            if r["label"] != r["to"]:
                requests[r["label"], r["to"]] = r["c"]
        share = quotas(sizes, requests, target * (1 + slack))
        granted = (share * requests).sum()
        if granted < 1:
            break
        rows = [(i, j, float(share[i, j])) for i in range(shards) for j in range(shards) if share[i, j] > 0]
        grant = spark.createDataFrame(rows, "label int, to int, share double")  # at most shards^2 rows
        # a whole group's part in a shard moves together, unless it alone is a large part of a shard
        lone = F.when(F.col("c") * 20 > int(target.max()), F.col("doc_id")).otherwise(F.lit(0))
        coin = F.pmod(F.xxhash64("g", "label", lone, F.lit(k)), F.lit(1 << 20)) / float(1 << 20)
        moves = votes.filter("label <> to").join(F.broadcast(grant), ["label", "to"])
        nxt = cur.join(moves.select("g", "label", "to", "share", "c", every), ["g", "label", "salt"], "left")
        nxt = nxt.withColumn("label", F.when(F.col("to").isNotNull() & (coin < F.col("share")), F.col("to")).otherwise(F.col("label")))
        nxt = scratch.save(nxt.select(cur.columns), "labels")
        scratch.drop(votes, cur)
        cur = nxt
    group = F.when(F.col("linked"), F.xxhash64("g")).otherwise(F.lit(0))
    ranked, have = numbered(scratch, cur.withColumn("alone", ~F.col("linked")), [F.col("alone"), group, F.col("g"), F.col("doc_id")], tasks, "label")
    count = np.array([have.get(s, 0) for s in range(shards)])
    over, free = np.maximum(count - target, 0), np.maximum(target - count, 0)
    over_at, free_at = np.cumsum(over) - over, np.cumsum(free) - free
    at = lambda a: F.element_at(F.array(*[F.lit(int(v)) for v in a]).cast("array<long>"), F.col("label") + 1)
    spill = F.when(F.col("idx") >= at(target), F.col("idx") - at(target) + at(over_at))
    out = ranked.withColumn("spill", spill)
    to, slot = F.col("label"), F.col("idx")
    for s in range(shards):
        lo, hi = int(free_at[s]), int(free_at[s] + free[s])
        here = (F.col("spill") >= lo) & (F.col("spill") < hi)
        to = F.when(here, F.lit(s)).otherwise(to)
        slot = F.when(here, F.col("spill") - lo + int(count[s])).otherwise(slot)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), to.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
