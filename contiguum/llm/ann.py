"""Approximate nearest neighbours by randomly rotated one-bit codes (RaBitQ; Gao and Long, 2024).

Each unit vector is padded with zeros to the length of the code, rotated by one random orthogonal matrix and kept as the signs of its
components, packed into bits, with one correction scalar: its inner product with its own code.  A query's inner product with
the code, divided by the scalar, estimates the cosine without bias, and its error is below
``eps * sqrt((1 - f^2) / f^2 / (bits - 1))`` but for a small probability.  The inner products are read from the packed bits: a query has
one table of 256 sums for each byte of the code.

In each block of vectors, the best estimates are reranked with exact cosines first, which gives a k-th best score; then
every vector whose upper bound reaches that score is reranked too.

Blocks are a table in the shared folder, with the vectors beside their codes: nearly every block has some vector that passes some
query's bound, so that vectors kept apart would be fetched one by one.  Queries pass in chunks of bounded size: one chunk is
sent to the executors, which return at most k ids for each query and block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lean
from .vectors import cosines, matrix, most_common_dim, unit

BLOCK = 8192
BITS = 256
TILE = 64
#: The signs that a byte of a code stands for.
SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1


def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """``dim`` rows of a random orthogonal matrix: what padding to ``bits`` components and rotating does to a vector."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim]


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of rotated unit rows, and each row's inner product with its code."""
    z = x @ turn
    return np.packbits(z >= 0, axis=1), np.abs(z).sum(1) / np.sqrt(turn.shape[1])


def estimates(places: np.ndarray, factor: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Estimated cosines of rotated unit queries (rows) and codes (columns); ``places`` has the codes' bytes, one row for each place."""
    out = np.zeros((len(queries), places.shape[1]), np.float32)
    for q, total in zip(queries, out, strict=True):
        for sums, column in zip(q.astype(np.float32).reshape(-1, 8) @ SIGNS.T, places, strict=True):
            total += sums.take(column)
    return out / (np.float32(np.sqrt(queries.shape[1])) * factor.astype(np.float32))


def bounds(factor: np.ndarray, bits: int, eps: float) -> np.ndarray:
    """How far each vector's estimates may be off."""
    f2 = np.minimum(factor * factor, 1.0)
    return (eps * np.sqrt((1 - f2) / f2 / max(1, bits - 1)) + 1e-6).astype(np.float32)


def build_index(df: DataFrame, turn, dim: int, id_col: str, vec_col: str, scratch: Scratch) -> DataFrame:
    """One row for each block of up to ``BLOCK`` vectors: ids, packed codes, correction scalars, original vectors."""

    def run(batches):
        ids, vecs, held = [], [], 0

        def block():
            i, x = np.concatenate(ids), np.concatenate(vecs)
            code, factor = encode(unit(x), turn.value)
            return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (i, code, factor, x)], names=["ids", "codes", "factor", "vecs"])

        for batch in batches:
            rows, x = matrix(batch.column(1), dim)
            own = np.asarray(batch.column(0).to_numpy(zero_copy_only=False)[rows], np.int64)
            for a in range(0, len(rows), BLOCK):
                ids.append(own[a : a + BLOCK])
                vecs.append(x[a : a + BLOCK])
                held += len(ids[-1])
                if held >= BLOCK:
                    yield block()
                    ids, vecs, held = [], [], 0
        if held:
            yield block()

    src = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return scratch.save(src.mapInArrow(lean(run), "ids binary, codes binary, factor binary, vecs binary"), "codes")


def search_block(ids, codes, factor, vecs, qid, q, turn, k: int, eps: float):
    """The k nearest ids of one block for each query: (query, vector, score) arrays.  Ties go to the smaller id."""
    u, places = unit(vecs), np.ascontiguousarray(codes.T)
    slack = bounds(factor, turn.shape[1], eps)
    first = min(len(ids), 8 * (k + 1))  # reranked at once
    out = []
    for a in range(0, len(qid), TILE):
        tile = q[a : a + TILE]
        est = estimates(places, factor, tile @ turn)
        for j, row in enumerate(est):
            top = np.argpartition(-row, first - 1)[:first]
            top = top[ids[top] != qid[a + j]]
            found = best(np.zeros(len(top), np.int64), ids[top], cosines(u[top], tile[j]), k)
            least = found[2][k - 1] if len(found[2]) == k else -np.inf  # k different ids are at least as near
            rest = np.flatnonzero(row + slack >= least)
            rest = rest[ids[rest] != qid[a + j]]
            found = best(np.zeros(len(rest), np.int64), ids[rest], cosines(u[rest], tile[j]), k)
            out.append((np.full(len(found[1]), a + j), found[1], found[2]))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else None


def best(q, i, s, k: int):
    """The k best different ids of each query; an id counts with its best score."""
    order = np.lexsort((-s, i, q))
    q, i, s = q[order], i[order], s[order]
    new = np.r_[True, (q[1:] != q[:-1]) | (i[1:] != i[:-1])] if len(q) else np.zeros(0, bool)
    q, i, s = q[new], i[new], s[new]
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    start = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
    return q[rank < k], i[rank < k], s[rank < k]


def nearest(df: DataFrame, queries: DataFrame, k: int = 5, eps: float = 3.0, seed: int = 11, chunk: int = 4096, bits: int = BITS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows of ``df`` by cosine for each row of ``queries``: query_id, rank, vec_id, score.

    Vectors that are null, zero, of another dimension, or hold null or non-finite components take no part, and
    neither do null ids.  A row with the query's own id is no candidate.  Equal scores rank by id; an id that ``df`` has
    several times is found once, with its best score; a repeated query counts once (if its vectors differ, the one that
    compares smallest).  Empty tables give an empty result.  ``bits`` is the length of a code, at least the dimension.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "ann")
    dim = most_common_dim(df, vec_col)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    turn = spark.sparkContext.broadcast(rotation(dim, -(-max(dim, bits) // 8) * 8, seed))
    index = build_index(df, turn, dim, id_col, vec_col, scratch)
    asked = queries.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    parts = max(1, -(-asked.count() // chunk))
    found = None
    for p in range(parts):
        # bounded: one chunk of queries, about ``chunk`` rows by hash
        rows = asked.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == p).toArrow().combine_chunks()
        at, q = matrix(rows.column("v"), dim)
        qid = np.asarray(rows.column("id").to_numpy()[at], np.int64) if len(at) else np.zeros(0, np.int64)
        sent = spark.sparkContext.broadcast((qid, unit(q) if len(at) else q))

        def run(batches, sent=sent):
            qid, q = sent.value
            for batch in batches:
                for i, c, f, v in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                    ids = np.frombuffer(i, np.int64)
                    n = len(ids)
                    got = search_block(ids, np.frombuffer(c, np.uint8).reshape(n, -1), np.frombuffer(f), np.frombuffer(v).reshape(n, dim), qid, q, turn.value, k, eps) if len(qid) else None
                    if got is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(qid[got[0]]), pa.array(got[1]), pa.array(got[2])], names=["query_id", "vec_id", "score"])

        part = index.mapInArrow(lean(run), "query_id long, vec_id long, score double")
        part = part.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        # k rows of each query and salt, then k rows of each query
        part = part.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(32)))
        nearest_first = (F.col("score").desc(), F.col("vec_id"))
        local = Window.partitionBy("query_id", "salt").orderBy(*nearest_first)
        part = part.withColumn("r", F.row_number().over(local)).filter(F.col("r") <= k)
        whole = Window.partitionBy("query_id").orderBy(*nearest_first)
        part = part.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)
        part = scratch.save(part.select("query_id", "rank", "vec_id", "score"), "found")
        found = part if found is None else found.union(part)
    return found
