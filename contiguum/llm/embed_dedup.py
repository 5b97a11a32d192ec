"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within cells, one vector kept per group.

Equal vectors are folded into one with a weight first.  A vector has a home cell (its nearest centroid) and is
a guest in every cell whose centroid is nearly as close (see ``guests``).  Homes are compared
with the homes and guests of their cell in tiles of about ``TILE`` x ``TILE`` (``WIDE`` times as many
guests), so a cell that holds a third of all vectors is many tasks.  Vectors travel in chunks, one row for up to ``PIECE`` vectors of a cell.  A tile returns
link counts and a spanning forest, never its pairs.

No pair is missed.  If x and y with homes c and d have cosine t or more, their gaps <x, c - d> and <y, d - c> add up to
<x - y, c - d> <= sqrt(2 - 2t) |c - d|, so one of them is at most half of that, and that vector is a guest of the other's cell.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import forest
from .common import Scratch, min_label_components
from .vectors import matrix, most_common_dim, unit

TILE = 2048
WIDE = 4  # a block of guests holds so many times as much: each of them takes the homes along
PIECE = 256  # vectors of a chunk at most; a block is the chunks that hash to it, about TILE vectors
COPY = 2000  # work of sending a vector to one more cell, in products of two vectors
CHUNK = pa.schema([("chunk", pa.int64()), ("cell", pa.int32()), ("is_home", pa.bool_()), ("size", pa.int32()), *((k, pa.binary()) for k in ("rep", "w", "v", "home", "top"))])
SLACK = 1e-6  # covers rounding; it only adds guests


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit rows; an empty cluster takes the row that is farthest from its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        sim = x @ c.T
        near, value = sim.argmax(1), sim.max(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.sqrt((total * total).sum(1))
        far = iter(np.argsort(value))
        for j in np.flatnonzero(size < 1e-12):
            total[j] = x[next(far)]
            size[j] = 1.0
        c = total / size[:, None]
    return c


def guests(u: np.ndarray, home: np.ndarray, top: np.ndarray, cells: np.ndarray, cents: np.ndarray, threshold: float) -> np.ndarray:
    """Which unit rows, with their home cells and the cosines to these, belong to which of ``cells``."""
    c = cents[cells]
    apart = np.sqrt(np.maximum(2 - 2 * (cents[home] @ c.T), 0))
    return top[:, None] - u @ c.T <= np.sqrt((1 - threshold) / 2) * apart + SLACK


def cheapest_cells(x: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Centroids fitted on the sample ``x``, as many as make the least work for ``n`` vectors: more cells mean fewer
    products and more guests.  From sqrt(n), 4096 at most, the number is halved as long as the work that a sample of the sample needs falls, to 16 at least."""
    best, least = None, np.inf
    k = int(np.clip(round(n**0.5), 1, min(4096, len(x))))
    while best is None or k >= 16:
        cents = spherical_kmeans(x, k)
        homes, others = np.zeros(k), np.zeros(k)
        for a in range(0, min(len(x), 4096), 512):
            u = x[a : a + 512]
            sim = u @ cents.T
            home = sim.argmax(1)
            homes += np.bincount(home, minlength=k)
            others += guests(u, home, sim.max(1), np.arange(k), cents, threshold).sum(0)
        m = homes.sum()
        others -= homes
        work = COPY * (1 + others.sum() / m) + n * (homes * (homes / 2 + others)).sum() / m**2
        if work >= least:
            break
        best, least, k = cents, work, k // 2
    return best


def runs(kind: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of runs of equal sorted numbers, cut to ``PIECE`` each."""
    ends = np.flatnonzero(np.r_[kind[1:] != kind[:-1], True]) + 1 if len(kind) else np.zeros(0, np.int64)
    return [(k, min(k + PIECE, int(b))) for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True) for k in range(int(a), int(b), PIECE)]


def packed(v: np.ndarray) -> bytes:
    """Vectors as bytes: in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        short = v.astype(np.float32)
    return short.tobytes() if (short == v).all() else v.tobytes()


def opened(chunks: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, weights, unit vectors, home cells and their cosines of some chunks."""
    rep, w, home, top = (np.frombuffer(b"".join(chunks.column(k).to_pylist()), t) for k, t in (("rep", np.int64), ("w", np.int64), ("home", np.int32), ("top", np.float64)))
    some = zip(chunks.column("v").to_pylist(), chunks.column("rep").to_pylist(), strict=True)
    v = [np.frombuffer(x, np.float64 if len(x) == len(r) * dim else np.float32).reshape(-1, dim) for x, r in some]
    return rep, w, unit(np.concatenate(v).astype(np.float64)), home, top


def close(x: np.ndarray, y: np.ndarray, threshold: float):
    """All pairs of unit rows at the threshold or more, for some hundred rows of ``x`` at a time.  Products in single precision choose,
    with room for their rounding; sums of doubles in a fixed order decide."""
    small = y.astype(np.float32).T
    room = np.float32(threshold - 1e-6 * (8 + x.shape[1]))
    for a in range(0, len(x), 256):
        p, q = np.nonzero(x[a : a + 256].astype(np.float32) @ small >= room)
        p += a
        real = np.zeros(len(p), bool)
        for s in range(0, len(p), 1 << 15):
            e = slice(s, s + (1 << 15))
            real[e] = (x[p[e]] * y[q[e]]).sum(1) >= threshold
        if real.any():
            yield p[real], q[real]


def near_duplicates(df: DataFrame, threshold: float = 0.95, sample: int = 20_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Link vectors at cosine >= ``threshold``; one row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, zero, of another dimension than most, or hold null or non-finite components link with
    nothing and are their own component.  Repeated rows are vectors of their own that link with each other.
    A null id is kept with a null component and no links.  Other columns are not read.  ``sample`` bounds the vectors that the
    centroids are fitted on; every vector is indexed.  An empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "cells")
    dim = most_common_dim(df, vec_col)
    src = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))

    def keyed(batches):
        for batch in batches:
            rows, x = matrix(batch.column(1), dim)
            blobs: list = [None] * batch.num_rows
            keys: list = [None] * batch.num_rows
            ids = batch.column(0).to_pylist()
            for r, v in zip(rows.tolist(), x, strict=True):
                if ids[r] is not None:
                    blobs[r] = v.tobytes()
                    keys[r] = hashlib.blake2b(blobs[r], digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())], names=["vec_id", "key", "v"])

    rows = scratch.save(src.mapInArrow(keyed, "vec_id long, key binary, v binary"), "rows")
    folded = rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w"), F.first("v").alias("v"))
    folded = scratch.save(folded, "distinct")
    n = folded.count()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    cut = int((1 << 30) * min(1.0, 1.2 * sample / n))
    drawn = folded.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) <= cut).orderBy(F.xxhash64("key"), "key").limit(sample).select("v").collect()
    x = unit(np.frombuffer(b"".join(r["v"] for r in drawn)).reshape(-1, dim))
    cents = cheapest_cells(x, n, threshold)
    cells = len(cents)
    sent = spark.sparkContext.broadcast(cents)

    step = int(np.clip((1 << 22) // cells, 256, 8192))

    def place(batches):
        c, part, seq = sent.value, TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            v = np.frombuffer(b"".join(batch.column(2).to_pylist())).reshape(-1, dim)
            rep, w = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a in range(0, len(v), step):
                u = unit(v[a : a + step])
                sim = u @ c.T
                home, top = sim.argmax(1), sim.max(1)
                i, j = np.nonzero(guests(u, home, top, np.arange(cells), c, threshold))
                kind = 2 * j + (home[i] != j)
                order = np.argsort(kind, kind="stable")
                i, kind = i[order], kind[order]
                held = [
                    (part + seq + k, int(kind[p]) // 2, not kind[p] % 2, len(m), rep[a + m].tobytes(), w[a + m].tobytes(), packed(v[a + m]), home[m].astype(np.int32).tobytes(), top[m].tobytes())
                    for k, (p, m) in enumerate((p, i[p:q]) for p, q in runs(kind))
                ]
                seq += len(held)
                yield pa.RecordBatch.from_pylist([dict(zip(CHUNK.names, h, strict=True)) for h in held], CHUNK)

    placed = folded.select("rep", "w", "v").mapInArrow(place, "chunk long, cell int, is_home boolean, size int, rep binary, w binary, v binary, home binary, top binary")
    placed = scratch.save(placed, "placed")
    blocks = np.ones((cells, 2), np.int64)  # of homes and guests; bounded: two rows for each cell
    for r in placed.groupBy("cell", "is_home").agg(F.sum("size").alias("n")).collect():
        blocks[r["cell"], 0 if r["is_home"] else 1] = -(-r["n"] // (TILE if r["is_home"] else WIDE * TILE))
    sizes = spark.createDataFrame([(j, int(h), int(g)) for j, (h, g) in enumerate(blocks)], "cell int, homes long, guests long")
    laid = placed.join(F.broadcast(sizes), "cell").withColumn("b", F.pmod(F.xxhash64("chunk"), F.when(F.col("is_home"), F.col("homes")).otherwise(F.col("guests"))))
    # tile (i, j, kind): kind 0 compares home blocks i <= j, kind 1 compares home block i with guest block j
    other = F.sequence(F.lit(0).cast("long"), F.col("homes") - 1)
    guest = F.sequence(F.lit(0).cast("long"), F.col("guests") - 1)
    b = F.col("b")
    among = F.transform(other, lambda o: F.struct(F.least(b, o).alias("i"), F.greatest(b, o).alias("j"), F.lit(0).alias("kind")))
    to_guests = F.transform(guest, lambda o: F.struct(b.alias("i"), o.alias("j"), F.lit(1).alias("kind")))
    to_homes = F.transform(other, lambda o: F.struct(o.alias("i"), b.alias("j"), F.lit(1).alias("kind")))
    tiles = laid.withColumn("t", F.explode(F.when(F.col("is_home"), F.concat(among, to_guests)).otherwise(to_homes)))
    tiles = tiles.select("cell", "t.i", "t.j", "t.kind", "is_home", "b", "rep", "w", "v", "home", "top")

    def compare(table: pa.Table) -> pa.Table:
        cell, i, j, kind = (table.column(k)[0].as_py() for k in ("cell", "i", "j", "kind"))
        at_home = table.column("is_home").to_numpy(zero_copy_only=False)
        block = table.column("b").to_numpy()
        left = at_home & (block == i)
        right = ~at_home & (block == j) if kind else at_home & (block == j)
        out = [np.zeros(0, np.int64)] * 3
        if left.any() and right.any():
            rep, w, u, home, top = opened(table.filter(pa.array(left)), dim)
            same = not kind and i == j
            rep2, w2, u2, home2, _ = (rep, w, u, home, top) if same else opened(table.filter(pa.array(right)), dim)
            back = np.unique(home2)
            links, links2, edges = np.zeros(len(rep)), np.zeros(len(rep2)), []
            for p, q in close(u, u2, threshold):
                if same:
                    once = p != q
                elif kind:  # a pair that both cells would find counts in the smaller one
                    some, at = np.unique(p, return_inverse=True)
                    probes = guests(u[some], home[some], top[some], back, sent.value, threshold)
                    once = ~(probes[at, np.searchsorted(back, home2[q])] & (home2[q] < cell))
                else:
                    once = np.ones(len(p), bool)
                p, q = p[once], q[once]
                links += np.bincount(p, w2[q], len(rep))
                if not same:
                    links2 += np.bincount(q, w[p], len(rep2))
                edges.append(forest(rep[p], rep2[q]))
            reps, links = (rep, links) if same else (np.r_[rep, rep2], np.r_[links, links2])
            some = np.flatnonzero(links)
            up, down = forest(*(np.concatenate([np.zeros(0, np.int64), *e]) for e in zip(*edges, strict=True))) if edges else out[:2]
            out = [np.r_[reps[some], up], np.r_[links[some], down], np.r_[np.zeros(len(some)), np.ones(len(up))]]
        return pa.table({"a": out[0].astype(np.int64), "b": out[1].astype(np.int64), "kind": out[2].astype(np.int64)})

    found = scratch.save(tiles.groupBy("cell", "i", "j", "kind").applyInArrow(compare, "a long, b long, kind long"), "links")
    counts = found.filter("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    comps = min_label_components(scratch, found.filter("kind = 1").select("a", "b")).select(F.col("id").alias("rep"), "component")
    known = folded.select("key", "rep", "w").join(counts, "rep", "left").join(comps, "rep", "left")
    out = rows.select("vec_id", "key").join(known, "key", "left")
    links = F.when(F.col("rep").isNull(), F.lit(0)).otherwise(F.col("w") - 1 + F.coalesce("others", F.lit(0))).cast("long")
    comp = F.coalesce("component", "rep", "vec_id")
    return out.select("vec_id", links.alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept"))
