"""Packing documents into token windows by non-negative least squares.

Every document is cut into full windows and one remainder.  How often each remainder length occurs is a
histogram of at most ``window - 1`` numbers, whatever the number of documents.  Shallow combinations of
lengths that fill a window exactly (one, two or three remainders) are the columns of a matrix; non-negative least
squares gives how often to repeat each, the counts are rounded within the histogram, and the residual
remainders are laid end to end and cut at window bounds.  Only the very last sequence can need padding.

Which piece a remainder becomes depends on its length and its rank among the remainders of that length.
Ranks come from per-task counts and a running sum over tasks, so a length that a third of all documents
share is never gathered.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import STRETCH, encoder, load, uncollected
from .common import Scratch, lean, small_batches


def combinations(hist: np.ndarray, common: int = 48) -> list[tuple[int, ...]]:
    """Length combinations that fill a window of ``len(hist)`` exactly, from lengths that occur.

    All pairs, and triples whose first two lengths are among the ``common`` most frequent: a bound on
    the matrix, not on the documents, as whatever no combination takes is packed greedily.
    """
    window = len(hist)
    there = np.flatnonzero(hist)
    out = [(a, window - a) for a in there.tolist() if a <= window - a and hist[window - a]]
    top = sorted(there[np.argsort(-hist[there], kind="stable")][:common].tolist())
    seen = set(out)
    for i, a in enumerate(top):
        for b in top[i:]:
            c = window - a - b
            if c > 0 and hist[c] and (key := tuple(sorted((a, b, c)))) not in seen:
                seen.add(key)
                out.append(key)
    return out


def nnls_counts(hist: np.ndarray, combos: list[tuple[int, ...]], steps: int = 400) -> np.ndarray:
    """Whole repeat counts: accelerated projected gradient on ||A x - hist||^2 with x >= 0, rounded and kept within hist.

    Rounded down first; then the combinations with the largest fractions get one more, while hist has their lengths.
    """
    if not combos:
        return np.zeros(0, np.int64)
    col = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    row = np.concatenate([np.array(c) for c in combos])
    target = hist.astype(float)
    # a bound of the largest eigenvalue of A^T A: the largest column sum times the largest row sum
    step = 1.0 / (3.0 * max(1, np.bincount(row, minlength=len(hist)).max()))
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        left = np.bincount(row, y[col], minlength=len(hist)) - target
        new = np.maximum(0.0, y - step * np.bincount(col, left[row], minlength=len(combos)))
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y, x = new + (last - 1) / t * (new - x), new
    spare, out = hist.astype(np.int64).copy(), np.zeros(len(combos), np.int64)
    parts = [np.unique(c, return_counts=True) for c in combos]
    whole = np.floor(x).astype(np.int64)
    for more in (whole, (x > whole + 1e-3).astype(np.int64)):
        rank = -x if more is whole else whole - x
        for j in np.argsort(rank, kind="stable").tolist():
            if more[j]:
                at, k = parts[j]
                n = min(int(more[j]), int((spare[at] // k).min()))
                out[j] += n
                spare[at] -= n * k
    return out


class Plan:
    """Where the remainder of rank r among those of its length goes; built on the driver from the histogram alone."""

    def __init__(self, hist: np.ndarray, full: int):
        self.window = window = len(hist)
        combos = combinations(hist)
        counts = nnls_counts(hist, combos)
        runs: dict[int, list[tuple[int, int, int, int]]] = {}  # length -> (first rank, count, first sequence, offset)
        used = np.zeros(window, np.int64)
        seq = full
        for combo, n in zip(combos, counts.tolist(), strict=True):
            if n:
                at = 0
                for length in combo:
                    runs.setdefault(length, []).append((int(used[length]), n, seq, at))
                    used[length] += n
                    at += length
                seq += n
        self.runs = {k: np.array(v, np.int64) for k, v in runs.items()}
        self.used = used
        rest = (hist - used) * np.arange(window)
        self.rest_at = np.cumsum(rest) - rest  # token position of a length's first residual remainder
        self.rest_seq = seq

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """Pieces (start in the remainder, length, sequence, offset)."""
        if rank < self.used[length]:
            runs = self.runs[length]
            first, _, seq, at = runs[np.searchsorted(runs[:, 0], rank, side="right") - 1].tolist()
            return [(0, length, seq + rank - first, at)]
        at = int(self.rest_at[length]) + (rank - int(self.used[length])) * length
        out, done = [], 0
        while done < length:
            seq, off = divmod(at + done, self.window)
            n = min(length - done, self.window - off)
            out.append((done, n, self.rest_seq + seq, off))
            done += n
        return out


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document's ids (then ``end_id``) into sequences of at most ``window`` ids.

    A null or empty text is one piece with just ``end_id``.  Rows are independent documents even if they
    repeat or have a null id; other columns are not read.  An empty table gives an empty result.  Sequence ids and
    offsets have no gaps; only the last sequence may be short.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    model = spark.sparkContext.broadcast(load(tokenizer))

    def tokenize(batches):
        enc = encoder(model.value)
        wide = enc.model.dtype.newbyteorder("<")
        last = np.array([end_id], wide).tobytes()
        task, full, ranks = TaskContext.get().partitionId(), 0, [0] * window
        for batch in small_batches(batches, "text", STRETCH):
            blobs = [ids.astype(wide).tobytes() + last for ids in enc.encode_all([t or "" for t in batch.column(1).to_pylist()])]
            sizes = [len(b) // wide.itemsize for b in blobs]
            firsts, ranked = [], []
            for n in sizes:
                firsts.append(full)
                ranked.append(ranks[n % window])
                full += n // window
                ranks[n % window] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([task] * len(sizes), pa.int64()), pa.array(sizes, pa.int64()), pa.array([n % window for n in sizes], pa.int32()), pa.array(firsts, pa.int64()), pa.array(ranked, pa.int64()), pa.array(blobs, pa.binary())],
                names=["doc_id", "task", "n", "rem", "first", "rank", "ids"],
            )

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    coded = scratch.save(src.mapInArrow(uncollected(tokenize), "doc_id long, task long, n long, rem int, first long, rank long, ids binary"), "ids")
    cells = coded.groupBy("rem", "task").agg(F.count(F.lit(1)).alias("c"), F.sum(F.expr(f"n div {window}")).alias("f"))
    cells = scratch.save(cells, "cells")
    # bounded: at most one row for each remainder length
    hist, full = np.zeros(window, np.int64), 0
    for r in cells.groupBy("rem").agg(F.sum("c").alias("c"), F.sum("f").alias("f")).collect():
        hist[r["rem"]] = r["c"]
        full += r["f"]
    hist[0] = 0
    plan = Plan(hist, full)
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    base = cells.select("rem", "task", F.coalesce(F.sum("c").over(before.partitionBy("rem").orderBy("task")), F.lit(0)).alias("base"))
    task = cells.groupBy("task").agg(F.sum("f").alias("f"))
    task = task.select("task", F.coalesce(F.sum("f").over(before.orderBy("task")), F.lit(0)).alias("full_base"))
    placed = coded.join(base.join(task, "task"), ["rem", "task"])

    def place(batches):
        wide = np.dtype("<u4")
        for batch in small_batches(batches, "ids"):
            cols = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
            out: list[list[int]] = [[] for _ in range(7)]
            for doc, n, rem, first, rank, blob in zip(*(cols[k].to_pylist() for k in ("doc_id", "n", "rem", "first", "rank", "ids")), strict=True):
                ids = np.frombuffer(blob, f"<u{len(blob) // n}").astype(wide)
                pieces = [(k * window, window, first + k, 0) for k in range(n // window)]
                if rem:
                    pieces += [(n - rem + s, size, seq, off) for s, size, seq, off in plan.place(rem, rank)]
                for start, size, seq, off in pieces:
                    for col, v in zip(out, (doc, start, size, zlib.crc32(ids[start : start + size].tobytes()), n, seq, off), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ready = placed.select("doc_id", "n", "rem", (F.col("first") + F.col("full_base")).alias("first"), (F.col("rank") + F.col("base")).alias("rank"), "ids")
    return ready.mapInArrow(lean(place), OUT)
