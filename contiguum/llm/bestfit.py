"""Packing documents whole into as few sequences as can be: a configuration linear program over the length histogram.

Only documents longer than a sequence are cut; what is over comes first, as a piece of its own, and full pieces fill sequences of their own.  So the
problem is bin packing of at most ``capacity`` lengths, each with a count, whatever the number of documents.

A *configuration* is a multiset of lengths that fits a sequence.  The linear program asks how often to use each, so that all lengths are
covered with the fewest sequences.  It is solved by multiplicative weights: a length's weight falls exponentially with
the share of it that is covered, a knapsack over the weights prices all configurations in one table of ``capacity`` entries, and the best
ones take a step, rounded to whole sequences.  What is left, lengths too rare for a step above all, goes where it fits best.

Which sequence a piece gets depends on its length and its rank among the pieces of that length; ranks come from counts of each
task and a running sum over tasks, so a length that a third of all documents share is never gathered.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet, load
from .common import Scratch, hold, lean, small_batches

Config = tuple[tuple[int, int], ...]  # (length, how often), longest first


class Prices:
    """The knapsack of a round: the best value at every size, and from it the best configuration through any length."""

    def __init__(self, lengths: np.ndarray, values: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
        for size in range(1, capacity + 1):
            n = upto[size]
            best[size], pick[size] = best[size - 1], -1
            if n:
                with_one = values[:n] + best[size - lengths[:n]]
                k = int(with_one.argmax())
                if with_one[k] > best[size]:
                    best[size], pick[size] = with_one[k], k
        self.best, self.pick = best.tolist(), pick.tolist()

    def through(self, k: int) -> dict[int, int]:
        """Numbers of lengths with how often: the one asked for, and the best that fits beside it."""
        out = {k: 1}
        size = self.capacity - int(self.lengths[k])
        while size > 0:
            j = self.pick[size]
            if j < 0:
                size -= 1
            else:
                out[j] = out.get(j, 0) + 1
                size -= int(self.lengths[j])
        return out


def cover(hist: np.ndarray, rounds: int = 400, step: float = 0.03, rate: float = 3.0, slack: float = 0.1, rare: int = 10) -> tuple[Counter, np.ndarray]:
    """Configurations with how often, in whole sequences, and what they leave of the histogram (index: length, the last one is the capacity).

    Weights start as the lengths themselves, which are feasible prices, and fall by ``exp(-rate)`` as a length is covered.  Each round prices
    all configurations once; those within ``slack`` of the best that share no length take a step of ``step`` of their scarcest length, rounded to
    whole sequences within what is left.  Lengths of which there are fewer than ``rare`` have no small step: they are left over.
    """
    capacity = len(hist) - 1
    left, out = hist.astype(np.int64).copy(), Counter()
    if left[capacity]:
        out[((capacity, 1),)] = int(left[capacity])
        left[capacity] = 0
    for _ in range(rounds):
        lengths = np.flatnonzero((left > 0) & (hist >= rare))
        if not len(lengths):
            break
        have, there, sizes = hist[lengths].tolist(), left[lengths].tolist(), lengths.tolist()
        done = 1 - left[lengths] / hist[lengths]
        value = lengths * np.exp(-rate * (done - done.min()))
        prices = Prices(lengths, value, capacity)
        worth = value + np.array(prices.best)[capacity - lengths]
        used, moved = set(), False
        for k in np.argsort(-worth, kind="stable").tolist():
            if worth[k] < (1 - slack) * prices.best[capacity]:
                break
            if k in used:
                continue
            found = prices.through(k)
            if any(j in used or n > there[j] or n * rare > have[j] for j, n in found.items()):
                continue
            times = min(max(1, int(min(step * have[j] / n for j, n in found.items()))), *(there[j] // n for j, n in found.items()))
            out[tuple(sorted(((sizes[j], n) for j, n in found.items()), reverse=True))] += times
            for j, n in found.items():
                left[sizes[j]] -= times * n
            used.update(found)
            moved = True
        if not moved:
            break
    return out, left


def best_fit(hist: np.ndarray) -> Counter:
    """Best fit, longest first, on counts: equal pieces go to equally filled sequences together, so the work does not follow the counts."""
    capacity = len(hist) - 1
    room: list[Counter] = [Counter() for _ in range(capacity + 1)]  # free tokens -> configurations with how many
    for length in range(capacity, 0, -1):
        left = int(hist[length])
        free = length
        while left and free < capacity:
            if room[free]:
                c, n = min(room[free].items())
                take = min(n, left)
                room[free][c] -= take
                if room[free][c] == 0:
                    del room[free][c]
                room[free - length][_with(c, length)] += take
                left -= take
                free = max(length, free - length)  # those that took one may be the best fit for the next
            else:
                free += 1
        each = capacity // length
        full, rest = divmod(left, each)
        if full:
            room[capacity - each * length][((length, each),)] += full
        if rest:
            room[capacity - rest * length][((length, rest),)] += 1
    out: Counter = Counter()
    for r in room:
        out.update(r)
    return out


def _with(c: Config, length: int) -> Config:
    return (*c[:-1], (length, c[-1][1] + 1)) if c[-1][0] == length else (*c, (length, 1))


def solve(hist: np.ndarray) -> Counter:
    """Configurations with how often; all lengths of the histogram are used up.  ``hist[n]``: pieces of length n, up to the capacity."""
    out, left = cover(hist)
    out.update(best_fit(left))
    return out


class Plan:
    """Where the piece of rank r among those of its length goes; built on the driver from the histogram alone."""

    def __init__(self, hist: np.ndarray):
        runs: dict[int, list[tuple[int, int, int, int, int]]] = {}  # length -> (first rank, first sequence, pieces a sequence, offset)
        used, seq = Counter(), 0
        for config, n in sorted(solve(hist).items(), reverse=True):
            at = 0
            for length, k in config:
                runs.setdefault(length, []).append((used[length], seq, k, at))
                used[length] += n * k
                at += length * k
            seq += n
        self.runs = {a: np.array(v, np.int64) for a, v in runs.items()}
        self.sequences = seq

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        sizes, starts = np.unique(length[order], return_index=True)
        for size, at in zip(sizes.tolist(), np.split(order, starts[1:]), strict=True):
            first, s, k, o = self.runs[size][np.searchsorted(self.runs[size][:, 0], rank[at], side="right") - 1].T
            nth, slot = np.divmod(rank[at] - first, k)
            seq[at], off[at] = s + nth, o + slot * size
        return seq, off


_CODERS: dict[int, object] = {}


def coder(blob: bytes):
    """Text to token ids as numpy, from a byte-level BPE file of the ``tokenizers`` library; one for each Python worker and file.

    The merges of such a file make its ids in order, so the ids are ranks, which is all that the faster ``tiktoken`` asks for.
    """
    key = zlib.crc32(blob)
    if key not in _CODERS:
        import tiktoken

        spec = json.loads(blob)
        model, pre = spec["model"], spec["pre_tokenizer"]
        vocab: dict[str, int] = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        fits = pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True) and spec["normalizer"] is None and spec["post_processor"] is None
        added = spec["added_tokens"]
        if not plain or not fits or made != sorted(made) or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("this tokenizer file has a step that is not supported")
        back = {c: b for b, c in enumerate(byte_alphabet())}
        hold("bestfit", _CODERS.clear)
        _CODERS[key] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks={bytes([back[c] for c in t]): i for t, i in vocab.items()}, special_tokens={t["content"]: t["id"] for t in added})
    return _CODERS[key]


#: The word pattern that byte-level files imply (a fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each text and ``end_id``, as little-endian unsigned 32-bit numbers."""
    model = docs.sparkSession.sparkContext.broadcast(load(tokenizer))
    last = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = coder(model.value)
        for batch in small_batches(batches, "text"):
            ids = [(enc.encode_to_numpy(t, allowed_special="all").astype("<u4").tobytes() if t else b"") + last for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(lean(run, keep="bestfit"), "doc_id long, ids binary")


def pieces(coded: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, rank): the pieces of each (doc_id, ids) row, ranked by length within the task.

    A document that is too long gives what is over a multiple of ``capacity`` first, then full pieces.
    """

    def run(batches):
        task, ranks = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in small_batches(batches, "ids"):
            out: list = []
            for doc, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, start, piece = len(blob) // 4, 0, 0
                while start < n:
                    size = (n - start) % capacity or capacity
                    out.append((doc, piece, start, size, zlib.crc32(memoryview(blob)[4 * start : 4 * (start + size)]), ranks[size]))
                    ranks[size] += 1
                    start, piece = start + size, piece + 1
            doc, piece, start, size, crc, rank = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(out), pa.int64()), pa.array(rank, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return coded.mapInArrow(lean(run, keep="bestfit"), "doc_id long, piece int, start long, length long, ids_crc32 long, task long, rank long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its sequence and its place there, ``OUT``.

    A null or empty text is one piece with just ``end_id``.  Rows are independent documents even if they repeat or have a null id; other
    columns are not read.  A very long text is tokenised in one task, its pieces are rows like any other.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "bestfit")
    cut = scratch.save(pieces(tokenized(docs, tokenizer, end_id, id_col, text_col), capacity), "pieces")
    cells = scratch.save(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("c")), "cells")
    # bounded: at most one row for each length
    hist = np.zeros(capacity + 1, np.int64)
    for r in cells.groupBy("length").agg(F.sum("c").alias("c")).collect():
        hist[r["length"]] = r["c"]
    plan = Plan(hist)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.select("length", "task", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    ready = cut.join(base, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                seq, off = plan.place(batch.column(3).to_numpy(), batch.column(5).to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], names=[f.split()[0] for f in OUT.split(", ")])

    return ready.mapInArrow(place, OUT)
