"""Exact Jaccard join on word n-grams by rare-first prefix filtering.

A document is the set of its distinct n-word shingles, as 64-bit hashes.  All shingles are put in one global order,
rarest first (document frequencies are counted over the whole corpus).  Two sets with Jaccard similarity
>= t share a shingle among their first ``n - ceil(t n) + 1``, so only these prefixes meet in an
inverted index, and a shingle that no other document has needs no entry at all.  Length, positional and suffix
filters drop pairs, and what is left is verified once per pair on the whole sets.

Equal sets are one entry.  A posting list is not expanded into all its pairs: its members are first verified against
one leader, for some rounds with other leaders, and the links found so far put them into components; then
only pairs between different components are joined, all of them.  So no link between components is lost, and a
group of near copies costs about one pair for each member and round.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NONE, build_blocks, cut_ranges, letter_table, mix, open_block, range_bits, rows_of, word_hash
from .common import Scratch, lean, min_label_components, text_bytes

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
TABLE = letter_table(3)
STEP = np.random.default_rng(9).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PIECE = 2 << 20


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased) in joined texts, and the document each is in.  Words end where documents do."""
    low = LOWER[data]
    word = ~BLANK[low]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(word & np.concatenate([[True], edge[1:-1] | ~word[:-1]])) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(word & np.concatenate([edge[1:-1] | ~word[1:], [True]])) + 1 if len(data) else start
    return word_hash(low, start, end, TABLE), np.searchsorted(offsets, start, side="right") - 1


def shingle_sets(data: bytes, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; fewer than n words are one shingle."""
    out: list[np.ndarray] = []
    raw = np.frombuffer(data, np.uint8)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, side="right")) - 1)
        at = offsets[first : last + 1] - offsets[first]
        h, doc = word_hashes(raw[offsets[first] : offsets[last]], at)
        bounds = np.searchsorted(doc, np.arange(last - first + 1))
        roll = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for k in range(n):
            roll += h[k : k + len(roll)] * STEP[k]
        roll = mix(roll)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= n:
                out.append(np.unique(roll[a : b - n + 1]))
            elif b > a:
                one = (h[a:b] * STEP[: b - a]).sum(dtype=np.uint64, keepdims=True) + STEP[n + b - a : n + b - a + 1]
                out.append(mix(one))
            else:
                out.append(np.zeros(0, np.uint64))
        first = last
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 |A n B| >= percent |A u B| for sorted sets, after a length and a suffix filter.

    The suffix filter cuts both ordered sets at the same hashes: the sum of differences of the parts' sizes bounds the symmetric
    difference from below.
    """
    n, m = len(a), len(b)
    if 100 * min(n, m) < percent * max(n, m):
        return False
    cuts = np.arange(1, 16, dtype=np.uint64) << np.uint64(60)
    apart = np.abs(np.diff(np.concatenate([[0], np.searchsorted(a, cuts), [n]])) - np.diff(np.concatenate([[0], np.searchsorted(b, cuts), [m]]))).sum()
    # |A n B| <= (n + m - apart) / 2
    if 100 * (n + m - apart) < percent * (n + m + apart):
        return False
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, m - 1)] == a).sum()) if m else 0
    return 100 * common >= percent * (n + m - common)


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked at Jaccard similarity >= percent / 100: doc_id, n_shingles, component_id.

    Null or blank texts have the empty set and link with nothing.  Repeated rows and equal texts link with each
    other.  A null id keeps its n_shingles and has a null component.  Other columns are not read.  An empty table gives an
    empty result.  Sets are compared as 64-bit hashes of whole shingles.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    blocks = build_blocks(scratch, docs, id_col, text_col)
    _, total = text_bytes(docs, text_col)
    bits = range_bits(total // 6, int(spark.conf.get("spark.sql.shuffle.partitions")))

    # 1. shingles of each block by hash range; the low 32 bits of what the range leaves are enough for a frequency
    def spread(batches):
        for row in rows_of(batches):
            _, offsets, data = open_block(row["ids"], row["sizes"], row["texts"])
            sets = shingle_sets(data, offsets, words)
            keys, n = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
            low = ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
            cuts = cut_ranges(keys, bits)
            if cuts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r for r, _, _ in cuts], pa.int32()), pa.array([row["block"]] * len(cuts), pa.int64()), pa.array([low[a:b].tobytes() for _, a, b in cuts], pa.binary()), pa.array([np.minimum(n[a:b], 255).astype(np.uint8).tobytes() for _, a, b in cuts], pa.binary())],
                    names=["part", "block", "low", "n"],
                )

    # 2. one task for each range: frequencies; back go the shingles that more than one document has
    def count(table: pa.Table) -> pa.Table:
        lows = [np.frombuffer(x, np.uint32) for x in table.column("low").to_pylist()]
        ns = [np.frombuffer(x, np.uint8) for x in table.column("n").to_pylist()]
        values, inverse = np.unique(np.concatenate(lows), return_inverse=True)
        df = np.bincount(inverse, np.concatenate(ns), minlength=len(values)).astype(np.uint32)
        mine = df[inverse]
        ends = np.cumsum([0, *map(len, lows)])
        back = [np.flatnonzero(mine[a:b] > 1) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({"block": table.column("block"), "part": table.column("part"), "low": pa.array([x[k].tobytes() for x, k in zip(lows, back, strict=True)], pa.binary()), "df": pa.array([mine[a:][k].tobytes() for a, k in zip(ends[:-1], back, strict=True)], pa.binary())})

    spreaded = blocks.mapInArrow(lean(spread), "part int, block long, low binary, n binary")
    counted = spreaded.groupBy("part").applyInArrow(count, "block long, part int, low binary, df binary")
    known = counted.groupBy("block").agg(F.collect_list(F.struct("part", "low", "df")).alias("known"))

    # 3. back in the block: prefixes in rare-first order
    def prefixes(batches):
        for row in rows_of(batches):
            ids, offsets, data = open_block(row["ids"], row["sizes"], row["texts"])
            sets = shingle_sets(data, offsets, words)
            parts = sorted(row["known"] or [], key=lambda p: p["part"])
            low = np.concatenate([np.frombuffer(p["low"], np.uint32).astype(np.uint64) + (np.uint64(p["part"]) << np.uint64(32)) for p in parts] + [np.zeros(0, np.uint64)])
            df = np.concatenate([np.frombuffer(p["df"], np.uint32) for p in parts] + [np.zeros(0, np.uint32)])
            cols: list[list] = [[] for _ in range(6)]
            for i, s in zip(ids.tolist(), sets, strict=True):
                n = len(s)
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n else None
                length = n - (percent * n + 99) // 100 + 1
                tokens = pos = np.zeros(0, np.int64)
                if n and len(low):
                    short = s >> np.uint64(32 - bits)
                    at = np.minimum(np.searchsorted(low, short), len(low) - 1)
                    shared = low[at] == short
                    lone = n - int(shared.sum())
                    if lone < length:
                        f = df[at[shared]]
                        order = np.lexsort((s[shared], f))[: length - lone]
                        tokens, pos = s[shared][order].view(np.int64), lone + np.arange(len(order))
                row_out = (None if i == NONE else i, n, key, s.tobytes() if len(tokens) else None, tokens.tolist(), pos.tolist())
                for c, v in zip(cols, row_out, strict=True):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n", "key", "shingles", "tokens", "pos"])

    joined = blocks.join(known, "block", "left").select("ids", "sizes", "texts", "known")
    rows = scratch.save(joined.mapInArrow(lean(prefixes), "doc_id long, n long, key binary, shingles binary, tokens array<long>, pos array<long>"), "sets")
    scratch.drop(blocks)
    members = rows.select("doc_id", "n", "key")
    some = rows.filter("shingles is not null and doc_id is not null")
    # equal sets are one entry, named by their smallest id
    names = scratch.save(members.filter("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep")), "names")
    sets = scratch.save(some.groupBy("key").agg(F.first("shingles").alias("shingles")).join(names, "key").select("rep", "shingles"), "distinct")
    entries = some.select("key", "n", F.explode(F.arrays_zip("tokens", "pos")).alias("t")).select("key", "n", F.col("t.tokens").alias("token"), F.col("t.pos").alias("pos"))
    entries = entries.groupBy("token", "key").agg(F.first("n").alias("n"), F.first("pos").alias("pos")).join(names, "key").select("token", "rep", "n", "pos")
    many = entries.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("token")
    entries = scratch.save(entries.join(many, "token"), "index")

    def verify(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose whole sets are similar."""

        def run(batches):
            for batch in batches:
                ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                at = pa.array(np.flatnonzero(ok))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

        left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
        right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")

    def could(x: str, y: str):
        """Length and positional filters on two index entries."""
        n, m, i, j = (F.col(c) for c in (f"{x}n", f"{y}n", f"{x}pos", f"{y}pos"))
        most = F.least(n - i, m - j)
        return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (100 * most >= percent * (n + m - most))

    edges = comps = None
    tried = None
    for r in range(rounds + 1):
        here = entries if comps is None else entries.join(comps, "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
        here = here.withColumn("c", F.col("rep")) if comps is None else here
        if comps is not None:
            open_tokens = here.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("token")
            here = here.join(open_tokens, "token")
        if r < rounds:
            lead = here.groupBy("token").agg(F.min_by(F.struct("rep", "n", "pos", "c"), F.col("rep") if not r else F.xxhash64("rep", F.lit(r))).alias("l"))
            pairs = here.join(lead, "token").select("rep", "n", "pos", "c", F.col("l.rep").alias("lrep"), F.col("l.n").alias("ln"), F.col("l.pos").alias("lpos"), F.col("l.c").alias("lc"))
            pairs = pairs.filter(F.col("c") != F.col("lc")).filter(could("", "l"))
        else:
            other = here.select("token", *(F.col(k).alias(f"l{k}") for k in ("rep", "n", "pos", "c")))
            pairs = here.join(other, "token").filter(F.col("c") < F.col("lc")).filter(could("", "l"))
        pairs = pairs.select(F.least("rep", "lrep").alias("a"), F.greatest("rep", "lrep").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = scratch.save(pairs, "pairs")
        if pairs.isEmpty():
            if r < rounds:
                continue
            break
        tried = pairs if tried is None else tried.union(pairs)
        new = scratch.save(verify(pairs), "edges")
        if not new.isEmpty():
            edges = new if edges is None else edges.union(new)
            comps = scratch.save(min_label_components(scratch, edges).select(F.col("id").alias("rep"), "component"), "comps")
    out = members.join(names, "key", "left")
    comp = F.col("rep")
    if comps is not None:
        out = out.join(comps, "rep", "left")
        comp = F.coalesce("component", "rep")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce(comp, F.col("doc_id"))).alias("component_id"))
