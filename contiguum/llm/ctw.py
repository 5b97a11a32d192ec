"""Scoring texts by context-tree weighting (Willems, Shtarkov and Tjalkens, 1995) over bytes.

A byte is eight binary decisions; each decision has a context tree over the preceding bytes.  Every node holds the counts of
zeros and ones of the training texts and their Krichevsky-Trofimov probability, and mixes it half and half with
the product of its children.  The probability of a byte after its context is the ratio of mixed probabilities:
on the way from the deepest context to the root, each node adds its own estimate with the weight it has earned.

The tree is built from the counts of all ``depth + 1``-grams of the training texts.  Blocks send their distinct grams once
(see ``blocks``); a task holds the subtrees of some pairs of nearest context bytes, and what lies above, at depths 0 and
1, is at most 257 x 255 nodes and is put together on the driver.  Back to a block goes one number for each of its
distinct grams, and a text's score is a sum of look-ups.  The counts of words, for the base score, travel alike.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NONE, bucketed, build_blocks, from_planes, letter_table, mix, open_block, pack_sorted, planes, rows_of, unpack_sorted, word_hash
from .common import Scratch, lean, text_bytes

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
END = b"\n"
TABLE = letter_table(23)
HALF = np.log(0.5)


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5: Stirling's series after moving the argument up by eight."""
    y = x + 8.0
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.91893853320467274 + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y - shift


#: lgamma at n + 1/2 and n + 1 for counts n below ``SMALL`` and twice that: nearly all nodes have such counts.
SMALL = 1 << 14
HALVES, WHOLES = lgamma(np.arange(SMALL) + 0.5), lgamma(np.arange(2 * SMALL) + 1.0)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with these (whole) counts."""
    z, o = np.minimum(zeros, SMALL - 1).astype(np.int64), np.minimum(ones, SMALL - 1).astype(np.int64)
    out = HALVES[z] + HALVES[o] - WHOLES[z + o] - np.log(np.pi)
    large = np.flatnonzero(np.maximum(zeros, ones) >= SMALL)
    if len(large):
        zeros, ones = zeros[large], ones[large]
        out[large] = lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - np.log(np.pi)
    return out


def held(doc_id: int | None, fold: int, part: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % fold == part


def tokens_of(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased; ``bytes.split`` cuts at 0x20 and 0x09-0x0D."""
    return text.translate(LOWER).split()


def grams(stream: np.ndarray, depth: int) -> np.ndarray:
    """For each byte behind the first ``depth``: the context, nearest byte highest, and the byte itself lowest."""
    n = len(stream) - depth
    if depth == 7:  # eight neighbours are one word, the byte itself highest
        word = np.ndarray((n,), "<u8", np.ascontiguousarray(stream), 0, (1,))
        return word << np.uint64(8) | word >> np.uint64(56)
    out = stream[depth:].astype(np.uint64)
    for d in range(1, depth + 1):
        out |= stream[depth - d : depth - d + n].astype(np.uint64) << np.uint64(8 * (depth + 1 - d))
    return out


class Tree:
    """Context trees below depth ``top`` for sorted distinct grams of ``depth`` context bytes, with counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int):
        self.depth, self.top = depth, top
        tables = {depth: (keys, counts.astype(float))}
        for d in range(depth - 1, top - 1, -1):
            k, c = tables[d + 1]
            short = (k >> np.uint64(16)) << np.uint64(8) | (k & np.uint64(255))  # drops the farthest byte
            u, inverse = np.unique(short, return_inverse=True)
            tables[d] = (u, np.bincount(inverse, c, minlength=len(u)))
        self.tables = tables

    def level(self, bit: int) -> tuple[dict, dict, dict, dict]:
        """Groups, log KT, log weighted probability and counts of the nodes that decide on bit ``bit`` (0 is highest)."""
        groups, pe, pw, ones = {}, {}, {}, {}
        zeros = {}
        for d in range(self.depth, self.top - 1, -1):
            k, c = self.tables[d]
            g = k >> np.uint64(8 - bit)
            start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            one = np.add.reduceat(np.where((k >> np.uint64(7 - bit)) & np.uint64(1), c, 0.0), start)
            zero = np.add.reduceat(c, start) - one
            groups[d], ones[d], zeros[d] = g[start], one, zero
            pe[d] = log_kt(zero, one)
            if d == self.depth:
                pw[d] = pe[d]
            else:
                below = np.bincount(np.searchsorted(groups[d], self.parent(groups[d + 1], bit)), pw[d + 1], minlength=len(start))
                pw[d] = np.logaddexp(HALF + pe[d], HALF + below)
        return groups, pe, pw, {d: (zeros[d], ones[d]) for d in ones}

    @staticmethod
    def parent(groups: np.ndarray, bit: int) -> np.ndarray:
        low = np.uint64(bit)
        return (groups >> np.uint64(bit + 8)) << low | (groups & ((np.uint64(1) << low) - np.uint64(1)))

    def roots(self) -> dict[str, np.ndarray]:
        """What depth ``top - 1`` needs of these subtrees: sums of log weighted probabilities and of counts by parent node."""
        out: dict[str, list] = {"node": [], "below": [], "zeros": [], "ones": []}
        for bit in range(8):
            groups, _, pw, counts = self.level(bit)
            u, inverse = np.unique(self.parent(groups[self.top], bit), return_inverse=True)
            out["node"].append((np.int64(1) << np.int64(bit + 8)) | u.astype(np.int64))
            for name, v in (("below", pw[self.top]), ("zeros", counts[self.top][0]), ("ones", counts[self.top][1])):
                out[name].append(np.bincount(inverse, v, minlength=len(u)))
        return {k: np.concatenate(v) for k, v in out.items()}

    def log_probabilities(self, upper: Upper) -> np.ndarray:
        """log2 of the probability of each gram's byte after its context."""
        keys = self.tables[self.depth][0]
        total = np.zeros(len(keys))
        for bit in range(8):
            groups, pe, pw, counts = self.level(bit)
            at = np.arange(len(groups[self.depth]))
            p = None
            for d in range(self.depth, self.top - 1, -1):
                if d < self.depth:
                    at = np.searchsorted(groups[d], self.parent(groups[d + 1], bit))[at]
                zero, one = counts[d]
                own = ((one + 0.5) / (zero + one + 1.0))[at]
                if p is None:
                    p = own
                else:
                    w = np.exp(HALF + pe[d] - pw[d])[at]
                    p = w * own + (1 - w) * p
            p = upper.mix(self.parent(groups[self.top], bit)[at], bit, p)
            group = np.searchsorted(groups[self.depth], keys >> np.uint64(8 - bit))
            one = ((keys >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
            total += np.log2(np.where(one, p[group], 1 - p[group]))
        return total


class Upper:
    """The nodes at depths 1 and 0: bounded tables, whatever the corpus."""

    def __init__(self, node: np.ndarray, below: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        size = 1 << 16  # (1 << bit + 8 | context byte << bit | bits so far) and (1 << bit | bits so far)
        self.own, self.weight = {}, {}
        b, z, o = (np.zeros(size) for _ in range(3))
        b[node], z[node], o[node] = below, zeros, ones
        for d in (1, 0):
            pe = log_kt(z, o)
            pw = np.logaddexp(HALF + pe, HALF + b)
            self.own[d], self.weight[d] = (o + 0.5) / (z + o + 1.0), np.exp(HALF + pe - pw)
            if d:
                at = np.flatnonzero(z + o > 0)
                bit = np.floor(np.log2(at)).astype(np.int64) - 8
                root = (1 << bit) | (at & ((1 << bit) - 1))
                b, z, o = (np.bincount(root, x[at], minlength=size) for x in (pw, z, o))

    def mix(self, group: np.ndarray, bit: int, p: np.ndarray) -> np.ndarray:
        node = (np.int64(1) << np.int64(bit + 8)) | group.astype(np.int64)
        root = (np.int64(1) << np.int64(bit)) | (group.astype(np.int64) & ((1 << bit) - 1))
        for d, at in ((1, node), (0, root)):
            w = self.weight[d][at]
            p = w * self.own[d][at] + (1 - w) * p
        return p


class Streams:
    """A block's documents as token streams: words parted by blanks, then the end."""

    def __init__(self, row: dict, depth: int, fold: int, part: int):
        self.ids, offsets, data = open_block(row["ids"], row["sizes"], row["texts"])
        self.held = np.array([held(None if i == NONE else i, fold, part) for i in self.ids.tolist()], bool)
        texts, n_tokens = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            words = tokens_of(data[a:b])
            n_tokens.append(len(words) + 1)
            texts.append(b" ".join(words) + END)
        self.n_tokens = np.array(n_tokens, np.int64)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.texts, self.depth = texts, depth

    def grams(self, first: int, last: int) -> np.ndarray:
        """The gram of every byte of some documents, in their order."""
        pad, sizes = END * self.depth, self.sizes[first:last]
        at = grams(np.frombuffer(pad + pad.join(self.texts[first:last]), np.uint8), self.depth)
        inside = np.ones(len(at), bool)
        ends = np.cumsum(sizes + self.depth)  # the pads between documents are nobody's bytes
        for k in range(self.depth):
            inside[ends[:-1] - self.depth + k] = False
        return at[inside]

    def gram_runs(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct grams of some documents, where each one's run starts, and the document of every byte in gram order.

        Within the run of a gram the documents come in any order.
        """
        at = self.grams(first, last)
        order = np.argsort(at)
        at, doc = at[order], np.repeat(np.arange(first, last, dtype=np.uint16), self.sizes[first:last])[order]
        start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        return at[start], start, doc

    def distinct_grams(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct grams of the chosen documents and how often they occur: a plain sort, which is many times faster than one that keeps the documents."""
        out, n = np.empty(int(self.sizes[chosen].sum()), np.uint64), 0
        for first in range(0, len(self.texts), 256):
            mine = chosen[first : first + 256]
            at = self.grams(first, first + len(mine))[np.repeat(mine, self.sizes[first : first + 256])]
            out[n : n + len(at)] = at
            n += len(at)
        out.sort()
        start = np.flatnonzero(np.append(np.ones(min(n, 1), bool), out[1:] != out[:-1]))
        return out[start], np.diff(np.append(start, n)).astype(np.uint32)

    @functools.cached_property
    def word_runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for hashes of words; every text has one end."""
        joined = np.frombuffer(b"".join(self.texts), np.uint8)
        stop = np.flatnonzero((joined == 32) | (joined == 10))
        start = np.concatenate([[0], stop[:-1] + 1])
        real = stop > start  # nothing stands before the end of a text without words
        start, stop = start[real], stop[real]
        h = word_hash(joined, start, stop, TABLE)
        doc = np.repeat(np.arange(len(self.texts), dtype=np.uint16), self.n_tokens - 1)
        h = np.concatenate([h, np.repeat(mix(np.array([0xE0D], np.uint64)), len(self.texts))])
        doc = np.concatenate([doc, np.arange(len(self.texts), dtype=np.uint16)])
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h[first], first, doc

    def runs(self, kind: int):
        """Parts (keys, run starts, documents): grams by 256 documents, words of all."""
        if kind:
            yield self.word_runs
        else:
            for first in range(0, len(self.texts), 256):
                yield self.gram_runs(first, min(first + 256, len(self.texts)))

    def table(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of the block and their counts in training documents."""
        if kind:
            keys, start, doc = self.word_runs
            return keys, np.add.reduceat((~self.held)[doc], start, dtype=np.uint32)
        learnt, counts = self.distinct_grams(~self.held)
        keys = np.concatenate([learnt, self.distinct_grams(self.held)[0]])
        keys.sort()
        keys = keys[np.append(True, keys[1:] != keys[:-1])]
        out = np.zeros(len(keys), np.uint32)
        out[np.searchsorted(keys, learnt)] = counts
        return keys, out

    def keys(self, kind: int) -> np.ndarray:
        """The keys of ``table`` alone."""
        return self.word_runs[0] if kind else self.distinct_grams(np.ones(len(self.texts), bool))[0]

    def sums(self, kind: int, keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        """For each document, the sums over its bytes (or words) of values given by distinct key."""
        out = [np.zeros(len(self.texts)) for _ in values]
        for k, start, doc in self.runs(kind):
            at, runs = np.searchsorted(keys, k), np.diff(np.append(start, len(doc)))
            for total, v in zip(out, values, strict=True):
                total += np.bincount(doc, np.repeat(v[at], runs), minlength=len(total))
        return out


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[start], np.add.reduceat(counts, start, dtype=counts.dtype)


def deal(keys: np.ndarray, kind: int, parts: int, depth: int) -> np.ndarray:
    """The task of each key: grams by their two nearest context bytes, so subtrees stay whole; words by hash."""
    lead = keys >> np.uint64(8 * (depth - 1)) if kind == 0 else keys
    return (mix(lead) % np.uint64(parts)).astype(np.int64)


def score(docs: DataFrame, depth: int = 7, fold: int = 5, part: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """log10 probability of every whole text under the tree and under unigram counts, learnt from the rows outside the held-out part.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.  ``score`` is the probability of the token stream
    (lower-cased words parted by blanks, then the end), so that both scores are of the same event; divided by its bytes it is the
    code length per byte.  A null or blank text is just the end.  Rows are independent, repeated rows count
    again, null ids are training rows; other columns are not read.  An empty table gives an empty result.
    """
    if not 2 <= depth <= 7:
        raise ValueError("depth must be 2 to 7: a gram is a 64-bit number")
    spark = docs.sparkSession
    scratch = Scratch(spark, "ctw")
    _, total = text_bytes(docs, text_col)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = build_blocks(scratch, docs, id_col, text_col)
    buckets = max(least, -(-total // (12 << 20)))
    blocks = bucketed(scratch, packed, buckets)
    scratch.drop(packed)
    parts = max(least, total // (8 << 20))

    def spread(batches):
        for row in rows_of(batches):
            s = Streams(row, depth, fold, part)
            for kind in (0, 1):
                keys, counts = s.table(kind)
                to = deal(keys, kind, parts, depth)
                order = np.argsort(to, kind="stable")
                bounds = np.searchsorted(to[order], np.arange(parts + 1))
                for p in range(parts):
                    at = order[bounds[p] : bounds[p + 1]]
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((kind, pa.int32()), (p, pa.int32()), (row["block"], pa.int64()), (pack_sorted(keys[at]), pa.binary()), (planes(counts[at]), pa.binary()))], names=["kind", "part", "block", "keys", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        keys = [unpack_sorted(x, np.uint64) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([from_planes(x, np.uint32) for x in table.column("counts").to_pylist()])
        u, c = added(np.concatenate(keys), counts.astype(np.int64))
        at = [pack_sorted(np.searchsorted(u, k).astype(np.uint32)) for k in keys]
        up = Tree(u, c, depth, 2).roots() if kind == 0 else {k: np.zeros(0) for k in ("node", "below", "zeros", "ones")}
        row = {"kind": kind, "part": table.column("part")[0].as_py(), "keys": pack_sorted(u), "counts": planes(c), "n": int(c.sum()), "known": int((c > 0).sum()), "blocks": table.column("block").to_pylist(), "at": at}
        row |= {k: v.astype(np.int64 if k == "node" else float).tolist() for k, v in up.items()}
        return pa.Table.from_pylist([row], schema=MERGED)

    MERGED = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()), ("known", pa.int64()), ("blocks", pa.list_(pa.int64())), ("at", pa.list_(pa.binary())), ("node", pa.list_(pa.int64())), *((k, pa.list_(pa.float64())) for k in ("below", "zeros", "ones"))])
    spreaded = blocks.mapInArrow(lean(spread), "kind int, part int, block long, keys binary, counts binary")
    merged = spreaded.groupBy("kind", "part").applyInArrow(merge, "kind int, part int, keys binary, counts binary, n long, known long, blocks array<long>, at array<binary>, node array<long>, below array<double>, zeros array<double>, ones array<double>")
    merged = scratch.save(merged, "counts")
    tokens, vocabulary = merged.filter("kind = 1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    tops = merged.filter("kind = 0").select(F.explode(F.arrays_zip("node", "below", "zeros", "ones")).alias("t")).select("t.*")
    rows = tops.groupBy("node").agg(F.sum("below").alias("below"), F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).collect()  # at most 256 x 255 rows
    up = [np.array([r[k] for r in rows], np.int64 if k == "node" else float) for k in ("node", "below", "zeros", "ones")]
    upper = spark.sparkContext.broadcast(up)

    def answer(batches):
        top = None
        for row in rows_of(batches):
            c = from_planes(row["counts"], np.int64)
            if row["kind"] == 0:
                top = top or Upper(*upper.value)
                value = Tree(unpack_sorted(row["keys"], np.uint64), c, depth, 2).log_probabilities(top).astype(np.float32)
            else:
                value = c.astype(np.uint32)
            for b, at in zip(row["blocks"], row["at"], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([row["kind"]], pa.int32()), pa.array([row["part"]], pa.int32()), pa.array([planes(value[unpack_sorted(at, np.uint32)])], pa.binary())], names=["block", "kind", "part", "value"])

    back = merged.select("kind", "part", "keys", "counts", "blocks", "at").mapInArrow(lean(answer), "block long, kind int, part int, value binary")
    back = back.repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("kind", "part", "value")).alias("back"))

    def total_scores(batches):
        for row in rows_of(batches):
            s = Streams(row, depth, fold, part)
            found = {(b["kind"], b["part"]): b["value"] for b in row["back"]}
            sums = []
            for kind in (0, 1):
                keys = s.keys(kind)
                to = deal(keys, kind, parts, depth)
                order = np.argsort(to, kind="stable")
                bounds = np.searchsorted(to[order], np.arange(parts + 1))
                v = np.empty(len(keys))
                for p in range(parts):
                    if bounds[p] < bounds[p + 1]:
                        v[order[bounds[p] : bounds[p + 1]]] = from_planes(found[kind, p], np.float32 if kind == 0 else np.uint32)
                values = (v * np.log10(2.0),) if kind == 0 else (v > 0, np.log10((v + 0.5) / (tokens + 0.5 * (vocabulary + 1))))
                sums += s.sums(kind, keys, *values)
            tree, known, base = sums
            known = known.astype(np.int64)
            ids = pa.array([None if i == NONE else i for i in s.ids.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(s.held), pa.array(s.n_tokens), pa.array(known), pa.array(np.full(len(s.sizes), tokens, np.int64)), pa.array(base), pa.array(tree)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = blocks.join(back.hint("shuffle_hash"), "block", "left").select("ids", "sizes", "texts", "back")
    return out.mapInArrow(lean(total_scores), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
