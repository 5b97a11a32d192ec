"""Removal of repeated byte strings by a distributed difference cover: every byte in a string of ``length`` bytes that starts earlier too.

What is sorted are the suffixes of all documents, each cut at ``length`` bytes; equal neighbours in that order are the
repeats.  A difference cover keeps most suffixes out of the sorts: offsets in a document whose remainder modulo ``period`` is
in the cover are the *sample* (6 of 31 by default), and for any two offsets a step of less than ``period`` leads both into the sample.

1. *Sort sampled tuples.*  Tuples of ``length - period`` bytes at the sample are sorted and named; equal neighbours get one name.  Two
   equal strings share a tuple, as both reach the sample after the same step.  So a string without a
   repeated tuple at its first ``period`` offsets is unique, and it and all tuples that occur once take no further part.
2. *Recurse on names.*  The names at s - period, s and s + period are a triple, which spells the bytes from s - period to
   s + length.  Triples are sorted; where an earlier one is equal, all strings that start between s - period and s are repeats.
   In a repeated passage each period has a sampled offset in common with the earlier occurrence, whatever the shift, so this decides
   all but its borders.
3. *Merge the remaining suffixes.*  Strings not decided yet (at borders, and first occurrences) are sorted by all
   their bytes, and those with an equal earlier neighbour are repeats.  A first occurrence is never decided before, so it is among them.

The depth of the order is bounded by ``length``, so one recursion reaches it.  Each sort is one exchange by range of names (see
``blocks``): sorted runs of blocks meet in the task of their range, neighbours are compared, and one bit for each
name goes back.  A name is a 64-bit hash of the whole string instead of a rank, so that no ranks have to travel; it
orders strings in another way than the alphabet does, but equal ones are neighbours all the same.  Among n sorted names
n^2 / 2^65 false matches are to be expected.  Documents lie in blocks in the order of their ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import MIX1, NONE, bits_of, bucketed, build_blocks, chain_hash, exchange, mix, open_block, open_carry, range_bits, rows_of
from .common import Scratch, lean, partitions_for, text_bytes

#: Perfect difference sets by period (fixed values): every remainder but 0 is the difference of exactly one pair.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (1, 5, 11, 24, 25, 27)}
BLOCK = 3 << 20  # a task holds about 25 bytes for each byte of a block


def period_for(length: int) -> int:
    """The longest period whose triples of names reach over ``length`` bytes and whose tuples are hashed by words of 8 bytes."""
    fits = [p for p in COVERS if 2 * p <= length and length - p >= 8]
    if not fits:
        raise ValueError("length must be at least 15")
    return max(fits)


class Sorted:
    """Names in ascending order: the distinct ones, and which of the entries has which."""

    def __init__(self, names: np.ndarray):
        self.order = np.argsort(names)
        s = names[self.order]
        new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
        self.start = np.flatnonzero(new)
        self.keys = s[self.start]
        self.rank = np.cumsum(new) - 1

    def counts(self) -> np.ndarray:
        return np.diff(np.append(self.start, len(self.order)))

    def entries(self, bits: np.ndarray) -> np.ndarray:
        """What is said of the distinct names, for each entry."""
        out = np.empty(len(self.order), bits.dtype)
        out[self.order] = bits[self.rank]
        return out

    def again(self) -> np.ndarray:
        """Entries that have an equal one before them."""
        out = np.ones(len(self.order), bool)
        if len(self.order):
            out[np.minimum.reduceat(self.order, self.start)] = False
        return out


class Strings:
    """The strings of ``length`` bytes of a block, which never cross documents, and their sample."""

    def __init__(self, row: dict, length: int):
        self.ids, self.offsets, self.data = open_block(row["ids"], row["sizes"], row["texts"])
        self.length, self.period, self.size = length, period_for(length), len(self.data)
        self.tuple = length - self.period
        cover = np.zeros(self.period, bool)
        cover[list(COVERS[self.period])] = True
        at, begin, end = [], [], []
        for a in range(0, self.size, 1 << 17):
            pos, lo, hi = self.around(a, min(a + (1 << 17), self.size))
            here = np.flatnonzero(cover[(pos - lo) % self.period] & (pos + self.tuple <= hi) & (hi - lo >= length))
            at.append(pos[here])
            begin.append(lo[here])
            end.append(hi[here])
        none = np.zeros(0, np.int64)
        self.at, self.begin, self.end = (np.concatenate([*x, none]) for x in (at, begin, end))

    def around(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions a..b, and where the document of each begins and ends."""
        first, last = int(np.searchsorted(self.offsets, a, side="right")) - 1, int(np.searchsorted(self.offsets, b))
        sizes = np.diff(np.clip(self.offsets[first : last + 1], a, b))
        return np.arange(a, b), np.repeat(self.offsets[first:last], sizes), np.repeat(self.offsets[first + 1 : last + 1], sizes)

    def tuples(self) -> Sorted:
        return Sorted(chain_hash(self.data, self.at, self.tuple, self.tuple))

    def triples(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, Sorted]:
        """(first, last) string decided by the triple at each chosen sample, and its name; triples end where documents do."""
        at, begin, end = self.at[chosen], self.begin[chosen], self.end[chosen]
        first, stop = np.maximum(begin, at - self.period), np.minimum(end, at + self.length)
        wide = stop - first >= self.length
        at, first, stop = at[wide], first[wide], stop[wide]
        names = chain_hash(self.data, first, stop - first, self.length + self.period)
        return first, np.minimum(at, stop - self.length), Sorted(mix(names + (at - first).astype(np.uint64) * MIX1))

    def spans(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A mark on every position from ``first`` to ``last`` of some span."""
        edge = np.zeros(self.size + 1, np.int16)
        np.add.at(edge, first, 1)
        np.add.at(edge, last + 1, -1)
        return np.cumsum(edge[:-1], dtype=np.int16) > 0

    def whole(self) -> np.ndarray:
        """Positions at which a string starts."""
        out = np.zeros(self.size, bool)
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            out[a : max(a, b - self.length + 1)] = True
        return out

    def decided(self, repeated: np.ndarray, later) -> tuple[np.ndarray, np.ndarray]:
        """(strings that are repeats by their triple, positions of strings still open).  ``later(keys)`` says which triples occur earlier."""
        first, last, names = self.triples(repeated)
        hit = names.again() | names.entries(later(names.keys))
        done = self.spans(first[hit], last[hit])
        at = self.at[repeated]
        open_ = self.spans(np.maximum(self.begin[repeated], at - self.period + 1), at)
        return done, np.flatnonzero(open_ & ~done & self.whole())


def _removal(docs: DataFrame, length: int, id_col: str, text_col: str, carry: tuple[str, ...], schema: T.StructType, emit: Callable) -> DataFrame:
    """Decide on every byte and let ``emit(strings, covered, carried columns)`` make the rows of each block."""
    period_for(length)
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    _, total = text_bytes(docs, text_col)
    parts = partitions_for(spark, total, 24 << 20)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carry)
    packed = build_blocks(scratch, src.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id"), "doc_id", "text", BLOCK, carry=carry)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = bucketed(scratch, packed, max(least, -(-total // (12 << 20))))
    scratch.drop(packed)
    sample, few, more = (range_bits(total // n, least) for n in (5, 25, 12))

    def with_bits(*found: DataFrame) -> DataFrame:
        out = blocks
        for f in found:
            out = out.join(f.hint("shuffle_hash"), "block", "left")
        return out

    def repeated_tuples(s: Strings, row: dict) -> np.ndarray:
        names = s.tuples()
        return names.entries(bits_of(row["repeated"], names.keys, sample))

    def decided(s: Strings, row: dict) -> tuple[np.ndarray, np.ndarray]:
        return s.decided(repeated_tuples(s, row), lambda keys: bits_of(row["later"], keys, few))

    def tuple_keys(row):
        names = Strings(row, length).tuples()
        return names.keys, names.counts() > 1

    def triple_keys(row):
        s = Strings(row, length)
        keys = s.triples(repeated_tuples(s, row))[2].keys
        return keys, np.zeros(len(keys), bool)

    def string_keys(row):
        s = Strings(row, length)
        keys = np.unique(chain_hash(s.data, decided(s, row)[1], length, length))
        return keys, np.zeros(len(keys), bool)

    def cut(batches):
        for row in rows_of(batches):
            s = Strings(row, length)
            gone, left = decided(s, row)
            names = Sorted(chain_hash(s.data, left, length, length))
            gone[left] = names.again() | names.entries(bits_of(row["later2"], names.keys, more))
            upto = np.concatenate([np.zeros(length, np.int32), np.cumsum(gone, dtype=np.int32)])
            yield emit(s, upto[length:] > upto[:-length], open_carry(row["carry"]) if carry else {})

    repeated = scratch.save(exchange(blocks, tuple_keys, sample, "repeated", width=4), "tuples")
    later = scratch.save(exchange(with_bits(repeated), triple_keys, few, "later", columns=("repeated",)), "triples")
    later2 = exchange(with_bits(repeated, later), string_keys, more, "later", columns=("repeated", "later")).withColumnRenamed("later", "later2")
    later2 = scratch.save(later2, "strings")
    final = with_bits(repeated, later, later2).select("ids", "sizes", "texts", *["carry"] * bool(carry), "repeated", "later", "later2")
    return final.mapInArrow(lean(cut), T.StructType(schema.fields + [src.schema[c] for c in carry]))


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts earlier (smaller id, or same document, earlier start).

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256.  A null text is empty; texts shorter than
    ``length`` are kept whole.  Rows with the same id come one after the other in some order; null ids come first.  Other columns are
    not read.  An empty table gives an empty result.  A text of any length is whole in one task, which needs up to 25 bytes for each of its bytes.
    """

    def digests(s: Strings, covered: np.ndarray, _: dict) -> pa.RecordBatch:
        raw = np.frombuffer(s.data, np.uint8)
        out: list[list] = [[] for _ in range(5)]
        for i, a, b in zip(s.ids.tolist(), s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True):
            c = covered[a:b]
            spans = int(c[:1].sum() + (c[1:] & ~c[:-1]).sum())
            for col, v in zip(out, (None if i == NONE else i, b - a, int(c.sum()), spans, hashlib.sha256(raw[a:b][~c]).hexdigest()), strict=True):
                col.append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _removal(docs, length, id_col, text_col, (), T.StructType.fromDDL(DIGEST), digests)


def cut_documents(docs: DataFrame, length: int = 100) -> DataFrame:
    """``documents`` without their repeated strings, with all their columns; ``n_chars`` is counted anew.

    A cut that falls inside a character takes the rest of it along.  A document that had text and has none left goes;
    null texts stay null, and empty ones empty.  Repeated rows, null ids and an empty table are as in ``remove_repeats``.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    shape = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def texts(s: Strings, covered: np.ndarray, carried: dict) -> pa.RecordBatch:
        raw = np.frombuffer(s.data, np.uint8)
        null = carried["_null"].to_pylist()
        ids, text, stay, cuts = [], [], [], []
        for k, (i, a, b) in enumerate(zip(s.ids.tolist(), s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True)):
            c = covered[a:b]
            cuts.append(bool(c.any()))
            if b == a or not c.all():
                stay.append(k)
                ids.append(None if i == NONE else i)
                text.append(None if null[k] else raw[a:b][~c].tobytes().decode("utf-8", "ignore"))
        kept = {n: v.take(pa.array(stay, pa.int64())) for n, v in carried.items()}
        if "n_chars" in kept:
            size = kept["n_chars"].to_pylist()
            kept["n_chars"] = pa.array([len(t) if cuts[k] else n for k, t, n in zip(stay, text, size, strict=True)], kept["n_chars"].type)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(text, pa.string()), *kept.values()], names=["doc_id", "text", *kept])

    out = _removal(docs.withColumn("_null", F.col("text").isNull()), length, "doc_id", "text", (*others, "_null"), shape, texts)
    return out.select(*(F.col(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
