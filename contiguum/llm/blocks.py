"""Document blocks and the exchange of their keys.

A block is one row that holds some megabytes of documents: ids, lengths and the compressed texts.  What is counted over
the corpus (shingles, windows, contexts) leaves a block as a few sorted arrays of hashes, one for each hash range,
meets the other blocks' arrays in one task for each range, and comes back to its block.  So a corpus-wide
count costs a few bytes for each distinct key of a block, with no row for each key, and a key that every block
holds adds one entry for each block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc  # noqa: F401 - pa.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, lean, narrow_batches, small_batches

BLOCK_BYTES = 6 << 20
BLOCK_ROWS = 1 << 16  # so that a document's number in its block takes 16 bits
BLOCK_SCHEMA = "block long, ids binary, sizes binary, texts binary"
MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
PLACES = 32
NONE = np.iinfo(np.int64).min


def mix(h: np.ndarray) -> np.ndarray:
    """Murmur3's 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(33))) * MIX1
    h = (h ^ (h >> np.uint64(33))) * MIX2
    return h ^ (h >> np.uint64(33))


def letter_table(seed: int) -> np.ndarray:
    """A random 64-bit number for each place in a word (the first ``PLACES``) and byte value, flat."""
    return np.random.default_rng(seed).integers(0, 1 << 64, PLACES << 8, dtype=np.uint64)


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray, step: int = 1 << 19) -> np.ndarray:
    """Hash of data[start:end] of each (not empty) word: the sum of one random number for each place and letter, and the length.

    Places from ``PLACES`` on take the numbers of the table again, mixed with how often it has been gone through.  So there
    are no two words that the form of the sum itself makes equal, as there are for polynomials modulo 2^64.
    """
    out = np.empty(len(start), np.uint64)
    sizes = end - start
    upto = np.cumsum(sizes)
    first = 0
    while first < len(start):  # some hundred thousand letters at a time
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + step, side="right")))
        size = sizes[first:last]
        lead = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(lead, size)
        letter = data[np.repeat(start[first:last], size) + place]
        value = table[(place & (PLACES - 1)) << 8 | letter]
        far = np.flatnonzero(place >= PLACES)
        value[far] = mix(value[far] + (place[far] // PLACES).astype(np.uint64) * MIX1)
        out[first:last] = np.add.reduceat(value, lead)
        first = last
    return mix(out + sizes.astype(np.uint64) * MIX2)


def chain_hash(data: bytes, at: np.ndarray, size: int | np.ndarray, most: int) -> np.ndarray:
    """Hash of the ``size`` (8 to ``most``) bytes from each position: their 8-byte words, the last one reaching to the end, one
    after the other; shorter strings take their last word again until ``most`` is reached."""
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)) if len(data) > 7 else np.zeros(0, np.uint64)
    out = np.empty(len(at), np.uint64)
    for a in range(0, len(at), 1 << 16):  # small enough to stay in the cache
        p, z = at[a : a + (1 << 16)], size if np.isscalar(size) else size[a : a + (1 << 16)]
        h = np.full(len(p), MIX2, np.uint64) * np.asarray(z).astype(np.uint64)
        for k in range(0, most, 8):
            h = (h ^ words[p + np.minimum(k, z - 8)]) * MIX1
            h ^= h >> np.uint64(32)
        out[a : a + (1 << 16)] = mix(h)
    return out


def build_blocks(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, limit: int = BLOCK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pack documents into blocks where they are read: no shuffle.  A null text is stored as empty, a null id as ``NONE``.

    ``carry`` names other columns whose values the blocks keep, as an Arrow stream.
    """

    def run(batches):
        task, seq, held = TaskContext.get().partitionId(), 0, 0
        ids: list[int] = []
        texts: list[bytes] = []
        others: list[pa.RecordBatch] = []

        def block():
            sizes = np.array([len(t) for t in texts], np.int64)
            cols = [np.array(ids, np.int64).tobytes(), sizes.tobytes(), zlib.compress(b"".join(texts), 1)]
            if carry:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, others[0].schema) as writer:
                    writer.write_table(pa.Table.from_batches(others).combine_chunks())
                cols.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + seq], pa.int64()), *(pa.array([c], pa.binary()) for c in cols)], names=["block", "ids", "sizes", "texts", *["carry"] * bool(carry)])

        for batch in small_batches(batches, "text", limit):
            for k, (i, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)):
                t = t or b""
                if texts and (held + len(t) > limit or len(texts) == BLOCK_ROWS):
                    yield block()
                    ids, texts, others, held, seq = [], [], [], 0, seq + 1
                if carry:
                    others.append(batch.slice(k, 1).select(list(carry)))
                ids.append(NONE if i is None else i)
                texts.append(t)
                held += len(t)
        if texts:
            yield block()

    narrow_batches(scratch.spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carry)
    return scratch.save(src.mapInArrow(lean(run), BLOCK_SCHEMA + ", carry binary" * bool(carry)), "blocks")


def open_carry(blob: bytes) -> dict[str, pa.Array]:
    table = pa.ipc.open_stream(blob).read_all().combine_chunks()
    return {n: table.column(n).chunk(0) if table.num_rows else pa.array([], table.schema.field(n).type) for n in table.schema.names}


def open_block(ids: bytes, sizes: bytes, texts: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Document ids, offsets (one more than documents) and the joined texts."""
    size = np.frombuffer(sizes, np.int64)
    return np.frombuffer(ids, np.int64), np.concatenate([[0], np.cumsum(size)]), zlib.decompress(texts)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(j)[k].as_py() for j, name in enumerate(batch.schema.names)}


def range_bits(units: int, least: int, per_range: int = 2_000_000) -> int:
    """log2 of the number of hash ranges, so that one range holds about ``per_range`` keys."""
    return max(0, int(np.ceil(np.log2(max(1, least, units / per_range)))))


def cut_ranges(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(range, first, last) of sorted 64-bit keys by their highest ``bits`` bits."""
    if not bits:
        return [(0, 0, len(keys))] if len(keys) else []
    at = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    end = np.append(at[1:], len(keys))
    return [(r, int(a), int(b)) for r, (a, b) in enumerate(zip(at, end, strict=True)) if b > a]


def bucketed(scratch: Scratch, blocks: DataFrame, buckets: int) -> DataFrame:
    """The blocks as a table bucketed by block id, so that what comes back for a block moves, and the texts do not."""
    return scratch.bucket(blocks, buckets, "block")


def exchange(blocks: DataFrame, keys_of, bits: int, rule: str, width: int = 8, columns: tuple[str, ...] = ()) -> DataFrame:
    """One bit for each distinct key of each block, decided over all blocks: rows ``(block, <rule>)``.

    ``keys_of(row)`` gives a block's sorted distinct 64-bit keys, and which of them it has more than once.  Rules: ``repeated``, some block
    or two blocks have the key more than once; ``later``, a block with a smaller id has it too.  With ``width`` 4 only 32 bits
    of a key beside its range are compared, which can only set more bits.  A range's task holds one entry for each block
    and key.  The bits come back as an array of (part, bitmap), each aligned with the keys of that hash range.
    """

    def spread(batches):
        for row in rows_of(batches):
            keys, twice = keys_of(row)
            short = keys if width == 8 else ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
            cuts = cut_ranges(keys, bits)
            if cuts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r for r, _, _ in cuts], pa.int32()), pa.array([row["block"]] * len(cuts), pa.int64()), pa.array([short[a:b].tobytes() for _, a, b in cuts], pa.binary()), pa.array([np.packbits(twice[a:b]).tobytes() for _, a, b in cuts], pa.binary())],
                    names=["part", "block", "keys", "twice"],
                )

    def decide(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("block").to_numpy(), kind="stable")
        keys = [np.frombuffer(x, np.uint64 if width == 8 else np.uint32) for x in table.column("keys").to_pylist()]
        keys = [keys[i] for i in order]
        twice = table.column("twice").to_pylist()
        sizes = [len(k) for k in keys]
        all_keys = np.concatenate(keys)
        by_key = np.argsort(all_keys, kind="stable")  # equal keys stay in block order
        same = np.concatenate([[False], all_keys[by_key][1:] == all_keys[by_key][:-1]])
        out = np.zeros(len(all_keys), bool)
        if rule == "later":
            out[by_key] = same
        else:
            out[by_key] = same | np.concatenate([same[1:], [False]])
            out |= np.concatenate([np.unpackbits(np.frombuffer(twice[i], np.uint8), count=n).astype(bool) for i, n in zip(order, sizes, strict=True)])
        ends = np.cumsum([0, *sizes])
        found = [np.packbits(out[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        del keys, twice, all_keys, by_key, same, out
        give_back()
        return pa.table({"block": table.column("block").take(pa.array(order)), "part": table.column("part"), "bits": pa.array(found, pa.binary())})

    out = blocks.select("block", "ids", "sizes", "texts", *columns).mapInArrow(lean(spread), "part int, block long, keys binary, twice binary")
    back = out.groupBy("part").applyInArrow(decide, "block long, part int, bits binary")
    return back.groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias(rule))


def bits_of(parts: list[dict] | None, keys: np.ndarray, bits: int) -> np.ndarray:
    """The bits that came back, for the block's sorted distinct keys."""
    out = np.zeros(len(keys), bool)
    known = {p["part"]: p["bits"] for p in parts or ()}
    for r, a, b in cut_ranges(keys, bits):
        out[a:b] = np.unpackbits(np.frombuffer(known[r], np.uint8), count=b - a).astype(bool)
    return out


def planes(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes: small numbers cost little."""
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1)


def from_planes(blob: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(dtype).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending unsigned numbers as their compressed differences."""
    return planes(np.diff(keys, prepend=keys.dtype.type(0)))


def unpack_sorted(blob: bytes, dtype) -> np.ndarray:
    return np.cumsum(from_planes(blob, dtype), dtype=dtype)
