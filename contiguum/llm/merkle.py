"""A Merkle manifest of a table, with proofs: which rows still have the content they were listed with.

Leaves are hashes of rows.  Per language they form a tree by id, every ``FAN`` neighbours a parent; the languages' roots form one more tree.
A parent is the hash of its children one after another, so the hash state before each child slot is a state that its computation
passes anyway: these are kept as copies (the midstate tree).  To see what a child makes of its root, the state before its slot is
resumed, the child and its right siblings follow, and nothing on the left is hashed again.  Every leaf is folded so, changed or not.
A hex digest is just one 64-byte block of SHA-256, so the state before a slot is 32 bytes, which travel to the tasks below;
``hashlib`` takes no states from elsewhere, so there ``compress`` goes on from them, for all nodes of some blocks at once.

A tree is worked up in *blocks* of ``FAN ** LEVELS`` neighbours (512), each in one task: only block roots go on to the next tier, so
a billion leaves are four tiers.  On the way down each block learns the runs of siblings above it, a few hundred bytes a level, and answers for all its
children.  Ranks come from a range sort and counts of its partitions, so neither a language nor an id that many rows share
is gathered, and no leaf passes the driver.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lean, partitions_for, small_batches

FAN, LEVELS = 8, 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars")

PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, p))]
ROUNDS = np.array([int(p ** (1 / 3) * 2**32) % 2**32 for p in PRIMES], np.uint64)[:, None]
START = np.array([math.isqrt(p << 64) % 2**32 for p in PRIMES[:8]], np.uint64)[:, None]
LOW = np.uint64(0xFFFFFFFF)


def turned(x: np.ndarray, *by: int, shift: int = 0) -> np.ndarray:
    """Exclusive or of 32-bit words turned right (and one shifted right); bits above the low 32 are left over."""
    twice = x << np.uint64(32) | x
    out = x >> np.uint64(shift) if shift else np.uint64(0)
    for n in by:
        out = out ^ (twice >> np.uint64(n))
    return out


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """SHA-256 states (8 x n) after one more 64-byte block each (16 words x n)."""
    w = np.empty((64, block.shape[1]), np.uint64)
    w[:16] = block
    for k in range(16, 64):
        w[k] = (w[k - 16] + w[k - 7] + (turned(w[k - 15], 7, 18, shift=3) & LOW) + (turned(w[k - 2], 17, 19, shift=10) & LOW)) & LOW
    w += ROUNDS
    a, b, c, d, e, f, g, h = state
    for k in range(64):
        one = h + (turned(e, 6, 11, 25) & LOW) + (g ^ (e & (f ^ g))) + w[k]
        two = (turned(a, 2, 13, 22) & LOW) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = (one + two) & LOW, a, b, c, (d + one) & LOW, e, f, g
    return (state + np.array([a, b, c, d, e, f, g, h])) & LOW


def words(raw: bytes, each: int) -> np.ndarray:
    """Big-endian 32-bit words of strings of ``each`` words, a column for each string."""
    return np.frombuffer(raw, ">u4").astype(np.uint64).reshape(-1, each).T


def spelled(states: np.ndarray) -> list[bytes]:
    raw = np.ascontiguousarray(states.T).astype(">u4").tobytes().hex().encode()
    return [raw[k : k + 64] for k in range(0, len(raw), 64)]


def midstates(nodes: list[bytes]) -> list[bytes]:
    """The state before each node's slot, with neighbours on one level in parents of ``FAN``."""
    out = [b""] * len(nodes)
    state = np.repeat(START, -(-len(nodes) // FAN), axis=1)
    for slot in range(FAN):
        low = nodes[slot::FAN]
        state = state[:, : len(low)]
        raw = np.ascontiguousarray(state.T).astype(">u4").tobytes()
        out[slot::FAN] = [raw[k : k + 32] for k in range(0, len(raw), 32)]
        if len(low):
            state = compress(state, words(b"".join(low), 16))
    return out


def resumed(nodes: list[bytes], owner: list[int], paths: list[list[dict]]) -> list[bytes]:
    """What nodes give at the upper end of the paths of their owners: at each level the state before the slot goes on with the node, its right siblings and the end."""
    nodes, owner = list(nodes), np.array(owner)
    for level in range(max(map(len, paths), default=0)):
        rows = np.flatnonzero(np.array([len(p) > level for p in paths])[owner])
        if not len(rows):
            continue
        runs = [paths[k][level] for k in owner[rows]]
        state = compress(words(b"".join([r["state"] for r in runs]), 8), words(b"".join([nodes[k] for k in rows]), 16))
        more = np.array([len(r["right"]) // 64 for r in runs])
        for at in range(more.max()):
            here = np.flatnonzero(more > at)
            state[:, here] = compress(state[:, here], words(b"".join([runs[k]["right"][64 * at : 64 * at + 64] for k in here]), 16))
        end = np.zeros((16, len(rows)), np.uint64)
        end[0], end[15] = 1 << 31, [8 * (len(r["left"]) + 64 + len(r["right"])) for r in runs]
        for k, new in zip(rows, spelled(compress(state, end)), strict=True):
            nodes[k] = new
    return nodes


def field(value) -> bytes:
    """A value with its length ahead, so that no two rows are spelled alike."""
    if value is None:
        return b"-"
    raw = str(value).encode() if not isinstance(value, bytes) else value
    return b"%d:%b" % (len(raw), raw)


def leaves(docs: DataFrame) -> DataFrame:
    """(lang, doc_id, leaf, other): the hash of each row, and that of the row after tampering if that is another one.

    Both share the state behind the columns before the text.  Tampering lower-cases A-Z in the text where 3 divides the id's checksum; a row
    without an id or a text stays as it is.
    """

    def run(batches):
        for batch in small_batches(batches, "text"):
            text = batch.column(4).cast(pa.large_binary()).to_pylist()
            ids, langs = batch.column(0), batch.column(2)
            leaf, other = [], []
            for doc, source, lang, n, raw in zip(ids.to_pylist(), batch.column(1).to_pylist(), langs.to_pylist(), batch.column(3).to_pylist(), text, strict=True):
                head = hashlib.sha256(b"".join(map(field, (doc, source, lang, n))))
                new = None
                if raw is not None and doc is not None and zlib.crc32(b"%d" % doc) % 3 == 0:
                    low = raw.lower()  # of bytes: A-Z only
                    if low != raw:
                        h = head.copy()
                        h.update(field(low))
                        new = h.digest()
                head.update(field(raw))
                leaf.append(head.digest())
                other.append(new)
            yield pa.RecordBatch.from_arrays([langs, ids, pa.array(leaf, pa.binary()), pa.array(other, pa.binary())], names=["lang", "doc_id", "leaf", "other"])

    kinds = {"doc_id": "long", "n_chars": "long"}
    cols = [F.col(c).cast(kinds.get(c, "string")).alias(c) for c in (*FIELDS, "text")]
    return docs.select(*cols).mapInArrow(lean(run), "lang string, doc_id long, leaf binary, other binary")


def ranked(scratch: Scratch, rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``place`` (0-based, within ``tree``) and ``size`` (rows of the tree), by the order given, nulls first.

    A last key of no meaning lets equal rows lie in several partitions.
    """
    parts = partitions_for(scratch.spark, 1, 1)
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "_any")]
    laid = rows.withColumn("_any", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_any")
    laid = scratch.save(laid.withColumn("_mid", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "ranked")
    cells = scratch.save(laid.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("c"), F.min("_mid").alias("lo")), "cells")
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = cells.select("tree", "_part", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("lo")).alias("_shift"), F.sum("c").over(tree).alias("size"))
    return laid.join(shift, ["tree", "_part"]).withColumn("place", F.col("_mid") + F.col("_shift")).drop("_mid", "_part", "_shift")


class Midstates:
    """The part of a tree above some neighbouring nodes: digests of each level, and for each parent its hash states before each child slot."""

    def __init__(self, nodes: list[bytes], single: bool):
        """``single``: these are all nodes of their tree, so it ends as soon as one is left; a block among others has ``LEVELS`` levels."""
        self.levels: list[list[bytes]] = [[n.hex().encode() for n in nodes]]
        self.states: list[list] = []
        while len(self.levels[-1]) > 1 or (not single and len(self.states) < LEVELS):
            states, above, low = [], [], self.levels[-1]
            for at in range(0, len(low), FAN):
                h = hashlib.sha256()
                for child in low[at : at + FAN]:
                    states.append(h.copy())
                    h.update(child)
                above.append(h.hexdigest().encode())
            self.states.append(states)
            self.levels.append(above)
        self.root = self.levels[-1][0]

    def siblings(self, place: int, level: int) -> tuple[bytes, bytes]:
        """Left and right siblings of the node above ``place`` on a level."""
        at = place // FAN**level
        first, low = at - at % FAN, self.levels[level]
        return b"".join(low[first:at]), b"".join(low[at + 1 : first + FAN])

    def folded(self, place: int, leaf: bytes) -> bytes:
        """The root if the leaf at ``place`` were another one."""
        for level, states in enumerate(self.states):
            at = place // FAN**level
            h = states[at].copy()
            h.update(leaf)
            h.update(b"".join(self.levels[level][at + 1 : at - at % FAN + FAN]))
            leaf = h.hexdigest().encode()
        return leaf


NODES = "array<struct<place:long,node:binary,doc_id:long,other:binary>>"
PATH = "array<struct<left:binary,right:binary,state:binary>>"


def blocks(scratch: Scratch, ranked_nodes: DataFrame) -> DataFrame:
    """(tree, block, size, nodes): up to 512 neighbours a row, in order."""
    node = F.struct("place", "node", "doc_id", "other")
    out = ranked_nodes.groupBy("tree", F.expr(f"place div {BLOCK}").alias("block")).agg(F.max("size").alias("size"), F.sort_array(F.collect_list(node)).alias("nodes"))
    return scratch.save(out.select("tree", "block", "size", F.col("nodes").cast(NODES).alias("nodes")), "blocks")


def _few(batches, rows: int = 8):
    """Batches of a few blocks."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def block_roots(laid: DataFrame) -> DataFrame:
    """(tree, place, size, node): the root of each block, a node of the next tier."""

    def run(batches):
        for batch in _few(batches):
            roots = []
            for size, nodes in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                roots.append(bytes.fromhex(Midstates(nodes.values.field("node").to_pylist(), size <= BLOCK).root.decode()))
            size = [-(-n // BLOCK) for n in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(roots, pa.binary())], names=["tree", "place", "size", "node"])

    return laid.mapInArrow(lean(run), "tree string, place long, size long, node binary")


def child_paths(laid: DataFrame) -> DataFrame:
    """(tree, block, path): for each node of blocks with a ``path``, the siblings from its own level up to the root, and the states before its slots.

    A node is a block of the tier below, so its place is that block's number.
    """

    def run(batches):
        for batch in _few(batches, 1):
            tree, size, nodes, above = batch.column(0)[0], batch.column(2)[0].as_py(), batch.column(3)[0], batch.column(4)[0].as_py()
            m = Midstates(nodes.values.field("node").to_pylist(), size <= BLOCK)
            count = len(m.levels[0])
            states = [midstates(m.levels[level]) for level in range(len(m.states))]
            paths = [[dict(zip(("left", "right", "state"), (*m.siblings(k, level), before[k // FAN**level]), strict=True)) for level, before in enumerate(states)] + above for k in range(count)]
            kind = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary()), ("state", pa.binary())]))
            yield pa.RecordBatch.from_arrays([pa.array([tree.as_py()] * count, pa.string()), nodes.values.field("place"), pa.array(paths, kind)], names=["tree", "block", "path"])

    return laid.select("tree", "block", "size", "nodes", "path").mapInArrow(lean(run), f"tree string, block long, path {PATH}")


class Tree:
    """Tiers of blocks of many trees at once, worked up to their roots."""

    def __init__(self, scratch: Scratch, nodes: DataFrame):
        """``nodes``: (tree, place, size, node, doc_id, other)."""
        self.scratch, self.tiers = scratch, [blocks(scratch, nodes)]
        while True:
            roots = scratch.save(block_roots(self.tiers[-1]), "roots")
            if roots.filter("size > 1").isEmpty():
                break
            self.tiers.append(blocks(scratch, roots.select("*", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("other"))))
        #: (tree, root)
        self.roots = roots.select("tree", F.col("node").alias("root"))

    def down(self, paths: DataFrame) -> DataFrame:
        """The lowest blocks with their ``path``, given the paths above each tree's root (tree, path)."""
        paths = paths.withColumn("block", F.lit(0).cast("long"))
        for tier in reversed(self.tiers[1:]):
            paths = self.scratch.save(child_paths(tier.join(paths, ["tree", "block"])), "paths")
        return self.tiers[0].join(paths, ["tree", "block"])


OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def answers(laid: DataFrame) -> DataFrame:
    """``OUT`` for each leaf of blocks (tree, block, size, nodes, path, subroot, root)."""
    names = [f.split()[0] for f in OUT.split(", ")]

    def run(batches):
        for batch in _few(batches):
            columns, changed, owner, which = [], [], [], []
            paths = batch.column(2).to_pylist()
            for b, (size, nodes, path) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), paths, strict=True)):
                nodes = nodes.values
                m = Midstates(nodes.field("node").to_pylist(), size <= BLOCK)
                tail = b"".join([part for r in path for part in (r["left"], r["right"])])
                # proofs: siblings of a level are those of all leaves below one node
                joined = [[b"".join(m.siblings(k * FAN**level, level)) for k in range(len(m.levels[level]))] for level in range(len(m.states))]
                proof, seen = [], {}
                for k, (leaf, other) in enumerate(zip(m.levels[0], nodes.field("other").to_pylist(), strict=True)):
                    proof.append(hashlib.sha256(b"".join([*(of[k // FAN**level] for level, of in enumerate(joined)), tail])).hexdigest())
                    node = m.folded(k, leaf if other is None else other.hex().encode())
                    if node not in seen:  # what leaves agree on here goes on once
                        seen[node] = len(changed)
                        changed.append(node)
                        owner.append(b)
                    which.append(seen[node])
                columns.append((nodes.field("doc_id"), [v.decode() for v in m.levels[0]], proof))
            tops = [t.decode() for t in resumed(changed, owner, paths)]
            folded = iter([tops[k] for k in which])
            for (ids, leaf, proof), subroot, root in zip(columns, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                n, root = len(proof), root.hex()
                mine = [next(folded) for _ in range(n)]
                cols = [ids, pa.array(leaf), pa.array([subroot.hex()] * n), pa.array([root] * n), pa.array(proof), pa.array(mine), pa.array([f == root for f in mine])]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return laid.select("size", "nodes", "path", "subroot", "root").mapInArrow(lean(run), OUT)


def manifest(docs: DataFrame) -> DataFrame:
    """``OUT`` for each row of (doc_id, source, lang, n_chars, text).

    Leaves of a language ascend by id, nulls first; rows that share an id ascend by leaf, and rows that are equal in all columns have equal leaves, siblings and
    answers.  A null is a value of its own: a null lang is the first tree, null ids the first leaves.  Texts of any length are hashed one at a
    time; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    # trees are named by their language; the marks keep null apart from any string, and ahead of all
    listed = leaves(docs).select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), "doc_id", F.col("leaf").alias("node"), "other")
    low = Tree(scratch, ranked(scratch, listed, ["doc_id", "node"]))
    tops = low.roots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("root").alias("node"), F.lit(None).cast("binary").alias("other"))
    tops = scratch.save(ranked(scratch, tops, ["lang"]), "tops").withColumn("doc_id", F.lit(None).cast("long"))
    top = Tree(scratch, tops)
    # the siblings of each language's root, by its place among the languages
    over = child_single(top.down(spark.createDataFrame([("", [])], f"tree string, path {PATH}")))
    paths = over.join(tops.select("place", F.col("lang").alias("tree"), F.col("node").alias("subroot")), "place").select("tree", "path", "subroot")
    paths = scratch.save(paths.crossJoin(F.broadcast(top.roots.select("root"))), "tops")  # one row: the root of all
    return answers(low.down(paths.select("tree", "path")).join(paths.select("tree", "subroot", "root"), "tree"))


def child_single(laid: DataFrame) -> DataFrame:
    """(place, path) of the nodes of a single tree's lowest blocks."""
    return child_paths(laid).select(F.col("block").alias("place"), "path")
