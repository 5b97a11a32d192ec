"""Iterative graph operators: components and breadth-first search to a depth.  Each round is a join on written tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .lineage import cut

CHUNK = 4_000_000  # edges that a task holds at once


def both_ways(edges: DataFrame, a: str = "a", b: str = "b", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each undirected edge in both directions, without self-loops."""
    return edges.select(F.col(a).alias("a"), F.col(b).alias("b"), *keep).union(edges.select(F.col(b).alias("a"), F.col(a).alias("b"), *keep)).filter("a <> b")


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of some edges, but the smallest of its component among them, with that smallest one."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = np.arange(len(names))
    a, b = at[: len(u)], at[len(u) :]
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            below = np.flatnonzero(root != np.arange(len(names)))
            return names[below], names[root[below]]
        np.minimum.at(root, np.maximum(x, y)[open_], np.minimum(x, y)[open_])  # larger roots go below smaller ones
        while not np.array_equal(root, root[root]):
            root = root[root]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with those of each partition, some millions at a time, replaced by the stars of their components."""

    def run(batches):
        held, size = [], 0

        def star():
            t = pa.Table.from_batches(held)
            up, down = forest(t.column("u").to_numpy(), t.column("v").to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(up), pa.array(down)], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                yield star()
                held, size = [], 0
        if size:
            yield star()

    return edges.mapInArrow(run, "u long, v long")


def component_labels(nodes: DataFrame, edges: DataFrame, node: str = "ord", closed: bool = False) -> DataFrame:
    """(node, label): the smallest node of each component.  Edges with an end outside ``nodes`` do not count (``closed``: there are none).

    Large-star and small-star steps (Kiveris et al., 2014) in turn, until every edge points from a node to a root and
    no node has two; there is no bound on the rounds, and chains in any order take about log n of them.  Before the first round and
    after each, a partition's edges are contracted where they are.  A round is one written table of at most as many edges as
    the one before; minima are pre-aggregated, so hubs are no hot keys.
    """
    ship(edges.sparkSession)
    own = nodes.select(F.col(node).cast("long").alias("n"))
    cur = edges.filter("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct()
    if not closed:
        own = cut(own)
        for end in ("u", "v"):
            cur = cur.join(own.withColumnRenamed("n", end), end, "left_semi")
    cur = cut(contracted(cur.select("u", "v")))
    while not stars(cur):
        # large-star: neighbours above a node go to the smallest of the node and its neighbours
        both = both_ways(cur, "u", "v")
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: a node and its neighbours below go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        cur = cut(contracted(small.filter("u <> v").distinct()))
    return cut(own.join(cur, F.col("n") == F.col("u"), "left").select(F.col("n").alias(node), F.coalesce("v", "n").alias("label")))


def relabelled(labels: DataFrame, nodes: DataFrame, edges: DataFrame, touched: DataFrame, joined: DataFrame) -> DataFrame:
    """(ord, label) after edits, from the labels before: what ``component_labels`` says of the new graph.

    ``nodes`` (ord) and ``edges`` (a, b) are those of the new graph; ``touched`` (ord) are nodes that have gone or lost a link, ``joined`` (a, b) the new
    links.  Only components with a touched node are searched again, and new links are followed between labels.  The other rows are read
    once, to find the touched ones and to give merged components their new name; they are in no round.
    """
    hit = cut(labels.join(touched, "ord", "left_semi").select("label").distinct())
    rest = labels.join(hit, "label", "left_anti").select("ord", "label")
    new = nodes.join(labels, "ord", "left_anti").select("ord", F.col("ord").alias("label"))
    again = cut(labels.join(hit, "label", "left_semi").join(nodes, "ord", "left_semi").select("ord"))
    inside = edges.join(again.select(F.col("ord").alias("a")), "a", "left_semi").select("a", "b")
    now = rest.union(component_labels(again, inside)).union(new)
    at = lambda end: now.select(F.col("ord").alias(end), F.col("label").alias(f"{end}_label"))
    links = joined.join(at("a"), "a").join(at("b"), "b").filter("a_label <> b_label").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
    links = cut(links)
    if links.isEmpty():
        return cut(now)
    names = links.select(F.explode(F.array("a", "b")).alias("ord")).distinct()
    names = component_labels(names, links, closed=True).select(F.col("ord").alias("label"), F.col("label").alias("to"))
    return cut(now.join(names, "label", "left").select("ord", F.coalesce("to", "label").alias("label")))


def stars(edges: DataFrame) -> bool:
    """Whether each node of (u, v) points at one root: no u twice, and no v that is a u."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up")))).alias("e")).select("e.n", "e.up")
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.min("up").alias("root")).filter("up > 1 OR (up = 1 AND root = 0)").isEmpty()


def hops(edges: DataFrame, seeds: DataFrame, depth: int | None = None, node: str = "n") -> DataFrame:
    """Breadth-first search from all seeds: (node, hops, parent); the parent is the smallest on the previous ring, null for seeds.

    To a ``depth``, ring by ring: a neighbour of a ring is on that ring, the one before or the next, so only these are compared.
    Without one, the search of ``searches.distances``, whose rounds do not follow the length of chains.
    """
    if depth is None:
        from . import searches

        found = searches.distances(searches.unit(edges), seeds.select(F.lit(0).alias("key"), F.col(node).alias("node")))
        found = searches.parents(edges, found.select("key", "node", F.col("dist").cast("int").alias("hops")))
        return found.select(F.col("node").alias(node), "hops", "parent")
    pairs = cut(both_ways(edges).distinct())
    ring = cut(seeds.select(F.col(node).cast("long").alias("n")).distinct().withColumn("hops", F.lit(0)).withColumn("parent", F.lit(None).cast("long")))
    rings, before = [ring], ring.select("n").limit(0)
    d = 0
    while d < depth:
        d += 1
        new = pairs.join(ring.select(F.col("n").alias("a")), "a").groupBy("b").agg(F.min("a").alias("parent"))
        new = new.join(before.union(ring.select("n")).select(F.col("n").alias("b")), "b", "left_anti")
        before, ring = ring.select("n"), cut(new.select(F.col("b").alias("n"), F.lit(d).alias("hops"), "parent"))
        if ring.isEmpty():
            break
        rings.append(ring)
    out = rings[0]
    for r in rings[1:]:
        out = out.union(r)
    return out.withColumnRenamed("n", node)
