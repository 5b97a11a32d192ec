"""Searches from many sources at once, each with its own key: distances, farthest nodes, backbones, nearest sources.

Rounds do not follow the length of chains: nodes with two neighbours that are no source are taken out first, the chains between the others become
single edges (pointers along the arcs are doubled, so a chain of n nodes takes log n rounds), and the nodes inside get their distances from their chain's ends at last.

The search is delta-stepping.  Of the nodes in the current range of distances (a bucket), those that have improved relax their light edges until none does,
then the bucket's nodes relax their heavy edges once.  A round writes only what has improved; what holds is the least of all rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import both_ways, component_labels
from .lineage import cut

#: Written rounds that are read as they are before they are put together.
ROUNDS = 6


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def without_chains(pairs: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges (a, b, w) between the nodes that stay, and (x, end, dist): the two ends of the chain that a node x lies in.

    ``pairs``: both directions of each edge, once.  Nodes stay if they are in ``keep`` (n) or have another number of neighbours than two.  Rings without a node that
    stays are dropped: no search can reach them.
    """
    inner = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")).filter("c = 2").select(F.col("a").alias("n"))
    inner = cut(inner.join(keep, "n", "left_anti"))
    if inner.isEmpty():
        return pairs, None
    is_inner = lambda c: inner.select(F.col("n").alias(c), F.lit(True).alias(f"{c}_in"))
    arcs = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("w").alias("dist")).join(is_inner("u"), "u", "left").join(is_inner("v"), "v", "left")
    arcs = cut(arcs.select("u", "v", "dist", F.col("u_in").isNotNull().alias("u_in"), F.col("v_in").isNotNull().alias("v_in")))
    done = [arcs.filter("NOT v_in").select("u", "v", "u_in", "dist", F.col("v").alias("end"))]
    # an arc into a chain points at the arc that leads on
    on = arcs.select(F.col("u").alias("v"), F.col("v").alias("nv"))
    left = cut(arcs.filter("v_in").join(on, "v").filter("nv <> u").select("u", "v", "u_in", "dist", F.col("v").alias("nu"), "nv"))
    while True:
        ends = union(done).select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("dist").alias("d1"), "end")
        ahead = left.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("dist").alias("d2"), F.col("nu").alias("nu2"), F.col("nv").alias("nv2"))
        step = left.join(ends, ["nu", "nv"], "left").join(ahead, ["nu", "nv"], "left")
        step = cut(step.select("u", "v", "u_in", (F.col("dist") + F.coalesce("d1", "d2")).alias("dist"), F.col("nu2").alias("nu"), F.col("nv2").alias("nv"), "end"))
        fresh = step.filter("end IS NOT NULL").select("u", "v", "u_in", "dist", "end")
        if fresh.isEmpty():  # all that is left goes round in rings
            break
        done.append(fresh)
        left = step.filter("end IS NULL").drop("end")
    found = union(done)
    short = found.filter("NOT u_in AND u <> end").groupBy(F.col("u").alias("a"), F.col("end").alias("b")).agg(F.min("dist").alias("w"))
    return cut(short), cut(found.filter("u_in").select(F.col("u").alias("x"), "end", "dist"))


def latest(told: list[DataFrame]) -> DataFrame:
    best = union(told).groupBy("key", "node").agg(F.min(F.struct("dist", "root")).alias("s"))
    return best.select("key", "node", "s.dist", "s.root")


def distances(edges: DataFrame, sources: DataFrame, delta: float | None = None) -> DataFrame:
    """(key, node, dist, root): for each key, the distance over undirected edges (a, b, w >= 0) from the nearest of its sources (key, node), and which one that is.

    Among equally near sources the smallest counts.  ``delta`` is the width of a bucket; 16 mean weights if not given.  Nodes that a key does not
    reach have no row.
    """
    pairs = cut(both_ways(edges, keep=("w",)).groupBy("a", "b").agg(F.min(F.col("w").cast("double")).alias("w")))
    src = cut(sources.select("key", F.col("node").cast("long").alias("node")).distinct().select("key", "node", F.lit(0.0).alias("dist"), F.col("node").alias("root")))
    graph, inside = without_chains(pairs, src.select(F.col("node").alias("n")).distinct())
    width = delta or 16 * (graph.agg(F.avg("w")).first()[0] or 1.0) or 1.0
    light, heavy = graph.filter(F.col("w") <= width), graph.filter(F.col("w") > width)
    any_heavy = not heavy.isEmpty()
    told = [src]

    def relax(nodes: DataFrame, over: DataFrame) -> DataFrame:
        nonlocal told
        sent = nodes.join(over, F.col("node") == F.col("a")).groupBy("key", F.col("b").alias("node")).agg(F.min(F.struct((F.col("dist") + F.col("w")).alias("dist"), "root")).alias("s"))
        if len(told) > ROUNDS:
            told = [cut(latest(told))]
        best = latest(told).select("key", "node", F.struct("dist", "root").alias("old"))
        better = sent.join(best, ["key", "node"], "left").filter(F.col("old").isNull() | (F.col("s") < F.col("old")))
        out = cut(better.select("key", "node", "s.dist", "s.root"))
        told.append(out)
        return out

    low: float | None = 0.0
    while low is not None:
        high = (low // width + 1) * width
        now = latest(told).filter((F.col("dist") >= low) & (F.col("dist") < high))
        while True:
            now = relax(now, light).filter(F.col("dist") < high)
            if now.isEmpty():
                break
        if any_heavy:
            relax(latest(told).filter((F.col("dist") >= low) & (F.col("dist") < high)), heavy)
        low = latest(told).filter(F.col("dist") >= high).agg(F.min("dist")).first()[0]
    out = cut(latest(told))
    if inside is None:
        return out
    near = out.join(inside.select("x", F.col("end").alias("node"), F.col("dist").alias("more")), "node").groupBy("key", F.col("x").alias("node"))
    near = near.agg(F.min(F.struct((F.col("dist") + F.col("more")).alias("dist"), "root")).alias("s"))
    return cut(out.unionByName(near.select("key", "node", "s.dist", "s.root")))


def unit(edges: DataFrame) -> DataFrame:
    """Edges of weight 1: distances are hops."""
    return edges.select("a", "b", F.lit(1.0).alias("w"))


def parents(edges: DataFrame, hops: DataFrame) -> DataFrame:
    """(key, node, hops, parent) from (key, node, hops): the smallest neighbour one hop nearer, null for sources."""
    back = hops.select("key", F.col("node").alias("b"), (F.col("hops") - 1).alias("before"))
    ahead = hops.select("key", F.col("node").alias("a"), F.col("hops").alias("before"))
    up = both_ways(edges).distinct().join(back, "b").join(ahead, ["key", "a", "before"]).groupBy("key", F.col("b").alias("node")).agg(F.min("a").alias("parent"))
    return hops.join(up, ["key", "node"], "left").select("key", "node", "hops", "parent")


def farthest(found: DataFrame) -> DataFrame:
    """(key, node, dist) of each key's farthest node; the smallest among equals."""
    top = found.groupBy("key").agg(F.min(F.struct((-F.col("dist")).alias("d"), "node")).alias("s"))
    return top.select("key", "s.node", (-F.col("s.d")).alias("dist"))


def swept(nodes: DataFrame, edges: DataFrame, node: str = "ord") -> tuple[DataFrame, DataFrame]:
    """What ``diameters`` says, and (key, node, hops) from the tips: one search for the first sweep of all components, one for the second."""
    labels = component_labels(nodes, edges, node)
    first = labels.select(F.col("label").alias("key"), F.col("label").alias("node")).distinct()
    tips = cut(farthest(distances(unit(edges), first)).select("key", F.col("node").alias("tip")))
    second = distances(unit(edges), tips.select("key", F.col("tip").alias("node")))
    wide = tips.join(farthest(second), "key").select("key", "tip", F.col("node").alias("end"), F.col("dist").cast("int").alias("hops"))
    return cut(wide), second.select("key", "node", F.col("dist").cast("int").alias("hops"))


def diameters(nodes: DataFrame, edges: DataFrame, node: str = "ord") -> DataFrame:
    """(key, tip, end, hops) of each component, named by its smallest node: the node farthest from that, and the node farthest from there."""
    return swept(nodes, edges, node)[0]


def backbones(nodes: DataFrame, edges: DataFrame, node: str = "ord") -> DataFrame:
    """(key, place, node): a shortest path between the two ends of each component, from its tip; each step takes the smallest neighbour that is nearer the tip.

    A node's ancestors 1, 2, 4, ... steps up are found by doubling, and places between the ends by halving what is left, so a path of n nodes takes log n rounds.
    """
    wide, hops = swept(nodes, edges, node)
    steps = [cut(parents(edges, hops).filter("parent IS NOT NULL").select("node", F.col("parent").alias("up")))]
    longest = wide.agg(F.max("hops")).first()[0] or 0
    for _ in range(1, int(longest).bit_length()):  # 2, 4, 8, ... steps up
        steps.append(cut(steps[-1].join(steps[-1].select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up"))))
    path = wide.select("key", F.col("hops").alias("place"), F.col("end").alias("node"))
    for k in range(len(steps) - 1, -1, -1):
        more = path.join(steps[k], "node").select("key", (F.col("place") - (1 << k)).alias("place"), F.col("up").alias("node"))
        path = cut(path.unionByName(more))
    return path


def nearest_backbone(nodes: DataFrame, edges: DataFrame, node: str = "ord") -> DataFrame:
    """(node, hops, root): for each node, how far its component's backbone is, and the smallest of the nearest nodes there."""
    path = backbones(nodes, edges, node)
    found = distances(unit(edges), path.select(F.lit(0).alias("key"), "node"))
    return found.select("node", F.col("dist").cast("int").alias("hops"), "root")
