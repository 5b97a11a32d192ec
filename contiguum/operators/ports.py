"""Port graphs: two nodes for each segment, an internal edge between them, an external edge for each link."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gfa as fn
from .components import component_labels
from .graph import AssemblyGraph
from .lineage import cut, numbered

EXTERNAL_LENGTH = 1.0


def port_nodes(g: AssemblyGraph) -> DataFrame:
    """(ord, port_id, contig, side); ord is 2 * segment index + side, which is also the node key."""
    return g.ports.select((F.col("node_ord") * 2 + F.col("side")).alias("ord"), fn.port_id(F.col("node_id"), F.col("port")).alias("port_id"), F.col("node_id").alias("contig"), "side")


def port_edges(g: AssemblyGraph) -> DataFrame:
    """(ord, u, v, kind, target): internal edges in segment order, then external ones in link order."""
    name = lambda end: fn.port_id(F.col(f"{end}.node_id"), F.col(f"{end}.port"))
    port = lambda p: fn.port_id(F.col("id"), F.lit(p))
    inside = g.segments.select("ord", port("IN").alias("u"), port("OUT").alias("v"), F.lit("INTERNAL").alias("kind"), fn.visual_length(F.col("length_bp")).alias("target"))
    n = g.segments.agg(F.count(F.lit(1)).alias("n"))
    outside = g.links.crossJoin(F.broadcast(n)).select((F.col("ord") + F.col("n")).alias("ord"), name("start").alias("u"), name("end").alias("v"), F.lit("EXTERNAL").alias("kind"), F.lit(EXTERNAL_LENGTH).alias("target"))
    return inside.unionByName(outside)


def link_keys(g: AssemblyGraph) -> DataFrame:
    """(ord, a, b): links between node keys (2 * segment index + side)."""
    seg = g.segments.select(F.col("id").alias("node_id"), F.col("ord").alias("at"))
    rows = g.links.select("ord", "start", "end")
    for name, end in (("a", "start"), ("b", "end")):
        rows = rows.withColumn("node_id", F.col(f"{end}.node_id")).join(seg, "node_id").withColumn(name, F.col("at") * 2 + fn.side(F.col(f"{end}.port"))).drop("node_id", "at")
    return rows.select("ord", "a", "b")


def junctions(links: DataFrame) -> DataFrame:
    """(port, junction): ports joined by links, numbered by their first port.  Ports without links are in none."""
    ports = links.select(F.explode(F.array("a", "b")).alias("port")).distinct()
    labels = component_labels(ports, links, "port", closed=True)
    ids = numbered(labels.filter("port = label").select("label"), [F.col("label")], "junction")
    return cut(labels.join(ids, "label").select("port", "junction"))


def canonical_pairs(links: DataFrame) -> DataFrame:
    """(a, b, ord): each pair of different ends once, smaller first, with the first of its links."""
    return links.filter("a <> b").groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("ord").alias("ord")).select(F.col("lo").alias("a"), F.col("hi").alias("b"), "ord")


def junction_directions(junctions_: DataFrame, ports: DataFrame) -> DataFrame:
    """(junction, n, mx, my): how many ports meet, and the mean of the unit vectors along their contigs, away from the junction.

    ports (key, x, y) with key = 2 * contig + side.  A contig of no length counts as a zero vector.
    """
    near = ports.select(F.col("key").alias("port"), "x", "y")
    far = ports.select(F.col("key").bitwiseXOR(F.lit(1).cast("long")).alias("port"), F.col("x").alias("fx"), F.col("y").alias("fy"))
    dx, dy = F.col("fx") - F.col("x"), F.col("fy") - F.col("y")
    size = F.sqrt(dx * dx + dy * dy)
    unit = lambda v: F.avg(F.when(size > 0, v / size).otherwise(0.0))
    return junctions_.join(near, "port").join(far, "port").groupBy("junction").agg(F.count(F.lit(1)).alias("n"), unit(dx).alias("mx"), unit(dy).alias("my"))


def contig_adjacency(links: DataFrame) -> DataFrame:
    """(contig, neighbor, link): both directions of links between different contigs; parallel links stay."""
    a, b = F.shiftright("a", 1), F.shiftright("b", 1)
    one = links.select(a.alias("contig"), b.alias("neighbor"), F.col("ord").alias("link"))
    return one.union(links.select(b, a, "ord")).filter("contig <> neighbor")


def link_incidence(links: DataFrame) -> DataFrame:
    """(contig, link): each link at each of its contigs, once for a self-loop."""
    ends = F.array_distinct(F.array(F.shiftright("a", 1), F.shiftright("b", 1)))
    return links.select(F.explode(ends).alias("contig"), F.col("ord").alias("link"))


def offsets(rows: DataFrame, contigs: DataFrame, key: str = "contig") -> DataFrame:
    """Start of each contig's run in a flat list of ``rows``: (contig, degree, start), with 0 rows for those without.

    The running sum goes by blocks of 65,536 contigs: sums of blocks first, then within blocks.
    """
    deg = contigs.select(F.col("ord").alias(key)).join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("degree")), key, "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    deg = deg.withColumn("block", F.shiftright(F.col(key), 16))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    base = deg.groupBy("block").agg(F.sum("degree").alias("s")).select("block", F.coalesce(F.sum("s").over(before.orderBy("block")), F.lit(0)).alias("base"))
    run = F.coalesce(F.sum("degree").over(before.partitionBy("block").orderBy(key)), F.lit(0))
    return deg.join(base, "block").select(key, "degree", (F.col("base") + run).alias("start"))


def local_sim(links: DataFrame, region: DataFrame) -> DataFrame:
    """Distinct links with an end in the region (contig)."""
    return link_incidence(links).join(region.select("contig"), "contig", "left_semi").select("link").distinct()
