"""Scenes: contigs as ribbons, links as segments, a bounding box; all by joins on positions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gfa as fn
from .graph import AssemblyGraph
from .ports import link_keys


@dataclass(frozen=True)
class Scene:
    """``contigs`` (ord, id, in_x, in_y, out_x, out_y, width, r, g, b, a), ``links`` (ord, x0..y1, contig_a, side_a, contig_b, side_b), one-row ``bbox``."""

    source: str
    contigs: DataFrame
    links: DataFrame
    bbox: DataFrame


def grid_positions(g: AssemblyGraph, columns: int = 100, spacing: float = 20.0) -> DataFrame:
    """Closed-form positions: contigs on a grid by index, each as long as its visual length."""
    x, y = (F.col("ord") % columns) * spacing, F.floor(F.col("ord") / columns) * spacing
    port = lambda p, px: F.struct(fn.port_id(F.col("id"), F.lit(p)).alias("port_id"), px.alias("x"), y.cast("double").alias("y"))
    each = F.explode(F.array(port("IN", x.cast("double")), port("OUT", x + fn.visual_length(F.col("length_bp"))))).alias("p")
    return g.segments.select(each).select("p.*")


def merged_positions(computed: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Computed positions with overrides on top; an override of an unknown port stays."""
    if overrides is None:
        return computed
    new = overrides.select("port_id", F.col("x").alias("nx"), F.col("y").alias("ny"))
    return computed.join(new, "port_id", "full_outer").select("port_id", F.coalesce("nx", "x").alias("x"), F.coalesce("ny", "y").alias("y"))


def bounding_box(points: DataFrame) -> DataFrame:
    """Extent of all points as doubles; zeros if there are none."""
    lo = lambda c: F.coalesce(F.min(c), F.lit(0.0))
    hi = lambda c: F.coalesce(F.max(c), F.lit(0.0))
    return points.agg(lo("x").alias("min_x"), lo("y").alias("min_y"), hi("x").alias("max_x"), hi("y").alias("max_y"))


def scene_contigs(g: AssemblyGraph, positions: DataFrame) -> DataFrame:
    ends = positions.select(fn.port_owner(F.col("port_id")).alias("id"), F.substring_index("port_id", ":", -1).alias("port"), "x", "y")
    at = lambda p, c: F.max(F.when(F.col("port") == p, F.col(c))).cast("float")
    ends = ends.groupBy("id").agg(*(at(p, c).alias(f"{p.lower()}_{c}") for p in ("IN", "OUT") for c in "xy"))
    rows = g.segments.select("ord", "id", "coverage").join(ends, "id").join(g.components.select("id", "cid"), "id")
    color = fn.palette(F.col("cid"))
    return rows.select("ord", "id", "in_x", "in_y", "out_x", "out_y", fn.ribbon_width(F.col("coverage")).cast("float").alias("width"), *(c.alias(n) for n, c in color.items()))


def scene_links(g: AssemblyGraph, positions: DataFrame) -> DataFrame:
    pos = positions.join(g.ports.select(fn.port_id(F.col("node_id"), F.col("port")).alias("port_id"), (F.col("node_ord") * 2 + F.col("side")).alias("key")), "port_id").select("key", F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"))
    return link_positions(link_keys(g), pos)


def link_positions(links: DataFrame, ports: DataFrame, baked: DataFrame | None = None) -> DataFrame:
    """Links (ord, a, b) between node keys, drawn from port positions (key, x, y).

    With ``baked`` (ord, x0, y0, x1, y1), an end whose port has no position stands where the scene's file has it; without, such links are left out.
    """
    ends = lambda k, n: ports.select(F.col("key").alias(k), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    how = "inner" if baked is None else "left"
    rows = links.join(ends("a", 0), "a", how).join(ends("b", 1), "b", how)
    if baked is not None:
        old = [f"{c}{n}" for n in (0, 1) for c in "xy"]
        rows = rows.join(baked.select("ord", *(F.col(c).alias(f"old_{c}") for c in old)), "ord", "left").select("ord", "a", "b", *(F.coalesce(c, f"old_{c}").alias(c) for c in old))
    half, low = lambda c: F.shiftright(c, 1), lambda c: F.col(c) % 2
    return rows.select("ord", "x0", "y0", "x1", "y1", half("a").alias("contig_a"), low("a").alias("side_a"), half("b").alias("contig_b"), low("b").alias("side_b"))


def build_scene(g: AssemblyGraph, positions: DataFrame, source: str = "") -> Scene:
    return Scene(source, scene_contigs(g, positions), scene_links(g, positions), bounding_box(positions))


def ribbon_bbox(contigs: DataFrame) -> DataFrame:
    """Extent of ribbons' two ends."""
    lo = lambda c: F.min(F.least(f"in_{c}", f"out_{c}"))
    hi = lambda c: F.max(F.greatest(f"in_{c}", f"out_{c}"))
    return contigs.agg(lo("x").alias("min_x"), lo("y").alias("min_y"), hi("x").alias("max_x"), hi("y").alias("max_y"))


def checksums(contigs: DataFrame) -> DataFrame:
    """Counts and column sums with three decimals, to compare two decoders."""
    total = lambda c: F.round(F.sum(F.col(c).cast("double")), 3).alias(f"sum_{c}")
    return contigs.agg(F.count(F.lit(1)).alias("n"), *(total(c) for c in ("in_x", "in_y", "out_x", "out_y", "width", "r", "g", "b", "a")))
