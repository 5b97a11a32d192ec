"""Ribbon geometry: chords, crowding pairs, bulge offsets, Bezier paths, zones, picking."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import component_labels
from .lineage import cut, numbered


@dataclass(frozen=True)
class BulgeParams:
    radius: float = 0.45  # of the mean chord
    strength: float = 0.14  # of the radius
    damping: float = 0.5
    iterations: int = 40
    cap: float = 0.15  # of a chord
    overlap: float = 0.5  # of a chord
    samples: int = 12


CURVE_STEP, CURVE_CAP = 0.15, 3.0
ZONE, MAGNET = 1.0 / 6.0, 0.22
TINY = 1e-6


def chords(contigs: DataFrame) -> DataFrame:
    """(ord, mid_x, mid_y, perp_x, perp_y, len): midpoint, unit perpendicular, length (at least 1e-6)."""
    dx, dy = F.col("out_x").cast("double") - F.col("in_x"), F.col("out_y").cast("double") - F.col("in_y")
    size = F.sqrt(dx * dx + dy * dy)
    rows = contigs.select("ord", ((F.col("in_x").cast("double") + F.col("out_x")) * 0.5).alias("mid_x"), ((F.col("in_y").cast("double") + F.col("out_y")) * 0.5).alias("mid_y"), dx.alias("dx"), dy.alias("dy"), F.when(size > 0, size).otherwise(TINY).alias("len"))
    return rows.select("ord", "mid_x", "mid_y", (-F.col("dy") / F.col("len")).alias("perp_x"), (F.col("dx") / F.col("len")).alias("perp_y"), "len")


def mean_chord(contigs: DataFrame, floor: float = 0.0) -> DataFrame:
    """One row: mean length of chords, those of length zero counted as ``floor``; 1 without contigs."""
    dx, dy = F.col("out_x").cast("double") - F.col("in_x"), F.col("out_y").cast("double") - F.col("in_y")
    size = F.sqrt(dx * dx + dy * dy)
    return contigs.agg(F.coalesce(F.avg(F.when(size > 0, size).otherwise(floor)), F.lit(1.0)).alias("mean_chord"))


def grid_pairs(points: DataFrame, radius: float, others: DataFrame | None = None, most: int = 2048) -> DataFrame:
    """Pairs (i, j, d) nearer than ``radius``, by an equi-join on grid cells of that size.

    Among one set of points (ord, x, y): each pair once, i < j.  With ``others``: i from points, j from others.  A cell with more than ``most`` points is met in
    blocks: its points fall into parts of about that size, and so do the points that look into it, and each part of one side meets
    each of the other under a key of its own.  Parts are drawn by number, so points that coincide are split as well.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.explode(F.array(*(F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    left = points.select(F.col("ord").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), around.alias("c")).select("i", "xi", "yi", "c.cx", "c.cy")
    right = (points if others is None else others).select(F.col("ord").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), cell("x").alias("cx"), cell("y").alias("cy"))
    keys = ["cx", "cy"]
    big = cut(right.groupBy(keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most))
    if not big.isEmpty():
        looks = left.join(big, keys).groupBy(keys).agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("m"))
        parts = cut(looks.select(*keys, F.ceil(F.col("m") / most).alias("ways_i"), F.ceil(F.col("n") / most).alias("ways_j")))
        own = lambda c: F.pmod(F.xxhash64(c), F.coalesce(f"ways_{c}", F.lit(1)))
        every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(f"ways_{c}", F.lit(1)) - 1))
        left = left.join(parts, keys, "left").withColumn("part_i", own("i")).withColumn("part_j", every("j")).drop("ways_i", "ways_j")
        right = right.join(parts, keys, "left").withColumn("part_j", own("j")).withColumn("part_i", every("i")).drop("ways_i", "ways_j")
        keys = [*keys, "part_i", "part_j"]
    d2 = F.pow(F.col("xi") - F.col("xj"), 2) + F.pow(F.col("yi") - F.col("yj"), 2)
    pairs = left.join(right, keys)
    if others is None:
        pairs = pairs.filter("i < j")
    return pairs.filter(d2 < radius * radius).select("i", "j", F.sqrt(d2).alias("d"))


def repel(frame: pd.DataFrame, pairs: tuple[np.ndarray, np.ndarray], movable: np.ndarray, start: np.ndarray, radius: float, p: BulgeParams) -> np.ndarray:
    """Offsets along the perpendiculars after damped rounds of repulsion; only ``movable`` rows move.

    ``pairs`` holds row numbers (i, j) in both directions; a row acts on i with its own perpendicular.
    """
    mid, perp, size = frame[["mid_x", "mid_y"]].to_numpy(), frame[["perp_x", "perp_y"]].to_numpy(), frame["len"].to_numpy()
    order = frame["ord"].to_numpy()
    i, j = pairs
    align = np.abs((perp[i] * perp[j]).sum(1))
    keep = align >= 0.2
    i, j, align = i[keep], j[keep], align[keep]
    at = np.lexsort((j, i))  # sums are made in the order of rows, wherever a row is solved
    i, j, align = i[at], j[at], align[at]
    tangent = np.column_stack([perp[:, 1], -perp[:, 0]])
    off, push, cap = start.copy(), p.strength * radius, p.cap * size
    for _ in range(p.iterations):
        at = mid + off[:, None] * perp
        v = at[i] - at[j]
        d2 = (v * v).sum(1)
        near = (d2 < radius * radius) & (np.abs((v * tangent[i]).sum(1)) <= p.overlap * size[i])
        d = np.sqrt(np.maximum(d2, 1e-30))
        same = d2 < 1e-9
        force = np.where(same, np.where(order[i] > order[j], 1.0, -1.0), (1 - d / radius) * (v * perp[i]).sum(1) / d)
        moved = np.bincount(i, np.where(near, push * align * force, 0.0), minlength=len(off))
        off = np.where(movable, np.clip(off + p.damping * moved, -cap, cap), off)
    return off


def _reach(chord: DataFrame, radius: float, p: BulgeParams) -> DataFrame:
    """Pairs (a, b) that can come within ``radius`` while both bulge: midpoints nearer than radius + cap * (len_a + len_b), ribbons
    not across one another (those pass by without a push).

    Long chords reach farther than short ones, so each pair is looked for on the grid of its longer chord's power of two.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log2((radius + 2 * p.cap * F.col("len")) / radius)))
    rows = chord.select("ord", F.col("mid_x").alias("x"), F.col("mid_y").alias("y"), F.col("perp_x").alias("px"), F.col("perp_y").alias("py"), "len", level.cast("int").alias("level"))
    top = rows.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]
    cell = lambda c, k: F.floor(F.col(c) / (F.lit(radius) * F.pow(F.lit(2.0), k)))
    nine = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    big = rows.select(F.col("ord").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), F.col("px").alias("pxi"), F.col("py").alias("pyi"), F.col("len").alias("li"), "level", F.explode(F.array(*(F.struct((cell("x", F.col("level")) + a).alias("cx"), (cell("y", F.col("level")) + b).alias("cy")) for a, b in nine))).alias("c"))
    all_levels = F.explode(F.sequence(F.col("level"), F.lit(top)))
    small = rows.select(F.col("ord").alias("j"), "x", "y", "px", "py", F.col("len").alias("lj"), F.col("level").alias("own"), all_levels.alias("level"))
    small = small.select("j", "x", "y", "px", "py", "lj", "own", "level", cell("x", F.col("level")).alias("cx"), cell("y", F.col("level")).alias("cy"))
    pairs = big.select("i", "xi", "yi", "pxi", "pyi", "li", "level", "c.cx", "c.cy").join(small, ["level", "cx", "cy"])
    once = (F.col("own") < F.col("level")) | (F.col("i") < F.col("j"))
    reach = radius + p.cap * (F.col("li") + F.col("lj"))
    d2 = F.pow(F.col("xi") - F.col("x"), 2) + F.pow(F.col("yi") - F.col("y"), 2)
    along = F.abs(F.col("pxi") * F.col("px") + F.col("pyi") * F.col("py")) >= 0.199  # the kernel decides at 0.2
    return pairs.filter(once & (F.col("i") != F.col("j")) & (d2 < reach * reach) & along).select(F.col("i").alias("a"), F.col("j").alias("b"))


CHORD = ("mid_x", "mid_y", "perp_x", "perp_y", "len")


def _rounds(members: DataFrame, links: DataFrame, radius: float, p: BulgeParams) -> DataFrame:
    """(ord, offset) of the members that a tile owns, after ``p.iterations`` rounds in each tile on its own.

    ``members`` (tile, ord, chord, moves, offset, own), ``links`` (tile, i, j).
    """
    no = lambda t: F.lit(None).cast(t)
    nodes = members.select("tile", "ord", *CHORD, "offset", "moves", "own", F.lit(False).alias("link"), F.lit(0).cast("long").alias("other"))
    both = links.select("tile", F.col("i").alias("ord"), *(no("double").alias(c) for c in CHORD), no("double").alias("offset"), no("boolean").alias("moves"), no("boolean").alias("own"), F.lit(True).alias("link"), F.col("j").alias("other"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        link = pdf[pdf["link"]]
        frame = pdf[~pdf["link"]].sort_values("ord")
        number = pd.Index(frame["ord"])
        at = number.get_indexer(link["ord"]), number.get_indexer(link["other"])
        off = repel(frame, at, frame["moves"].to_numpy().astype(bool), frame["offset"].to_numpy(), radius, p)
        own = frame["own"].to_numpy().astype(bool)
        return pd.DataFrame({"ord": frame["ord"].to_numpy()[own], "offset": off[own]})

    return nodes.unionByName(both).groupBy("tile").applyInPandas(run, "ord long, offset double")


def _halo(homes: DataFrame, both: DataFrame, hops: int, spread: float = 3.0) -> tuple[DataFrame, DataFrame, int]:
    """What the tiles need to make some rounds alone: members (tile, ord, depth), links (tile, i, j) and the number of rounds.

    A row after k rounds depends on rows at most k links away, so each tile takes in the rows around it, link by link, up to
    ``hops`` times, and stops earlier when all tiles together hold over ``spread`` times the rows that there are.
    """
    members = cut(homes.select("tile", "ord", F.lit(0).alias("depth")))
    most = spread * members.count()
    links = None
    for depth in range(1, hops + 1):
        edge = members.filter(F.col("depth") == depth - 1).select("tile", F.col("ord").alias("i"))
        step = cut(edge.join(both, "i").select("tile", "i", "j"))
        links = step if links is None else links.union(step)
        seen = step.select("tile", F.col("j").alias("ord"), F.lit(depth).alias("depth"))
        members = cut(members.union(seen).groupBy("tile", "ord").agg(F.min("depth").alias("depth")))
        if members.count() > most:
            break
    return members, links, depth


def _settle(rows: DataFrame, pairs: DataFrame, radius: float, p: BulgeParams, most: int, hops: int) -> DataFrame:
    """(ord, offset) of the rows that move and have a row near them; ``rows`` (ord, chord, moves, offset), ``pairs`` (a, b) once each.

    Rows that move and can meet form clusters.  A cluster of up to ``most`` rows is solved in one task, all rounds at once.  A larger one
    is cut into tiles of ``most`` rows along the Morton curve of their midpoints.  A tile takes in the rows up to
    ``hops`` links around it (its halo), makes as many rounds alone as its halo allows and hands on the offsets of its own rows,
    from which all tiles start their next rounds.  Results are those of one task to the last bit: every row sums its pushes in the
    same order, wherever it is.  A task holds a tile, its halo and their links; a row's own neighbours are in one task.
    """
    movers = rows.filter("moves").select("ord")
    both = pairs.select(F.col("a").alias("i"), F.col("b").alias("j")).union(pairs.select("b", "a"))
    both = cut(both.join(movers.withColumnRenamed("ord", "i"), "i", "left_semi"))
    couple = both.join(movers.withColumnRenamed("ord", "j"), "j", "left_semi").filter("i < j").select(F.col("i").alias("a"), F.col("j").alias("b"))
    labels = component_labels(both.select(F.col("i").alias("ord")).distinct(), couple, closed=True)
    large = cut(labels.groupBy("label").count().filter(F.col("count") > most).select("label"))
    own = F.col("depth") == 0

    def placed(members: DataFrame, deepest: int) -> DataFrame:
        inner = F.col("moves") & (F.col("depth") < deepest)
        return members.join(rows, "ord").select("tile", "ord", *CHORD, inner.alias("moves"), "offset", own.alias("own"))

    small = labels.join(large, "label", "left_anti").select(F.col("label").alias("tile"), "ord")
    out = labels.limit(0).select("ord", F.lit(0.0).alias("offset"))
    if not small.isEmpty():
        members, links, _ = _halo(small, both, 1)  # a cluster is whole: around it are only rows that stand still
        out = _rounds(placed(members, 1), links, radius, p)
    if large.isEmpty():
        return out
    wide = cut(labels.join(large, "label", "left_semi").join(rows, "ord").select("label", "ord", "mid_x", "mid_y", "offset"))
    box = wide.agg(F.min("mid_x"), F.max("mid_x"), F.min("mid_y"), F.max("mid_y")).first()
    cell = lambda c, lo, hi: F.floor((F.col(c) - lo) * (((1 << CODE_BITS) - 1) / ((hi - lo) or 1.0))).cast("long")
    code = _spread(cell("mid_x", box[0], box[1])).bitwiseOR(F.shiftleft(_spread(cell("mid_y", box[2], box[3])), 1))
    homes = numbered(wide.select("label", code.alias("code"), "ord"), [F.col("label"), F.col("code"), F.col("ord")], "rank")
    homes = cut(homes.select(F.expr(f"rank div {most}").alias("tile"), "ord"))
    members, links, deepest = _halo(homes, both, min(hops, p.iterations))
    members, links = cut(placed(members, deepest)), cut(links)
    now, left = wide.select("ord", "offset"), p.iterations
    while left > 0:
        start = members.withColumnRenamed("offset", "still").join(now.withColumnRenamed("offset", "last"), "ord", "left").withColumn("offset", F.coalesce("last", "still"))
        now = cut(_rounds(start, links, radius, replace(p, iterations=min(left, deepest))))
        left -= deepest
    return out.union(now)


def bulge_offsets(contigs: DataFrame, p: BulgeParams | None = None, most: int = 20_000, hops: int = 8) -> DataFrame:
    """(ord, offset): how far each ribbon bows out of crowded spots.  Contigs that can meet form clusters, those of up to ``most`` one
    task each, larger ones in tiles with halos (see ``_settle``).  No contigs, no rows; a contig that meets none has offset 0."""
    p = p or BulgeParams()
    chord = cut(chords(contigs))
    radius = max(mean_chord(contigs, TINY).first()[0] * p.radius, TINY)
    pairs = cut(_reach(chord, radius, p))
    if pairs.isEmpty():
        return chord.select("ord", F.lit(0.0).alias("offset"))
    found = _settle(chord.withColumn("moves", F.lit(True)).withColumn("offset", F.lit(0.0)), pairs, radius, p, most, hops)
    return chord.select("ord").join(found, "ord", "left").select("ord", F.coalesce("offset", F.lit(0.0)).alias("offset"))


def local_bulge(contigs: DataFrame, active: DataFrame, offsets: DataFrame, p: BulgeParams | None = None, most: int = 20_000, hops: int = 8) -> DataFrame:
    """(ord, offset) of the active contigs, from zero, against each other and against all others where they stand.

    Active contigs that can meet form clusters, as in ``bulge_offsets``, each with the others around it.  So gestures in different
    places are different tasks, and one over a great many contigs is cut into tiles.
    """
    p = p or BulgeParams()
    chord = cut(chords(contigs))
    radius = max(mean_chord(contigs, TINY).first()[0] * p.radius, TINY)
    moving = active.select("ord").distinct().withColumn("moves", F.lit(True))
    start = F.when(F.col("moves"), 0.0).otherwise(F.coalesce("offset", F.lit(0.0)))
    rows = chord.join(moving, "ord", "left").join(offsets, "ord", "left").withColumn("moves", F.coalesce("moves", F.lit(False)))
    rows = cut(rows.select(*chord.columns, "moves", start.alias("offset")))
    found = _settle(rows, _reach(chord, radius, p), radius, p, most, hops)
    return rows.filter("moves").select("ord").join(found, "ord", "left").select("ord", F.coalesce("offset", F.lit(0.0)).alias("offset"))


def effective_ports(ports: DataFrame, moves: DataFrame) -> DataFrame:
    """Ports (key, x, y) plus their moves (key, dx, dy)."""
    d = lambda c: F.coalesce(c, F.lit(0.0))
    return ports.join(moves, "key", "left").select("key", (F.col("x") + d("dx")).alias("x"), (F.col("y") + d("dy")).alias("y"))


def bezier_paths(contigs: DataFrame, offsets: DataFrame | None = None, curves: DataFrame | None = None, samples: int = 12) -> DataFrame:
    """(ord, s, x, y): points on the quadratic curve whose middle stands ``offset`` from the chord.

    ``offsets`` (ord, offset) are lengths, ``curves`` (ord, curve) are shares of the chord on top.
    """
    k = max(2, samples)
    rows = contigs.select("ord", *(F.col(c).cast("double").alias(c) for c in ("in_x", "in_y", "out_x", "out_y"))).join(chords(contigs), "ord")
    for extra, name in ((offsets, "offset"), (curves, "curve")):
        rows = rows.join(extra, "ord", "left") if extra is not None else rows.withColumn(name, F.lit(0.0))
    bow = 2 * (F.coalesce("offset", F.lit(0.0)) + F.coalesce("curve", F.lit(0.0)) * F.col("len"))
    rows = rows.withColumn("cx", F.col("mid_x") + bow * F.col("perp_x")).withColumn("cy", F.col("mid_y") + bow * F.col("perp_y"))
    rows = rows.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("t", F.col("s") / float(k - 1))
    t, r = F.col("t"), 1 - F.col("t")
    curve = lambda c: r * r * F.col(f"in_{c}") + 2 * r * t * F.col(f"c{c}") + t * t * F.col(f"out_{c}")
    return rows.select("ord", "s", curve("x").alias("x"), curve("y").alias("y"))


def start_indices(n: int, size: int) -> list[int]:
    """Where each of n paths of ``size`` points starts in a flat list, and the end."""
    return [i * size for i in range(n + 1)]


def zone_samples(samples: int, zone: int) -> tuple[int, int]:
    """First and last sample of a zone: 0 the IN end, 1 the middle, 2 the OUT end."""
    edge = max(1, int(np.floor(samples * ZONE + 0.5)))
    return ((0, edge), (edge, samples - 1 - edge), (samples - 1 - edge, samples - 1))[zone]


def styled(contigs: DataFrame, hovered: Column, selected: Column, hover_color=(255, 240, 150, 255), select_color=(255, 80, 80, 255), wider: float = 1.6) -> DataFrame:
    """Ribbons with the colours of hovered and selected ones, and those wider."""
    mark = hovered | selected
    color = lambda c, k: F.when(hovered, F.lit(hover_color[k])).when(selected, F.lit(select_color[k])).otherwise(F.col(c)).cast("short").alias(c)
    return contigs.select(*(color(c, "rgba".index(c)) if c in ("r", "g", "b", "a") else (F.when(mark, F.col("width") * wider).otherwise(F.col("width")).alias("width") if c == "width" else F.col(c)) for c in contigs.columns))


def view_fit(bbox: DataFrame, width: float, height: float) -> DataFrame:
    """Centre and zoom (log2 of pixels for a unit) that show the whole box."""
    extent = lambda lo, hi: F.when(F.col(hi) - F.col(lo) > 0, F.col(hi) - F.col(lo)).otherwise(1.0)
    return bbox.select(((F.col("min_x") + F.col("max_x")) / 2).alias("x"), ((F.col("min_y") + F.col("max_y")) / 2).alias("y"), F.log2(F.least(F.lit(width) / extent("min_x", "max_x"), F.lit(height) / extent("min_y", "max_y"))).alias("zoom"))


def _to(side: str) -> Column:
    return F.pow(F.col("px") - F.col(f"{side}_x"), 2) + F.pow(F.col("py") - F.col(f"{side}_y"), 2)


def nearest_side() -> Column:
    """1 (OUT) if the point (px, py) is strictly nearer to it, else 0."""
    return F.when(_to("out") < _to("in"), 1).otherwise(0)


def grab_zone() -> Column:
    """Zone of a contig that the point (px, py) grabs: near an end its port, else by where it falls along the chord."""
    ex, ey = F.col("out_x") - F.col("in_x"), F.col("out_y") - F.col("in_y")
    l2 = ex * ex + ey * ey
    l2 = F.when(l2 > 0, l2).otherwise(1e-12)
    along = ((F.col("px") - F.col("in_x")) * ex + (F.col("py") - F.col("in_y")) * ey) / l2
    caught = F.least(_to("in"), _to("out")) < MAGNET * MAGNET * l2
    return F.when(caught, F.when(_to("in") <= _to("out"), 0).otherwise(2)).when(along < ZONE, 0).when(along > 1 - ZONE, 2).otherwise(1)


def pick_box(paths: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Contigs with a path point in the rectangle."""
    return paths.filter(F.col("x").between(min(x0, x1), max(x0, x1)) & F.col("y").between(min(y0, y1), max(y0, y1))).select("ord").distinct()


def pick_point(paths: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """The contig with the nearest path point within ``radius``: at most one row."""
    d = F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2)
    return paths.filter(d <= radius * radius).orderBy(d, "ord").limit(1).select("ord")


#: Bits of a code for each axis.
CODE_BITS = 16


def _spread(v: Column) -> Column:
    """A number below 2^16 with a zero bit ahead of each of its bits."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def code_ranges(x0: int, y0: int, x1: int, y1: int, most: int = 64) -> list[tuple[int, int]]:
    """Ranges of Morton codes that cover the cells x0..x1, y0..y1: squares of the quadtree, split largest first until there are ``most``, neighbours joined."""
    inside: list[tuple[int, int]] = []
    open_ = [(CODE_BITS, 0, 0)]
    while open_ and len(open_) + len(inside) < most:
        open_.sort()
        level, a, b = open_.pop()
        if level == 0:
            open_.append((level, a, b))
            break
        half = 1 << (level - 1)
        for p, q in ((a, b), (a + half, b), (a, b + half), (a + half, b + half)):
            if p > x1 or q > y1 or p + half <= x0 or q + half <= y0:
                continue
            whole = x0 <= p and y0 <= q and p + half - 1 <= x1 and q + half - 1 <= y1
            (inside if whole else open_).append((level - 1, p, q))
    plain = lambda v: sum((v >> k & 1) << 2 * k for k in range(CODE_BITS))
    starts = sorted((plain(p) | plain(q) << 1, 1 << 2 * level) for level, p, q in (*inside, *open_))
    out: list[tuple[int, int]] = []
    for start, size in starts:
        if out and out[-1][1] + 1 == start:
            out[-1] = out[-1][0], start + size - 1
        else:
            out.append((start, start + size - 1))
    return out


class PathIndex:
    """Path points in the order of their Morton codes, written so that a pick reads only files and row groups near it."""

    def __init__(self, paths: DataFrame, parts: int | None = None):
        """paths (ord, x, y); points without two finite numbers cannot be picked.  ``parts``: files, the session's partitions if not given."""
        good = paths.filter("abs(x) < double('inf') AND abs(y) < double('inf')")
        box = good.agg(*(f(c).cast("double") for c in "xy" for f in (F.min, F.max))).first()
        self.low = box[0] or 0.0, box[2] or 0.0
        self.scale = tuple(((1 << CODE_BITS) - 1) / ((hi - lo) or 1.0) if lo is not None else 1.0 for lo, hi in ((box[0], box[1]), (box[2], box[3])))
        cell = lambda c, k: F.floor((F.col(c) - self.low[k]) * self.scale[k]).cast("long")
        code = _spread(cell("x", 0)).bitwiseOR(F.shiftleft(_spread(cell("y", 1)), 1))
        parts = parts or int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.points = cut(good.select("ord", "x", "y", code.alias("code")).repartitionByRange(parts, "code").sortWithinPartitions("code"))

    def near(self, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
        """Points whose codes are among those that cover the rectangle."""
        top = (1 << CODE_BITS) - 1
        at = lambda v, k: min(max(math.floor((v - self.low[k]) * self.scale[k]), -1), top + 1)
        cells = [at(v, k) for v, k in ((x0, 0), (y0, 1), (x1, 0), (y1, 1))]
        ranges = code_ranges(*cells) if cells[0] <= top and cells[1] <= top and cells[2] >= 0 and cells[3] >= 0 else []
        found = reduce(lambda a, b: a | b, [F.col("code").between(a, b) for a, b in ranges], F.lit(False))
        return self.points.filter(found).select("ord", "x", "y")

    def pick_box(self, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
        """Contigs with a path point in the rectangle."""
        box = min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)
        return pick_box(self.near(*box), *box)

    def pick_point(self, x: float, y: float, radius: float) -> DataFrame:
        """The contig with the nearest path point within ``radius``: at most one row."""
        return pick_point(self.near(x - radius, y - radius, x + radius, y + radius), x, y, radius)
