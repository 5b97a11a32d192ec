"""Registered queries of the graph engine on the events bridge, and their DuckDB equivalents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gfa as fn
from ..operators import components as cc
from ..operators import edits as ed
from ..operators import layout as lay
from ..operators import ports as po
from ..operators import relax as rx
from ..operators import ribbons as rb
from ..operators import scene as sc
from ..operators import searches as se
from ..operators.graph import END, AssemblyGraph
from ..operators.lineage import cut, shared_folder
from ..sources import bridge, gfa, gfa_source, scene_file

_GRAPHS: dict[tuple[str, str], AssemblyGraph] = {}


def graph(spark: SparkSession, sf_dir: str) -> AssemblyGraph:
    """The bridge graph of a directory, parsed once for each application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GRAPHS:
        _GRAPHS[key] = bridge.bridge_graph(spark, sf_dir)
    return _GRAPHS[key]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.bridge_lines(bridge.events(spark, sf_dir)).select(F.col("k").alias("line_no"), F.col("line").alias("value"))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ribbons on the closed-form grid, in double precision."""
    x, y = (F.col("ord") % 100) * 20.0, F.floor(F.col("ord") / 100) * 20.0
    tilt = (F.col("ord") % 7) * 0.5
    out_x = fn.visual_length(F.col("length_bp"), base=x + 1.0)  # added in the order of the SQL: x, 1, the length; ties between ends hang on the last bit
    return graph(spark, sf_dir).segments.select("ord", "id", x.alias("in_x"), y.cast("double").alias("in_y"), out_x.alias("out_x"), (y + tilt).cast("double").alias("out_y"))


def port_points(c: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.lit(0).alias("s"), F.col("in_x").alias("x"), F.col("in_y").alias("y")), F.struct(F.lit(1).alias("s"), F.col("out_x").alias("x"), F.col("out_y").alias("y")))
    return c.select("ord", F.explode(ends).alias("p")).select((F.col("ord") * 2 + F.col("p.s")).alias("key"), "p.x", "p.y")


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits from events: the event's type gives the kind, its user the key, its value the numbers."""
    ev = bridge.events(spark, sf_dir)
    kind = F.when(F.col("event_type") == "click", "move_port").when(F.col("event_type") == "view", "link_rest").when(F.col("event_type") == "error", "toggle").when(F.col("event_type") == "signup", "add").otherwise("nudge")
    kind = F.when(F.col("event_id") == 100, "clear").otherwise(kind)
    return ev.select(F.col("event_id").alias("seq"), kind.alias("kind"), F.col("user_id").alias("key"), F.col("value").alias("v0"), (F.when(F.col("event_id") % 3 == 0, -1.0).otherwise(1.0)).alias("v1"))


def r5(*names: str):
    """To 5 digits as SQL's round: of the scaled double, not of the digits that are printed for it."""
    scaled = lambda n: F.col(n).cast("double") * 1e5
    return [F.when(F.abs(scaled(n)) < float("inf"), F.round(scaled(n)) / 1e5).otherwise(F.col(n).cast("double")).alias(n) for n in names]


def r6(*names: str):
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

SEG = """seg AS (SELECT event_id AS ord, concat('s', event_id) AS id, 10 + (event_id * 37) % 991 AS length_bp,
 CASE WHEN event_type = 'view' THEN NULL ELSE value END AS coverage FROM events)"""
LK = """sess AS (SELECT event_id, user_id, ts, event_type, SUM(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END)
 OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sess_no FROM events),
o AS (SELECT *, LAG(event_id, 1) OVER w AS p1, LAG(event_type, 1) OVER w AS t1, LAG(event_id, 3) OVER w AS p3, LAG(event_type, 3) OVER w AS t3
 FROM sess WINDOW w AS (PARTITION BY user_id, sess_no ORDER BY ts, event_id)),
l AS (SELECT event_id * 2 AS link_ord, p1 AS f, t1 AS ft, event_id AS t, event_type AS tt FROM o WHERE p1 IS NOT NULL
 UNION ALL SELECT event_id * 2 + 1, p3, t3, event_id, event_type FROM o WHERE p3 IS NOT NULL AND event_type = 'click'),
lk AS (SELECT row_number() OVER (ORDER BY link_ord) - 1 AS ord, link_ord, f, t, CASE WHEN ft = 'error' THEN '-' ELSE '+' END AS fo,
 CASE WHEN tt = 'error' THEN '-' ELSE '+' END AS too, concat(link_ord % 11, 'M') AS overlap FROM l),
e AS (SELECT ord, link_ord, f, t, CASE WHEN fo = '+' THEN 1 ELSE 0 END AS fs, CASE WHEN too = '+' THEN 0 ELSE 1 END AS tsd, overlap FROM lk)"""
COMP = """u AS (SELECT f AS a, t AS b FROM e UNION SELECT t, f FROM e),
r(id, lab) AS (SELECT ord, ord FROM seg UNION SELECT u.b, r.lab FROM r JOIN u ON u.a = r.id WHERE r.lab < u.b),
lab AS (SELECT id AS ord, MIN(lab) AS lab FROM r GROUP BY id),
comp AS (SELECT ord, concat('s', ord) AS id, dense_rank() OVER (ORDER BY lab) - 1 AS cid FROM lab)"""
CON = """con AS (SELECT ord, id, (ord % 100) * 20.0::DOUBLE AS in_x, (ord // 100) * 20.0::DOUBLE AS in_y,
 (ord % 100) * 20.0::DOUBLE + 1.0::DOUBLE + 0.6::DOUBLE * sqrt(length_bp::DOUBLE) AS out_x, (ord // 100) * 20.0::DOUBLE + (ord % 7) * 0.5::DOUBLE AS out_y FROM seg)"""
PT = "pt AS (SELECT ord * 2 AS k, in_x AS x, in_y AS y FROM con UNION ALL SELECT ord * 2 + 1, out_x, out_y FROM con)"
LOG = """lg AS (SELECT event_id AS seq, CASE WHEN event_id = 100 THEN 'clear' WHEN event_type = 'click' THEN 'move_port' WHEN event_type = 'view' THEN 'link_rest'
 WHEN event_type = 'error' THEN 'toggle' WHEN event_type = 'signup' THEN 'add' ELSE 'nudge' END AS kind, user_id AS k, value AS v0,
 CASE WHEN event_id % 3 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS v1 FROM events), lg2 AS (SELECT * FROM lg WHERE seq > 100)"""


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` starts behind WITH, with the names of shared subqueries in braces."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            text = sql
            for k, v in (("{SEG}", SEG), ("{LK}", LK), ("{COMP}", COMP), ("{CON}", CON), ("{PT}", PT), ("{LOG}", LOG)):
                text = text.replace(k, v)
            _SQL[name] = "WITH RECURSIVE " + text
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# sources and parsing


@query("gfa_lines", """{SEG}, {LK} SELECT concat('S', chr(9), id, chr(9), '*', chr(9), 'LN:i:', length_bp, CASE WHEN coverage IS NULL THEN '' ELSE concat(chr(9), 'dp:f:', coverage) END) AS value, ord AS line_no FROM seg
UNION ALL SELECT concat('L', chr(9), 's', f, chr(9), fo, chr(9), 's', t, chr(9), too, chr(9), overlap), 1000000000 + link_ord FROM lk""")
def gfa_lines(spark, d):
    return gfa.gfa_lines(lines(spark, d)).select("value", "line_no")


@query("gfa_segments", "{SEG} SELECT ord, id, length_bp, coverage FROM seg")
def gfa_segments(spark, d):
    return graph(spark, d).segments.select("ord", "id", "length_bp", "coverage")


@query("gfa_source", "{SEG} SELECT ord, id, length_bp, coverage FROM seg")
def source_segments(spark, d):
    """Segments by the data source: the graph's text as files, of which only S lines are decoded."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    lines(spark, d).repartitionByRange("line_no").sortWithinPartitions("line_no").select("value").write.text(path)
    return gfa_source.read_segments(spark, path, suffix=".txt").select("ord", "id", "length_bp", "coverage")


@query("gfa_tags", "{SEG} SELECT id, 'LN' AS tag, concat('i:', length_bp) AS v FROM seg UNION ALL SELECT id, 'dp', concat('f:', coverage) FROM seg WHERE coverage IS NOT NULL")
def gfa_tags(spark, d):
    return graph(spark, d).segments.select("id", F.explode("tags").alias("tag", "v"))


@query("gfa_links", """{LK} SELECT ord, concat('e', ord, ':s', f, ':', CASE WHEN fs = 1 THEN 'OUT' ELSE 'IN' END, '->s', t, ':', CASE WHEN tsd = 1 THEN 'OUT' ELSE 'IN' END) AS id,
 concat('s', f) AS start_id, CASE WHEN fs = 1 THEN 'OUT' ELSE 'IN' END AS start_port, concat('s', t) AS end_id, CASE WHEN tsd = 1 THEN 'OUT' ELSE 'IN' END AS end_port, overlap FROM e""")
def gfa_links(spark, d):
    return graph(spark, d).links.select("ord", "id", F.col("start.node_id").alias("start_id"), F.col("start.port").alias("start_port"), F.col("end.node_id").alias("end_id"), F.col("end.port").alias("end_port"), "overlap")


@query("record_counts", "{SEG}, {LK} SELECT 'S' AS record, count(*) AS n FROM seg UNION ALL SELECT 'L', count(*) FROM lk")
def record_counts(spark, d):
    return gfa.record_counts(lines(spark, d))


@query("violations", """{SEG}, {LK}, bad AS (SELECT ord, 'NodeExists' AS kind, id AS detail FROM seg WHERE ord % 50 = 0)
SELECT 2000000000 + ord AS line_no, kind, detail FROM bad
UNION ALL SELECT 3000000000 + ord, 'GFAParseError', concat('GFA parse error at line ', 3000000000 + ord, ': invalid S record') FROM seg WHERE ord % 40 = 0
UNION ALL SELECT 4000000000 + ord, 'GFAParseError', concat('GFA parse error at line ', 4000000000 + ord, ': invalid orientation in L record') FROM seg WHERE ord % 30 = 0
UNION ALL SELECT 5000000000 + ord, 'InvalidEdgeEndpoint', concat('x', ord) FROM seg WHERE ord % 20 = 0""")
def violations(spark, d):
    """The bridge text with faulty lines of each kind added."""
    seg = bridge.bridge_segments(bridge.events(spark, d))
    bad = lambda every, base, text: seg.filter(F.col("ord") % every == 0).select((F.lit(base).cast("long") + F.col("ord")).alias("line_no"), text.alias("value"))
    i, o = F.col("id"), F.col("ord").cast("string")
    more = bad(50, 2_000_000_000, F.concat(F.lit("S\t"), i, F.lit("\t*"))).union(bad(40, 3_000_000_000, F.concat(F.lit("S\t"), i, F.lit("\t"))))
    more = more.union(bad(30, 4_000_000_000, F.concat_ws("\t", F.lit("L"), i, F.lit("?"), i, F.lit("+"), F.lit("0M")))).union(bad(20, 5_000_000_000, F.concat(F.lit("L\t"), i, F.lit("\t+\tx"), o, F.lit("\t+\t0M"))))
    return gfa.violations(lines(spark, d).union(more))


@query("synthetic_ribbons", """i AS (SELECT unnest(range(2000)) AS ord), n AS (SELECT ord, sin(ord * 12.9898::DOUBLE) * 43758.5453::DOUBLE AS p, sin(ord * 78.233::DOUBLE) * 12345.678::DOUBLE AS q FROM i),
m AS (SELECT ord, (p - floor(p)) * 2 * pi() AS turn, 6 + (q - floor(q)) * 12 AS size FROM n)
SELECT ord, (ord % 45) * 20.0::DOUBLE AS in_x, (ord // 45) * 20.0::DOUBLE AS in_y, round(((ord % 45) * 20.0::DOUBLE + cos(turn) * size)::FLOAT::DOUBLE, 2) AS out_x, round(((ord // 45) * 20.0::DOUBLE + sin(turn) * size)::FLOAT::DOUBLE, 2) AS out_y, (1 + ord % 8)::DOUBLE AS width,
 (60 + (ord * 53) % 195)::INTEGER AS r, (60 + (ord * 97) % 195)::INTEGER AS g, (60 + (ord * 29) % 195)::INTEGER AS b, 255 AS a FROM m""")
def synthetic_ribbons(spark, d):
    return scene_file.synthetic_ribbons(spark, 2000).select("ord", *(F.col(c).cast("double").alias(c) for c in ("in_x", "in_y", "width")), *(F.round(F.col(c).cast("double"), 2).alias(c) for c in ("out_x", "out_y")), *(F.col(c).cast("int").alias(c) for c in "rgba"))


@query("format_size", """{SEG}, b AS (SELECT ord, length_bp * length_bp * 1500 AS size_bytes FROM seg) SELECT ord, size_bytes, CASE WHEN size_bytes >= 1073741824 THEN concat(printf('%.1f', size_bytes / 1073741824.0), ' GB')
 WHEN size_bytes >= 1048576 THEN concat(printf('%.0f', size_bytes / 1048576.0), ' MB') ELSE concat(printf('%.0f', size_bytes / 1024.0), ' KB') END AS size_text, size_bytes >= 524288000 AS is_large FROM b""")
def format_size(spark, d):
    size = (F.col("length_bp") * F.col("length_bp") * 1500).alias("size_bytes")
    rows = graph(spark, d).segments.select("ord", size)
    return rows.select("ord", "size_bytes", fn.format_size(F.col("size_bytes")).alias("size_text"), fn.is_large(F.col("size_bytes")).alias("is_large"))


# graph look-ups and aggregates


@query("graph_summary", "{SEG}, {LK}, {COMP} SELECT (SELECT count(*) FROM seg) AS contigs, (SELECT count(*) FROM lk) AS links, (SELECT count(DISTINCT cid) FROM comp) AS components")
def graph_summary(spark, d):
    return graph(spark, d).summary()


@query("components", "{SEG}, {LK}, {COMP} SELECT ord, id, cid FROM comp")
def components(spark, d):
    return graph(spark, d).components


@query("component_summaries", """{SEG}, {LK}, {COMP} SELECT c.cid, count(*) AS num_nodes, coalesce(max(k.n), 0) AS num_edges FROM comp c
 LEFT JOIN (SELECT cid, count(*) AS n FROM e JOIN comp ON comp.ord = e.f GROUP BY cid) k ON k.cid = c.cid GROUP BY c.cid""")
def component_summaries(spark, d):
    return graph(spark, d).component_summaries()


@query("nodes_in_component", "{SEG}, {LK}, {COMP} SELECT ord, id FROM comp WHERE cid = 3")
def nodes_in_component(spark, d):
    return graph(spark, d).nodes_in_component(3)


@query("port_degree", """{SEG}, {LK}, x AS (SELECT f AS n, fs AS s, ord FROM e UNION SELECT t, tsd, ord FROM e), p AS (SELECT ord, id, s FROM seg, (SELECT 0 AS s UNION ALL SELECT 1))
SELECT p.id AS node_id, CASE WHEN p.s = 1 THEN 'OUT' ELSE 'IN' END AS port, count(x.ord) AS degree FROM p LEFT JOIN x ON x.n = p.ord AND x.s = p.s GROUP BY p.id, p.s""")
def port_degree(spark, d):
    return graph(spark, d).port_edges().select("node_id", "port", F.size("edges").cast("long").alias("degree"))


@query("incident_edges", "{LK}, x AS (SELECT f AS n, ord FROM e UNION SELECT t, ord FROM e) SELECT concat('s', n) AS node_id, ord FROM x")
def incident_edges(spark, d):
    g = graph(spark, d)
    return g.endpoints.select("node_id", "ord").distinct()


@query("neighbors", "{LK}, x AS (SELECT f AS a, t AS b FROM e UNION SELECT t, f FROM e) SELECT concat('s', a) AS node_id, concat('s', b) AS neighbor FROM x WHERE a <> b")
def neighbors(spark, d):
    return graph(spark, d).neighbors()


@query("contig_search", "{SEG} SELECT min(ord) AS ord FROM seg WHERE id = 's7'")
def contig_search(spark, d):
    return spark.createDataFrame([(graph(spark, d).search(" s7 "),)], "ord long")


@query("canonical_pairs", "{LK}, p AS (SELECT least(f, t) AS a, greatest(f, t) AS b, min(ord) AS ord FROM e WHERE f <> t GROUP BY ALL) SELECT a, b, ord FROM p")
def canonical_pairs(spark, d):
    return po.canonical_pairs(graph(spark, d).edges_by_ord())


# edits of the graph


@query("remove_nodes", "{SEG}, {LK} SELECT 'node' AS kind, ord FROM seg WHERE ord % 10 <> 0 UNION ALL SELECT 'edge', ord FROM e WHERE f % 10 <> 0 AND t % 10 <> 0")
def remove_nodes(spark, d):
    g = graph(spark, d)
    left, _ = g.remove_nodes(g.segments.filter("ord % 10 = 0").select("id"))
    return left.segments.select(F.lit("node").alias("kind"), "ord").union(left.links.select(F.lit("edge"), "ord"))


@query("remove_patch", "{SEG}, {LK} SELECT 'node' AS kind, count(*) AS n FROM seg WHERE ord % 10 = 0 UNION ALL SELECT 'edge', count(*) FROM e WHERE f % 10 = 0 OR t % 10 = 0")
def remove_patch(spark, d):
    g = graph(spark, d)
    _, patch = g.remove_nodes(g.segments.filter("ord % 10 = 0").select("id"))
    return patch.changes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("reconnect_edges", "{LK} SELECT ord, concat('s', f) AS start_id, CASE WHEN ord % 7 = 0 THEN 's0' ELSE concat('s', t) END AS end_id, CASE WHEN ord % 7 = 0 OR tsd = 0 THEN 'IN' ELSE 'OUT' END AS end_port FROM e")
def reconnect_edges(spark, d):
    g = graph(spark, d)
    new = F.struct(F.lit("s0").alias("node_id"), F.lit("IN").alias("port"))
    edits = g.links.filter("ord % 7 = 0").select("id", F.lit(None).cast(END).alias("new_start"), new.alias("new_end"))
    return g.reconnect_edges(edits).links.select("ord", F.col("start.node_id").alias("start_id"), F.col("end.node_id").alias("end_id"), F.col("end.port").alias("end_port"))


@query("update_nodes", "{SEG} SELECT ord, CASE WHEN ord % 5 = 0 THEN length_bp * 2 ELSE length_bp END AS length_bp, coverage FROM seg")
def update_nodes(spark, d):
    g = graph(spark, d)
    edits = g.segments.filter("ord % 5 = 0").select("id", (F.col("length_bp") * 2).alias("length_bp"), F.lit(None).cast("double").alias("coverage"), F.lit(None).cast("map<string,string>").alias("tags"))
    return g.update_nodes(edits).segments.select("ord", "length_bp", "coverage")


# ports, junctions, paths


@query("port_nodes", "{SEG} SELECT ord * 2 + s AS ord, concat(id, ':', CASE WHEN s = 1 THEN 'OUT' ELSE 'IN' END) AS port_id, id AS contig, s::INTEGER AS side FROM seg, (SELECT 0 AS s UNION ALL SELECT 1)")
def port_nodes(spark, d):
    return po.port_nodes(graph(spark, d)).withColumn("side", F.col("side").cast("int"))


@query("port_edges", """{SEG}, {LK} SELECT ord, concat(id, ':IN') AS u, concat(id, ':OUT') AS v, 'INTERNAL' AS kind, round(1.0::DOUBLE + 0.6::DOUBLE * sqrt(length_bp::DOUBLE), 6) AS target FROM seg
UNION ALL SELECT (SELECT count(*) FROM seg) + ord, concat('s', f, ':', CASE WHEN fs = 1 THEN 'OUT' ELSE 'IN' END), concat('s', t, ':', CASE WHEN tsd = 1 THEN 'OUT' ELSE 'IN' END), 'EXTERNAL', 1.0 FROM e""")
def port_edges(spark, d):
    return po.port_edges(graph(spark, d)).select("ord", "u", "v", "kind", *r6("target"))


@query("visual_length", "{SEG} SELECT ord, round(1.0::DOUBLE + 0.6::DOUBLE * sqrt(length_bp::DOUBLE), 6) AS len FROM seg")
def visual_length(spark, d):
    return graph(spark, d).segments.select("ord", F.round(fn.visual_length(F.col("length_bp")), 6).alias("len"))


@query("ribbon_width", "{SEG} SELECT ord, round(CASE WHEN coverage IS NULL OR coverage <= 0 THEN 2.0::DOUBLE ELSE greatest(1.0::DOUBLE, least(12.0::DOUBLE, 1.0::DOUBLE + 1.5::DOUBLE * sqrt(coverage))) END, 6) AS width FROM seg")
def ribbon_width(spark, d):
    return graph(spark, d).segments.select("ord", F.round(fn.ribbon_width(F.col("coverage")), 6).alias("width"))


@query("palette_color", "{SEG}, {LK}, {COMP}, pal AS (SELECT " + ", ".join(f"{[c[k] for c in fn.PALETTE]} AS {n}" for k, n in enumerate("rgb")) + ") SELECT ord, pal.r[cid % 20 + 1] AS r, pal.g[cid % 20 + 1] AS g, pal.b[cid % 20 + 1] AS b, 255 AS a FROM comp, pal")
def palette_color(spark, d):
    return graph(spark, d).components.select("ord", *(c.cast("int").alias(n) for n, c in fn.palette(F.col("cid")).items()))


JN = """pe AS (SELECT f * 2 + fs AS a, t * 2 + tsd AS b FROM e), ps AS (SELECT a AS p FROM pe UNION SELECT b FROM pe), u AS (SELECT a, b FROM pe UNION SELECT b, a FROM pe),
r(id, lab) AS (SELECT p, p FROM ps UNION SELECT u.b, r.lab FROM r JOIN u ON u.a = r.id WHERE r.lab < u.b), lab AS (SELECT id AS port, min(lab) AS lab FROM r GROUP BY id),
jn AS (SELECT port, dense_rank() OVER (ORDER BY lab) - 1 AS junction FROM lab)"""


@query("junctions", "{LK}, " + JN + " SELECT port, junction FROM jn")
def junctions(spark, d):
    return po.junctions(po.link_keys(graph(spark, d)))


@query("junction_direction", "{SEG}, {LK}, {CON}, {PT}, " + JN + """, d AS (SELECT junction, q.x - p.x AS dx, q.y - p.y AS dy FROM jn JOIN pt p ON p.k = port JOIN pt q ON q.k = xor(port, 1))
SELECT junction, count(*) AS n, round(avg(dx / sqrt(dx * dx + dy * dy)), 6) AS mx, round(avg(dy / sqrt(dx * dx + dy * dy)), 6) AS my FROM d GROUP BY junction HAVING count(*) > 1""")
def junction_direction(spark, d):
    rows = po.junction_directions(po.junctions(po.link_keys(graph(spark, d))), port_points(contigs(spark, d)))
    return rows.filter("n > 1").select("junction", "n", *r6("mx", "my"))


@query("contig_adjacency", "{LK} SELECT f AS contig, t AS neighbor, ord AS link FROM e WHERE f <> t UNION ALL SELECT t, f, ord FROM e WHERE f <> t")
def contig_adjacency(spark, d):
    return po.contig_adjacency(po.link_keys(graph(spark, d)))


@query("adjacency_offsets", "{SEG}, {LK}, a AS (SELECT f AS c FROM e WHERE f <> t UNION ALL SELECT t FROM e WHERE f <> t), n AS (SELECT seg.ord AS contig, count(a.c) AS degree FROM seg LEFT JOIN a ON a.c = seg.ord GROUP BY seg.ord) SELECT contig, degree, (sum(degree) OVER (ORDER BY contig) - degree)::BIGINT AS start FROM n")
def adjacency_offsets(spark, d):
    g = graph(spark, d)
    return po.offsets(po.contig_adjacency(po.link_keys(g)), g.segments)


@query("link_incidence", "{LK} SELECT f AS contig, ord AS link FROM e UNION SELECT t, ord FROM e")
def link_incidence(spark, d):
    return po.link_incidence(po.link_keys(graph(spark, d)))


@query("local_sim", "{LK} SELECT ord AS link FROM e WHERE f < 50 OR t < 50")
def local_sim(spark, d):
    g = graph(spark, d)
    return po.local_sim(po.link_keys(g), g.segments.filter("ord < 50").select(F.col("ord").alias("contig")))


HOPS = "u AS (SELECT f AS a, t AS b FROM e UNION SELECT t, f FROM e), w(n, h) AS (SELECT ord, 0 FROM seg WHERE ord IN (0, 11, 25) UNION SELECT u.b, w.h + 1 FROM w JOIN u ON u.a = w.n WHERE w.h < {}), b AS (SELECT n AS ord, min(h) AS hops FROM w GROUP BY n)"


@query("k_hop", "{SEG}, {LK}, " + HOPS.format(3) + " SELECT ord, concat('s', ord) AS id, hops FROM b")
def k_hop(spark, d):
    return graph(spark, d).k_hop(["s0", "s11", "s25"], 3)


@query("bfs_hops", "{SEG}, {LK}, " + HOPS.format(60) + " SELECT ord, hops, (SELECT min(u.a) FROM u JOIN b p ON p.ord = u.a WHERE u.b = b.ord AND p.hops = b.hops - 1) AS parent FROM b")
def bfs_hops(spark, d):
    g = graph(spark, d)
    return cc.hops(g.edges_by_ord(), g.segments.filter(F.col("ord").isin(0, 11, 25)).select("ord"), node="ord")


@query("shortest_path", """{SEG}, {LK}, pe AS (SELECT f * 2 + fs AS a, t * 2 + tsd AS b, 1.0::DOUBLE AS w FROM e UNION ALL SELECT ord * 2, ord * 2 + 1, 1.0::DOUBLE + 0.6::DOUBLE * sqrt(length_bp::DOUBLE) FROM seg),
u AS (SELECT a, b, w FROM pe UNION SELECT b, a, w FROM pe), s(n, d, path) AS (SELECT 0, 0.0::DOUBLE, [0] UNION ALL SELECT u.b, s.d + u.w, list_append(path, u.b) FROM s JOIN u ON u.a = s.n WHERE NOT list_contains(path, u.b))
SELECT n::BIGINT AS port, round(min(d), 6) AS dist FROM s GROUP BY n""")
def shortest_path(spark, d):
    g = graph(spark, d)
    links = po.link_keys(g).select("a", "b", F.lit(po.EXTERNAL_LENGTH).alias("w"))
    inner = g.segments.select((F.col("ord") * 2).alias("a"), (F.col("ord") * 2 + 1).alias("b"), fn.visual_length(F.col("length_bp")).alias("w"))
    source = spark.createDataFrame([(0, 0)], "key int, node long")
    return se.distances(links.union(inner), source).select(F.col("node").alias("port"), *r6("dist"))


#: Every component's breadth-first search from one node: {0} is the table (key, n) of these nodes.
SWEEP = """SELECT key, n, 0 AS h FROM {0} UNION SELECT s.key, u.b, s.h + 1 FROM {1} s JOIN u ON u.a = s.n WHERE s.h < 60"""
TIPS = f"""u AS (SELECT f AS a, t AS b FROM e WHERE f <> t UNION SELECT t, f FROM e WHERE f <> t), r(id, lab) AS (SELECT ord, ord FROM seg UNION SELECT u.b, r.lab FROM r JOIN u ON u.a = r.id WHERE r.lab < u.b),
k AS (SELECT DISTINCT min(lab) AS key, min(lab) AS n FROM r GROUP BY id), s1(key, n, h) AS ({SWEEP.format("k", "s1")}), b1 AS (SELECT key, n, min(h) AS h FROM s1 GROUP BY ALL),
t1 AS (SELECT key, arg_min(n, -h * 1000000000::BIGINT + n) AS n FROM b1 GROUP BY key), s2(key, n, h) AS ({SWEEP.format("t1", "s2")}), b2 AS (SELECT key, n, min(h) AS h FROM s2 GROUP BY ALL),
t2 AS (SELECT key, arg_min(n, -h * 1000000000::BIGINT + n) AS n, max(h) AS h FROM b2 GROUP BY key)"""
PATH = TIPS + """, up AS (SELECT b2.n, b2.h, min(u.a) AS p FROM b2 JOIN u ON u.b = b2.n JOIN b2 q ON q.n = u.a AND q.h = b2.h - 1 GROUP BY ALL),
pa(key, place, n) AS (SELECT key, h, n FROM t2 UNION ALL SELECT pa.key, pa.place - 1, up.p FROM pa JOIN up ON up.n = pa.n)"""


@query("component_diameter", "{SEG}, {LK}, " + TIPS + " SELECT t1.key AS component, t1.n AS tip, t2.n AS far_end, t2.h AS hops FROM t1 JOIN t2 USING (key)")
def component_diameter(spark, d):
    g = graph(spark, d)
    return se.diameters(g.segments.select("ord"), g.edges_by_ord()).select(F.col("key").alias("component"), "tip", F.col("end").alias("far_end"), "hops")


@query("backbone_path", "{SEG}, {LK}, " + PATH + " SELECT key AS component, place, n AS ord FROM pa")
def backbone_path(spark, d):
    g = graph(spark, d)
    return se.backbones(g.segments.select("ord"), g.edges_by_ord()).select(F.col("key").alias("component"), "place", F.col("node").alias("ord"))


@query("nearest_backbone", "{SEG}, {LK}, " + PATH + """, s3(key, n, h) AS (SELECT n, n, 0 FROM pa UNION SELECT s3.key, u.b, s3.h + 1 FROM s3 JOIN u ON u.a = s3.n WHERE s3.h < 12),
m AS (SELECT n, min(h) AS h FROM s3 GROUP BY n) SELECT m.n AS ord, m.h AS hops, min(s3.key) AS root FROM m JOIN s3 ON s3.n = m.n AND s3.h = m.h GROUP BY ALL""")
def nearest_backbone(spark, d):
    g = graph(spark, d)
    return se.nearest_backbone(g.segments.select("ord"), g.edges_by_ord()).select(F.col("node").alias("ord"), "hops", "root")


@query("landmark_distances", "{SEG}, {LK}, " + TIPS + """, pe AS (SELECT f * 2 + fs AS a, t * 2 + tsd AS b, 1.0::DOUBLE AS w FROM e UNION ALL SELECT ord * 2, ord * 2 + 1, 1.0::DOUBLE + 0.6::DOUBLE * sqrt(length_bp::DOUBLE) FROM seg),
x AS (SELECT a, b, min(w) AS w FROM (SELECT a, b, w FROM pe UNION ALL SELECT b, a, w FROM pe) q WHERE a <> b GROUP BY ALL), lm AS (SELECT n * 2 AS k FROM t1 UNION SELECT n * 2 FROM t2),
s(i, k, n, d) AS (SELECT 0, k, k, 0.0::DOUBLE FROM lm UNION ALL SELECT i, k, n, min(d) FROM (SELECT s.i + 1 AS i, s.k, x.b AS n, s.d + x.w AS d FROM s JOIN x ON x.a = s.n WHERE s.i < 90 UNION ALL SELECT i + 1, k, n, d FROM s WHERE i < 90) GROUP BY ALL)
SELECT k AS landmark, n AS port, round(d, 6) AS dist FROM s WHERE i = 90""")
def landmark_distances(spark, d):
    """From the IN ports of both ends of each component's diameter, in one search keyed by the landmark."""
    g = graph(spark, d)
    links = po.link_keys(g).select("a", "b", F.lit(po.EXTERNAL_LENGTH).alias("w"))
    inner = g.segments.select((F.col("ord") * 2).alias("a"), (F.col("ord") * 2 + 1).alias("b"), fn.visual_length(F.col("length_bp")).alias("w"))
    wide = se.diameters(g.segments.select("ord"), g.edges_by_ord())
    marks = wide.select(F.explode(F.array("tip", "end")).alias("n")).select((F.col("n") * 2).alias("key"), (F.col("n") * 2).alias("node"))
    return se.distances(links.union(inner), marks).select(F.col("key").alias("landmark"), F.col("node").alias("port"), *r6("dist"))


# scenes and ribbons


@query("tightest_boxes", """{SEG}, {LK}, {COMP}, {CON}, {PT}, p AS (SELECT DISTINCT comp.cid, x, y FROM pt JOIN comp ON comp.ord = pt.k // 2),
h AS (SELECT a.cid, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy FROM p a JOIN p b ON b.cid = a.cid AND (b.x <> a.x OR b.y <> a.y)),
b AS (SELECT h.cid, min(h.dx * (p.y - h.ay) - h.dy * (p.x - h.ax)) AS side, (max(p.x * h.dx + p.y * h.dy) - min(p.x * h.dx + p.y * h.dy)) * (max(p.y * h.dx - p.x * h.dy) - min(p.y * h.dx - p.x * h.dy)) / (h.dx * h.dx + h.dy * h.dy) AS area
 FROM h JOIN p ON p.cid = h.cid GROUP BY h.cid, h.ax, h.ay, h.dx, h.dy)
SELECT cid, round(min(area), 4) AS area FROM b WHERE side > -0.0000001::DOUBLE GROUP BY cid""")
def tightest_boxes(spark, d):
    """The smallest bounding box of each component's ribbons."""
    g = graph(spark, d)
    points = port_points(contigs(spark, d)).withColumn("ord", F.shiftright("key", 1)).join(g.components.select("ord", "cid"), "ord")
    return lay.tightest_boxes(points.select("cid", "x", "y")).select("cid", F.round("area", 4).alias("area"))


SCENE_CONTIGS = """{SEG}, {LK}, {COMP} SELECT seg.ord, seg.id, comp.cid % 20 AS color, round(((seg.ord % 100) * 20.0::DOUBLE)::FLOAT::DOUBLE, 3) AS in_x, round(((seg.ord // 100) * 20.0::DOUBLE)::FLOAT::DOUBLE, 3) AS in_y,
 round(((seg.ord % 100) * 20.0::DOUBLE + 1.0::DOUBLE + 0.6::DOUBLE * sqrt(length_bp::DOUBLE))::FLOAT::DOUBLE, 3) AS out_x,
 round(((seg.ord // 100) * 20.0::DOUBLE)::FLOAT::DOUBLE, 3) AS out_y,
 round((CASE WHEN coverage IS NULL OR coverage <= 0 THEN 2.0::DOUBLE ELSE greatest(1.0::DOUBLE, least(12.0::DOUBLE, 1.0::DOUBLE + 1.5::DOUBLE * sqrt(coverage))) END)::FLOAT::DOUBLE, 3) AS width FROM seg JOIN comp USING (ord)"""


def contig_rows(rows: DataFrame) -> DataFrame:
    at = F.array_position(F.array(*(F.lit(c[0] * 1000 + c[1]) for c in fn.PALETTE)), F.col("r").cast("int") * 1000 + F.col("g").cast("int")) - 1
    return rows.select("ord", "id", at.cast("long").alias("color"), *(F.round(F.col(c).cast("double"), 3).alias(c) for c in ("in_x", "in_y", "out_x", "out_y", "width")))


@query("scene_contigs", SCENE_CONTIGS)
def scene_contigs(spark, d):
    g = graph(spark, d)
    return contig_rows(sc.scene_contigs(g, sc.grid_positions(g)))


@query("scene_roundtrip", SCENE_CONTIGS)
def scene_roundtrip(spark, d):
    """The same columns after the whole scene went through a file's bytes."""
    g = graph(spark, d)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.gsc"
    scene_file.write_gsc1(sc.build_scene(g, sc.grid_positions(g), "bridge"), path)
    return contig_rows(scene_file.read_contigs(spark, path))


@query("scene_links", """{SEG}, {LK}, g AS (SELECT ord * 2 AS k, (ord % 100) * 20.0::DOUBLE AS x, (ord // 100) * 20.0::DOUBLE AS y FROM seg UNION ALL SELECT ord * 2 + 1, (ord % 100) * 20.0::DOUBLE + 1.0::DOUBLE + 0.6::DOUBLE * sqrt(length_bp::DOUBLE), (ord // 100) * 20.0::DOUBLE FROM seg)
SELECT e.ord, round(p.x::FLOAT::DOUBLE, 3) AS x0, round(p.y::FLOAT::DOUBLE, 3) AS y0, round(q.x::FLOAT::DOUBLE, 3) AS x1, round(q.y::FLOAT::DOUBLE, 3) AS y1, f AS contig_a, fs::BIGINT AS side_a, t AS contig_b, tsd::BIGINT AS side_b FROM e JOIN g p ON p.k = f * 2 + fs JOIN g q ON q.k = t * 2 + tsd""")
def scene_links(spark, d):
    g = graph(spark, d)
    rows = sc.scene_links(g, sc.grid_positions(g))
    return rows.select("ord", *(F.round(F.col(c).cast("double"), 3).alias(c) for c in ("x0", "y0", "x1", "y1")), "contig_a", F.col("side_a").cast("long").alias("side_a"), "contig_b", F.col("side_b").cast("long").alias("side_b"))


@query("scene_bbox", "{SEG}, {CON}, p AS (SELECT CASE WHEN ord = 0 THEN -50.0::DOUBLE ELSE in_x END AS x, CASE WHEN ord = 0 THEN -7.0::DOUBLE ELSE in_y END AS y FROM con UNION ALL SELECT out_x, in_y FROM con UNION ALL SELECT 5000.0::DOUBLE, 0.0::DOUBLE) SELECT round(min(x), 6) AS min_x, round(min(y), 6) AS min_y, round(max(x), 6) AS max_x, round(max(y), 6) AS max_y FROM p")
def scene_bbox(spark, d):
    """An override replaces a port's position, and one of an unknown port still widens the box."""
    g = graph(spark, d)
    over = spark.createDataFrame([("ghost:IN", 5000.0, 0.0), ("s0:IN", -50.0, -7.0)], "port_id string, x double, y double")
    return sc.bounding_box(sc.merged_positions(sc.grid_positions(g), over)).select(*r6("min_x", "min_y", "max_x", "max_y"))


@query("ribbon_bbox", "{SEG}, {CON} SELECT min(least(in_x, out_x)) AS min_x, min(least(in_y, out_y)) AS min_y, round(max(greatest(in_x, out_x)), 6) AS max_x, max(greatest(in_y, out_y)) AS max_y FROM con")
def ribbon_bbox(spark, d):
    return sc.ribbon_bbox(contigs(spark, d)).select(*r6("min_x", "min_y", "max_x", "max_y"))


@query("view_fit", "{SEG}, {CON}, b AS (SELECT min(least(in_x, out_x)) AS x0, min(least(in_y, out_y)) AS y0, max(greatest(in_x, out_x)) AS x1, max(greatest(in_y, out_y)) AS y1 FROM con) SELECT round((x0 + x1) / 2, 6) AS x, round((y0 + y1) / 2, 6) AS y, round(log2(least(800.0::DOUBLE / (x1 - x0), 600.0::DOUBLE / (y1 - y0))), 6) AS zoom FROM b")
def view_fit(spark, d):
    return rb.view_fit(sc.ribbon_bbox(contigs(spark, d)), 800.0, 600.0).select(*r6("x", "y", "zoom"))


CH = "ch AS (SELECT ord, (in_x + out_x) * 0.5::DOUBLE AS mid_x, (in_y + out_y) * 0.5::DOUBLE AS mid_y, sqrt((out_x - in_x) * (out_x - in_x) + (out_y - in_y) * (out_y - in_y)) AS len, out_x - in_x AS dx, out_y - in_y AS dy FROM con)"


@query("chords", "{SEG}, {CON}, " + CH + " SELECT ord, round(mid_x, 6) AS mid_x, round(mid_y, 6) AS mid_y, round(-dy / len, 6) + 0.0 AS perp_x, round(dx / len, 6) AS perp_y, round(len, 6) AS len FROM ch")
def chords(spark, d):
    rows = rb.chords(contigs(spark, d))
    return rows.select("ord", *r6("mid_x", "mid_y"), (F.round("perp_x", 6) + 0.0).alias("perp_x"), *r6("perp_y", "len"))


@query("mean_chord", "{SEG}, {CON}, " + CH + " SELECT round(avg(len), 6) AS mean_chord FROM ch")
def mean_chord(spark, d):
    return rb.mean_chord(contigs(spark, d)).select(*r6("mean_chord"))


@query("grid_pairs", "{SEG}, {CON}, " + CH + ", c AS (SELECT *, floor(mid_x / 21.5::DOUBLE) AS cx, floor(mid_y / 21.5::DOUBLE) AS cy FROM ch) SELECT a.ord AS i, b.ord AS j, round(sqrt((a.mid_x - b.mid_x) ** 2 + (a.mid_y - b.mid_y) ** 2), 5) AS d FROM c a JOIN (SELECT *, unnest([-1, 0, 1]) AS dx1 FROM c) b0 ON false JOIN c b ON true WHERE false UNION ALL SELECT a.ord, b.ord, round(sqrt((a.mid_x - b.mid_x) ** 2 + (a.mid_y - b.mid_y) ** 2), 5) FROM (SELECT *, unnest([-1, 0, 1]) AS ox FROM c) a0 JOIN c a ON a.ord = a0.ord JOIN c b ON b.cx = a0.cx + a0.ox AND abs(b.cy - a.cy) <= 1 WHERE a.ord < b.ord AND (a.mid_x - b.mid_x) ** 2 + (a.mid_y - b.mid_y) ** 2 < 21.5::DOUBLE * 21.5::DOUBLE")
def grid_pairs(spark, d):
    pts = rb.chords(contigs(spark, d)).select("ord", F.col("mid_x").alias("x"), F.col("mid_y").alias("y"))
    return rb.grid_pairs(pts, 21.5).select("i", "j", F.round("d", 5).alias("d"))


@query("effective_ports", "{SEG}, {CON}, {PT} SELECT k AS key, round(x + CASE WHEN k % 9 = 0 THEN 1.5::DOUBLE ELSE 0 END, 6) AS x, round(y - CASE WHEN k % 9 = 0 THEN 2.5::DOUBLE ELSE 0 END, 6) AS y FROM pt")
def effective_ports(spark, d):
    pt = port_points(contigs(spark, d))
    moves = pt.filter("key % 9 = 0").select("key", F.lit(1.5).alias("dx"), F.lit(-2.5).alias("dy"))
    return rb.effective_ports(pt, moves).select("key", *r6("x", "y"))


@query("bezier_paths", "{SEG}, {CON}, " + CH + """, t AS (SELECT unnest(range(5)) AS s), p AS (SELECT con.ord, s, s / 4.0::DOUBLE AS t, in_x, in_y, out_x, out_y,
 mid_x + 2 * (0.25::DOUBLE + 0.15::DOUBLE * len) * (-dy / len) AS cx, mid_y + 2 * (0.25::DOUBLE + 0.15::DOUBLE * len) * (dx / len) AS cy FROM con JOIN ch USING (ord), t)
SELECT ord, s::INTEGER AS s, round((1 - t) * (1 - t) * in_x + 2 * (1 - t) * t * cx + t * t * out_x, 5) AS x, round((1 - t) * (1 - t) * in_y + 2 * (1 - t) * t * cy + t * t * out_y, 5) AS y FROM p""")
def bezier_paths(spark, d):
    c = contigs(spark, d)
    rows = rb.bezier_paths(c, c.select("ord", F.lit(0.25).alias("offset")), c.select("ord", F.lit(0.15).alias("curve")), 5)
    return rows.select("ord", "s", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("grab_zone", "{SEG}, {CON}, q AS (SELECT *, in_x + (out_x - in_x) * (ord % 13) / 12.0::DOUBLE AS px, in_y + 0.75::DOUBLE AS py, (out_x - in_x) ** 2 + (out_y - in_y) ** 2 AS l2 FROM con), z AS (SELECT *, (px - in_x) ** 2 + (py - in_y) ** 2 AS di, (px - out_x) ** 2 + (py - out_y) ** 2 AS dq, ((px - in_x) * (out_x - in_x) + (py - in_y) * (out_y - in_y)) / l2 AS t FROM q) SELECT ord, CASE WHEN least(di, dq) < 0.22::DOUBLE * 0.22::DOUBLE * l2 THEN CASE WHEN di <= dq THEN 0 ELSE 2 END WHEN t < 1 / 6.0::DOUBLE THEN 0 WHEN t > 1 - 1 / 6.0::DOUBLE THEN 2 ELSE 1 END AS zone, CASE WHEN dq < di THEN 1 ELSE 0 END AS side FROM z")
def grab_zone(spark, d):
    c = contigs(spark, d)
    px = F.col("in_x") + (F.col("out_x") - F.col("in_x")) * (F.col("ord") % 13) / 12.0
    return c.withColumn("px", px).withColumn("py", F.col("in_y") + 0.75).select("ord", rb.grab_zone().alias("zone"), rb.nearest_side().alias("side"))


@query("pick_box", "{SEG}, {CON}, {PT} SELECT DISTINCT k // 2 AS ord FROM pt WHERE x BETWEEN 190 AND 905 AND y BETWEEN 95 AND 1411")
def pick_box(spark, d):
    """Contigs with a port in a rectangle, by an index on Morton codes."""
    points = port_points(contigs(spark, d)).select(F.shiftright("key", 1).alias("ord"), "x", "y")
    return rb.PathIndex(points).pick_box(190, 1411, 905, 95)


@query("pinned_rests", "{SEG}, {LK}, {CON}, {PT} SELECT ord AS link, round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2), 5) AS rest FROM e JOIN pt p ON p.k = f * 2 + fs JOIN pt q ON q.k = t * 2 + tsd WHERE (SELECT min(f * 2 + fs) FROM e) IN (f * 2 + fs, t * 2 + tsd)")
def pinned_rests(spark, d):
    links = po.link_keys(graph(spark, d))
    first = links.agg(F.min("a")).first()[0]  # the first port at which a link starts
    return rx.pinned_rests(port_points(contigs(spark, d)), links, first).select("link", F.round("rest", 5).alias("rest"))


@query("drag_edits", """{SEG}, {LK}, {CON}, {PT}, {LOG}, q AS (SELECT *, in_x + (out_x - in_x) * (ord % 13) / 12.0::DOUBLE AS px, in_y + 0.75::DOUBLE AS py, (ord % 5 - 2)::DOUBLE AS dx, (ord % 3 - 1)::DOUBLE AS dy FROM con),
g AS (SELECT ord AS gesture, dx, dy, ord * 2 + CASE WHEN (px - out_x) ** 2 + (py - out_y) ** 2 < (px - in_x) ** 2 + (py - in_y) ** 2 THEN 1 ELSE 0 END AS key FROM q),
ov AS (SELECT k, arg_max(v0, seq) AS x0, arg_max(v1, seq) AS y0 FROM lg2 WHERE kind = 'move_port' GROUP BY k), n AS (SELECT ord AS link, f * 2 + fs AS a, t * 2 + tsd AS b FROM e),
w AS (SELECT link, a AS key, b AS other FROM n UNION SELECT link, b, a FROM n)
SELECT gesture, 'move_port' AS kind, key, round(coalesce(x0, 0) + dx, 5) AS v0, round(coalesce(y0, 0) + dy, 5) AS v1 FROM g LEFT JOIN ov ON ov.k = g.key
UNION ALL SELECT gesture, 'link_rest', link, round(CASE WHEN other = w.key THEN 0.0::DOUBLE ELSE sqrt((p.x + dx - r.x) ** 2 + (p.y + dy - r.y) ** 2) END, 5), NULL FROM g JOIN w ON w.key = g.key JOIN pt p ON p.k = w.key JOIN pt r ON r.k = w.other""")
def drag_edits(spark, d):
    """Each contig's nearest port dragged with Ctrl: moves on top of the log's, and lengths kept for the port's links."""
    c, g = contigs(spark, d), graph(spark, d)
    at = (F.col("in_x") + (F.col("out_x") - F.col("in_x")) * (F.col("ord") % 13) / 12.0).alias("px"), (F.col("in_y") + 0.75).alias("py")
    drag = c.select(F.col("ord").alias("gesture"), F.col("ord").alias("contig"), *at, (F.col("ord") % 5 - 2).cast("double").alias("dx"), (F.col("ord") % 3 - 1).cast("double").alias("dy"), F.lit(True).alias("ctrl"))
    made, _ = rx.drags(c, po.link_keys(g), drag, edit_log(spark, d), rx.ForceParams(enabled=False))
    return made.select("gesture", "kind", "key", *r5("v0", "v1"))


@query("drag_cloud")
def drag_cloud(spark, d):
    """A plain drag of every contig that the edit log moves a port of: two layers relax around it."""
    c, g = contigs(spark, d), graph(spark, d)
    moves = ed.port_moves(edit_log(spark, d)).groupBy(F.shiftright("key", 1).alias("ord")).agg(F.max("dx").alias("dx"), F.max("dy").alias("dy"))
    drag = c.join(moves, "ord").select(F.col("ord").alias("gesture"), F.col("ord").alias("contig"), ((F.col("in_x") + F.col("out_x")) / 2).alias("px"), ((F.col("in_y") + F.col("out_y")) / 2).alias("py"), "dx", "dy", F.lit(False).alias("ctrl"))
    return rx.drags(c, po.link_keys(g), drag, edit_log(spark, d), rx.ForceParams(layers=2))[1].select("gesture", "key", *r6("x", "y"))


# the edit log


@query("edit_moves", "{LOG} SELECT k AS key, arg_max(v0, seq) AS dx, arg_max(v1, seq) AS dy FROM lg2 WHERE kind = 'move_port' GROUP BY k")
def edit_moves(spark, d):
    return ed.port_moves(edit_log(spark, d))


@query("edit_rests", "{LOG} SELECT k AS link, arg_max(v0, seq) AS rest FROM lg2 WHERE kind = 'link_rest' GROUP BY k")
def edit_rests(spark, d):
    return ed.link_rests(edit_log(spark, d))


@query("edit_curves", "{LOG}, n AS (SELECT k, list(v1 ORDER BY seq) AS s FROM lg2 WHERE kind = 'nudge' GROUP BY k) SELECT k AS ord, round(list_reduce(list_prepend(0.0::DOUBLE, s), lambda a, x: greatest(-3.0::DOUBLE, least(3.0::DOUBLE, a + 0.15::DOUBLE * x))), 6) AS curve FROM n")
def edit_curves(spark, d):
    return ed.curves(edit_log(spark, d).withColumn("v0", F.col("v1"))).select("ord", *r6("curve"))


@query("selection_toggle", "{LOG}, a AS (SELECT k, max(CASE WHEN kind = 'add' THEN seq END) AS sure FROM lg GROUP BY k), s AS (SELECT lg.k, CASE WHEN max(sure) IS NULL THEN 0 ELSE 1 END + count(CASE WHEN kind = 'toggle' AND seq > coalesce(sure, -1) THEN 1 END) AS n FROM lg JOIN a USING (k) GROUP BY lg.k) SELECT k AS ord FROM s WHERE n % 2 = 1")
def selection_toggle(spark, d):
    return ed.selection(edit_log(spark, d))


@query("edit_count", "{LOG}, n AS (SELECT k, list_reduce(list_prepend(0.0::DOUBLE, list(v1 ORDER BY seq)), lambda a, x: greatest(-3.0::DOUBLE, least(3.0::DOUBLE, a + 0.15::DOUBLE * x))) AS c FROM lg2 WHERE kind = 'nudge' GROUP BY k) SELECT (SELECT count(DISTINCT k) FROM lg2 WHERE kind = 'move_port') + (SELECT count(DISTINCT k) FROM lg2 WHERE kind = 'link_rest') + (SELECT count(*) FROM n WHERE c <> 0) AS edits")
def edit_count(spark, d):
    return ed.edit_count(edit_log(spark, d).withColumn("v0", F.when(F.col("kind") == "nudge", F.col("v1")).otherwise(F.col("v0"))))


# kernels beyond SQL


@query("layout_positions")
def layout_positions(spark, d):
    return lay.layout(graph(spark, d))


@query("packed_boxes")
def packed_boxes(spark, d):
    return lay.packed_boxes(lay.boxes(lay.local_layout(graph(spark, d))))


@query("bulge_offsets")
def bulge_offsets(spark, d):
    return rb.bulge_offsets(contigs(spark, d).withColumn("out_x", F.col("in_x") + (F.col("out_x") - F.col("in_x")) * 2).withColumn("in_y", F.col("in_y") * 0.3).withColumn("out_y", F.col("out_y") * 0.3))


@query("relax_local")
def relax_local(spark, d):
    """One gesture for each port that the edit log moves: it is held where its last move puts it."""
    c = contigs(spark, d)
    pt, links = cut(port_points(c)), po.link_keys(graph(spark, d))
    moves = ed.port_moves(edit_log(spark, d)).join(pt, "key")
    gestures = moves.select(F.col("key").alias("gesture"), F.shiftright("key", 1).alias("contig"))
    near = po.contig_adjacency(links).select("contig", "neighbor")
    regions = gestures.union(gestures.join(near, "contig").select("gesture", F.col("neighbor").alias("contig"))).distinct()
    pins = moves.select(F.col("key").alias("gesture"), "key", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
    return rx.relax_local(pt, links, po.junctions(links), regions, pins, rb.mean_chord(c).first()[0])


@query("relax_rods", "{SEG}, {LK}, {CON}, {LOG}, g AS (SELECT DISTINCT k FROM lg2 WHERE kind = 'move_port' AND k < 2 * (SELECT count(*) FROM seg)), r AS (SELECT k, k // 2 AS c FROM g UNION SELECT k, t FROM g JOIN e ON f = k // 2 UNION SELECT k, f FROM g JOIN e ON t = k // 2) SELECT k AS gesture, c AS contig, round(sqrt((out_x - in_x) ** 2 + (out_y - in_y) ** 2), 4) AS len FROM r JOIN con ON con.ord = c")
def relax_rods(spark, d):
    """Contigs keep their lengths through a relaxation, whatever pulls at them."""
    rows = relax_local(spark, d).withColumn("contig", F.shiftright("key", 1))
    at = lambda s, c: F.max(F.when(F.col("key") % 2 == s, F.col(c)))
    rows = rows.groupBy("gesture", "contig").agg(F.hypot(at(0, "x") - at(1, "x"), at(0, "y") - at(1, "y")).alias("len"))
    return rows.select("gesture", "contig", F.round("len", 4).alias("len"))


@query("lone_contigs", "{SEG}, {LK} SELECT id AS contig, round(1.0::DOUBLE + 0.6::DOUBLE * sqrt(length_bp::DOUBLE), 4) AS len FROM seg WHERE ord NOT IN (SELECT f FROM e UNION SELECT t FROM e)")
def lone_contigs(spark, d):
    """In the layout, a contig without links has exactly its visual length."""
    g = graph(spark, d)
    at = lay.layout(g).select(fn.port_owner(F.col("port_id")).alias("contig"), F.col("port_id").endswith(":IN").alias("first"), "x", "y")
    at = at.join(g.endpoints.select(F.col("node_id").alias("contig")), "contig", "left_anti")
    end = lambda s, c: F.max(F.when(F.col("first") == s, F.col(c)))
    rows = at.groupBy("contig").agg(F.hypot(end(True, "x") - end(False, "x"), end(True, "y") - end(False, "y")).alias("len"))
    return rows.select("contig", F.round("len", 4).alias("len"))


SCENE_HEAD = """{SEG}, {LK}, {CON}, n AS (SELECT count(*) AS n, sum(length(id) + 3) - 1 AS ids, max(greatest(in_x, out_x)) AS x, max(in_y) AS y FROM con), m AS (SELECT count(*) AS m FROM e),
t AS (SELECT n, m, ids, concat('{"version":1,"source":"bridge","contigCount":', n, ',"linkCount":', m, ',"columns":{"contigPositions":{"dtype":"f32","size":4,"offset":0,"length":', 4 * n,
 '},"contigWidth":{"dtype":"f32","size":1,"offset":', 16 * n, ',"length":', n, '},"linkPositions":{"dtype":"f32","size":4,"offset":', 20 * n, ',"length":', 4 * m,
 '},"linkEndpoints":{"dtype":"u32","size":4,"offset":', 20 * n + 16 * m, ',"length":', 4 * m, '},"contigColor":{"dtype":"u8","size":4,"offset":', 20 * n + 32 * m, ',"length":', 4 * n,
 '}},"idTable":[],"bbox":[0.0,0.0,', x, ',', y, ']}') AS head FROM n, m)
SELECT (8 + length(head) + ids + 24 * n + 32 * m)::BIGINT AS bytes, n AS contigs, m AS links FROM t"""


@query("scene_bytes", SCENE_HEAD)
def scene_bytes(spark, d):
    """The whole graph as a scene file: its size, and the counts of its header."""
    g = graph(spark, d)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.gsc"
    scene_file.write_gsc1(sc.build_scene(g, sc.grid_positions(g), "bridge"), path)
    size = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))
    return size.join(scene_file.read_headers(spark, path), "path").select("bytes", "contigs", "links")
