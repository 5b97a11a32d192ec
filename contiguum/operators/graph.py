"""The assembly graph: two immutable tables, look-ups, edits that return a new graph and a change log."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EdgeExists, EdgeNotFound, InvalidEdgeEndpoint, NodeExists, NodeNotFound
from .components import component_labels, hops, relabelled
from .lineage import cut, numbered

SEGMENTS = "ord long, id string, length_bp long, coverage double, tags map<string,string>"
END = "struct<node_id:string,port:string>"
LINKS = f"ord long, id string, start {END}, end {END}, overlap string, tags map<string,string>"
PATCH = "seq long, op string, kind string, id string"


class Patch:
    """What an edit changed, as a table (seq, op, kind, id) with op add, remove or update and kind node or edge."""

    def __init__(self, changes: DataFrame, topology_changed: bool):
        self.changes, self.topology_changed = changes, topology_changed

    def merge(self, other: Patch) -> Patch:
        """This patch's changes, then the other's."""
        high = self.changes.agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
        return Patch(self.changes.unionByName(other.changes.withColumn("seq", F.col("seq") + high)), self.topology_changed or other.topology_changed)

    def ids(self, op: str, kind: str) -> list[str]:
        return [r["id"] for r in self.changes.filter((F.col("op") == op) & (F.col("kind") == kind)).orderBy("seq").collect()]


class AssemblyGraph:
    """Segments and links.  Tables are never changed: an edit makes a new graph.

    A new graph finds its components on demand.  Where those of the graph before the edit are known, only the ones that the edit touched are searched again.
    """

    def __init__(self, segments: DataFrame, links: DataFrame):
        self.segments, self.links = segments, links
        self.spark: SparkSession = segments.sparkSession
        self._before: tuple[DataFrame, DataFrame, DataFrame] | None = None

    def _edited(self, segments: DataFrame, links: DataFrame, touched: DataFrame | None = None, joined: DataFrame | None = None) -> AssemblyGraph:
        """The graph after an edit that took something from the nodes ``touched`` (id) and made the links ``joined`` (a_id, b_id)."""
        out = AssemblyGraph(segments, links)
        if "labels" in self.__dict__:
            at = self.segments.select("ord", "id")
            gone = at.limit(0).select("ord") if touched is None else at.join(touched.distinct(), "id").select("ord")
            ends = (at.withColumnRenamed("id", f"{e}_id").withColumnRenamed("ord", e) for e in "ab")
            new = at.limit(0).select(F.col("ord").alias("a"), F.col("ord").alias("b")) if joined is None else joined
            for e in ends if joined is not None else ():
                new = new.join(e, e.columns[1])
            out._before = self.labels, cut(gone), cut(new.select("a", "b"))
        return out

    # look-ups

    def get_node(self, node_id: str):
        rows = self.segments.filter(F.col("id") == node_id).limit(1).collect()
        if not rows:
            raise NodeNotFound(node_id)
        return rows[0]

    def get_edge(self, edge_id: str):
        rows = self.links.filter(F.col("id") == edge_id).limit(1).collect()
        if not rows:
            raise EdgeNotFound(edge_id)
        return rows[0]

    def has_node(self, node_id: str) -> bool:
        return not self.segments.filter(F.col("id") == node_id).isEmpty()

    def has_edge(self, edge_id: str) -> bool:
        return not self.links.filter(F.col("id") == edge_id).isEmpty()

    @cached_property
    def endpoints(self) -> DataFrame:
        """(node_id, port, edge_id, ord): both ends of each link; a link with both ends at one port has one row there."""
        ends = F.array_distinct(F.array("start", "end"))
        return self.links.select(F.explode(ends).alias("e"), F.col("id").alias("edge_id"), "ord").select("e.node_id", "e.port", "edge_id", "ord")

    @cached_property
    def ports(self) -> DataFrame:
        """Two rows for each segment: (node_ord, node_id, port, side)."""
        each = F.explode(F.array(*(F.struct(F.lit(p).alias("port"), F.lit(s).cast("tinyint").alias("side")) for s, p in enumerate(("IN", "OUT")))))
        return self.segments.select(F.col("ord").alias("node_ord"), F.col("id").alias("node_id"), each.alias("p")).select("node_ord", "node_id", "p.port", "p.side")

    def port_edges(self) -> DataFrame:
        """Edge ids at every port, empty for a port without links."""
        at = self.endpoints.groupBy("node_id", "port").agg(F.array_sort(F.collect_set("edge_id")).alias("edges"))
        return self.ports.join(at, ["node_id", "port"], "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<string>")))

    def incident_edges_at_port(self, node_id: str, port: str) -> set[str]:
        self.get_node(node_id)
        return {r[0] for r in self.endpoints.filter((F.col("node_id") == node_id) & (F.col("port") == port)).select("edge_id").collect()}

    def incident_edges(self, node_id: str | None = None) -> DataFrame | set[str]:
        """Distinct (node_id, edge_id) of all nodes, or the set of one node."""
        pairs = self.endpoints.select("node_id", "edge_id").distinct()
        if node_id is None:
            return pairs
        self.get_node(node_id)
        return {r["edge_id"] for r in pairs.filter(F.col("node_id") == node_id).collect()}

    def neighbors(self, node_id: str | None = None) -> DataFrame | set[str]:
        """Distinct (node_id, neighbor) of all nodes without self-links, or the set of one node."""
        s, e = F.col("start.node_id"), F.col("end.node_id")
        pairs = self.links.select(s.alias("node_id"), e.alias("neighbor")).union(self.links.select(e, s)).filter("node_id <> neighbor").distinct()
        if node_id is None:
            return pairs
        self.get_node(node_id)
        return {r["neighbor"] for r in pairs.filter(F.col("node_id") == node_id).collect()}

    def search(self, query: str) -> int | None:
        """Index of the first segment with exactly this id, blanks around it aside."""
        return self.segments.filter(F.col("id") == query.strip()).agg(F.min("ord")).first()[0]

    def edges_by_ord(self) -> DataFrame:
        """(ord, a, b): links between segment indexes."""
        seg = self.segments.select("id", "ord")
        a, b = (seg.select(F.col("id").alias(f"{n}_id"), F.col("ord").alias(n)) for n in "ab")
        return self.links.select("ord", F.col("start.node_id").alias("a_id"), F.col("end.node_id").alias("b_id")).join(a, "a_id").join(b, "b_id").select("ord", "a", "b")

    # components

    @cached_property
    def labels(self) -> DataFrame:
        """(ord, label): the first segment of each segment's component."""
        if self._before is None:
            return component_labels(self.segments, self.edges_by_ord(), closed=True)
        labels, touched, joined = self._before
        return relabelled(labels, self.segments.select("ord"), self.edges_by_ord(), touched, joined)

    @cached_property
    def components(self) -> DataFrame:
        """(ord, id, cid): components are numbered by their first segment."""
        labels = self.labels
        roots = labels.filter("ord = label").select("label")
        # one row for each component; ranks by a range sort, not in one task
        cids = numbered(roots, [F.col("label")], "cid")
        return cut(self.segments.select("ord", "id").join(labels, "ord").join(cids, "label").select("ord", "id", "cid"))

    def component_summaries(self) -> DataFrame:
        """(cid, num_nodes, num_edges): a link counts where it starts."""
        nodes = self.components.groupBy("cid").agg(F.count(F.lit(1)).alias("num_nodes"))
        edges = self.links.select(F.col("start.node_id").alias("id")).join(self.components, "id").groupBy("cid").agg(F.count(F.lit(1)).alias("num_edges"))
        return nodes.join(edges, "cid", "left").withColumn("num_edges", F.coalesce("num_edges", F.lit(0).cast("long")))

    def component_of(self, node_id: str) -> int:
        self.get_node(node_id)
        return self.components.filter(F.col("id") == node_id).first()["cid"]

    def nodes_in_component(self, cid: int) -> DataFrame:
        return self.components.filter(F.col("cid") == cid).orderBy("ord").select("ord", "id")

    def summary(self) -> DataFrame:
        """One row: contigs, links, components."""
        one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
        return one(self.segments, "contigs").crossJoin(one(self.links, "links")).crossJoin(self.components.agg(F.count_distinct("cid").alias("components")))

    def k_hop(self, seeds: list[str], k: int) -> DataFrame:
        """(ord, id, hops) within k links of the seeds."""
        at = self.segments.filter(F.col("id").isin(list(seeds))).select(F.col("ord").alias("n"))
        return hops(self.edges_by_ord(), at, k, "n").withColumnRenamed("n", "ord").join(self.segments.select("ord", "id"), "ord").select("ord", "id", "hops")

    # edits

    def _patch(self, rows: list[tuple[str, str, str]], topology: bool) -> Patch:
        return Patch(self.spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], PATCH), topology)

    def _next(self, table: DataFrame) -> int:
        return table.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("n")).first()["n"]

    def add_node(self, node_id: str, length_bp: int | None = None, coverage: float | None = None, tags: dict | None = None) -> tuple[AssemblyGraph, Patch]:
        if self.has_node(node_id):
            raise NodeExists(node_id)
        row = self.spark.createDataFrame([(self._next(self.segments), node_id, length_bp, coverage, tags or {})], SEGMENTS)
        return self._edited(self.segments.unionByName(row), self.links), self._patch([("add", "node", node_id)], True)

    def update_nodes(self, edits: DataFrame) -> AssemblyGraph:
        """Edits (id, length_bp, coverage, tags): values that are not null replace the old ones; ids must exist."""
        lost = edits.join(self.segments, "id", "left_anti").select("id").limit(1).collect()
        if lost:
            raise NodeNotFound(lost[0]["id"])
        names = ("length_bp", "coverage", "tags")
        new = edits.select("id", *(F.col(c).alias(f"new_{c}") for c in names))
        merged = self.segments.join(new, "id", "left")
        return self._edited(merged.select("ord", "id", *(F.coalesce(f"new_{c}", c).alias(c) for c in names)), self.links)

    def update_node(self, node_id: str, length_bp: int | None = None, coverage: float | None = None, tags: dict | None = None) -> tuple[AssemblyGraph, Patch]:
        row = self.spark.createDataFrame([(node_id, length_bp, coverage, tags)], "id string, length_bp long, coverage double, tags map<string,string>")
        return self.update_nodes(row), self._patch([("update", "node", node_id)], False)

    def remove_nodes(self, ids: list[str] | DataFrame) -> tuple[AssemblyGraph, Patch]:
        """Nodes go with all their links.  Ids must exist, and a repeated id is missing the second time."""
        gone = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id string")
        bad = gone.groupBy("id").count().join(self.segments.select("id", F.lit(1).alias("there")), "id", "left").filter("there is null or count > 1").orderBy("id").limit(1).collect()
        if bad:
            raise NodeNotFound(bad[0]["id"])
        edges = self._without(gone)
        lost = self.links.join(edges.select("id"), "id", "left_anti").select("id")
        # a node's links go first, in the order of their ids
        both = lost.select(F.lit("edge").alias("kind"), "id").union(gone.select(F.lit("node").alias("kind"), "id"))
        changes = numbered(both.withColumn("op", F.lit("remove")), [F.col("kind"), F.col("id")], "seq")
        left = self._edited(self.segments.join(gone, "id", "left_anti").select(self.segments.columns), edges, touched=gone)
        return left, Patch(changes.select("seq", "op", "kind", "id"), True)

    def _without(self, gone: DataFrame) -> DataFrame:
        links = self.links
        for end in ("start", "end"):
            links = links.withColumn("g", F.col(f"{end}.node_id")).join(gone.select(F.col("id").alias("g")), "g", "left_anti").drop("g")
        return links.select(self.links.columns)

    def remove_node(self, node_id: str) -> tuple[AssemblyGraph, Patch]:
        return self.remove_nodes([node_id])

    def add_edge(self, edge_id: str, start: tuple[str, str], end: tuple[str, str], overlap: str | None = None, tags: dict | None = None) -> tuple[AssemblyGraph, Patch]:
        if self.has_edge(edge_id):
            raise EdgeExists(edge_id)
        self._must_exist(start, end)
        row = self.spark.createDataFrame([(self._next(self.links), edge_id, start, end, overlap, tags or {})], LINKS)
        pair = self.spark.createDataFrame([(start[0], end[0])], "a_id string, b_id string")
        return self._edited(self.segments, self.links.unionByName(row), joined=pair), self._patch([("add", "edge", edge_id)], True)

    def _must_exist(self, *ends: tuple[str, str] | None) -> None:
        for e in ends:
            if e is not None and (e[1] not in ("IN", "OUT") or not self.has_node(e[0])):
                raise InvalidEdgeEndpoint(str(e))

    def remove_edge(self, edge_id: str) -> tuple[AssemblyGraph, Patch]:
        old = self.get_edge(edge_id)
        end = self.spark.createDataFrame([(old["start"]["node_id"],)], "id string")
        return self._edited(self.segments, self.links.filter(F.col("id") != edge_id), touched=end), self._patch([("remove", "edge", edge_id)], True)

    def reconnect_edges(self, edits: DataFrame) -> AssemblyGraph:
        """Edits (id, new_start, new_end) of existing links; a null end stays, and so do the ids."""
        lost = edits.join(self.links, "id", "left_anti").select("id").limit(1).collect()
        if lost:
            raise EdgeNotFound(lost[0]["id"])
        ends = edits.select(F.explode(F.array("new_start", "new_end")).alias("e")).filter("e is not null").select(F.col("e.node_id").alias("id"))
        loose = ends.join(self.segments, "id", "left_anti").limit(1).collect()
        if loose:
            raise InvalidEdgeEndpoint(loose[0]["id"])
        merged = self.links.join(edits.select("id", "new_start", "new_end"), "id", "left")
        new = merged.select("ord", "id", F.coalesce("new_start", "start").alias("start"), F.coalesce("new_end", "end").alias("end"), "overlap", "tags")
        moved = edits.select("id")
        ends = self.links.join(moved, "id", "left_semi").select(F.col("start.node_id").alias("id"))
        return self._edited(self.segments, new, ends, new.join(moved, "id", "left_semi").select(F.col("start.node_id").alias("a_id"), F.col("end.node_id").alias("b_id")))

    def reconnect_edge_end(self, edge_id: str, new_start: tuple[str, str] | None = None, new_end: tuple[str, str] | None = None) -> tuple[AssemblyGraph, Patch]:
        self.get_edge(edge_id)
        self._must_exist(new_start, new_end)
        row = self.spark.createDataFrame([(edge_id, new_start, new_end)], f"id string, new_start {END}, new_end {END}")
        return self.reconnect_edges(row), self._patch([("update", "edge", edge_id)], True)

