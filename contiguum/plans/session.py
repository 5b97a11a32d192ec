"""Sessions: a loaded graph with its layout, position overrides and scene, looked up by id."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.gfa import valid_dataset_name
from ..operators.graph import AssemblyGraph
from ..operators.layout import LayoutParams, layout
from ..operators.lineage import cut
from ..operators.scene import Scene, build_scene, merged_positions
from ..sources.gfa import read_gfa
from ..sources.scene_file import scene_bytes


class BadRequest(ValueError):
    """An id or name that cannot be valid (status 400)."""

    status = 400


class Unknown(LookupError):
    """An id or dataset that does not exist (status 404)."""

    status = 404


class GraphSession:
    """A graph whose layout is computed once, and overrides that lie on top of it."""

    def __init__(self, graph: AssemblyGraph, source: str = ""):
        self.id, self.graph, self.source = str(uuid.uuid4()), graph, source
        self.computed: DataFrame | None = None
        self.overrides: dict[str, tuple[float, float]] = {}

    def positions(self, recompute: bool = False, params: LayoutParams | None = None) -> DataFrame:
        """Computed positions; the layout has a fixed seed, so computing again gives the same."""
        if self.computed is None or recompute:
            self.computed = cut(layout(self.graph, params))
        return self.computed

    def set_override(self, port_id: str, x: float, y: float) -> None:
        self.overrides[port_id] = (x, y)

    def clear_override(self, port_id: str) -> None:
        self.overrides.pop(port_id, None)

    def clear_overrides(self) -> None:
        self.overrides.clear()

    def merged(self) -> DataFrame:
        rows = [(k, float(x), float(y)) for k, (x, y) in self.overrides.items()]
        over = self.graph.spark.createDataFrame(rows, "port_id string, x double, y double") if rows else None
        return merged_positions(self.positions(), over)

    def scene(self, recompute: bool = False) -> Scene:
        self.positions(recompute)
        return build_scene(self.graph, self.merged(), self.source)

    def summary(self) -> dict:
        row = self.graph.summary().first()
        return {"graph_id": self.id, "source": self.source, "contigCount": row["contigs"], "linkCount": row["links"], "componentCount": row["components"]}

    def components(self) -> list[dict]:
        """One entry for each component, by number."""
        return [r.asDict() for r in self.graph.component_summaries().orderBy("cid").toLocalIterator()]


class SessionStore:
    def __init__(self) -> None:
        self._sessions: dict[str, GraphSession] = {}

    def create(self, graph: AssemblyGraph, source: str = "") -> GraphSession:
        s = GraphSession(graph, source)
        self._sessions[s.id] = s
        return s

    def has(self, session_id: str) -> bool:
        return session_id in self._sessions

    def get(self, session_id: str) -> GraphSession:
        if not re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", session_id):
            raise BadRequest("invalid graph id")
        if session_id.lower() not in self._sessions:
            raise Unknown("unknown graph id")
        return self._sessions[session_id.lower()]


def dataset_path(spark: SparkSession, folder: str, name: str, stateless: bool = False) -> str:
    if not valid_dataset_name(name, stateless):
        raise BadRequest("invalid name")
    path = f"{folder.rstrip('/')}/{name}.gfa"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise Unknown(f"{name}.gfa not found")
    return path


def load_graph(spark: SparkSession, store: SessionStore, folder: str, name: str = "example") -> GraphSession:
    """Parse a dataset by name (without suffix) into a new session."""
    return store.create(read_gfa(spark, dataset_path(spark, folder, name)), name)


def session_scene(store: SessionStore, session_id: str, recompute: bool = False) -> bytes:
    return scene_bytes(store.get(session_id).scene(recompute))


def stateless_scene(spark: SparkSession, folder: str, name: str) -> bytes:
    """Parse, lay out and encode without keeping anything."""
    return scene_bytes(GraphSession(read_gfa(spark, dataset_path(spark, folder, name, stateless=True)), name).scene())


def health() -> dict:
    return {"status": "ok"}
