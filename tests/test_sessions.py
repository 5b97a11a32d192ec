"""Sessions from files: names, errors, and scenes held against the positions they were built from."""

import numpy as np
import pytest

from contiguum.functions.gfa import valid_dataset_name
from contiguum.operators import ribbons
from contiguum.plans import session as ps
from contiguum.sources.scene_file import decode

from conftest import TINY


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("data")
    (path / "tiny.gfa").write_text(TINY)
    (path / "a.b-c.gfa").write_text(TINY)
    return f"file://{path}"


def test_names_and_errors(spark, folder):
    assert [valid_dataset_name(n) for n in ("tiny", "a.b-c", "a/b", "", "..\\x", "a b")] == [True, True, False, False, False, False]
    assert [valid_dataset_name(n, True) for n in ("tiny", "a_1", "a.b", "a-b")] == [True, True, False, False]
    for name, stateless, error in (("a/b", False, ps.BadRequest), ("a-b", True, ps.BadRequest), ("none", False, ps.Unknown), ("none", True, ps.Unknown)):
        with pytest.raises(error) as e:
            ps.dataset_path(spark, folder, name, stateless)
        assert e.value.status == (400 if error is ps.BadRequest else 404)
    store = ps.SessionStore()
    with pytest.raises(ps.Unknown):
        ps.load_graph(spark, store, folder)  # the default name
    assert ps.load_graph(spark, store, folder, "a.b-c").summary()["contigCount"] == 6
    assert ps.health() == {"status": "ok"}


def check(blob, session, positions):
    """Every ribbon's and link's ends are the positions' own, as single precision."""
    got = decode(blob)
    at = {r.port_id: (np.float32(r.x), np.float32(r.y)) for r in positions.collect()}
    ids = [r.id for r in session.graph.segments.orderBy("ord").collect()]
    assert got["idTable"] == ids
    assert got["contigPositions"].tolist() == [[*at[f"{i}:IN"], *at[f"{i}:OUT"]] for i in ids]
    side = {"IN": 0, "OUT": 1}
    links = session.graph.links.orderBy("ord").collect()
    assert got["linkPositions"].tolist() == [[*at[f"{e.start.node_id}:{e.start.port}"], *at[f"{e.end.node_id}:{e.end.port}"]] for e in links]
    assert got["linkEndpoints"].tolist() == [[ids.index(e.start.node_id), side[e.start.port], ids.index(e.end.node_id), side[e.end.port]] for e in links]
    xy = np.array([(r.x, r.y) for r in positions.collect()])
    assert got["bbox"] == [*xy.min(axis=0), *xy.max(axis=0)]
    return got


def test_scenes_of_a_session(spark, folder):
    store = ps.SessionStore()
    s = ps.load_graph(spark, store, folder, "tiny")
    assert store.has(s.id) and s.summary() == {"graph_id": s.id, "source": "tiny", "contigCount": 6, "linkCount": 4, "componentCount": 3}
    assert s.components() == [{"cid": 0, "num_nodes": 3, "num_edges": 3}, {"cid": 1, "num_nodes": 2, "num_edges": 1}, {"cid": 2, "num_nodes": 1, "num_edges": 0}]
    first = ps.session_scene(store, s.id)
    assert check(first, s, s.positions())["source"] == "tiny"
    assert ps.session_scene(store, s.id, recompute=True) == first == ps.stateless_scene(spark, folder, "tiny")
    s.set_override("s1:IN", -1234.5, 77.25)
    s.set_override("s6:OUT", 0.5, 0.5)
    moved = check(ps.session_scene(store, s.id), s, s.merged())
    assert moved["contigPositions"][0, :2].tolist() == [-1234.5, 77.25] and moved["bbox"][0] == -1234.5
    s.clear_override("s6:OUT")
    s.clear_overrides()
    assert ps.session_scene(store, s.id) == first


def test_mean_chord_with_a_floor(spark):
    rows = spark.createDataFrame([(0, 0.0, 0.0, 3.0, 4.0), (1, 1.0, 1.0, 1.0, 1.0), (2, 0.0, 0.0, 0.0, 1.0)], "ord long, in_x double, in_y double, out_x double, out_y double")
    assert ribbons.mean_chord(rows).first()[0] == 2.0 and ribbons.mean_chord(rows, 1.5).first()[0] == 2.5
    assert ribbons.mean_chord(rows.limit(0), 1.5).first()[0] == 1.0
