import numpy as np
import pytest
from pyspark.sql import functions as F

from contiguum import errors
from contiguum.operators import layout as lay
from contiguum.operators import ports as po
from contiguum.operators import scene as sc
from contiguum.sources.gfa import read_gfa, violations
from contiguum.sources.scene_file import decode, encode, read_contigs, read_links, scene_bytes


def lines(spark, text):
    return spark.createDataFrame([(i, v) for i, v in enumerate(text.split("\n"), 1)], "line_no long, value string")


def test_component_of_a_long_chain_with_the_smallest_node_at_its_end(spark):
    """1, 2, ..., 399 in file order and 0 linked behind 399: one component, however far the smallest node's label has to go."""
    from contiguum.operators.components import component_labels

    n = 400
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, n - 1)] + [(n - 1, 0), (n + 1, n + 2), (5, 5)], "a long, b long")
    got = component_labels(spark.range(n + 4).withColumnRenamed("id", "ord"), edges).collect()
    assert {r.ord: r.label for r in got} == {**dict.fromkeys(range(n), 0), n: n, n + 1: n + 1, n + 2: n + 1, n + 3: n + 3}


def test_golden_segments_and_links(tiny):
    seg = [(r.id, r.length_bp, r.coverage) for r in tiny.segments.orderBy("ord").collect()]
    assert seg == [("s1", 100, 5.0), ("s2", 10, 3.5), ("s3", 250, None), ("s4", 40, 80.0), ("s5", 60, None), ("s6", 10, None)]
    assert tiny.get_node("s1").tags == {"LN": "i:100", "dp": "f:5.0"}
    ids = [(r.id, r.overlap) for r in tiny.links.orderBy("ord").collect()]
    assert ids == [("e0:s1:OUT->s2:IN", "10M"), ("e1:s2:OUT->s3:OUT", "5M"), ("e2:s1:OUT->s3:IN", "0M"), ("e3:s4:OUT->s5:IN", "3M")]


def test_components(tiny):
    assert {r.id: r.cid for r in tiny.components.collect()} == {"s1": 0, "s2": 0, "s3": 0, "s4": 1, "s5": 1, "s6": 2}
    assert [tuple(r) for r in tiny.component_summaries().orderBy("cid").collect()] == [(0, 3, 3), (1, 2, 1), (2, 1, 0)]
    assert tiny.components is tiny.components
    assert tiny.neighbors("s1") == {"s2", "s3"}
    assert tiny.incident_edges_at_port("s1", "OUT") == {"e0:s1:OUT->s2:IN", "e2:s1:OUT->s3:IN"}


def test_tags_and_lengths(spark):
    text = "# note\n\n  S\ta:b\tACG\tLN:i:x\tdp:Z:1\tdp:f:nan\tX:Y\r\nS\tc\tACGT\tLN:i:0\tKC:i:7\tKC:i:9\tzz:Z:a:b\nS\td\t*\tdp:f:1.0f\tRC:i:3\nP\tx"
    g = read_gfa(spark, lines(spark, text))
    rows = {r.id: r for r in g.segments.collect()}
    assert rows["a:b"].length_bp == 3 and np.isnan(rows["a:b"].coverage)
    assert rows["c"].length_bp == 0 and rows["c"].coverage == 9.0 and rows["c"].tags["zz"] == "Z:a:b"
    assert rows["d"].length_bp is None and rows["d"].coverage == 3.0


@pytest.mark.parametrize(
    ("text", "error"),
    [("S\ts1\t", errors.GFAParseError), ("S\ta\t*\nL\ta\t?\ta\t+\t0M", errors.GFAParseError), ("S\ta\t*\nS\ta\t*", errors.NodeExists), ("L\ta\t+\ta\t+\t0M\nS\ta\t*", errors.InvalidEdgeEndpoint)],
)
def test_first_bad_line_raises(spark, text, error):
    with pytest.raises(error):
        read_gfa(spark, lines(spark, text))
    assert violations(lines(spark, text)).count() == 1


def test_edits(tiny):
    with pytest.raises(errors.NodeExists):
        tiny.add_node("s1")
    with pytest.raises(errors.NodeNotFound):
        tiny.remove_node("nope")
    with pytest.raises(errors.EdgeNotFound):
        tiny.remove_edge("nope")
    with pytest.raises(errors.InvalidEdgeEndpoint):
        tiny.add_edge("x", ("s1", "OUT"), ("nope", "IN"))
    with pytest.raises(errors.EdgeExists):
        tiny.add_edge("e3:s4:OUT->s5:IN", ("s1", "OUT"), ("s2", "IN"))
    g, patch = tiny.remove_node("s1")
    assert patch.ids("remove", "edge") == ["e0:s1:OUT->s2:IN", "e2:s1:OUT->s3:IN"] and patch.ids("remove", "node") == ["s1"]
    assert g.links.count() == 2 and patch.topology_changed
    g, _ = tiny.reconnect_edge_end("e3:s4:OUT->s5:IN", new_end=("s6", "IN"))
    assert g.get_edge("e3:s4:OUT->s5:IN").end.node_id == "s6"
    g, patch = tiny.update_node("s2", coverage=9.0)
    assert g.get_node("s2").coverage == 9.0 and g.get_node("s2").length_bp == 10 and not patch.topology_changed


def test_port_graph(tiny):
    assert po.port_nodes(tiny).count() == 12
    kinds = {r.kind: r["count"] for r in po.port_edges(tiny).groupBy("kind").count().collect()}
    assert kinds == {"INTERNAL": 6, "EXTERNAL": 4}


def test_layout_and_scene(spark, tiny, tmp_path):
    pos = lay.layout(tiny).orderBy("port_id").toPandas()
    again = lay.layout(tiny).orderBy("port_id").toPandas()
    assert len(pos) == 12 and np.isfinite(pos[["x", "y"]]).all().all() and pos.equals(again)
    at = pos.set_index("port_id")
    assert abs(np.hypot(at.x["s6:IN"] - at.x["s6:OUT"], at.y["s6:IN"] - at.y["s6:OUT"]) - (1 + 0.6 * 10**0.5)) < 1e-9
    boxes = lay.packed_boxes(lay.boxes(lay.local_layout(tiny))).toPandas()
    for i, a in boxes.iterrows():
        for j, b in boxes.iterrows():
            if i < j:
                assert a.ox + a.w <= b.ox or b.ox + b.w <= a.ox or a.oy + a.h <= b.oy or b.oy + b.h <= a.oy
    blob = scene_bytes(sc.build_scene(tiny, sc.grid_positions(tiny), "tiny"))
    (tmp_path / "t.gsc").write_bytes(blob)
    got = decode(blob)
    assert got["idTable"] == ["s1", "s2", "s3", "s4", "s5", "s6"] and got["linkEndpoints"].tolist()[1] == [1, 1, 2, 1]
    same = encode("tiny", got["idTable"], tuple(got["bbox"]), got)
    assert same == blob
    rows = read_contigs(spark, f"file://{tmp_path}/t.gsc").orderBy("ord").collect()
    assert rows[0].width == pytest.approx(1 + 1.5 * 5**0.5) and rows[3].r == 174
    assert read_links(spark, f"file://{tmp_path}/t.gsc").count() == 4
    with pytest.raises(ValueError):
        decode(b"nope")


def test_random_components_against_union_find(spark):
    rng = np.random.default_rng(0)
    pairs = rng.integers(0, 300, (220, 2))
    from contiguum.operators.components import component_labels

    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    nodes = spark.range(300).withColumnRenamed("id", "ord")
    edges = spark.createDataFrame(pairs.tolist(), "a long, b long")
    assert {r.ord: r.label for r in component_labels(nodes, edges).collect()} == {i: find(i) for i in range(300)}


def test_sessions(spark, tiny):
    from contiguum.plans.session import BadRequest, SessionStore, Unknown

    store = SessionStore()
    s = store.create(tiny, "tiny")
    assert s.summary()["componentCount"] == 3 and store.get(s.id) is s
    first = s.positions()
    assert s.positions() is first
    s.set_override("s1:IN", 1e6, 0.0)
    assert s.scene().bbox.first().max_x == 1e6
    s.clear_overrides()
    assert s.merged().agg(F.max("x")).first()[0] < 1e6
    with pytest.raises(BadRequest):
        store.get("x")
    with pytest.raises(Unknown):
        store.get("00000000-0000-0000-0000-000000000000")


def test_edit_log(spark):
    from contiguum.operators import edits as ed

    rows = [(0, "nudge", 1, 1.0, None)] + [(i, "nudge", 2, 1.0, None) for i in range(1, 25)] + [(25, "nudge", 2, -1.0, None), (26, "toggle", 5, None, None), (27, "toggle", 6, None, None), (28, "toggle", 5, None, None), (29, "move_port", 3, 1.0, 2.0), (30, "move_port", 3, 4.0, 5.0)]
    log = spark.createDataFrame(rows, "seq long, kind string, key long, v0 double, v1 double")
    assert {r.ord: round(r.curve, 6) for r in ed.curves(log).collect()} == {1: 0.15, 2: 2.85}
    assert [r.ord for r in ed.selection(log).collect()] == [6]
    assert [tuple(r) for r in ed.port_moves(log).collect()] == [(3, 4.0, 5.0)]
    assert ed.edit_count(log).first().edits == 3


def test_relax_keeps_lengths(spark):
    from contiguum.operators.relax import relax_local

    ports = spark.createDataFrame([(0, 0.0, 0.0), (1, 10.0, 0.0), (2, 11.0, 0.0), (3, 21.0, 0.0), (4, 22.0, 0.0), (5, 32.0, 0.0)], "key long, x double, y double")
    links = spark.createDataFrame([(0, 1, 2), (1, 3, 4)], "ord long, a long, b long")
    regions = spark.createDataFrame([(7, 0), (7, 1)], "gesture long, contig long")
    pins = spark.createDataFrame([(7, 0, 0.0, 3.0)], "gesture long, key long, x double, y double")
    out = relax_local(ports, links, po.junctions(links), regions, pins, 10.0).orderBy("key").toPandas()
    assert out.key.tolist() == [0, 1, 2, 3] and (out.x[0], out.y[0]) == (0.0, 3.0)
    for a, b in ((0, 1), (2, 3)):
        assert abs(np.hypot(out.x[a] - out.x[b], out.y[a] - out.y[b]) - 10) < 1e-6


def test_bulge_splits_coincident_ribbons(spark):
    from contiguum.operators.ribbons import bulge_offsets, local_bulge

    c = spark.createDataFrame([(0, 0.0, 0.0, 10.0, 0.0), (1, 0.0, 0.0, 10.0, 0.0), (2, 500.0, 0.0, 510.0, 0.0)], "ord long, in_x double, in_y double, out_x double, out_y double")
    off = {r.ord: r.offset for r in bulge_offsets(c).collect()}
    assert off[0] == -off[1] != 0 and off[2] == 0 and abs(off[0]) <= 1.5 + 1e-9
    part = local_bulge(c, spark.createDataFrame([(0,)], "ord long"), bulge_offsets(c))
    assert [r.ord for r in part.collect()] == [0]
