"""Components after edits, against a fresh search of the edited graph; and the success paths of single edits."""

import random

from contiguum.operators import components
from contiguum.operators.graph import AssemblyGraph


def fresh(g):
    return {r.id: r.cid for r in AssemblyGraph(g.segments, g.links).components.collect()}


def test_random_edits(spark, tiny):
    rnd = random.Random(7)
    g = tiny
    assert g.components.count() == 6
    for k in range(9):
        ids = sorted(r.id for r in g.segments.select("id").collect())
        links = sorted(r.id for r in g.links.select("id").collect())
        what = k % 5
        if what == 0:
            g, _ = g.add_node(f"n{k}", 5, tags={"LN": "i:5"})
            assert {r.id: r.cid for r in g.components.collect()} == fresh(g)
            g, _ = g.add_edge(f"x{k}", (f"n{k}", "IN"), (rnd.choice(ids), "OUT"))
        elif what == 1:
            g, _ = g.add_edge(f"e{k}", (rnd.choice(ids), "OUT"), (rnd.choice(ids), "IN"), "3M")
        elif what == 2:
            g, _ = g.remove_edge(rnd.choice(links))
        elif what == 3:
            g, _ = g.reconnect_edge_end(rnd.choice(links), new_end=(rnd.choice(ids), "IN"))
        else:
            g, _ = g.remove_node(rnd.choice(ids))
        assert g._before is not None and {r.id: r.cid for r in g.components.collect()} == fresh(g), (k, what)


def test_single_edits(tiny):
    g, patch = tiny.add_node("new", 7, 2.5, {"LN": "i:7"})
    row = g.get_node("new")
    assert (row.ord, row.length_bp, row.coverage, row.tags) == (6, 7, 2.5, {"LN": "i:7"}) and patch.ids("add", "node") == ["new"] and not tiny.has_node("new")
    h, patch = g.add_edge("link", ("new", "OUT"), ("s1", "IN"), "4M", {"X": "i:1"})
    row = h.get_edge("link")
    assert (row.ord, row.start.node_id, row.end.port, row.overlap, row.tags) == (4, "new", "IN", "4M", {"X": "i:1"}) and patch.ids("add", "edge") == ["link"]
    back, patch = h.remove_edge("link")
    assert back.links.count() == 4 and not back.has_edge("link") and patch.ids("remove", "edge") == ["link"]
    both = patch.merge(g.remove_node("s6")[1])
    assert [tuple(r) for r in both.changes.orderBy("seq").collect()] == [(0, "remove", "edge", "link"), (1, "remove", "node", "s6")] and both.topology_changed


def test_only_touched_components_are_searched(spark, monkeypatch):
    """A graph of 400 chains of five: one link goes, two chains are joined, one node is new."""
    nodes = [(k,) for k in range(2000)]
    links = [(k, k + 1) for k in range(1999) if k % 5 != 4]
    labels = spark.createDataFrame([(k, k - k % 5) for (k,) in nodes], "ord long, label long")
    after = [e for e in links if e != (11, 12)] + [(3, 700), (2000, 705)]
    searched = []
    real = components.component_labels
    monkeypatch.setattr(components, "component_labels", lambda n, e, *a, **b: searched.append((n.count(), e.count())) or real(n, e, *a, **b))
    got = components.relabelled(labels, spark.createDataFrame([*nodes, (2000,)], "ord long"), spark.createDataFrame(after, "a long, b long"), spark.createDataFrame([(11,)], "ord long"), spark.createDataFrame([(3, 700), (2000, 705)], "a long, b long"))
    want = {k: k - k % 5 for (k,) in nodes} | {12: 12, 13: 12, 14: 12, 2000: 705} | {k: 0 for k in range(700, 705)}
    assert {r.ord: r.label for r in got.collect()} == want
    assert searched == [(5, 3), (4, 2)]
