"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_queries_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from contiguum.plans import registry

    con = duckdb.connect()
    con.sql(f"create view events as select * from '{DATA}/events.parquet'")
    for name in ("gfa_lines", "gfa_links", "components", "component_summaries", "port_degree", "violations", "scene_links", "edit_curves"):
        got = registry.queries()[name](spark, str(DATA))
        cols = sorted(got.columns)
        want = con.sql(registry.oracle_sql()[name]).df()[cols]
        a, b = (sorted(map(tuple, x.astype(object).where(x.notna(), None).values.tolist()), key=str) for x in (got.toPandas()[cols], want))
        assert [tuple(map(str, r)) for r in a] == [tuple(map(str, r)) for r in b], name


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_scene_bytes_and_gestures_cover_the_input(spark):
    """The scene file has every contig and link; the gestures are all moves of ports in the edit log."""
    from contiguum.operators import edits
    from contiguum.plans import registry

    g = registry.graph(spark, str(DATA))
    head = registry.queries()["scene_bytes"](spark, str(DATA)).first()
    assert (head.contigs, head.links) == (g.segments.count(), g.links.count()) and head.contigs == 1000
    ports = {r.key: r for r in registry.port_points(registry.contigs(spark, str(DATA))).collect()}
    moved = {r.key: r for r in edits.port_moves(registry.edit_log(spark, str(DATA))).collect() if r.key in ports}
    got = registry.queries()["relax_local"](spark, str(DATA)).collect()
    assert moved and {r.gesture for r in got} == set(moved)
    held = {r.gesture: (r.x, r.y) for r in got if r.gesture == r.key}
    assert held == {k: (ports[k].x + m.dx, ports[k].y + m.dy) for k, m in moved.items()}
