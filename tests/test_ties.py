"""Rows that hang on the last bit: the same as by the SQL."""

import datetime
from types import SimpleNamespace

import pytest

from contiguum.sources import bridge


def events_of(spark, tmp_path, monkeypatch, ids):
    """An events table of these ids, each of another user, and its graph: a parsed one would number its contigs from 0."""
    from contiguum.plans import registry

    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=k), k, "purchase", 1.5 * k, "{}") for k, i in enumerate(ids)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    end = "struct<node_id string, port string>"
    links = spark.createDataFrame([], f"ord long, start {end}, end {end}")
    monkeypatch.setattr(registry, "graph", lambda spark, d: SimpleNamespace(segments=bridge.bridge_segments(events), links=links))
    return str(tmp_path)


def both(spark, folder, name):
    """Rows of the query and of its SQL, sorted."""
    duckdb = pytest.importorskip("duckdb")
    from contiguum.plans import registry

    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    got = registry.queries()[name](spark, folder)
    con.execute("create table want as " + registry.oracle_sql()[name])
    want = con.execute(f"select {', '.join(got.columns)} from want").fetchall()
    return sorted(map(tuple, got.collect()), key=str), sorted(want, key=str)


#: Contigs of which the grabbed point is as far from both ends but for the last bit.
TIES = (58285, 85039, 135583, 148466, 159113, 162337)


def test_zones_at_ties(spark, tmp_path, monkeypatch):
    got, want = both(spark, events_of(spark, tmp_path, monkeypatch, TIES), "grab_zone")
    assert len(got) == len(TIES) and got == want


def test_drags_at_ties(spark, tmp_path, monkeypatch):
    got, want = both(spark, events_of(spark, tmp_path, monkeypatch, TIES), "drag_edits")
    assert len(got) == len(TIES) and got == want


def test_rounding_is_that_of_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from contiguum.plans import registry

    values = [k + 0.000005 for k in range(200)] + [0.0, 1e-9, 7e300, 1e308]
    want = [duckdb.connect().execute("select round(?::double, 5)", [v]).fetchall()[0][0] for v in values]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").select(*registry.r5("v")).collect()]
    assert got == want
