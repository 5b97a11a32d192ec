"""Searches against Dijkstra and plain breadth-first search."""

import heapq
import random

import pytest

from contiguum.operators import components as cc
from contiguum.operators import searches as se


def dijkstra(edges, sources):
    near: dict = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    best, heap = {}, [(0.0, s, s) for s in sources]
    heapq.heapify(heap)
    while heap:
        d, root, a = heapq.heappop(heap)
        if a not in best:
            best[a] = (d, root)
            for b, w in near.get(a, ()):
                heapq.heappush(heap, (d + w, root, b))
    return best


def made(seed, n=120):
    """Trees, chains, rings, self-loops and parallel edges; weights are zero, equal or far apart, sums of them exact."""
    rnd = random.Random(seed)
    out = [(k, rnd.randrange(max(0, k - rnd.choice([1, 1, 1, 9])), k), rnd.choice([0.0, 1.0, 1.0, 0.5, 64.0])) for k in range(1, n) if rnd.random() < 0.93]
    out += [(rnd.randrange(n), rnd.randrange(n), rnd.choice([0.0, 2.0, 200.0])) for _ in range(n // 12)]
    ring = [(1000 + k, 1000 + (k + 1) % 9, 1.0) for k in range(9)]
    return out + ring + [(2000 + k, 2000 + (k + 1) % 5, 1.0) for k in range(5)] + [(7, 7, 1.0), (3, 4, 1.0), (4, 3, 0.5)]


@pytest.mark.parametrize(("seed", "delta"), [(1, None), (2, 40.0)])
def test_distances(spark, seed, delta):
    edges = made(seed)
    rnd = random.Random(seed)
    sources = {k: [rnd.randrange(120) for _ in range(k + 1)] for k in range(4)} | {9: [1003, 5], 10: [5555]}
    df = spark.createDataFrame(edges, "a long, b long, w double")
    got = se.distances(df, spark.createDataFrame([(k, n) for k, ns in sources.items() for n in ns], "key long, node long"), delta)
    want = {(k, n): v for k, ns in sources.items() for n, v in dijkstra(edges, ns).items()}
    assert {(r.key, r.node): (r.dist, r.root) for r in got.collect()} == want


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    """A chain of 100,000 nodes in mixed order, and its hops, tip, end and backbone, in tens of written tables."""
    n, step = 100_000, 48_271
    df = spark.range(n - 1).selectExpr(f"id * {step} % 100003 AS a", f"(id + 1) * {step} % 100003 AS b")
    rounds = []
    for m in (se, cc):
        monkeypatch.setattr(m, "cut", lambda t, f=m.cut: rounds.append(1) or f(t))
    got = cc.hops(df, spark.createDataFrame([(0,)], "n long"))
    row = got.selectExpr("max(hops) AS most", "count(*) AS n", "count(DISTINCT hops) AS d", "sum(CAST(parent IS NULL AS INT)) AS top").first()
    assert (row.most, row.n, row.d, row.top) == (n - 1, n, n, 1)
    assert len(rounds) < 60
    assert got.filter(f"n <> bigint(hops) * {step} % 100003").count() == 0


def test_diameter_and_backbone(spark):
    rnd = random.Random(4)
    edges = [(k, rnd.randrange(max(0, k - 4), k)) for k in range(1, 60) if rnd.random() < 0.93] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(4)]
    nodes = spark.createDataFrame([(k,) for k in range(63)], "ord long")
    df = spark.createDataFrame(edges, "a long, b long")
    ends = {r.key: (r.tip, r.end, r.hops) for r in se.diameters(nodes, df).collect()}
    paths: dict = {}
    for r in se.backbones(nodes, df).collect():
        paths.setdefault(r.key, []).append((r.place, r.node))
    weighted = [(a, b, 1.0) for a, b in edges]
    left = set(range(63))
    seen_backbone = set()
    while left:
        key = min(left)
        mine = dijkstra(weighted, [key])
        left -= set(mine)
        tip = min(mine, key=lambda v: (-mine[v][0], v))
        hop = {v: d for v, (d, _) in dijkstra(weighted, [tip]).items()}
        end = min(hop, key=lambda v: (-hop[v], v))
        assert ends[key] == (tip, end, hop[end])
        at, want = end, []
        while True:
            want.append((hop[at], at))
            if at == tip:
                break
            at = min(b for e in edges for a, b in (e, e[::-1]) if a == at and hop[b] == hop[at] - 1)
        assert sorted(paths[key]) == sorted(want)
        seen_backbone |= {v for _, v in want}
    near = dijkstra(weighted, sorted(seen_backbone))
    assert {r.node: (r.hops, r.root) for r in se.nearest_backbone(nodes, df).collect()} == near


def test_empty(spark):
    nothing = spark.createDataFrame([], "a long, b long, w double")
    assert [tuple(r) for r in se.distances(nothing, spark.createDataFrame([(1, 5)], "key long, node long")).collect()] == [(1, 5, 0.0, 5)]
    assert se.distances(nothing, spark.createDataFrame([], "key long, node long")).count() == 0
    assert [tuple(r) for r in se.backbones(spark.createDataFrame([(3,)], "ord long"), nothing).collect()] == [(3, 0, 3)]
