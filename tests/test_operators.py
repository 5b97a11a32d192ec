"""Operators against brute force on small inputs."""

import numpy as np
from pyspark.sql import functions as F

from contiguum.operators import components, layout, ports, relax, ribbons, scene
from contiguum.sources import gfa, scene_file


def test_close_pairs():
    rng = np.random.default_rng(1)
    for n, reach in ((0, 1.0), (1, 1.0), (60, 0.7), (200, 0.2)):
        p = rng.normal(size=(n, 2)) * 3 - 1
        i, j = relax.close_pairs(p, reach)
        d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1)) if n else np.zeros((0, 0))
        want = {(a, b) for a in range(n) for b in range(n) if a != b and d[a, b] < reach}
        assert len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_boxes_do_not_overlap():
    rng = np.random.default_rng(2)
    w, h = rng.uniform(0, 30, 80), rng.uniform(0, 30, 80)
    at = layout.pack_boxes(w, h, 3.0)
    x1, y1 = at[:, 0] + w + 3, at[:, 1] + h + 3
    for a in range(80):
        for b in range(a):
            apart = at[a, 0] >= x1[b] - 1e-6 or at[b, 0] >= x1[a] - 1e-6 or at[a, 1] >= y1[b] - 1e-6 or at[b, 1] >= y1[a] - 1e-6
            assert apart
    largest = int(np.argmax((w + 3) * (h + 3)))
    assert at[largest].tolist() == [0.0, 0.0] and len(layout.pack_boxes(w[:0], h[:0], 3.0)) == 0


def test_landmarks_and_terms():
    rng = np.random.default_rng(3)
    u, v = np.r_[np.arange(1, 30), rng.integers(30, size=10)], np.r_[[int(rng.integers(i)) for i in range(1, 30)], rng.integers(30, size=10)]
    w = rng.uniform(0.5, 3, len(u))
    g = layout.LocalGraph(u, v, w, 0)
    full = np.full((30, 30), np.inf)
    for a in range(30):
        full[a, a] = 0
        for b, x in g.near[a]:
            full[a, b] = min(full[a, b], x)
    for k in range(30):
        full = np.minimum(full, full[:, k, None] + full[None, k])
    nodes, table = g.landmarks(4, 6)
    assert nodes[0] == 4 and len(set(nodes.tolist())) == 6 and np.allclose(table, full[nodes])
    for k in range(1, 6):
        assert full[nodes[:k]].min(0)[nodes[k]] == full[nodes[:k]].min(0).max()
    pairs, dist = g.terms(6, np.random.default_rng(0))
    assert len({tuple(p) for p in pairs.tolist()}) == len(pairs) and (pairs[:, 0] < pairs[:, 1]).all() and (dist > 0).all()
    assert np.ptp(layout.turned(layout.hull(np.array([[0, 0], [2, 2], [1, 1], [2, 0]])), 0.0), axis=0).tolist() == [2, 2]
    small = layout.LocalGraph(np.array([0]), np.array([1]), np.array([5.0]), 0)
    assert len(small.landmarks(0, 9)[0]) == 2


def test_forest():
    rng = np.random.default_rng(4)
    u, v = rng.integers(0, 400, 300) * 7, rng.integers(0, 400, 300) * 7
    parent = {int(x): int(x) for x in np.r_[u, v]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    up, down = components.forest(u, v)
    assert dict(zip(up.tolist(), down.tolist(), strict=True)) == {x: find(x) for x in parent if find(x) != x}


def test_labels_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(1, 700)] + [(0, 700)] + [(1000, 1001 + i) for i in range(500)] + [(5, 5)]
    nodes = spark.createDataFrame([(i,) for i in [*range(701), *range(1000, 1501), 2000]], "ord long")
    edges = spark.createDataFrame(links + [(3, 9999)], "a long, b long")
    got = {r.ord: r.label for r in components.component_labels(nodes, edges).collect()}
    assert got == {i: 0 if i < 701 else 1000 if i < 1501 else 2000 for (i,) in nodes.collect()}


def test_pairs_and_directions(spark):
    links = spark.createDataFrame([(0, 3, 1), (1, 1, 3), (2, 4, 4), (3, 1, 2)], "ord long, a long, b long")
    assert {tuple(r) for r in ports.canonical_pairs(links).collect()} == {(1, 3, 0), (1, 2, 3)}
    jn = spark.createDataFrame([(1, 0), (2, 0), (5, 1)], "port long, junction long")
    pt = spark.createDataFrame([(0, 0.0, 0.0), (1, 3.0, 4.0), (2, 3.0, 4.0), (3, 3.0, 9.0), (4, 1.0, 1.0), (5, 1.0, 1.0)], "key long, x double, y double")
    got = {r.junction: (r.n, round(r.mx, 9), round(r.my, 9)) for r in ports.junction_directions(jn, pt).collect()}
    assert got == {0: (2, -0.3, 0.1), 1: (1, 0.0, 0.0)}


def test_baked_link_ends(spark):
    links = spark.createDataFrame([(0, 1, 2), (1, 3, 6)], "ord long, a long, b long")
    live = spark.createDataFrame([(1, 1.0, 1.5), (2, 2.0, 2.5), (3, 3.0, 3.5)], "key long, x double, y double")
    baked = spark.createDataFrame([(0, 9.0, 9.0, 9.0, 9.0), (1, 7.0, 7.0, 8.0, 8.5)], "ord long, x0 double, y0 double, x1 double, y1 double")
    assert {r.ord for r in scene.link_positions(links, live).collect()} == {0}
    got = {r.ord: (r.x0, r.y0, r.x1, r.y1) for r in scene.link_positions(links, live, baked).collect()}
    assert got == {0: (1.0, 1.5, 2.0, 2.5), 1: (3.0, 3.5, 8.0, 8.5)}


def test_json_scene(spark, tmp_path):
    rows = scene_file.synthetic_ribbons(spark, 20)
    scene_file.write_json_scene(rows, f"file://{tmp_path}/s")
    assert [tuple(r) for r in scene_file.read_json_scene(spark, f"file://{tmp_path}/s").orderBy("ord").collect()] == [tuple(r) for r in rows.orderBy("ord").collect()]
    assert [r.ord for r in rows.limit(0).collect()] == [] and scene.checksums(rows).first()["n"] == 20


def test_first_ids_and_datasets(spark, tiny, tmp_path):
    assert scene_file.first_ids(tiny.segments, 2) == ["s1", "s2"]
    for name, size in (("b", 10), ("a", 2000)):
        (tmp_path / f"{name}.gfa").write_text("x" * size)
    (tmp_path / "c.txt").write_text("x")
    assert [(r["name"], r["size_bytes"], r["is_large"]) for r in gfa.list_datasets(spark, f"file://{tmp_path}").collect()] == [("a", 2000, False), ("b", 10, False)]


def test_client_helpers(spark):
    assert ribbons.start_indices(3, 4) == [0, 4, 8, 12] and [ribbons.zone_samples(12, z) for z in range(3)] == [(0, 2), (2, 9), (9, 11)]
    assert [relax.drag_mode(*a) for a in ((True, 1, True), (False, 1, True), (False, 1, False), (False, 0, False))] == ["port", "cloud", "port", "port"]
    paths = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 5.0, 0.0), (1, 0, 5.0, 1.0)], "ord long, s int, x double, y double")
    assert [r.ord for r in ribbons.pick_box(paths, 6, 2, 4, 0.5).collect()] == [1] and [r.ord for r in ribbons.pick_point(paths, 5, 0.4, 2).collect()] == [0]
    assert ribbons.pick_point(paths, 50, 50, 1).count() == 0


def test_a_dense_cell_is_met_in_blocks(spark):
    """Half of all points in one cell, many of them in one place: pairs as by brute force, and no task with over twice the median."""
    rng = np.random.default_rng(6)
    x, y = rng.uniform(0, 60, (2, 1400))
    x[:700], y[:700] = rng.uniform(30, 31, (2, 700))
    x[:200], y[:200] = 30.5, 30.25
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "ord long, x double, y double")
    i, j = np.nonzero(np.triu((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 < 1, 1))
    want = set(zip(i.tolist(), j.tolist(), strict=True))
    for most in (2048, 32):
        got = [(r.i, r.j) for r in ribbons.grid_pairs(df, 1.0, most=most).select("i", "j").collect()]
        assert set(got) == want and len(got) == len(want)
    some = df.filter("ord % 3 = 0")
    both = {(a, b) for a, b in (*want, *((b, a) for a, b in want), *((k, k) for k in range(1400))) if a % 3 == 0}
    got = [(r.i, r.j) for r in ribbons.grid_pairs(some, 1.0, df, most=32).select("i", "j").collect()]
    assert set(got) == both and len(got) == len(both)
    for name, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(name, value)
    try:
        made = sorted(r["count"] for r in ribbons.grid_pairs(df, 1.0, most=32).groupBy(F.spark_partition_id()).count().collect())
        whole = max(r["count"] for r in ribbons.grid_pairs(df, 1.0).groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert made[-1] <= 2 * made[len(made) // 2] and whole > 0.9 * len(want)


def test_hulls_of_parts_are_the_hull(spark):
    """Partial hulls, in several rounds, against the hull of all points; a circle, where every point is a corner; lines, single and repeated points."""
    rng = np.random.default_rng(3)
    turn = np.linspace(0, 2 * np.pi, 300, endpoint=False)
    shapes = {1: rng.normal(size=(4000, 2)), 2: np.stack([np.cos(turn), np.sin(turn)], 1), 3: np.outer(np.arange(50.0), [1.0, 2.0]), 4: np.ones((3, 2)), 5: rng.integers(0, 4, (200, 2)).astype(float)}
    rows = [(c, float(x), float(y)) for c, pts in shapes.items() for x, y in pts]
    df = spark.createDataFrame([*rows, (1, float("nan"), 0.0), (1, float("inf"), 0.0), (6, None, 1.0)], "cid long, x double, y double").repartition(9)
    for most in (100_000, 40):
        got: dict = {}
        for r in layout.hulls(df, most).collect():
            got.setdefault(r.cid, set()).add((r.x, r.y))
        assert got == {c: set(map(tuple, layout.hull(pts).tolist())) for c, pts in shapes.items()}
    boxes = {r.cid: r for r in layout.tightest_boxes(df, 40).collect()}
    for c, pts in shapes.items():
        sweep = min(np.prod(np.ptp(layout.turned(pts, a), axis=0)) for a in np.linspace(0, np.pi / 2, 721))
        assert boxes[c].area <= sweep + 1e-9 and abs(np.prod(np.ptp(layout.turned(pts, boxes[c].angle), axis=0)) - boxes[c].area) < 1e-9
    assert boxes[5].area == 9.0 and abs(boxes[3].area) < 1e-9 and boxes[4].area == 0
    assert layout.hulls(df.limit(0)).count() == 0


def test_drags(spark):
    """All ways to drag, against the pieces put together by hand."""
    n = 12
    contigs = spark.createDataFrame([(k, 10.0 * k, 0.0, 10.0 * k + 6, 1.0) for k in range(n)], "ord long, in_x double, in_y double, out_x double, out_y double").cache()
    pairs = [(2 * k + 1, 2 * k + 2) for k in range(n - 1) if k != 7] + [(1, 5), (3, 3)]
    links = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "ord long, a long, b long").cache()
    log = spark.createDataFrame([(1, "move_port", 3, 0.5, 0.25), (2, "link_rest", 3, 2.5, None), (3, "select", 9, None, None), (4, "add", 11, None, None)], "seq long, kind string, key long, v0 double, v1 double")
    spot = {0: 0.0, 1: 3.0, 2: 6.0}
    made = [(1, 1, 2, True), (2, 4, 1, False), (3, 4, 0, False), (4, 4, 2, False), (5, 9, 0, False), (6, 0, 0, True)]
    gestures = spark.createDataFrame([(g, c, 10.0 * c + spot[z], spot[z] / 6, 1.5, -2.0, ctrl) for g, c, z, ctrl in made], "gesture long, contig long, px double, py double, dx double, dy double, ctrl boolean")
    at = {2 * k + s: (10.0 * k + 6 * s, float(s)) for k in range(n) for s in (0, 1)}
    p = relax.ForceParams(layers=2)
    edits, live = relax.drags(contigs, links, gestures, log, p)
    length = lambda a, b: np.hypot(at[a][0] + 1.5 - at[b][0], at[a][1] - 2 - at[b][1])
    want = {(1, "move_port", 3, 2.0, -1.75), (6, "move_port", 0, 1.5, -2.0), (1, "link_rest", 1, round(length(3, 4), 9), None), (1, "link_rest", len(pairs) - 1, 0.0, None)}
    assert {(r.gesture, r.kind, r.key, round(r.v0, 9), r.v1) for r in edits.collect()} == want
    near = {k: {x // 2 for q in pairs for x in q if k in (q[0] // 2, q[1] // 2)} - {k} for k in range(n)}

    def around(seeds):
        out = set(seeds)
        for _ in range(2):
            out |= set().union(*(near[k] for k in out))
        return out

    regions, pins = {}, {}
    for g, c, z, ctrl in made:
        if not ctrl:
            seeds = {9, 11} if c == 9 else {c}
            keys = [2 * c + z // 2] if c != 9 and z != 1 else [2 * s + e for s in seeds for e in (0, 1)]
            regions[g], pins[g] = around(seeds) - (set() if len(keys) == 1 else seeds), {k: (at[k][0] + 1.5, at[k][1] - 2) for k in keys}
    ports_ = spark.createDataFrame([(k, *v) for k, v in at.items()], "key long, x double, y double")
    area = spark.createDataFrame([(g, c) for g, cs in regions.items() for c in cs], "gesture long, contig long")
    held = spark.createDataFrame([(g, k, *v) for g, ks in pins.items() for k, v in ks.items()], "gesture long, key long, x double, y double")
    rests = spark.createDataFrame([(3, 2.5)], "link long, rest double")
    args = ports_, links, ports.junctions(links), area, held, ribbons.mean_chord(contigs).first()[0], p
    hand = {(r.gesture, r.key): (r.x, r.y) for r in relax.relax_local(*args, rests).collect()}
    got = {(r.gesture, r.key): (r.x, r.y) for r in live.collect()}
    assert {k: v for k, v in got.items() if k in hand} == hand
    assert {k: v for k, v in got.items() if k not in hand} == {(g, k): v for g in (2, 5) for k, v in pins[g].items()}
    assert got[3, 8] == pins[3][8] and got[4, 9] == pins[4][9] and got[3, 9] != at[9]
    free = {(r.gesture, r.key): (r.x, r.y) for r in relax.relax_local(*args).collect()}
    assert free != hand  # a length that was set pulls
    off, none = relax.drags(contigs, links, gestures, log, relax.ForceParams(enabled=False))
    assert {r.gesture for r in off.filter("kind = 'move_port'").collect()} == {1, 2, 3, 4, 5, 6} and {r.gesture for r in off.filter("kind = 'link_rest'").collect()} == {1} and none.count() == 0


def test_code_ranges_cover_their_cells():
    rng = np.random.default_rng(2)
    plain = lambda v: sum((int(v) >> k & 1) << 2 * k for k in range(16))
    for most in (1, 7, 64):
        for _ in range(30):
            (x0, x1), (y0, y1) = (sorted(rng.integers(0, 1 << 16, 2).tolist()) for _ in range(2))
            got = ribbons.code_ranges(x0, y0, x1, y1, most)
            assert len(got) <= most + 3 and all(a <= b for a, b in got) and all(a[1] < b[0] for a, b in zip(got, got[1:], strict=False))
            for _ in range(40):
                code = plain(rng.integers(x0, x1 + 1)) | plain(rng.integers(y0, y1 + 1)) << 1
                assert any(a <= code <= b for a, b in got)


def test_picks_by_code_read_little(spark):
    """Picks equal those of a full scan, and a small one reads a few of 32 files."""
    rng = np.random.default_rng(9)
    pts = [(k // 12, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-500, 1500, (24_000, 2)))]
    df = spark.createDataFrame([*pts, (9999, None, 1.0), (9998, float("nan"), 2.0)], "ord long, x double, y double")
    index = ribbons.PathIndex(df, 32)
    for _ in range(4):
        x, y = rng.uniform(-600, 1600, 2).tolist()
        w, h = rng.uniform(0, 300, 2).tolist()
        want = {o for o, a, b in pts if x <= a <= x + w and y - h <= b <= y}
        assert {r.ord for r in index.pick_box(x + w, y - h, x, y).collect()} == want
        assert [r.ord for r in index.pick_point(x, y, w).collect()] == [r.ord for r in ribbons.pick_point(df, x, y, w).collect()]
    assert index.pick_box(-9e9, -9e9, 9e9, 9e9).count() == 2000 and index.pick_box(2000, 0, 3000, 9).count() == 0 and index.pick_point(1e9, 0, 5).count() == 0
    files = {r.f: r.n for r in index.points.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        small = index.near(100, 100, 130, 130)
        small.collect()
        scan = small._jdf.queryExecution().executedPlan().collectLeaves().head()
        read = scan.metrics().apply("numOutputRows").value()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(files) == 32 and 0 < read <= 4 * max(files.values()) < 24_000 / 4
    assert ribbons.PathIndex(df.limit(0)).pick_point(0, 0, 1).count() == 0


def test_styles(spark):
    """Hovered wins over selected in colour, both are wider; the rest stays as it is."""
    rows = spark.createDataFrame([(k, 2.0, 1, 2, 3, 255) for k in range(4)], "ord long, width double, r short, g short, b short, a short")
    got = {r.ord: tuple(r)[1:] for r in ribbons.styled(rows, F.col("ord") == 1, F.col("ord").isin(1, 2)).collect()}
    assert got == {0: (2.0, 1, 2, 3, 255), 3: (2.0, 1, 2, 3, 255), 1: (3.2, 255, 240, 150, 255), 2: (3.2, 255, 80, 80, 255)}
