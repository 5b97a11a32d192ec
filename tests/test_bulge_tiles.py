"""Bulges in tiles with halos against the kernel on all rows at once."""

import numpy as np
import pandas as pd
import pytest

from contiguum.operators import ribbons as rb

SCHEMA = "ord long, in_x double, in_y double, out_x double, out_y double"


def crowd(n: int, side: float, seed: int) -> pd.DataFrame:
    """Ribbons in a square, most of them short, a few long, some of them twice at one place."""
    rng = np.random.default_rng(seed)
    mid, turn = rng.uniform(0, side, (n, 2)), rng.normal(0, 0.7, n)
    size = rng.uniform(0.7, 1.3, n) * np.where(rng.random(n) < 0.002, 6, 1)
    half = size[:, None] / 2 * np.column_stack([np.cos(turn), np.sin(turn)])
    mid[1::50], half[1::50] = mid[0::50][: len(mid[1::50])], half[0::50][: len(mid[1::50])]
    at = np.column_stack([mid - half, mid + half])
    return pd.DataFrame({"ord": np.arange(n) * 3 + 5, "in_x": at[:, 0], "in_y": at[:, 1], "out_x": at[:, 2], "out_y": at[:, 3]})


def brute(frame: pd.DataFrame, moves: np.ndarray, start: np.ndarray, p: rb.BulgeParams) -> np.ndarray:
    """Each round from its definition: for every row that moves, the sum over all rows near it."""
    a, b = frame[["in_x", "in_y"]].to_numpy(), frame[["out_x", "out_y"]].to_numpy()
    mid, way = (a + b) * 0.5, b - a
    size = np.hypot(*way.T)
    radius = size.mean() * p.radius
    perp, tangent = np.column_stack([-way[:, 1], way[:, 0]]) / size[:, None], way / size[:, None]
    off = start.copy()
    for _ in range(p.iterations):
        at, new = mid + off[:, None] * perp, off.copy()
        for k in np.flatnonzero(moves):
            v = at[k] - at
            d2 = (v * v).sum(1)
            align = np.abs(perp @ perp[k])
            near = (d2 < radius * radius) & (align >= 0.2) & (np.abs(v @ tangent[k]) <= p.overlap * size[k])
            near[k] = False
            d = np.sqrt(np.maximum(d2, 1e-30))
            force = np.where(d2 < 1e-9, np.where(k > np.arange(len(mid)), 1.0, -1.0), (1 - d / radius) * (v @ perp[k]) / d)
            new[k] = off[k] + p.damping * (p.strength * radius * align * force)[near].sum()
        off = np.where(moves, np.clip(new, -p.cap * size, p.cap * size), off)
    return off


@pytest.mark.parametrize("hops", [1, 3])
def test_small_tiles_equal_the_definition(spark, hops):
    frame = crowd(300, 8.0, 1)
    p = rb.BulgeParams(iterations=7)
    want = brute(frame, np.ones(300, bool), np.zeros(300), p)
    got = rb.bulge_offsets(spark.createDataFrame(frame, SCHEMA), p, most=40, hops=hops).orderBy("ord").toPandas()
    assert got["ord"].tolist() == frame["ord"].tolist() and np.abs(want).max() > 0.01
    np.testing.assert_allclose(got["offset"], want, rtol=0, atol=1e-9)


def test_ten_thousand_crowded_ribbons(spark):
    """One percolating cluster: tiles give the numbers of one task, to the last bit."""
    ribbons = spark.createDataFrame(crowd(10_000, 45.0, 2), SCHEMA)
    one = rb.bulge_offsets(ribbons).orderBy("ord").toPandas()
    tiles = rb.bulge_offsets(ribbons, most=1500).orderBy("ord").toPandas()
    assert one["ord"].tolist() == tiles["ord"].tolist() and (one["offset"] != 0).mean() > 0.5
    assert np.array_equal(one["offset"], tiles["offset"])


def test_local_bulge_in_tiles(spark):
    """Two gestures and a still background with offsets of its own, by definition, whole and in tiles."""
    frame = crowd(300, 8.0, 3)
    p = rb.BulgeParams(iterations=6)
    x = frame["in_x"].to_numpy()
    moves = (x < 3.0) | (x > 6.5)
    still = np.where(np.arange(300) % 2, 0.05, 0.0)
    want = brute(frame, moves, np.where(moves, 0.0, still), p)
    ribbons = spark.createDataFrame(frame, SCHEMA)
    active = spark.createDataFrame(frame[["ord"]][moves], "ord long")
    offsets = spark.createDataFrame(pd.DataFrame({"ord": frame["ord"], "offset": still}), "ord long, offset double")
    for most in (20_000, 25):
        got = rb.local_bulge(ribbons, active, offsets, p, most=most, hops=2).orderBy("ord").toPandas()
        assert got["ord"].tolist() == frame["ord"][moves].tolist()
        np.testing.assert_allclose(got["offset"], want[moves], rtol=0, atol=1e-9)


def test_no_rows_and_no_neighbours(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert rb.bulge_offsets(none).count() == 0
    far = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0), (2, 90.0, 0.0, 91.0, 0.0)], SCHEMA)
    assert [tuple(r) for r in rb.bulge_offsets(far, most=1).orderBy("ord").collect()] == [(1, 0.0), (2, 0.0)]
    part = rb.local_bulge(far, far.select("ord"), spark.createDataFrame([], "ord long, offset double"), most=1)
    assert sorted(tuple(r) for r in part.collect()) == [(1, 0.0), (2, 0.0)]
