"""Polygon measures against sampling, known shapes and plain loops."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from freshet.operators import polygons, spatial

KIND = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
L = [(0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (0, 6)]
U = [(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6)]


def shapes(*parts):
    return polygons.edges_of(pa.array([[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in p] if p is not None else None for p in parts], KIND))


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def star(rng, n, x, y, size):
    """A simple ring, concave as a rule."""
    angle = (np.arange(n) + rng.uniform(0, 0.45, n)) * 2 * np.pi / n
    r = rng.uniform(0.2, 1.0, n) * size
    return list(zip(x + r * np.cos(angle), y + r * np.sin(angle)))


def inside(parts, px, py):
    """Even-odd rule for many points, by a plain loop over edges."""
    odd = np.zeros(len(px), dtype=bool)
    for ring in parts:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if ay != by:
                over = (ay > py) != (by > py)
                odd ^= over & (px < ax + (bx - ax) * (py - ay) / (by - ay))
    return odd


def segment_distance(p, q, r, s):
    def turn(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    if turn(p, q, r) * turn(p, q, s) < 0 and turn(r, s, p) * turn(r, s, q) < 0:
        return 0.0

    def to(a, b, c):
        long = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
        t = 0 if long == 0 else min(1, max(0, ((c[0] - a[0]) * (b[0] - a[0]) + (c[1] - a[1]) * (b[1] - a[1])) / long))
        return math.hypot(c[0] - a[0] - t * (b[0] - a[0]), c[1] - a[1] - t * (b[1] - a[1]))

    return min(to(p, q, r), to(p, q, s), to(r, s, p), to(r, s, q))


def plain_distance(a, b):
    (ax, ay), (bx, by) = a[0][0], b[0][0]
    if inside(a, np.array([bx]), np.array([by]))[0] or inside(b, np.array([ax]), np.array([ay]))[0]:
        return 0.0
    edges = [[(p, q) for ring in parts for p, q in zip(ring, ring[1:] + ring[:1])] for parts in (a, b)]
    return min(segment_distance(*e, *f) for e in edges[0] for f in edges[1])


def test_areas_of_known_shapes():
    pairs = [
        ([L], [box(1, 1, 7, 7)], 5 + 5 - 1 - 0 + 0),  # the L without its corner square, cut at 1
        ([L], [box(2, 2, 6, 6)], 0),
        ([U], [box(0, 3, 6, 5)], 8),
        ([U], [L], 20),
        ([box(0, 0, 6, 6), box(1, 1, 5, 5)], [box(0, 0, 6, 6)], 20),
        ([box(0, 0, 6, 6), box(1, 1, 5, 5)], [box(2, 2, 4, 4)], 0),
        ([box(0, 0, 6, 6), box(1, 1, 5, 5)[::-1]], [box(3, 3, 9, 9)], 9 - 4),
        ([L[::-1]], [L], 20),
        ([box(1e7, 1e7, 1e7 + 2, 1e7 + 2)], [box(1e7 + 1, 1e7 - 1, 1e7 + 5, 1e7 + 1)], 1),
        (None, [L], 0),
        ([[]], [L], 0),
    ]
    got = polygons.areas(shapes(*[p for p, _, _ in pairs]), shapes(*[q for _, q, _ in pairs]))
    assert got == pytest.approx([w for _, _, w in pairs], abs=1e-6)


def test_measures_of_random_shapes():
    rng = np.random.default_rng(5)
    a, b = [], []
    for _ in range(60):
        x, y = rng.uniform(0, 3, 2)
        outer = star(rng, rng.integers(3, 12), x, y, 1.5)
        a.append([outer])
        x, y = rng.uniform(0, 3, 2)
        b.append([box(x, y, x + 2, y + 2), [(x + 0.5 + 0.9 * u, y + 0.5 + 0.9 * v) for u, v in star(rng, 5, 0.5, 0.5, 0.45)]])
    e, f = shapes(*a), shapes(*b)
    px, py = rng.uniform(-2, 6, 200_000), rng.uniform(-2, 6, 200_000)
    want = [64 * (inside(p, px, py) & inside(q, px, py)).mean() for p, q in zip(a, b)]
    assert polygons.areas(e, f) == pytest.approx(want, abs=0.05)
    plain = [plain_distance(p, q) for p, q in zip(a, b)]
    assert polygons.distances(e, f) == pytest.approx(plain, abs=1e-9)
    assert polygons.touching(e, f).tolist() == [d == 0 for d in plain]
    # Blocks of any size give the same.
    polygons.BLOCK, kept = 50, polygons.BLOCK
    try:
        assert polygons.distances(e, f) == pytest.approx(plain, abs=1e-9)
    finally:
        polygons.BLOCK = kept


def test_a_shape_in_a_hole_is_apart():
    ring = [box(0, 0, 10, 10), box(2, 2, 8, 8)]
    e, f = shapes(ring, ring, ring, [L]), shapes([box(4, 4, 5, 5)], [box(1, 4, 3, 5)], [box(-3, 1, -1, 2)], None)
    assert polygons.distances(e, f).tolist() == [2.0, 0.0, 1.0, math.inf]
    assert polygons.touching(e, f).tolist() == [False, True, False, False]


def table(spark, shapes_, key):
    rows = [(i, [{"x": float(x), "y": float(y)} for x, y in p[0]], [[{"x": float(x), "y": float(y)} for x, y in h] for h in p[1:]] or None) for i, p in shapes_.items()]
    point = "array<struct<x double, y double>>"
    return spatial.with_box(spark.createDataFrame(rows, f"{key} int, ring {point}, holes array<{point}>"))


def test_nearest_rings(spark):
    rng = np.random.default_rng(8)
    lefts = {i: [star(rng, 6, *rng.uniform(0, 30, 2), 0.7)] for i in range(120)} | {900: [star(rng, 5, 900, -400, 3)], 901: [box(4.5, 4.5, 5, 5)]}
    rights = {i: [[(x + 8 * i % 31, y + 5 * i % 27) for x, y in (L if i % 2 else U)]] for i in range(25)} | {70: [box(1, 1, 9, 9), box(2, 2, 8, 8)], 71: [box(1, 1, 9, 9), box(2, 2, 8, 8)]}
    got = {r["cell_id"]: (r["near_id"], r["dist"]) for r in spatial.nearest(table(spark, lefts, "cell_id"), table(spark, rights, "near_id")).collect()}
    assert len(got) == len(lefts)
    for i, p in lefts.items():
        d = {j: plain_distance(p, q) for j, q in rights.items()}
        assert got[i][1] == pytest.approx(min(d.values()), abs=1e-9)
        assert got[i][0] == min(j for j in d if d[j] <= min(d.values()) + 1e-9)


def test_candidates_stay_few_far_away_and_in_crowds(spark):
    rng = np.random.default_rng(9)
    n = 4000
    spots = np.r_[rng.uniform(0, 100, (n, 2)), rng.uniform(50, 50.01, (n, 2))]
    right = pd.DataFrame({"near_id": np.arange(2 * n, dtype="int32"), "x0": spots[:, 0], "y0": spots[:, 1], "x1": spots[:, 0] + 0.01, "y1": spots[:, 1] + 0.01})
    at = np.r_[rng.uniform(0, 100, (300, 2)), rng.uniform(-1e4, 1e4, (300, 2))]
    left = pd.DataFrame({"cell_id": np.arange(600, dtype="int32"), "x0": at[:, 0], "y0": at[:, 1], "x1": at[:, 0], "y1": at[:, 1]})
    a, b = spark.createDataFrame(left), spark.createDataFrame(right)
    counts = [r["count"] for r in spatial.nearest_candidates(a, b).groupBy("cell_id").count().collect()]
    assert len(counts) == 600 and sum(counts) / 600 < 200 and max(counts) < 2000
    plan = spatial.nearest_candidates(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_overlap_of_concave_cells(spark):
    cells = {1: [L], 2: [[(x + 2, y + 2) for x, y in L]], 3: [box(0, 0, 6, 6), box(1, 1, 5, 5)]}
    low = {10: [box(0, 0, 3, 3)], 11: [box(3, 0, 9, 3)], 12: [box(2, 3, 9, 9)]}
    got = {(r["cell_id"], r["lf_cell_id"]): r["area"] for r in spatial.overlap_areas(table(spark, cells, "cell_id"), table(spark, low, "lf_cell_id")).collect()}
    want = {(1, 10): 8, (1, 11): 6, (2, 10): 1, (2, 11): 5, (2, 12): 5 + 9, (3, 10): 5, (3, 11): 3 + 2, (3, 12): 3 + 3 - 1 + 3 - 2 + 1}
    want[3, 12] = 4 * 3 - 3 * 2
    assert {k: pytest.approx(v) for k, v in want.items()} == got


def test_area_of_interest_cuts_rings(spark):
    cells = {1: [U], 2: [[(x + 20, y) for x, y in U]], 3: [box(2.2, 3, 3.8, 5)], 4: [box(0, 0, 30, 30), box(1, 1, 29, 29)]}
    got = {r["cell_id"] for r in spatial.within_aoi(table(spark, cells, "cell_id"), box(2.1, 2.5, 3.9, 5.5)).collect()}
    assert got == {3}


def plain_pixels(parts, spec, fine=40):
    """Pixels with a sampled point inside: a lower bound of the right set."""
    step = spec["cell"] / fine
    xs = spec["left"] + step * (np.arange(spec["ncols"] * fine) + 0.5)
    ys = spec["top"] - step * (np.arange(spec["nrows"] * fine) + 0.5)
    px, py = np.meshgrid(xs, ys)
    hit = inside(parts, px.ravel(), py.ravel()).reshape(spec["nrows"], fine, spec["ncols"], fine).any(axis=(1, 3))
    return {(int(r), int(c)) for r, c in zip(*np.nonzero(hit))}


def test_scan_lines(spark):
    spec = {"left": -1.0, "top": 7.0, "cell": 0.5, "nrows": 16, "ncols": 15}
    rng = np.random.default_rng(3)
    for parts in ([L], [U[::-1]], [box(0, 0, 6, 6), box(1, 1, 5, 5)], [box(0.1, 0.2, 0.3, 0.4)], [star(rng, 9, 3, 3, 4)], [box(-9, -9, 99, 99)], [box(2.5, 0, 2.6, 9)]):
        got = {(r["row"], r["col"]) for r in spatial.rasterize(table(spark, {1: parts}, "cell_id"), spec).collect()}
        least = plain_pixels(parts, spec)
        assert got >= least
        # What sampling misses are slivers at the border: their pixels have an edge inside.
        cell = spec["cell"]
        for r, c in got - least:
            x, y = spec["left"] + c * cell, spec["top"] - (r + 1) * cell
            assert polygons.areas(shapes([box(x, y, x + cell, y + cell)]), shapes(parts))[0] > 0


def test_one_large_shape_is_spread_by_rows(spark):
    ring = [(0.0, 0.0), (1000.0, 0.0), (1000.0, 1000.0), (0.0, 1000.0)]
    df = table(spark, {1: [ring]}, "cell_id")
    spec = {"left": 0.0, "top": 1000.0, "cell": 1.0, "nrows": 1000, "ncols": 1000}
    pixels = spatial.rasterize(df, spec)
    assert pixels.count() == 1_000_000
    plan = pixels._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_shape" in plan and "row" in plan and "Python" not in plan and "Arrow" not in plan


def test_cells_along_a_line(spark):
    rng = np.random.default_rng(4)
    cells = {i * 20 + j: [box(i, j, i + 1, j + 1)] for i in range(20) for j in range(20)} | {900: [[(x + 0.5, y + 30) for x, y in L]], 901: [[(x + 8.2, y + 33) for x, y in box(0, 0, 1, 1)]]}
    points = [tuple(p) for p in rng.uniform(0.01, 19.99, (9, 2))] + [(5.0, 5.0), (5.0, 9.0), (2.9, 40.0), (2.9, 31.0), (2.9, 31.0)]
    line = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "ord int, x double, y double")
    mesh = table(spark, cells, "cell_id")
    got = {r["cell_id"] for r in spatial.line_cells(mesh, line).collect()}
    want = {i for i, p in cells.items() if any(plain_distance(p, [[s, t]]) < 1e-12 for s, t in zip(points, points[1:]))}
    assert got == want and 900 in got and 901 not in got
    far = spark.createDataFrame([(0, -1e6, 0.5), (1, 1e6, 0.5)], "ord int, x double, y double")
    assert {r["cell_id"] for r in spatial.line_cells(mesh, far).collect()} == {i * 20 for i in range(20)}
    assert spatial.line_cells(mesh.drop("ring", "holes"), far).columns == ["cell_id", *spatial.BOX]
