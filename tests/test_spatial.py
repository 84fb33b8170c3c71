import numpy as np
import pandas as pd
import pytest

from freshet.operators import spatial


def boxes(rng, n, size, key):
    xy = rng.uniform(0, 40, size=(n, 2))
    wh = size * rng.lognormal(sigma=1.0, size=(n, 2))
    return pd.DataFrame({key: np.arange(n, dtype="int32"), "x0": xy[:, 0], "y0": xy[:, 1], "x1": xy[:, 0] + wh[:, 0], "y1": xy[:, 1] + wh[:, 1]})


@pytest.fixture(scope="module")
def meshes(spark):
    rng = np.random.default_rng(14)
    # Very different sizes, and a third of the fine boxes in one corner.
    fine, coarse = boxes(rng, 300, 0.4, "cell_id"), boxes(rng, 60, 4.0, "lf_cell_id")
    fine.loc[:100, ["x0", "y0"]] = rng.uniform(1, 1.5, size=(101, 2))
    fine["x1"], fine["y1"] = np.maximum(fine["x1"], fine["x0"] + 0.1), np.maximum(fine["y1"], fine["y0"] + 0.1)
    return fine, coarse, spark.createDataFrame(fine), spark.createDataFrame(coarse)


def brute(a, b):
    w = np.minimum(a["x1"].values[:, None], b["x1"].values) - np.maximum(a["x0"].values[:, None], b["x0"].values)
    h = np.minimum(a["y1"].values[:, None], b["y1"].values) - np.maximum(a["y0"].values[:, None], b["y0"].values)
    return w, h


def test_box_pairs_are_complete_and_unique(meshes):
    fine, coarse, a, b = meshes
    w, h = brute(fine, coarse)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero((w >= 0) & (h >= 0)))}
    got = [(r["i"], r["j"]) for r in spatial.box_pairs(a, b).selectExpr("l.cell_id i", "r.lf_cell_id j").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_largest_overlap_and_missing_cells(meshes):
    fine, coarse, a, b = meshes
    w, h = brute(fine, coarse)
    area = np.where((w > 0) & (h > 0), w * h, 0)
    got = {r["cell_id"]: r["lf_cell_id"] for r in spatial.largest_overlap(a, b, require_all=False).collect()}
    assert got == {i: int(area[i].argmax()) for i in range(len(fine)) if area[i].max() > 0}
    if len(got) < len(fine):
        with pytest.raises(Exception, match="no low-fidelity cell"):
            spatial.largest_overlap(a, b).collect()


def test_nearest_is_exact_even_far_away(spark, meshes):
    fine, _, a, _ = meshes
    near = pd.DataFrame({"near_id": np.array([7, 3], "int32"), "x0": [0.0, 300.0], "y0": [0.0, 300.0], "x1": [0.5, 301.0], "y1": [0.5, 301.0]})
    got = {r["cell_id"]: (r["near_id"], r["dist"]) for r in spatial.nearest(a, spark.createDataFrame(near)).collect()}
    gx = np.maximum(0, np.maximum(fine["x0"].values[:, None] - near["x1"].values, near["x0"].values - fine["x1"].values[:, None]))
    gy = np.maximum(0, np.maximum(fine["y0"].values[:, None] - near["y1"].values, near["y0"].values - fine["y1"].values[:, None]))
    d = np.hypot(gx, gy)
    assert len(got) == len(fine)
    for i in range(len(fine)):
        assert got[i][0] == near["near_id"][d[i].argmin()] and got[i][1] == pytest.approx(d[i].min())


def test_overlap_of_convex_rings():
    square = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float)
    diamond = np.array([(1, -1), (3, 1), (1, 3), (-1, 1)], float)
    assert spatial.clip_area(square, diamond) == pytest.approx(4.0)
    assert spatial.clip_area(square, square[::-1] + 1) == pytest.approx(1.0)
    assert spatial.clip_area(square, square + 5) == 0
    rng = np.random.default_rng(15)
    angles = np.sort(rng.uniform(0, 2 * np.pi, 7))
    ring = np.c_[np.cos(angles), np.sin(angles)] * 1.3 + 1
    points = rng.uniform(0, 2, size=(200_000, 2))
    edge = np.roll(ring, -1, 0) - ring
    inside = np.all(edge[:, 0] * (points[:, None, 1] - ring[:, 1]) - edge[:, 1] * (points[:, None, 0] - ring[:, 0]) >= 0, axis=1)
    assert spatial.clip_area(square, ring) == pytest.approx(4 * inside.mean(), abs=0.02)


def test_area_of_interest_may_be_concave(spark):
    grid = pd.DataFrame([(i * 10 + j, float(i), float(j), i + 1.0, j + 1.0) for i in range(10) for j in range(10)], columns=["cell_id", "x0", "y0", "x1", "y1"])
    ell = [(0.5, 0.5), (8.5, 0.5), (8.5, 2.5), (2.5, 2.5), (2.5, 8.5), (0.5, 8.5)]
    got = {r["cell_id"] for r in spatial.within_aoi(spark.createDataFrame(grid), ell).collect()}
    want = {i * 10 + j for i in range(10) for j in range(10) if (i <= 8 and j <= 2) or (i <= 2 and j <= 8)}
    assert got == want


def test_rasterize_takes_every_pixel_a_ring_reaches(spark):
    ring = [(1.0, 1.0), (5.0, 3.0), (1.0, 5.0)]
    df = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in ring])], "cell_id int, ring array<struct<x double, y double>>")
    spec = {"left": 0.0, "top": 6.0, "cell": 1.0, "nrows": 6, "ncols": 6}
    got = {(r["row"], r["col"]) for r in spatial.rasterize(spatial.with_box(df), spec).collect()}
    rng = np.random.default_rng(16)
    weights = rng.dirichlet(np.ones(3), size=100_000)
    hits = weights @ np.array(ring)
    assert got >= {(int(6 - y), int(x)) for x, y in hits} and len(got) <= 14


def test_stations_follow_the_line(spark):
    mesh = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (2, 2.0, 0.0, 4.0, 2.0), (3, 8.0, 8.0, 9.0, 9.0)], "cell_id int, x0 double, y0 double, x1 double, y1 double")
    line = spark.createDataFrame([(0, -1.0, 1.0), (1, 3.0, 1.0), (2, 3.0, 5.0)], "ord int, x double, y double")
    got = {r["cell_id"]: r["station"] for r in spatial.cell_stations(mesh, line).collect()}
    assert got == {1: pytest.approx((1 + 3) / 2), 2: pytest.approx((3 + 5) / 2)}


def test_interpolation_reproduces_a_plane(spark):
    tri = spark.createDataFrame(
        [(0, 1, 0.0, 0.0, 2, 4.0, 0.0, 3, 0.0, 4.0), (1, 2, 4.0, 0.0, 4, 4.0, 4.0, 3, 0.0, 4.0)],
        "tri_id int, a_id int, ax double, ay double, b_id int, bx double, by double, c_id int, cx double, cy double",
    )
    points = spark.createDataFrame([(10, 1.0, 1.0, 0.0), (11, 3.0, 3.5, 0.0), (12, 2.0, 2.0, 90.0), (13, 9.0, 9.0, 5.0)], "cell_id int, x double, y double, elevation double")
    corners = {1: (0, 0), 2: (4, 0), 3: (0, 4), 4: (4, 4)}
    lf = spark.createDataFrame([("r", t, i, 10.0 + x + 2 * y + t) for t in range(2) for i, (x, y) in corners.items()], "run string, t int, cell_id int, value double")
    out = spatial.interpolate_surface(lf, spatial.triangle_weights(tri, points), points.select("cell_id", "elevation"))
    got = {(r["t"], r["cell_id"]): r["value"] for r in out.collect()}
    assert len(got) == 8
    for t in range(2):
        assert got[t, 10] == pytest.approx(13 + t) and got[t, 11] == pytest.approx(20 + t)
        assert got[t, 12] == 90.0 and got[t, 13] == 5.0


def test_tree_of_boxes_along_a_line_has_few_rows_in_a_leaf(spark):
    """Leaves as deep as a filled square needs hold ever more boxes of a long line."""
    line = "SELECT id AS near_id, 25.0D AS x0, CAST(id AS DOUBLE) AS y0, 26.0D AS x1, id + 1.0D AS y1 FROM range({n})"
    cells = "SELECT id AS cell_id, CAST(id % 50 AS DOUBLE) AS x0, CAST(id DIV 50 AS DOUBLE) AS y0, id % 50 + 1.0D AS x1, id DIV 50 + 1.0D AS y1 FROM range(0, {n} * 50, {n})"
    seen = []
    for n in (400, 4000):
        left, right = spark.sql(cells.format(n=n)), spark.sql(line.format(n=n))
        seen.append(spatial.nearest_candidates(left, right).count() / left.count())
        assert spatial.nearest(left, right).where("near_id <> greatest(cell_id DIV 50 - 1, 0)").isEmpty()
    bins = spark.sql("SELECT 0L AS _bx, id * 64 AS _by FROM range(4000)")
    assert seen[1] < 2 * seen[0] + 8 and spatial._depth(bins) > 2
