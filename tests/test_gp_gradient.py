"""Gradients against finite differences, gradient searches, and fits beyond the range of random starts."""

import math

import numpy as np
import pytest

from freshet.operators import gp


def rows_of(spark, x, y):
    return spark.createDataFrame([("a", i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "run string, t int, x array<double>, y array<double>").repartition(3)


@pytest.mark.parametrize("kernel", ["RBF", "Matern12", "Matern32", "Matern52", "Exponential"])
def test_gradient_is_the_slope_of_the_loss(spark, kernel):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 2))
    y = np.stack([np.sin(x[:, 0]), x[:, 1] ** 2], axis=1)
    rows = rows_of(spark, x, y)
    points = {m: gp.Point(rng.normal(size=3) * 0.3, rng.normal(size=(4, 2))) for m in (0, 1)}
    got = gp.losses_and_gradients(rows, kernel, points)

    def loss(m, logs, z):
        v, ls, e = np.exp(logs)
        k = gp.correlation(kernel, z, x, ls)
        s = gp.Sums(k @ k.T, k @ y[:, m], float(y[:, m] @ y[:, m]), len(x))
        return gp.loss_of(gp.correlation(kernel, z, z, ls), s, v, ls, e)

    for m, p in points.items():
        assert got[m][0] == pytest.approx(loss(m, p.logs, p.z))
        for i in range(3):
            d = np.eye(3)[i] * 1e-5
            assert got[m][1][i] == pytest.approx((loss(m, p.logs + d, p.z) - loss(m, p.logs - d, p.z)) / 2e-5, rel=1e-3, abs=1e-3)
        for i, j in np.ndindex(p.z.shape):
            d = np.zeros(p.z.shape)
            d[i, j] = 1e-5
            assert got[m][2][i, j] == pytest.approx((loss(m, p.logs, p.z + d) - loss(m, p.logs, p.z - d)) / 2e-5, rel=1e-3, abs=1e-3)


def test_gradient_searches_lower_the_loss_and_move_inducing_points(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2))
    rows = rows_of(spark, x, np.stack([np.sin(2 * x[:, 0])], axis=1)).cache()
    z = gp.inducing_points(rows, 5)
    start = gp.losses_and_gradients(rows, "RBF", {0: gp.Point(np.zeros(3), z)})[0][0]
    for search, stages in ((gp.search_gradient, {"stages": ("z", "logs")}), (gp.search_adam, {}), (gp.search_adadelta, {"rate": 1.0})):
        options = {"rate": 0.1, **stages}
        found = search(rows, "RBF", z, 1.0, max_iter=6, **options)[0]
        assert found.loss < start and not np.allclose(found.z, z)


def test_bfgs_reaches_a_flat_point_below_adam(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 2))
    rows = rows_of(spark, x, np.stack([np.sin(2 * x[:, 0]), x[:, 0] * x[:, 1]], axis=1)).cache()
    z = gp.inducing_points(rows, 6)
    adam = gp.search_adam(rows, "RBF", z, 1.0, max_iter=12, rate=0.1)
    found = gp.search_lbfgs(rows, "RBF", z, 1.0, max_iter=12)
    three = gp.search_three_stage(rows, "RBF", z, 1.0, max_iter=5, rate=0.1)
    for m in (0, 1):
        assert found[m].loss < adam[m].loss and not np.allclose(found[m].z, z)
        assert three[m].loss < adam[m].loss
    # On a smooth function of its own the state machine finds the minimum.
    d = gp.Descent(np.array([-1.0, 1.5]), 0.0, np.zeros(2), [], [])
    grad = lambda v: np.array([2 * (v[0] - 3) + v[1], 8 * v[1] + v[0]])
    d.slope = grad(d.x)
    for _ in range(30):
        step = d.direction() if d.steps else -0.05 * d.slope
        new = d.x + step
        d.steps, d.changes = [*d.steps, step][-10:], [*d.changes, grad(new) - d.slope][-10:]
        d.x, d.slope = new, grad(new)
        if np.abs(d.slope).max() < 1e-9:
            break
    np.testing.assert_allclose(d.x, np.linalg.solve([[2, 1], [1, 8]], [6, 0]), atol=1e-6)


def test_bfgs_on_parameters_alone_is_the_best_of_a_grid(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 2))
    y = np.sin(x[:, :1]) + 0.1 * rng.normal(size=(60, 1))
    rows = rows_of(spark, x, y).cache()
    z = gp.inducing_points(rows, 5)
    loss, p = gp._bfgs(rows, "Matern32", {0: gp.Point(np.zeros(3), z)}, 25, False, True)[0]
    np.testing.assert_array_equal(p.z, z)
    for ls in np.exp(p.logs[1]) * np.array([0.7, 0.9, 1.0, 1.1, 1.4]):
        k = gp.correlation("Matern32", z, x, ls)
        s = gp.Sums(k @ k.T, k @ y[:, 0], float(y[:, 0] @ y[:, 0]), len(x))
        for v in np.exp(p.logs[0]) * np.array([0.8, 1.0, 1.25]):
            for e in np.exp(p.logs[2]) * np.array([0.8, 1.0, 1.25]):
                assert loss <= gp.loss_of(gp.correlation("Matern32", z, z, ls), s, v, ls, e) + 1e-6


def test_points_that_meet_end_no_search(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(30, 2))
    rows = rows_of(spark, x, x[:, :1]).cache()
    z = np.repeat(x[:1], 4, axis=0)
    found = gp.search_lbfgs(rows, "RBF", z, 1.0, max_iter=3)[0]
    assert math.isfinite(found.loss)


def test_fit_is_not_held_in_the_range_of_random_starts(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 6)) * 4
    smooth = x @ rng.normal(size=6)
    rows = rows_of(spark, x, smooth[:, None]).cache()
    model = gp.fit_gpr(rows, "RBF", 12, points=5, refine=1).first()
    assert model["lengthscale"] > 10 and model["variance"] > 10
    z = np.array(model["z"])
    k_of = lambda ls: gp.correlation("RBF", z, x, ls)
    for ls in np.logspace(-1, 3, 9):
        k = k_of(ls)
        s = gp.Sums(k @ k.T, k @ smooth, float(smooth @ smooth), len(x))
        for v in np.logspace(-1, 4, 6):
            for e in np.logspace(-5, 2, 8):
                assert model["loss"] <= gp.loss_of(gp.correlation("RBF", z, z, ls), s, v, ls, e) + 0.5
    assert math.isfinite(model["loss"])
