import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.functions.exprs import KERNELS, kernel
from freshet.operators import gp


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(60, 2))
    y = np.c_[np.sin(2 * x[:, 0]) + 0.05 * rng.normal(size=60), x[:, 0] * x[:, 1]]
    rows = spark.createDataFrame([("a", i, x[i].tolist(), y[i].tolist()) for i in range(60)], "run string, t int, x array<double>, y array<double>")
    return x, y, rows.repartition(5)


def dense_loss(x, y, z, name, var, ls, noise):
    """Collapsed bound written with full matrices."""
    n = len(x)
    kuu = var * gp.correlation(name, z, z, ls) + gp.JITTER * np.eye(len(z))
    kuf = var * gp.correlation(name, z, x, ls)
    q = kuf.T @ np.linalg.solve(kuu, kuf)
    cov = q + noise * np.eye(n)
    fit = -0.5 * (n * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + y @ np.linalg.solve(cov, y))
    trace = -0.5 / noise * (n * var - np.trace(q))
    prior = sum(-math.log(v) - 0.5 * math.log(2 * math.pi) - 0.5 * math.log(v) ** 2 for v in (var, ls, noise))
    return -(fit + trace + prior)


@pytest.mark.parametrize("name", KERNELS)
def test_gram_form_equals_dense_form(data, name):
    x, y, rows = data
    z = x[:9]
    cand = gp.Candidate(0, 0.8, z, None, math.log10(1.3), math.log10(0.05))
    scores = gp.score_pass(gp.gram_pass(rows, name, [cand]), name, [cand], tune=False).orderBy("mode").collect()
    for r in scores:
        assert r["loss"] == pytest.approx(dense_loss(x, y[:, r["mode"]], z, name, 1.3, 0.8, 0.05), rel=1e-7)


def test_sql_kernels_equal_array_kernels(spark):
    d2 = np.linspace(0, 4, 9)
    df = spark.createDataFrame([(float(v),) for v in d2], "d2 double")
    for name in KERNELS:
        got = [r[0] for r in df.select(kernel(name, 2.0, 0.7)("d2")).collect()]
        a = np.sqrt(d2)[:, None]
        np.testing.assert_allclose(got, 2 * gp.correlation(name, a, np.zeros((1, 1)), 0.7)[:, 0], atol=1e-12)


def test_all_points_inducing_is_the_exact_process(data):
    x, y, rows = data
    var, ls, noise = 1.1, 0.9, 0.02
    chosen = {m: gp.Choice(m, math.log10(var), math.log10(ls), math.log10(noise), 0.0, x) for m in range(2)}
    model = gp.solve_choices(rows, "RBF", chosen)
    got = gp.predict_gpr(rows, model).collect()
    k = var * gp.correlation("RBF", x, x, ls)
    inv = np.linalg.inv(k + noise * np.eye(60))
    for r in got:
        i, m = r["t"], r["mode"]
        assert r["mean"] == pytest.approx(float(k[i] @ inv @ y[:, m]), abs=1e-4)
        assert r["var"] == pytest.approx(float(var - k[i] @ inv @ k[i] + noise), abs=1e-4)


@pytest.mark.parametrize("search,options", [("profile", {"points": 5}), ("random", {"n_starts": 12}), ("evolution", {"popsize": 2, "max_iter": 4})])
def test_searches_learn_the_targets(data, search, options):
    x, y, rows = data
    model = gp.fit_gpr(rows, "RBF", 15, "kmeans", search, **options)
    start = dense_loss(x, y[:, 0], gp.inducing_points(rows, 15), "RBF", 1.0, float(np.abs(x).mean()), 1.0)
    assert model.where("mode = 0").first()["loss"] < start
    wide = gp.predict_gpr(rows, model).groupBy("t").pivot("mode", [0, 1]).agg(F.first("mean")).orderBy("t").collect()
    error = np.array([[r["0"], r["1"]] for r in wide]) - y
    assert np.sqrt((error**2).mean()) < 0.4 * y.std()


def test_grid_points_and_single_cluster(data):
    x, _, rows = data
    grid = gp.inducing_points(rows, 5, "grid")
    np.testing.assert_allclose(grid, np.linspace(x.min(0), x.max(0), 5))
    np.testing.assert_allclose(gp.inducing_points(rows, 1), x.mean(0, keepdims=True))
    with pytest.raises(ValueError, match="initialiser"):
        gp.inducing_points(rows, 3, "sobol")


def test_model_survives_a_round_trip(spark, data, tmp_path):
    _, _, rows = data
    model = gp.fit_gpr(rows, "Matern32", 6, "grid", points=3, refine=0)
    gp.save(model, str(tmp_path / "gp"))
    a, b = (gp.predict_gpr(rows, m).orderBy("t", "mode").toPandas()["mean"] for m in (model, gp.load(spark, str(tmp_path / "gp"))))
    np.testing.assert_allclose(a, b)


@pytest.mark.parametrize("name", ["Linear", "Polynomial", "Periodic", "Cubic"])
def test_unusable_kernels_are_refused(name):
    with pytest.raises(ValueError, match="kernel"):
        kernel(name)


def rounded_sums(lowest):
    """Two inducing points close together, and Gram sums whose whitened matrix has the eigenvalue ``lowest``."""
    z = np.array([[0.0], [1e-2]])
    kuu = gp.correlation("RBF", z, z, 1.0)
    chol = np.linalg.cholesky(kuu + gp.JITTER * np.eye(2))
    vectors = np.linalg.eigh(kuu)[1]
    inner = (vectors * [lowest, 1e4]) @ vectors.T
    return z, kuu, gp.Sums(0.1 * chol @ inner @ chol.T, np.zeros(2), 50.0, 10**6)


def test_a_bound_of_rounding_error_is_rejected():
    _, kuu, good = rounded_sums(0.5)
    assert np.isfinite(gp.loss_of(kuu, good, 1.0, 1.0, 0.1))
    _, kuu, bad = rounded_sums(-0.978)
    assert gp.loss_of(kuu, bad, 1.0, 1.0, 0.1) == np.inf


def test_last_pass_survives_other_rounding(spark, monkeypatch):
    z, kuu, s = rounded_sums(-1.5)
    full = np.zeros((3, 3))
    full[:2, :2], full[:2, 2], full[2, 0], full[2, 2] = s.phi, s.b, s.n, s.yy
    sums = spark.createDataFrame([(0, 0, 0, bytearray(full.tobytes()))], "slot int, block int, salt int, body binary")
    monkeypatch.setattr(gp, "gram_pass", lambda rows, kernel, candidates: sums)
    got = gp.solve_choices(None, "RBF", {0: gp.Choice(0, 0.0, 0.0, -1.0, 12.5, z)}).collect()
    assert [(r["mode"], r["loss"]) for r in got] == [(0, 12.5)]
    assert np.isfinite(got[0]["c"]).all() and np.isfinite(np.frombuffer(got[0]["pinv"])).all()
