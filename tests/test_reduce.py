import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators import features, reduce


def series(spark, x, runs=("a", "b")):
    half = len(x) // len(runs)
    rows = [(runs[i // half], i % half, c, float(v)) for i, row in enumerate(x) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, "run string, t int, cell_id int, value double")


@pytest.fixture(scope="module")
def flood():
    rng = np.random.default_rng(8)
    n, c = 40, 12
    modes = rng.normal(size=(3, c))
    x = 100 + (rng.normal(size=(n, 3)) * [6, 3, 1.5]) @ modes + rng.normal(scale=0.3, size=(n, c)) + 40
    ground = np.full(c, 100.0)
    x[:, 10] = 99.0  # always dry
    x[:, 11] = 100.01  # always dry as well
    return x, ground, 1 + np.arange(c) / 4


def pca(x, k=None):
    values, vectors = np.linalg.eigh(np.cov(x, rowvar=False))
    return values[::-1][:k], vectors[:, ::-1][:, :k]


@pytest.mark.parametrize("method", ["primal", "dual", "block"])
def test_every_path_finds_the_same_modes(spark, method):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(30, 25)) @ np.diag(0.7 ** np.arange(25)) @ rng.normal(size=(25, 25))
    df = series(spark, x)
    found = reduce.principal_modes(df, ["run", "t"], "cell_id", "value", 3, method=method)
    values, vectors = pca(x, 3)
    got = [r["eigenvalue"] for r in found.eigen.orderBy("mode").limit(3).collect()]
    np.testing.assert_allclose(got, values, rtol=1e-6)
    loadings = np.zeros((3, 25))
    for r in found.loadings(3).collect():
        loadings[r["mode"], r["cell_id"]] = r["loading"]
    for i in range(3):
        lead = np.abs(vectors[:, i]).argmax()
        np.testing.assert_allclose(loadings[i], vectors[:, i] * np.sign(vectors[lead, i]), atol=1e-4)


def test_absent_entries_count_as_zero(spark):
    x = np.random.default_rng(10).normal(size=(20, 6)) + 2
    x[x < 1.5] = 0
    found = reduce.principal_modes(series(spark, x).where("value <> 0"), ["run", "t"], "cell_id", "value")
    got = [r["eigenvalue"] for r in found.eigen.orderBy("mode").collect()]
    np.testing.assert_allclose(got, pca(x)[0], atol=1e-9)


@pytest.mark.parametrize("parameter", ["wse", "depth"])
def test_transform_and_back(spark, flood, parameter):
    x, ground, area = flood
    df = series(spark, x)
    info = spark.createDataFrame([(i, float(g), float(a)) for i, (g, a) in enumerate(zip(ground, area))], "cell_id int, elevation double, area double")
    model = reduce.fit_eof(df, info, k=3, parameter=parameter)
    values = np.maximum(x - ground, 0) if parameter == "depth" else x
    wet = np.arange(12) < 10
    centred = (values[:, wet] - values[:, wet].mean(0)) * area[wet]
    eig, vec = pca(centred, 3)
    np.testing.assert_allclose([r["eigenvalue"] for r in model.eigen.orderBy("mode").limit(3).collect()], eig, rtol=1e-9)
    sign = np.sign(vec[np.abs(vec).argmax(0), range(3)])
    scores = centred @ (vec * sign)
    want = scores / scores.std(0)
    z = {(r["run"], r["t"], r["mode"]): r["z"] for r in reduce.to_modes(df, model).collect()}
    for i in range(40):
        for m in range(3):
            assert z["ab"[i // 20], i % 20, m] == pytest.approx(want[i, m], abs=1e-8)
    modes = reduce.to_modes(df, model).withColumn("var", F.lit(0.5) + F.col("mode"))
    back = reduce.to_cells(modes, model, block=4, salts=3).collect()
    assert len(back) == 40 * 12
    approx = scores @ (vec * sign).T / area[wet] + values[:, wet].mean(0)
    spread = ((0.5 + np.arange(3)) @ ((scores.std(0)[:, None] * (vec * sign).T / area[wet]) ** 2))
    for r in back:
        i, c = r["t"] + 20 * "ab".index(r["run"]), r["cell_id"]
        if wet[c]:
            assert r["value"] == pytest.approx(approx[i, c], abs=1e-8) and r["var"] == pytest.approx(spread[c])
        else:
            assert r["value"] == (0.0 if parameter == "depth" else ground[c]) and r["var"] == 0


def test_model_is_kept_in_tables(spark, flood, tmp_path):
    x, ground, area = flood
    df = series(spark, x)
    info = spark.createDataFrame([(i, float(g), float(a)) for i, (g, a) in enumerate(zip(ground, area))], "cell_id int, elevation double, area double")
    model = reduce.fit_eof(df, info, k=0)
    assert 1 <= model.k <= 10
    model.save(str(tmp_path / "m"))
    again = reduce.EofModel.load(spark, str(tmp_path / "m"))
    key = ["run", "t", "mode"]
    a, b = (reduce.to_modes(df, m).toPandas().sort_values(key)["z"].to_numpy() for m in (model, again))
    np.testing.assert_allclose(a, b)


def test_forcing_features_match_arrays(spark):
    rng = np.random.default_rng(11)
    n, p = 24, 5
    rain = np.maximum(rng.normal(size=(n, p)), 0)
    flow = rng.random((n, 2))
    rows = [(("a", "b")[i // 12], i % 12, f"precip_{j}", float(rain[i, j])) for i in range(n) for j in range(p)]
    rows += [(("a", "b")[i // 12], i % 12, f"site_{j}", float(flow[i, j])) for i in range(n) for j in range(2)]
    df = spark.createDataFrame(rows, "run string, t int, feature string, value double")
    for carry in (False, True):
        model = features.fit_forcing_features(df, k=2, carry_over=carry)
        got = features.transform_forcing(df, model).toPandas()
        c = rain - rain.mean(0)
        mean = c.mean(1)
        parts = [mean] if carry else [mean[:12], mean[12:]]
        api = np.concatenate([np.convolve(m, 0.85 ** np.arange(len(m)))[: len(m)] for m in parts])
        total = np.concatenate([np.cumsum(m) for m in parts])
        _, vec = pca(c, 2)
        want = {"rain_mean": mean, "rain_api": api, "rain_sum": total, "site_0": flow[:, 0] - flow[:, 0].mean()}
        want |= {f"rain_pc_{j}": c @ (vec[:, j] * np.sign(vec[np.abs(vec[:, j]).argmax(), j])) for j in range(2)}
        assert set(got["feature"]) == set(want) | {"site_1"}
        for name, v in want.items():
            part = got[got["feature"] == name].sort_values(["run", "t"])["z"].to_numpy()
            np.testing.assert_allclose(part, (v - v.mean()) / v[v != 0].std(), atol=1e-7, err_msg=name)


def test_constant_feature_becomes_zero(spark):
    df = spark.createDataFrame([("a", t, f, v) for t in range(6) for f, v in (("precip_0", float(t)), ("precip_1", float(t % 2)), ("flat", 3.0))], "run string, t int, feature string, value double")
    out = features.transform_forcing(df, features.fit_forcing_features(df, k=1))
    assert {r["z"] for r in out.where("feature = 'flat'").collect()} == {0.0}


def test_many_modes_go_both_ways(spark):
    """A column or a nested term for each mode fails at hundreds of modes."""
    rng = np.random.default_rng(3)
    n, c = 150, 160
    values = rng.normal(size=(n, c)) + 3
    series = spark.createDataFrame([("a" if i % 2 else "b", i, j, float(values[i, j])) for i in range(n) for j in range(c)], "run string, t int, cell_id int, value double")
    info = spark.createDataFrame([(j, 0.0, 1.0 + j % 3) for j in range(c)], "cell_id int, elevation double, area double")
    model = reduce.fit_eof(series, info, k=c)
    assert model.k > reduce.MANY_MODES
    modes = reduce.to_modes(series, model).withColumn("var", F.lit(0.5))
    back = reduce.to_cells(modes, model)
    got = {(r["t"], r["cell_id"]): (r["value"], r["var"]) for r in back.collect()}
    assert len(got) == n * c and all(abs(got[i, j][0] - values[i, j]) < 1e-8 for i in range(n) for j in range(c))
    few = reduce.EofModel(model.cells, model.eof.where("mode < 3"), model.eigen, model.mode_stats.where("mode < 3"), n, 3)
    first = modes.where("mode < 3")
    want = {(r["run"], r["t"], r["mode"]): r["z"] for r in reduce.to_modes(series, few).collect()}
    assert all(abs(want[r["run"], r["t"], r["mode"]] - r["z"]) < 1e-8 for r in first.collect())
    plain = {(r["t"], r["cell_id"]): (r["value"], r["var"]) for r in reduce.to_cells(first, few).collect()}
    packed = reduce._score_arrays(first, "z").join(reduce._score_arrays(first, "var"), ["run", "t"])
    stats = {r["mode"]: r["std"] for r in few.mode_stats.collect()}
    scale = F.transform("_l", lambda v, j: v * F.element_at(F.array(*[F.lit(stats[m]) for m in range(3)]), (j + 1).cast("int")) / F.col("weight"))
    cells = few.cells.join(reduce._loading_arrays(few.eof), "cell_id").select("cell_id", F.col("mean").alias("_base"), scale.alias("_c"))
    for r in reduce._matrix_cells(packed, cells, True).collect():
        assert np.allclose((r["value"], r["var"]), plain[r["t"], r["cell_id"]], atol=1e-9)
