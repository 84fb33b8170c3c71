import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.functions import quantiles, scan
from freshet.operators import stats, windows


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(0)
    # One key holds most rows.
    pdf = pd.DataFrame({"k": ["hot"] * 900 + ["cold"] * 100, "t": [*range(900), *range(100)], "v": rng.normal(size=1000)})
    return pdf, spark.createDataFrame(pdf)


def test_running_sum_and_position_over_buckets(frame):
    pdf, df = frame
    got = scan.running_sum(df, ["k"], ["t"], scan.chunk_of("t", 64), {"s": "v"})
    got = scan.row_position(got, ["k"], ["t"], scan.chunk_of("t", 37)).toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    want = pdf.sort_values(["k", "t"]).reset_index(drop=True)
    np.testing.assert_allclose(got["s"], want.groupby("k")["v"].cumsum(), atol=1e-9)
    assert (got["pos"] == want.groupby("k").cumcount()).all()


def test_next_row_across_buckets(spark):
    values = sorted(np.random.default_rng(1).normal(size=300).tolist())
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "x double, i int")
    bounds = scan.quantile_bounds(df, "x", rows_per_bucket=40)
    assert len(bounds) >= 6
    got = scan.with_next(df, "x", scan.bucket_of("x", bounds), ["i"]).toPandas().sort_values("i")
    assert got["next_i"].iloc[:-1].astype(int).tolist() == list(range(1, 300)) and pd.isna(got["next_i"].iloc[-1])


def test_bins_never_fall_as_values_grow(spark):
    rng = np.random.default_rng(20)
    v = np.r_[rng.normal(size=300), rng.lognormal(sigma=200, size=300), -rng.lognormal(sigma=200, size=300), 0.0, -0.0, 5e-324, -5e-324, 1e-308, 1.7e308, -1.7e308, np.inf, -np.inf]
    v = np.r_[v, [s * np.nextafter(2.0**k, d) for k in range(-1020, 1024, 7) for d in (-np.inf, np.inf) for s in (1, -1)], [2.0**k for k in range(-1022, 1024, 5)]]
    v = np.sort(v[~np.isnan(v)])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double")
    for bits in (quantiles.COARSE, quantiles.FINE):
        bins = [r["b"] for r in df.select("i", quantiles.bin_of(quantiles.F.col("v"), bits).alias("b")).orderBy("i").collect()]
        assert bins == sorted(bins) and len(set(bins)) > 900


@pytest.mark.parametrize("scale", [1.0, 1e-200])
def test_quantiles_of_hot_groups_are_exact(spark, scale):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": ["hot"] * 5000 + ["cold"] * 7 + ["same"] * 90, "v": scale * np.r_[np.round(rng.normal(size=5000) * 3, 2), np.arange(7.0), [0.1] * 90]})
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {r["k"]: r["q"] for r in quantiles.exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", probs).collect()}
    for key, group in pdf.groupby("k"):
        np.testing.assert_allclose(got[key], np.quantile(group["v"], probs), atol=1e-12 * scale)
    whole = quantiles.exact_quantiles(spark.createDataFrame(pdf), [], "v", probs).first()["q"]
    np.testing.assert_allclose(whole, np.quantile(pdf["v"], probs), atol=1e-12 * scale)


@pytest.mark.parametrize("k,window,width", [(0.85, None, 512), (0.85, None, 8), (0.999, None, 16), (1, None, 8), (0.85, 5, 8), (0.5, None, 512)])
def test_api_is_a_decayed_sum(frame, k, window, width):
    pdf, df = frame
    got = windows.api(df, k, window, keys=["k"], value="v", width=width).toPandas().sort_values(["k", "t"])
    for key, group in pdf.sort_values(["k", "t"]).groupby("k"):
        x = group["v"].to_numpy()
        weights = np.array([k**i for i in range(window or len(x))])
        np.testing.assert_allclose(got[got["k"] == key]["api"], np.convolve(x, weights)[: len(x)], atol=1e-8)


def test_step_change_paths_agree(spark):
    rng = np.random.default_rng(4)
    rows = [("r", f"s{s}", t, float(v)) for s in range(4) for t, v in enumerate(rng.normal(size=50) * (s > 0))]
    df = spark.createDataFrame(rows, "run string, series string, t int, value double")
    one = windows.step_change(df).toPandas().sort_values(["series", "t"])
    many = windows.step_change(df, width=8).toPandas().sort_values(["series", "t"])
    np.testing.assert_allclose(one["change"], many["change"])
    assert len(one) == 4 * 49 and (one[one["series"] == "s0"]["change"] == 0).all()


def cut(combo, threshold=0.95):
    """Cut-offs by array arithmetic."""
    if np.isnan(combo).any():
        combo = combo[: np.isnan(combo).any(axis=1).argmax()]
    d = np.abs(np.diff(combo, axis=0))
    total = d.sum(axis=0)
    d = d / np.where(total == 0, 1, total)
    with np.errstate(invalid="ignore"):
        cum = np.cumsum(d.sum(axis=1) / d.sum())
    return int(np.argmax(cum > 10e-4)), int(np.argmax(cum > threshold))


def test_cutoffs_match_array_arithmetic_and_flat_runs_are_empty(spark):
    rng = np.random.default_rng(5)
    hf, lf, want = [], [], {}
    for run in ("a", "b", "flat"):
        x = np.cumsum(rng.exponential(size=(40, 5)) * np.r_[np.zeros(4), np.geomspace(1e-3, 5, 10), np.geomspace(5, 1e-4, 26)][:, None], axis=0)
        if run == "flat":
            x = np.ones((40, 5))
        if run == "b":
            x[35:, 3] = np.nan
        want[run] = cut(x)
        hf += [(run, t, c, float(x[t, c])) for t in range(40) for c in range(3)]
        lf += [(run, t, c, float(x[t, c])) for t in range(40) for c in range(3, 5)]
    schema = "run string, t int, cell_id int, value double"
    cuts = windows.cutoffs(spark.createDataFrame(hf, schema), spark.createDataFrame(lf, schema))
    assert {r["run"]: (r["start"], r["stop"]) for r in cuts.collect()} == want
    assert want["flat"] == (0, 0)
    clipped = windows.clip(spark.createDataFrame(hf, schema), cuts).groupBy("run").agg(F.min("t"), F.count_distinct("t")).collect()
    assert {r[0]: (r[1], r[2]) for r in clipped} == {r: (0, b - a) for r, (a, b) in want.items() if b > a}


def test_interpolation_extends_past_the_ends(spark, monkeypatch):
    monkeypatch.setattr(scan, "quantile_bounds", lambda df, col, rows_per_bucket=None: [-1.0, 0.5, 2.0])
    xs = np.sort(np.random.default_rng(6).normal(size=30) * 2)
    ys = np.cumsum(np.abs(np.random.default_rng(7).normal(size=30)))
    curve = spark.createDataFrame(list(zip(xs.tolist(), ys.tolist())), "value double, rp double")
    asked = [-50.0, *np.linspace(-6, 6, 41).tolist(), xs[3], 50.0, -50.0]
    got = windows.interp_linear(spark.createDataFrame([(float(v),) for v in asked], "x double"), curve, "x", "y").toPandas()
    i = np.clip(np.searchsorted(xs, got["x"], side="right") - 1, 0, len(xs) - 2)
    want = ys[i] + (ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i]) * (got["x"] - xs[i])
    assert len(got) == len(asked)
    np.testing.assert_allclose(got["y"], want, rtol=1e-9)


@pytest.mark.parametrize(
    "values,n,kept",
    [([0.5, 0.2], 100, 0), ([5.0], 100, 1), ([10.0, 9.9, 2.0], 100, 3), ([50.0, 20.0, 10.0, 9.9, 5.0, 0.1], 100, 2), ([50.0, 20.0, 5.0], 10**9, 3)],
)
def test_separation_rule(spark, values, n, kept):
    eigs = spark.createDataFrame(list(enumerate(values)), "mode int, eigenvalue double")
    assert stats.norths_rule(eigs, n).first()["modes"] == kept


def test_positions_of_sparse_values_need_no_single_window(spark):
    rng = np.random.default_rng(21)
    ids = np.unique((rng.uniform(size=3000) ** 9 * 1e15).astype("int64"))
    df = spark.createDataFrame([(int(i),) for i in rng.permutation(ids)], "event_id long").repartition(6)
    got = {r["event_id"]: r["pos"] for r in scan.global_position(df, ["event_id"]).collect()}
    assert got == {int(i): k for k, i in enumerate(ids)}


def test_index_over_all_runs_holds_no_series_in_one_task(spark):
    """Without a key: no Python group, and windows go by chunks of one level only."""
    from freshet.operators import windows

    df = spark.range(200_000).select(F.col("id").cast("int").alias("t"), (F.col("id") % 17).cast("double").alias("rain"))
    for k in (0.85, 0.9999):
        out = windows.api(df, k, keys=[])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "SinglePartition" not in plan
        got = {r["t"]: r["api"] for r in out.where("t % 9973 = 5 OR t = 199999").collect()}
        state, want = 0.0, {}
        for t in range(200_000):
            state = t % 17 + k * state
            want[t] = state
        assert got == {t: pytest.approx(want[t], rel=1e-9) for t in got} and len(got) > 20
