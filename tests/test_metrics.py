import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.operators import metrics


def long(spark, arrays):
    """(run -> T x C arrays) for several named columns as one frame."""
    rows = []
    for run, cols in arrays.items():
        t, c = next(iter(cols.values())).shape
        for i in range(t):
            for j in range(c):
                rows.append({"run": run, "t": i, "cell_id": j, **{k: float(v[i, j]) for k, v in cols.items()}})
    return spark.createDataFrame(pd.DataFrame(rows)).withColumns({"t": F.col("t").cast("int"), "cell_id": F.col("cell_id").cast("int")})


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    out = {}
    for run, t in (("a", 13), ("b", 29)):
        x = np.abs(rng.normal(size=(t, 6))) * np.arange(6)
        out[run] = {"x": x, "y": np.abs(x + rng.normal(scale=0.4, size=x.shape)), "s": rng.random(x.shape)}
    return out, long(spark, out)


def table_of(df, col):
    return df.select("run", "t", "cell_id", F.col(col).alias("value"))


def agrees(x, y, t, c, t_tol, v_tol):
    """One value agrees if either series comes within ``v_tol`` of the other's present value by ``t_tol`` steps from now."""
    soon = range(t, min(len(x), t + t_tol + 1))
    return any(abs(y[t, c] - x[u, c]) <= v_tol or abs(x[t, c] - y[u, c]) <= v_tol for u in soon)


def agreement(x, y, t_tol, v_tol):
    return np.mean([agrees(x, y, t, c, t_tol, v_tol) for t, c in np.ndindex(x.shape)])


@pytest.mark.parametrize("t_tol,v_tol", [(0, 0.2), (1, 0.1), (3, 0.05)])
def test_suite_against_numpy(spark, data, t_tol, v_tol):
    arrays, df = data
    thr = 1.5
    pred = df.select("run", "t", "cell_id", F.col("y").alias("value"), F.col("s").alias("sd"))
    two = metrics.metric_suite(table_of(df, "x"), pred, None, thr, t_tol, v_tol)
    three = metrics.metric_suite(table_of(df, "x"), table_of(df, "y"), table_of(df, "s"), thr, t_tol, v_tol)
    for tables in (two, three):
        for row in tables.scalar.collect():
            x, y, s = (arrays[row["event"]][k] for k in "xys")
            px, py = x.max(0), y.max(0)
            a, b, c = ((px >= thr) & (py >= thr)).sum(), ((px < thr) & (py >= thr)).sum(), ((px >= thr) & (py < thr)).sum()
            want = {
                "rmse_aoi_toi": np.sqrt(((x - y) ** 2).mean()), "mae_aoi_toi": np.abs(x - y).mean(), "conf_aoi_toi": s.mean(),
                "err_aoi_toi": (x - y).mean(), "rmse_aoi_mts": np.sqrt(((px - py) ** 2).mean()), "err_aoi_mts": (px - py).mean(),
                "nse_aoi_mts": 1 - ((px - py) ** 2).sum() / ((px - px.mean()) ** 2).sum(), "fi_aoi_toi": agreement(x, y, t_tol, v_tol),
                "pod_mts": a / (a + c), "rfa_mts": b / (a + b), "csi_mts": a / (a + b + c), "f2_mts": (a - c) / (a + b + c),
                "f3_mts": (a - b) / (a + b + c),
            }
            for name, value in want.items():
                assert row[name] == pytest.approx(value, abs=1e-9), name
        for row in tables.cell.collect():
            x, y, s = (arrays[row["event"]][k][:, row["cell_id"]] for k in "xys")
            assert row["rmse_cell_toi"] == pytest.approx(np.sqrt(((x - y) ** 2).mean()))
            assert row["err_cell_mts"] == pytest.approx(x.max() - y.max())
            assert row["err_cell_toi"] == pytest.approx((x - y).mean()) and row["conf_cell_toi"] == pytest.approx(s.mean())
        steps = tables.timeseries.collect()
        assert len(steps) == 13 + 29
        for row in steps:
            x, y = (arrays[row["event"]][k][row["timestep"]] for k in "xy")
            assert row["rmse_aoi_ts"] == pytest.approx(np.sqrt(((x - y) ** 2).mean()))
        tables.release()


def test_look_ahead_across_chunk_borders(data):
    arrays, df = data
    found = {r["run"]: r["fi"] for r in metrics.matches(df, 3, 0.05, width=4).groupBy("run").agg(F.avg("matched").alias("fi")).collect()}
    for run, cols in arrays.items():
        assert found[run] == pytest.approx(agreement(cols["x"], cols["y"], 3, 0.05))


def test_perfect_prediction(data):
    _, df = data
    same = df.withColumn("y", F.col("x"))
    assert all(r[1] == 0 for r in metrics.rmse_aoi_toi(same).collect())
    assert all(r[1] == 1 for r in metrics.nse_aoi_mts(same).collect())
    assert all(r[1] == 1 for r in metrics.fi_aoi_toi(same).collect())


def test_contingency_without_events_is_null_or_one(data):
    _, df = data
    assert all(r[1] is None for r in metrics.pod_mts(df, threshold=1e9).collect())
    assert all(r[1] is None for r in metrics.csi_mts(df, threshold=1e9).collect())
    assert all(r[1] == 1.0 for r in metrics.f2_mts(df, threshold=1e9).collect())
    assert all(r[1] == 1.0 for r in metrics.f3_mts(df, threshold=1e9).collect())


def test_velocity_runs_have_no_contingency_scores(data):
    _, df = data
    pred = df.select("run", "t", "cell_id", F.col("y").alias("value"), F.col("s").alias("sd"))
    row = metrics.metric_suite(table_of(df, "x"), pred, parameter="velocity", cache=False).scalar.first()
    assert row["pod_mts"] is None and row["rfa_mts"] is None and row["csi_mts"] is None and row["f2_mts"] is not None


def test_negative_peak_is_an_error(spark):
    bad = spark.createDataFrame([("a", 0, 1, -1.0, 2.0, 0.1)], "run string, t int, cell_id int, x double, y double, s double")
    with pytest.raises(Exception, match="negative"):
        metrics.detection_categories(bad).collect()


def test_pairs_are_joined_by_sorting(spark):
    """Tables that compress well looked small and were sent whole to every task."""
    from freshet.operators import joins

    steps = spark.range(60).selectExpr("concat('r', id % 2) AS run", "CAST(id % 5 AS INT) AS t", "id AS cell_id", "id * 0.5 AS value", "0.1D AS sd")
    for found in (joins.pair(steps, steps), joins.pair(steps, steps, steps), metrics._filed_pairs(steps, steps, 0)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
        assert found.count() == 60


def test_overall_errors_are_joined_by_sorting(spark):
    """Levels that compress well were broadcast and filled the driver's memory (F2)."""
    steps = spark.range(60).selectExpr("concat('r', id % 2) AS run", "CAST(id % 5 AS INT) AS t", "id AS cell_id", "id * 0.5 AS value")
    low, up = steps.withColumn("value", F.col("value") - 2), steps.withColumn("value", F.col("value") + 1).where("cell_id < 50")
    found = metrics.overall_rmse(low, steps, up)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") >= 2
    assert tuple(found.first()) == (2.0, 1.0)


def test_scatter_bins_are_joined_by_sorting(spark):
    """As for the overall errors."""
    from freshet.operators import diagnostics

    steps = spark.range(60).selectExpr("concat('r', id % 2) AS run", "CAST(id % 5 AS INT) AS t", "id AS cell_id", "0.5D AS value")
    low, up = steps.withColumn("value", F.col("value") - 2), steps.withColumn("value", F.col("value") + 1).where("cell_id < 50")
    found = diagnostics.scatter_bins(low, steps, up, 1.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") >= 2
    assert sorted(map(tuple, found.collect())) == [("lf", -2, 0, 50, 200.0), ("upskill", 1, 0, 50, 50.0)]
