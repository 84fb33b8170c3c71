import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators import metrics
from freshet.operators.metrics import overall_rmse
from freshet.plans import experiment, sweep
from freshet.schema import Dataset


def flood(spark, runs, seed):
    """High-fidelity levels that are a bent copy of the low-fidelity ones."""
    rng = np.random.default_rng(seed)
    hf, lf = [], []
    shape = np.linspace(0.5, 2, 8)
    for r in runs:
        wave = np.abs(np.cumsum(rng.normal(size=30))) / 2
        for t, w in enumerate(wave):
            for c in range(8):
                lf.append((r, t, c, float(10 + w * shape[c])))
                hf.append((r, t, c, float(10 + (w + 0.5 * np.sin(w)) * shape[c] + 0.01 * rng.normal())))
    schema = "run string, t int, cell_id int, value double"
    info = spark.createDataFrame([(c, 10.0, 1.0 + c) for c in range(8)], "cell_id int, elevation double, area double")
    lines = spark.createDataFrame([], "run string, t int, line string, flow double, wse double")
    return Dataset(spark.createDataFrame(hf, schema), spark.createDataFrame(lf, schema), info, lines)


@pytest.fixture(scope="module")
def parts(spark):
    return flood(spark, ["a", "b", "c", "d"], 1), flood(spark, ["x", "y"], 2)


CFG = experiment.Config(spatial_mode_count=2, inducing_pt_count=15, optimizer_kwargs={"points": 5, "refine": 1})


def test_surrogate_beats_the_raw_low_fidelity_model(parts):
    train, test = parts
    out = experiment.train_predict_score(train, test, CFG)
    keys = ["run", "t", "cell_id"]
    row = overall_rmse(test.lf, test.hf, out.prediction.select(*keys, "value")).first()
    assert row["upskill_rmse"] < 0.5 * row["lf_rmse"]
    scalar = out.metrics.scalar.collect()
    assert {r["event"] for r in scalar} == {"x", "y"} and all(r["nse_aoi_mts"] > 0.8 for r in scalar)
    assert out.metrics.cell.count() == 16 and out.metrics.timeseries.count() == 60
    assert out.prediction.where(F.col("var") < 0).isEmpty()


def test_steps_without_truth_are_left_out_before_they_become_cells(parts, monkeypatch):
    """Every step of a long forcing was spread to all cells and dealt out for a join that dropped most of it (F1)."""
    train, test = parts
    short = Dataset(test.hf.where("t < 10"), test.lf, test.cell_info, test.ref_lines)
    spread = []

    def suite(truth, pred, *rest):
        spread.append((truth.count(), pred.count()))
        return metrics.metric_suite(truth, pred, *rest)

    monkeypatch.setattr(experiment, "metric_suite", suite)
    out = experiment.train_predict_score(train, short, CFG)
    assert spread == [(160, 160)]
    assert out.prediction.count() == 480  # the prediction itself stays whole
    assert out.metrics.timeseries.count() == 20 and out.metrics.cell.count() == 16
    pairs = metrics.pair(short.hf, out.prediction.select("run", "t", "cell_id", "value", F.sqrt("var").alias("sd")))
    want = {r["run"]: r["rmse_aoi_toi"] for r in metrics.rmse_aoi_toi(pairs).collect()}
    assert {r["event"]: r["rmse_aoi_toi"] for r in out.metrics.scalar.collect()} == pytest.approx(want)


def test_sweep_skips_what_is_done_and_ranks_the_rest(spark, parts, tmp_path):
    train, test = parts
    path = str(tmp_path / "cv")
    options = {"kernel": ["RBF", "Matern32"], "spatial_mode_count": [2, 1]}
    scores = sweep.sweep(spark, CFG, options, train, test, path)
    assert {r["sweep_id"] for r in scores.collect()} == {0, 1}

    def fail(*_):
        raise AssertionError("position was run again")

    before, sweep.train_predict_score = sweep.train_predict_score, fail
    try:
        again = sweep.sweep(spark, CFG, options, train, test, path)
    finally:
        sweep.train_predict_score = before
    board = sweep.leaderboard(again).orderBy("rank").collect()
    assert [r["rank"] for r in board] == [1, 2] and board[0]["rmse_aoi_toi"] <= board[1]["rmse_aoi_toi"]
    settings = [experiment.Config.from_json(r["config"]) for r in spark.read.parquet(f"{path}/configs").collect()]
    assert {(s.kernel, s.spatial_mode_count) for s in settings} == {("RBF", 2), ("Matern32", 1)}
    with pytest.raises(ValueError, match="same length"):
        sweep.sweep(spark, CFG, {"kernel": ["RBF"], "spatial_mode_count": [1, 2]}, train, test, path)


def test_unknown_models_fail(parts):
    train, _ = parts
    with pytest.raises(ValueError, match="unknown low-fidelity"):
        experiment.lf_builder("tides")
    with pytest.raises(ValueError, match="no reduction"):
        experiment.fit_reducers(train, experiment.with_options(CFG, lf_model_type="tides"))


def test_presets_have_equal_option_lists():
    for options in sweep.PRESETS.values():
        assert len({len(v) for v in options.values()}) == 1
