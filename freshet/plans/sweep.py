"""Cross-validation sweeps over settings."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.plans.experiment import Config, Reducers, fit_reducers, train_predict_score, with_options
from freshet.schema import Dataset
from freshet.sources.dataset import table_exists
from freshet.sources.metric_tables import NAMES

# Settings that change the reduction itself.
REDUCTION_SETTINGS = {"spatial_mode_count", "precip_spatial_mode_count", "hydraulic_parameter", "wet_threshold_depth"}

# The preset sweeps, with the searches under their names here.
PRESETS: dict[str, dict[str, list[Any]]] = {
    "kernel": {"kernel": ["Matern12", "Matern32", "Matern52", "RBF", "Exponential"]},
    "spatial_mode_count": {"spatial_mode_count": [1, 3, 5, 7, 10, 15, 20, 30, 50]},
    "inducing_pt_count": {"inducing_pt_count": [1, 3, 5, 10, 20, 50, 100, 300]},
    "optimizer": {
        "optimizer": ["profile", "random", "evolution", "two-stage", "three-stage", "adam", "adadelta", "l-bfgs"],
        "optimizer_kwargs": [{}, {"n_starts": 50}, {"popsize": 5, "max_iter": 100}, *[{"max_iter": 5_000}] * 5],
    },
}


def sweep(
    spark: SparkSession, cfg: Config, options: dict[str, Sequence[Any]], train: Dataset, test: Dataset, path: str,
    reducers: Reducers | None = None,
) -> DataFrame:
    """Run one experiment per position of the option lists, in lock-step, and record its settings and scores.

    Finished positions are skipped. The reduction is fitted once and fitted
    again only for settings that change it. Results lie below
    ``path/<table>/sweep_id=<i>``; the scalar scores of all positions are returned.
    """
    length = len(next(iter(options.values())))
    if any(len(v) != length for v in options.values()):
        raise ValueError("all option lists must have the same length")
    shared = reducers
    for i in range(length):
        done = f"{path}/configs/sweep_id={i}"
        if table_exists(spark, done):
            continue
        changes = {name: values[i] for name, values in options.items()}
        trial = with_options(cfg, **changes)
        if REDUCTION_SETTINGS & changes.keys():
            fitted = fit_reducers(train, trial)
        else:
            shared = fitted = shared or fit_reducers(train, cfg)
        outcome = train_predict_score(train, test, trial, fitted)
        tables = (outcome.metrics.scalar, outcome.metrics.timeseries, outcome.metrics.cell)
        for name, df in zip(NAMES, tables):
            df.write.mode("overwrite").parquet(f"{path}/{name}/sweep_id={i}")
        outcome.metrics.release()
        # The settings are written last: they mark the position as finished.
        spark.createDataFrame([(trial.to_json(), str(changes))], "config string, changed string").coalesce(1).write.mode(
            "overwrite"
        ).parquet(done)
    return spark.read.option("basePath", f"{path}/scalar_metrics").parquet(f"{path}/scalar_metrics")


def run_preset(spark: SparkSession, name: str, cfg: Config, train: Dataset, test: Dataset, path: str) -> DataFrame:
    return sweep(spark, cfg, PRESETS[name], train, test, f"{path}/{name}")


def sweep_kernel(spark, cfg, train, test, path) -> DataFrame:
    return run_preset(spark, "kernel", cfg, train, test, path)


def sweep_modes(spark, cfg, train, test, path) -> DataFrame:
    return run_preset(spark, "spatial_mode_count", cfg, train, test, path)


def sweep_inducing(spark, cfg, train, test, path) -> DataFrame:
    return run_preset(spark, "inducing_pt_count", cfg, train, test, path)


def sweep_optimizer(spark, cfg, train, test, path) -> DataFrame:
    return run_preset(spark, "optimizer", cfg, train, test, path)


def leaderboard(scores: DataFrame, metric: str = "rmse_aoi_toi", by: str = "sweep_id") -> DataFrame:
    """Mean score per configuration, best first; configurations are few."""
    means = scores.groupBy(by).agg(F.avg(metric).alias(metric))
    return means.withColumn("rank", F.row_number().over(Window.orderBy(metric, by)))
