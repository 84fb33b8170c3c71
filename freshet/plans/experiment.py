"""Train, predict and score one surrogate."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions.exprs import check_kernel, depth
from freshet.operators import gp
from freshet.operators.features import ForcingModel, fit_forcing_features, forcing_table, transform_forcing
from freshet.operators.joins import resample_cells
from freshet.operators.metrics import MetricTables, metric_suite
from freshet.operators.reduce import EofModel, fit_eof, to_cells, to_modes
from freshet.operators.spatial import interpolate_surface
from freshet.operators.surfaces import pseudo_surface
from freshet.functions.exprs import floor_to_ground
from freshet.schema import Dataset
from freshet.session import cut_lineage

MESH_MODELS = ("upskill", "interpolate", "pseudo_surface")


@dataclass
class Config:
    """Settings of one experiment."""

    hydraulic_parameter: str = "wse"
    wet_threshold_depth: float = 0.03
    spatial_mode_count: int | None = 10
    kernel: str = "Matern32"
    inducing_pt_count: int = 50
    induction_pt_initializer: str = "kmeans"
    optimizer: str = "profile"
    optimizer_kwargs: dict[str, Any] = field(default_factory=dict)
    lf_model_type: str = "upskill"
    precip_spatial_mode_count: int | None = 5
    carry_over: bool = False
    depth_threshold: float = 0.5
    t_tol: int = 0
    v_tol: float = 0.0

    @classmethod
    def from_json(cls, text: str) -> Config:
        return cls(**json.loads(text))

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)


# --- low-fidelity tables --------------------------------------------------------------------------


def upskill_surface(lf: DataFrame, cell_map: DataFrame, cells: DataFrame, parameter: str = "wse") -> DataFrame:
    """Low-fidelity values on the high-fidelity cells; levels never below ground."""
    mapped = resample_cells(lf.select("run", "t", "cell_id", "value"), cell_map)
    if parameter == "velocity":
        return mapped.select("run", "t", "cell_id", "value")
    return mapped.join(cells.select("cell_id", "elevation"), "cell_id").select(
        "run", "t", "cell_id", floor_to_ground("value", "elevation", fill_nan=False).alias("value")
    )


LF_BUILDERS: dict[str, Callable[..., DataFrame]] = {
    "upskill": upskill_surface,
    "interpolate": interpolate_surface,
    "forcing": forcing_table,
    "pseudo_surface": pseudo_surface,
}


def lf_builder(name: str) -> Callable[..., DataFrame]:
    if name not in LF_BUILDERS:
        raise ValueError(f"unknown low-fidelity model {name!r}; use one of {sorted(LF_BUILDERS)}")
    return LF_BUILDERS[name]


# --- the experiment -------------------------------------------------------------------------------


@dataclass
class Reducers:
    hf: EofModel
    lf: EofModel | ForcingModel


def fit_reducers(train: Dataset, cfg: Config) -> Reducers:
    """Mesh models share one reduction for both sides; a forcing model has its own features."""
    hf = fit_eof(
        train.hf, train.cell_info, cfg.spatial_mode_count, cfg.wet_threshold_depth, cfg.hydraulic_parameter
    )
    if cfg.lf_model_type in MESH_MODELS:
        return Reducers(hf, hf)
    if cfg.lf_model_type == "forcing":
        return Reducers(hf, fit_forcing_features(train.lf, cfg.precip_spatial_mode_count, cfg.carry_over))
    raise ValueError(f"no reduction for low-fidelity model {cfg.lf_model_type!r}")


def lf_inputs(lf: DataFrame, reducers: Reducers) -> DataFrame:
    """Input arrays ``x`` per run and step."""
    if isinstance(reducers.lf, ForcingModel):
        return gp.stack(transform_forcing(lf, reducers.lf), "feature", "z", "x")
    return gp.stack(to_modes(lf, reducers.lf), "mode", "z", "x")


def fit_surrogate(train: Dataset, reducers: Reducers, cfg: Config) -> DataFrame:
    check_kernel(cfg.kernel)
    y = gp.stack(to_modes(train.hf, reducers.hf), "mode", "z", "y")
    rows = cut_lineage(lf_inputs(train.lf, reducers).join(y, ["run", "t"]))
    return gp.fit_gpr(
        rows, cfg.kernel, cfg.inducing_pt_count, cfg.induction_pt_initializer, cfg.optimizer, **cfg.optimizer_kwargs
    )


def predict_scores(lf: DataFrame, reducers: Reducers, model: DataFrame) -> DataFrame:
    """Mean and variance of every mode ``(run, t, mode, z, var)``."""
    # Mode scores are small next to the cells they spread to, and several results start from them.
    scores = cut_lineage(gp.predict_gpr(lf_inputs(lf, reducers), model))
    return scores.select("run", "t", "mode", F.col("mean").alias("z"), "var")


def predict_cells(lf: DataFrame, reducers: Reducers, model: DataFrame) -> DataFrame:
    """Mean and variance on every cell ``(run, t, cell_id, value, var)``."""
    return to_cells(predict_scores(lf, reducers, model), reducers.hf)


def as_depth(df: DataFrame, cells: DataFrame, parameter: str, predicted: bool = False) -> DataFrame:
    """Depth to score: levels minus ground, predicted depths clipped at 0, velocities as they are."""
    if parameter == "velocity":
        return df
    if parameter == "depth" and predicted:
        return df.withColumn("value", F.greatest("value", F.lit(0.0)))
    joined = df.join(cells.select("cell_id", "elevation"), "cell_id")
    return joined.withColumn("value", depth("value", "elevation")).select(*df.columns)


@dataclass
class Outcome:
    metrics: MetricTables
    scores: DataFrame
    model: DataFrame
    reducers: Reducers

    @cached_property
    def prediction(self) -> DataFrame:
        """Mean and variance on every cell and predicted step."""
        return to_cells(self.scores, self.reducers.hf)


def train_predict_score(train: Dataset, test: Dataset, cfg: Config, reducers: Reducers | None = None) -> Outcome:
    """Fit on ``train``, predict ``test`` and score it per event."""
    reducers = reducers or fit_reducers(train, cfg)
    model = fit_surrogate(train, reducers, cfg)
    scores = predict_scores(test.lf, reducers, model)
    # Only steps with a truth are scored, and a forcing may have many more: they are left out while they are modes,
    # as steps times cells would be dealt out for the join before it drops them.
    known = cut_lineage(scores.join(test.hf.select("run", "t").distinct(), ["run", "t"], "left_semi"))
    p = cfg.hydraulic_parameter
    truth = as_depth(test.hf.select("run", "t", "cell_id", "value"), test.cell_info, p)
    scored = as_depth(to_cells(known, reducers.hf), test.cell_info, p, predicted=True).withColumn("sd", F.sqrt("var"))
    tables = metric_suite(
        truth, scored, None, cfg.depth_threshold, cfg.t_tol, cfg.v_tol, p
    )
    return Outcome(tables, scores, model, reducers)


def with_options(cfg: Config, **changes: Any) -> Config:
    return replace(cfg, **changes)
