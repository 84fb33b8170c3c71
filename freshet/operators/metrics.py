"""Scores of a prediction against the truth.

``pairs`` has ``run, t, cell_id`` and truth ``x``, prediction ``y``, spread ``s``.
The peak of a cell is its largest value in the run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions import scan
from freshet.operators.joins import pair
from freshet.session import shares_partitioning

CONTINGENCY = ("pod_mts", "rfa_mts", "csi_mts", "f2_mts", "f3_mts")


def _error() -> Column:
    return F.col("x") - F.col("y")


def _score(pairs: DataFrame, by, name: str, value: Column) -> DataFrame:
    by = [by] if isinstance(by, str) else list(by)
    return pairs.groupBy(*by).agg(value.alias(name))


def peaks(pairs: DataFrame) -> DataFrame:
    """Peak truth ``px`` and prediction ``py`` per event and cell."""
    return pairs.groupBy("run", "cell_id").agg(F.max("x").alias("px"), F.max("y").alias("py"))


# --- all cells, all steps -------------------------------------------------------------------------


def rmse_aoi_toi(pairs: DataFrame, by="run") -> DataFrame:
    return _score(pairs, by, "rmse_aoi_toi", F.sqrt(F.avg(_error() * _error())))


def mae_aoi_toi(pairs: DataFrame, by="run") -> DataFrame:
    return _score(pairs, by, "mae_aoi_toi", F.avg(F.abs(_error())))


def conf_aoi_toi(pairs: DataFrame, by="run") -> DataFrame:
    return _score(pairs, by, "conf_aoi_toi", F.avg("s"))


def err_aoi_toi(pairs: DataFrame, by="run") -> DataFrame:
    return _score(pairs, by, "err_aoi_toi", F.avg(_error()))


def matches(pairs: DataFrame, t_tol: int = 0, v_tol: float = 0.0, width: int = scan.STEP_CHUNK) -> DataFrame:
    """Add ``matched``: truth and prediction agree within ``v_tol``, up to ``t_tol`` steps ahead either way round."""
    hit = F.abs(_error()) <= v_tol
    if t_tol:
        if "_chunk" not in pairs.columns:
            pairs = scan.with_halo(pairs, "t", t_tol, width)
        pairs = scan.ahead_in_chunk(pairs, ["run", "cell_id"], "t", ["x", "y"], t_tol, width)
        for i in range(1, t_tol + 1):
            later = (F.abs(F.col("y") - F.col(f"x_{i}")) <= v_tol) | (F.abs(F.col("x") - F.col(f"y_{i}")) <= v_tol)
            hit = hit | F.coalesce(later, F.lit(False))
    return pairs.withColumn("matched", F.coalesce(hit, F.lit(False)).cast("double"))


def fi_aoi_toi(pairs: DataFrame, by="run", t_tol: int = 0, v_tol: float = 0.0) -> DataFrame:
    """Share of cells and steps the prediction is faithful to."""
    return _score(matches(pairs, t_tol, v_tol), by, "fi_aoi_toi", F.avg("matched"))


# --- peaks ----------------------------------------------------------------------------------------


def _peak_error() -> Column:
    return F.col("px") - F.col("py")


def _hits(threshold: float) -> Column:
    return F.count_if((F.col("px") >= threshold) & (F.col("py") >= threshold))


def _false_alarms(threshold: float) -> Column:
    return F.count_if((F.col("px") < threshold) & (F.col("py") >= threshold))


def _misses(threshold: float) -> Column:
    return F.count_if((F.col("px") >= threshold) & (F.col("py") < threshold))


def _peak_scores(threshold: float) -> dict[str, Column]:
    a, b, c = _hits(threshold), _false_alarms(threshold), _misses(threshold)
    return {
        "rmse_aoi_mts": F.sqrt(F.avg(_peak_error() * _peak_error())),
        "nse_aoi_mts": F.lit(1.0)
        - F.try_divide(F.sum(_peak_error() * _peak_error()), F.var_pop("px") * F.count(F.lit(1))),
        "err_aoi_mts": F.avg(_peak_error()),
        "pod_mts": F.try_divide(a, a + c),
        "rfa_mts": F.try_divide(b, a + b),
        "csi_mts": F.try_divide(a, a + b + c),
        "f2_mts": F.coalesce(F.try_divide(a - c, a + b + c), F.lit(1.0)),
        "f3_mts": F.coalesce(F.try_divide(a - b, a + b + c), F.lit(1.0)),
    }


def _peak_metric(name: str):
    def metric(pairs: DataFrame, by="run", threshold: float = 0.0) -> DataFrame:
        return _score(peaks(pairs), by, name, _peak_scores(threshold)[name])

    metric.__name__ = name
    return metric


rmse_aoi_mts = _peak_metric("rmse_aoi_mts")
nse_aoi_mts = _peak_metric("nse_aoi_mts")
err_aoi_mts = _peak_metric("err_aoi_mts")
pod_mts = _peak_metric("pod_mts")
rfa_mts = _peak_metric("rfa_mts")
csi_mts = _peak_metric("csi_mts")
f2_mts = _peak_metric("f2_mts")
f3_mts = _peak_metric("f3_mts")


# --- per step, per cell ---------------------------------------------------------------------------


def rmse_aoi_ts(pairs: DataFrame, by=("run", "t")) -> DataFrame:
    return _score(pairs, by, "rmse_aoi_ts", F.sqrt(F.avg(_error() * _error())))


def err_aoi_ts(pairs: DataFrame, by=("run", "t")) -> DataFrame:
    return _score(pairs, by, "err_aoi_ts", F.avg(_error()))


def conf_aoi_ts(pairs: DataFrame, by=("run", "t")) -> DataFrame:
    return _score(pairs, by, "conf_aoi_ts", F.avg("s"))


def rmse_cell_toi(pairs: DataFrame, by=("run", "cell_id")) -> DataFrame:
    return _score(pairs, by, "rmse_cell_toi", F.sqrt(F.avg(_error() * _error())))


def err_cell_mts(pairs: DataFrame, by=("run", "cell_id")) -> DataFrame:
    return _score(pairs, by, "err_cell_mts", F.max("x") - F.max("y"))


def err_cell_toi(pairs: DataFrame, by=("run", "cell_id")) -> DataFrame:
    return _score(pairs, by, "err_cell_toi", F.avg(_error()))


def conf_cell_toi(pairs: DataFrame, by=("run", "cell_id")) -> DataFrame:
    return _score(pairs, by, "conf_cell_toi", F.avg("s"))


# --- the whole suite ------------------------------------------------------------------------------


@dataclass
class MetricTables:
    """Three result tables that share one cached aggregate; ``release`` frees it."""

    scalar: DataFrame
    timeseries: DataFrame
    cell: DataFrame
    base: DataFrame

    def release(self) -> None:
        self.base.unpersist()


def _filed_pairs(truth: DataFrame, pred: DataFrame, t_tol: int) -> DataFrame:
    """Pairs partitioned by run, cell and chunk of steps, which join, look-ahead and sums all share.

    A cell's steps then lie together, so the per-cell and per-step sums are
    almost complete before they are shuffled.
    """

    def filed(df: DataFrame) -> DataFrame:
        chunked = scan.with_halo(df, "t", t_tol) if t_tol else df.withColumn("_chunk", scan.chunk_of("t"))
        return chunked.repartition("run", "cell_id", "_chunk")

    x = truth.select("run", "t", "cell_id", F.col("value").alias("x"))
    y = pred.select("run", "t", "cell_id", F.col("value").alias("y"), F.col("sd").alias("s"))
    # As in ``pair``, never broadcast.
    return filed(x).join(filed(y).hint("merge"), ["run", "cell_id", "_chunk", "t"])


def metric_suite(
    truth: DataFrame,
    pred: DataFrame,
    conf: DataFrame | None = None,
    threshold: float = 0.5,
    t_tol: int = 0,
    v_tol: float = 0.0,
    parameter: str = "depth",
    cache: bool = True,
) -> MetricTables:
    """All 20 metrics at their three grains from one pass over the pairs.

    Grouping sets give the per-step and the per-cell sums together; the event
    scores are sums over the per-cell rows, so the raw pairs are read once.
    """
    if conf is None and shares_partitioning(truth.sparkSession):
        pairs = _filed_pairs(truth, pred, t_tol)
    else:
        pairs = pair(truth, pred, conf)
    pairs = matches(pairs, t_tol, v_tol)
    e = _error()
    base = pairs.groupingSets([["run", "t"], ["run", "cell_id"]], "run", "t", "cell_id").agg(
        F.grouping("t").alias("by_cell"),
        F.count(F.lit(1)).alias("n"),
        F.sum(e).alias("e1"),
        F.sum(e * e).alias("e2"),
        F.sum(F.abs(e)).alias("ea"),
        F.sum("s").alias("sd"),
        F.sum("matched").alias("hits"),
        F.max("x").alias("px"),
        F.max("y").alias("py"),
    )
    if cache:
        base = base.persist(StorageLevel.MEMORY_AND_DISK)
    cells = base.where(F.col("by_cell") == 1)
    total = F.sum("n")
    scores = _peak_scores(threshold)
    if parameter == "velocity":
        for name in ("pod_mts", "rfa_mts", "csi_mts"):
            scores[name] = F.lit(None).cast("double")
    scalar = cells.groupBy(F.col("run").alias("event")).agg(
        F.sqrt(F.sum("e2") / total).alias("rmse_aoi_toi"),
        (F.sum("ea") / total).alias("mae_aoi_toi"),
        (F.sum("sd") / total).alias("conf_aoi_toi"),
        scores["rmse_aoi_mts"].alias("rmse_aoi_mts"),
        scores["nse_aoi_mts"].alias("nse_aoi_mts"),
        (F.sum("e1") / total).alias("err_aoi_toi"),
        scores["err_aoi_mts"].alias("err_aoi_mts"),
        (F.sum("hits") / total).alias("fi_aoi_toi"),
        *[scores[name].alias(name) for name in CONTINGENCY],
    )
    timeseries = base.where(F.col("by_cell") == 0).select(
        F.col("run").alias("event"),
        F.col("t").alias("timestep"),
        F.sqrt(F.col("e2") / F.col("n")).alias("rmse_aoi_ts"),
        (F.col("e1") / F.col("n")).alias("err_aoi_ts"),
        (F.col("sd") / F.col("n")).alias("conf_aoi_ts"),
    )
    cell = cells.select(
        F.col("run").alias("event"),
        "cell_id",
        F.sqrt(F.col("e2") / F.col("n")).alias("rmse_cell_toi"),
        (F.col("px") - F.col("py")).alias("err_cell_mts"),
        (F.col("e1") / F.col("n")).alias("err_cell_toi"),
        (F.col("sd") / F.col("n")).alias("conf_cell_toi"),
    )
    return MetricTables(scalar, timeseries, cell, base)


def detection_categories(pairs: DataFrame, wet_threshold: float = 0.0, include_negative: bool = False) -> DataFrame:
    """Detected, Miss, False Alarm or Correct Negative per event and cell; negative peaks are an error."""
    checked = peaks(pairs).where(
        F.when((F.col("px") < 0) | (F.col("py") < 0), F.raise_error(F.lit("depths must not be negative")).cast("boolean"))
        .otherwise(F.lit(True))
    )
    wet = checked.withColumns(
        {c: F.when(F.col(c) < wet_threshold, F.lit(0.0)).otherwise(F.col(c)) for c in ("px", "py")}
    )
    x, y = F.col("px"), F.col("py")
    category = (
        F.when((x > 0) & (y > 0), F.lit("Detected"))
        .when((x > 0) & (y == 0), F.lit("Miss"))
        .when((x == 0) & (y > 0), F.lit("False Alarm"))
    )
    if include_negative:
        category = category.when((x == 0) & (y == 0), F.lit("Correct Negative"))
    return wet.select("run", "cell_id", F.coalesce(category, F.lit("")).alias("detection_category"))


def overall_rmse(lf: DataFrame, hf: DataFrame, pred: DataFrame) -> DataFrame:
    """One number each for the raw and the upskilled low-fidelity values."""
    joined = pair(hf, pred, lf).withColumnRenamed("s", "l")
    lf_err, up_err = F.col("l") - F.col("x"), _error()
    return joined.agg(
        F.sqrt(F.avg(lf_err * lf_err)).alias("lf_rmse"), F.sqrt(F.avg(up_err * up_err)).alias("upskill_rmse")
    )
