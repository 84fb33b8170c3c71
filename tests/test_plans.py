"""Shape of physical plans."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from freshet.operators import metrics, spatial, windows
from workload.views import view

SF = "/root/testdata/sf0.001"
LAZY = (
    "rmse_aoi_toi", "nse_aoi_mts", "fi_aoi_toi", "metric_suite_scalar", "metric_map", "largest_overlap", "triangle_weights",
    "cell_stations", "link_boundaries", "rasterize", "event_hour", "block_maxima", "api", "rank_candidates", "sample_log_bins",
    "to_modes", "to_cells", "centreline_profile", "explode_grid", "gather_event_series", "align", "cutoffs", "interp_linear",
)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pairwise_joins(spark, name):
    plan = plan_of(queries()[name](spark, SF))
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_suite_shuffles_the_series_once_per_side(spark, no_broadcast):
    cells = view(spark, SF, "cells")
    truth = cells.select("run", "t", "cell_id", F.col("hf").alias("value"))
    pred = cells.select("run", "t", "cell_id", F.col("lf").alias("value"), F.lit(0.1).alias("sd"))
    for t_tol in (0, 2):
        plan = plan_of(metrics.metric_suite(truth, pred, t_tol=t_tol, cache=False).scalar)
        shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
        # Two inputs by (run, cell, chunk), one of per-group sums, one of per-run sums.
        assert len(shuffles) == 4, shuffles


def test_rank_limit_is_applied_before_the_shuffle(spark):
    plan = plan_of(queries()["rank_candidates"](spark, SF))
    assert re.search(r"WindowGroupLimit.*Partial", plan)


def test_area_box_reaches_the_scan(spark, tmp_path):
    view(spark, SF, "hf_mesh").write.parquet(str(tmp_path / "mesh"))
    mesh = spark.read.parquet(str(tmp_path / "mesh"))
    plan = plan_of(spatial.within_aoi(mesh, [(1.0, 1.0), (5.0, 1.0), (5.0, 3.0), (1.0, 3.0)]).select("cell_id"))
    assert "LessThanOrEqual(x0,5.0)" in plan and "elevation" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_step_change_of_short_series_shuffles_once(spark, no_broadcast):
    cells = view(spark, SF, "cells").select("run", F.col("cell_id").cast("string").alias("series"), "t", F.col("hf").alias("value"))
    plan = plan_of(windows.step_change(cells))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


@pytest.mark.parametrize("name", ["cell_stations", "centreline_cells", "profile_by_station"])
def test_filed_boxes_are_not_broadcast(spark, name):
    """A side filed in grid bins has many times the rows its estimated size stands for."""
    plan = plan_of(queries()[name](spark, SF))
    filed = [line for line in plan.split("\n") if re.search(r"(Join|SortMergeJoin).*\[_(level|bx)#", line)]
    assert filed and all("SortMergeJoin" in line for line in filed), filed


def test_steps_are_not_shuffled_by_run_alone(spark, no_broadcast):
    """A join by run put all steps of a run in one task and kept them there."""
    cells = view(spark, SF, "cells").select("run", F.col("cell_id").cast("string").alias("series"), "t", F.col("hf").alias("value"))
    cuts = cells.groupBy("run").agg(F.min("t").alias("start"), F.max("t").alias("stop"))
    for made in (windows.trim_at_nan(cells), windows.clip(cells, cuts)):
        assert "SortMergeJoin" not in plan_of(made)
