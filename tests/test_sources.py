import json

import pytest
from pyspark.sql import functions as F

from freshet.functions import exprs, scan
from freshet.operators import filters
from freshet.schema import Dataset
from freshet.sources import catalogue, dataset, gather, grids


def test_data_set_is_built_once(spark, tmp_path):
    rows = [(r, t, c, float(t * c)) for r in "ab" for t in range(3) for c in range(4)]
    series = spark.createDataFrame(rows, "run string, t int, cell_id int, value double")
    info = spark.createDataFrame([(c, c, 1.0, 2.0, [{"x": 0.0, "y": 0.0}]) for c in range(4)], "cell_id int, lf_cell_id int, elevation double, area double, ring array<struct<x double, y double>>")
    lines = spark.createDataFrame([("a", 0, "us", 1.0, 2.0)], "run string, t int, line string, flow double, wse double")
    calls = []

    def build():
        calls.append(1)
        return Dataset(series, series, info, lines)

    path = str(tmp_path / "ds")
    assert not dataset.is_complete(spark, path)
    for _ in range(2):
        back = dataset.materialize(spark, path, build)
    assert len(calls) == 1 and back.hf.count() == 24
    plan = back.hf.where("run = 'a'").select("t")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in plan and "ReadSchema: struct<t:int>" in plan


def test_plan_list_and_folds(spark, tmp_path):
    rows = [{"plan_title": f"gpr{i}", "event_number": i, "type": "Train" if i % 3 else "Test", "set": ("Test", "AEP", "Diverse")[i % 3]} for i in range(9)]
    (tmp_path / "plans.json").write_text(json.dumps(rows, indent=1))
    p = catalogue.plans(spark, str(tmp_path / "plans.json"))
    assert p.count() == 9 and catalogue.plans(spark, str(tmp_path / "plans.json"), "Test").count() == 3
    assert {r["set"] for r in catalogue.fold(p, "train").collect()} == {"AEP"}
    assert {r["set"] for r in catalogue.fold(p, "test").collect()} == {"Diverse"}


def test_catalogue_round_trip(spark):
    rows = [(12, 14.055, 2.675, 1.005, 2000.5, "Train", "Max"), (7, 1.0, 2.0, 3.0, 4.0, "Test", "Test")]
    df = spark.createDataFrame(rows, "event_id long, precip_cum double, inflow double, rp_precip double, rp_inflow double, type string, set string")
    text = catalogue.plans_to_catalogue(df, "s3://store").first()["catalogue"]
    item = json.loads(text)
    assert item["properties"] == {"datetime": None, "train_event_count": 1, "test_event_count": 1} and item["links"] == []
    assert list(item["assets"]) == ["7", "12"]
    asset = item["assets"]["12"]
    assert asset["href"] == "s3://store/12/hydrology/SST.dss" and asset["roles"] == ["Train"]
    assert asset["properties"]["avg_precip_in"] == round(14.055, 2) and asset["properties"]["peak_inflow_cfs"] == round(2.675, 2)
    again = catalogue.catalogue_to_plans(spark.createDataFrame([(json.dumps(item["assets"]),)], "assets string")).collect()
    assert [(r["plan_title"], r["event_number"], r["type"], r["set"]) for r in again] == [("gpr1", 7, "Test", "Test"), ("gpr2", 12, "Train", "Max")]


def test_unreadable_times_fail(spark):
    df = spark.createDataFrame([("01JAN2000:2400",)], "s string")
    with pytest.raises(Exception):
        df.select(exprs.parse_model_time("s")).collect()
    good = spark.createDataFrame([("05mar1999 01:02:03.5",)], "s string").select(exprs.parse_model_time("s").cast("string")).first()[0]
    assert good == "1999-03-05 01:02:03.5"


def test_events_without_a_match_vanish(spark):
    df = spark.createDataFrame([(1, 1, "//A/FLOW/x/"), (1, 0, "//a/flow/y/"), (2, 0, "//B/FLOW/"), (3, 0, "//A/STAGE/")], "event_id long, ord int, path string")
    got = gather.choose_records(df, {"inflow": ("A", "Flow")}).collect()
    assert [(r["event_id"], r["path"]) for r in got] == [(1, "//a/flow/y/")]


def test_pixels_are_numbered_row_by_row(spark):
    mask = spark.createDataFrame([(1, 2), (0, 1), (1, 0), (70, 0)], "row int, col int")
    got = {(r["row"], r["col"]): r["feature"] for r in grids.number_pixels(mask).collect()}
    assert got == {(0, 1): "precip_0", (1, 0): "precip_1", (1, 2): "precip_2", (70, 0): "precip_3"}


def test_mixed_geometries_fail(spark):
    runs = spark.createDataFrame([("a", "g1"), ("b", "g2")], "run string, geometry string")
    with pytest.raises(Exception, match="more than one geometry"):
        filters.single_geometry(runs).collect()
    assert filters.single_geometry(runs.where("run = 'a'")).count() == 1


def test_tiny_areas_are_dropped_by_absolute_size(spark):
    df = spark.createDataFrame([(1, 1e-9), (2, 1e-4), (3, float("nan")), (4, None)], "cell_id int, area double")
    assert [r["cell_id"] for r in filters.valid_area(df).collect()] == [2]


def test_sparse_step_labels_become_dense(spark):
    df = spark.createDataFrame([("a", 5, 1.0), ("a", 9, 2.0), ("a", 5, 3.0), ("b", 7, 4.0)], "run string, step int, v double")
    got = sorted((r["run"], r["v"], r["t"]) for r in scan.index_steps(df, ["run"], "step").collect())
    assert got == [("a", 1.0, 0), ("a", 2.0, 1), ("a", 3.0, 0), ("b", 4.0, 0)]


def test_unknown_fields_and_tables_fail(spark):
    from freshet.sources import metric_tables

    df = spark.createDataFrame([("a", 1, 0.5)], "event string, cell_id int, rmse double")
    with pytest.raises(ValueError, match="not present"):
        metric_tables.select_metric(df, ["nse"])
    with pytest.raises(ValueError, match="not found"):
        metric_tables.read_metric(spark, "x", "other")
    assert metric_tables.select_metric(df, ["rmse"]).columns == ["event", "cell_id", "rmse"]
    assert df.select(F.lit(1)).count() == 1
