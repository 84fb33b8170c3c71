"""Rows of steps and cells compress so well that a task must not be measured by its shuffle files alone."""

import os

from pyspark.sql import functions as F

from freshet.operators import joins, surfaces
from freshet.schema import Dataset
from freshet.session import tune
from freshet.sources import dataset


def cells(spark, steps, n):
    i = F.col("id")
    return spark.range(steps * n).select(
        F.lit("a").alias("run"), (i % steps).cast("int").alias("t"), F.floor(i / steps).cast("int").alias("cell_id"), (i % 10).cast("double").alias("value")
    )


def test_alignment_is_split_below_the_partitions_of_the_session(spark):
    tune(spark)
    got = joins.align(cells(spark, 1000, 1000), cells(spark, 1000, 1000))
    rows = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(rows) == 1_000_000
    assert max(rows) < 200_000  # four partitions held 250,000 each


def test_a_long_line_is_written_by_several_tasks(spark, tmp_path):
    tune(spark)
    lines = spark.range(400_000).select(
        F.lit("a").alias("run"), F.col("id").cast("int").alias("t"), F.lit("us").alias("line"), F.rand(1).alias("flow"), F.rand(2).alias("wse")
    )
    few = cells(spark, 3, 3)
    info = spark.createDataFrame([(0, 0, 1.0, 1.0, None)], "cell_id int, lf_cell_id int, elevation double, area double, ring array<struct<x:double,y:double>>")
    dataset.write_dataset(Dataset(few, few, info, lines), str(tmp_path))
    assert sum(f.endswith(".parquet") for f in os.listdir(tmp_path / "ref_lines" / "run=a")) > 1
    assert dataset.read_dataset(spark, str(tmp_path)).ref_lines.count() == 400_000


def test_surface_multiplies_steps_after_the_last_shuffle(spark, monkeypatch):
    tune(spark)
    monkeypatch.setattr(joins, "DENSE_ROWS", 1000)
    knots, coefs = [0.0] * 4 + [150.0, 300.0] + [450.0] * 4, [0.0, 50.0, 150.0, 300.0, 400.0, 450.0]
    ratings = spark.createDataFrame([(s, 0.0, 450.0, knots, coefs) for s in ("us", "ds")], "site string, q_min double, q_max double, knots array<double>, coefs array<double>")
    i = F.col("id")
    frac = spark.range(2).select(i.cast("int").alias("cell_id"), (i / 2).alias("frac"))
    mesh = spark.range(20).select(i.cast("int").alias("cell_id"), (i % 2).cast("int").alias("near_id"), F.lit(1.0).alias("elevation"))
    inflow = spark.range(1000).select(F.lit("a").alias("run"), F.col("id").cast("int").alias("t"), (F.col("id") % 400 + 10).cast("double").alias("us_flow"), F.lit(5.0).alias("ds_flow"))
    flows = joins.deal_steps(inflow, 20)
    assert flows.rdd.getNumPartitions() == 20
    other = joins.pair_up(flows.select("run", "t"), mesh.select("cell_id", F.lit(2.0).alias("value")))
    got = surfaces.pseudo_surface(flows, ratings, frac, mesh.select("cell_id", "near_id"), mesh, other)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(run" in line and "cell_id" in line.split(", REPART")[0].split(", ENSURE")[0]]
    rows = {(r["t"], r["cell_id"]): r["value"] for r in got.collect()}
    assert len(rows) == 20_000
    assert abs(rows[7, 0] - 17.0) < 1e-9
    assert abs(rows[7, 1] - 11.0) < 1e-9
