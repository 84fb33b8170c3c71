"""Joins that queries put before a model."""

from workload.q_models import on_steps


def test_steps_of_another_table_do_not_shuffle_the_series(spark):
    """A plain semi join by step dealt out every row of the series anew in each pass over it."""
    series = spark.range(6000).selectExpr("concat('r', id % 3) AS run", "CAST(id % 20 AS INT) AS t", "id AS cell_id", "id * 0.5 AS value")
    other = spark.range(900).selectExpr("concat('r', id % 2) AS run", "CAST(id % 13 * 2 AS INT) AS t", "id AS feature")
    want = series.join(other.select("run", "t").distinct(), ["run", "t"], "left_semi")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = on_steps(series, other)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
        assert got.columns == series.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert 0 < got.count() < series.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
