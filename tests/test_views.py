"""Tables that Spark keeps of the views."""

from pyspark.sql import functions as F

from workload import views

SF = "/root/testdata/sf0.001"


def test_cells_are_those_of_the_view(spark):
    views.tune(spark)
    order = ["run", "cell_id", "t"]

    def rows(df):
        return df.select("run", "t", "cell_id", *[F.round(c, 9).alias(c) for c in ("elevation", "hf", "lf")]).orderBy(*order).collect()

    want = views._formatted(spark, SF, views._text("cells", True))
    got = views._formatted(spark, SF, views.STORED_TEXT["cells"])
    assert got.dtypes == want.dtypes
    assert rows(got) == rows(want)


def test_cells_are_not_sorted_run_by_run(spark):
    """A join by run alone put all steps of a run's cells in one task."""
    views.tune(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = getattr(views, "STORED_TEXT", {}).get("cells") or views._text("cells", True)
        plan = views._formatted(spark, SF, text)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "Sort [" not in plan
