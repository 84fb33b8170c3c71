"""Numbers behind the diagnostic charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions import scan
from freshet.operators.joins import pair
from freshet.operators.windows import step_change, trim_at_nan


def mode_pairs(x: DataFrame, y: DataFrame, n: int) -> DataFrame:
    """Every low-fidelity mode against every high-fidelity mode below ``n``, per run and step."""
    low = x.where(F.col("mode") < n).select("run", "t", F.col("mode").alias("i"), F.col("z").alias("lf"))
    high = y.where(F.col("mode") < n).select("run", "t", F.col("mode").alias("j"), F.col("z").alias("hf"))
    return low.join(high, ["run", "t"])


def mode_pair_limits(x: DataFrame, y: DataFrame, n: int) -> DataFrame:
    """Ends of the 1:1 line of each mode."""
    both = x.select("mode", "z").unionByName(y.select("mode", "z")).where(F.col("mode") < n)
    return both.groupBy("mode").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))


def scatter_bins(lf: DataFrame, hf: DataFrame, pred: DataFrame, width: float) -> DataFrame:
    """Counts per square bin of estimate against truth, for the raw and the upskilled model."""
    joined = pair(hf, pred, lf).withColumnRenamed("s", "l")
    both = joined.select(
        "x", F.inline(F.array(
            F.struct(F.lit("lf").alias("model"), F.col("l").alias("est")),
            F.struct(F.lit("upskill").alias("model"), F.col("y").alias("est")),
        ))
    )
    error = F.col("est") - F.col("x")
    return both.groupBy(
        "model", F.floor(F.col("est") / width).alias("est_bin"), F.floor(F.col("x") / width).alias("hf_bin")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(error * error).alias("sse"))


def clipping_trace(series: DataFrame, cuts: DataFrame) -> DataFrame:
    """Mean change and mean cumulative change per step, with the zoom range around the cut-offs.

    Series that never change are left out.
    """
    changes = step_change(trim_at_nan(series))
    moving = changes.groupBy("run", "series").agg(F.max("change").alias("_top")).where(F.col("_top") > 0)
    counts = moving.groupBy("run").agg(F.count(F.lit(1)).alias("_series"))
    # A series that never changes adds 0 to every sum, so the sums need no filter.
    per_step = changes.groupBy("run", "t").agg(F.sum("change").alias("_change"))
    running = scan.running_sum(per_step, ["run"], ["t"], scan.chunk_of("t"), {"_upto": "_change"})
    margin = F.floor((F.col("stop") - F.col("start")) / 10).cast("int")
    return (
        running.join(counts, "run").join(cuts, "run").select(
            "run", "t",
            F.try_divide("_change", "_series").alias("mean_change"),
            F.try_divide("_upto", "_series").alias("mean_cumulative"),
            (F.col("start") - margin).alias("zoom_from"),
            (F.col("stop") + margin).alias("zoom_to"),
        )
    )


def profile_by_station(stations: DataFrame, frac: DataFrame) -> DataFrame:
    """Percent drop of the water surface against the distance along the centreline."""
    return stations.join(frac, "cell_id").select("cell_id", "station", (F.col("frac") * 100).alias("pct_drop"))
