"""Grouped summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions import scan
from freshet.functions.exprs import depth, feature_class
from freshet.functions.quantiles import exact_quantiles
from freshet.operators.filters import finite
from freshet.operators.joins import with_scalars


def wetness_class(df: DataFrame, threshold: float = 0.03, parameter: str = "wse") -> DataFrame:
    """AD (always dry), TF (transitionally flooded) or AF (always flooded) per cell.

    A cell whose extreme depth equals the threshold exactly keeps an empty class.
    """
    if parameter == "velocity":
        return df.select("cell_id").distinct().withColumn("wetness", F.lit("TF"))
    d = depth("value", "elevation") if parameter == "depth" else F.col("value") - F.col("elevation")
    extremes = df.groupBy("cell_id").agg(F.max(d).alias("hi"), F.min(d).alias("lo"))
    wetness = (
        F.when(F.col("lo") > threshold, F.lit("AF"))
        .when(F.col("hi") > threshold, F.lit("TF"))
        .when(F.col("hi") < threshold, F.lit("AD"))
        .otherwise(F.lit(""))
    )
    return extremes.select("cell_id", wetness.alias("wetness"))


def event_maxima(df: DataFrame) -> DataFrame:
    return df.groupBy("event_id").agg(F.max("precip_cum").alias("precip_cum"), F.max("inflow").alias("inflow"))


def extreme_events(maxima: DataFrame) -> DataFrame:
    """Events with the largest rainfall period, inflow period and joint scaled size, without repeats."""
    limits = maxima.agg(
        *[f(c).alias(f"_{n}_{c}") for c in ("precip_cum", "inflow") for n, f in (("lo", F.min), ("hi", F.max))]
    )

    def scaled(c: str):
        return F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))

    sized = with_scalars(maxima, limits).withColumn("_joint", scaled("precip_cum") + scaled("inflow"))

    def largest(c: str):
        known = F.when(~F.isnan(c), F.struct(F.col(c), -F.col("event_id")))
        return F.max_by(F.when(known.isNotNull(), F.col("event_id")), known)

    picks = sized.agg(
        F.array(largest("rp_precip"), largest("rp_inflow"), largest("_joint")).alias("_ids")
    ).select(F.posexplode("_ids").alias("rank", "event_id"))
    return (
        picks.where(F.col("event_id").isNotNull())
        .groupBy("event_id")
        .agg(F.min("rank").cast("int").alias("rank"))
        .withColumn("set", F.lit("Max"))
    )


def feature_stats(df: DataFrame, by: Sequence[str] = ("feature",), value: str = "value") -> DataFrame:
    """Mean and population standard deviation."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def nonzero_std(df: DataFrame, by: Sequence[str] = ("feature",), value: str = "value") -> DataFrame:
    """Population standard deviation of the values that are not zero."""
    return df.groupBy(*by).agg(F.stddev_pop(F.when(F.col(value) != 0, F.col(value))).alias("std"))


def mean_rainfall(df: DataFrame) -> DataFrame:
    """Mean over all rainfall pixels per run and step."""
    rain = df.where(feature_class("feature") == "precip")
    return rain.groupBy("run", "t").agg(F.avg("value").alias("rain"))


def wide_lines(bc: DataFrame, us: str, ds: str) -> DataFrame:
    """Flow and level of the upstream and downstream line side by side."""
    picked = bc.where(F.col("line").isin(us, ds))
    return picked.groupBy("run", "t").agg(
        *[
            F.max(F.when(F.col("line") == line, F.col(c))).alias(f"{tag}_{c}")
            for tag, line in (("us", us), ("ds", ds))
            for c in ("flow", "wse")
        ]
    )


def centreline_fraction(bc: DataFrame, cells: DataFrame, us: str, ds: str) -> DataFrame:
    """Median relative drop from the upstream level per centreline cell, over steps with any flow."""
    flowing = wide_lines(bc, us, ds).where((F.col("us_flow") > 0) | (F.col("ds_flow") > 0))
    drop = F.try_divide(F.col("us_wse") - F.col("value"), F.col("us_wse") - F.col("ds_wse"))
    drops = cells.join(flowing, ["run", "t"]).select("cell_id", drop.alias("drop"))
    return exact_quantiles(drops, ["cell_id"], "drop", [0.5]).select("cell_id", F.col("q")[0].alias("frac"))


def quantile_knots(df: DataFrame, k: int = 7, by: Sequence[str] = ("site",), value: str = "flow") -> DataFrame:
    """Interior knots at equally spaced quantiles."""
    probs = [i / (k + 1) for i in range(1, k + 1)]
    return exact_quantiles(df, by, value, probs, "knots")


def fit_stats(df: DataFrame, by: Sequence[str] = ("site",), fitted: str = "fitted", observed: str = "wse") -> DataFrame:
    residual = F.col(fitted) - F.col(observed)
    return df.groupBy(*by).agg(F.sqrt(F.avg(residual * residual)).alias("rmse"), F.avg(F.abs(residual)).alias("mae"))


def inducing_grid(df: DataFrame, m: int, by: Sequence[str] = ("feature",), value: str = "value") -> DataFrame:
    """``m`` equally spaced points between the smallest and largest value of each feature."""
    extremes = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    points = extremes.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    share = F.col("point") / F.lit(float(max(m - 1, 1)))
    return points.select(*by, "point", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * share).alias("z"))


def initial_lengthscale(df: DataFrame, value: str = "value") -> DataFrame:
    return df.agg(F.avg(F.abs(F.col(value))).alias("lengthscale"))


def error_cdf(
    df: DataFrame, points: Sequence[float] | None = None, by: Sequence[str] = ("model",), col: str = "abs_error"
) -> DataFrame:
    """Cumulative distribution of absolute errors.

    With ``points`` (percents) the error at each of them; without, the whole
    curve as one row per distinct error with the percents of its first and
    last occurrence in the sorted list.
    """
    if points is not None:
        found = exact_quantiles(df, by, col, [p / 100 for p in points])
        pct = F.array(*[F.lit(float(p)) for p in points])
        return found.select(*by, F.inline(F.arrays_zip(pct.alias("pct"), F.col("q").alias(col))))
    counted = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy(*by).agg(F.sum("n").alias("_total"))
    bucket = scan.bucket_of(col, scan.quantile_bounds(counted, col))
    running = scan.running_sum(counted, by, [col], bucket, {"_upto": "n"}).join(totals, list(by))

    def percent(rank):
        return F.coalesce(F.try_divide(F.lit(100.0) * rank, F.col("_total") - 1), F.lit(0.0))

    return running.select(
        *by, col, "n", percent(F.col("_upto") - F.col("n")).alias("pct_first"), percent(F.col("_upto") - 1).alias("pct_last")
    )


def box_summary(df: DataFrame, field: str, by: Sequence[str] = ("event",)) -> DataFrame:
    """Minimum, quartiles, maximum and count of the finite values per event."""
    usable = df.where(finite(field))
    quartiles = exact_quantiles(usable, by, field, [0.0, 0.25, 0.5, 0.75, 1.0])
    counts = usable.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    names = ("lo", "q1", "median", "q3", "hi")
    return counts.join(quartiles, list(by)).select(*by, "n", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def steps_per_event(timeseries: DataFrame) -> DataFrame:
    return timeseries.groupBy("event").agg(F.count(F.lit(1)).alias("n_steps"))


def event_bounds(df: DataFrame) -> DataFrame:
    return df.groupBy("event_id").agg(F.min("datetime").alias("start_time"), F.max("datetime").alias("end_time"))


def role_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(F.col("type") == "Train").alias("train_event_count"),
        F.count_if(F.col("type") == "Test").alias("test_event_count"),
    )


def axis_limits(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Whole-number limits that hold every chosen metric."""
    lows, highs = [F.min(f) for f in fields], [F.max(f) for f in fields]
    lo = lows[0] if len(fields) == 1 else F.least(*lows)
    hi = highs[0] if len(fields) == 1 else F.greatest(*highs)
    return df.agg(F.floor(lo).cast("double").alias("lo"), F.ceil(hi).cast("double").alias("hi"))


def eigen_summary(eigs: DataFrame, n: int, k: int) -> DataFrame:
    """Eigenvalues with their sampling error and whether the mode is kept."""
    stderr = F.lit((2.0 / n) ** 0.5) * F.col("eigenvalue")
    return eigs.select(
        "mode",
        "eigenvalue",
        stderr.alias("stderr"),
        (F.col("eigenvalue") - stderr).alias("low"),
        (F.col("eigenvalue") + stderr).alias("high"),
        (F.col("mode") < k).alias("selected"),
    )


def norths_rule(eigs: DataFrame, n: int) -> DataFrame:
    """Number of modes above 1 that lie before the first gap within sampling error.

    A hit on the very first gap, or none at all, keeps every mode above 1.
    """
    above = eigs.where(F.col("eigenvalue") > 1)
    following = F.lead("eigenvalue").over(Window.orderBy(F.col("eigenvalue").desc(), "mode"))
    position = F.row_number().over(Window.orderBy(F.col("eigenvalue").desc(), "mode")) - 1
    gaps = above.select("eigenvalue", following.alias("following"), position.alias("position"))
    error = F.lit((2.0 / n) ** 0.5) * F.col("eigenvalue")
    close = F.abs(F.col("following") - F.col("eigenvalue")) <= error
    found = gaps.agg(F.count(F.lit(1)).alias("kept"), F.min(F.when(close, F.col("position"))).alias("gap"))
    return found.select(
        F.when(F.coalesce(F.col("gap"), F.lit(0)) == 0, F.col("kept")).otherwise(F.col("gap")).cast("int").alias("modes")
    )
