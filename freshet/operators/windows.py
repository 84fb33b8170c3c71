"""Operators that depend on the order of steps, events or values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions import scan
from freshet.operators.joins import with_scalars
from freshet.session import cut_lineage

WARM_UP_SHARE = 10e-4


def step_change(df: DataFrame, keys: Sequence[str] = ("run", "series"), width: int = scan.STEP_CHUNK) -> DataFrame:
    """Absolute change to the next step as a share of the series' total change.

    ``t`` is the dense step index of the run. A series that never changes has
    change 0 throughout.
    """
    longest = df.agg(F.max("t")).first()[0]
    if longest is not None and longest < width:
        # Every series is one chunk, so its total is taken in the same window partition and one shuffle is enough.
        order = Window.partitionBy(*keys).orderBy(F.col("t").cast("long")).rangeBetween(1, 1)
        deltas = df.select(*keys, "t", F.abs(F.first("value").over(order) - F.col("value")).alias("_delta"))
        summed = deltas.withColumn("_total", F.sum("_delta").over(Window.partitionBy(*keys)))
        summed = summed.where(F.col("_delta").isNotNull())
    else:
        ahead = scan.look_ahead(df, keys, "t", ["value"], 1, width, keep_chunk=True)
        deltas = ahead.select(*keys, "t", "_chunk", F.abs(F.col("value_1") - F.col("value")).alias("_delta"))
        # A chunk's total is taken where its rows are; totals of the chunks of a series meet as one row each.
        here = Window.partitionBy(*keys, "_chunk")
        deltas = deltas.withColumns({"_part": F.sum("_delta").over(here), "_first": F.col("t") == F.min("t").over(here)})
        parts = deltas.where("_first").groupBy(*keys).agg(F.sum("_part").alias("_total"))
        summed = deltas.where(F.col("_delta").isNotNull()).join(parts, list(keys))
    share = F.when(F.col("_total") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("_delta"), F.col("_total")))
    return summed.select(*keys, "t", share.alias("change"))


def all_series(hf: DataFrame, lf: DataFrame) -> DataFrame:
    """High- and low-fidelity series of a run in one table, told apart by prefix."""

    def tagged(df: DataFrame, prefix: str) -> DataFrame:
        label = "cell_id" if "cell_id" in df.columns else "feature"
        return df.select("run", F.concat(F.lit(prefix), F.col(label).cast("string")).alias("series"), "t", "value")

    return tagged(hf, "hf_").unionByName(tagged(lf, "lf_"))


def trim_at_nan(df: DataFrame) -> DataFrame:
    """Keep the steps before the first missing value of any series of the run."""
    missing = F.col("value").isNull() | F.isnan("value")
    ends = df.groupBy("run").agg(F.min(F.when(missing, F.col("t"))).alias("_end"))
    # One row a run goes to every task: a shuffle by run would put all steps of a run in one, and later windows would keep them there.
    kept = df.join(F.broadcast(ends), "run").where(F.col("_end").isNull() | (F.col("t") < F.col("_end")))
    return kept.drop("_end")


def change_profile(series: DataFrame) -> DataFrame:
    """Share of all change that happens at each step of a run, and its running sum."""
    # Small (one row per run and step) and read several times below.
    per_step = cut_lineage(step_change(series).groupBy("run", "t").agg(F.sum("change").alias("_change")))
    totals = per_step.groupBy("run").agg(F.sum("_change").alias("_total"))
    share = F.try_divide(F.col("_change"), F.col("_total"))
    shares = per_step.join(totals, "run").select("run", "t", share.alias("share"))
    return scan.running_sum(shares, ["run"], ["t"], scan.chunk_of("t"), {"cumulative": "share"})


def cutoffs(hf: DataFrame, lf: DataFrame, threshold: float = 0.95) -> DataFrame:
    """First step after warm-up and first step after convergence per run; 0 where there is none."""
    series = all_series(hf, lf)
    profile = change_profile(trim_at_nan(series))
    found = profile.groupBy("run").agg(
        F.min(F.when(F.col("cumulative") > WARM_UP_SHARE, F.col("t"))).alias("_start"),
        F.min(F.when(F.col("cumulative") > threshold, F.col("t"))).alias("_stop"),
    )
    runs = series.select("run").distinct()
    return runs.join(found, "run", "left").select(
        "run",
        F.coalesce("_start", F.lit(0)).cast("int").alias("start"),
        F.coalesce("_stop", F.lit(0)).cast("int").alias("stop"),
    )


def clip(df: DataFrame, cuts: DataFrame) -> DataFrame:
    """Keep ``start <= t < stop`` and count steps from 0 again."""
    # One row a run, as in ``trim_at_nan``.
    inside = df.join(F.broadcast(cuts), "run").where((F.col("t") >= F.col("start")) & (F.col("t") < F.col("stop")))
    return inside.withColumn("t", (F.col("t") - F.col("start")).cast("int")).select(*df.columns)


def event_hour(df: DataFrame) -> DataFrame:
    """Position of each record inside its event, in time order; equal times are ordered by the other columns."""
    ties = [c for c in df.columns if c not in ("event_id", "datetime")]
    out = scan.row_position(df, ["event_id"], ["datetime", *ties], F.date_trunc("month", "datetime"), "hour")
    return out.withColumn("hour", F.col("hour").cast("int"))


def peak_step(df: DataFrame, value: str = "value") -> DataFrame:
    """First step at which a cell reaches its largest value."""
    return df.groupBy("run", "cell_id").agg(F.max_by("t", F.struct(F.col(value), -F.col("t"))).alias("peak_t"))


def block_maxima(df: DataFrame, k: int = 10, cols: Sequence[str] = ("precip_cum", "inflow")) -> DataFrame:
    """Maxima over groups of ``k`` consecutive events in id order, however sparse the ids."""
    placed = scan.global_position(df, ["event_id"], "_pos")
    block = F.floor(F.col("_pos") / k).cast("int")
    return placed.groupBy(block.alias("block")).agg(*[F.max(c).alias(c) for c in cols])


def return_period_curve(blocks: DataFrame, value: str) -> DataFrame:
    """Return period ``(n + 1) / rank`` of every distinct block maximum; ties share the best rank."""
    counted = blocks.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("_n"))
    total = counted.agg(F.sum("_n").alias("_total"))
    bucket = scan.bucket_of("value", scan.quantile_bounds(counted, "value"))
    running = with_scalars(scan.running_sum(counted, [], ["value"], bucket, {"_upto": "_n"}), total)
    rank = F.col("_total") - F.col("_upto") + 1
    return running.select("value", ((F.col("_total") + 1) / rank).alias("rp"))


def interp_linear(
    df: DataFrame, curve: DataFrame, x: str, y: str, curve_x: str = "value", curve_y: str = "rp"
) -> DataFrame:
    """Piece-wise linear lookup of ``x`` on a curve, extended linearly past both ends.

    The curve's segments and the distinct looked-up values are put in one
    order; each value takes the last segment that starts at or before it. A
    range join would compare every value with every segment instead.
    """
    knots = curve.select(F.col(curve_x).cast("double").alias("_x"), F.col(curve_y).cast("double").alias("_y"))
    bounds = scan.quantile_bounds(knots, "_x")
    bucket = scan.bucket_of("_x", bounds)
    segments = scan.with_next(knots, "_x", bucket, ["_x", "_y"]).where(F.col("next__x").isNotNull())
    segment = F.struct("_x", "_y", "next__x", "next__y")
    first = segments.agg(F.min_by(segment, F.col("_x")).alias("_first"))

    starts = segments.select(F.col("_x").alias("_at"), F.lit(0).alias("_asked"), segment.alias("_segment"))
    asked = df.select(F.col(x).cast("double").alias("_at")).where(F.col("_at").isNotNull()).distinct()
    ordered = starts.unionByName(
        asked.withColumn("_asked", F.lit(1)), allowMissingColumns=True
    ).withColumn("_bucket", scan.bucket_of("_at", bounds))
    ends = ordered.groupBy("_bucket").agg(F.max_by("_segment", F.when(F.col("_asked") == 0, F.col("_at"))).alias("_end"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_bucket", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy("_bucket").orderBy("_at", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    filled = (
        ordered.withColumn("_last", F.last("_segment", ignorenulls=True).over(inside))
        .where(F.col("_asked") == 1)
        .join(carried, "_bucket")
    )
    s = F.coalesce("_last", "_carried", "_first")
    slope = F.try_divide(s["next__y"] - s["_y"], s["next__x"] - s["_x"])
    looked_up = with_scalars(filled, first).select("_at", (s["_y"] + slope * (F.col("_at") - s["_x"])).alias(y))
    return df.join(looked_up, F.col(x).cast("double") == F.col("_at"), "left").drop("_at")


def return_periods(maxima: DataFrame, k: int = 10) -> DataFrame:
    """Event maxima with ``rp_precip`` and ``rp_inflow`` from their own block-maximum curves."""
    # One row per event, and one per k events; both are read many times.
    maxima = cut_lineage(maxima)
    blocks = cut_lineage(block_maxima(maxima, k))
    out = maxima
    for source, target in (("precip_cum", "rp_precip"), ("inflow", "rp_inflow")):
        curve = cut_lineage(return_period_curve(blocks, source))
        out = interp_linear(out, curve, source, target)
    return out


def api(
    df: DataFrame,
    k: float = 0.85,
    window: int | None = None,
    keys: Sequence[str] = ("run",),
    value: str = "rain",
    name: str = "api",
    width: int = 512,
    carry_over: bool = False,
) -> DataFrame:
    """Antecedent index ``a_t = x_t + k * a_(t-1)`` over the dense step index ``t``.

    ``carry_over`` continues the memory from one run into the next, in run
    order. Steps are scanned in chunks: inside a chunk the decayed sum is a
    running sum of ``x_t / k^r``; what all earlier chunks leave behind is added
    with its decay.
    """
    if carry_over:
        return _stacked_api(df, k, window, keys, value, name, width)
    if window is not None:
        lags = F.explode(F.sequence(F.lit(0), F.lit(window - 1)))
        spread = df.select(*keys, "t", F.col(value).alias("_x"), lags.alias("_lag"))
        sums = spread.groupBy(*keys, (F.col("t") + F.col("_lag")).cast("int").alias("t")).agg(
            F.sum(F.col("_x") * F.pow(F.lit(float(k)), F.col("_lag"))).alias(name)
        )
        return df.join(sums, [*keys, "t"])
    if k == 1:
        return scan.running_sum(df, keys, ["t"], scan.chunk_of("t", width), {name: value})
    if not 0 < k < 1:
        raise ValueError("the decay must lie in (0, 1]")
    width = min(width, max(1, int(600 / -math.log(k))))  # keeps k^-width inside a double
    place = F.pmod(F.col("t"), F.lit(width))
    grow = F.pow(F.lit(float(k)), -place)
    tagged = df.withColumn("_chunk", scan.chunk_of("t", width))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumn("_sum", F.sum(F.col(value) * grow).over(inside))
    left_behind = tagged.groupBy(*keys, "_chunk").agg(
        F.sum(F.col(value) * F.pow(F.lit(float(k)), F.lit(width - 1) - place)).alias("_left")
    )
    carried = _carried(left_behind, keys, float(k) ** width)
    joined = local.join(carried, [*keys, "_chunk"], "left")
    decayed = F.pow(F.lit(float(k)), place)
    total = F.col("_sum") * decayed + F.coalesce("_carried", F.lit(0.0)) * decayed * float(k)
    return joined.select(*df.columns, total.alias(name))


# Below this decay, what lies two chunks back is lost in a double.
FADED = 1e-130


def _carried(left_behind: DataFrame, keys: Sequence[str], fade: float) -> DataFrame:
    """What all earlier chunks leave to each chunk, decayed by ``fade`` a chunk.

    That is the same index over the series of chunks, so it is found in the
    same way: chunks of chunks, until a chunk fades within the next one. No
    group holds more than one chunk of a level, with keys or without.
    """
    sent = left_behind.select(*keys, (F.col("_chunk") + 1).alias("t"), F.col("_left").alias("_x"))
    asked = left_behind.select(*keys, F.col("_chunk").alias("t"), F.lit(0.0).alias("_x"))
    series = sent.unionByName(asked).groupBy(*keys, "t").agg(F.sum("_x").alias("_x"))
    if fade < FADED:
        found = series.withColumnRenamed("_x", "_carried")
    else:
        found = api(series, fade, None, keys, "_x", "_carried").drop("_x")
    return found.withColumnRenamed("t", "_chunk")


def _stacked_api(df, k, window, keys, value, name, width) -> DataFrame:
    lengths = df.groupBy(*keys).agg((F.max("t") + 1).alias("_length"))
    # One row per run: its offset in the stacked order.
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = lengths.select(*keys, F.coalesce(F.sum("_length").over(before), F.lit(0)).alias("_offset"))
    placed = df.join(offsets, list(keys)).withColumn("_own_t", F.col("t"))
    placed = placed.withColumn("t", F.col("_offset") + F.col("t"))
    scanned = api(placed, k, window, [], value, name, width)
    return scanned.withColumn("t", F.col("_own_t")).select(*df.columns, name)


def mode_series(
    lf: DataFrame, hf: DataFrame, n_modes: int, band: DataFrame | None = None
) -> DataFrame:
    """Low- and high-fidelity mode values (and a predicted band) per run, mode and step, in plotting order."""
    first = F.col("mode") < n_modes
    out = lf.where(first).select("run", "mode", "t", F.col("z").alias("lf")).join(
        hf.where(first).select("run", "mode", "t", F.col("z").alias("hf")), ["run", "mode", "t"]
    )
    if band is not None:
        out = out.join(band.select("run", "mode", "t", "mean", "low", "high"), ["run", "mode", "t"])
    return out.repartitionByRange("run", "mode", "t").sortWithinPartitions("run", "mode", "t")


