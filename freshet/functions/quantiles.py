"""Exact quantiles for groups of any size, by radix selection.

A double is filed by its sign, its binary exponent and the leading bits of its
fraction: a whole number that grows with the value. Counts of a coarse file
(64 bins an octave) tell which bin holds a wanted rank; only the values of such
bins are counted in a fine one (2**20 bins an octave), and only what shares a
fine bin with a wanted rank is put in order. The same steps hold for any group:
what is moved between tasks are counts of bins and a few values, never a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.session import cut_lineage

COARSE, FINE = 6, 20  # bits of the fraction


def bin_of(value: Column, bits: int) -> Column:
    """Bin of a double; never falls as the value grows.

    ``log2`` may be rounded up to the next whole number just below it; the
    fraction is then a little below 0 and the bin the last one of the octave
    before, which is the right one.
    """
    size = F.least(F.abs(value), F.lit(1.7976931348623157e308))
    octave = F.floor(F.log2(F.greatest(size, F.lit(2.0**-1021))))
    fraction = F.greatest(F.floor((size / F.pow(F.lit(2.0), octave.cast("double")) - 1) * (1 << bits)), F.lit(-1))
    own = (octave + 1022) * (1 << bits) + fraction + 1
    return F.when(size < 2.0**-1021, F.lit(0)).when(value < 0, -own).otherwise(own).cast("long")


def _located(wanted: DataFrame, counts: DataFrame, keys: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Wanted ranks (``_rank``, counted inside ``keys`` and ``within``) with the ``_bin`` that holds them and the rank inside it."""
    place = [*keys, *within]
    earlier = Window.partitionBy(*place).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    upto = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    met = wanted.join(upto, place).where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
    return met.withColumn("_rank", F.col("_rank") - F.col("_before")).drop("_before", "_n")


def exact_quantiles(df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float], name: str = "q") -> DataFrame:
    """One row per group with ``name`` = array of linearly interpolated quantiles; NULL and NaN do not count."""
    keys = list(by) or ["_all"]
    values = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).select(*by, F.col(col).cast("double").alias("_v"))
    if not by:
        values = values.withColumn("_all", F.lit(0))
    # Read three times below.
    values = cut_lineage(values)
    coarse = values.withColumn("_bin", bin_of(F.col("_v"), COARSE)).groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    coarse = cut_lineage(coarse)
    totals = coarse.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    at = (F.col("_total") - 1) * F.col("_w.p")
    ends = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs) for side in (0, 1)])
    wanted = totals.select(*keys, "_total", F.explode(ends).alias("_w")).select(
        *keys, F.col("_w.i").alias("_i"), F.col("_w.side").alias("_side"), (at - F.floor(at)).alias("_share"), F.least(F.floor(at) + F.col("_w.side"), F.col("_total") - 1).alias("_rank")
    )
    wanted = _located(wanted, coarse, keys, []).withColumnRenamed("_bin", "_coarse")
    held = values.withColumn("_coarse", bin_of(F.col("_v"), COARSE)).join(wanted.select(*keys, "_coarse").distinct(), [*keys, "_coarse"])
    fine = held.withColumn("_bin", bin_of(F.col("_v"), FINE)).groupBy(*keys, "_coarse", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    wanted = cut_lineage(_located(wanted, fine, keys, ["_coarse"])).withColumnRenamed("_bin", "_fine")
    few = values.withColumn("_fine", bin_of(F.col("_v"), FINE)).join(wanted.select(*keys, "_fine").distinct(), [*keys, "_fine"])
    # Equal values are one row with their count.
    few = few.groupBy(*keys, "_fine", F.col("_v").alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    points = _located(wanted.drop("_coarse"), few, keys, ["_fine"])
    low, high = F.max(F.when(F.col("_side") == 0, F.col("_bin"))), F.max(F.when(F.col("_side") == 1, F.col("_bin")))
    between = points.groupBy(*keys, "_i").agg((low + (high - low) * F.max("_share")).alias("_q"))
    out = between.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"]).alias(name))
    return out if by else out.drop("_all")
