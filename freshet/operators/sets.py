"""Top-k, set operations and seeded sampling."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.exprs import log_dist

RP_FIELDS = ("rp_precip", "rp_inflow")


def argmax_row(df: DataFrame, col: str, key: str = "event_id") -> DataFrame:
    """The row with the largest value; the lowest key wins a tie and NaN never wins."""
    known = df.where(F.col(col).isNotNull() & ~F.isnan(col))
    return known.agg(F.max_by(F.struct("*"), F.struct(F.col(col), -F.col(key))).alias("_row")).select("_row.*")


def take_modes(df: DataFrame, k: int) -> DataFrame:
    return df.where(F.col("mode") < k)


def near_targets(maxima: DataFrame, targets: Sequence[float], width: float = 0.2) -> DataFrame:
    """Events near each target return period in either field, with their joint log distance.

    The target list is a parameter, so it is expanded inside each row: no join.
    """
    slots = F.array(
        *[
            F.struct(F.lit(i).alias("slot"), F.lit(float(rp)).alias("rp"), F.lit(field).alias("field"))
            for i, (rp, field) in enumerate((rp, field) for rp in targets for field in RP_FIELDS)
        ]
    )
    spread = maxima.select("*", F.inline(slots))
    period = reduce(lambda acc, f: F.when(F.col("field") == f, F.col(f)).otherwise(acc), RP_FIELDS, F.lit(None))
    near = spread.where(period.between(F.col("rp") * (1 - width), F.col("rp") * (1 + width)))
    return near.withColumn("log_dist", log_dist("rp_precip", "rp_inflow", "rp"))


def rank_candidates(maxima: DataFrame, targets: Sequence[float], width: float = 0.2, top: int = 25) -> DataFrame:
    """The ``top`` nearest events per target and field, numbered from 1.

    Spark applies the rank limit before the shuffle, so a crowded target sends
    at most ``top`` rows per task. Undefined distances come last.
    """
    ordering = Window.partitionBy("slot").orderBy(F.col("log_dist").asc_nulls_last(), "event_id")
    ranked = near_targets(maxima, targets, width).withColumn("rank", F.row_number().over(ordering))
    return ranked.where(F.col("rank") <= top)


def ordered(df: DataFrame, by: Sequence[str] = ("event_id", "datetime")) -> DataFrame:
    """Total order over range partitions; files written from it are numbered in that order."""
    return df.orderBy(*by)


def tail_steps(df: DataFrame, n: int = 72, start: str = "start_time", interval: str = "1 hour") -> DataFrame:
    """Last ``n`` steps of every event, stamped at equal intervals from the event's start."""
    ends = df.groupBy("event_id").agg(F.max("t").alias("_last"))
    first = F.greatest(F.col("_last") - n + 1, F.lit(0))
    kept = df.join(ends, "event_id").where(F.col("t") >= first)
    step = (F.col("t") - first).cast("int")
    unit = {"second": "secs", "minute": "mins", "hour": "hours", "day": "days"}
    count, word = interval.split()
    stamp = F.col(start) + F.make_interval(**{unit[word.rstrip("s")]: step * int(count)})
    return kept.select(*df.columns, step.alias("step"), stamp.alias("stamp"))


def union_runs(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def union_ids(a: DataFrame, b: DataFrame, key: str = "event_id") -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def minus(a: DataFrame, b: DataFrame, key: str = "event_id") -> DataFrame:
    return a.join(b.select(key), key, "left_anti")


def lot(key: str = "event_id", seed: int = 42) -> Column:
    """Seeded draw that is the same on every engine and every retry."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def log_edges(lo: float, hi: float, n: int) -> list[float]:
    step = (math.log10(hi) - math.log10(lo)) / n
    return [10 ** (math.log10(lo) + i * step) for i in range(n + 1)]


def sample_log_bins(df: DataFrame, col: str, lo: float, hi: float, n: int, seed: int = 42) -> DataFrame:
    """One event per log-spaced bin; a value on an edge belongs to both bins."""
    edges = log_edges(lo, hi, n)
    bins = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(a).alias("a"), F.lit(b).alias("b"))
                     for i, (a, b) in enumerate(zip(edges, edges[1:]))])
    spread = df.select("event_id", F.col(col).alias("_v"), F.inline(bins))
    inside = spread.where((F.col("_v") >= F.col("a")) & (F.col("_v") <= F.col("b")))
    return inside.groupBy("bin").agg(
        F.min_by("event_id", F.struct(lot(seed=seed), F.col("event_id"))).alias("event_id")
    )


def fill_sample(df: DataFrame, have: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Further events, drawn without replacement, that bring ``have`` up to ``n``."""
    missing = max(0, n - have.select("event_id").distinct().count())
    rest = df.join(have.select("event_id"), "event_id", "left_anti")
    return rest.orderBy(lot(seed=seed), "event_id").limit(missing)
