"""Ordered scans that never gather a whole group in one task.

A window over a hot key (one event, one run, or no key at all) would put every
row of that key in one task. The helpers here split the order axis into
buckets: the row-level window works inside ``(key, bucket)``, a second window
works on one summary row per bucket, and a join on ``(key, bucket)`` brings the
two together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.session import cut_lineage

STEP_CHUNK = 4096
BUCKETS_TOGETHER = 4096
ROWS_PER_BUCKET = 200_000


def chunk_of(order: str | Column, width: int = STEP_CHUNK) -> Column:
    """Bucket of an integer step or id."""
    return F.floor((F.col(order) if isinstance(order, str) else order) / width)


def quantile_bounds(df: DataFrame, col: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> list[float]:
    """Ascending inner bounds that split ``col`` into buckets of about equal row counts.

    The bucket number follows the row count, so a small table gets one bucket.
    At most 1,023 numbers reach the driver.
    """
    present = df.where(F.col(col).isNotNull())
    rows = present.count()
    buckets = min(1024, -(-rows // rows_per_bucket))
    if buckets < 2:
        return []
    probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    found = present.agg(F.percentile_approx(F.col(col).cast("double"), probs, F.lit(20 * buckets))).first()[0]
    return sorted(set(found or []))


def bucket_of(col: str | Column, bounds: Sequence[float]) -> Column:
    """Index of the bucket of a value: how many bounds are <= it."""
    value = F.col(col) if isinstance(col, str) else col
    # Without bounds there is one bucket; it must still look like a column, because
    # a join on a constant would be planned as a pairwise join.
    edges = F.array(*[F.lit(float(b)) for b in bounds or [math.inf]])
    return F.size(F.filter(edges, lambda edge: edge <= value))


def _before(summary: DataFrame, keys: Sequence[str], bucket: str, sums: Sequence[str]) -> DataFrame:
    """Sums over all earlier buckets of the same key.

    Without a key all summary rows are one series. They are summed in stretches
    of ``BUCKETS_TOGETHER`` buckets first, so that only one row a stretch goes
    through a single window.
    """
    if not keys:
        placed = summary.withColumn("_stretch", F.floor(F.col(bucket) / BUCKETS_TOGETHER))
        totals = placed.groupBy("_stretch").agg(*[F.sum(c).alias(c) for c in sums])
        whole = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
        far = totals.select("_stretch", *[F.coalesce(F.sum(c).over(whole), F.lit(0)).alias(f"_far_{c}") for c in sums])
        inside = Window.partitionBy("_stretch").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        near = placed.select("_stretch", bucket, *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_near_{c}") for c in sums])
        return near.join(far, "_stretch").select(bucket, *[(F.col(f"_near_{c}") + F.col(f"_far_{c}")).alias(f"_before_{c}") for c in sums])
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(
        *keys, bucket, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums]
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    values: dict[str, str | Column],
) -> DataFrame:
    """Add inclusive running sums; ``bucket`` must grow with the first order column."""
    tagged = df.withColumn("_bucket", bucket)
    for name, value in values.items():
        tagged = tagged.withColumn(f"_v_{name}", F.col(value) if isinstance(value, str) else value)
    totals = tagged.groupBy(*keys, "_bucket").agg(*[F.sum(f"_v_{n}").alias(n) for n in values])
    offsets = _before(totals, keys, "_bucket", list(values))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_local_{n}") for n in values])
    joined = local.join(offsets, [*keys, "_bucket"])
    out = joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_local_{n}") + F.col(f"_before_{n}")).alias(n) for n in values],
    )
    return out


def row_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column, name: str = "pos"
) -> DataFrame:
    """Add the 0-based position of each row inside its key."""
    tagged = df.withColumn("_bucket", bucket)
    counts = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = _before(counts, keys, "_bucket", ["_rows"])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = tagged.withColumn("_local", F.row_number().over(inside))
    return local.join(offsets, [*keys, "_bucket"]).select(
        *[F.col(c) for c in df.columns],
        (F.col("_local") - 1 + F.col("_before__rows")).cast("long").alias(name),
    )


def global_position(df: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """Add the 0-based position of each row in the order of the whole table, whatever the spread of its values.

    Rows are sorted into ranges and numbered where they lie; one row a range
    tells how many stand before it.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    kept = cut_lineage(ranged).withColumn("_bucket", F.shiftright("_mid", 33))
    counts = kept.groupBy("_bucket").agg(F.min("_mid").alias("_lo"), F.count(F.lit(1)).alias("_rows"))
    offsets = counts.join(_before(counts, [], "_bucket", ["_rows"]), "_bucket").select("_bucket", (F.col("_before__rows") - F.col("_lo")).alias("_shift"))
    return kept.join(offsets, "_bucket").select(*[F.col(c) for c in df.columns], (F.col("_mid") + F.col("_shift")).cast("long").alias(name))


def with_halo(df: DataFrame, step: str, distance: int, width: int = STEP_CHUNK) -> DataFrame:
    """Add ``_chunk``; the first ``distance`` rows of a chunk are copied into the chunk before it."""
    if distance > width:
        raise ValueError(f"look-ahead of {distance} steps needs chunks of at least that width")
    here = chunk_of(step, width)
    near_start = F.pmod(F.col(step), F.lit(width)) < distance
    return df.withColumn("_chunk", F.explode(F.when(near_start, F.array(here, here - 1)).otherwise(F.array(here))))


def ahead_in_chunk(
    df: DataFrame, keys: Sequence[str], step: str, cols: Sequence[str], distance: int, width: int = STEP_CHUNK, keep_chunk: bool = False
) -> DataFrame:
    """Add ``<col>_<i>`` inside the chunks of ``with_halo`` and drop the copies."""
    ordered = Window.partitionBy(*keys, "_chunk").orderBy(F.col(step).cast("long"))
    ahead = df.select(
        "*",
        *[
            F.first(c).over(ordered.rangeBetween(i, i)).alias(f"{c}_{i}")
            for i in range(1, distance + 1)
            for c in cols
        ],
    )
    own = ahead.where(F.col("_chunk") == chunk_of(step, width))
    return own if keep_chunk else own.drop("_chunk")


def look_ahead(
    df: DataFrame,
    keys: Sequence[str],
    step: str,
    cols: Sequence[str],
    distance: int,
    width: int = STEP_CHUNK,
    keep_chunk: bool = False,
) -> DataFrame:
    """Add ``<col>_<i>``: the value of the same series at ``step + i``, i = 1..distance, and on request the row's ``_chunk``.

    One shuffle on ``(keys, chunk)`` is enough, and no task holds a whole series.
    """
    return ahead_in_chunk(with_halo(df, step, distance, width), keys, step, cols, distance, width, keep_chunk)


def with_next(df: DataFrame, order: str, bucket: Column, cols: Sequence[str]) -> DataFrame:
    """Add ``next_<col>`` of the following row in the global order of distinct ``order`` values."""
    tagged = df.withColumn("_bucket", bucket)
    row = F.struct(*[F.col(c) for c in cols])
    heads = tagged.groupBy("_bucket").agg(F.min_by(row, F.col(order)).alias("_head"))
    after = heads.select("_bucket", F.lead("_head").over(Window.orderBy("_bucket")).alias("_next_head"))
    inside = Window.partitionBy("_bucket").orderBy(order)
    led = tagged.withColumn("_lead", F.lead(row).over(inside)).join(after, "_bucket")
    picked = F.coalesce(F.col("_lead"), F.col("_next_head"))
    return led.select(*df.columns, *[picked.getField(c).alias(f"next_{c}") for c in cols])


def index_steps(df: DataFrame, keys: Sequence[str], order: str, name: str = "t") -> DataFrame:
    """Replace sparse step labels by the dense index 0, 1, 2, ... of the distinct labels of each key."""
    labels = df.select(*keys, order).distinct()
    inside = Window.partitionBy(*keys).orderBy(order)
    dense = labels.withColumn("_dense", (F.row_number().over(inside) - 1).cast("int"))
    joined = df.join(dense, [*keys, order])
    kept = [c for c in df.columns if c != name]
    return joined.select(*kept, F.col("_dense").alias(name))
