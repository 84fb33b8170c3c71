"""Mixing sources to target weights by Pfair scheduling.

A source's rows are cut into blocks. Its j-th block (from 0) is released at
slot ``floor(j / w)`` and due before slot ``ceil((j + 1) / w)``, ``w`` being
the target weight. Each slot takes the released block with the earliest
deadline. With weights in fractions of ``period`` slots that add up to 1, all
deadlines are met, so after any number of slots a source has had less than one
block more or less than its share.

The windows repeat every ``period`` slots. The schedule of one period (at most
``period`` rows, whatever the data) is made once; every block's slot follows
from its number by one join.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERIOD = 4096
BLOCK_ROWS = 16
ROWS_PER_WINDOW = 20_000


def quotas(weights: dict[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Blocks of each source in a period: largest remainders, one at least; they add up to ``period``."""
    good = {k: float(w) for k, w in weights.items() if w is not None and w > 0 and math.isfinite(w)}
    if len(good) > period:
        raise ValueError(f"{len(good)} sources need a period of as many slots at least")
    if not good:
        return {}
    order = sorted(good, key=lambda k: (k is not None, k or ""))
    total = math.fsum(good.values())
    share = {k: good[k] / total * period for k in order}
    out = {k: max(1, math.floor(share[k])) for k in order}
    rest = period - sum(out.values())
    if rest > 0:
        for k in sorted(order, key=lambda k: (out[k] - share[k], order.index(k)))[:rest]:
            out[k] += 1
    while rest < 0:  # many tiny weights were rounded up to one block
        k = max(order, key=lambda k: (out[k] - share[k]) if out[k] > 1 else -math.inf)
        out[k] -= 1
        rest += 1
    return out


def schedule(blocks: dict[str | None, int]) -> list[tuple[str | None, int, int, int, int]]:
    """(source, block, release, deadline, slot) of one period, earliest deadline first, ties by source order."""
    period = sum(blocks.values())
    names = list(blocks)
    waiting = [(0, i, 0) for i in range(len(names))]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []  # (deadline, source, block, release)
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            release, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // blocks[names[i]]), i, j, release))
        deadline, i, j, release = heapq.heappop(ready)
        out.append((names[i], j, release, deadline, slot))
        if j + 1 < blocks[names[i]]:
            heapq.heappush(waiting, ((j + 1) * period // blocks[names[i]], i, j + 1))
    return out


def tempered(docs: DataFrame, power: float = 0.5, source: str = "source") -> dict[str | None, float]:
    """Target weights in proportion to ``rows ** power``; one number a source reaches the driver, ``PERIOD`` at most."""
    found = docs.groupBy(F.col(source).alias("s")).count().limit(PERIOD + 1).collect()
    if len(found) > PERIOD:
        raise ValueError(f"more than {PERIOD} sources; give weights and a longer period")
    return {r["s"]: r["count"] ** power for r in found}


def interleave(
    docs: DataFrame,
    weights: dict[str | None, float],
    *,
    source: str = "source",
    row_id: str = "doc_id",
    block_rows: int = BLOCK_ROWS,
    period: int = PERIOD,
    seed: str = "mix",
) -> DataFrame:
    """Add ``mix_block``, ``mix_release``, ``mix_deadline``, ``mix_slot`` and ``mix_place`` (row within the slot).

    Reading the rows by (``mix_slot``, ``mix_place``) gives the mix. Every row
    stays: once a source is used up its later slots are empty and the others go
    on in the same proportion. Within a source rows follow the MD5 of the seed
    and the id, so the order is the same at any parallelism. A null source is a
    source of its own; sources without a positive weight follow the mix in no
    slot (null). Rows with the same source and id share a place's order in no
    stated way. Columns of the input with the names of the new ones are
    replaced.
    """
    new = ["mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place"]
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    spark = docs.sparkSession
    per = quotas(weights, period)
    rows = [(s is None, s or "", j, r, d, t, per[s]) for s, j, r, d, t in schedule(per)]
    # At most `period` rows, a fixed number.
    table = F.broadcast(spark.createDataFrame(rows, "_n boolean, _s string, _j long, _r long, _d long, _t long, _c long"))
    counts = F.broadcast(table.where("_j = 0").select("_n", "_s", "_c"))

    most = docs.groupBy(F.col(f"`{source}`").alias("s")).count().agg(F.max("count")).first()[0] or 0
    # Windows small enough for the largest source; the order does not depend on their number.
    digits = 2 + max(0, math.ceil(math.log(max(1.0, most / 256 / ROWS_PER_WINDOW), 16)))
    name, own_id = F.col(f"`{source}`").cast("string"), F.col(f"`{row_id}`")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(own_id.cast("string"), F.lit(""))).cast("binary"))
    own = docs.select(F.struct(*keep).alias("_row"), name.isNull().alias("_n"), F.coalesce(name, F.lit("")).alias("_s"), key.alias("_k"), own_id.alias("_id"))
    own = own.withColumn("_b", F.substring("_k", 1, digits))
    ranked = own.withColumn("_i", F.row_number().over(Window.partitionBy("_n", "_s", "_b").orderBy("_k", "_id")) - 1)
    earlier = Window.partitionBy("_n", "_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = own.groupBy("_n", "_s", "_b").agg(F.count("*").alias("_m"))
    offsets = sizes.select("_n", "_s", "_b", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_o"))
    at = ranked.join(offsets, ["_n", "_s", "_b"]).withColumn("_i", F.col("_i") + F.col("_o"))
    at = at.withColumn("_block", F.floor(F.col("_i") / block_rows))
    at = at.join(counts, ["_n", "_s"], "left").withColumn("_j", F.pmod("_block", "_c"))
    at = at.join(table.drop("_c"), ["_n", "_s", "_j"], "left")
    base = F.floor(F.col("_block") / F.col("_c")) * F.lit(sum(per.values()))
    return at.select(
        "_row.*",
        F.col("_block").cast("long").alias("mix_block"),
        (base + F.col("_r")).cast("long").alias("mix_release"),
        (base + F.col("_d")).cast("long").alias("mix_deadline"),
        (base + F.col("_t")).cast("long").alias("mix_slot"),
        F.pmod("_i", F.lit(block_rows)).cast("int").alias("mix_place"),
    )
