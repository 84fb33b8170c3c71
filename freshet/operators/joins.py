"""Equi joins that line tables up, and the block product used for dense outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["run", "t", "cell_id"]
# Rows of steps times cells that one task sorts.
DENSE_ROWS = 1_000_000


def align(hf: DataFrame, lf: DataFrame, keys=KEYS) -> DataFrame:
    """Full outer join of both models on time and cell, as ``(keys, hf, lf)``."""
    left = hf.select(*keys, F.col("value").alias("hf"))
    right = lf.select(*keys, F.col("value").alias("lf"))
    return left.join(right, list(keys), "full_outer")


def pair(truth: DataFrame, pred: DataFrame, conf: DataFrame | None = None) -> DataFrame:
    """Truth ``x``, prediction ``y`` and its spread ``s`` for every ``(run, t, cell_id)``.

    Without ``conf`` the prediction table must carry ``sd`` itself, which saves a join.
    The tables are joined by sorting: their files are so well compressed that the
    planner takes millions of rows for a small table and sends them to every task.
    """
    x = truth.select(*KEYS, F.col("value").alias("x"))
    if conf is None:
        return x.join(pred.select(*KEYS, F.col("value").alias("y"), F.col("sd").alias("s")).hint("merge"), KEYS)
    y = pred.select(*KEYS, F.col("value").alias("y"))
    s = conf.select(*KEYS, F.col("value").alias("s"))
    return x.join(y.hint("merge"), KEYS).join(s.hint("merge"), KEYS)


def resample_cells(lf: DataFrame, cell_map: DataFrame) -> DataFrame:
    """Give every high-fidelity cell the value of the low-fidelity cell it maps to."""
    mapping = cell_map.select("cell_id", "lf_cell_id")
    source = lf.withColumnRenamed("cell_id", "lf_cell_id")
    others = [c for c in source.columns if c != "lf_cell_id"]
    return source.join(mapping, "lf_cell_id").select("cell_id", *others)


def cell_info(mesh: DataFrame, elevations: DataFrame, areas: DataFrame, cell_map: DataFrame | None = None) -> DataFrame:
    """Identity, elevation, area, geometry and mapped cell in one table."""
    out = mesh.join(elevations.select("cell_id", "elevation"), "cell_id").join(
        areas.select("cell_id", "area"), "cell_id"
    )
    if cell_map is not None:
        out = out.join(cell_map.select("cell_id", "lf_cell_id"), "cell_id")
    return out


def link_boundaries(boundaries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """First catalogue record of every boundary's cleaned element and parameter.

    ``boundaries``: ``id, bc_line_id, area_id``; ``catalogue``: ``event_id, ord, element, param, path``.
    A boundary on a line takes base flow, one on an area takes plain flow, and
    boundaries without either id or without a matching element are skipped.
    """
    from freshet.functions.exprs import clean_boundary_id

    line, area = F.trim(F.coalesce("bc_line_id", F.lit(""))), F.trim(F.coalesce("area_id", F.lit("")))
    wanted = boundaries.where((line != "") | (area != "")).select(
        "id",
        clean_boundary_id(F.when(line != "", line).otherwise(area)).alias("element"),
        F.when(line != "", F.lit("FLOW-BASE")).otherwise(F.lit("FLOW")).alias("param"),
    )
    # The first record per element is found before the join, so a popular
    # element never multiplies rows.
    first = catalogue.groupBy("event_id", "element", "param").agg(
        F.min_by("path", F.struct("ord", "path")).alias("path")
    )
    return wanted.join(first, ["element", "param"]).select("event_id", "id", "element", "param", "path")


def metric_map(mesh: DataFrame, metrics: DataFrame, field: str, fill_unmatched: bool = False) -> DataFrame:
    """Metric on mesh cells per event, missing values as 0, with limits shared by all events.

    ``fill_unmatched`` also lists mesh cells an event has no metric for.
    """
    value = F.col(field)
    known = metrics.select(
        "event", "cell_id", F.when(value.isNull() | F.isnan(value), F.lit(0.0)).otherwise(value).alias("error_value")
    ).join(mesh.select("cell_id"), "cell_id", "left_semi")
    limits = known.agg(F.min("error_value").alias("vmin"), F.max("error_value").alias("vmax"))
    if fill_unmatched:
        spine = pair_up(mesh.select("cell_id"), metrics.select("event").distinct())
        known = spine.join(known, ["event", "cell_id"], "left").withColumn(
            "error_value", F.coalesce("error_value", F.lit(0.0))
        )
    geometry = [c for c in mesh.columns if c != "cell_id"]
    placed = known.join(mesh, "cell_id").select("event", "cell_id", *geometry, "error_value")
    return with_scalars(placed, limits)


def eof_map(mesh: DataFrame, eof: DataFrame, n_modes: int = 3) -> DataFrame:
    """Loadings of the first modes on the mesh, dry cells 0, with one symmetric colour limit."""
    first = eof.where(F.col("mode") < n_modes)
    limit = first.agg(F.max(F.abs("loading")).alias("vmax"))
    slots = F.array(*[F.lit(m) for m in range(n_modes)])
    spine = mesh.withColumn("mode", F.explode(slots))
    placed = spine.join(first.select("mode", "cell_id", "loading"), ["mode", "cell_id"], "left").withColumn(
        "loading", F.coalesce("loading", F.lit(0.0))
    )
    return with_scalars(placed, limit)


def exclude(df: DataFrame, ids: DataFrame, key: str = "event_id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def restrict(df: DataFrame, ids: DataFrame, key: str = "event_id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row, as scalar subqueries."""
    return df.select("*", *[scalars.select(c).scalar().alias(c) for c in scalars.columns])


def pair_up(left: DataFrame, right: DataFrame, block: int = 1024, salts: int = 1) -> DataFrame:
    """Every row of ``left`` with every row of ``right``, for outputs that are dense by definition.

    ``right`` is packed into blocks of about ``block`` rows. A left row is
    routed once per block, and rows multiply only after the join, inside the
    task that writes them. ``salts`` spreads one block over several tasks.
    A single block goes to every task, and the left rows stay where they are.
    """
    blocks = max(1, -(-right.count() // block))
    packed = (
        right.withColumn("_block", F.pmod(F.xxhash64(*right.columns), F.lit(blocks)).cast("int"))
        .groupBy("_block")
        .agg(F.collect_list(F.struct(*right.columns)).alias("_rows"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    routed = left.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn(
        "_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    )
    joined = routed.join(F.broadcast(packed) if blocks == 1 else packed, ["_block", "_salt"])
    return joined.select(*left.columns, F.inline("_rows"))


def deal_steps(steps: DataFrame, per_step: int) -> DataFrame:
    """Steps dealt out so that a task gets about ``DENSE_ROWS`` rows once each becomes ``per_step`` rows.

    Such rows are so alike that shuffle files say nothing about the memory they
    take in a sort, so their number decides and not their bytes.
    """
    spark = steps.sparkSession
    wanted = -(-steps.count() * per_step // DENSE_ROWS)
    return steps.repartition(max(wanted, spark.sparkContext.defaultParallelism), "run", "t")


def first_row(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """First row per key in the given order, by a mergeable aggregate rather than a window."""
    rest = [c for c in df.columns if c not in by]
    picked = df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*by, "_row.*")


