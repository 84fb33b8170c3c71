"""Row filters and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALWAYS_DRY = "AD"
# Areas this small come from degenerate border cells.
ZERO_AREA = 1e-8


def finite(col: str) -> Column:
    """Not NULL, not NaN, not infinite."""
    c = F.col(col)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def valid_elevation(df: DataFrame) -> DataFrame:
    return df.where(F.col("elevation").isNotNull() & ~F.isnan("elevation"))


def valid_area(df: DataFrame) -> DataFrame:
    return df.where(F.col("area").isNotNull() & ~F.isnan("area") & (F.abs("area") > ZERO_AREA))


def drop_dry(df: DataFrame, classes: DataFrame) -> DataFrame:
    """Remove cells whose wetness class is always dry."""
    dry = classes.where(F.col("wetness") == ALWAYS_DRY).select("cell_id")
    return df.join(dry, "cell_id", "left_anti")


def rating_filter(
    df: DataFrame,
    flow: str = "flow",
    wse: str = "wse",
    drop_nonpos: bool = True,
    qmin: float | None = 10.0,
    qmax: float | None = 10e10,
) -> DataFrame:
    """Observations usable for a stage-discharge fit."""
    keep = finite(flow) & finite(wse)
    if drop_nonpos:
        keep = keep & (F.col(flow) > 0)
    if qmin is not None:
        keep = keep & (F.col(flow) > float(qmin))
    if qmax is not None:
        keep = keep & (F.col(flow) < float(qmax))
    return df.where(keep)


def rp_window(df: DataFrame, field: str, rp: float, width: float = 0.2) -> DataFrame:
    """Rows whose return period lies within ``rp * (1 -/+ width)``, ends included."""
    return df.where(F.col(field).between(rp * (1 - width), rp * (1 + width)))


def joint_range(df: DataFrame, lo: float, hi: float, fields=("rp_precip", "rp_inflow")) -> DataFrame:
    """Rows with every return period inside ``[lo, hi]``."""
    keep = F.lit(True)
    for field in fields:
        keep = keep & F.col(field).between(float(lo), float(hi))
    return df.where(keep)


def single_geometry(runs: DataFrame, mesh_name: str | None = None) -> DataFrame:
    """Fail when the runs do not share one geometry; optionally keep one mesh."""
    seen = runs.agg(F.min("geometry").alias("_lo"), F.max("geometry").alias("_hi"))
    checked = seen.select(
        F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
        .otherwise(F.raise_error(F.lit("runs use more than one geometry")).cast("string"))
        .alias("geometry")
    )
    out = runs.join(F.broadcast(checked), "geometry")  # one row by construction
    return out if mesh_name is None else out.where(F.col("mesh_name") == mesh_name)
