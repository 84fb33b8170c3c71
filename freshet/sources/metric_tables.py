"""Published metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from freshet.operators.metrics import MetricTables

NAMES = ("scalar_metrics", "timeseries_metrics", "cell_metrics")


def write_metrics(tables: MetricTables, path: str) -> None:
    """Replace the three tables below ``path``."""
    for name, df in zip(NAMES, (tables.scalar, tables.timeseries, tables.cell)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_metric(
    spark: SparkSession, path: str, table: str, fields: Sequence[str] | None = None, cells: DataFrame | None = None
) -> DataFrame:
    """Chosen columns of a metric table, optionally only for the cells of another table."""
    if table not in NAMES:
        raise ValueError(f"table {table!r} not found; available tables: {list(NAMES)}")
    return select_metric(spark.read.parquet(f"{path}/{table}"), fields, cells)


def select_metric(df: DataFrame, fields: Sequence[str] | None = None, cells: DataFrame | None = None) -> DataFrame:
    if cells is not None:
        df = df.join(cells.select("cell_id"), "cell_id", "left_semi")
    if fields is None:
        return df
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise ValueError(f"fields {missing} not present; available: {df.columns}")
    keys = [c for c in ("event", "timestep", "cell_id") if c in df.columns and c not in fields]
    return df.select(*keys, *fields)
