"""Raster records as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions import scan


def explode_grid(
    df: DataFrame,
    nrows: int,
    ncols: int,
    flip_y: bool = False,
    mask: DataFrame | None = None,
    col: str = "vals",
) -> DataFrame:
    """One row per pixel of a flattened raster, optionally flipped vertically and kept to a pixel mask.

    With a mask (``row, col``) the kept pixels are numbered in row-major order
    as ``feature = precip_<i>``.
    """
    keys = [c for c in df.columns if c != col]
    flat = df.select(*keys, F.posexplode(col).alias("_i", "value"))
    row = F.floor(F.col("_i") / ncols).cast("int")
    if flip_y:
        row = F.lit(nrows - 1) - row
    cells = flat.select(*keys, row.alias("row"), (F.col("_i") % ncols).cast("int").alias("col"), "value")
    return cells if mask is None else cells.join(number_pixels(mask), ["row", "col"])


def number_pixels(mask: DataFrame) -> DataFrame:
    """Kept pixels with their feature name, numbered in row-major order."""
    kept = mask.select("row", "col").distinct()
    numbered = scan.row_position(kept, [], ["row", "col"], scan.chunk_of("row", 64), "_i")
    return numbered.select("row", "col", F.concat(F.lit("precip_"), F.col("_i").cast("string")).alias("feature"))


def grid_spec(left: float, top: float, cell_size: float, nrows: int, ncols: int) -> dict:
    """Placement of a north-up raster from its upper left corner."""
    return {"left": left, "top": top, "cell": cell_size, "nrows": nrows, "ncols": ncols}


def spec_from_lower_left(cell_x: int, cell_y: int, cell_size: float, nrows: int, ncols: int) -> dict:
    """Placement of a raster whose lower left corner is given in cell counts."""
    return grid_spec(cell_x * cell_size, (cell_y + nrows) * cell_size, cell_size, nrows, ncols)


