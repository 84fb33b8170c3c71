"""Rating curves and water surfaces estimated along a centreline."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.functions.exprs import floor_to_ground, max_surface
from freshet.operators.filters import rating_filter
from freshet.operators.joins import deal_steps, pair_up, resample_cells
from freshet.operators.stats import quantile_knots

DEGREE = 3


# --- cubic splines as columns ---------------------------------------------------------------------


def spline_basis(df: DataFrame, x: str, knots: str) -> DataFrame:
    """Add ``_j`` (interval) and ``_b0 .. _b3``: the four cubic B-splines that are not 0 at ``x``.

    ``knots`` is the full knot array with four equal knots at each end. Values
    outside it take the polynomial of the end interval.
    """
    v = F.col(x)
    inner = F.slice(knots, DEGREE + 2, F.size(knots) - 2 * (DEGREE + 1))
    placed = df.withColumn("_j", F.size(F.filter(inner, lambda k: k <= v)))
    # Distances to the three knots on either side of the interval.
    placed = placed.withColumns(
        {
            **{f"_l{r}": v - F.get(knots, F.col("_j") + DEGREE + 1 - r) for r in range(1, DEGREE + 1)},
            **{f"_r{r}": F.get(knots, F.col("_j") + DEGREE + r) - v for r in range(1, DEGREE + 1)},
        }
    ).withColumn("_n0_0", F.lit(1.0))
    for d in range(1, DEGREE + 1):
        shares = {
            f"_w{d}_{r}": F.coalesce(
                F.try_divide(F.col(f"_n{d - 1}_{r}"), F.col(f"_r{r + 1}") + F.col(f"_l{d - r}")), F.lit(0.0)
            )
            for r in range(d)
        }
        placed = placed.withColumns(shares)
        terms = {}
        for r in range(d + 1):
            rising = F.col(f"_l{d - r + 1}") * F.col(f"_w{d}_{r - 1}") if r else None
            falling = F.col(f"_r{r + 1}") * F.col(f"_w{d}_{r}") if r < d else None
            terms[f"_n{d}_{r}"] = rising + falling if r and r < d else (rising if r else falling)
        placed = placed.withColumns(terms)
    return placed.select(*df.columns, "_j", *[F.col(f"_n{DEGREE}_{r}").alias(f"_b{r}") for r in range(DEGREE + 1)])


def rating_gram(obs: DataFrame, by: Sequence[str], knots: str = "knots", flow: str = "flow", wse: str = "wse") -> DataFrame:
    """Products of the basis with itself and with the level, summed per site and knot interval.

    Only neighbouring basis functions overlap, so ten products and four
    cross terms per interval hold the whole Gram matrix.
    """
    based = spline_basis(obs, flow, knots)
    sums = [F.sum(F.col(f"_b{p}") * F.col(f"_b{q}")).alias(f"g{p}{q}") for p in range(4) for q in range(p, 4)]
    cross = [F.sum(F.col(f"_b{p}") * F.col(wse)).alias(f"y{p}") for p in range(4)]
    return based.groupBy(*by, "_j").agg(*sums, *cross, F.count(F.lit(1)).alias("n"))


def site_knots(obs: DataFrame, by: Sequence[str], n_knots: int = 7) -> DataFrame:
    """Full knot array per site; too few observations are an error."""
    need = max(8, n_knots + 5)
    ends = obs.groupBy(*by).agg(F.min("flow").alias("q_min"), F.max("flow").alias("q_max"), F.count(F.lit(1)).alias("_n"))
    inner = quantile_knots(obs, n_knots, by)
    pad = [F.col("q_min")] * (DEGREE + 1), [F.col("q_max")] * (DEGREE + 1)
    full = F.concat(F.array(*pad[0]), F.col("knots"), F.array(*pad[1]))
    few = F.raise_error(F.concat(F.lit(f"rating curve needs at least {need} observations, got "), F.col("_n").cast("string")))
    return ends.join(inner, list(by)).select(
        *by, "q_min", "q_max", F.when(F.col("_n") < need, few.cast("array<double>")).otherwise(full).alias("knots")
    )


def fit_rating(
    df: DataFrame, by: Sequence[str] = ("site",), n_knots: int = 7, drop_nonpos: bool = True, qmin: float = 10.0, qmax: float = 10e10
) -> DataFrame:
    """Least-squares cubic spline of level on flow per site: ``by, q_min, q_max, knots, coefs``."""
    by = list(by)
    obs = rating_filter(df, drop_nonpos=drop_nonpos, qmin=qmin, qmax=qmax).select(*by, "flow", "wse")
    knots = site_knots(obs, by, n_knots)
    sums = rating_gram(obs.join(knots.select(*by, "knots"), by), by)
    size = n_knots + DEGREE + 1
    fields = [df.schema[c] for c in by] + [T.StructField("coefs", T.ArrayType(T.DoubleType()))]

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        lhs, rhs = np.zeros((size, size)), np.zeros(size)
        for row in group.to_dict("records"):
            j = row["_j"]
            for p in range(4):
                rhs[j + p] += row[f"y{p}"]
                for q in range(p, 4):
                    lhs[j + p, j + q] += row[f"g{p}{q}"]
                    if q > p:
                        lhs[j + q, j + p] += row[f"g{p}{q}"]
        coefs = np.linalg.lstsq(lhs, rhs, rcond=1e-13)[0]
        return pd.DataFrame({**{c: [group[c].iloc[0]] for c in by}, "coefs": [coefs.tolist()]})

    solved = sums.groupBy(*by).applyInPandas(solve, T.StructType(fields))
    return knots.join(solved, by)


def apply_rating(df: DataFrame, model: DataFrame, by: Sequence[str] = ("site",), flow: str = "flow", out: str = "fitted") -> DataFrame:
    """Level for a flow; past the fitted range the end polynomial continues."""
    joined = df.join(model.select(*by, "knots", "coefs"), list(by))
    based = spline_basis(joined, flow, "knots")
    value = sum((F.col(f"_b{r}") * F.get("coefs", F.col("_j") + r) for r in range(1, 4)), F.col("_b0") * F.get("coefs", F.col("_j")))
    return based.select(*df.columns, value.alias(out))


def rating_trace(model: DataFrame, n: int = 1000, by: Sequence[str] = ("site",)) -> DataFrame:
    """Fitted curve at ``n`` equally spaced flows between each site's extremes."""
    points = model.select(*by, "q_min", "q_max", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("point"))
    flows = points.select(
        *by, "point", (F.col("q_min") + (F.col("q_max") - F.col("q_min")) * F.col("point") / (n - 1)).alias("flow")
    )
    return apply_rating(flows, model, by)


# --- surfaces -------------------------------------------------------------------------------------


def centreline_profile(bc: DataFrame, frac: DataFrame, block: int = 1024, salts: int = 1) -> DataFrame:
    """Level of every centreline cell between the upstream and the downstream level.

    ``bc``: ``run, t, us_wse, ds_wse``; ``frac``: ``cell_id, frac``.
    """
    product = pair_up(bc.select("run", "t", "us_wse", "ds_wse"), frac.select("cell_id", "frac"), block, salts)
    value = F.col("us_wse") - (F.col("us_wse") - F.col("ds_wse")) * F.col("frac")
    return product.select("run", "t", "cell_id", value.alias("value"))


def spread_to_cells(profile: DataFrame, nearest: DataFrame) -> DataFrame:
    """Give every cell the level of its nearest centreline cell (``cell_id, near_id``)."""
    return resample_cells(profile, nearest.withColumnRenamed("near_id", "lf_cell_id"))


def pseudo_surface(
    inflow: DataFrame,
    ratings: DataFrame,
    frac: DataFrame,
    nearest: DataFrame,
    cells: DataFrame,
    forcing_estimate: DataFrame | None = None,
    us: str = "us",
    ds: str = "ds",
) -> DataFrame:
    """Level of every cell from two inflows: ratings, profile, spread, ground, and the forcing model's estimate.

    ``inflow``: ``run, t, us_flow, ds_flow``; ``ratings`` has one row per site ``us`` and ``ds``.
    Steps are dealt out before they become cells, and the ratings go to every task.
    """
    sites = deal_steps(inflow, cells.count()).select(
        "run", "t", F.inline(F.array(
            F.struct(F.lit(us).alias("site"), F.col("us_flow").alias("flow")),
            F.struct(F.lit(ds).alias("site"), F.col("ds_flow").alias("flow")),
        ))
    )
    two = F.broadcast(ratings.where(F.col("site").isin(us, ds)))
    levels = apply_rating(sites, two).groupBy("run", "t").agg(
        F.max(F.when(F.col("site") == us, F.col("fitted"))).alias("us_wse"),
        F.max(F.when(F.col("site") == ds, F.col("fitted"))).alias("ds_wse"),
    )
    spread = spread_to_cells(centreline_profile(levels, frac), nearest)
    grounded = spread.join(cells.select("cell_id", "elevation"), "cell_id").select(
        "run", "t", "cell_id", floor_to_ground("value", "elevation", fill_nan=False).alias("value")
    )
    if forcing_estimate is None:
        return grounded
    other = forcing_estimate.select("run", "t", "cell_id", F.col("value").alias("_other"))
    return grounded.join(other, ["run", "t", "cell_id"]).select(
        "run", "t", "cell_id", max_surface("value", "_other").alias("value")
    )
