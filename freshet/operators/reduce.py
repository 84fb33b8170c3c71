"""Reduction of a run's cells to a few spatial modes, and back."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.operators import gram
from freshet.operators.filters import ALWAYS_DRY
from freshet.operators.joins import pair_up, with_scalars
from freshet.operators.stats import norths_rule, wetness_class
from freshet.functions.exprs import depth
from freshet.session import cut_lineage

# Largest Gram matrix side that is solved on the driver (32 MB of doubles).
MAX_SIDE = 2048
# Up to so many modes, a mode is a column of its own.
MANY_MODES = 64
BLOCK_SIDE = 512
EIGEN = "mode int, eigenvalue double"


# --- principal components of long rows ------------------------------------------------------------


@dataclass
class Modes:
    """Leading eigenvalues (descending) and, on request, unit loadings ``(mode, feature, loading)``.

    Every loading vector has its largest entry positive. ``complete`` tells
    whether ``eigen`` lists every eigenvalue.
    """

    eigen: DataFrame
    n_samples: int
    complete: bool
    build: Callable[[int], DataFrame]

    def loadings(self, k: int) -> DataFrame:
        """Loadings of the first ``k`` modes; only these are computed."""
        return self.build(k)


def principal_modes(
    df: DataFrame,
    sample: Sequence[str],
    feature: str,
    value: str,
    k: int | None = None,
    max_side: int = MAX_SIDE,
    method: str = "auto",
) -> Modes:
    """Principal components of the matrix ``sample x feature``; absent, NULL and NaN entries count as 0.

    The smaller side decides: a feature Gram matrix or a sample Gram matrix is
    solved on the driver when that side fits ``max_side``; otherwise a block of
    vectors is iterated in DataFrames and only its tiny Gram matrix is solved.
    """
    data = df.select(*sample, F.col(feature).alias("_f"), F.col(value).cast("double").alias("_x"))
    n = data.select(*sample).distinct().count()
    c = data.select("_f").distinct().count()
    if method == "auto":
        method = "primal" if c <= min(n, max_side) else "dual" if n <= max_side else "block"
    data = data.where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    if method == "block":
        eigen, build = _block_modes(data, sample, k, n, c)
    elif method == "dual":
        eigen, build = _dual_modes(data, sample, n)
    else:
        eigen, build = _primal_modes(data, sample, n)
    return Modes(eigen, n, method != "block", lambda m: _orient(build(m)).withColumnRenamed("_f", feature))


def _numbered(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct keys with a dense index; used only for the side that fits the driver."""
    rows = sorted(tuple(r) for r in df.select(*cols).distinct().collect())
    fields = [df.schema[c] for c in cols]
    schema = T.StructType([*fields, T.StructField("_i", T.IntegerType())])
    return df.sparkSession.createDataFrame([(*row, i) for i, row in enumerate(rows)], schema)


def _eigh(gram_matrix: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh((gram_matrix + gram_matrix.T) / 2)
    order = np.argsort(values)[::-1][:rows]
    return np.maximum(values[order], 0.0), vectors[:, order]


def _eigen_frame(spark: SparkSession, values: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], EIGEN)


def _vectors_for(index: DataFrame, vectors: np.ndarray, name: str) -> DataFrame:
    """Attach rows of a small matrix to their keys, as an array column."""
    spark = index.sparkSession
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], f"_i int, {name} array<double>")
    return index.join(rows, "_i").drop("_i")


def _orient(loadings: DataFrame) -> DataFrame:
    """Make the largest loading of each mode positive."""
    lead = loadings.groupBy("mode").agg(
        F.max_by("loading", F.struct(F.abs("loading"), F.hash("_f"))).alias("_lead")
    )
    return loadings.join(F.broadcast(lead), "mode").select(  # one row per mode
        "mode", "_f", (F.when(F.col("_lead") < 0, -F.col("loading")).otherwise(F.col("loading"))).alias("loading")
    )


def _primal_modes(data: DataFrame, sample: Sequence[str], n: int):
    index = _numbered(data, ["_f"])
    c = index.count()
    rows = data.join(index, "_f").groupBy(*sample).agg(F.collect_list("_i").alias("idx"), F.collect_list("_x").alias("val"))
    second, first = gram.second_moments(rows, c)
    values, vectors = _eigh((second - np.outer(first, first) / n) / max(n - 1, 1), min(n, c))

    def build(k: int) -> DataFrame:
        return _vectors_for(index, vectors[:, :k], "_v").select("_f", F.posexplode("_v").alias("mode", "loading"))

    return _eigen_frame(data.sparkSession, values), build


def _dual_modes(data: DataFrame, sample: Sequence[str], n: int):
    index = _numbered(data, sample)
    placed = data.join(index, list(sample))
    rows = placed.groupBy("_f").agg(F.collect_list("_i").alias("idx"), F.collect_list("_x").alias("val"))
    second, _ = gram.second_moments(rows, n)
    centre = np.eye(n) - 1.0 / n
    values, vectors = _eigh(centre @ second @ centre / max(n - 1, 1), n)
    kept = values > values.max(initial=0.0) * 1e-12
    values, vectors = values[kept], vectors[:, kept]
    scaled = vectors / np.sqrt(values * max(n - 1, 1))

    def build(k: int) -> DataFrame:
        k = min(k, len(values))
        if not k:
            return data.select("_f", F.lit(0).alias("mode"), F.lit(0.0).alias("loading")).limit(0)
        known = _vectors_for(index, scaled[:, :k], "_u")
        if k > MANY_MODES:
            summed = _matrix_sums(data, ["_f"], list(sample), known.withColumnRenamed("_u", "_w"))
            return summed.select("_f", "mode", F.col("value").alias("loading"))
        sums = [F.sum(F.col("_x") * F.col("_u")[j]) for j in range(k)]
        projected = data.join(known, list(sample)).groupBy("_f").agg(F.array(*sums).alias("_v"))
        return projected.select("_f", F.posexplode("_v").alias("mode", "loading"))

    return _eigen_frame(data.sparkSession, values), build


def _block_modes(
    data: DataFrame, sample: Sequence[str], k: int | None, n: int, c: int, tol: float = 1e-9, max_rounds: int = 200
):
    """Block iteration: X times the block, orthonormalise by a small Gram matrix, X' times the result.

    When no mode count is given, the block grows until its smallest eigenvalue
    falls to 1 or below, which is all the mode-count rule looks at.
    """
    spark = data.sparkSession
    width = min(n, c, (k or 12) + 8)
    means = data.groupBy("_f").agg((F.sum("_x") / F.lit(float(n))).alias("_mean"))
    while True:
        start = means.select(
            "_f", "_mean",
            F.array(*[F.hash("_f", F.lit(j)).cast("double") / F.lit(2.0**31) for j in range(width)]).alias("_w"),
        )
        weights, previous = start, None
        for _ in range(max_rounds):
            offset = weights.agg(*[F.sum(F.col("_mean") * F.col("_w")[j]).alias(f"o{j}") for j in range(width)])
            y = with_scalars(
                data.join(weights.select("_f", "_w"), "_f")
                .groupBy(*sample)
                .agg(*[F.sum(F.col("_x") * F.col("_w")[j]).alias(f"y{j}") for j in range(width)]),
                offset,
            ).select(*sample, *[(F.col(f"y{j}") - F.col(f"o{j}")).alias(f"y{j}") for j in range(width)])
            y = cut_lineage(y)
            inner = _pair_sums(y, [f"y{j}" for j in range(width)])
            inverse = _inverse_root(inner)
            mixed = y.select(*sample, F.array(*[_dot(f"y{{}}", inverse[:, j]) for j in range(width)]).alias("_q"))
            z = cut_lineage(
                data.join(mixed, list(sample))
                .groupBy("_f")
                .agg(*[F.sum(F.col("_x") * F.col("_q")[j]).alias(f"z{j}") for j in range(width)])
            )
            values, turn = _eigh(_pair_sums(z, [f"z{j}" for j in range(width)]), width)
            weights = z.join(means, "_f").select(
                "_f", "_mean", F.array(*[_dot("z{}", turn[:, j] / max(np.sqrt(values[j]), 1e-300)) for j in range(width)]).alias("_w")
            )
            settled = k or width - 8
            if previous is not None and np.allclose(values[:settled], previous[:settled], rtol=tol, atol=0.0):
                break
            previous = values
        else:
            raise RuntimeError(f"the modes did not settle in {max_rounds} rounds")
        eigen = values / max(n - 1, 1)
        if k is not None or width >= min(n, c) or eigen[width - 8 - 1] <= 1.0:
            break
        width = min(n, c, 2 * width)
    keep = width if width >= min(n, c) else (k or width - 8)
    weights = cut_lineage(weights)

    def build(m: int) -> DataFrame:
        return weights.select("_f", F.posexplode(F.slice("_w", 1, min(m, keep))).alias("mode", "loading"))

    return _eigen_frame(spark, eigen[:keep]), build


def _dot(pattern: str, weights: np.ndarray):
    total = F.lit(0.0)
    for i, w in enumerate(weights):
        total = total + F.col(pattern.format(i)) * F.lit(float(w))
    return total


def _pair_sums(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Small Gram matrix of columns, as one aggregate."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1)]
    row = df.agg(*[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"s{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(cols), len(cols)))
    for (i, j), value in zip(pairs, row):
        out[i, j] = out[j, i] = value or 0.0
    return out


def _inverse_root(inner: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(inner)
    safe = np.where(values > values.max() * 1e-14, values, np.inf)
    return vectors / np.sqrt(safe)


# --- spatial modes of flood levels ----------------------------------------------------------------


@dataclass
class EofModel:
    """A fitted reduction as four small tables.

    ``cells``: ``cell_id, wetness, elevation, mean, weight``; ``eof``: ``mode, cell_id, loading``;
    ``eigen``: ``mode, eigenvalue``; ``mode_stats``: ``mode, mean, std``.
    """

    cells: DataFrame
    eof: DataFrame
    eigen: DataFrame
    mode_stats: DataFrame
    n_samples: int
    k: int
    parameter: str = "wse"

    TABLES = ("cells", "eof", "eigen", "mode_stats")

    def save(self, path: str) -> None:
        for name in self.TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.cells.sparkSession
        spark.createDataFrame(
            [(self.n_samples, self.k, self.parameter)], "n_samples long, k int, parameter string"
        ).write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EofModel:
        s = spark.read.parquet(f"{path}/settings").first()
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in cls.TABLES}
        return cls(**tables, n_samples=s["n_samples"], k=s["k"], parameter=s["parameter"])


def _modelled(series: DataFrame, cells: DataFrame, parameter: str) -> DataFrame:
    """Series joined to its cell columns, with depth in place of level where depth is modelled."""
    joined = series.select("run", "t", "cell_id", "value").join(cells, "cell_id")
    return joined.withColumn("value", depth("value", "elevation")) if parameter == "depth" else joined


def cell_statistics(
    series: DataFrame, info: DataFrame, wet_threshold: float = 0.03, parameter: str = "wse", weighted: bool = True
) -> DataFrame:
    """Wetness class, elevation, mean and weight (area, or 1) of every cell, from one pass."""
    cells = info.select("cell_id", "elevation", (F.col("area") if weighted else F.lit(1.0)).alias("weight"))
    values = _modelled(series, cells, parameter)
    extremes = values.groupBy("cell_id", "elevation", "weight").agg(
        F.avg("value").alias("mean"), F.min("value").alias("_lo"), F.max("value").alias("_hi")
    )
    # The class needs only the extremes, so it is taken from the summary rows.
    ends = extremes.select("cell_id", "elevation", F.explode(F.array("_lo", "_hi")).alias("_value"))
    base = F.col("_value") if parameter != "depth" else F.col("_value") + F.col("elevation")
    classes = wetness_class(ends.select("cell_id", "elevation", base.alias("value")), wet_threshold, parameter)
    return extremes.join(classes, "cell_id").select("cell_id", "wetness", "elevation", "mean", "weight")


def anomalies(series: DataFrame, cells: DataFrame, parameter: str = "wse") -> DataFrame:
    """Centred, weighted values ``x`` of the cells that are not always dry."""
    wet = cells.where(F.col("wetness") != ALWAYS_DRY).select("cell_id", "elevation", "mean", "weight")
    values = _modelled(series, wet, parameter)
    return values.select("run", "t", "cell_id", ((F.col("value") - F.col("mean")) * F.col("weight")).alias("x"))


def covariance(df: DataFrame, feature: str = "cell_id", value: str = "x", sample: Sequence[str] = ("run", "t")) -> DataFrame:
    """Covariance ``(i, j, cov)``, i <= j, of up to ``MAX_SIDE`` features; absent entries count as 0."""
    data = df.select(*sample, F.col(feature).alias("_f"), F.col(value).alias("_x"))
    n = data.select(*sample).distinct().count()
    index = _numbered(data, ["_f"])
    c = index.count()
    if c > MAX_SIDE:
        raise ValueError(f"{c} features need principal_modes, which does not form the covariance")
    rows = data.join(index, "_f").groupBy(*sample).agg(F.collect_list("_i").alias("idx"), F.collect_list("_x").alias("val"))
    second, first = gram.second_moments(rows, c)
    cov = (second - np.outer(first, first) / n) / max(n - 1, 1)
    wide = _vectors_for(index, cov, "_v").select(F.col("_f").alias("i"), F.posexplode("_v").alias("_j", "cov"))
    names = index.select(F.col("_i").alias("_j"), F.col("_f").alias("j"))
    return wide.join(names, "_j").where(F.col("i") <= F.col("j")).select("i", "j", "cov")


def fit_eof(
    series: DataFrame,
    info: DataFrame,
    k: int | None = None,
    wet_threshold: float = 0.03,
    parameter: str = "wse",
    weighted: bool = True,
    max_side: int = MAX_SIDE,
) -> EofModel:
    """Fit the reduction: drop dry cells, centre, weight, principal components.

    ``k`` of 0 or None keeps the modes that pass the separation rule.
    """
    cells = cut_lineage(cell_statistics(series, info, wet_threshold, parameter, weighted))
    x = anomalies(series, cells, parameter)
    found = principal_modes(x, ["run", "t"], "cell_id", "x", k or None, max_side)
    eigen = cut_lineage(found.eigen)
    if not k:
        k = norths_rule(eigen, found.n_samples).first()["modes"]
    k = min(k, eigen.count())
    eof = cut_lineage(found.loadings(k).select("mode", "cell_id", "loading"))
    # Scores of centred data have mean 0 and population variance eigenvalue * (n - 1) / n.
    n = found.n_samples
    stats = eigen.where(F.col("mode") < k).select(
        "mode", F.lit(0.0).alias("mean"), F.sqrt(F.col("eigenvalue") * ((n - 1) / n)).alias("std")
    )
    return EofModel(cells, eof, eigen, stats, n, k, parameter)


def _loading_arrays(eof: DataFrame, key: str = "cell_id") -> DataFrame:
    """Loadings of one cell as an array in mode order."""
    packed = F.array_sort(F.collect_list(F.struct("mode", "loading")))
    return eof.groupBy(key).agg(F.transform(packed, lambda s: s["loading"]).alias("_l"))


def _score_arrays(modes: DataFrame, value: str) -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct("mode", value)))
    return modes.groupBy("run", "t").agg(F.transform(packed, lambda s: s[value]).alias(f"_{value}"))


def standardise(df: DataFrame, stats: DataFrame, value: str, out: str, keys: Sequence[str] = ("mode",)) -> DataFrame:
    """``(value - mean) / std``; a constant column becomes 0."""
    usable = (F.col("std") > 0) & ~F.isnan("std")
    scaled = F.when(usable, (F.col(value) - F.col("mean")) / F.col("std")).otherwise(F.lit(0.0))
    return df.join(stats, list(keys)).withColumn(out, scaled).drop("mean", "std")


def _matrix_sums(rows: DataFrame, keys: Sequence[str], inner: Sequence[str], weights: DataFrame) -> DataFrame:
    """``(keys, mode, value)``: sums of ``_x * _w[mode]`` over ``inner``, for any number of modes.

    ``rows`` has the keys, ``inner`` and ``_x``; ``weights`` has ``inner`` and
    the array ``_w``. Both are dealt out as blocks of about ``BLOCK_SIDE`` keys
    by as many inner rows, each of which is one matrix product.
    """
    blocks = max(1, -(-weights.count() // BLOCK_SIDE))
    buckets = max(1, -(-rows.select(*keys).distinct().count() // BLOCK_SIDE))

    def dealt(cols: Sequence[str], n: int) -> Column:
        return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")

    left = rows.where(F.col("_x").isNotNull()).withColumns({"_block": dealt(inner, blocks), "_bucket": dealt(keys, buckets)})
    right = weights.withColumns({"_block": dealt(inner, blocks), "_bucket": F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))})
    kind = rows.select(*keys).schema.add("_s", T.ArrayType(T.DoubleType()))

    def product(values: pd.DataFrame, matrix: pd.DataFrame) -> pd.DataFrame:
        placed = values.merge(matrix[list(inner)].assign(_at=np.arange(len(matrix))), on=list(inner))
        if placed.empty:
            return pd.DataFrame({c: [] for c in [*keys, "_s"]})
        code = placed.groupby(list(keys), sort=False).ngroup().to_numpy()
        x = np.zeros((code.max() + 1, len(matrix)))
        np.add.at(x, (code, placed["_at"].to_numpy()), placed["_x"].to_numpy(dtype=float))
        out = placed[list(keys)].drop_duplicates()
        return out.assign(_s=list(x @ np.stack(matrix["_w"].to_numpy())))

    parts = left.groupBy("_block", "_bucket").cogroup(right.groupBy("_block", "_bucket")).applyInPandas(product, kind)
    return parts.select(*keys, F.posexplode("_s").alias("mode", "value")).groupBy(*keys, "mode").agg(F.sum("value").alias("value"))


def to_modes(series: DataFrame, model: EofModel) -> DataFrame:
    """Standardised mode scores ``(run, t, mode, z)``.

    Each value meets its cell's loadings once, as an array, so the rows are not
    multiplied by the number of modes before they are summed.
    """
    wet = model.cells.where(F.col("wetness") != ALWAYS_DRY)
    x = (F.col("value") - F.col("mean")) * F.col("weight")
    if model.k > MANY_MODES:
        values = _modelled(series, wet.select("cell_id", "elevation", "mean", "weight"), model.parameter)
        loadings = _loading_arrays(model.eof).withColumnRenamed("_l", "_w")
        scores = _matrix_sums(values.select("run", "t", "cell_id", x.alias("_x")), ["run", "t"], ["cell_id"], loadings)
        scores = scores.withColumnRenamed("value", "score")
    else:
        wet = wet.join(_loading_arrays(model.eof), "cell_id")
        values = _modelled(series, wet.select("cell_id", "elevation", "mean", "weight", "_l"), model.parameter)
        sums = values.select("run", "t", x.alias("_x"), "_l").groupBy("run", "t").agg(
            *[F.sum(F.col("_x") * F.get("_l", j)).alias(f"_s{j}") for j in range(model.k)]
        )
        scores = sums.select("run", "t", F.posexplode(F.array(*[f"_s{j}" for j in range(model.k)])).alias("mode", "score"))
    return standardise(scores, model.mode_stats, "score", "z").select("run", "t", "mode", "z")


def _matrix_cells(packed: DataFrame, cells: DataFrame, with_var: bool) -> DataFrame:
    """``_base + _c . _z`` of every step and cell, block by block as matrix products, for any number of modes."""
    packed, cells = cut_lineage(packed), cut_lineage(cells.withColumn("_c", F.transform("_c", lambda c: F.coalesce(c, F.lit(0.0)))))
    blocks, buckets = (max(1, -(-df.count() // BLOCK_SIDE)) for df in (cells, packed))

    def dealt(cols: Sequence[str], n: int, own: str, n_other: int, other: str) -> dict[str, Column]:
        return {own: F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))}

    left = packed.withColumns(dealt(["run", "t"], buckets, "_bucket", blocks, "_block"))
    right = cells.withColumns(dealt(["cell_id"], blocks, "_block", buckets, "_bucket"))
    kind = packed.select("run", "t").schema.add(cells.schema["cell_id"]).add("value", T.DoubleType())
    if with_var:
        kind = kind.add("var", T.DoubleType())

    def product(steps: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if steps.empty or some.empty:
            return pd.DataFrame({f: [] for f in kind.names})
        z = np.stack(steps["_z"].to_numpy())
        c = np.zeros((len(some), z.shape[1]))
        for i, own in enumerate(some["_c"]):
            c[i, : len(own)] = own
        out = {f: np.repeat(steps[f].to_numpy(), len(some)) for f in ("run", "t")} | {"cell_id": np.tile(some["cell_id"].to_numpy(), len(steps))}
        out["value"] = (z @ c.T + some["_base"].to_numpy(dtype=float)).ravel()
        if with_var:
            out["var"] = (np.stack(steps["_var"].to_numpy()) @ (c * c).T).ravel()
        return pd.DataFrame(out)

    return left.groupBy("_block", "_bucket").cogroup(right.groupBy("_block", "_bucket")).applyInPandas(product, kind)


def to_cells(modes: DataFrame, model: EofModel, block: int = 1024, salts: int = 1) -> DataFrame:
    """Cell values from mode scores, with ``var`` when the scores carry ``var``.

    ``modes``: ``run, t, mode, z [, var]``. Always-dry cells get their ground
    level (0 for depth) and variance 0.
    """
    with_var = "var" in modes.columns
    packed = _score_arrays(modes, "z")
    if with_var:
        packed = packed.join(_score_arrays(modes, "var"), ["run", "t"])
    stats = model.mode_stats.groupBy().agg(
        F.array_sort(F.collect_list(F.struct("mode", "mean", "std"))).alias("_stats")
    )
    loadings = _loading_arrays(model.eof)
    dry_value = F.lit(0.0) if model.parameter == "depth" else F.col("elevation")
    dry = F.col("wetness") == ALWAYS_DRY
    placed = with_scalars(model.cells.join(loadings, "cell_id", "left"), stats)
    # Per cell: offset and one coefficient per mode, so each output value is one short dot product.
    coef = F.transform(
        F.sequence(F.lit(0), F.lit(model.k - 1)),
        lambda j: F.get("_l", j) * F.get("_stats", j)["std"] / F.col("weight"),
    )
    shift = F.aggregate(
        F.transform(F.sequence(F.lit(0), F.lit(model.k - 1)), lambda j: F.get("_l", j) * F.get("_stats", j)["mean"]),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )
    cells = placed.select(
        "cell_id",
        F.when(dry, dry_value).otherwise(F.col("mean") + shift / F.col("weight")).alias("_base"),
        F.when(dry, F.array().cast("array<double>")).otherwise(coef).alias("_c"),
    )
    if model.k > MANY_MODES:
        return _matrix_cells(packed, cells, with_var)
    product = pair_up(packed, cells, block, salts)
    terms, spread = F.lit(0.0), F.lit(0.0)
    for j in range(model.k):
        c = F.coalesce(F.get("_c", j), F.lit(0.0))
        terms = terms + c * F.get("_z", j)
        if with_var:
            spread = spread + c * c * F.get("_var", j)
    out = [F.col("run"), F.col("t"), F.col("cell_id"), (F.col("_base") + terms).alias("value")]
    return product.select(*out, *([spread.alias("var")] if with_var else []))


def var_to_cells(modes: DataFrame, model: EofModel, block: int = 1024, salts: int = 1) -> DataFrame:
    """Variance of cell values from mode variances ``(run, t, mode, var)``; dry cells 0."""
    scored = modes.withColumn("z", F.lit(0.0)) if "z" not in modes.columns else modes
    return to_cells(scored, model, block, salts).select("run", "t", "cell_id", "var")
