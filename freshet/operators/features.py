"""Features of rainfall and inflow that drive a surrogate without a low-fidelity mesh."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.exprs import feature_class
from freshet.operators.joins import pair_up
from freshet.operators.reduce import MAX_SIDE, principal_modes, standardise
from freshet.operators.stats import mean_rainfall, norths_rule
from freshet.operators.windows import api
from freshet.session import cut_lineage


def forcing_table(inflow: DataFrame, rain: DataFrame) -> DataFrame:
    """Inflow and rainfall features on the union of their steps; what one side lacks is 0."""
    both = inflow.select("run", "t", "feature", "value").unionByName(rain.select("run", "t", "feature", "value"))
    spine = pair_up(both.select("run", "t").distinct(), both.select("feature").distinct())
    return spine.join(both, ["run", "t", "feature"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


@dataclass
class ForcingModel:
    """``input_stats``: ``feature, mean``; ``eof``: ``mode, feature, loading``; ``stats``: ``feature, mean, std``."""

    input_stats: DataFrame
    eof: DataFrame
    eigen: DataFrame
    stats: DataFrame
    k: int
    n_samples: int
    carry_over: bool = False

    TABLES = ("input_stats", "eof", "eigen", "stats")

    def save(self, path: str) -> None:
        for name in self.TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.stats.sparkSession
        spark.createDataFrame(
            [(self.k, self.n_samples, self.carry_over)], "k int, n_samples long, carry_over boolean"
        ).write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ForcingModel:
        s = spark.read.parquet(f"{path}/settings").first()
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in cls.TABLES}
        return cls(**tables, k=s["k"], n_samples=s["n_samples"], carry_over=s["carry_over"])


def derived_features(centred: DataFrame, eof: DataFrame | None, k: int, carry_over: bool = False) -> DataFrame:
    """Boundary values, rainfall modes, mean rainfall and two antecedent indices, as long features."""
    boundary = centred.where(feature_class("feature") == "boundary")
    rain = mean_rainfall(centred)
    parts = [
        boundary.select("run", "t", "feature", "value"),
        rain.select("run", "t", F.lit("rain_mean").alias("feature"), F.col("rain").alias("value")),
    ]
    for name, decay in (("rain_api", 0.85), ("rain_sum", 1)):
        index = api(rain, decay, carry_over=carry_over)
        parts.append(index.select("run", "t", F.lit(name).alias("feature"), F.col("api").alias("value")))
    if eof is not None and k:
        packed = F.array_sort(F.collect_list(F.struct("mode", "loading")))
        arrays = eof.groupBy("feature").agg(F.transform(packed, lambda s: s["loading"]).alias("_l"))
        sums = centred.join(arrays, "feature").groupBy("run", "t").agg(
            *[F.sum(F.col("value") * F.get("_l", j)).alias(f"_s{j}") for j in range(k)]
        )
        modes = sums.select("run", "t", F.posexplode(F.array(*[f"_s{j}" for j in range(k)])).alias("_m", "value"))
        parts.append(modes.select("run", "t", F.concat(F.lit("rain_pc_"), F.col("_m").cast("string")).alias("feature"), "value"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def centre(df: DataFrame, input_stats: DataFrame) -> DataFrame:
    joined = df.join(input_stats, "feature")
    return joined.select("run", "t", "feature", (F.col("value") - F.col("mean")).alias("value"))


def fit_forcing_features(
    df: DataFrame, k: int | None = None, carry_over: bool = False, max_side: int = MAX_SIDE
) -> ForcingModel:
    """Fit on long forcing features ``(run, t, feature, value)`` with dense steps.

    ``k`` of 0 or None keeps the rainfall modes that pass the separation rule.
    The last scaling uses the deviation of non-zero values only.
    """
    input_stats = cut_lineage(df.groupBy("feature").agg(F.avg("value").alias("mean")))
    centred = centre(df, input_stats)
    found = principal_modes(
        centred.where(feature_class("feature") == "precip"), ["run", "t"], "feature", "value", k or None, max_side
    )
    eigen = cut_lineage(found.eigen)
    if not k:
        k = norths_rule(eigen, found.n_samples).first()["modes"]
    k = min(k, eigen.count())
    eof = cut_lineage(found.loadings(k).select("mode", "feature", "loading"))
    features = derived_features(centred, eof, k, carry_over)
    nonzero = F.when(F.col("value") != 0, F.col("value"))
    stats = features.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop(nonzero).alias("std"))
    return ForcingModel(input_stats, eof, eigen, cut_lineage(stats), k, found.n_samples, carry_over)


def transform_forcing(df: DataFrame, model: ForcingModel) -> DataFrame:
    """Standardised features ``(run, t, feature, z)``."""
    features = derived_features(centre(df, model.input_stats), model.eof, model.k, model.carry_over)
    return standardise(features, model.stats, "value", "z", ["feature"]).select("run", "t", "feature", "z")
