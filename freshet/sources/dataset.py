"""The aligned data set on disk, and reshaping of raw tables into it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet import schema
from freshet.functions import scan
from freshet.schema import Dataset

TABLES = ("hf", "lf", "cell_info", "ref_lines")
# Groups of cells and steps that a run's rows are dealt out in when they are written.
WRITE_GROUPS = 256
FORCING = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("t", T.IntegerType()),
        T.StructField("feature", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table lies at ``path`` (its success marker is there)."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(jvm_path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether all four tables of a data set are there."""
    return all(table_exists(spark, f"{path}/{name}") for name in TABLES)


def read_dataset(spark: SparkSession, path: str, forcing: bool = False) -> Dataset:
    """Open a data set; ``forcing`` says its low-fidelity table holds features rather than cells."""
    schemas = {
        "hf": schema.SERIES,
        "lf": FORCING if forcing else schema.SERIES,
        "cell_info": schema.CELL_INFO,
        "ref_lines": schema.REF_LINES,
    }
    return Dataset(**{name: spark.read.schema(s).parquet(f"{path}/{name}") for name, s in schemas.items()})


def write_dataset(ds: Dataset, path: str) -> None:
    """Write the four tables, series partitioned by run.

    Each run's rows are spread over many groups by cell and chunk of steps, so
    neither a long run nor a long line ends up in one writer task. Small groups
    share a task and its files.
    """
    for name in ("hf", "lf", "ref_lines"):
        df = getattr(ds, name)
        spread = next(c for c in ("cell_id", "feature", "line") if c in df.columns)
        split = F.pmod(F.xxhash64(spread, scan.chunk_of("t")), F.lit(WRITE_GROUPS))
        df.repartition("run", split).sortWithinPartitions("run", spread, "t").write.mode("overwrite").partitionBy(
            "run"
        ).parquet(f"{path}/{name}")
    ds.cell_info.write.mode("overwrite").parquet(f"{path}/cell_info")


def materialize(spark: SparkSession, path: str, build: Callable[[], Dataset], forcing: bool = False) -> Dataset:
    """Reuse the data set at ``path`` when complete, else build and write it first."""
    if not is_complete(spark, path):
        write_dataset(build(), path)
    return read_dataset(spark, path, forcing)


def to_long(df: DataFrame, keys: Sequence[str] = ("run", "t"), name: str = "cell_id", value: str = "value") -> DataFrame:
    """Wide matrix with one column per cell to one row per cell."""
    cells = [c for c in df.columns if c not in keys]
    long = df.unpivot(list(keys), cells, name, value)
    if all(c.isdigit() for c in cells):
        long = long.withColumn(name, F.col(name).cast("int"))
    return long


def from_arrays(
    df: DataFrame, col: str, keys: Sequence[str] = ("run", "t"), name: str = "cell_id", value: str = "value"
) -> DataFrame:
    """One array per step to one row per cell; the position is the cell."""
    return df.select(*keys, F.posexplode(col).alias(name, value))


def union_wide(frames: Sequence[DataFrame], keys: Sequence[str] = ("run", "t")) -> DataFrame:
    """Long form of many runs' wide matrices."""
    return reduce(lambda a, b: a.unionByName(b), [to_long(f, keys) for f in frames])


def reference_lines(df: DataFrame, lines: Sequence[str], cuts: DataFrame | None = None) -> DataFrame:
    """Flow and level of the chosen lines side by side, one row per run and step, optionally clipped."""
    from freshet.operators.windows import clip

    picked = df.where(F.col("line").isin(*lines))
    if cuts is not None:
        picked = clip(picked, cuts)
    wide = picked.groupBy("run", "t").pivot("line", list(lines)).agg(F.max("flow").alias("flow"), F.max("wse").alias("wse"))
    renamed = {f"{line}_flow": f"{line}_flows" for line in lines}
    return wide.withColumnsRenamed(renamed)
