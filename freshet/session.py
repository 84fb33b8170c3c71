"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job here relies on.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Merged shuffle partitions. Rows of steps and cells are 15 to 80 times as large in a sort as in a shuffle
    # file, so tasks of the default 64 MB hold gigabytes; a session of few partitions would not split them either.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "200",
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Lets a join on (run, cell, chunk, t) use inputs partitioned by (run, cell, chunk).
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application: their Python need not have it installed."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, file.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(target))
        _SHIPPED.add(app)
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere, and ship the package."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return ship(spark)


def shares_partitioning(spark: SparkSession) -> bool:
    """Whether joins may use inputs partitioned by some of the join keys."""
    return spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition", "true") == "false"


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("freshet")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def shared_folder(spark: SparkSession) -> str:
    """A fresh path in the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master, where the driver's disk is every task's disk, may fall
    back on a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/freshet-{uuid.uuid4().hex}"


_KEPT: dict[str, list[str]] = {}


@contextmanager
def job_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that ``cut_lineage`` keeps inside this scope when it ends.

    Results must be written or collected before the scope is left.
    """
    app = spark.sparkContext.applicationId
    before = len(_KEPT.setdefault(app, []))
    try:
        yield
    finally:
        gone, _KEPT[app] = _KEPT[app][before:], _KEPT[app][:before]
        jvm = spark.sparkContext._jvm
        for path in gone:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the table to the shared folder and read it back.

    The table outlives lost executors, is computed once, and keeps column
    pruning and filter pushdown for what follows.
    """
    path = shared_folder(df.sparkSession)
    _KEPT.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
