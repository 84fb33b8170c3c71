"""Event plans and event catalogues."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.functions import scan
from freshet.schema import CATALOGUE_ASSET, EVENT_PLANS

# The catalogue's format.
RECORD_FILE = "SST.dss"
RAIN_FILE = "exported-precip_trinity.p01.tmp.hdf"
RECORD_TYPE = "application/x.hec-dss"
CATALOGUE_ID = "GPR_SST_Events"
CATALOGUE_VERSION = "1.1.0"

FOLDS = {"train": ("Train", "AEP"), "test": ("Train", "Diverse")}


def plans(spark: SparkSession, path: str, type: str | None = None, set: str | None = None) -> DataFrame:
    """Event plans of a JSON plan list, optionally of one role and set."""
    df = spark.read.schema(EVENT_PLANS).json(path, multiLine=True)
    return pick_plans(df, type, set)


def pick_plans(df: DataFrame, type: str | None = None, set: str | None = None) -> DataFrame:
    if type is not None:
        df = df.where(F.col("type") == type)
    if set is not None:
        df = df.where(F.col("set") == set)
    return df


def fold(df: DataFrame, part: str) -> DataFrame:
    """Cross-validation fold inside the training events: design storms train, diverse storms test."""
    return pick_plans(df, *FOLDS[part])


def catalogue_to_plans(df: DataFrame, assets: str = "assets", prefix: str = "gpr") -> DataFrame:
    """Plans ``<prefix>1, <prefix>2, ...`` in catalogue order from a catalogue's asset map.

    ``df`` has one row per catalogue with ``assets`` as JSON text or as a map.
    """
    if isinstance(df.schema[assets].dataType, T.StringType):
        df = df.withColumn(assets, F.from_json(assets, T.MapType(T.StringType(), CATALOGUE_ASSET)))
    return asset_plans(df.select(F.posexplode(F.map_values(assets)).alias("pos", "asset")), prefix)


def asset_plans(df: DataFrame, prefix: str = "gpr") -> DataFrame:
    """Plans from ``(pos, asset)`` rows."""
    asset = F.col("asset")
    return df.select(
        F.concat(F.lit(prefix), (F.col("pos") + 1).cast("string")).alias("plan_title"),
        asset["event_id"].alias("event_number"),
        F.get(asset["roles"], 0).alias("type"),
        asset["properties"]["Set"].alias("set"),
        asset["href"].alias("flow_path"),
        F.replace(asset["href"], F.lit(RECORD_FILE), F.lit(RAIN_FILE)).alias("precip_path"),
    )


def event_assets(selected: DataFrame, prefix: str) -> DataFrame:
    """Catalogue assets, one row per selected event, numbered in event order.

    Numbers are rounded to two decimals by their exact binary value, as the
    catalogue's writer does; SQL rounding goes by the shortest decimal text and
    differs on ties.
    """

    @F.pandas_udf(T.DoubleType())
    def two(values: pd.Series) -> pd.Series:
        return values.map(lambda v: round(v, 2) if pd.notna(v) else v).astype("float64")

    placed = scan.row_position(selected, [], ["event_id"], scan.chunk_of("event_id"), "pos")
    return placed.select(
        "pos",
        F.struct(
            F.concat(F.lit(f"{prefix}/"), F.col("event_id").cast("string"), F.lit(f"/hydrology/{RECORD_FILE}")).alias("href"),
            F.lit(RECORD_TYPE).alias("type"),
            F.array("type").alias("roles"),
            F.col("event_id").cast("long").alias("event_id"),
            F.struct(
                F.coalesce("set", F.lit("Unknown")).alias("Set"),
                two("precip_cum").alias("avg_precip_in"),
                two("inflow").alias("peak_inflow_cfs"),
                two("rp_precip").alias("recurrence_interval_precip"),
                two("rp_inflow").alias("recurrence_interval_inflow"),
            ).alias("properties"),
        ).alias("asset"),
    )


def plans_to_catalogue(selected: DataFrame, prefix: str) -> DataFrame:
    """One-row catalogue JSON of the selected events (tens of events by construction)."""
    assets = event_assets(selected, prefix)
    entries = F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "asset"))),
        lambda e: F.struct(e["asset"]["event_id"].cast("string").alias("key"), e["asset"].alias("value")),
    )
    role = F.get(F.col("asset.roles"), 0)
    packed = assets.agg(
        F.map_from_entries(entries).alias("assets"),
        F.count_if(role == "Train").alias("train_event_count"),
        F.count_if(role == "Test").alias("test_event_count"),
    )
    nothing = F.lit(None).cast("string")
    whole = F.struct(
        F.lit("Feature").alias("type"),
        F.lit(CATALOGUE_VERSION).alias("stac_version"),
        F.lit(CATALOGUE_ID).alias("id"),
        nothing.alias("geometry"),
        nothing.alias("bbox"),
        F.struct(nothing.alias("datetime"), "train_event_count", "test_event_count").alias("properties"),
        F.array().cast("array<string>").alias("links"),
        F.col("assets"),
    )
    return packed.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("catalogue"))
