"""Table schemas shared by the readers, the operators and the models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))

SERIES = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("t", T.IntegerType()),
        T.StructField("cell_id", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
    ]
)

CELL_INFO = T.StructType(
    [
        T.StructField("cell_id", T.IntegerType()),
        T.StructField("lf_cell_id", T.IntegerType()),
        T.StructField("elevation", T.DoubleType()),
        T.StructField("area", T.DoubleType()),
        T.StructField("ring", RING),
    ]
)

REF_LINES = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("t", T.IntegerType()),
        T.StructField("line", T.StringType()),
        T.StructField("flow", T.DoubleType()),
        T.StructField("wse", T.DoubleType()),
    ]
)

STORM_SERIES = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("datetime", T.TimestampNTZType()),
        T.StructField("inflow", T.DoubleType()),
        T.StructField("precip_cum", T.DoubleType()),
        T.StructField("precip_excess", T.DoubleType()),
    ]
)

EVENT_PLANS = T.StructType(
    [
        T.StructField("plan_title", T.StringType()),
        T.StructField("event_number", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("set", T.StringType()),
    ]
)

CATALOGUE_ASSET = T.StructType(
    [
        T.StructField("href", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("roles", T.ArrayType(T.StringType())),
        T.StructField("event_id", T.LongType()),
        T.StructField(
            "properties",
            T.StructType(
                [
                    T.StructField("Set", T.StringType()),
                    T.StructField("avg_precip_in", T.DoubleType()),
                    T.StructField("peak_inflow_cfs", T.DoubleType()),
                    T.StructField("recurrence_interval_precip", T.DoubleType()),
                    T.StructField("recurrence_interval_inflow", T.DoubleType()),
                ]
            ),
        ),
    ]
)


@dataclass
class Dataset:
    """The four aligned tables one experiment works on."""

    hf: DataFrame
    lf: DataFrame
    cell_info: DataFrame
    ref_lines: DataFrame
