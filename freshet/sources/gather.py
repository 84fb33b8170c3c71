"""Gathering storm series from per-event record catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VARIABLES = ("inflow", "precip_cum", "precip_excess")


def choose_records(catalogue: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """First record per event and label whose path holds both the site and the parameter, case aside.

    Events without any match vanish. Every record is tested against each label
    in place, and only the winning record per event and label is shuffled.
    """
    path = F.lower("path")
    labels = F.array(
        *[
            F.when(path.contains(site.lower()) & path.contains(part.lower()), F.lit(label))
            for label, (site, part) in wanted.items()
        ]
    )
    matched = catalogue.withColumn("label", F.explode(F.array_compact(labels)))
    rest = [c for c in catalogue.columns if c != "event_id"]
    first = matched.groupBy("event_id", "label").agg(F.min_by(F.struct(*rest), F.struct("ord", "path")).alias("_r"))
    return first.select("event_id", "label", "_r.*")


def gather_event_series(records: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """Storm series: one row per event and time with one column per label, times outer-aligned.

    ``records``: ``event_id, ord, path, times array<timestamp>, vals array<double>``.
    """
    chosen = choose_records(records, wanted)
    points = chosen.select(
        "event_id", "label", F.inline(F.arrays_zip(F.col("times").alias("datetime"), F.col("vals").alias("value")))
    )
    return align_series(points, list(wanted))


def align_series(points: DataFrame, labels: list[str]) -> DataFrame:
    """``(event_id, label, datetime, value)`` to one column per label, sorted by event and time."""
    wide = points.groupBy("event_id", "datetime").pivot("label", labels).agg(F.max("value"))
    return wide.orderBy("event_id", "datetime")


def filter_keys(df: DataFrame, pattern: str, suffix: str = "", key: str = "key") -> DataFrame:
    """Object keys that start with a ``prefix*pattern`` and end with a suffix.

    The part before the first ``*`` is a plain prefix test, which reaches the scan.
    """
    prefix = pattern.split("*")[0]
    regex = "^" + pattern.replace("*", ".*")
    c = F.col(key)
    return df.where(c.startswith(prefix) & c.rlike(regex) & c.endswith(suffix))


