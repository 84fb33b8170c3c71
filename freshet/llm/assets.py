"""Files that tasks need (vocabularies), sent to every executor by Spark."""

from __future__ import annotations

import os

from pyspark import SparkFiles
from pyspark.sql import SparkSession


def send(spark: SparkSession, path: str) -> str:
    """Give a file of the driver to all tasks; its name there is returned. Sending it again does nothing."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def place(name: str) -> str:
    """Inside a task: where a sent file lies."""
    return SparkFiles.get(name)
