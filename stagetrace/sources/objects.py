"""Listing media objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_objects(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """URI and size of every object under a root; no content is read.

    Spark's file listing passes over objects of no bytes.  Which objects exist is a
    semi or anti join with the listing.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(root).select(
        F.col("path").alias("uri"), F.col("length").alias("n_bytes")
    )
