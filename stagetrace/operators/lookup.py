"""Display names and info records for ids found in facts.

The dimensions carry no join hint: Spark broadcasts one when its size is below
spark.sql.autoBroadcastJoinThreshold and shuffles with skew handling otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: tenant shown for a farm that is in no mapping.
UNKNOWN = "Unknown"


def join_key(key: str) -> Column:
    """A dimension key for joining facts of which one id may hold a large share.

    Spark splits a skewed fact partition only if both sides are shuffled for the
    join.  A dimension comes out of an aggregate by its key and would be used as
    it lies; comparing with an expression of the key gives it a shuffle, which is
    small, and is not needed at all when the dimension is broadcast.
    """
    return F.concat(F.col(key), F.lit(""))


def with_display_name(
    df: DataFrame, dim: DataFrame, key: str, name: str, alias: str, missing: str | None = None
) -> DataFrame:
    """Add the name of an id: the mapped name, else the id, else `missing`."""
    names = dim.select(join_key(key).alias("_id"), F.col(name).alias("_name"))
    shown = [F.col("_name"), F.col(key)] + ([F.lit(missing)] if missing else [])
    return (
        df.join(names, F.col(key) == F.col("_id"), "left")
        .withColumn(alias, F.coalesce(*shown))
        .drop("_id", "_name")
    )


def farm_info(ids: DataFrame, farms: DataFrame) -> DataFrame:
    """Full farm record for each row's `farm_id`, defaults where it is unmapped."""
    farms = farms.select(join_key("farm_id").alias("_id"), "farm_name", "tenant_id", "tenant_name")
    return ids.join(farms, F.col("farm_id") == F.col("_id"), "left").select(
        *ids.columns,
        F.coalesce("farm_name", "farm_id").alias("farm_name"),
        F.coalesce("tenant_id", F.lit("")).alias("tenant_id"),
        F.coalesce("tenant_name", F.lit(UNKNOWN)).alias("tenant_name"),
    )


def camera_info(ids: DataFrame, cameras: DataFrame) -> DataFrame:
    """Full camera record for each row's `camera_id`.

    With a camera dimension from site configuration the record also names the
    camera's farm.
    """
    columns = [*ids.columns, F.coalesce("camera_name", "camera_id").alias("camera_name")]
    if "farm_name" in cameras.columns:
        columns += [
            F.coalesce("farm_name", F.lit(UNKNOWN)).alias("farm_name"),
            F.coalesce("farm_id", F.lit("")).alias("farm_id"),
        ]
    others = [c for c in cameras.columns if c != "camera_id"]
    cameras = cameras.select(join_key("camera_id").alias("_id"), *others)
    return ids.join(cameras, F.col("camera_id") == F.col("_id"), "left").select(*columns)
