"""Tenant, farm and camera dimensions with their defaults filled in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagetrace.functions.text import or_default

# Names shown when a mapping row has none.
UNKNOWN_TENANT = "Unknown Tenant"
UNKNOWN_FARM = "Unknown Farm"
UNKNOWN_CAMERA = "Unknown Camera"


def latest_per_key(
    df: DataFrame, key: str, order: Sequence[str | Column] | None = None
) -> DataFrame:
    """One row per key: the last one in the given order.

    Without an order the greatest row by its remaining columns is kept, so the
    result does not depend on how files were read.  This is an aggregate, merged
    on the map side, so a key with very many rows costs no large group.
    """
    rest = [c for c in df.columns if c != key]
    rank = F.struct(*(order if order is not None else rest))
    best = F.max_by(F.struct(*rest), rank).alias("_row")
    return df.groupBy(key).agg(best).select(key, "_row.*").select(*df.columns)


def _without_header(df: DataFrame, key: str) -> DataFrame:
    """Drop null ids and header lines that were loaded as data."""
    return df.where(F.col(key).isNotNull() & (F.col(key) != F.lit(key)))


def tenant_dim(tenants: DataFrame, order: Sequence[str | Column] | None = None) -> DataFrame:
    rows = latest_per_key(_without_header(tenants, "tenant_id"), "tenant_id", order)
    return rows.select(
        "tenant_id",
        or_default(F.col("tenant_name"), UNKNOWN_TENANT).alias("tenant_name"),
        F.coalesce("tenant_ui_url", F.lit("")).alias("tenant_ui_url"),
        F.coalesce("tenant_slug", F.lit("")).alias("tenant_slug"),
    )


def farm_dim(
    farms: DataFrame,
    tenants: DataFrame,
    order: Sequence[str | Column] | None = None,
) -> DataFrame:
    """Farms with the name of their tenant; `tenants` is a tenant dimension."""
    rows = latest_per_key(_without_header(farms, "farm_id"), "farm_id", order)
    names = tenants.where("tenant_id <> ''").select("tenant_id", "tenant_name")
    return rows.join(names, "tenant_id", "left").select(
        "farm_id",
        or_default(F.col("farm_name"), UNKNOWN_FARM).alias("farm_name"),
        F.coalesce("tenant_id", F.lit("")).alias("tenant_id"),
        F.coalesce("tenant_name", F.lit(UNKNOWN_TENANT)).alias("tenant_name"),
    )


def camera_dim(cameras: DataFrame, order: Sequence[str | Column] | None = None) -> DataFrame:
    rows = latest_per_key(_without_header(cameras, "camera_id"), "camera_id", order)
    return rows.select(
        "camera_id", or_default(F.col("camera_name"), UNKNOWN_CAMERA).alias("camera_name")
    )


def _site_farms(configs: DataFrame, order: Sequence[str]) -> DataFrame:
    farm = configs.select(*order, F.posexplode("farms").alias("_farm_at", "farm"))
    return farm.select(
        *order,
        "_farm_at",
        F.coalesce("farm.uuid", F.lit("")).alias("farm_id"),
        F.coalesce("farm.name", F.lit(UNKNOWN_FARM)).alias("farm_name"),
        F.col("farm.cameras").alias("cameras"),
    )


def site_farms(configs: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Farm dimension of site configuration documents.

    Of several entries for a farm the last one counts: of the last document by the
    columns `order`, and within it by position.  Entries that tie are told apart by
    their values.
    """
    farms = _site_farms(configs, order).where("farm_id <> ''")
    farms = farms.select(*order, "_farm_at", "farm_id", "farm_name")
    last = latest_per_key(farms, "farm_id", [*order, "_farm_at", "farm_name"])
    return last.select("farm_id", "farm_name")


def site_cameras(configs: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Camera dimension of site configuration documents, with farm id and name.

    Of several entries for a camera the last one counts, as for farms.
    """
    cameras = _site_farms(configs, order).select(
        *order, "_farm_at", "farm_id", "farm_name",
        F.posexplode("cameras").alias("_camera_at", "camera"),
    )
    rows = cameras.select(
        *order,
        "_farm_at",
        "_camera_at",
        F.coalesce("camera.uuid", F.lit("")).alias("camera_id"),
        F.coalesce("camera.name", F.lit(UNKNOWN_CAMERA)).alias("camera_name"),
        "farm_name",
        "farm_id",
    ).where("camera_id <> ''")
    rank = [*order, "_farm_at", "_camera_at", "camera_name", "farm_name", "farm_id"]
    last = latest_per_key(rows, "camera_id", rank)
    return last.select("camera_id", "camera_name", "farm_name", "farm_id")
