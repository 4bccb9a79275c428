"""The questions a user of the dashboard asks, each as one DataFrame."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagetrace.functions.choices import as_day, chosen
from stagetrace.operators import details, dims, display, facets, linkage
from stagetrace.operators.linkage import NO_FILTERS, PAGE_ROWS, STANDARD, Filters, Modes
from stagetrace.sources import tables


@dataclass(frozen=True)
class Workspace:
    """The five tables, and the cleaned dimensions as lazy frames."""

    detections: DataFrame
    inferences: DataFrame
    tenant_map: DataFrame
    farm_map: DataFrame
    camera_map: DataFrame

    @cached_property
    def tenants(self) -> DataFrame:
        return dims.tenant_dim(self.tenant_map)

    @cached_property
    def farms(self) -> DataFrame:
        return dims.farm_dim(self.farm_map, self.tenants)

    @cached_property
    def cameras(self) -> DataFrame:
        return dims.camera_dim(self.camera_map)

    @classmethod
    def open(cls, spark: SparkSession, where: tables.Tables) -> Workspace:
        """Dimensions are read anew by every query, so they are never stale."""
        return cls(
            tables.scan_detections(spark, where.detections),
            tables.scan_inferences(spark, where.inferences),
            tables.scan_tenants(spark, where.tenants),
            tables.scan_farms(spark, where.farms),
            tables.scan_cameras(spark, where.cameras),
        )


def load_filters(ws: Workspace, day: str | dt.date) -> DataFrame:
    """The three filter lists of a day, told apart by the column `facet`; one scan."""
    return facets.all_lists(ws.detections, ws.farms, ws.cameras, day)


def after_tenant_choice(ws: Workspace, day: str | dt.date, tenant: Any) -> DataFrame:
    """Farm and camera lists once a tenant is chosen; cameras go back to all."""
    lists = (facets.FARM, facets.CAMERA)
    return facets.all_lists(ws.detections, ws.farms, ws.cameras, day, lists, tenant)


def after_farm_choice(ws: Workspace, day: str | dt.date, farm: Any) -> DataFrame:
    """Camera list once a farm is chosen."""
    cameras = facets.camera_facet(ws.detections, ws.cameras, day, farm)
    return cameras.select(F.lit(facets.CAMERA).alias("facet"), "*")


def facet_counts(ws: Workspace, day: str | dt.date) -> DataFrame:
    """How many tenants, farms and cameras the lists offer, and the status line."""
    entries = facets.entries(ws.detections, ws.farms, ws.cameras, day)

    def count(facet: str) -> Column:
        return F.count_if(F.col("facet") == facet)

    counted = entries.agg(
        count("tenant").alias("tenants"),
        count("farm").alias("farms"),
        count("camera").alias("cameras"),
    )
    # fixed text of the status line
    status = F.format_string(
        f"Loaded %d tenants, %d farms, %d cameras for {as_day(day)}",
        "tenants",
        "farms",
        "cameras",
    )
    return counted.withColumn("status", status)


def linked(
    ws: Workspace,
    day: str | dt.date,
    filters: Filters = NO_FILTERS,
    limit: int | None = None,
    modes: Modes = STANDARD,
) -> DataFrame:
    farms = ws.farms if chosen(filters.tenant) is not None else None
    return linkage.link_stages(
        ws.detections, ws.inferences, day, filters, farms, limit, modes
    )


def linked_display(
    ws: Workspace,
    day: str | dt.date,
    filters: Filters = NO_FILTERS,
    limit: int | None = None,
    modes: Modes = STANDARD,
) -> DataFrame:
    """Linked rows as a display table; a limit keeps the newest."""
    return display.display_table(linked(ws, day, filters, limit, modes), ws.farms, ws.cameras)


def _name(dim: DataFrame, key: str, name: str, value: str) -> Column:
    """Display name of one id as a scalar subquery; the id if it is unmapped."""
    found = dim.where(F.col(key) == F.lit(value)).agg(F.max(name))
    return F.coalesce(found.scalar(), F.lit(value))


def filter_summary(ws: Workspace, day: str | dt.date, filters: Filters) -> Column:
    """The active filters as one line of text."""
    parts = [F.lit(f"Date: {as_day(day)}")]
    for label, bound in (("From", filters.start), ("To", filters.end)):
        if (bound or "").strip():
            parts.append(F.lit(f"{label}: {bound}"))
    for label, value, dim, key, name in (
        ("Tenant", filters.tenant, ws.tenants, "tenant_id", "tenant_name"),
        ("Farm", filters.farm, ws.farms, "farm_id", "farm_name"),
        ("Camera", filters.camera, ws.cameras, "camera_id", "camera_name"),
    ):
        if chosen(value) is not None:
            shown = _name(dim, key, name, chosen(value))
            parts.append(F.concat(F.lit(f"{label}: "), shown))
    return F.concat_ws(" | ", *parts)


def query_status(
    ws: Workspace,
    day: str | dt.date,
    filters: Filters = NO_FILTERS,
    page_rows: int = PAGE_ROWS,
    modes: Modes = STANDARD,
) -> DataFrame:
    """One row: the number of all results, how many of them a page shows, and the status line."""
    counted = linked(ws, day, filters, modes=modes).agg(F.count("*").alias("results"))
    summary = filter_summary(ws, day, filters)
    # fixed texts of the status line
    found = F.concat(F.lit("Found "), F.col("results"), F.lit(" results | "), summary)
    none = F.concat(F.lit("No results found. Filters: "), summary)
    return counted.withColumns(
        {
            "on_page": F.least("results", F.lit(page_rows).cast("long")),
            "status": F.when(F.col("results") > 0, found).otherwise(none),
        }
    )


def row_details(
    ws: Workspace,
    session_id: str,
    inference_id: str | None = None,
    day: str | dt.date | None = None,
    modes: Modes = STANDARD,
) -> DataFrame:
    """Details of one event, found by its ids rather than by its row number.

    Only the session's keys go to the inferences; a known day bounds both scans.
    """
    rows = linkage.link_session(ws.detections, ws.inferences, session_id, day, modes)
    if inference_id is not None:
        rows = rows.where(F.col("stage2_inference_id") == F.lit(inference_id))
    return details.event_details(rows, ws.farms, ws.cameras)
