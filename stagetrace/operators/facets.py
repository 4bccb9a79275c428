"""Filter lists: the tenants, farms and cameras seen on a day.

Every list has the columns `pos`, `label` and `id`; position 0 is "All".
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagetrace.functions.choices import ALL, chosen
from stagetrace.functions.sizes import estimated_bytes
from stagetrace.operators.linkage import events_on_day
from stagetrace.operators.lookup import join_key

# The names of the lists.
TENANT, FARM, CAMERA = "tenant", "farm", "camera"

# Plan parameters; positions never depend on them.
# Entries that cut the lists into parts.
SPLITTERS = 64
# Lists made of no more bytes, by Spark's estimate, are sorted whole, a list in a task.
WHOLE_LIST_BYTES = 32 << 20


def numbered(rows: DataFrame, source: DataFrame) -> DataFrame:
    """Add `pos`, each entry's place in its `facet` by label and id, from 1.

    No list passes through one task if `source`, of which the lists are made, has more
    than WHOLE_LIST_BYTES.  The entries with the
    smallest hashes, a sample that depends on the entries alone, cut all lists into parts;
    an entry's place is its place in its part, which is sorted alone, after the sizes of
    the parts before.  Whatever evaluates the sample or the sizes again gets the same.
    """
    columns = ("facet", "label", "id")
    if estimated_bytes(source) <= WHOLE_LIST_BYTES:
        place = F.row_number().over(Window.partitionBy("facet").orderBy("label", "id"))
        return rows.select("facet", place.alias("pos"), "label", "id")
    lowest = rows.orderBy(F.xxhash64(*columns), *columns).limit(SPLITTERS)
    splitters = F.array_sort(F.collect_list(F.struct("label", "id"))).alias("_splitters")
    part = F.size(F.filter("_splitters", lambda s: s <= F.struct("label", "id")))
    # a row for each list, here and below
    cut = rows.join(F.broadcast(lowest.groupBy("facet").agg(splitters)), "facet", "left")
    parts = cut.select(*columns, F.when(F.col("_splitters").isNull(), 0).otherwise(part).alias("_part"))
    # at most a part for each splitter, and one more for each list
    sizes = parts.groupBy("facet", "_part").agg(F.count("*").alias("_n"))
    sizes = sizes.groupBy("facet").agg(F.collect_list(F.struct("_part", "_n")).alias("_sizes"))
    parts = parts.join(F.broadcast(sizes), "facet")
    ahead = F.filter("_sizes", lambda p: p["_part"] < F.col("_part"))
    before = F.aggregate(ahead, F.lit(0).cast("long"), lambda n, p: n + p["_n"])
    place = F.row_number().over(Window.partitionBy("facet", "_part").orderBy("label", "id"))
    return parts.select("facet", (before + place).cast("int").alias("pos"), "label", "id")


def listed(rows: DataFrame, lists: Sequence[str], source: DataFrame) -> DataFrame:
    """Number the entries of each list and put "All" in front."""
    name = F.explode(F.array(*(F.lit(x) for x in lists)))
    everything = rows.sparkSession.range(1, numPartitions=1).select(
        name.alias("facet"), F.lit(0).alias("pos"), F.lit(ALL).alias("label"), F.lit(ALL).alias("id")
    )
    return everything.unionByName(numbered(rows, source))


def _entry(facet: str, label: Column, value: Column) -> Column:
    return F.struct(F.lit(facet).alias("facet"), label.alias("label"), value.alias("id"))


def _tenant_of_farm() -> Column:
    """The tenant as an entry; farms without a tenant add none."""
    return F.when(F.col("tenant_id") != "", _entry(TENANT, F.col("tenant_name"), F.col("tenant_id")))


def _named_farms(ids: DataFrame, farms: DataFrame, tenant: Any = None) -> DataFrame:
    """With the farm's names, of one tenant if one is given."""
    columns = [c for c in ("farm_name", "tenant_id", "tenant_name") if c in farms.columns]
    farms = farms.select(join_key("farm_id").alias("_farm"), *columns)
    if chosen(tenant) is None:
        return ids.join(farms, F.col("farm_id") == F.col("_farm"), "left")
    wanted = farms.where(F.col("tenant_id") == F.lit(chosen(tenant)))
    return ids.join(wanted, F.col("farm_id") == F.col("_farm"))


def _farm_entry() -> Column:
    return _entry(FARM, F.coalesce("farm_name", "farm_id"), F.col("farm_id"))


def _camera_entry() -> Column:
    return _entry(CAMERA, F.coalesce("camera_name", "camera_id"), F.col("camera_id"))


def _named_cameras(ids: DataFrame, cameras: DataFrame) -> DataFrame:
    names = cameras.select(join_key("camera_id").alias("_camera"), "camera_name")
    return ids.join(names, F.col("camera_id") == F.col("_camera"), "left")


def entries(
    detections: DataFrame,
    farms: DataFrame,
    cameras: DataFrame,
    day: str | dt.date,
    lists: Sequence[str] = (TENANT, FARM, CAMERA),
    tenant: Any = None,
) -> DataFrame:
    """`facet`, `label` and `id` of several lists of a day, from one aggregation of its events.

    The events are grouped by farm and by camera at once.  Tenants are those of the
    farms seen.  A tenant restricts the farms.
    """
    by = [F.col("farm_id")], [F.col("camera_id")]
    seen = events_on_day(detections, day).select("farm_id", "camera_id")
    seen = seen.groupingSets(by, "farm_id", "camera_id").agg(F.grouping("farm_id").alias("_camera_row"))
    farm_rows = _named_farms(seen.where("_camera_row = 0 AND farm_id IS NOT NULL"), farms, tenant)
    camera_rows = _named_cameras(seen.where("_camera_row = 1 AND camera_id IS NOT NULL"), cameras)
    of_farm = [e for name, e in ((FARM, _farm_entry()), (TENANT, _tenant_of_farm())) if name in lists]
    found = farm_rows.select(F.inline(F.array_compact(F.array(*of_farm))))
    if TENANT in lists:
        found = found.distinct()  # several farms of a tenant
    if CAMERA in lists:
        found = found.unionByName(camera_rows.select(F.inline(F.array(_camera_entry()))))
    return found


def all_lists(
    detections: DataFrame,
    farms: DataFrame,
    cameras: DataFrame,
    day: str | dt.date,
    lists: Sequence[str] = (TENANT, FARM, CAMERA),
    tenant: Any = None,
) -> DataFrame:
    """The entries in their places, told apart by `facet`."""
    source = detections.select("farm_id", "camera_id")
    return listed(entries(detections, farms, cameras, day, lists, tenant), lists, source)


def _ids(detections: DataFrame, day: str | dt.date, column: str, limit: int | None = None) -> DataFrame:
    ids = events_on_day(detections, day).select(column).where(F.col(column).isNotNull()).distinct()
    return ids if limit is None else ids.orderBy(column).limit(limit)


def _one(rows: DataFrame, entry: Column, facet: str, detections: DataFrame) -> DataFrame:
    source = detections.select(f"{'camera' if facet == CAMERA else 'farm'}_id")
    return listed(rows.select(F.inline(F.array(entry))), [facet], source).drop("facet")


def tenant_facet(detections: DataFrame, farms: DataFrame, day: str | dt.date) -> DataFrame:
    rows = _named_farms(_ids(detections, day, "farm_id"), farms).where("tenant_id <> ''")
    tenants = rows.select("tenant_id", "tenant_name").distinct()
    return _one(tenants, _tenant_of_farm(), TENANT, detections)


def farm_facet(
    detections: DataFrame,
    farms: DataFrame,
    day: str | dt.date,
    tenant: Any = None,
    limit: int | None = None,
) -> DataFrame:
    """Farms seen, of one tenant if one is given; a limit then keeps the first by id."""
    ids = _ids(detections, day, "farm_id")
    rows = _named_farms(ids, farms, tenant)
    if limit is not None:
        rows = rows.orderBy("farm_id").limit(limit)
    return _one(rows, _farm_entry(), FARM, detections)


def camera_facet(
    detections: DataFrame,
    cameras: DataFrame,
    day: str | dt.date,
    farm: Any = None,
    limit: int | None = None,
) -> DataFrame:
    """Cameras seen, on one farm if one is given; a limit then keeps the first by id."""
    if chosen(farm) is not None:
        detections = detections.where(F.col("farm_id") == F.lit(chosen(farm)))
    ids = _ids(detections, day, "camera_id", limit)
    return _one(_named_cameras(ids, cameras), _camera_entry(), CAMERA, detections)
