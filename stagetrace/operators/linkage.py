"""Linking first-stage detections to second-stage inferences."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagetrace.functions import daytime, keys
from stagetrace.functions.choices import as_day, chosen, time_bound
from stagetrace.functions.sizes import estimated_bytes
from stagetrace.operators.hotkeys import HOT_ROWS, Band, heavy_names, hot_keys, key_profile, left_join
from stagetrace.operators.lookup import join_key

# Rows of a short and of a whole result page.
SHORT_PAGE_ROWS = 50
PAGE_ROWS = 100

# Largest top-k whose keys are broadcast; beyond it the whole join is sorted, in the
# same order.
TOP_ROWS_BROADCAST = 10_000

STAGE1_COLUMNS = (
    "session_id",
    "farm_id",
    "camera_id",
    "stage1_timestamp",
    "stage1_category",
    "stage1_confidence",
    "stage1_should_forward",
    "frame_uris",
    "trigger_frame_uri",
    "frame_count",
    "probability_animal_husbandry",
    "probability_down_cow",
    "probability_quick_movements",
    "probability_no_event",
    "stage1_raw_response",
)
STAGE2_COLUMNS = (
    "stage2_inference_id",
    "stage2_timestamp",
    "stage2_classification",
    "stage2_confidence",
    "stage2_should_forward",
    "video_gcs_path",
    "video_filename",
    "stage2_raw_response",
)

_KEYS = (
    ("camera_id", "camera_id"),
    ("blk_file", "blk_file"),
    ("frame_timestamp_key", "video_timestamp_key"),
)
_DAY1, _DAY2 = "_stage1_day", "_stage2_day"
_SPAN1, _SPAN2 = "_stage1_span", "_stage2_span"

# Days of a span, for each day of the band: an inference is in two spans only if
# its band crosses the edge between them, so that (1 + 2 / 16) of its rows meet
# the detections.
SPAN_DAYS = 16

# Stored bytes of an inference at least, for the choice of a plan.
LEAST_ROW_BYTES = 64


@dataclass(frozen=True)
class Modes:
    """The points on which the two known query generations differ."""

    blank_keys: str = "strict"
    band_days: int = 1
    time_precision: str = "second"
    raw: str = "first_vote"


STANDARD = Modes()
WAREHOUSE = Modes(blank_keys="verbatim", raw="all_votes")
LEGACY = Modes(band_days=2, time_precision="micro")


@dataclass(frozen=True)
class Filters:
    """Optional restrictions on detections; "All", "" and None restrict nothing."""

    start: str | None = None
    end: str | None = None
    tenant: Any = None
    farm: Any = None
    camera: Any = None
    forwarded_only: bool = False


NO_FILTERS = Filters()


def stage1_keyed(
    detections: DataFrame, blank_keys: str = "strict", *also: str
) -> DataFrame:
    """Detections under their result names, with the keys of their first frame."""
    frame = keys.trigger_frame(F.col("frame_uris"))
    return detections.select(
        "session_id",
        "farm_id",
        "camera_id",
        F.col("processing_timestamp").alias("stage1_timestamp"),
        F.col("highest_probability_category").alias("stage1_category"),
        F.col("highest_probability_value").alias("stage1_confidence"),
        F.col("should_forward").alias("stage1_should_forward"),
        "frame_uris",
        frame.alias("trigger_frame_uri"),
        keys.extracted(frame, keys.FRAME_BLOCK, blank_keys).alias("blk_file"),
        keys.extracted(frame, keys.SECOND_STAMP, blank_keys).alias("frame_timestamp_key"),
        "probability_animal_husbandry",
        "probability_down_cow",
        "probability_quick_movements",
        "probability_no_event",
        F.col("gemini_raw_response").alias("stage1_raw_response"),
        *also,
    )


def first_vote_response(inferences: DataFrame) -> DataFrame:
    """Each inference with the response of its first model vote."""
    return inferences.select(
        "inference_id",
        F.get("model_votes", F.lit(0))["raw_response"].alias("stage2_raw_response"),
    )


def stage2_keyed(
    inferences: DataFrame, blank_keys: str = "strict", raw: str = "first_vote"
) -> DataFrame:
    """Inferences under their result names, with the keys of their file name."""
    if raw == "first_vote":
        response = F.get("model_votes", F.lit(0))["raw_response"]
    elif raw == "all_votes":
        response = F.col("model_votes")
    else:
        raise ValueError(f"unknown raw: {raw!r}")
    name = F.col("file_name")
    return inferences.select(
        F.col("inference_id").alias("stage2_inference_id"),
        "camera_id",
        F.col("inference_timestamp").alias("stage2_timestamp"),
        F.col("classification").alias("stage2_classification"),
        F.col("max_probability_score").alias("stage2_confidence"),
        F.col("should_forward").alias("stage2_should_forward"),
        "video_gcs_path",
        name.alias("video_filename"),
        keys.extracted(name, keys.VIDEO_BLOCK, blank_keys).alias("blk_file"),
        keys.extracted(name, keys.SECOND_STAMP, blank_keys).alias("video_timestamp_key"),
        response.alias("stage2_raw_response"),
    )


def events_on_day(detections: DataFrame, day: str | dt.date) -> DataFrame:
    return detections.where(daytime.on_day(F.col("processing_timestamp"), as_day(day)))


def select_detections(
    detections: DataFrame,
    filters: Filters = NO_FILTERS,
    farms: DataFrame | None = None,
    first: dt.date | None = None,
    last: dt.date | None = None,
    time_precision: str = "second",
) -> DataFrame:
    """Detections of a span of days that pass the filters.

    A farm replaces a tenant, even when the farm belongs to another tenant.  A
    tenant stands for the farms the farm dimension lists under it, so a tenant
    without farms selects nothing.
    """
    farm, tenant, camera = (
        chosen(v) for v in (filters.farm, filters.tenant, filters.camera)
    )
    single_day = first if first is not None and first == last else None
    if single_day:
        wanted = [daytime.on_day(F.col("processing_timestamp"), single_day)]
    else:
        wanted = daytime.between_days(F.col("processing_timestamp"), first, last)
    wanted += daytime.in_time_window(
        detections,
        "processing_timestamp",
        time_bound(filters.start, 0),
        time_bound(filters.end, 59),
        time_precision,
        single_day,
    )
    if farm is not None:
        wanted.append(F.col("farm_id") == F.lit(farm))
    if camera is not None:
        wanted.append(F.col("camera_id") == F.lit(camera))
    if filters.forwarded_only:
        wanted.append(F.col("should_forward"))
    rows = detections.where(reduce(and_, wanted)) if wanted else detections
    if farm is None and tenant is not None:
        if farms is None:
            raise ValueError("a tenant filter needs the farm dimension")
        of_tenant = farms.where(F.col("tenant_id") == F.lit(tenant)).select(
            join_key("farm_id").alias("_wanted")
        )
        rows = rows.join(of_tenant, F.col("farm_id") == F.col("_wanted"), "left_semi")
    return rows


def select_inferences(
    inferences: DataFrame,
    band_days: int,
    camera: Any = None,
    first: dt.date | None = None,
    last: dt.date | None = None,
) -> DataFrame:
    """Inferences that detections of a span of days can link to."""
    band = dt.timedelta(days=band_days)
    wanted = daytime.between_days(
        F.col("inference_timestamp"),
        None if first is None else first - band,
        None if last is None else last + band,
    )
    if chosen(camera) is not None:
        wanted.append(F.col("camera_id") == F.lit(chosen(camera)))
    return inferences.where(reduce(and_, wanted)) if wanted else inferences


def _result(linked: DataFrame) -> DataFrame:
    """The 26 result columns in their order."""
    linked = linked.withColumn("frame_count", F.array_size("frame_uris"))
    return linked.select(
        *STAGE1_COLUMNS,
        *STAGE2_COLUMNS,
        "blk_file",
        F.col("frame_timestamp_key").alias("event_timestamp"),
        keys.video_url(F.col("video_gcs_path"), F.col("trigger_frame_uri")).alias(
            "video_url_derived"
        ),
    )


def newest_first() -> list:
    """Total order of linked rows; rows alike in all of it are alike in their link."""
    return [
        F.desc_nulls_last("stage1_timestamp"),
        F.asc_nulls_first("session_id"),
        F.asc_nulls_first("camera_id"),
        F.asc_nulls_first("trigger_frame_uri"),
        F.asc_nulls_first("stage2_inference_id"),
        F.asc_nulls_first("stage2_timestamp"),
        F.asc_nulls_first("video_filename"),
    ]


def _newest(detections: DataFrame, limit: int) -> DataFrame:
    """The newest detections with their rank.

    The time of the last of them is found on the time alone; only rows from that
    time on carry their other columns.  They are ordered on stored columns, so
    keys are parsed only for the rows that remain.
    """
    times = detections.select("processing_timestamp").orderBy(F.desc("processing_timestamp"))
    last = times.limit(limit).agg(F.min("processing_timestamp")).scalar()
    order = [
        F.desc_nulls_last("processing_timestamp"),
        F.asc_nulls_first("session_id"),
        F.asc_nulls_first("camera_id"),
        keys.trigger_frame(F.col("frame_uris")).asc_nulls_first(),
    ]
    rank = F.row_number().over(Window.orderBy(*order))
    newest = detections.where(F.col("processing_timestamp") >= last)
    return newest.orderBy(*order).limit(limit).withColumn("_rank", rank)


def _nearby(day: str, band: int) -> Column:
    """The days within the band of a day, each as a row."""
    return F.explode(F.sequence(F.date_sub(day, band), F.date_add(day, band)))


def _span(day: Column, band: int) -> Column:
    """The number of the span of days in which a day lies."""
    return F.floor(F.unix_date(day) / F.lit(SPAN_DAYS * max(band, 1))).cast("int")


def _probed(
    stage1: DataFrame, row: str, stage2: DataFrame, band: int | None
) -> DataFrame:
    """Second-stage rows of the few first-stage rows, by the column `row` of these.

    The keys of the first stage are broadcast over the second, which is neither
    shuffled nor sorted.  With a band every key comes once for each of its days.
    """
    probe = stage1.select(
        row,
        *(F.col(a).alias(f"_probe{i}") for i, (a, _) in enumerate(_KEYS)),
        F.col("stage1_timestamp").cast("date").alias("_probe_day"),
    )
    on = [F.col(b) == F.col(f"_probe{i}") for i, (_, b) in enumerate(_KEYS)]
    if band is not None:
        probe = probe.withColumn("_probe_day", _nearby("_probe_day", band))
        on.append(F.col(_DAY2) == F.col("_probe_day"))
    return stage2.join(F.broadcast(probe), reduce(and_, on)).select(row, *STAGE2_COLUMNS)


def _top_rows(
    detections: DataFrame, stage2: DataFrame, modes: Modes, band: int | None, limit: int
) -> DataFrame:
    """The first rows of the sorted left join, without joining everything.

    Every detection yields at least one row, so the result only involves the
    `limit` newest of them.  Each task keeps its best `limit` pairs, and the pairs
    return to their rows.
    """
    stage1 = stage1_keyed(_newest(detections, limit), modes.blank_keys, "_rank")
    within = [
        F.col("_rank"),
        F.asc_nulls_first("stage2_inference_id"),
        F.asc_nulls_first("stage2_timestamp"),
        F.asc_nulls_first("video_filename"),
    ]
    pairs = _probed(stage1, "_rank", stage2, band).orderBy(*within).limit(limit)
    return stage1.join(pairs, "_rank", "left").orderBy(*within).limit(limit)


def second_stage(inferences: DataFrame, modes: Modes) -> DataFrame:
    """Keyed inferences with their day; those with both keys blank link to nothing."""
    rows = stage2_keyed(inferences, modes.blank_keys, modes.raw)
    rows = rows.where((F.col("blk_file") != "") | (F.col("video_timestamp_key") != ""))
    return rows.withColumn(_DAY2, F.col("stage2_timestamp").cast("date"))


def inference_profile(inferences: DataFrame, modes: Modes = STANDARD) -> DataFrame:
    """(day, rows, sketch) of the linkage keys; kept by a loader for each day it adds."""
    return key_profile(second_stage(inferences, modes), [b for _, b in _KEYS], _DAY2)


def with_spans(stage2: DataFrame, band: int) -> DataFrame:
    """Keyed inferences once for each span that their band touches."""
    first, last = F.date_sub(_DAY2, band), F.date_add(_DAY2, band)
    return stage2.withColumn(_SPAN2, F.explode(F.sequence(_span(first, band), _span(last, band))))


def hot_link_keys(
    inferences: DataFrame,
    modes: Modes = STANDARD,
    hot_rows: int = HOT_ROWS,
    profile: DataFrame | None = None,
) -> DataFrame:
    """Keys with very many inferences, how many, and over how many tasks a link deals them."""
    keys = [b for _, b in _KEYS]
    rows = second_stage(inferences, modes).where(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    names = None if profile is None else heavy_names(profile, hot_rows)
    found = hot_keys(rows, keys, hot_rows, names)
    return found.select(*keys, F.col("_n").alias("inferences"), F.col("_slots").alias("slots"))


def link_keyed(
    stage1: DataFrame,
    stage2: DataFrame,
    band: int | None,
    hot_rows: int | None = HOT_ROWS,
    names: list[str] | None = None,
    stored: bool = False,
) -> DataFrame:
    """The 26 columns of keyed detections with their keyed inferences.

    Without a band the days of the two are not compared.  `stored` sides lie by the
    keys alone, so that nothing else may be a key.
    """
    on = list(_KEYS)
    days = None
    if band is None:
        stage2 = stage2.drop(_DAY2)
    else:
        stage1 = stage1.withColumn(_DAY1, F.col("stage1_timestamp").cast("date"))
        days = Band(_DAY1, _DAY2, band)
    if band is not None and not stored:
        stage1 = stage1.withColumn(_SPAN1, _span(F.col(_DAY1), band))
        # a detection is in one span, so that no pair is doubled
        stage2 = with_spans(stage2, band)
        on.append((_SPAN1, _SPAN2))
    return _result(
        left_join(
            stage1,
            stage2,
            on,
            left_row=() if stored else ("session_id", "stage1_timestamp", "camera_id", "trigger_frame_uri"),
            right_row=("stage2_inference_id", "stage2_timestamp", "video_filename"),
            hot_rows=hot_rows,
            keyless=(F.col("blk_file") == "") & (F.col("frame_timestamp_key") == ""),
            band=days,
            names=names,
            named=len(_KEYS),
        )
    )


def _link(
    detections: DataFrame,
    inferences: DataFrame,
    modes: Modes,
    banded: bool,
    limit: int | None,
    hot_rows: int | None,
    names: Callable[[], list[str] | None],
) -> DataFrame:
    stage2 = second_stage(inferences, modes)
    band = modes.band_days if banded else None
    if limit is not None and limit <= TOP_ROWS_BROADCAST:
        return _result(_top_rows(detections, stage2, modes, band, limit))
    stage1 = stage1_keyed(detections, modes.blank_keys)
    linked = link_keyed(stage1, stage2, band, hot_rows, names())
    return linked if limit is None else linked.orderBy(*newest_first()).limit(limit)


def link_session(
    detections: DataFrame,
    inferences: DataFrame,
    session_id: str,
    day: str | dt.date | None = None,
    modes: Modes = STANDARD,
    hot_rows: int | None = HOT_ROWS,
    profile: DataFrame | None = None,
) -> DataFrame:
    """The linked rows of one session, found by its keys.

    A known day bounds both scans.  A session may be of any size: it is linked as
    a range is.  Spark filters the inferences by the keys of its few detections
    before they are shuffled.
    """
    the_day = None if day is None else as_day(day)
    kept = select_detections(detections, first=the_day, last=the_day)
    kept = kept.where(
        (F.col("session_id") == F.lit(session_id)) & F.col("processing_timestamp").isNotNull()
    )
    near = select_inferences(inferences, modes.band_days, None, the_day, the_day)
    names = partial(_hot_names, near, profile, hot_rows, modes.band_days, the_day, the_day)
    return _link(kept, near, modes, banded=True, limit=None, hot_rows=hot_rows, names=names)


def _hot_names(
    inferences: DataFrame,
    profile: DataFrame | None,
    hot_rows: int | None,
    band_days: int,
    first: dt.date | None,
    last: dt.date | None,
) -> list[str] | None:
    """What a profile says of the inferences near these days.

    Without one, None: the join looks for hot keys itself, unless by Spark's estimate
    the inferences are too small to hold one.
    """
    if hot_rows is None:
        return None
    if profile is None:
        return [] if estimated_bytes(inferences) < hot_rows * LEAST_ROW_BYTES else None
    band = dt.timedelta(days=band_days)
    return heavy_names(
        profile, hot_rows, None if first is None else first - band, None if last is None else last + band
    )


def link_stages(
    detections: DataFrame,
    inferences: DataFrame,
    day: str | dt.date,
    filters: Filters = NO_FILTERS,
    farms: DataFrame | None = None,
    limit: int | None = None,
    modes: Modes = STANDARD,
    hot_rows: int | None = HOT_ROWS,
    profile: DataFrame | None = None,
) -> DataFrame:
    """Detections of one day with the inferences they led to.

    A detection without an inference keeps nulls; one with several gives several
    rows.  A limit gives the newest rows, newest first; without one the whole day
    comes in no particular order.  A profile of the inferences' keys, kept for
    each day, saves looking for hot ones; it is the only thing read now.
    """
    the_day = as_day(day)
    kept = select_detections(
        detections, filters, farms, the_day, the_day, modes.time_precision
    )
    near = select_inferences(inferences, modes.band_days, filters.camera, the_day, the_day)
    names = partial(_hot_names, near, profile, hot_rows, modes.band_days, the_day, the_day)
    return _link(kept, near, modes, banded=False, limit=limit, hot_rows=hot_rows, names=names)


def link_range(
    detections: DataFrame,
    inferences: DataFrame,
    first: str | dt.date | None = None,
    last: str | dt.date | None = None,
    filters: Filters = NO_FILTERS,
    farms: DataFrame | None = None,
    limit: int | None = None,
    modes: Modes = STANDARD,
    hot_rows: int | None = HOT_ROWS,
    profile: DataFrame | None = None,
) -> DataFrame:
    """The union of the daily links over a span of days, in one job.

    Open ends take the whole table.  A span of days is part of the join key: an
    inference stands for each span whose detections it can belong to, mostly one,
    and the exact band is checked on the pairs that meet.
    """
    start = None if first is None else as_day(first)
    end = None if last is None else as_day(last)
    kept = select_detections(detections, filters, farms, start, end, modes.time_precision)
    kept = kept.where(F.col("processing_timestamp").isNotNull())
    near = select_inferences(inferences, modes.band_days, filters.camera, start, end)
    names = partial(_hot_names, near, profile, hot_rows, modes.band_days, start, end)
    return _link(kept, near, modes, banded=True, limit=limit, hot_rows=hot_rows, names=names)
