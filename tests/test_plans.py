"""Plans: what reaches the scan, and what must not appear at all."""

from __future__ import annotations

import datetime as dt
import re
import uuid

import pytest
from pyspark.sql import functions as F
from tables import cameras, detections, farms, inferences, video_name

from stagetrace import schemas
from stagetrace.operators import colocated, details, dims, display, facets, linkage, lookup, media
from stagetrace.operators.linkage import Filters
from stagetrace.plans import dashboard
from stagetrace.plans.dashboard import Workspace
from stagetrace.sources.tables import Table, scan_detections, scan_inferences

DAY = "2024-01-10"


@pytest.fixture(scope="module", params=["timestamp", "timestamp_ntz"])
def stored(spark, tmp_path_factory, request):
    """Both fact tables as files, with either kind of timestamp."""
    root = tmp_path_factory.mktemp(request.param)
    for name, df, column in (
        ("d", detections(spark, [{}]), "processing_timestamp"),
        ("i", inferences(spark, [{}]), "inference_timestamp"),
    ):
        df.withColumn(column, F.col(column).cast(request.param)).write.parquet(f"{root}/{name}")
    return (
        scan_detections(spark, Table(path=f"{root}/d")),
        scan_inferences(spark, Table(path=f"{root}/i")),
    )


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def scans(text):
    """(columns read, filters pushed) of every file scan."""
    found = []
    for block in re.split(r"\n\n", text):
        if re.search(r"^\(\d+\) Scan parquet", block.strip()):
            pushed = re.search(r"PushedFilters: \[(.*)\]", block)
            schema = re.search(r"ReadSchema: struct<(.*)>", block).group(1)
            found.append((schema, pushed.group(1) if pushed else ""))
    return found


def check_clean(text):
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert bad not in text


def of_detections(text):
    return [s for s in scans(text) if "processing_timestamp" in s[0]]


def of_inferences(text):
    return [s for s in scans(text) if "file_name" in s[0]]


@pytest.mark.parametrize("limit", [None, 100])
def test_day_and_camera_reach_both_scans(stored, limit):
    text = plan(linkage.link_stages(*stored, DAY, Filters(camera="c1"), limit=limit))
    check_clean(text)
    assert of_detections(text) and of_inferences(text)
    for _, pushed in of_detections(text):
        assert "GreaterThanOrEqual(processing_timestamp,2024-01-10" in pushed
        assert "LessThan(processing_timestamp,2024-01-11" in pushed
        assert "EqualTo(camera_id,c1)" in pushed
    for _, pushed in of_inferences(text):
        assert "GreaterThanOrEqual(inference_timestamp,2024-01-09" in pushed
        assert "LessThan(inference_timestamp,2024-01-12" in pushed
        assert "EqualTo(camera_id,c1)" in pushed


def test_time_window_reaches_the_scan(stored):
    text = plan(linkage.link_stages(*stored, DAY, Filters(start="08:00", end="17:00")))
    for _, pushed in of_detections(text):
        assert re.search(r"GreaterThanOrEqual\(processing_timestamp,2024-01-10[ T]08:00", pushed)
        assert re.search(r"LessThan\(processing_timestamp,2024-01-10[ T]17:01", pushed)


def test_top_rows_shuffle_nothing_large(stored):
    text = plan(linkage.link_stages(*stored, DAY, limit=50))
    assert "TakeOrderedAndProject" in text
    assert "SortMergeJoin" not in text and "hashpartitioning" not in text


def test_range_bounds_both_scans(stored):
    text = plan(linkage.link_range(*stored, "2024-01-08", DAY))
    check_clean(text)
    for _, pushed in of_detections(text):
        assert "GreaterThanOrEqual(processing_timestamp,2024-01-08" in pushed
    for _, pushed in of_inferences(text):
        assert "GreaterThanOrEqual(inference_timestamp,2024-01-07" in pushed
        assert "LessThan(inference_timestamp,2024-01-12" in pushed


def test_tenant_filter_is_a_semi_join(spark, stored):
    dim = farms(spark, [("f", "F", "t", "T")])
    text = plan(linkage.link_stages(*stored, DAY, Filters(tenant="t"), dim))
    check_clean(text)
    assert "LeftSemi" in text


def test_filter_lists_read_two_columns(spark, stored):
    text = plan(facets.camera_facet(stored[0], cameras(spark, [("c", "C")]), DAY))
    check_clean(text)
    for schema, pushed in of_detections(text):
        assert re.fullmatch(r"camera_id:string,processing_timestamp:timestamp(_ntz)?", schema)
        assert "IsNotNull(camera_id)" in pushed


def windows(text):
    """The partition columns of every window."""
    return re.findall(r"^\(\d+\) Window\n.*?\nArguments: \[.*?\], \[(.*?)\], \[", text, re.M | re.S)


def test_no_list_is_numbered_in_one_task(spark, stored, monkeypatch):
    monkeypatch.setattr(facets, "WHOLE_LIST_BYTES", 0)
    maps = ([("t", "T", None, None)], schemas.TENANTS), ([("f", "F", "t")], schemas.FARMS), ([("c", "C")], schemas.CAMERAS)
    ws = Workspace(*stored, *(spark.createDataFrame(*m) for m in maps))
    for df in (dashboard.load_filters(ws, DAY), dashboard.after_farm_choice(ws, DAY, "f"), facets.tenant_facet(ws.detections, ws.farms, DAY)):
        found = windows(plan(df))
        assert found and all("facet" in w and "_part" in w for w in found)


@pytest.mark.parametrize("whole", [0, 1 << 40])
def test_positions_of_a_long_list(spark, monkeypatch, whole):
    """Labels that repeat, and many entries; every position once, in order."""
    monkeypatch.setattr(facets, "WHOLE_LIST_BYTES", whole)
    entries = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "camera").otherwise("farm").alias("facet"),
        F.concat(F.lit("n"), F.col("id") % 500).alias("label"),
        F.col("id").cast("string").alias("id"),
    )
    rows = facets.listed(entries, ["farm", "camera", "tenant"], entries).collect()
    for facet, n in (("farm", 20_000), ("camera", 10_000), ("tenant", 0)):
        own = sorted((r.pos, r.label, r.id) for r in rows if r.facet == facet)
        assert [p for p, *_ in own] == list(range(n + 1)) and own[0] == (0, "All", "All")
        assert own[1:] == sorted(own[1:], key=lambda r: r[1:])


def test_frames_need_no_shuffle(stored):
    text = plan(media.frame_manifest(stored[0]))
    check_clean(text)
    assert "Exchange" not in text
    assert scans(text)[0][0] == "session_id:string,frame_uris:array<string>"


def test_shown_rows_stay_in_the_engine(spark, stored):
    both = farms(spark, [("f", "F", "t", "T")]), cameras(spark, [("c", "C")])
    linked = linkage.link_range(*stored)
    for df in (display.display_table(linked, *both), details.event_details(linked, *both)):
        check_clean(plan(df))
    narrow = plan(display.display_table(linked, *both))
    assert not any("gemini_raw_response" in s or "model_votes" in s for s, _ in scans(narrow))


@pytest.fixture
def large(spark):
    """Settings under which small frames are joined the way large ones are."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1MB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1MB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def jobs_of(spark, build):
    """What build() gives, and the number of Spark jobs that it started."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    try:
        return build(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_building_a_link_runs_nothing(spark, stored, tmp_path):
    for build in (
        lambda: linkage.link_range(*stored),
        lambda: linkage.link_stages(*stored, DAY),
        lambda: linkage.link_range(*stored, limit=50_000),
        lambda: linkage.link_session(*stored, "s"),
    ):
        assert jobs_of(spark, build)[1] == 0
    linkage.inference_profile(stored[1]).write.parquet(f"{tmp_path}/profile")
    profile = spark.read.parquet(f"{tmp_path}/profile")
    linked, jobs = jobs_of(spark, lambda: linkage.link_range(*stored, profile=profile))
    # only the profile is read; it names no hot key, so that none is looked for
    assert jobs > 0 and len(of_inferences(plan(linked))) == 1
    assert "file_name" not in plan(profile)


def test_a_range_has_spans_of_days_in_the_key(stored):
    text = plan(linkage.link_range(*stored, "2024-01-08", DAY, hot_rows=None))
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", text) + re.findall(r"Left keys \[\d+\]: \[(.*)\]", text)
    assert any("span" in k for k in keys) and not any("_day" in k for k in keys)
    assert re.search(r"Join condition: .*date_?diff", text)
    assert len(of_inferences(text)) == 1


def test_few_inferences_are_copied_for_a_band(spark, tmp_path):
    """An inference a day over a year: under a fifth of them meet two spans."""
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(365)]
    rows = [{"inference_id": str(i), "inference_timestamp": d, "camera_id": "c", "file_name": video_name(i, "2024-01-10T08:00:00")} for i, d in enumerate(days)]
    inferences(spark, rows).write.parquet(f"{tmp_path}/i")
    for band in (1, 2, 5):
        linked = linkage.link_range(
            detections(spark, []), spark.read.parquet(f"{tmp_path}/i"), modes=linkage.Modes(band_days=band), hot_rows=None
        )
        spans = linkage.with_spans(linkage.second_stage(spark.read.parquet(f"{tmp_path}/i"), linkage.STANDARD), band)
        assert 365 < spans.count() < 1.2 * 365
        assert linked.count() == 0


def test_keys_of_the_kept_detections_filter_the_inferences(spark, stored, large):
    """Spark's own runtime filter, for detections of one farm."""
    threshold = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "1")
    try:
        for linked in (
            linkage.link_range(*stored, "2024-01-08", DAY, Filters(farm="f"), hot_rows=None),
            linkage.link_session(*stored, "s", hot_rows=None),
        ):
            assert "might_contain" in plan(linked)
        assert "might_contain" not in plan(linkage.link_range(*stored, hot_rows=None))
    finally:
        spark.conf.set(threshold, before)


def test_a_session_of_any_size(spark, stored, large):
    text = plan(linkage.link_session(*stored, "s", DAY, hot_rows=None))
    assert "EqualTo(session_id,s)" in of_detections(text)[0][1]
    assert "Window" not in text and "Broadcast" not in text
    # a third of the detections are one session, and a third of its rows have one key
    n = 6000
    stem = F.concat(F.lit("gs://b/007_"), F.lpad(F.when(F.col("id") % 9 == 0, 0).otherwise(F.col("id")).cast("string"), 7, "0"))
    moment = F.lit("2024-01-10 08:00:00").cast("timestamp_ntz")
    d = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "s").otherwise(F.concat(F.lit("s"), "id")).alias("session_id"),
        F.lit("c").alias("camera_id"),
        moment.alias("processing_timestamp"),
        F.array(F.concat(stem, F.lit("_cam_2024-01-10T08:00:00_f0.jpg"))).alias("frame_uris"),
    )
    i = spark.range(n).select(
        F.concat(F.lit("i"), "id").alias("inference_id"),
        F.lit("c").alias("camera_id"),
        moment.alias("inference_timestamp"),
        F.concat(F.substring(stem, 8, 99), F.lit("_cam_2024-01-10T08:00:00.mp4")).alias("file_name"),
    )
    d = detections(spark, []).unionByName(d, allowMissingColumns=True)
    i = inferences(spark, []).unionByName(i, allowMissingColumns=True)
    hot = -(-n // 9)
    for hot_rows in (None, 100):
        linked = linkage.link_session(d, i, "s", hot_rows=hot_rows)
        counts = linked.agg(F.count("*"), F.count("stage2_inference_id"), F.countDistinct("stage2_inference_id")).first()
        assert tuple(counts) == (hot * hot + n // 3 - hot, hot * hot + n // 3 - hot, n // 3)


def test_stored_stages_link_without_an_exchange(spark, stored, large, tmp_path):
    names = f"side1_{tmp_path.name}", f"side2_{tmp_path.name}"
    colocated.write_keyed(*stored, *names, buckets=4, path=str(tmp_path))
    text = plan(colocated.link_stored(spark, *names))
    assert "SortMergeJoin" in text or "ShuffledHashJoin" in text
    assert "Exchange" not in text
    for name in names:
        spark.sql(f"DROP TABLE {name}")


def test_a_response_is_parsed_once(spark, stored):
    both = farms(spark, [("f", "F", "t", "T")]), cameras(spark, [("c", "C")])
    raw = stored[0].select(F.col("gemini_raw_response").alias("raw"))
    shown = details.event_details(linkage.link_range(*stored, hot_rows=None), *both)
    for df, texts in ((details.normalize_response(raw, "raw", "status", "body"), 1), (shown, 2)):
        optimised = df._jdf.queryExecution().optimizedPlan().toString()
        assert optimised.count("from_json(") == texts


def test_one_scan_behind_all_lists(spark, stored):
    maps = ([("t", "T", None, None)], schemas.TENANTS), ([("f", "F", "t")], schemas.FARMS), ([("c", "C")], schemas.CAMERAS)
    ws = Workspace(*stored, *(spark.createDataFrame(*m) for m in maps))
    for df in (dashboard.load_filters(ws, DAY), dashboard.after_tenant_choice(ws, DAY, "t")):
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert len(re.findall(r"FileScan parquet[^\n]*processing_timestamp", final)) <= 1


@pytest.mark.parametrize("look_up", ["with_display_name", "camera_info"])
def test_a_hot_id_is_split_in_lookups(spark, large, look_up):
    third = F.when(F.col("id") % 3 == 0, "7").otherwise((F.col("id") % 5000).cast("string"))
    filler = F.sha2(F.col("id").cast("string"), 256).alias("filler")
    facts = spark.range(600_000).select(third.alias("camera_id"), filler)
    ids = spark.range(5000).select(F.col("id").cast("string").alias("camera_id"))
    dim = dims.camera_dim(ids.withColumn("camera_name", F.col("camera_id")))
    if look_up == "camera_info":
        named = lookup.camera_info(facts, dim)
    else:
        named = lookup.with_display_name(facts, dim, "camera_id", "camera_name", "name")
    assert named.toArrow().num_rows == 600_000
    assert "skew=true" in plan(named)


def test_a_hot_video_key_is_split_in_the_link(spark, large, tmp_path):
    """A third of the inferences share one key, a third of the events have none."""
    n = 150_000
    stem = F.concat(F.lit("007_"), F.lpad(F.col("k").cast("string"), 7, "0"))
    stem = F.concat(stem, F.lit("_cam_2024-01-10T08:00:00"))
    moment = F.lit("2024-01-10 08:00:00").cast("timestamp_ntz")
    rows = spark.range(n).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")))
    i = rows.select(
        F.concat(F.lit("i"), "id").alias("inference_id"),
        F.lit("c").alias("camera_id"),
        moment.alias("inference_timestamp"),
        F.concat(stem, F.lit(".mp4")).alias("file_name"),
    )
    uri = F.concat(F.lit("gs://b/"), stem, F.lit("_f0.jpg"))
    rows = spark.range(n).withColumn("k", F.col("id"))
    d = rows.select(
        F.concat(F.lit("s"), "id").alias("session_id"),
        F.lit("c").alias("camera_id"),
        moment.alias("processing_timestamp"),
        F.when(F.col("id") % 3 != 2, F.array(uri)).alias("frame_uris"),
    )
    d = detections(spark, []).unionByName(d, allowMissingColumns=True)
    i = inferences(spark, []).unionByName(i, allowMissingColumns=True)
    d.write.parquet(f"{tmp_path}/d")
    i.write.parquet(f"{tmp_path}/i")
    d, i = spark.read.parquet(f"{tmp_path}/d"), spark.read.parquet(f"{tmp_path}/i")
    linked = linkage.link_range(d, i, hot_rows=5000).select("session_id", "stage2_inference_id")
    slots = linked.where("session_id = 's0'").distinct().count()
    counts = linked.agg(
        F.count("*").alias("rows"), F.count("stage2_inference_id").alias("linked")
    ).first()
    # event 0 meets the hot third; of the other events, those divisible by three
    # find no inference, one in three finds one, and the rest have no key
    assert slots == n // 3
    assert (counts.rows, counts.linked) == (n // 3 + n - 1, n // 3 + n // 3)
