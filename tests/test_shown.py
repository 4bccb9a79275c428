from __future__ import annotations

from pyspark.sql import types as T

import pytest
from tables import at, cameras, detections, farms, frame_uri, inferences, video_name

from stagetrace.operators import details, display, media
from stagetrace.operators.linkage import Filters, link_stages
from stagetrace.plans import dashboard

DAY = "2024-01-10"
STAMP = "2024-01-10T08:00:00"


@pytest.fixture(scope="module")
def ws(spark):
    base = {"processing_timestamp": at(f"{DAY} 08:00:00.5"), "frame_uris": [frame_uri(1, STAMP)]}
    events = detections(
        spark,
        [
            base | {"session_id": "a", "farm_id": "f1", "camera_id": "c1", "should_forward": True,
                    "highest_probability_category": "down_cow", "highest_probability_value": 0.0625,
                    "gemini_raw_response": '{"k":\\n 1}'},
            base | {"session_id": "b", "farm_id": None, "camera_id": None, "frame_uris": None,
                    "highest_probability_value": float("nan"), "gemini_raw_response": 'no \\"json\\"'},
        ],
    )
    videos = inferences(
        spark,
        [{"inference_id": "i1", "camera_id": "c1", "inference_timestamp": at(f"{DAY} 09:00:00"),
          "classification": "down_cow", "max_probability_score": 0.5, "should_forward": False,
          "video_gcs_path": "gs://v/1.mp4", "file_name": video_name(1, STAMP),
          "model_votes": [("",)]}],
    )
    tenants = spark.createDataFrame(
        [("t1", "T1", None, None)],
        "tenant_id string, tenant_name string, tenant_ui_url string, tenant_slug string",
    )
    farm_map = spark.createDataFrame(
        [("f1", "F1", "t1")], "farm_id string, farm_name string, tenant_id string"
    )
    return dashboard.Workspace(events, videos, tenants, farm_map, cameras(spark, [("c1", "C1")]))


def test_display_table(ws):
    shown = dashboard.linked_display(ws, DAY)
    assert shown.columns == [
        "Farm", "Camera", "Stage 1 Time", "Event Timestamp", "S1 Category", "S1 Conf",
        "S1 Forward", "S2 Class", "S2 Conf", "S2 Forward",
    ]
    assert sorted(tuple(r) for r in shown.collect()) == [
        ("F1", "C1", f"{DAY} 08:00:00", STAMP, "down_cow", "0.062", "✓", "down_cow", "0.500", "✗"),
        ("N/A", "N/A", f"{DAY} 08:00:00", None, None, "N/A", "N/A", None, "N/A", "N/A"),
    ]


def test_display_keeps_only_present_columns(ws):
    some = dashboard.linked(ws, DAY).select("stage2_confidence", "camera_id", "frame_count")
    assert display.display_table(some, ws.farms, ws.cameras).columns == ["Camera", "S2 Conf"]


def test_details_of_a_linked_event(ws):
    rows = dashboard.row_details(ws, "a", "i1").collect()
    assert [r.details for r in rows] == [
        """Session ID: a

═══ Location ═══
  Farm: F1
  Farm ID: f1
  Camera: C1
  Camera ID: c1

═══ Stage 1 Results ═══
  Category: down_cow
  Confidence: 0.062
  Should Forward: Yes ✓
  Frame Count: 1
  Timestamp: 2024-01-10 08:00:00.500000

═══ Stage 2 Results ═══
  Classification: down_cow
  Confidence: 0.500
  Should Forward: No ✗

═══ Stage 1 Raw Response ═══
{"k":
 1}

═══ Stage 2 Raw Response ═══
  (No raw response available)"""
    ]


def test_details_of_an_event_without_second_stage(ws):
    text = dashboard.row_details(ws, "b", day=DAY).first().details
    assert "  Farm: N/A\n  Farm ID: N/A\n  Camera: N/A\n  Camera ID: N/A\n" in text
    assert "  Confidence: N/A\n  Should Forward: N/A\n  Frame Count: N/A\n" in text
    assert "  (No Stage 2 processing - event not forwarded)\n" in text
    assert 'Response ═══\nno "json"\n' in text
    assert details.event_details(dashboard.linked(ws, DAY), ws.farms, ws.cameras).count() == 2


def test_status_lines(ws):
    def status(**filters):
        return dashboard.query_status(ws, DAY, Filters(**filters)).first().status

    assert status() == "Found 2 results | Date: 2024-01-10"
    assert status(farm="f1", camera={"label": "C1", "id": "c1"}, start="07:00") == (
        "Found 1 results | Date: 2024-01-10 | From: 07:00 | Farm: F1 | Camera: C1"
    )
    assert status(tenant="t1", end="07:00") == (
        "No results found. Filters: Date: 2024-01-10 | To: 07:00 | Tenant: T1"
    )
    assert status(tenant="t9") == "No results found. Filters: Date: 2024-01-10 | Tenant: t9"
    counts = dashboard.facet_counts(ws, DAY).first()
    assert counts.status == "Loaded 1 tenants, 1 farms, 1 cameras for 2024-01-10"


def test_filter_lists_follow_each_other(ws):
    def listed(df):
        return sorted((r.facet, r.pos, r.label, r.id) for r in df.collect())

    camera_list = [("camera", 0, "All", "All"), ("camera", 1, "C1", "c1")]
    farm_list = [("farm", 0, "All", "All"), ("farm", 1, "F1", "f1")]
    tenant_list = [("tenant", 0, "All", "All"), ("tenant", 1, "T1", "t1")]
    assert listed(dashboard.load_filters(ws, DAY)) == camera_list + farm_list + tenant_list
    assert listed(dashboard.after_tenant_choice(ws, DAY, "t9")) == camera_list + farm_list[:1]
    assert listed(dashboard.after_farm_choice(ws, DAY, "f1")) == camera_list
    assert listed(dashboard.after_farm_choice(ws, DAY, "f9")) == camera_list[:1]


def test_frames_in_order_without_invalid_ones(spark):
    events = detections(
        spark,
        [{"session_id": "a", "frame_uris": ["gs://b/2.jpg", "", None, "gs://b", "gs://b/1.jpg"]},
         {"session_id": "b", "frame_uris": []}, {"session_id": "c", "frame_uris": None}],
    )
    frames = media.frame_manifest(events).collect()
    assert [tuple(r) for r in sorted(frames, key=lambda r: r.frame_no)] == [
        ("a", 0, "gs://b/2.jpg", "b", "2.jpg", 333),
        ("a", 1, "gs://b/1.jpg", "b", "1.jpg", 333),
    ]
    assert media.frame_manifest(events, fps=4).first().duration_ms == 250


def test_media_presence(spark):
    def uris(*values):
        return spark.createDataFrame([(v,) for v in values], "uri string")

    asked = uris("gs://b/1", "gs://b/1", "gs://b/2", "s3://b/1", None)
    listing = uris("gs://b/1", "gs://b/1", "s3://b/1", "gs://b/9")
    assert [r.uri for r in media.media_present(asked, listing).collect()] == ["gs://b/1"]
    missing = sorted(r.uri for r in media.media_missing(asked, listing).collect())
    assert missing == ["gs://b/2", "s3://b/1"]


def test_only_recorded_videos_play(spark, ws):
    linked = link_stages(ws.detections, ws.inferences, DAY)
    assert [tuple(r) for r in media.playable_videos(linked).collect()] == [
        ("a", "i1", "gs://v/1.mp4")
    ]


def test_details_of_all_votes(spark, ws):
    from stagetrace.operators.linkage import Modes

    whole = link_stages(ws.detections, ws.inferences, DAY, modes=Modes(raw="all_votes"))
    votes = whole.schema["stage2_raw_response"].dataType
    for given, shown in (
        (None, "  (No raw response available)"), ([], "  (No raw response available)"),
        ([("x",), ("y",)], '[{"raw_response":"x"},{"raw_response":"y"}]'),
    ):
        one = spark.createDataFrame([(given,)], T.StructType().add("v", votes)).select("v")
        rows = whole.drop("stage2_raw_response").crossJoin(one.withColumnRenamed("v", "stage2_raw_response"))
        text = details.event_details(rows, ws.farms, ws.cameras).where("session_id = 'a'").first().details
        assert text.endswith("═══ Stage 2 Raw Response ═══\n" + shown)


def test_texts_are_whole_unless_a_length_is_given(spark):
    df = spark.createDataFrame([("x" * 5000,)], "raw string")
    assert len(details.normalize_response(df, "raw", "s", "b").first().b) == 5000
    assert len(details.normalize_response(df, "raw", "s", "b", 7).first().b) == 7
