from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F
from tables import at, detections, farms, frame_uri, inferences, video_name

from stagetrace.operators import colocated, hotkeys, linkage
from stagetrace.operators.linkage import LEGACY, Filters, Modes, link_range, link_stages

DAY = "2024-01-10"
STAMP = "2024-01-10T08:00:00"


def one_event(spark, moment=f"{DAY} 08:00:00", uris=(frame_uri(1, STAMP),), **more):
    row = {"session_id": "s", "camera_id": "c", "processing_timestamp": at(moment)}
    row["frame_uris"] = list(uris) if uris is not None else None
    return detections(spark, [row | more])


def one_video(spark, moment=f"{DAY} 09:00:00", name=video_name(1, STAMP), **more):
    row = {"inference_id": "i", "camera_id": "c", "inference_timestamp": at(moment)}
    return inferences(spark, [row | {"file_name": name} | more])


def ids(df):
    return sorted(
        ((r.session_id, r.stage2_inference_id) for r in df.collect()),
        key=lambda pair: (pair[0] or "", pair[1] or ""),
    )


def test_result_has_26_columns_in_order(spark):
    linked = link_stages(one_event(spark), one_video(spark), DAY)
    assert len(linked.columns) == 26
    assert linked.columns[:4] == ["session_id", "farm_id", "camera_id", "stage1_timestamp"]
    assert linked.columns[-3:] == ["blk_file", "event_timestamp", "video_url_derived"]


@pytest.mark.parametrize("limit", [None, 50])
def test_rows_without_both_keys_never_link(spark, limit):
    event, video = one_event(spark, uris=["gs://b/bad.jpg"]), one_video(spark, name="bad.mp4")
    verbatim = Modes(blank_keys="verbatim")
    for modes in (Modes(), verbatim):
        assert ids(link_stages(event, video, DAY, limit=limit, modes=modes)) == [("s", None)]
    assert link_stages(event, video, DAY, modes=verbatim).first().blk_file == ""
    # one blank key is enough to link by the other, verbatim only
    half = "_2024-01-10T08:00:00_x"
    event, video = one_event(spark, uris=[f"gs://b/{half}.jpg"]), one_video(spark, name=f"{half}.mp4")
    assert ids(link_stages(event, video, DAY, limit=limit)) == [("s", None)]
    assert ids(link_stages(event, video, DAY, limit=limit, modes=verbatim)) == [("s", "i")]


@pytest.mark.parametrize("uris,frames", [(None, None), ([], 0)])
@pytest.mark.parametrize("blank_keys", ["strict", "verbatim"])
def test_events_without_frames_are_kept(spark, uris, frames, blank_keys):
    event = one_event(spark, uris=uris)
    rows = link_stages(
        event, one_video(spark, name="bad.mp4"), DAY, modes=Modes(blank_keys=blank_keys)
    ).collect()
    assert [(r.frame_count, r.trigger_frame_uri, r.stage2_inference_id) for r in rows] == [
        (frames, None, None)
    ]


@pytest.mark.parametrize(
    "days,band,found", [(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False), (-1, 1, True)]
)
@pytest.mark.parametrize("limit", [None, 50])
def test_day_band(spark, days, band, found, limit):
    moment = str(at(f"{DAY} 23:00:00") + dt.timedelta(days=days))
    modes = Modes(band_days=band)
    expected = [("s", "i" if found else None)]
    event, video = one_event(spark), one_video(spark, moment)
    assert ids(link_stages(event, video, DAY, limit=limit, modes=modes)) == expected
    assert ids(link_range(event, video, limit=limit, modes=modes)) == expected
    assert ids(link_range(event, video, limit=limit, modes=modes, hot_rows=1)) == expected


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("zone", ["UTC", "America/Chicago"])
@pytest.mark.parametrize("span", ["day", "range"])
def test_time_bounds(spark, kind, zone, span):
    rows = {
        "a": "08:00:00", "b": "07:59:59.999999", "c": "08:30:59.9", "d": "08:31:00", "e": "08:30:59",
    }
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        events = detections(
            spark,
            [{"session_id": k, "processing_timestamp": at(f"{DAY} {v}")} for k, v in rows.items()],
        )
        column = events["processing_timestamp"].cast(kind)
        events = events.withColumn("processing_timestamp", column)

        def kept(start, end, precision):
            days = (dt.date(2024, 1, 10),) * 2 if span == "day" else (None, None)
            chosen = linkage.select_detections(
                events, Filters(start=start, end=end), None, *days, precision
            )
            return "".join(sorted(r.session_id for r in chosen.collect()))

        assert kept("08:00", "08:30", "second") == "ace"
        assert kept(" 08:00 ", "08:30:59", "micro") == "ae"
        assert kept("08:30:59", None, "second") == "cde"
        assert kept(None, "08:00:00", "second") == "ab"
        assert kept(None, "24:00", "second") == "abcde"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("bound", ["8:00", "08:60", "noon", "25:00", "08:00:00.5", "08"])
def test_bad_times_are_refused(spark, bound):
    with pytest.raises(ValueError):
        link_stages(one_event(spark), one_video(spark), DAY, Filters(start=bound))


@pytest.mark.parametrize("day", ["2024-13-01", "10.01.2024", "", "2024-01-10' OR '1'='1"])
def test_bad_days_are_refused(spark, day):
    with pytest.raises(ValueError):
        link_stages(one_event(spark), one_video(spark), day)


def test_unknown_modes_are_refused(spark):
    for modes in (Modes(blank_keys="x"), Modes(raw="x"), Modes(time_precision="x")):
        with pytest.raises(ValueError):
            link_stages(one_event(spark), one_video(spark), DAY, modes=modes)


def test_filters(spark):
    def event(name, farm, camera, forward):
        return {
            "session_id": name, "farm_id": farm, "camera_id": camera, "should_forward": forward,
            "processing_timestamp": at(f"{DAY} 08:00:00"),
        }

    events = detections(
        spark,
        [event("a", "f1", "c1", True), event("b", "f2", "c1", False), event("c", "f3", "c2", None),
         event("d", None, None, True), event("e", "x' OR '1'='1", "c1", True)],
    )
    dim = farms(spark, [("f1", "F1", "t1", "T1"), ("f2", "F2", "t1", "T1"), ("f3", "F3", "t2", "T2")])

    def kept(**filters):
        df = link_stages(events, one_video(spark), DAY, Filters(**filters), dim)
        return "".join(sorted(r.session_id for r in df.collect()))

    assert kept() == kept(farm="All", tenant="", camera=None) == "abcde"
    assert kept(farm="f1") == kept(farm={"label": "Farm one", "id": "f1"}) == "a"
    assert kept(tenant="t1") == "ab"
    assert kept(tenant="nobody") == ""
    assert kept(tenant="t1", farm="f3") == "c"
    assert kept(camera="c1") == "abe"
    assert kept(forwarded_only=True) == "ade"
    assert kept(farm="x' OR '1'='1") == "e"


def test_first_vote_and_all_votes(spark):
    video = one_video(spark, model_votes=[("first",), ("second",)])
    assert link_stages(one_event(spark), video, DAY).first().stage2_raw_response == "first"
    whole = link_stages(one_event(spark), video, DAY, modes=Modes(raw="all_votes")).first()
    assert [v.raw_response for v in whole.stage2_raw_response] == ["first", "second"]
    for votes in (None, []):
        none = link_stages(one_event(spark), one_video(spark, model_votes=votes), DAY).first()
        assert none.stage2_inference_id == "i" and none.stage2_raw_response is None


def test_video_url(spark):
    def url(path, uri):
        event = one_event(spark, uris=[uri])
        return link_stages(event, one_video(spark, video_gcs_path=path), DAY).first()[-1]

    uri = frame_uri(1, STAMP)
    assert url("gs://v/1.mp4", uri) == "gs://v/1.mp4"
    assert url(None, uri) == "gs://b/video-to-analyze/c/007_0000001_cam_2024-01-10T08:00:00_f0.mp4"
    both = "gs://frames-to-analyze/frames-to-analyze/x.JPG"
    assert url(None, both) == "gs://video-to-analyze/video-to-analyze/x.JPG"


# Brute force ---------------------------------------------------------------


def random_tables(rng, n):
    """Events and videos crowded onto few keys, with repeats and missing parts."""
    first = at("2024-01-08 00:00:00")
    stamps = ["2024-01-09T01:02:03", "2024-01-10T01:02:03"]

    def moment():
        return first + dt.timedelta(seconds=rng.randrange(5 * 24) * 3600)

    def block():
        return 1 if rng.random() < 0.5 else rng.randrange(4)

    def frames():
        pick = rng.random()
        if pick < 0.15:
            return None
        if pick < 0.3:
            return []
        if pick < 0.45:
            return ["gs://b/frames-to-analyze/bad.jpg"]
        return [frame_uri(block(), rng.choice(stamps))]

    events = [
        {
            "session_id": f"s{rng.randrange(n) if rng.random() < 0.2 else i}",
            "camera_id": rng.choice(["c1", "c1", "c2", None]),
            "processing_timestamp": moment(),
            "frame_uris": frames(),
        }
        for i in range(n)
    ]
    videos = [
        {
            "inference_id": f"i{i}",
            "camera_id": rng.choice(["c1", "c1", "c2", None]),
            "inference_timestamp": moment(),
            "file_name": "bad.mp4" if rng.random() < 0.2 else video_name(block(), rng.choice(stamps)),
        }
        for i in range(n)
    ]
    return events, videos


def keys_of(text, pattern, strict):
    if text is None:
        return (None, None)
    found = []
    for p in (pattern, r"_(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})"):
        match = re.search(p, text)
        found.append(match.group(1) if match else (None if strict else ""))
    return tuple(found)


def brute_force(events, videos, modes, days=None):
    strict = modes.blank_keys == "strict"
    rows = []
    for e in events:
        day = e["processing_timestamp"].date()
        if days and not days[0] <= day <= days[1]:
            continue
        uri = (e["frame_uris"] or [None])[0]
        key = (e["camera_id"], *keys_of(uri, r"/(\d{3}_\d{7})_", strict))
        found = [
            v["inference_id"]
            for v in videos
            if None not in key
            and key[1:] != ("", "")
            and key == (v["camera_id"], *keys_of(v["file_name"], r"^(\d{3}_\d{7})_", strict))
            and abs((v["inference_timestamp"].date() - day).days) <= modes.band_days
        ]
        known = e["processing_timestamp"], e["session_id"], e["camera_id"], uri
        rows += [(*known, v) for v in found or [None]]
    return rows


def triples(df):
    return [
        (r.stage1_timestamp, r.session_id, r.camera_id, r.trigger_frame_uri, r.stage2_inference_id)
        for r in df.collect()
    ]


def in_order(rows):
    return sorted(rows, key=lambda r: (-r[0].timestamp(), *(x or "" for x in r[1:])))


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("modes", [Modes(), Modes(blank_keys="verbatim"), LEGACY])
def test_against_nested_loops(spark, seed, modes):
    events, videos = random_tables(random.Random(seed), 60)
    s1, s2 = detections(spark, events).cache(), inferences(spark, videos).cache()
    whole = in_order(brute_force(events, videos, modes))
    for hot_rows in (None, 1, 4):
        assert in_order(triples(link_range(s1, s2, modes=modes, hot_rows=hot_rows))) == whole
    day = dt.date(2024, 1, 10)
    one_day = in_order(brute_force(events, videos, modes, (day, day)))
    linked = link_stages(s1, s2, day, limit=None, modes=modes, hot_rows=2)
    assert in_order(triples(linked)) == one_day
    for limit in (5, 400):
        top = link_stages(s1, s2, day, limit=limit, modes=modes)
        assert triples(top) == one_day[:limit]
        assert triples(link_range(s1, s2, modes=modes, limit=limit)) == whole[:limit]
    s1.unpersist(), s2.unpersist()


def test_large_limits_take_the_plain_plan(spark, monkeypatch):
    events, videos = random_tables(random.Random(11), 40)
    s1, s2 = detections(spark, events), inferences(spark, videos)
    expected = in_order(brute_force(events, videos, Modes()))[:30]
    monkeypatch.setattr(linkage, "TOP_ROWS_BROADCAST", 10)
    assert triples(link_range(s1, s2, limit=30)) == expected


def test_range_is_the_union_of_its_days(spark):
    events, videos = random_tables(random.Random(5), 80)
    s1, s2 = detections(spark, events), inferences(spark, videos)
    daily = []
    for d in (9, 10, 11):
        daily += triples(link_stages(s1, s2, dt.date(2024, 1, d), limit=None))
    assert in_order(triples(link_range(s1, s2, "2024-01-09", "2024-01-11"))) == in_order(daily)


def test_both_top_plans_agree_on_repeated_sessions(spark, monkeypatch):
    same = dict(session_id="s", processing_timestamp=at("2024-01-10 08:00:00"))
    events = [
        {**same, "camera_id": c, "frame_uris": [frame_uri(b, STAMP)]} for c in ("b", "a") for b in (2, 1)
    ]
    videos = [
        {"inference_id": i, "camera_id": c, "inference_timestamp": at("2024-01-10 08:00:00"),
         "file_name": video_name(b, STAMP)}
        for i, c, b in (("i9", "a", 1), ("i1", "b", 1), ("i5", "a", 2), ("i5", "a", 1))
    ]
    s1, s2 = detections(spark, events), inferences(spark, videos)
    for limit in (1, 2, 3, 9):
        tops = []
        for most in (0, 10_000):
            monkeypatch.setattr(linkage, "TOP_ROWS_BROADCAST", most)
            tops.append(triples(link_stages(s1, s2, DAY, limit=limit)))
            tops.append(triples(link_range(s1, s2, limit=limit)))
        assert all(t == in_order(brute_force(events, videos, Modes()))[:limit] for t in tops)


def test_a_session_alone_is_linked_as_in_the_whole(spark):
    events, videos = random_tables(random.Random(7), 60)
    s1, s2 = detections(spark, events), inferences(spark, videos)
    for modes in (Modes(), Modes(blank_keys="verbatim")):
        for session in {e["session_id"] for e in events[:8]}:
            own = [e for e in events if e["session_id"] == session]
            expected = in_order(brute_force(own, videos, modes))
            assert in_order(triples(linkage.link_session(s1, s2, session, modes=modes))) == expected


def test_hot_keys_are_exact(spark):
    rows = spark.createDataFrame([("a",)] * 5 + [("b",)] * 2 + [(None,)] * 9, "k string").where("k IS NOT NULL")

    def hot(n, names=None):
        return [(r.k, r._n, r._slots) for r in hotkeys.hot_keys(rows, ["k"], n, names).orderBy("k").collect()]

    assert hot(6) == [] and hot(2) == [("a", 5, 3), ("b", 2, 1)] and hot(3) == [("a", 5, 2)]
    # names only say where to look
    assert hot(2, ['{"k0":"b"}', '{"k0":"c"}']) == [("b", 2, 1)] and hot(1, []) == []


def test_a_profile_names_the_heavy_keys_of_its_days(spark):
    days = [dt.date(2024, 1, d) for d in (8, 9, 10)]
    rows = [("a", days[0])] * 40 + [("b", days[1])] * 30 + [("a", days[2])] * 5 + [(None, days[2])] * 50
    rows += [(f"x{i}", days[i % 3]) for i in range(200)]
    rows = spark.createDataFrame(rows, "k string, d date")
    loads = [rows.where(F.col("k") != "b"), rows.where(F.col("k") == "b")]
    profile = hotkeys.key_profile(loads[0], ["k"], "d").unionByName(hotkeys.key_profile(loads[1], ["k"], "d"))
    assert {(r.day, r["rows"]) for r in profile.collect()} >= {(days[1], 30)}

    def heavy(n, first=None, last=None):
        return sorted(hotkeys.heavy_names(profile, n, first, last))

    a, b = '{"k0":"a"}', '{"k0":"b"}'
    assert heavy(30) == [a, b] and heavy(45) == [a] and heavy(46) == []
    assert heavy(30, days[1], days[2]) == [b] and heavy(30, None, days[0]) == [a]
    assert heavy(1, dt.date(2025, 1, 1)) == []


@pytest.mark.parametrize("band", [0, 1, 2, 40])
def test_bands_across_the_edges_of_spans(spark, band):
    """Days on both sides of an edge, for spans of any length, and before 1970."""
    events, videos = [], []
    for base in ("1969-12-20", "2024-01-01"):
        for i in range(70):
            moment = at(f"{base} 12:00:00") + dt.timedelta(days=i)
            events.append({"session_id": f"{base}{i}", "camera_id": "c", "processing_timestamp": moment,
                           "frame_uris": [frame_uri(i % 2, STAMP)]})
            videos.append({"inference_id": f"{base}{i}", "camera_id": "c", "inference_timestamp": moment,
                           "file_name": video_name(i % 2, STAMP)})
    s1, s2 = detections(spark, events), inferences(spark, videos)
    modes = Modes(band_days=band)
    want = in_order(brute_force(events, videos, modes))
    for hot_rows in (None, 3):
        assert in_order(triples(link_range(s1, s2, modes=modes, hot_rows=hot_rows))) == want


def test_hot_keys_without_a_partner_in_the_band(spark):
    """A hot key's inferences lie in the span of an event, but not within its band."""
    events = [{"session_id": f"s{d}", "camera_id": "c", "processing_timestamp": at(f"2024-01-{d:02d} 08:00:00"),
               "frame_uris": [frame_uri(1, STAMP)]} for d in range(1, 29)]
    videos = [{"inference_id": f"i{i}", "camera_id": "c", "inference_timestamp": at("2024-01-14 08:00:00"),
               "file_name": video_name(1, STAMP)} for i in range(20)]
    s1, s2 = detections(spark, events), inferences(spark, videos)
    profile = linkage.inference_profile(s2)
    want = in_order(brute_force(events, videos, Modes()))
    for given in (None, profile):
        assert in_order(triples(link_range(s1, s2, hot_rows=4, profile=given))) == want
        one = linkage.link_session(s1, s2, "s13", hot_rows=4, profile=given)
        assert in_order(triples(one)) == [r for r in want if r[1] == "s13"]


def test_profiles_and_stored_tables_give_the_same_links(spark, tmp_path):
    events, videos = random_tables(random.Random(13), 80)
    s1, s2 = detections(spark, events), inferences(spark, videos)
    for modes in (Modes(), Modes(blank_keys="verbatim")):
        want = in_order(brute_force(events, videos, modes))
        profile = linkage.inference_profile(s2, modes)
        assert in_order(triples(link_range(s1, s2, modes=modes, hot_rows=3, profile=profile))) == want
        names = f"stored1_{modes.blank_keys}", f"stored2_{modes.blank_keys}"
        colocated.write_keyed(s1, s2, *names, buckets=4, modes=modes, path=str(tmp_path))
        assert in_order(triples(colocated.link_stored(spark, *names, modes))) == want
        assert in_order(triples(colocated.link_stored(spark, *names, modes, profile, hot_rows=3))) == want
        for name in names:
            spark.sql(f"DROP TABLE {name}")
    found = linkage.hot_link_keys(s2, hot_rows=5, profile=linkage.inference_profile(s2))
    assert found.collect() == linkage.hot_link_keys(s2, hot_rows=5).collect() != []
