"""DuckDB SQL that each registered query is checked against.

Written from the meaning of the queries, not from the Spark code: plain SQL over
the test tables, with the input tables of the library as common table expressions.
"""

from __future__ import annotations

DAY = "2024-01-10"
FIRST, LAST = "2024-01-08", "2024-01-12"
FARM = "12"
CAMERA = "12"
TENANT = "2"
EMPTY_TENANT = "99"
FARM_OF_OTHER_TENANT = "0"
SESSION = "sess-4"

_STEM = """lpad(CAST(user_id % 1000 AS VARCHAR), 3, '0') || '_' || lpad(CAST(event_id AS VARCHAR), 7, '0')
      || '_cam_' || strftime(ts, '%Y-%m-%dT%H:%M:%S')"""

TABLES = f"""
WITH stage1 AS (
  SELECT 'sess-' || CAST(event_id AS VARCHAR) AS session_id,
    CASE WHEN event_id % 89 = 0 THEN NULL ELSE CAST(user_id % 27 AS VARCHAR) END AS farm_id,
    CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS camera_id,
    CASE WHEN (event_id + day(ts)) % 11 = 0 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) + to_milliseconds(61259900)
         ELSE ts END AS processing_timestamp,
    CASE event_type WHEN 'purchase' THEN 'animal_husbandry' WHEN 'error' THEN 'down_cow'
                    WHEN 'click' THEN 'quick_movements' ELSE 'no_event' END AS highest_probability_category,
    CAST(CAST(round(value * 100) AS BIGINT) % 1001 AS DOUBLE) / 1000.0 AS highest_probability_value,
    CASE WHEN event_type = 'signup' THEN NULL ELSE event_type IN ('error','click') END AS should_forward,
    CASE WHEN event_id % 53 = 0 THEN NULL ELSE list_slice(list_transform(range(0, 3), lambda i :
      CASE WHEN event_id % 31 = 0 THEN 'gs://b/frames-to-analyze/bad' || CAST(i AS VARCHAR) || '.jpg'
           ELSE 'gs://b/frames-to-analyze/c' || CAST(user_id AS VARCHAR) || '/' || {_STEM}
             || '_f' || CAST(i AS VARCHAR) || '.jpg' END), 1, least(event_id % 5, 3)) END AS frame_uris,
    CAST((event_id * 3) % 1001 AS DOUBLE) / 1000.0 AS probability_animal_husbandry,
    CAST((event_id * 5) % 1001 AS DOUBLE) / 1000.0 AS probability_down_cow,
    CAST((event_id * 7) % 1001 AS DOUBLE) / 1000.0 AS probability_quick_movements,
    CAST((event_id * 11) % 1001 AS DOUBLE) / 1000.0 AS probability_no_event,
    CASE WHEN event_id % 11 = 0 THEN '{{bad' WHEN event_id % 19 = 0 THEN NULL ELSE props END AS gemini_raw_response
  FROM events),
runs AS (
  SELECT *, unnest(CASE WHEN event_id % 6 = 0 THEN [] WHEN event_id % 13 = 0 THEN [0, 1] ELSE [0] END) AS k
  FROM events WHERE event_type IN ('error','click')),
stage2 AS (
  SELECT 'inf-' || CAST(event_id AS VARCHAR) || '-' || CAST(k AS VARCHAR) AS inference_id,
    CAST(user_id AS VARCHAR) AS camera_id,
    ts + to_hours(CAST((event_id % 4) * 20 AS INTEGER)) AS inference_timestamp,
    CASE event_type WHEN 'error' THEN 'down_cow' ELSE 'quick_movements' END AS classification,
    CAST((event_id * 13) % 1001 AS DOUBLE) / 1000.0 AS max_probability_score,
    event_type = 'error' AS should_forward,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'gs://b/videos/' || CAST(event_id AS VARCHAR) || '.mp4' END AS video_gcs_path,
    CASE WHEN event_id % 31 = 0 THEN 'bad.mp4' ELSE {_STEM} || '.mp4' END AS file_name,
    [struct_pack(model := 'm0', raw_response := props)] AS model_votes
  FROM runs),
tenant_map AS (
  SELECT CAST(r_regionkey AS VARCHAR) AS tenant_id, CASE WHEN r_regionkey = 4 THEN '' ELSE r_name END AS tenant_name,
    CAST(NULL AS VARCHAR) AS tenant_ui_url, lower(r_name) AS tenant_slug FROM region
  UNION ALL SELECT 'tenant_id', 'tenant_name', 'tenant_ui_url', 'tenant_slug'
  UNION ALL SELECT NULL, 'orphan', NULL, NULL),
farm_map AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS farm_id, CASE WHEN n_nationkey = 3 THEN NULL ELSE n_name END AS farm_name,
    CASE WHEN n_nationkey % 7 = 6 THEN NULL WHEN n_nationkey = 9 THEN 'no-such' ELSE CAST(n_regionkey AS VARCHAR) END AS tenant_id FROM nation
  UNION ALL SELECT 'farm_id', 'farm_name', 'tenant_id'),
farm_camera_map AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS camera_id, CASE WHEN s_suppkey = 5 THEN '' ELSE s_name END AS camera_name FROM supplier
  UNION ALL SELECT 'camera_id', 'camera_name'),
object_listing AS (SELECT 'gs://b/videos/' || CAST(event_id AS VARCHAR) || '.mp4' AS uri FROM events WHERE event_id % 3 <> 0),
tenants AS (
  SELECT tenant_id, CASE WHEN coalesce(tenant_name, '') = '' THEN 'Unknown Tenant' ELSE tenant_name END AS tenant_name,
    coalesce(tenant_ui_url, '') AS tenant_ui_url, coalesce(tenant_slug, '') AS tenant_slug
  FROM tenant_map WHERE tenant_id IS NOT NULL AND tenant_id <> 'tenant_id'),
farms AS (
  SELECT f.farm_id, CASE WHEN coalesce(f.farm_name, '') = '' THEN 'Unknown Farm' ELSE f.farm_name END AS farm_name,
    coalesce(f.tenant_id, '') AS tenant_id, coalesce(t.tenant_name, 'Unknown Tenant') AS tenant_name
  FROM farm_map f LEFT JOIN tenants t ON f.tenant_id = t.tenant_id
  WHERE f.farm_id IS NOT NULL AND f.farm_id <> 'farm_id'),
cameras AS (
  SELECT camera_id, CASE WHEN coalesce(camera_name, '') = '' THEN 'Unknown Camera' ELSE camera_name END AS camera_name
  FROM farm_camera_map WHERE camera_id IS NOT NULL AND camera_id <> 'camera_id')
"""


def _array(column: str) -> str:
    return f"CASE WHEN {column} IS NOT NULL THEN CAST(to_json({column}) AS VARCHAR) END AS {column}"


def _keyed1(strict: bool = True) -> str:
    block = r"regexp_extract(frame_uris[1], '/(\d{3}_\d{7})_', 1)"
    stamp = r"regexp_extract(frame_uris[1], '_(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})', 1)"
    if strict:
        block, stamp = f"nullif({block}, '')", f"nullif({stamp}, '')"
    return f"""SELECT session_id, farm_id, camera_id, processing_timestamp AS stage1_timestamp,
      highest_probability_category AS stage1_category, highest_probability_value AS stage1_confidence,
      should_forward AS stage1_should_forward, frame_uris, frame_uris[1] AS trigger_frame_uri,
      {block} AS blk_file, {stamp} AS frame_timestamp_key,
      probability_animal_husbandry, probability_down_cow, probability_quick_movements, probability_no_event,
      gemini_raw_response AS stage1_raw_response
    FROM stage1"""


def _keyed2(strict: bool = True, all_votes: bool = False) -> str:
    block = r"regexp_extract(file_name, '^(\d{3}_\d{7})_', 1)"
    stamp = r"regexp_extract(file_name, '_(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})', 1)"
    if strict:
        block, stamp = f"nullif({block}, '')", f"nullif({stamp}, '')"
    raw = "CAST(to_json(model_votes) AS VARCHAR)" if all_votes else "model_votes[1].raw_response"
    return f"""SELECT inference_id AS stage2_inference_id, camera_id, inference_timestamp AS stage2_timestamp,
      classification AS stage2_classification, max_probability_score AS stage2_confidence,
      should_forward AS stage2_should_forward, video_gcs_path, file_name AS video_filename,
      {block} AS blk_file, {stamp} AS video_timestamp_key, {raw} AS stage2_raw_response
    FROM stage2"""


# The folder names, and in _keyed1 and _keyed2 the key patterns.
_URL = r"""CASE WHEN {path} IS NOT NULL THEN {path}
      ELSE regexp_replace(regexp_replace({frame}, 'frames-to-analyze', 'video-to-analyze', 'g'), '\.jpg$', '.mp4') END"""


def _links(
    where1: str = "",
    where2: str = "",
    on: str = "",
    strict: bool = True,
    all_votes: bool = False,
    limit: int | None = None,
) -> str:
    """Common table expressions ending in `linked`, the 26-column result."""
    url = _URL.format(path="s2.video_gcs_path", frame="s1.trigger_frame_uri")
    tail = ""
    if limit:
        tail = (
            "ORDER BY s1.stage1_timestamp DESC, s1.session_id NULLS FIRST, s1.camera_id NULLS FIRST, "
            "s1.trigger_frame_uri NULLS FIRST, s2.stage2_inference_id NULLS FIRST, "
            f"s2.stage2_timestamp NULLS FIRST, s2.video_filename NULLS FIRST LIMIT {limit}"
        )
    if not strict:  # rows with both keys blank belong to nothing
        on += " AND NOT (s2.blk_file = '' AND s2.video_timestamp_key = '')"
    return f"""{TABLES},
keyed1 AS ({_keyed1(strict)} {where1}),
keyed2 AS ({_keyed2(strict, all_votes)} {where2}),
linked AS (
  SELECT s1.session_id, s1.farm_id, s1.camera_id, s1.stage1_timestamp, s1.stage1_category, s1.stage1_confidence,
    s1.stage1_should_forward, s1.frame_uris, s1.trigger_frame_uri, CAST(len(s1.frame_uris) AS INTEGER) AS frame_count,
    s1.probability_animal_husbandry, s1.probability_down_cow, s1.probability_quick_movements, s1.probability_no_event,
    s1.stage1_raw_response, s2.stage2_inference_id, s2.stage2_timestamp, s2.stage2_classification, s2.stage2_confidence,
    s2.stage2_should_forward, s2.video_gcs_path, s2.video_filename, s2.stage2_raw_response,
    s1.blk_file, s1.frame_timestamp_key AS event_timestamp, {url} AS video_url_derived
  FROM keyed1 s1 LEFT JOIN keyed2 s2
    ON s1.camera_id = s2.camera_id AND s1.blk_file = s2.blk_file AND s1.frame_timestamp_key = s2.video_timestamp_key {on}
  {tail})
"""


def _day_links(filters: str = "", band: int = 1, camera: str | None = None, **modes) -> str:
    where1 = f"WHERE CAST(processing_timestamp AS DATE) = DATE '{DAY}' {filters}"
    where2 = (
        f"WHERE CAST(inference_timestamp AS DATE) BETWEEN DATE '{DAY}' - {band} AND DATE '{DAY}' + {band}"
    )
    if camera:
        where2 += f" AND camera_id = '{camera}'"
    return _links(where1, where2, **modes)


def _near(band: int = 1) -> str:
    return f"AND abs(CAST(s2.stage2_timestamp AS DATE) - CAST(s1.stage1_timestamp AS DATE)) <= {band}"


_NEAR = _near()


def _range_links(filters: str = "", band: int = 1, **modes) -> str:
    where1 = f"WHERE CAST(processing_timestamp AS DATE) BETWEEN DATE '{FIRST}' AND DATE '{LAST}' {filters}"
    return _links(where1, "", _near(band), **modes)


_ALL = "SELECT * REPLACE (CASE WHEN frame_uris IS NOT NULL THEN CAST(to_json(frame_uris) AS VARCHAR) END AS frame_uris) FROM linked"

_CLOCK = "strftime(processing_timestamp, '%H:%M:%S')"
_WORKING_HOURS = f"AND {_CLOCK} >= '08:00:00' AND {_CLOCK} <= '17:00:59'"
_MICRO_HOURS = (
    "AND CAST(processing_timestamp AS TIME) >= TIME '08:00:00' AND CAST(processing_timestamp AS TIME) <= TIME '17:00:59'"
)
_EDGE = f"AND {_CLOCK} >= '00:00:07' AND {_CLOCK} <= '21:37:05'"
_MICRO_EDGE = (
    "AND CAST(processing_timestamp AS TIME) >= TIME '00:00:07' AND CAST(processing_timestamp AS TIME) <= TIME '21:37:05'"
)
_OF_TENANT = "AND farm_id IN (SELECT farm_id FROM farms WHERE tenant_id = '{}')"


# Filter lists -------------------------------------------------------------

_ON_DAY = f"CAST(processing_timestamp AS DATE) = DATE '{DAY}'"
_TENANT_LIST = f"""SELECT DISTINCT f.tenant_name AS label, f.tenant_id AS id
  FROM stage1 s JOIN farms f ON s.farm_id = f.farm_id WHERE {_ON_DAY} AND f.tenant_id <> ''"""
_FARM_IDS = f"(SELECT DISTINCT farm_id FROM stage1 WHERE {_ON_DAY} AND farm_id IS NOT NULL)"


def _farm_list(tenant: str | None = None) -> str:
    only = f"WHERE f.tenant_id = '{tenant}'" if tenant else ""
    return f"""SELECT coalesce(f.farm_name, c.farm_id) AS label, c.farm_id AS id
      FROM {_FARM_IDS} c LEFT JOIN farms f ON c.farm_id = f.farm_id {only}"""


def _camera_list(farm: str | None = None) -> str:
    only = f"AND farm_id = '{farm}'" if farm else ""
    return f"""SELECT coalesce(m.camera_name, c.camera_id) AS label, c.camera_id AS id
      FROM (SELECT DISTINCT camera_id FROM stage1 WHERE {_ON_DAY} AND camera_id IS NOT NULL {only}) c LEFT JOIN cameras m ON c.camera_id = m.camera_id"""


def _list(entries: str) -> str:
    return f"""SELECT 0 AS pos, 'All' AS label, 'All' AS id
      UNION ALL SELECT CAST(row_number() OVER (ORDER BY label, id) AS INTEGER), label, id FROM ({entries})"""


def _lists(**lists: str) -> str:
    return TABLES + " UNION ALL ".join(
        f"SELECT '{name}' AS facet, * FROM ({_list(entries)})" for name, entries in lists.items()
    )


# Shown values -------------------------------------------------------------


def _score(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR isnan({c}) THEN 'N/A' ELSE printf('%.3f', {c}) END"


def _flag(c: str, yes: str, no: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'N/A' WHEN {c} THEN '{yes}' ELSE '{no}' END"


_DISPLAY = f"""SELECT coalesce(f.farm_name, l.farm_id, 'N/A') AS "Farm",
    coalesce(c.camera_name, l.camera_id, 'N/A') AS "Camera",
    strftime(stage1_timestamp, '%Y-%m-%d %H:%M:%S') AS "Stage 1 Time",
    event_timestamp AS "Event Timestamp", stage1_category AS "S1 Category",
    {_score('stage1_confidence')} AS "S1 Conf", {_flag('stage1_should_forward', '✓', '✗')} AS "S1 Forward",
    stage2_classification AS "S2 Class", {_score('stage2_confidence')} AS "S2 Conf",
    {_flag('stage2_should_forward', '✓', '✗')} AS "S2 Forward"
  FROM linked l LEFT JOIN farms f ON l.farm_id = f.farm_id LEFT JOIN cameras c ON l.camera_id = c.camera_id"""


def _status(raw: str) -> str:
    return f"""CASE WHEN coalesce({raw}, '') = '' THEN 'missing'
      WHEN json_valid(replace({raw}, '\\n', chr(10))) THEN 'json' ELSE 'text' END"""


def _body(raw: str) -> str:
    clean = f"replace({raw}, '\\n', chr(10))"
    return f"""CASE {_status(raw)} WHEN 'json' THEN {clean}
      WHEN 'text' THEN replace({clean}, '\\"', '"') END"""


def _details(where: str = "") -> str:
    def line(label: str, value: str) -> str:
        return f"'{label}: ' || coalesce(CAST({value} AS VARCHAR), 'N/A')"

    moment = """CASE WHEN date_part('microseconds', stage1_timestamp) % 1000000 = 0
      THEN strftime(stage1_timestamp, '%Y-%m-%d %H:%M:%S') ELSE strftime(stage1_timestamp, '%Y-%m-%d %H:%M:%S.%f') END"""

    def raw(c: str) -> str:
        return f"coalesce({_body(c)}, '  (No raw response available)')"

    second = " || chr(10) || ".join(
        [
            line("  Classification", "stage2_classification"),
            line("  Confidence", _score("stage2_confidence")),
            line("  Should Forward", _flag("stage2_should_forward", "Yes ✓", "No ✗")),
        ]
    )
    lines = [
        line("Session ID", "session_id"),
        "''",
        "'═══ Location ═══'",
        line("  Farm", "coalesce(f.farm_name, l.farm_id)"),
        line("  Farm ID", "l.farm_id"),
        line("  Camera", "coalesce(c.camera_name, l.camera_id)"),
        line("  Camera ID", "l.camera_id"),
        "''",
        "'═══ Stage 1 Results ═══'",
        line("  Category", "stage1_category"),
        line("  Confidence", _score("stage1_confidence")),
        line("  Should Forward", _flag("stage1_should_forward", "Yes ✓", "No ✗")),
        line("  Frame Count", "frame_count"),
        line("  Timestamp", moment),
        "''",
        "'═══ Stage 2 Results ═══'",
        f"CASE WHEN stage2_inference_id IS NULL THEN '  (No Stage 2 processing - event not forwarded)' ELSE {second} END",
        "''",
        "'═══ Stage 1 Raw Response ═══'",
        raw("stage1_raw_response"),
        "''",
        "'═══ Stage 2 Raw Response ═══'",
        raw("stage2_raw_response"),
    ]
    return (
        "SELECT session_id, stage2_inference_id, "
        + " || chr(10) || ".join(lines)
        + f""" AS details FROM linked l LEFT JOIN farms f ON l.farm_id = f.farm_id
          LEFT JOIN cameras c ON l.camera_id = c.camera_id {where}"""
    )


# Media --------------------------------------------------------------------

_VALID = "({u} IS NOT NULL AND starts_with({u}, 'gs://') AND strpos(replace({u}, 'gs://', ''), '/') > 0)"
_BUCKET = "split_part(replace({u}, 'gs://', ''), '/', 1)"
_OBJECT = "substr(replace({u}, 'gs://', ''), strpos(replace({u}, 'gs://', ''), '/') + 1)"

_OBJECT_URIS = """SELECT 'event-' || event_id AS id, CASE event_id % 9
      WHEN 0 THEN 'gs://b' || event_id WHEN 1 THEN 'gs://b' || event_id || '/' WHEN 2 THEN 's3://b/' || event_id
      WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN 'gs://my_bucket/x/' || event_id
      WHEN 6 THEN 'gs://b/gs://c/' || event_id ELSE 'gs://b/v/' || event_id || '.jpg' END AS uri FROM events
    UNION ALL SELECT 'page-' || page_id, url FROM pages"""

_RAW_RESPONSES = """SELECT 'event-' || event_id AS id, CASE event_id % 10
      WHEN 1 THEN '{bad ' || event_id WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN '[1, ' || props || ']'
      WHEN 5 THEN props || ' x' WHEN 6 THEN '{"a":\\n ' || event_id || '}'
      WHEN 7 THEN '{"a": "x\\ny' || event_id || '"}' WHEN 8 THEN '{\\"a\\": ' || event_id || '}'
      WHEN 9 THEN '{"a": NaN, "a": ' || event_id || '}' ELSE props END AS raw FROM events
    UNION ALL SELECT 'doc-' || doc_id, text FROM documents
    UNION ALL SELECT 'turn-' || conv_id || '-' || turn,
      '{"text": "' || replace(replace(text, '\\', '\\\\'), '"', '\\"') || '"}' FROM conversations"""


def statements() -> dict[str, str]:
    day, whole = _day_links, _links(on=_NEAR)
    detections = f"{TABLES} SELECT * REPLACE ({_array('frame_uris')}) FROM stage1"
    frame = "frame_uris[1]"
    page = day(_WORKING_HOURS, limit=100)
    farm_camera_hours = f"AND farm_id = '{FARM}' AND camera_id = '{CAMERA}' {_WORKING_HOURS}"
    summary = f"""'Date: {DAY} | From: 08:00 | To: 17:00 | Tenant: '
      || coalesce((SELECT tenant_name FROM tenants WHERE tenant_id = '{TENANT}'), '{TENANT}')
      || ' | Farm: ' || coalesce((SELECT farm_name FROM farms WHERE farm_id = '{FARM}'), '{FARM}')
      || ' | Camera: ' || coalesce((SELECT camera_name FROM cameras WHERE camera_id = '{CAMERA}'), '{CAMERA}')"""
    status = """SELECT results, least(results, 100) AS on_page, CASE WHEN results > 0 THEN 'Found ' || results || ' results | ' || summary
      ELSE 'No results found. Filters: ' || summary END AS status FROM (SELECT
      (SELECT count(*) FROM linked) AS results, {} AS summary)"""
    uri = {"u": "uri"}
    frames = f"""{TABLES}, frames AS (
        SELECT session_id, unnest(list_filter(frame_uris, lambda x : {_VALID.format(u='x')})) AS uri,
          generate_subscripts(list_filter(frame_uris, lambda x : {_VALID.format(u='x')}), 1) - 1 AS n FROM stage1)
      SELECT session_id, CAST(n AS INTEGER) AS frame_no, uri, {_BUCKET.format(**uri)} AS bucket,
        {_OBJECT.format(**uri)} AS object_name, 333 AS duration_ms FROM frames"""
    asked = f"{TABLES} SELECT DISTINCT video_gcs_path AS uri FROM stage2 WHERE video_gcs_path IS NOT NULL"
    three_lists = {"tenant": _TENANT_LIST, "farm": _farm_list(), "camera": _camera_list()}
    return {
        "scan_detections": detections,
        "scan_inferences": f"{TABLES} SELECT * REPLACE ({_array('model_votes')}) FROM stage2",
        "scan_parsed_responses": f"""{TABLES} SELECT * REPLACE ({_array('frame_uris')},
            '{{"session":"' || session_id || '"' || coalesce(',"forward":' || CAST(should_forward AS VARCHAR), '') || '}}'
              AS gemini_raw_response) FROM stage1""",
        "table_by_path": "SELECT event_id, event_type, value FROM events",
        "table_by_connector": "SELECT event_id, event_type, value FROM events WHERE event_type = 'error'",
        "tenant_dim": f"{TABLES} SELECT * FROM tenants",
        "farm_dim": f"{TABLES} SELECT * FROM farms",
        "camera_dim": f"{TABLES} SELECT * FROM cameras",
        "dim_dedup": """SELECT CAST(user_id AS VARCHAR) AS id, event_type AS name, ts, event_id FROM events
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
        "site_config_farms": "SELECT CAST(n_nationkey AS VARCHAR) AS farm_id, n_name AS farm_name FROM nation",
        "site_config_cameras": """SELECT CAST(s_suppkey AS VARCHAR) AS camera_id, s_name AS camera_name,
            n_name AS farm_name, CAST(n_nationkey AS VARCHAR) AS farm_id
            FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
        "stage1_keyed": f"{TABLES} SELECT * REPLACE ({_array('frame_uris')}) FROM ({_keyed1()})",
        "stage1_keyed_verbatim": f"{TABLES} SELECT * REPLACE ({_array('frame_uris')}) FROM ({_keyed1(False)})",
        "stage2_keyed": f"{TABLES} {_keyed2()}",
        "first_vote_response": f"{TABLES} SELECT inference_id, model_votes[1].raw_response AS stage2_raw_response FROM stage2",
        "events_on_day": f"{detections} WHERE {_ON_DAY}",
        "link_stages": day() + _ALL,
        "link_stages_verbatim": day(strict=False) + _ALL,
        "link_stages_warehouse": day(strict=False, all_votes=True) + _ALL,
        "link_stages_band2": day(band=2) + _ALL,
        "link_stages_legacy": day(_MICRO_EDGE, band=2) + _ALL,
        "link_stages_top50": day(limit=50) + _ALL,
        "link_stages_top100": day(limit=100) + _ALL,
        "link_stages_verbatim_top100": day(strict=False, all_votes=True, limit=100) + _ALL,
        "linked_by_farm": day(f"AND farm_id = '{FARM}'") + _ALL,
        "linked_by_tenant": day(_OF_TENANT.format(TENANT)) + _ALL,
        "linked_by_empty_tenant": day(_OF_TENANT.format(EMPTY_TENANT)) + _ALL,
        "linked_farm_over_tenant": day(f"AND farm_id = '{FARM_OF_OTHER_TENANT}'") + _ALL,
        "linked_by_camera": day(f"AND camera_id = '{CAMERA}'", camera=CAMERA) + _ALL,
        "linked_form_values": day(f"AND camera_id = '{CAMERA}' {_WORKING_HOURS}", camera=CAMERA) + _ALL,
        "linked_forwarded_only": day("AND should_forward") + _ALL,
        "linked_time_window": day(_WORKING_HOURS) + _ALL,
        "linked_time_window_micro": day(_MICRO_HOURS) + _ALL,
        "linked_time_edge": day(_EDGE) + _ALL,
        "linked_all_filters": day(
            f"{_OF_TENANT.format(TENANT)} AND camera_id = '{CAMERA}' AND should_forward {_WORKING_HOURS}"
        )
        + _ALL,
        "link_range": _range_links() + _ALL,
        "link_range_verbatim": _range_links(strict=False) + _ALL,
        "link_range_band2": _range_links(band=2) + _ALL,
        "link_range_time_window": _range_links(f"{_OF_TENANT.format(TENANT)} {_WORKING_HOURS}") + _ALL,
        "link_all_days": whole + _ALL,
        "link_all_days_salted": whole + _ALL,
        "link_all_days_profiled": whole + _ALL,
        "link_all_days_colocated": whole + _ALL,
        "hot_link_keys": f"""{TABLES}, keyed2 AS ({_keyed2()})
            SELECT camera_id, blk_file, video_timestamp_key, count(*) AS inferences, CAST(ceil(count(*) / 2.0) AS INTEGER) AS slots
            FROM keyed2 WHERE camera_id IS NOT NULL AND blk_file IS NOT NULL AND video_timestamp_key IS NOT NULL
            GROUP BY ALL HAVING count(*) >= 2""",
        "link_stages_verbatim_salted": day(strict=False) + _ALL,
        "video_url": whole + "SELECT session_id, stage2_inference_id, video_url_derived FROM linked",
        "frame_video_url": f"{TABLES} SELECT session_id, {_URL.format(path='NULL', frame=frame)} AS video_url FROM stage1",
        "name_lookup": f"""{TABLES} SELECT s.session_id, s.farm_id, s.camera_id,
            coalesce(f.farm_name, s.farm_id) AS farm, coalesce(c.camera_name, s.camera_id) AS camera
            FROM stage1 s LEFT JOIN farms f ON s.farm_id = f.farm_id LEFT JOIN cameras c ON s.camera_id = c.camera_id""",
        "farm_info": f"""{TABLES} SELECT i.farm_id, coalesce(f.farm_name, i.farm_id) AS farm_name,
            coalesce(f.tenant_id, '') AS tenant_id, coalesce(f.tenant_name, 'Unknown') AS tenant_name
            FROM (SELECT DISTINCT farm_id FROM stage1 WHERE farm_id IS NOT NULL) i LEFT JOIN farms f ON i.farm_id = f.farm_id""",
        "camera_info": f"""{TABLES} SELECT i.camera_id, coalesce(c.camera_name, i.camera_id) AS camera_name
            FROM (SELECT DISTINCT camera_id FROM stage1 WHERE camera_id IS NOT NULL) i LEFT JOIN cameras c ON i.camera_id = c.camera_id""",
        "site_camera_info": f"""{TABLES} SELECT i.camera_id, coalesce(s_name, i.camera_id) AS camera_name,
            coalesce(n_name, 'Unknown') AS farm_name, coalesce(CAST(n_nationkey AS VARCHAR), '') AS farm_id
            FROM (SELECT DISTINCT camera_id FROM stage1 WHERE camera_id IS NOT NULL) i
            LEFT JOIN supplier ON i.camera_id = CAST(s_suppkey AS VARCHAR) LEFT JOIN nation ON s_nationkey = n_nationkey""",
        "tenant_facet": TABLES + _list(_TENANT_LIST),
        "farm_facet": TABLES + _list(_farm_list()),
        "farm_facet_by_tenant": TABLES + _list(_farm_list(TENANT)),
        "camera_facet": TABLES + _list(_camera_list()),
        "camera_facet_by_farm": TABLES + _list(_camera_list(FARM)),
        "farm_facet_site_config": TABLES + _list(
            f"""SELECT coalesce(n_name, c.farm_id) AS label, c.farm_id AS id
            FROM {_FARM_IDS} c LEFT JOIN nation ON c.farm_id = CAST(n_nationkey AS VARCHAR)"""
        ),
        "camera_facet_site_config": TABLES + _list(
            f"""SELECT coalesce(s_name, c.camera_id) AS label, c.camera_id AS id
            FROM (SELECT DISTINCT camera_id FROM stage1 WHERE {_ON_DAY} AND camera_id IS NOT NULL AND farm_id = '{FARM}') c LEFT JOIN supplier ON c.camera_id = CAST(s_suppkey AS VARCHAR)"""
        ),
        "load_filters": _lists(**three_lists),
        "after_tenant_choice": _lists(farm=_farm_list(TENANT), camera=_camera_list()),
        "after_farm_choice": _lists(camera=_camera_list(FARM)),
        "facet_counts": f"""{TABLES} SELECT *, 'Loaded ' || tenants || ' tenants, ' || farms || ' farms, '
            || cameras || ' cameras for {DAY}' AS status FROM (SELECT
            (SELECT count(*) FROM ({_TENANT_LIST})) AS tenants, (SELECT count(*) FROM ({_farm_list()})) AS farms,
            (SELECT count(*) FROM ({_camera_list()})) AS cameras)""",
        "display_table": whole + _DISPLAY,
        "event_details": whole + _details(),
        "row_details": whole + _details(f"WHERE session_id = '{SESSION}'"),
        "event_details_all_votes": _links(on=_NEAR, strict=False, all_votes=True) + _details(),
        "row_details_all_votes": _links(on=_NEAR, strict=False, all_votes=True)
        + _details(f"WHERE session_id = '{SESSION}'"),
        "linked_display": page + _DISPLAY,
        "query_status": day(farm_camera_hours) + status.format(summary),
        "query_status_empty": day(_OF_TENANT.format(EMPTY_TENANT))
        + status.format(f"'Date: {DAY} | Tenant: {EMPTY_TENANT}'"),
        "normalize_response": f"""SELECT id, {_status('raw')} AS status, {_body('raw')} AS body
            FROM ({_RAW_RESPONSES})""",
        "object_uri_parts": f"""SELECT id, uri, {_VALID.format(**uri)} AS is_valid,
            CASE WHEN {_VALID.format(**uri)} THEN {_BUCKET.format(**uri)} END AS bucket,
            CASE WHEN {_VALID.format(**uri)} THEN {_OBJECT.format(**uri)} END AS object_name
            FROM ({_OBJECT_URIS})""",
        "frame_manifest": frames,
        "playable_videos": whole
        + """SELECT session_id, stage2_inference_id, video_gcs_path FROM linked
            WHERE stage2_inference_id IS NOT NULL AND video_gcs_path IS NOT NULL""",
        "media_present": f"{asked} AND video_gcs_path IN (SELECT uri FROM object_listing)",
        "media_missing": f"{asked} AND video_gcs_path NOT IN (SELECT uri FROM object_listing)",
    }
