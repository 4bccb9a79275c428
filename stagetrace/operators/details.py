"""One text per linked row with everything known about the event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagetrace.functions import text
from stagetrace.functions.responses import ABSENT, normalized
from stagetrace.operators.lookup import with_display_name

# The lines of the text, and below the labels in them.
LOCATION = "═══ Location ═══"
STAGE1 = "═══ Stage 1 Results ═══"
STAGE2 = "═══ Stage 2 Results ═══"
STAGE1_RAW = "═══ Stage 1 Raw Response ═══"
STAGE2_RAW = "═══ Stage 2 Raw Response ═══"
NOT_FORWARDED = "  (No Stage 2 processing - event not forwarded)"
NO_RESPONSE = "  (No raw response available)"


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(label + ": "), F.coalesce(value.cast("string"), F.lit(text.MISSING)))


def _response(status: str, body: str) -> Column:
    return F.when(F.col(status) == ABSENT, F.lit(NO_RESPONSE)).otherwise(F.col(body))


def normalize_response(
    df: DataFrame, raw: str, status: str, body: str, max_chars: int | None = None
) -> DataFrame:
    """Add the state of a raw response and the text to show for it."""
    both = f"_{status}_{body}"
    return (
        df.withColumn(both, normalized(F.col(raw), max_chars))
        .withColumns({status: F.col(both)["status"], body: F.col(both)["body"]})
        .drop(both)
    )


def _as_text(df: DataFrame, column: str) -> DataFrame:
    """A response that came parsed, as JSON text; an empty list of votes is none."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return df
    shown = F.to_json(column)
    if isinstance(kind, T.ArrayType):
        shown = F.when(F.size(column) > 0, shown)
    return df.withColumn(column, shown)


def event_details(
    linked: DataFrame, farms: DataFrame, cameras: DataFrame, max_chars: int | None = None
) -> DataFrame:
    """`session_id`, `stage2_inference_id` and the details text of every row."""
    rows = linked.withColumns(
        {"farm_id": F.nullif("farm_id", F.lit("")), "camera_id": F.nullif("camera_id", F.lit(""))}
    )
    rows = with_display_name(rows, farms, "farm_id", "farm_name", "_farm")
    rows = with_display_name(rows, cameras, "camera_id", "camera_name", "_camera")
    for stage in ("1", "2"):
        raw = f"stage{stage}_raw_response"
        rows = normalize_response(
            _as_text(rows, raw), raw, f"_status{stage}", f"_body{stage}", max_chars
        )
    blank = F.lit("")
    forwarded1 = text.shown_flag(F.col("stage1_should_forward"), text.YES, text.NO)
    forwarded2 = text.shown_flag(F.col("stage2_should_forward"), text.YES, text.NO)
    second = F.concat_ws(
        "\n",
        _line("  Classification", F.col("stage2_classification")),
        _line("  Confidence", text.shown_score(F.col("stage2_confidence"))),
        _line("  Should Forward", forwarded2),
    )
    details = F.concat_ws(
        "\n",
        _line("Session ID", F.col("session_id")),
        blank,
        F.lit(LOCATION),
        _line("  Farm", F.col("_farm")),
        _line("  Farm ID", F.col("farm_id")),
        _line("  Camera", F.col("_camera")),
        _line("  Camera ID", F.col("camera_id")),
        blank,
        F.lit(STAGE1),
        _line("  Category", F.col("stage1_category")),
        _line("  Confidence", text.shown_score(F.col("stage1_confidence"))),
        _line("  Should Forward", forwarded1),
        _line("  Frame Count", F.col("frame_count")),
        _line("  Timestamp", text.shown_moment(F.col("stage1_timestamp"))),
        blank,
        F.lit(STAGE2),
        F.when(F.col("stage2_inference_id").isNull(), F.lit(NOT_FORWARDED)).otherwise(second),
        blank,
        F.lit(STAGE1_RAW),
        _response("_status1", "_body1"),
        blank,
        F.lit(STAGE2_RAW),
        _response("_status2", "_body2"),
    )
    return rows.select("session_id", "stage2_inference_id", details.alias("details"))
