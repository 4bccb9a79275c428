"""Linked rows as a table for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagetrace.functions.text import CROSS, MISSING, TICK, shown_flag, shown_score, shown_second
from stagetrace.operators.lookup import with_display_name


def _tick(column: str) -> Column:
    return shown_flag(F.col(column), TICK, CROSS)


# Headings of the display table, in order, with their source
# column and how its values are shown.
_LAYOUT = (
    ("Farm", "farm_id", lambda _: F.col("_farm")),
    ("Camera", "camera_id", lambda _: F.col("_camera")),
    ("Stage 1 Time", "stage1_timestamp", lambda c: shown_second(F.col(c))),
    ("Event Timestamp", "event_timestamp", F.col),
    ("S1 Category", "stage1_category", F.col),
    ("S1 Conf", "stage1_confidence", lambda c: shown_score(F.col(c))),
    ("S1 Forward", "stage1_should_forward", _tick),
    ("S2 Class", "stage2_classification", F.col),
    ("S2 Conf", "stage2_confidence", lambda c: shown_score(F.col(c))),
    ("S2 Forward", "stage2_should_forward", _tick),
)


def display_table(linked: DataFrame, farms: DataFrame, cameras: DataFrame) -> DataFrame:
    """The display columns whose source is present; other columns are dropped."""
    present = set(linked.columns)
    if "farm_id" in present:
        linked = with_display_name(linked, farms, "farm_id", "farm_name", "_farm", MISSING)
    if "camera_id" in present:
        linked = with_display_name(
            linked, cameras, "camera_id", "camera_name", "_camera", MISSING
        )
    return linked.select(
        *(show(source).alias(head) for head, source, show in _LAYOUT if source in present)
    )
