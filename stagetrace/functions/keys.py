"""Linkage keys and the derived video location, parsed from URIs and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text forms shared by frame URIs and video file names.
FRAME_BLOCK = r"/(\d{3}_\d{7})_"
VIDEO_BLOCK = r"^(\d{3}_\d{7})_"
SECOND_STAMP = r"_(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})"
FRAME_FOLDER = "frames-to-analyze"
VIDEO_FOLDER = "video-to-analyze"
FRAME_SUFFIX = r"\.jpg$"
VIDEO_SUFFIX = ".mp4"

BLANK_KEYS = ("strict", "verbatim")


def extracted(text: Column, pattern: str, blank_keys: str) -> Column:
    """First group of the pattern.

    Text without a match gives null under `strict`, so it links to nothing, and
    the empty string under `verbatim`, so unparseable rows link to each other.
    """
    if blank_keys not in BLANK_KEYS:
        raise ValueError(f"unknown blank_keys: {blank_keys!r}")
    found = F.regexp_extract(text, pattern, 1)
    return F.nullif(found, F.lit("")) if blank_keys == "strict" else found


def trigger_frame(frame_uris: Column) -> Column:
    """First frame of an event; null for a null or empty array."""
    return F.get(frame_uris, F.lit(0))


def video_url(video_path: Column, frame_uri: Column) -> Column:
    """The recorded video path, else the place a video of this frame would have."""
    guessed = F.regexp_replace(
        F.replace(frame_uri, F.lit(FRAME_FOLDER), F.lit(VIDEO_FOLDER)),
        FRAME_SUFFIX,
        VIDEO_SUFFIX,
    )
    return F.coalesce(video_path, guessed)
