"""Frames and videos of linked events as tables of object URIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagetrace.functions.uris import bucket_name, is_object_uri, object_name

# Fixed value: frames shown per second.
FRAMES_PER_SECOND = 3


def object_uri_parts(uris: DataFrame, column: str = "uri") -> DataFrame:
    """Add whether a URI names an object, and its bucket and object name."""
    uri = F.col(column)
    return uris.select(
        *uris.columns,
        is_object_uri(uri).alias("is_valid"),
        bucket_name(uri).alias("bucket"),
        object_name(uri).alias("object_name"),
    )


def frame_manifest(events: DataFrame, fps: int = FRAMES_PER_SECOND) -> DataFrame:
    """One row per valid frame of an event, in playing order from 0.

    Frames are filtered inside their array and then unfolded, so the order needs
    no window and no shuffle.  Null and empty arrays give no rows.
    """
    valid = F.filter("frame_uris", is_object_uri)
    frames = events.select("session_id", F.posexplode(valid).alias("frame_no", "uri"))
    return frames.select(
        "session_id",
        "frame_no",
        "uri",
        bucket_name(F.col("uri")).alias("bucket"),
        object_name(F.col("uri")).alias("object_name"),
        F.lit(int(1000 / fps)).alias("duration_ms"),
    )


def playable_videos(linked: DataFrame) -> DataFrame:
    """Videos that can be played: those an inference recorded a path for.

    The derived location is only a guess and does not count.
    """
    return linked.where(
        F.col("stage2_inference_id").isNotNull() & F.col("video_gcs_path").isNotNull()
    ).select("session_id", "stage2_inference_id", "video_gcs_path")


def _asked(uris: DataFrame, column: str) -> DataFrame:
    # Both sides of the lookups are made distinct: a URI that very many rows share
    # is merged on the map side, and the join needs no further shuffle.
    return uris.select(F.col(column).alias("uri")).where("uri IS NOT NULL").distinct()


def media_present(uris: DataFrame, listing: DataFrame, column: str = "uri") -> DataFrame:
    """Distinct valid URIs that the listing has."""
    return (
        _asked(uris, column)
        .where(is_object_uri(F.col("uri")))
        .join(listing.select("uri").distinct(), "uri", "left_semi")
    )


def media_missing(uris: DataFrame, listing: DataFrame, column: str = "uri") -> DataFrame:
    """Distinct URIs that the listing lacks; an invalid URI is always missing."""
    listed = listing.select("uri").where(is_object_uri(F.col("uri"))).distinct()
    return _asked(uris, column).join(listed, "uri", "left_anti")
