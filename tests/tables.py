"""Small literal tables for tests, built from partial rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

from stagetrace import schemas


def ntz(schema: T.StructType) -> T.StructType:
    """The same schema with timestamps that carry no zone."""
    return T.StructType(
        [
            T.StructField(
                f.name,
                T.TimestampNTZType() if isinstance(f.dataType, T.TimestampType) else f.dataType,
            )
            for f in schema
        ]
    )


def _frame(spark, schema, rows):
    schema = ntz(schema)
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def detections(spark, rows):
    return _frame(spark, schemas.DETECTIONS, rows)


def inferences(spark, rows):
    return _frame(spark, schemas.INFERENCES, rows)


def farms(spark, rows):
    """A farm dimension: (farm_id, farm_name, tenant_id, tenant_name)."""
    return spark.createDataFrame(
        rows, "farm_id string, farm_name string, tenant_id string, tenant_name string"
    )


def cameras(spark, rows):
    return spark.createDataFrame(rows, "camera_id string, camera_name string")


def frame_uri(block: int, stamp: str, n: int = 0) -> str:
    return f"gs://b/frames-to-analyze/c/007_{block:07d}_cam_{stamp}_f{n}.jpg"


def video_name(block: int, stamp: str) -> str:
    return f"007_{block:07d}_cam_{stamp}.mp4"
