"""Spark's own estimate of a frame's size, by which a plan is chosen; rows never depend on it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame


def estimated_bytes(df: DataFrame) -> float:
    """From the sizes of the files behind the frame: no job runs.  Infinite where it is unknown."""
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return math.inf
    return float(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))
