"""Linking from keyed tables that are stored side by side.

Both tables are bucketed by camera, block and time, so that rows that can link lie
in files of the same number: linking them, for however many days and however often,
shuffles nothing.  The keys are parsed once, when the tables are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagetrace.operators import linkage
from stagetrace.operators.hotkeys import HOT_ROWS, heavy_names
from stagetrace.operators.linkage import STANDARD, Modes

STAGE1_KEYS = ("camera_id", "blk_file", "frame_timestamp_key")
STAGE2_KEYS = ("camera_id", "blk_file", "video_timestamp_key")


def _store(rows: DataFrame, name: str, keys: tuple[str, ...], buckets: int, path: str | None) -> None:
    """One file for each bucket: rows are dealt the way the buckets are."""
    dealt = rows.repartition(buckets, *keys)
    writer = dealt.write.bucketBy(buckets, *keys).sortBy(*keys)
    if path is not None:
        writer = writer.option("path", f"{path}/{name.rsplit('.', 1)[-1]}")
    writer.mode("overwrite").format("parquet").saveAsTable(name)


def write_keyed(
    detections: DataFrame,
    inferences: DataFrame,
    stage1_name: str,
    stage2_name: str,
    buckets: int,
    modes: Modes = STANDARD,
    path: str | None = None,
) -> None:
    """Store both stages under their result names, with keys, as bucketed tables.

    `buckets` should leave some hundred megabytes in each bucket of the larger
    table.  `path` is a folder for external tables; else the warehouse holds them.
    """
    _store(linkage.stage1_keyed(detections, modes.blank_keys), stage1_name, STAGE1_KEYS, buckets, path)
    _store(linkage.second_stage(inferences, modes), stage2_name, STAGE2_KEYS, buckets, path)


def link_stored(
    spark: SparkSession,
    stage1_name: str,
    stage2_name: str,
    modes: Modes = STANDARD,
    profile: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """All linked rows of two stored tables, as link_range gives them.

    A bucket is one task's, and a key cannot be split in it.  Where a profile of the
    inferences' keys has hot ones, the tables are shuffled and salted after all.
    """
    stage1 = spark.table(stage1_name).where(F.col("stage1_timestamp").isNotNull())
    stage2 = spark.table(stage2_name)
    names = [] if profile is None else heavy_names(profile, hot_rows)
    return linkage.link_keyed(stage1, stage2, modes.band_days, hot_rows, names, stored=not names)
