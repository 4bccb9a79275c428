"""A session with the settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Session settings that belong to every run, small or large.  Memory, executor
# counts and spark.checkpoint.dir come from the cluster and are left alone.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Many small partitions to begin with, which adaptive execution merges to fit; a
    # job over terabytes needs tens of thousands, and no partition that is too large
    # can be made smaller again.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    # Filtered detections hand their keys to the scan of the inferences as a Bloom filter
    # of at most some megabytes, however large the tables are that they come from.
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1t",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1g",
    # HotSpot does not compile methods beyond 8,000 bytes; better several small ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(
    app: str = "stagetrace",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create or reuse a session; calendar days are taken in UTC."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(SETTINGS)
    if shuffle_partitions:  # a number for a known, small input
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
        del conf["spark.sql.adaptive.coalescePartitions.initialPartitionNum"]
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
