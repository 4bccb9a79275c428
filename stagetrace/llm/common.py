"""What several operators share: saved tables, gapless numbering, anti joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: monotonically_increasing_id() holds the row's place in its partition in these bits.
PLACE_BITS = 33
#: Rows of a group among which a sample is ranked, for each row it may give.
OVERSHOOT = 4


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; one of our own only where none is
    set and all tasks run on the driver's machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="stagetrace-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir() or folder
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The frame written to the shared folder and read again: lineage ends there, so that a
    lost executor costs no more than the tasks it ran."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def range_sorted(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """A saved table sorted by `by` over range partitions, with `_part` and `_place`: the
    partition, in order, and the row's place in it, from 0.

    Without a number of its own the exchange begins with the session's partitions, which
    adaptive execution merges to its target size: as many as the rows call for."""
    at = F.monotonically_increasing_id()
    out = (
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_at", at)
        .withColumn("_part", F.shiftright("_at", PLACE_BITS))
        .withColumn("_place", F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1))
        .drop("_at")
    )
    return saved(out, name)


def numbered(df: DataFrame, by: list[str], out: str, name: str) -> DataFrame:
    """Rows with a gapless number from 0 in the order of `by`.

    Only a row per range partition is summed in one task.  `by` should tell rows apart;
    rows alike in it are numbered in any order, once.
    """
    rows = range_sorted(df, by, name)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # one row for each range partition
    rows = rows.join(F.broadcast(starts), "_part")
    return rows.withColumn(out, F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of docs whose key is not among ids[key]; a null key equals a null key."""
    gone = ids.select(F.col(key).alias("_gone")).distinct()
    return docs.join(gone, docs[key].eqNullSafe(gone["_gone"]), "left_anti")


def bounded_sample(rows: DataFrame, group: str, most: int, seed: int, key: str = "doc_id") -> DataFrame:
    """At most `most` rows of (key, group), dealt evenly over the groups in hash order.

    Each group is ranked by a hash of the key, and the lowest ranks of all groups are
    taken: a function of the rows, whatever their partitions.  Groups are counted first,
    so that only hashes low enough to matter, some OVERSHOOT * most a group, meet in the
    task that ranks them, however hot a group is.
    """
    order = F.xxhash64(F.lit(seed), F.col(key))
    counted = rows.groupBy(group).agg(F.count("*").alias("_rows"))
    low = F.pmod(order, F.lit(1 << 40)) < F.lit(float(OVERSHOOT * most << 40)) / F.col("_rows")
    rows = rows.select(key, group).join(counted, group).where(low)
    by_group = Window.partitionBy(group).orderBy("_order", key)
    ranked = (
        rows.select(key, group, F.pmod(order, F.lit(1 << 40)).alias("_order"))
        .withColumn("_rank", F.row_number().over(by_group))
        .where(F.col("_rank") <= most)
    )
    return ranked.orderBy("_rank", "_order", key).limit(most).select(key, group)
