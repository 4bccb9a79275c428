"""Exact deduplication with a split of heavy hitters.

Misra-Gries summaries of the tasks find digests that may be frequent; they are counted
exactly, and the verified winners are broadcast, so that rows of frequent texts meet their
group without a shuffle.  All other digests take an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stagetrace.llm.common import saved, without

#: Counters of a task's summary.
COUNTERS = 4096


def misra_gries(batches: Iterator[pd.Series], counters: int) -> pd.Series:
    """Counts of at most `counters` values, each too low by at most n / (counters + 1).

    A batch is added with its exact counts; then the (counters + 1)-th largest count is
    taken from all, and what is not positive goes.
    """
    kept = pd.Series(dtype="int64")
    for batch in batches:
        kept = kept.add(batch.value_counts(), fill_value=0).astype("int64")
        if len(kept) > counters:
            kept -= kept.nlargest(counters + 1).iloc[-1]
            kept = kept[kept > 0]
    return kept


def frequent(digests: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """Values that may fill more than 1 / counters of all rows; at most `counters` of them.

    The summaries are added up.  A value's sum is at most its true count and at least that
    less n / (counters + 1), so a value of more than 2 n / counters rows is always found,
    and as the sums add up to n at most, no more than `counters` values reach n / counters.
    """

    def summary(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = misra_gries((f[column] for f in frames), counters)
        yield pd.DataFrame({column: found.index.astype(object), "_n": found.to_numpy()})

    kind = digests.schema[column].dataType.simpleString()
    total = digests.select(F.count(column).alias("_total"))
    sums = (
        digests.select(column)
        .where(F.col(column).isNotNull())
        .mapInPandas(summary, f"{column} {kind}, _n long")
        .groupBy(column)
        .agg(F.sum("_n").alias("_n"))
    )
    # a single row
    sums = sums.crossJoin(F.broadcast(total))
    return sums.where((F.col("_n") > 1) & (F.col("_n") * counters >= F.col("_total"))).select(column)


def duplicate_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """A row per row of docs: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty.  Of equal texts the row with the
    largest key stays, null being the smallest; of rows alike in both, any one stays, but
    only one.  An empty table gives an empty result; further columns are not looked at.
    """
    rows = saved(
        docs.select(
            F.col(key).alias(key),
            F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "digests",
    )
    groups = (F.max(F.struct(key, "_row")).alias("_keep"), F.count("*").alias("group_size"))
    # at most `counters` rows, here and in the winners made of them
    heavy = saved(frequent(rows, "text_sha256", counters), "frequent")
    winners = saved(
        rows.join(F.broadcast(heavy), "text_sha256").groupBy("text_sha256").agg(*groups), "winners"
    )
    light = rows.join(F.broadcast(heavy), "text_sha256", "left_anti")
    met = rows.join(F.broadcast(winners), "text_sha256").unionByName(
        light.join(light.groupBy("text_sha256").agg(*groups), "text_sha256")
    )
    return met.select(
        key,
        F.col(f"_keep.{key}").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_keep._row")).alias("kept"),
        "text_sha256",
    )


def exact_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """The rows of docs that stay, with their own columns.

    Rows that share both key and text are thinned to one; which of them is settled by
    their other columns.
    """
    groups = saved(duplicate_groups(docs, key, text, counters), "groups")
    lost = groups.where(~F.col("kept"))
    # a key may be lost only because its row is there twice
    stays = groups.where("kept").select(F.col(key).alias("_kept"))
    twice = lost.join(stays, F.col(key).eqNullSafe(F.col("_kept")), "left_semi")
    plain = without(docs, lost.select(key), key)
    again = twice.select(F.col(key).alias("_twice")).distinct()
    winners = groups.where("kept").select(F.col(key).alias("_id"), F.col("text_sha256").alias("_sha"))
    whole = docs.select(F.struct(*docs.columns).alias("_doc"))  # no name of docs can clash
    one = F.col(f"_doc.{key}")
    sha = F.sha2(F.coalesce(F.col(f"_doc.{text}"), F.lit("")), 256)
    # the least of the rows alike in key and text, by their other columns
    rank = Window.partitionBy("_key", "_digest").orderBy("_doc")
    repeated = (
        whole.join(again, one.eqNullSafe(F.col("_twice")), "left_semi")
        .withColumns({"_key": one, "_digest": sha})
        .join(winners, one.eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_sha")), "left_semi")
        .withColumn("_rank", F.row_number().over(rank))
        .where("_rank = 1")
        .select("_doc.*")
    )
    return plain.unionByName(repeated)
