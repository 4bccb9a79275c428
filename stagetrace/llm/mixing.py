"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key; each source is range-sorted by it; distributed
prefix sums of the token counts give each document its place in its source's epoch; and
the source is cut at its exact budget, after whole epochs where the budget exceeds it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stagetrace.llm.common import range_sorted, saved

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: A word is a run of anything but these blanks.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of the whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(key: Column, text: Column, seed: int) -> Column:
    """A random order that any engine can repeat: the start of a SHA-256 of key and text, so
    that rows with the same key, or none, are told apart, and spread."""
    parts = (F.coalesce(c.cast("string"), F.lit("")) for c in (key, text))
    return F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), *parts), 256), 1, 16)


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most_epochs: int = MOST_EPOCHS
) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row per source.

    Sources in the order of their code points, null last, have the weights in turn and
    share the sum of all sizes.  No target exceeds most_epochs times its source's size:
    with sources sorted by cap over weight, those before the first whose even share
    stays below its cap have just their caps, and the rest divide what is left.  The
    windows see one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long")
    named = sizes.withColumn("_weight", weight)
    cap = F.col("source_size") * most_epochs
    named = named.withColumn("_cap", cap).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    order = [F.col("_ratio"), F.col("source").isNull(), F.col("source")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = named.select(
        "*",
        F.row_number().over(Window.orderBy(*order)).alias("_k"),
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).alias("_left"),
        F.sum("_weight").over(onward).alias("_weights"),
    )
    free = F.col("_left") * F.col("_weight") <= F.col("_cap") * F.col("_weights")
    first = F.min_by(F.struct("_k", "_left", "_weights"), F.when(free, F.col("_k"))).over(everything)
    placed = placed.withColumn("_first", first)
    share = (F.col("_weight") * F.col("_first._left")).cast("double") / F.col("_first._weights")
    target = F.when(F.col("_k") < F.col("_first._k"), F.col("_cap").cast("double")).otherwise(share)
    return placed.select("source", "source_size", target.alias("target"))


def mixed(
    docs: DataFrame,
    size: Column,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    seed: int = 7,
    weights: Sequence[int] = WEIGHTS,
    most_epochs: int = MOST_EPOCHS,
) -> DataFrame:
    """A row per row of docs: key, source, size, source_size, target, taken.

    `taken` is the number of the document's tokens in the mix: its size for each whole
    epoch of its source, and for the last, partial one what lies before the cut, which
    falls inside a document if the budget does.  A source's taken tokens add up to the
    floor of its target.  A source's documents come in the order of a hash of key and text,
    then of the size, so that a rerun takes the same, however the rows are dealt.  Null keys
    and null sources are values of their own; a source without tokens has target 0; an empty
    table gives an empty result.
    """
    rows = saved(
        docs.select(
            F.col(key).alias(key),
            F.col(source).alias("source"),
            size.alias("size"),
            hash_key(F.col(key), F.col(text), seed).alias("_key"),
        ),
        "mix-sizes",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = saved(source_targets(sizes, weights, most_epochs), "mix-targets")
    placed = range_sorted(rows, ["source", "_key", key, "size"], "mix-sorted")
    # a row for each source in each range partition
    parts = placed.groupBy("_part", "source").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        F.col("_part").alias("_p"),
        F.col("source").alias("_s"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"),
    )
    within = Window.partitionBy("_part", "source").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(starts, (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s"))).drop("_p", "_s")
    of = targets.select(F.col("source").alias("_s"), "source_size", "target")
    placed = placed.join(of, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    left = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("_start") - F.col("_within")))
    return placed.select(
        key, "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken")
    )


def mix_documents(docs: DataFrame, size: Column | None = None, key: str = "doc_id", **options) -> DataFrame:
    """The documents of the mix, with their own columns: one row for each epoch that takes them.

    A document that the cut divides stays whole, so that a source exceeds its budget by
    less than one document.
    """
    size = word_count(F.col("text")) if size is None else size
    takes = mixed(docs, size, key, **options)
    # documents without words are neither scarce nor abundant: they stay once
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.ceil(F.col("taken") / F.col("size"))).cast("int")
    times = takes.groupBy(F.col(key).alias("_id")).agg(F.max(times).alias("_times")).where(F.col("_times") > 0)
    whole = docs.select(F.struct(*docs.columns).alias("_doc"))  # no name of docs can clash
    rows = whole.join(times, F.col(f"_doc.{key}").eqNullSafe(F.col("_id")))
    return rows.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_doc.*")
