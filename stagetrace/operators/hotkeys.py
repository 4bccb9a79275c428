"""A left join that stays even when a few keys hold much of the right side.

Spark's adaptive execution can split an oversized left partition of a left join,
but not a right one.  Keys with very many right rows are therefore salted: their
right rows are dealt over several slots by a hash of the row, and the few left
rows of such a key are copied to every slot.  Left rows without a key match
nothing; they are dealt over slots of their own instead of meeting in one task.

Building the join reads none of its rows.  Which keys can be hot is either known
from a profile, a small table with a mergeable sketch of the heaviest keys for
each day, or found inside the join itself, by counting hash buckets first.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Plan parameters; rows never depend on them.
# Right rows of one key from which it counts as hot; also the rows of one slot.
HOT_ROWS = 500_000
# Heaviest keys looked at in a profile, and keys tracked by a day's sketch, which is
# about a megabyte.  A key that a sketch can miss holds less than a four-thousandth of
# the day's rows, which is about a partition of a large job.
CANDIDATES = 4_096
TRACKED = 16_384
# Hash buckets counted where there is no profile; only buckets with HOT_ROWS rows
# can hold a hot key.
BUCKETS = 1 << 18
# Slots over which rows without a key are dealt.
KEYLESS_SLOTS = 4096


@dataclass(frozen=True)
class Band:
    """Left and right columns with days that must not be further apart."""

    left: str
    right: str
    days: int

    def holds(self, right_day: Column) -> Column:
        return F.abs(F.date_diff(F.col(self.left), right_day)) <= self.days


def _name(keys: Sequence[str]) -> Column:
    return F.to_json(F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys))))


def key_profile(rows: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """(day, rows, sketch): how many rows have all keys, and a sketch of the heaviest.

    Made when a day's rows are loaded, and kept; profiles of several loads of a
    day are rows of their own.  Sketches merge on the map side, so no key is
    shuffled to be counted.
    """
    sketch = F.call_function("approx_top_k_accumulate", F.col("_name"), F.lit(TRACKED))
    named = rows.where(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    named = named.select(F.col(day).alias("day"), _name(keys).alias("_name"))
    return named.groupBy("day").agg(F.count("*").alias("rows"), sketch.alias("sketch"))


def heavy_names(
    profile: DataFrame, hot_rows: int, first: dt.date | None = None, last: dt.date | None = None
) -> list[str]:
    """Names of the keys that may be hot on these days, at most CANDIDATES.

    Reads the profile alone, a row for each load of a day.
    """
    if first is not None:
        profile = profile.where(F.col("day") >= F.lit(first))
    if last is not None:
        profile = profile.where(F.col("day") <= F.lit(last))
    merged = F.call_function("approx_top_k_combine", F.col("sketch"), F.lit(TRACKED))
    heaviest = F.call_function("approx_top_k_estimate", F.col("_sketch"), F.lit(CANDIDATES))
    # grouped, so that no row of the profile gives no row here
    found = (
        profile.groupBy(F.lit(0).alias("_all"))
        .agg(F.sum("rows").alias("_rows"), merged.alias("_sketch"))
        .where(F.col("_rows") >= hot_rows)
        .select(heaviest.alias("_top"))
        .first()
    )
    return [] if found is None else [x["item"] for x in found["_top"] if x["count"] >= hot_rows]


def _suspects(narrow: DataFrame, named: Sequence[str], hot_rows: int, names: Sequence[str] | None) -> DataFrame:
    """The rows whose key may be hot: by name, or by the size of their hash bucket."""
    if names is None:
        bucket = F.pmod(F.xxhash64(*named), F.lit(BUCKETS)).cast("int")
        narrow = narrow.withColumn("_bucket", bucket)
        # at most BUCKETS rows
        large = narrow.groupBy("_bucket").agg(F.count("*").alias("_n")).where(F.col("_n") >= hot_rows)
        return narrow.join(F.broadcast(large.select("_bucket")), "_bucket", "left_semi")
    # at most CANDIDATES names
    listed = narrow.sparkSession.createDataFrame([(n,) for n in names], "_name string")
    return narrow.withColumn("_name", _name(named)).join(F.broadcast(listed), "_name", "left_semi")


def hot_keys(
    right: DataFrame,
    keys: Sequence[str],
    hot_rows: int,
    names: Sequence[str] | None = None,
    named: Sequence[str] | None = None,
    day: str | None = None,
) -> DataFrame:
    """The hot right keys with the slots each needs, and the days of their rows.

    Lazy and exact: whatever evaluates it gets the same keys.  `names` are keys
    that may be hot, by the columns `named` of the keys; without them the hash
    buckets are counted.  At most one key in `hot_rows` right rows.
    """
    named = list(named or keys)
    narrow = right.select(*keys, *([day] if day and day not in keys else []))
    days = F.collect_set(day) if day else F.lit(None)
    return (
        _suspects(narrow, named, hot_rows, names)
        .groupBy(*keys)
        .agg(F.count("*").alias("_n"), days.alias("_days"))
        .where(F.col("_n") >= hot_rows)
        .select(*keys, "_n", F.ceil(F.col("_n") / hot_rows).cast("int").alias("_slots"), "_days")
    )


def left_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[tuple[str, str]],
    left_row: Sequence[str],
    right_row: Sequence[str],
    hot_rows: int | None = HOT_ROWS,
    keyless: Column | None = None,
    band: Band | None = None,
    names: Sequence[str] | None = None,
    named: int | None = None,
) -> DataFrame:
    """`left LEFT JOIN right` on equal keys; right key columns are dropped.

    `keys` pairs left with right column names.  `left_row` and `right_row` name
    columns whose hash deals rows over slots.  `keyless` marks further left rows
    that match nothing.  `band` is a further condition on days; its right column
    is dropped, too.  `names` are the names that heavy_names() found, by the first
    `named` keys; without hot names, or without `hot_rows`, nothing is salted.
    Without a `left_row` either, the keys alone join, as sides that are stored by
    them need it.
    """
    right_keys = [f"_key{i}" for i in range(len(keys))]
    for (_, name), renamed in zip(keys, right_keys):
        right = right.withColumnRenamed(name, renamed)
    right = right.where(reduce(and_, [F.col(k).isNotNull() for k in right_keys]))
    on: list[Column] = [F.col(a) == F.col(b) for (a, _), b in zip(keys, right_keys)]
    if band is not None:
        on.append(band.holds(F.col(band.right)))
    nothing = reduce(or_, [F.col(a).isNull() for a, _ in keys])
    if keyless is not None:
        nothing = nothing | F.coalesce(keyless, F.lit(False))
    extra = [*right_keys, *([band.right] if band else [])]
    salted = hot_rows is not None and names != []
    if not salted and not left_row:
        return left.join(right, reduce(and_, on), "left").drop(*extra)
    own_slot = (-1 - F.pmod(F.xxhash64(*left_row), F.lit(KEYLESS_SLOTS))).cast("int")
    on.append(F.col("_left_slot") == F.col("_right_slot"))
    extra += ["_left_slot", "_right_slot"]
    if not salted:
        left = left.withColumn("_left_slot", F.when(nothing, own_slot).otherwise(F.lit(0)))
        # always 0, but no constant, which would leave the slot out of the shuffle
        zero = F.pmod(F.xxhash64(*right_row), F.lit(1)).cast("int")
        right = right.withColumn("_right_slot", zero)
        return left.join(right, reduce(and_, on), "left").drop(*extra)

    day = band.right if band else None
    hot = hot_keys(right, right_keys, hot_rows, names, right_keys[:named], day)
    # at most one key in hot_rows rows
    hot = F.broadcast(hot)
    right = right.withColumn("_hit", F.lit(True))
    dealt = F.pmod(F.xxhash64(*right_row), F.col("_slots")).cast("int")
    right = right.join(hot, right_keys, "left").select(
        *right.columns, F.coalesce(dealt, F.lit(0)).alias("_right_slot")
    )
    marks = hot.select(
        *(F.col(k).alias(f"_hot{i}") for i, k in enumerate(right_keys)),
        F.col("_slots").alias("_copies"),
        F.col("_days").alias("_hot_days"),
    )
    # a row is copied only if it has a partner in some slot
    copied = F.col("_copies").isNotNull()
    if band is not None:
        copied = copied & F.exists("_hot_days", band.holds)
    slots = (
        F.when(copied, F.sequence(F.lit(0), F.col("_copies") - 1))
        .when(nothing, F.array(own_slot))
        .otherwise(F.array(F.lit(0)))
    )
    is_hot = [F.col(a) == F.col(f"_hot{i}") for i, (a, _) in enumerate(keys)]
    left = left.join(marks, reduce(and_, is_hot), "left").select(
        *left.columns, copied.alias("_copied"), F.explode(slots).alias("_left_slot")
    )
    joined = left.join(right, reduce(and_, on), "left")
    # the partnerless copies of a copied row are dropped
    return joined.where(~F.col("_copied") | F.col("_hit").isNotNull()).drop(
        "_hit", "_copied", *extra
    )
