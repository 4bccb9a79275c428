"""Shards as the leaves of a k-d tree over metadata.

A node splits at the weighted median of its widest dimension (at the quantile that its
number of shards calls for, if that is odd), and the parts split again until a leaf is one
shard of the target bytes.  The cuts of all nodes of a level are found together: each round
sums a histogram of every node's weights on the executors and narrows the search to the
bin in which the cut falls.  The driver sees one row per node.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stagetrace.llm.common import numbered, saved

#: A node's histogram has 2 ** BITS bins.
BITS = 12
#: A cut may miss its target by this share of a shard.
TOLERANCE = 0.005
#: Rows alike in everything are parted only if they weigh more than this share of a shard;
#: a cut beside them misses its target by half of it at most.
ALIKE = 0.05
#: Steps of a dimension, and the bits below them that order rows alike in it.
STEPS = (1 << 30) - 1
TIE_BITS = 32
KEY_BITS = 62


@dataclass
class Cut:
    """The search for a node's cut: its key lies in low .. low + 2 ** bits - 1; `before` is
    the weight of the node's rows that are known to lie below.

    Rows go left if their key on `dim` is below `low`, or equals `at` with a tie key below
    `low` once ties must be divided (`at` >= 0).
    """

    node: int
    right: int
    dim: int
    target: float
    before: int = 0
    low: int = 0
    bits: int = KEY_BITS
    at: int = -1
    settled: bool = False

    @property
    def shift(self) -> int:
        return max(0, self.bits - BITS)

    def row(self) -> tuple:
        high = min(self.low + (1 << self.bits), 1 << KEY_BITS) - 1
        return self.node, self.right, self.dim, self.at, self.low, high, self.shift, float(self.target - self.before)

    def narrow(self, found: Row, slack: float, alike: float) -> None:
        """Go on in the bin that holds the target: its rows, their keys' ends, their weight
        and the weight below.  Settle if one of its ends is near enough, or if there is but
        one row, or rows of one key of no more weight than `alike`, to put on either side."""
        miss = self.target - self.before - (found["cum"] - found["sum"])
        over = found["sum"] - miss
        self.before += found["cum"] - found["sum"]
        self.low, one_key = found["low"], found["low"] == found["high"]
        whole = one_key and (self.at >= 0 or found["sum"] <= alike)
        if min(abs(miss), abs(over)) <= slack or found["n"] == 1 or whole:
            self.low = found["high"] + 1 if abs(over) < abs(miss) else found["low"]
            self.settled = True
        elif one_key:  # too heavy: divide the rows that share it
            self.at, self.low, self.bits = self.low, 0, KEY_BITS
        else:
            self.bits = (found["high"] - found["low"]).bit_length()


def _table(spark: SparkSession, cuts: list[Cut]) -> DataFrame:
    """At most one row per shard, as literals: no job runs to make it."""
    rows = ", ".join("({}, {}, {}, {}L, {}L, {}L, {}, {!r}D)".format(*c.row()) for c in cuts)
    names = "_node, _right, _dim, _at, _low, _high, _shift, _target"
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {rows} AS cuts({names})"))


def _round(rows: DataFrame, cuts: list[Cut], slack: float, alike: float) -> None:
    key = F.element_at("_keys", F.col("_dim"))
    # the node's rows, or those that share the key to be divided
    own = F.when(F.col("_at") < 0, key).when(key == F.col("_at"), F.col("_tie"))
    bins = (
        rows.join(_table(rows.sparkSession, cuts), "_node")
        .withColumn("_own", own)
        .where(F.col("_own").between(F.col("_low"), F.col("_high")))
        .groupBy("_node", F.expr("shiftright(_own - _low, _shift)").alias("_bin"))
        .agg(
            F.sum("size").alias("sum"),
            F.count("*").alias("n"),
            F.min("_own").alias("low"),
            F.max("_own").alias("high"),
            F.first("_target").alias("_target"),
        )
    )
    upto = Window.partitionBy("_node").orderBy("_bin")  # at most 2 ** BITS rows
    cum = bins.withColumn("cum", F.sum("sum").over(upto))
    last = F.max("_bin").over(Window.partitionBy("_node"))
    holds = cum.withColumn("_holds", (F.col("cum") >= F.col("_target")) | (F.col("_bin") == last)).where("_holds")
    hit = holds.groupBy("_node").agg(F.min_by(F.struct("cum", "sum", "n", "low", "high"), "_bin").alias("hit"))
    by_node = {r["_node"]: r["hit"] for r in hit.collect()}
    for cut in cuts:
        cut.narrow(by_node[cut.node], slack, alike)


def _split(rows: DataFrame, cuts: list[Cut]) -> DataFrame:
    """Rows with the node they fall into."""
    key = F.element_at("_keys", F.col("_dim"))
    by_key = F.when(F.col("_at") < 0, key < F.col("_low"))
    by_tie = (key < F.col("_at")) | ((key == F.col("_at")) & (F.col("_tie") < F.col("_low")))
    left = F.coalesce(by_key, by_tie)
    node = F.when(F.col("_right").isNull() | left, F.col("_node")).otherwise(F.col("_right"))
    joined = rows.join(_table(rows.sparkSession, cuts), "_node", "left")
    return joined.withColumn("_node", node).select(*rows.columns)


def text_metadata(text: Column) -> dict[str, Column]:
    """Dimensions that tell texts of different kinds apart: length, script and layout.

    All are functions of the text, so that equal texts are alike in them.
    """
    chars, octets = F.length(text), F.octet_length(text)
    lines = octets - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return {
        "log_chars": F.log2(chars + 1),
        # from 1 for plain ASCII to 4
        "bytes_a_char": F.when(chars > 0, octets / chars).otherwise(1.0),
        "log_lines": F.log2(lines + 1),
    }


def kd_shards(
    docs: DataFrame,
    size: Column,
    dims: Mapping[str, Column],
    group: Column,
    shards: int | None = None,
    target_bytes: int | None = None,
    key: str = "doc_id",
) -> DataFrame:
    """A row per row of docs: key, size, group, the dimensions, shard.

    `size` (above 0) is what the shards balance, `dims` the numeric dimensions; a null
    coordinate is the smallest.  Rows alike in all dimensions and in `group` are parted
    only if their weight alone is more than the share ALIKE of a shard.
    The number of shards is given, or follows from target_bytes.  An empty table gives an
    empty result; rows that share a key, or have none, are rows of their own.
    """
    rows = saved(
        docs.select(
            F.col(key).alias(key),
            size.cast("long").alias("size"),
            group.alias("group"),
            *(c.cast("double").alias(f"dim_{n}") for n, c in dims.items()),
        ),
        "shard-rows",
    )
    names = [f"dim_{n}" for n in dims]
    ends = rows.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("all"),
        *(f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)),
    ).first()
    shards = shards or max(1, -(-ends["all"] // target_bytes))
    slack = TOLERANCE * ends["all"] / shards
    steps = []
    for n in names:
        low, high = ends[f"min_{n}"], ends[f"max_{n}"]
        scale = STEPS / (high - low) if low is not None and high > low else 0.0
        steps.append(F.coalesce(F.floor((F.col(n) - F.lit(low)) * F.lit(scale)), F.lit(0)).cast("long"))
    alike = F.pmod(F.xxhash64("group"), F.lit(1 << TIE_BITS))
    placed = rows.select(
        "*",
        F.lit(0).alias("_node"),
        F.array(*(F.shiftleft(s, TIE_BITS) + alike for s in steps)).alias("_keys"),
        F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit("tie")), 64 - KEY_BITS).alias("_tie"),
    )
    leaves = {0: shards} if ends["all"] else {}
    while open_ := [n for n, k in leaves.items() if k > 1]:
        stats = (
            placed.where(F.col("_node").isin(open_) if len(open_) < len(leaves) else F.lit(True))
            .groupBy("_node")
            .agg(
                F.sum("size").alias("_sum"),
                *(f(F.element_at("_keys", i + 1)).alias(f"_{f.__name__}{i}") for i in range(len(names)) for f in (F.min, F.max)),
            )
            .collect()
        )
        cuts = []
        for s in stats:
            k = leaves[s["_node"]]
            widths = [s[f"_max{i}"] - s[f"_min{i}"] for i in range(len(names))]
            dim = widths.index(max(widths))
            cut = Cut(s["_node"], s["_node"] + k // 2, dim + 1, s["_sum"] * (k // 2) / k)
            cut.low, cut.bits = s[f"_min{dim}"], widths[dim].bit_length()
            cuts.append(cut)
        while todo := [c for c in cuts if not c.settled]:
            _round(placed, todo, slack, ALIKE * ends["all"] / shards)
        placed = _split(placed, cuts)
        with_rows = {c.node for c in cuts}
        for node in open_:
            k = leaves.pop(node)
            if node in with_rows:  # a node without rows leaves its shards empty
                leaves |= {node: k // 2, node + k // 2: k - k // 2}
    return placed.select(key, "size", "group", *names, F.col("_node").alias("shard"))


def with_slots(rows: DataFrame, shard: str, by: list[str]) -> DataFrame:
    """Rows with `slot`, their gapless place in their shard from 0, in the order of `by`."""
    placed = numbered(rows, [shard, *by], "_at", "slots")
    # a row per shard
    starts = placed.groupBy(F.col(shard).alias("_shard")).agg(F.min("_at").alias("_first"))
    placed = placed.join(F.broadcast(starts), F.col(shard) == F.col("_shard"))
    return placed.withColumn("slot", F.col("_at") - F.col("_first")).drop("_at", "_shard", "_first")
