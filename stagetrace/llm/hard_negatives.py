"""Hard negatives for contrastive training, scored by Kronecker-packed products.

Every component is a whole number.  The components of several candidates are biased so that
none is negative and laid into separated fields of one wide integer; one multiplication by an
anchor's component then serves all of them, and the sum over components holds their inner
products in the same fields.  The wide integers lie in doubles, which hold every whole number
below 2**53, so that the products run as one exact matrix product; components too large for
that are multiplied as integers of any length.

The anchors are a stated set of rows.  They are taken in blocks of bounded size, each of which
is sent to all tasks and meets every candidate where it lies: candidates are never shuffled.
A task keeps the best few candidates of each anchor, and these few are ranked by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stagetrace.llm.common import new_folder, numbered

POSITIVES = 5
NEGATIVES = 5
SCALE = 256
#: A negative's score lies between so many hundredths of the positive's score and all of it.
LEAST_PERCENT = 80
#: Bits of a wide integer that a double holds exactly.
WIDE = 53
#: Anchors in a block, and candidates scored at a time: bounds on a task's memory and on what
#: is sent to it.
ANCHORS = 4096
CANDIDATES = 2048
#: Stands for the id of a row without one, so that it comes last among equal scores.
NO_ID = (1 << 63) - 1

PAIR = "anchor long, slot int, score long, id long"
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable_rows(rows: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """(id, label, vector) of the rows with a label and a vector whose components are all finite."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    out = rows.select(
        F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), label.cast("long").alias("label"), x.alias("vector")
    )
    return out.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite.eqNullSafe(True))


def whole_components(vectors: pd.Series, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), dims))
    lengths = vectors.map(len).to_numpy()
    if len(vectors):
        out[np.arange(dims) < lengths[:, None]] = np.concatenate(vectors.to_list())
    return np.floor(scale * out)


class Packed:
    """Anchors ready to be multiplied with packed candidates."""

    def __init__(self, anchors: np.ndarray, largest: float):
        # a score lies in -spread .. spread, so that a field of a sum is below 2 * spread + 1
        self.bias = int(largest)
        self.spread = 2 * self.bias * max(1, int(np.abs(anchors).sum(axis=1).max(initial=0)))
        self.bits = (2 * self.spread + 1).bit_length()
        self.fields = WIDE // self.bits
        self.exact = self.fields > 0
        self.anchors = anchors if self.exact else whole(anchors)
        #: What the bias of the candidates adds to every field of an anchor's sum.
        self.added = self.bias * self.anchors.sum(axis=1)

    def scores(self, candidates: np.ndarray) -> np.ndarray:
        """Inner products of all anchors with all candidates."""
        n = len(candidates)
        if not self.exact:
            return self.anchors @ whole(candidates).T
        width = 1 << self.bits
        wide = np.zeros((-(-n // self.fields), candidates.shape[1]))
        for k in range(self.fields):
            part = candidates[k :: self.fields] + self.bias
            wide[: len(part)] += part * float(width**k)
        # a constant in each field keeps negative sums out of the next one
        lift = sum(self.spread * width**k for k in range(self.fields))
        sums = (self.anchors @ wide.T).astype(np.int64) + lift
        out = np.empty((len(self.anchors), n), dtype=np.int64)
        lost = (self.spread + self.added).astype(np.int64)[:, None]
        for k in range(self.fields):
            part = out[:, k :: self.fields]
            part[:] = ((sums >> (self.bits * k)) & (width - 1))[:, : part.shape[1]] - lost
        return out


def whole(x: np.ndarray) -> np.ndarray:
    """Integers of any length."""
    return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)


class Best:
    """The k best (score, id) of each group seen so far: higher scores first, then smaller ids."""

    def __init__(self, groups: int, k: int):
        self.k, self.groups = k, groups
        self.group = np.empty(0, dtype=np.int64)
        self.score, self.id = self.group.copy(), self.group.copy()
        #: Score from which a row may still come in; None lets all in.
        self.floor: np.ndarray | None = None

    def may_enter(self, scores: np.ndarray) -> np.ndarray:
        """Rows of scores are groups."""
        return np.ones(scores.shape, bool) if self.floor is None else scores >= self.floor[:, None]

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        group = np.concatenate([self.group, group])
        score = np.concatenate([self.score, score])
        ids = np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, group))
        group = group[order]
        first = np.searchsorted(group, np.arange(self.groups))
        rank = np.arange(len(group)) - first[group]
        kept = rank < self.k
        self.group, self.score, self.id = group[kept], score[order][kept], ids[order][kept]
        if (full := rank == self.k - 1).any():
            floor = np.full(self.groups, np.iinfo(np.int64).min)
            floor[group[full]] = score[order][full]
            self.floor = floor


@dataclass
class Block:
    """A bounded block of anchors; positives are known in the second pass only."""

    ids: np.ndarray
    labels: np.ndarray
    components: np.ndarray
    #: (anchors, positives) scores, and whether there is such a positive.
    positive: np.ndarray | None = None
    there: np.ndarray | None = None


def same_label(block: Block, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, best: Best) -> None:
    at = (block.labels[:, None] == labels) & (block.ids[:, None] != ids) & best.may_enter(scores)
    a, c = np.nonzero(at)
    best.add(a, scores[a, c], ids[c])


def in_window(block: Block, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, best: Best, least: int) -> None:
    """Candidates of other labels within the window of each positive; a group is a (anchor, positive)."""
    k = block.positive.shape[1]
    other = block.labels[:, None] != labels
    found = []
    for j in range(k):
        top = block.positive[:, j : j + 1]
        # whole numbers: least * top <= 100 * score, without a product that could overflow
        at = other & (scores <= top) & (scores >= -((-least * top) // 100)) & block.there[:, j : j + 1]
        if best.floor is not None:
            at &= scores >= best.floor[j::k][:, None]
        a, c = np.nonzero(at)
        found.append((a * k + j, scores[a, c], ids[c]))
    best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))


def best_pairs(candidates: DataFrame, block: Block, dims: int, largest: float, scale: int, k: int, least: int) -> DataFrame:
    """(anchor, slot, score, id): the k best candidates of every anchor, or of every positive of
    each once these are known; `anchor` is the anchor's place in the block."""
    session = candidates.sparkSession
    sent = session.sparkContext.broadcast(block)  # at most ANCHORS rows
    second = block.positive is not None
    slots = block.positive.shape[1] if second else 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = sent.value
        packed = Packed(anchors.components, largest)
        best = Best(len(anchors.ids) * slots, k)
        for frame in frames:
            for at in range(0, len(frame), CANDIDATES):
                part = frame.iloc[at : at + CANDIDATES]
                scores = packed.scores(whole_components(part["vector"], dims, scale))
                if scores.dtype == object:  # integers of any length: they must fit the result
                    if any(abs(x) > NO_ID >> 8 for x in scores.flat):
                        raise OverflowError("an inner product doesn't fit a long")
                    scores = scores.astype(np.int64)
                ids, labels = part["id"].to_numpy(), part["label"].to_numpy()
                if second:
                    in_window(anchors, scores, ids, labels, best, least)
                else:
                    same_label(anchors, scores, ids, labels, best)
        yield pd.DataFrame({"anchor": best.group // slots, "slot": best.group % slots, "score": best.score, "id": best.id})

    pairs = candidates.mapInPandas(run, PAIR)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def of_block(
    candidates: DataFrame, block: Block, dims: int, largest: float, scale: int, positives: int, negatives: int, least: int
) -> DataFrame:
    """The result rows of one block of anchors."""
    n = len(block.ids)
    shape = (n, positives)
    block.positive, block.there, named = None, None, np.zeros(shape, dtype=np.int64)
    score, there = np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=bool)
    # at most `positives` rows for each anchor of the block
    for r in best_pairs(candidates, block, dims, largest, scale, positives, least).collect():
        score[r.anchor, r.rank - 1], there[r.anchor, r.rank - 1], named[r.anchor, r.rank - 1] = r.score, True, r.id
    block.positive, block.there = score, there
    found = best_pairs(candidates, block, dims, largest, scale, negatives, least)
    a, j = np.nonzero(there)
    names = candidates.sparkSession.createDataFrame(
        pd.DataFrame({"anchor": a, "slot": j, "anchor_id": block.ids[a], "positive_id": named[a, j], "positive_score": score[a, j]}),
        "anchor long, slot int, anchor_id long, positive_id long, positive_score long",
    )
    # at most ANCHORS * positives names
    return found.join(F.broadcast(names), ["anchor", "slot"]).select(
        "anchor_id",
        F.nullif("positive_id", F.lit(NO_ID)).alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.nullif("id", F.lit(NO_ID)).alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    label: str | Column = "label",
    key: str = "vec_id",
    vector: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT,
    scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A component x counts as floor(scale * x).  Every row for which `anchors` holds is an anchor;
    its positives are the `positives` best other rows of its label, and each positive's negatives
    the `negatives` best rows of other labels that score at least `least_percent` hundredths of
    the positive and no more than it.  Higher inner products are better, then smaller keys.

    Rows with a null label, a null vector, or a null or non-finite component take no part.  Rows
    without a key are candidates, last among equal scores, and never anchors.  Rows that share
    an anchor's key aren't "other" rows to it; repeated rows count each.  Shorter vectors count
    as ending in zeros.  Other columns are ignored, whatever their names.  No anchors: no rows.
    An inner product beyond 2**55 is refused.
    """
    spark = rows.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    candidates = usable_rows(rows, key, vector, label)
    is_anchor = F.coalesce(anchors, F.lit(False)) & F.col(key).isNotNull()
    chosen = usable_rows(rows.where(is_anchor), key, vector, label)
    size = F.array_max(F.transform("vector", lambda v: F.abs(F.floor(v * scale).cast("double"))))
    seen = candidates.agg(F.max(size).alias("largest"), F.max(F.size("vector")).alias("dims")).first()
    dims, largest = seen["dims"] or 0, float(seen["largest"] or 0)
    placed = numbered(chosen, ["id", "label"], "_at", "anchors")
    count = placed.count()
    folder = new_folder(spark, "hard-negatives")
    spark.createDataFrame([], OUT).write.parquet(f"{folder}/empty")
    for start in range(0, count, ANCHORS):
        one = placed.where(F.col("_at").between(start, start + ANCHORS - 1)).toPandas()
        block = Block(one["id"].to_numpy(), one["label"].to_numpy(), whole_components(one["vector"], dims, scale))
        out = of_block(candidates, block, dims, largest, scale, positives, negatives, least_percent)
        out.write.parquet(f"{folder}/block-{start}")
    return spark.read.schema(OUT).parquet(f"{folder}/*")


def moved_label(key: str = "vec_id", label: str = "label") -> Column:
    """Every seventh row under the next of ten labels, as noisy labels to mine against."""
    return F.when(F.col(key) % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label))
