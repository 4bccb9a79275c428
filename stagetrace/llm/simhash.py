"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at up to TAU differing bits.  The bits are grouped, correlated
ones together, into partitions; if the thresholds of the partitions add up to TAU less
their number plus 1, any linked pair is within the threshold of at least one partition.
Dynamic programming picks the thresholds, from -1 (not probed) up, by the candidates that
the counts of all fingerprints let expect.  Every fingerprint probes the keys within its
partitions' thresholds; what meets is verified on all bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagetrace.llm.common import saved

WORDS = 4
TAU = 4
BITS = 64
#: Numbers of partitions to weigh against each other.
PARTITIONS = (3, 4, 5)
#: What a probe costs, as a row that is shuffled, in verified candidates.
PROBE_COST = 1000.0
#: Fingerprints of a key that a task compares with each other; larger groups meet in midpoints.
MOST_IN_TASK = 16384
#: Rows a task compares at once.
CHUNK = 100_000


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Bits set in over half the hashes of the text's shingles, repetitions included."""
    # bytes.lower() and bytes.split() know just the ASCII letters and blanks
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(parts) > words:
        starts, ends = starts[: 1 - words], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    counts = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), 65536):
        spans = zip(starts[at : at + 65536].tolist(), ends[at : at + 65536].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, fp) of every row of docs; a text without words has fingerprint 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"key": frame["key"], "fp": [fingerprint(t, words) for t in frame["text"]]})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"key {kind}, fp long").withColumnRenamed("key", key)


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return signed(sum(1 << b for b in self.bits))

    def flips(self) -> list[int]:
        """What turns a fingerprint into each probe: all ways to flip up to `threshold` bits."""
        return [signed(sum(1 << b for b in c)) for k in range(self.threshold + 1) for c in combinations(self.bits, k)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def bit_correlation(fps: DataFrame) -> np.ndarray:
    """|correlation| of each pair of bits over all fingerprints; 64 x 64 sums a task."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, n = np.zeros((BITS, BITS)), 0
        for frame in frames:
            raw = frame["fp"].to_numpy(dtype="<i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        yield pd.DataFrame({"cell": np.arange(BITS * BITS + 1), "n": [*both.ravel(), float(n)]})

    rows = fps.select("fp").mapInPandas(sums, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r["cell"]] = r["n"]
    n = max(flat[-1], 1.0)
    both = flat[:-1].reshape(BITS, BITS) / n
    p = np.diag(both)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((both - np.outer(p, p)) / np.outer(spread, spread))


def group_bits(correlation: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Bits in `parts` groups of nearly equal size; each grows by the bit most correlated with it."""
    left, groups = set(range(BITS)), []
    for i in range(parts):
        size = len(left) // (parts - i)
        rest = sorted(left)
        near = correlation[np.ix_(rest, rest)].sum(axis=1)
        group = [rest[int(near.argmax())]]
        left -= set(group)
        while len(group) < size:
            rest = sorted(left)
            group.append(rest[int(correlation[np.ix_(rest, group)].sum(axis=1).argmax())])
            left.remove(group[-1])
        groups.append(tuple(sorted(group)))
    return groups


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds -1, 0, 1, ... for each partition that add up to `total` at the least cost;
    costs[i][t + 1] is the cost of threshold t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for t, more in enumerate(own, start=-1):
                if s + t not in step or c + more < step[s + t][0]:
                    step[s + t] = (c + more, [*chosen, t])
        best = step
    return best[total]


def choose_parts(fps: DataFrame, tau: int = TAU) -> list[Part]:
    """Partition and thresholds of least cost: probes to shuffle and candidates to verify,
    by the exact counts of all fingerprints' keys."""
    correlation = bit_correlation(fps)
    groups = {m: group_bits(correlation, m) for m in PARTITIONS if m <= tau + 1}
    masks = {(m, i): signed(sum(1 << b for b in g)) for m, gs in groups.items() for i, g in enumerate(gs)}
    keys = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(x)).alias("k")) for (m, i), x in masks.items())))
    met = fps.select(keys.alias("key")).groupBy("key").count()
    met = met.groupBy("key.m", "key.i").agg(F.sum("count").alias("n"), F.sum(F.col("count").cast("double") ** 2).alias("pairs"))
    pairs = {(r["m"], r["i"]): (r["n"], r["pairs"] - r["n"]) for r in met.collect()}
    best = None
    for m, gs in groups.items():
        costs = []
        for i, g in enumerate(gs):
            n, met_ = pairs.get((m, i), (1, 0.0))
            probes = [sum(math.comb(len(g), k) for k in range(t + 1)) for t in range(tau + 1)]
            costs.append([0.0, *(p * (PROBE_COST * n + met_ + n * n / 2.0 ** len(g)) for p in probes)])
        cost, chosen = allocate(costs, tau - m + 1)
        if best is None or cost < best[0]:
            best = (cost, [Part(g, t) for g, t in zip(gs, chosen, strict=True) if t >= 0])
    return best[1]


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))  # of signed numbers it would count the absolute value's


def _forest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> None:
    """Lower the labels (places of the component's least member so far) by the links a-b."""
    while True:
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            return
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label[:] = label[label]


def links_within(group: np.ndarray, fp: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join just what is joined by all pairs of a group within tau bits.

    Rows of a group stand together.  Row i is compared with row i + 1, then i + 2, and so
    on as far as the groups reach; components are kept, not pairs.
    """
    label = np.arange(len(fp))
    new = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, len(fp)])
    left = np.repeat(starts + sizes, sizes) - np.arange(len(fp))  # rows from here to the group's end
    at, d = np.arange(len(fp)), 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    while len(at := at[left[at] > d]):
        hit = at[_popcount(fp[at] ^ fp[at + d]) <= tau]
        found.append((hit, hit + d))
        held += len(hit)
        if held > 500_000:
            _forest(*map(np.concatenate, zip(*found, strict=True)), label)
            found, held = [], 0
        d += 1
    if found:
        _forest(*map(np.concatenate, zip(*found, strict=True)), label)
    i = np.flatnonzero(label != np.arange(len(fp)))
    return fp[i], fp[label[i]]


def _compare(frames: Iterator[pd.DataFrame], tau: int) -> Iterator[pd.DataFrame]:
    """Links of whole groups; rows come sorted by (part, probe)."""
    held: list[pd.DataFrame] = []
    rows = 0

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        part, probe = frame["part"].to_numpy(), frame["probe"].to_numpy()
        new = np.r_[True, (part[1:] != part[:-1]) | (probe[1:] != probe[:-1])]
        a, b = links_within(np.cumsum(new), frame["fp"].to_numpy(dtype=np.int64), tau)
        return pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    for frame in frames:
        held.append(frame)
        rows += len(frame)
        if rows >= CHUNK:
            frame = pd.concat(held, ignore_index=True)
            last = frame.iloc[-1]
            cut = int(((frame["part"] != last["part"]) | (frame["probe"] != last["probe"])).to_numpy().sum())
            if cut:
                yield links(frame.iloc[:cut])
            held, rows = [frame.iloc[cut:]], len(frame) - cut
    if rows:
        yield links(pd.concat(held, ignore_index=True))


def links(fps: DataFrame, tau: int = TAU, parts: list[Part] | None = None, most: int = MOST_IN_TASK) -> DataFrame:
    """(a, b): links between fingerprints within tau bits, enough of them to join whatever
    any links join.  fps has distinct `fp`."""
    parts = choose_parts(fps, tau) if parts is None else parts
    probes = []
    for i, part in enumerate(parts):
        masked = F.col("fp").bitwiseAND(F.lit(part.mask))
        probes += [F.struct(F.lit(i).alias("part"), masked.bitwiseXOR(F.lit(x)).alias("probe")) for x in part.flips()]
    rows = fps.select("fp", F.explode(F.array(*probes)).alias("p")).select("p.part", "p.probe", "fp")
    counts = rows.groupBy("part", "probe").count()
    large = saved(counts.where(F.col("count") > most).select("part", "probe"), "large-keys")
    small = rows.join(large, ["part", "probe"], "left_anti")
    small = small.repartition("part", "probe").sortWithinPartitions("part", "probe")
    near = small.mapInPandas(lambda frames: _compare(frames, tau), "a long, b long")
    crowded = rows.join(large, ["part", "probe"])
    return near.unionByName(_by_midpoints(crowded, parts, tau))


def _by_midpoints(rows: DataFrame, parts: list[Part], tau: int) -> DataFrame:
    """Links in groups too large to compare in a task, in linear work.

    Two fingerprints differ in at most tau bits just if some midpoint is within half of
    that of both (rounded up for one of them); so each is linked with the least that has
    a midpoint in common with it.
    """
    half = (tau + 1) // 2
    flips = [signed(sum(1 << b for b in c)) for k in range(half + 1) for c in combinations(range(BITS), k)]
    if tau % 2:
        raise ValueError("midpoints need an even threshold")
    mid = F.explode(F.transform(F.array(*map(F.lit, flips)), lambda x: F.col("fp").bitwiseXOR(x)))
    points = rows.select("fp").distinct().select("fp", mid.alias("mid"))
    least = points.groupBy("mid").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
    return points.join(least, "mid").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): the least node it is connected to.

    Large-star and small-star steps in turn, until nothing moves; each is an aggregation
    and a join on nodes, and a saved table.
    """
    up, down = F.greatest("a", "b"), F.least("a", "b")
    edges = saved(edges.where("a <> b").select(up.alias("a"), down.alias("b")).distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = state(edges)
    while True:
        # large-star: all larger neighbours of a node go to the least of its neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = saved(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")), "stars")
        moved = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        moved = saved(moved.where("a <> b").distinct(), "edges")
        # small-star: a node and its smaller neighbours go to the least of these
        low = saved(moved.groupBy("a").agg(F.min("b").alias("low")), "stars")
        near = moved.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = saved(near.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "edges")
        last, now = now, state(edges)
        if now == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, tau: int = TAU
) -> DataFrame:
    """A row per row of docs: key, fp, component_id.

    component_id is the least key that links of up to tau bits lead to, the row's own
    included; null keys only count where there is no other.  Null, empty and blank texts
    have fingerprint 0, and link like any other.  Rows that share a fingerprint are one
    node, however many they are.  An empty table gives an empty result; further columns
    are not looked at.
    """
    rows = saved(fingerprints(docs, key, text, words), "fingerprints")
    fps = saved(rows.groupBy("fp").agg(F.min(key).alias("_least")), "distinct-fingerprints")
    roots = saved(components(links(fps.select("fp"), tau)), "roots")
    named = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "_least", F.coalesce("root", "fp").alias("_root"))
    named = saved(named, "rooted")
    least = named.groupBy("_root").agg(F.min("_least").alias("component_id"))
    # saved, so that a join with a very common fingerprint can split its rows
    named = saved(named.join(least, "_root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select(key, "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, tau: int = TAU) -> DataFrame:
    """One row of docs for each component, with its own columns.

    The row with the least key stays, null keys last; of rows with that key the one whose
    text has the least hash, and one of rows that are alike.  Null, empty and blank texts
    are one component with all others of fingerprint 0.  Columns of any name are kept; an
    empty table stays empty.

    Rows are saved with a number, so that rows with the same key or none are told apart; only
    the numbers of the rows that go meet the documents again.
    """
    number = F.monotonically_increasing_id()
    rows = saved(docs.select(F.struct("*").alias("doc"), number.alias("row")), "numbered-documents", "zstd")
    name, body = F.col("doc")[key], F.col("doc")[text]
    found = near_duplicates(rows.select("row", body.alias("text")), "row", "text", words, tau)
    order = F.struct(name.isNull().alias("unnamed"), name.alias("key"), F.xxhash64(body).alias("hash"), "row")
    members = found.select("row", "component_id").join(rows.select("row", order.alias("order")), "row")
    members = saved(members, "members")
    first = members.groupBy("component_id").agg(F.min("order").alias("first")).select(F.col("first")["row"].alias("row"))
    gone = saved(members.select("row").join(first, "row", "left_anti"), "near-copies")
    return rows.join(gone, "row", "left_anti").select("doc.*")
