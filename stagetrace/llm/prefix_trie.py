"""The trie of all conversations' prefixes, as a row for each node.

A turn becomes a digest of its role and text with its length, so that texts are never
shuffled; a conversation becomes the concatenation of its turns' digests.  Conversations are
range-partitioned by that path.  A task holds one range as padded matrices of turn ids, sorts
them by columns, and marks where a column differs from the row above: accumulated over the
columns by OR, the marks are the first rows of the nodes of every depth, and reduceat
aggregates them.

Only nodes on the path of a range's first or last conversation may go on in another range.
Their parts, a few for each range, are added up by a digest of their prefix, and one pass in
the order of the trie carries the sums of subtrees upwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagetrace.llm.common import saved

#: Conversations rebuilt on one beginning, and the turns of it they take, at most one less.
FAMILY = 100
HEADS = 6
#: Bytes of a turn in a path: digest and length.
DIGEST, RECORD = 16, 24
#: Turns of a range: what one task holds, and what is worth a task of its own.
MOST_TURNS, LEAST_TURNS = 1 << 20, 1 << 12
#: Columns of a padded matrix; longer conversations go on in the next one.
SLAB = 32
#: Ids in a row of an open node's ends.
CHUNK = 1024

NODE = (
    "kind string, key binary, parent_key binary, shard int, at long, depth long, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, ends_sha256 string, ids binary"
)
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_record(role, text):
    """The digest of a turn and its length in code points, as hexadecimal text."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    return F.concat(digest, F.lower(F.lpad(F.hex(F.length(text).cast("long")), 2 * (RECORD - DIGEST), "0")))


def rebuilt_paths(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, path): each conversation with the beginning that its family shares.

    Conversation c starts with the first h turns of conversation c - c % FAMILY, as far as
    there are so many, and goes on with its own turns after its first h, where h is the CRC-32
    of c's decimal digits modulo HEADS.  Turns come in their order, null first; turns of one
    place in the order of their records.  Rows without a conversation are left out.

    Only records are shuffled, once, by family: 200 conversations at most.
    """
    c = F.col("conv_id")
    records = turns.select(
        F.col(key).cast("long").alias("conv_id"), F.col(turn).alias("turn"), turn_record(F.col(role), F.col(text)).alias("record")
    ).where(c.isNotNull())
    records = records.withColumn("family", c - c % FAMILY).repartition("family")
    in_order = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull(), "turn", "record")))
    own = records.groupBy("family", "conv_id").agg(F.transform(in_order, lambda x: x["record"]).alias("own"))
    first = F.when(c == F.col("family"), F.slice("own", 1, HEADS - 1))
    nothing = F.array().cast("array<string>")
    head = F.coalesce(F.max(first).over(Window.partitionBy("family")), nothing)
    h = (F.crc32(c.cast("string")) % HEADS).cast("int")
    path = F.concat(F.slice("head", F.lit(1), h), F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0))))
    return own.withColumn("head", head).select("conv_id", F.unhex(F.array_join(path, "")).alias("path"))


@dataclass
class Nodes:
    """The nodes of one range, by depth; node 0 is the root."""

    depth: list[np.ndarray] = field(default_factory=list)
    parent: list[np.ndarray] = field(default_factory=list)
    n_convs: list[np.ndarray] = field(default_factory=list)
    conv_id: list[np.ndarray] = field(default_factory=list)
    chars: list[np.ndarray] = field(default_factory=list)
    count: int = 0

    def add(self, depth: int, parent, n_convs, conv_id, chars) -> None:
        self.depth.append(np.full(len(parent), depth, dtype=np.int64))
        for column, values in ((self.parent, parent), (self.n_convs, n_convs), (self.conv_id, conv_id), (self.chars, chars)):
            column.append(np.asarray(values, dtype=np.int64))
        self.count += len(parent)


def turn_ids(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number from 1 for each different turn, and the lengths by number."""
    order = np.lexsort((records[:, 1], records[:, 0]))
    ordered = records[order, :2]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    ids = np.empty(len(order), dtype=np.int32)
    ids[order] = np.cumsum(new)
    return ids, np.concatenate([[0], records[order[new], 2].astype(np.int64)])


def find_nodes(convs: np.ndarray, lengths: np.ndarray, ids: np.ndarray, chars: np.ndarray) -> tuple[Nodes, np.ndarray]:
    """All nodes of the conversations, and the node at which each conversation ends.

    `ids` holds the conversations' turn ids one after the other.
    """
    nodes = Nodes()
    nodes.add(0, [-1], [len(convs)], [convs.min()], [0])
    begin = np.cumsum(lengths) - lengths
    at_node = np.zeros(len(convs), dtype=np.int64)
    prefix = np.zeros(len(convs), dtype=np.int64)  # alike where all columns so far are
    rows, done = np.flatnonzero(lengths), 0
    while len(rows):
        width = int(min(SLAB, lengths[rows].max() - done))
        column = done + np.arange(width)
        inside = column < lengths[rows, None]
        matrix = np.zeros(inside.shape, dtype=np.int32)  # 0 pads
        matrix[inside] = ids[(begin[rows, None] + column)[inside]]
        order = np.lexsort((*matrix.T[::-1], prefix[rows]))
        rows, matrix = rows[order], matrix[order]
        new = np.ones(matrix.shape, dtype=bool)
        new[1:] = matrix[1:] != matrix[:-1]
        new[1:, 0] |= prefix[rows[1:]] != prefix[rows[:-1]]
        np.logical_or.accumulate(new, axis=1, out=new)
        for j in range(width):
            starts = np.flatnonzero(new[:, j])
            real = matrix[starts, j] != 0
            first = starts[real]
            number = np.full(len(starts), -1)
            number[real] = nodes.count + np.arange(len(first))
            nodes.add(
                done + j + 1,
                at_node[rows[first]],
                np.diff(np.append(starts, len(rows)))[real],
                np.minimum.reduceat(convs[rows], starts)[real],
                chars[matrix[first, j]],
            )
            there = matrix[:, j] != 0
            at_node[rows[there]] = number[np.cumsum(new[:, j])[there] - 1]
        prefix[rows] = np.cumsum(new[:, -1])
        done += width
        rows = rows[lengths[rows] > done]
    return nodes, at_node


def prefix_keys(path: bytes) -> list[bytes]:
    """A digest of the path up to each depth, the root's first."""
    digest = hashlib.sha256()
    keys = [digest.digest()]
    for at in range(0, len(path), RECORD):
        digest.update(path[at : at + RECORD])
        keys.append(digest.copy().digest())
    return keys


def digest_of(convs: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, convs.tolist())).encode()).hexdigest()


def rows_of_range(convs: np.ndarray, paths: list[bytes], shard: int) -> Iterator[dict[str, list | np.ndarray]]:
    """Columns of NODE: whole nodes, parts of open nodes, and the ends of open nodes."""
    lengths = np.array([len(p) // RECORD for p in paths], dtype=np.int64)
    records = np.frombuffer(b"".join(paths), dtype=">u8").astype(np.uint64).reshape(-1, RECORD // 8)
    ids, chars = turn_ids(records)
    nodes, at_node = find_nodes(convs, lengths, ids, chars)
    parent, depth, n_convs, conv_id, node_chars = (
        np.concatenate(x) for x in (nodes.parent, nodes.depth, nodes.n_convs, nodes.conv_id, nodes.chars)
    )
    # nodes on the path of the first and of the last conversation, with the digest of their prefix
    key: dict[int, bytes] = {}
    place: dict[int, int] = {}
    for side, path in enumerate((min(paths), max(paths))):
        node, digests = int(at_node[paths.index(path)]), prefix_keys(path)
        for d in range(len(digests) - 1, -1, -1):
            if node not in key:
                key[node], place[node] = digests[d], side
            node = int(parent[node])
    is_open = np.zeros(nodes.count, dtype=bool)
    is_open[list(key)] = True

    # sums of subtrees, deepest nodes first; an open node gets what its whole children have
    children = np.bincount(parent[1:][~is_open[1:]], minlength=nodes.count)
    leaves = ((children == 0) & ~is_open).astype(np.int64)
    saved_tokens = np.where(is_open, 0, (n_convs - 1) * node_chars)
    ends = np.cumsum([len(x) for x in nodes.depth])
    for a, b in zip(ends[:-1][::-1], ends[1:][::-1]):
        at = a + np.flatnonzero(~is_open[a:b])
        np.add.at(leaves, parent[at], leaves[at])
        np.add.at(saved_tokens, parent[at], saved_tokens[at])

    order = np.lexsort((convs, at_node))
    last_node, bounds = np.unique(at_node[order], return_index=True)
    ending = {
        int(node): convs[order[a:b]] for node, a, b in zip(last_node, bounds, [*bounds[1:], len(order)], strict=True)
    }
    whole = np.flatnonzero(~is_open)
    under_open = is_open[parent[whole]]
    yield {
        "kind": ["whole"] * len(whole),
        "parent_key": [key.get(p) for p in parent[whole].tolist()],
        "depth": depth[whole],
        "conv_id": conv_id[whole],
        "parent_conv_id": pa.array(conv_id[parent[whole]], mask=under_open),
        "n_convs": n_convs[whole],
        "n_children": children[whole],
        "n_leaves": leaves[whole],
        "saved_tokens": saved_tokens[whole],
        "ends_sha256": [digest_of(ending[n]) if n in ending else NO_ENDS for n in whole.tolist()],
    }
    parts = np.array(sorted(key), dtype=np.int64)
    yield {
        "kind": ["open"] * len(parts),
        "key": [key[n] for n in parts.tolist()],
        "shard": np.full(len(parts), shard),
        # places follow the order of the trie: shard, then side, then depth
        "at": [place[n] for n in parts.tolist()],
        "depth": depth[parts],
        "conv_id": conv_id[parts],
        "n_convs": n_convs[parts],
        "n_children": children[parts],
        "n_leaves": leaves[parts],
        "saved_tokens": saved_tokens[parts],
        "chars": node_chars[parts],
    }
    for n in parts.tolist():
        members = ending.get(n, convs[:0])
        starts = range(0, len(members), CHUNK)
        yield {
            "kind": ["ends"] * len(starts),
            "key": [key[n]] * len(starts),
            "shard": np.full(len(starts), shard),
            "at": [*starts],
            "ids": [members[a : a + CHUNK].astype("<i8").tobytes() for a in starts],
        }


_ARROW = pa.schema(
    [
        (name, {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}[kind])
        for name, kind in (c.split() for c in NODE.split(", "))
    ]
)


def _range_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    convs, paths = [], []
    for batch in batches:
        convs.append(batch.column("conv_id").to_numpy())
        paths += batch.column("path").to_pylist()
    if not paths:
        return
    for columns in rows_of_range(np.concatenate(convs), paths, TaskContext.get().partitionId()):
        n = len(columns["kind"])
        arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ARROW]
        yield pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


@dataclass
class _Open:
    key: bytes
    depth: int
    conv_id: int
    parent_conv_id: int | None
    n_convs: int
    n_children: int
    n_leaves: int
    saved_tokens: int


OPEN = "key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _carried_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Open nodes in the order of the trie, with the sums of their subtrees; only a path is held."""
    path: list[_Open] = []

    def closed(down_to: int) -> Iterator[_Open]:
        while len(path) > down_to:
            node = path.pop()
            node.n_leaves += node.n_children == 0
            if path:
                path[-1].n_children += 1
                path[-1].n_leaves += node.n_leaves
                path[-1].saved_tokens += node.saved_tokens
            yield node

    def frame(nodes: list[_Open]) -> pd.DataFrame:
        out = pd.DataFrame([vars(n) for n in nodes], columns=[c.split()[0] for c in OPEN.split(", ")])
        return out.astype({"parent_conv_id": "Int64"})

    for part in frames:
        out = []
        for r in part.itertuples():
            out += closed(r.depth)
            own = (r.n_convs - 1) * r.chars
            above = path[-1].conv_id if path else None
            path.append(_Open(r.key, r.depth, r.conv_id, above, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens + own))
        yield frame(out)
    yield frame(list(closed(0)))


def _end_digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of each open node's ends, whose ids come in order, a chunk at a time."""
    key, digest = None, None
    for part in frames:
        out = []
        for name, ids in zip(part["key"], part["ids"], strict=True):
            text = ",".join(map(str, np.frombuffer(ids, dtype="<i8").tolist()))
            if name != key:
                if digest is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = name, hashlib.sha256(text.encode())
            else:
                digest.update(f",{text}".encode())
        yield pd.DataFrame(out, columns=["key", "ends_sha256"])
    if digest is not None:
        yield pd.DataFrame([(key, digest.hexdigest())], columns=["key", "ends_sha256"])


def ranges(paths: DataFrame) -> int:
    """Ranges for so many turns: bounded work for each, enough of them for all cores."""
    turns = paths.agg(F.sum(F.octet_length("path") / RECORD + 1)).first()[0] or 0
    cores = paths.sparkSession.sparkContext.defaultParallelism
    return max(1, round(turns / MOST_TURNS), min(cores, round(turns / LEAST_TURNS)))


def prefix_trie(paths: DataFrame) -> DataFrame:
    """COLUMNS, a row for each different beginning of a path, the empty one included.

    `paths` has conv_id (unique) and path.  conv_id is the smallest member's, parent_conv_id the
    parent's; a node's subtree includes it.  saved_tokens sums (n_convs - 1) times the code
    points of the last turn over the subtree; ends_sha256 is of the members that end there,
    ascending, comma-joined.  Equal conversations, however many, share a node; empty paths end
    at the root.  No conversations: no rows.

    A task holds a range's paths, RECORD bytes a turn, so that one conversation must fit in
    memory as digests.  The ends of a node pass through one task in chunks, as their digest
    goes through them one after the other.
    """
    paths = saved(paths.select("conv_id", "path"), "paths")
    by_range = paths.repartitionByRange(ranges(paths), "path", "conv_id")
    nodes = saved(by_range.mapInArrow(_range_nodes, NODE), "trie-nodes")

    place = F.struct("shard", "at", "depth")
    summed = nodes.where("kind = 'open'").groupBy("key").agg(
        F.min(place).alias("place"),
        *(F.min(c).alias(c) for c in ("depth", "conv_id", "chars")),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
    )
    # two paths for each range
    in_order = summed.repartition(1).sortWithinPartitions("place").drop("place")
    opened = saved(in_order.mapInPandas(_carried_up, OPEN), "trie-open")

    chunks = nodes.where("kind = 'ends'").select("key", "shard", "at", "ids")
    chunks = chunks.repartition("key").sortWithinPartitions("key", "shard", "at")
    digests = chunks.mapInPandas(_end_digests, "key binary, ends_sha256 string")
    spanning = opened.join(digests, "key", "left")
    spanning = spanning.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))

    whole = nodes.where("kind = 'whole'")
    inner = whole.where("parent_key IS NULL")
    parents = opened.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    outer = whole.join(parents, "parent_key").withColumn("parent_conv_id", F.col("above"))
    return inner.select(*COLUMNS).unionByName(outer.select(*COLUMNS)).unionByName(spanning.select(*COLUMNS))


def conversation_trie(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The prefix trie of the rebuilt conversations: see rebuilt_paths and prefix_trie.

    Null roles and texts are empty; very long texts count whole; repeated rows are turns of
    their own; other columns are ignored, whatever their names.
    """
    return prefix_trie(rebuilt_paths(turns, key, turn, role, text))
