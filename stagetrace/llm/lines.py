"""Line deduplication: two Bloom filters find suspects, only suspects shuffle.

Each task fills two filters with its lines: the first with every line's hash, the second
with those that another document of the task had before.  Filters of tasks merge by
segment: the second ones by OR, together with the AND of any two first ones, so that no
repeated line can be missed.  Lines that hit the merged second filter are suspects; only
they are shuffled, counted exactly and given their first occurrence.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagetrace.llm.common import saved

#: Bits of each filter for a line, and hashes of a line.
BITS_A_LINE = 32
HASHES = 2
#: Neither filter has more bits; beyond that more lines are suspects, and all are settled exactly.
MOST_BITS = 1 << 29
#: Bits of a segment, the unit in which filters travel.
SEGMENT = 1 << 18
LEAST_CHARS = 10


def line_keys(text: str | None, least: int) -> list[bytes | None]:
    """A key for each line of the text: blanks cut off, A-Z lower-cased; None for short ones."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    # bytes.strip() and bytes.lower() know just the ASCII blanks and letters
    keys = [line.strip().lower() for line in lines]
    return [k if len(k) >= least and (len(k) >= 4 * least or len(k.decode("utf-8", "surrogatepass")) >= least) else None for k in keys]


def positions(keys: list[bytes], bits: int) -> np.ndarray:
    """HASHES bit positions for each key."""
    h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
    step = (h >> np.uint64(33)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) % np.uint64(bits) for i in range(HASHES)], axis=1).astype(np.int64)


class Filter:
    def __init__(self, bits: int, words: np.ndarray | None = None):
        self.bits = bits
        self.bytes = np.zeros(bits // 8, dtype=np.uint8) if words is None else words

    def add(self, at: np.ndarray) -> None:
        flat = at.ravel()
        np.bitwise_or.at(self.bytes, flat >> 3, (1 << (flat & 7)).astype(np.uint8))

    def has(self, at: np.ndarray) -> np.ndarray:
        return ((self.bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _fill(frames: Iterator[pd.DataFrame], bits: int, least: int) -> Iterator[pd.DataFrame]:
    once, twice = Filter(bits), Filter(bits)
    for frame in frames:
        keys = [k for text in frame["text"] for k in {*line_keys(text, least)} - {None}]
        if not keys:
            continue
        at = positions(keys, bits)
        # the keys of a document differ, so that equal positions are those of another one
        _, first = np.unique(at @ np.array([bits, 1]), return_index=True)
        again = np.ones(len(at), dtype=bool)
        again[first] = False
        twice.add(at[again | once.has(at)])
        once.add(at)
    for part, filter_ in enumerate((once, twice)):
        cells = filter_.bytes.reshape(-1, SEGMENT // 8)
        filled = np.flatnonzero(cells.any(axis=1))
        for some in np.array_split(filled, -(-len(filled) // 64) or 1):
            packed = [zlib.compress(cells[i].tobytes(), 1) for i in some]
            yield pd.DataFrame({"segment": some, "part": part, "cells": packed})


def _merge(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The merged second filter, by segment; rows come sorted by segment."""
    now, once, twice = None, np.zeros(size, np.uint8), np.zeros(size, np.uint8)

    def done() -> Iterator[pd.DataFrame]:
        if now is not None and twice.any():
            yield pd.DataFrame({"segment": [now], "cells": [zlib.compress(twice.tobytes(), 1)]})

    for frame in frames:
        for segment, part, packed in zip(frame["segment"], frame["part"], frame["cells"], strict=True):
            if segment != now:
                yield from done()
                now = segment
                once[:], twice[:] = 0, 0
            cells = np.frombuffer(zlib.decompress(packed), np.uint8)
            if part:
                twice |= cells
            else:
                twice |= once & cells
                once |= cells
    yield from done()


def suspected_bits(docs: DataFrame, lines: int, least: int = LEAST_CHARS, most_bits: int = MOST_BITS) -> Filter:
    """The merged second filter, of at most most_bits bits whatever the input."""
    bits = max(SEGMENT, min(most_bits, 1 << (BITS_A_LINE * max(1, lines)).bit_length() - 1))
    filled = docs.select("text").mapInPandas(
        lambda frames: _fill(frames, bits, least), "segment int, part int, cells binary"
    )
    merged = filled.repartition("segment").sortWithinPartitions("segment", "part")
    merged = merged.mapInPandas(lambda frames: _merge(frames, SEGMENT // 8), "segment int, cells binary")
    out = np.zeros((bits // SEGMENT, SEGMENT // 8), np.uint8)
    for row in merged.collect():
        out[row["segment"]] = np.frombuffer(zlib.decompress(row["cells"]), np.uint8)
    return Filter(bits, out.ravel())


def repeated_lines(docs: DataFrame, least: int = LEAST_CHARS, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc, line): the lines, as digests of their keys, that each document loses.

    docs has (doc, text), doc telling documents apart in the order that makes one the first.
    """
    spark = docs.sparkSession
    lines = docs.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0]
    filter_ = suspected_bits(docs, lines or 0, least, most_bits)
    sent = spark.sparkContext.broadcast(filter_.bytes)  # at most most_bits / 8 bytes
    bits = filter_.bits

    def suspects(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            docs_, keys = [], []
            for doc, text in zip(frame["doc"], frame["text"], strict=True):
                own = {*line_keys(text, least)} - {None}
                keys += own
                docs_ += [doc] * len(own)
            if keys:
                hit = np.flatnonzero(Filter(bits, sent.value).has(positions(keys, bits)))
                digests = [hashlib.sha256(keys[i]).digest()[:16] for i in hit]
                yield pd.DataFrame({"doc": [docs_[i] for i in hit], "line": digests})

    kind = docs.schema["doc"].dataType.simpleString()
    found = saved(docs.select("doc", "text").mapInPandas(suspects, f"doc {kind}, line binary"), "suspects")
    ends = found.groupBy("line").agg(F.min("doc").alias("_first"), F.max("doc").alias("_last"))
    # saved, so that a join with a very common line can split its rows
    ends = saved(ends.where("_first < _last").select("line", "_first"), "repeated-lines")
    return found.join(ends, "line").where("doc > _first").select("doc", "line")


def _rewrite(frames: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        counts, drops, texts = [], [], []
        for text, lost in zip(frame["text"], frame["lost"], strict=True):
            lines = (text or "").split("\n")
            counts.append(len(lines))
            if lost is None or not len(lost):
                drops.append(0)
                texts.append(text or "")
                continue
            gone = {bytes(d) for d in lost}
            stay = [
                line
                for line, key in zip(lines, line_keys(text, least), strict=True)
                if key is None or hashlib.sha256(key).digest()[:16] not in gone
            ]
            drops.append(len(lines) - len(stay))
            texts.append("\n".join(stay))
        yield pd.DataFrame({"key": frame["key"], "n_lines": counts, "n_dropped": drops, "text": texts})


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_CHARS, most_bits: int = MOST_BITS
) -> DataFrame:
    """A row per row of docs: key, n_lines, n_dropped, text without the repeated lines.

    Lines are parted at \\n; null and empty texts have one empty line.  A line whose key
    has at least `least` code points and is found in several documents stays only in the
    one with the smallest (integer) key, null being the smallest; repetitions within that
    document stay.  Rows that share a key are one document.  An empty table gives an
    empty result; further columns are not looked at.
    """
    rows = docs.select(
        F.coalesce(F.col(key), F.lit(-(1 << 63))).cast("long").alias("doc"), F.col(text).alias("text"), F.col(key).alias("key")
    )
    lost = repeated_lines(rows, least, most_bits).groupBy("doc").agg(F.collect_list("line").alias("lost"))
    kind = docs.schema[key].dataType.simpleString()
    out = rows.join(lost, "doc", "left").select("key", "text", "lost")
    return out.mapInPandas(
        lambda frames: _rewrite(frames, least), f"key {kind}, n_lines long, n_dropped long, text string"
    ).withColumnRenamed("key", key)
