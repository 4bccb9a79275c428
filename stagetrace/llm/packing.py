"""Packing documents into sequences of a fixed number of tokens: best two fit.

Which documents share a sequence depends on their lengths alone, and there are no more
lengths than tokens in a sequence.  The documents are therefore counted by length, and the
counts are packed: a sequence is filled greedily with the longest document that fits; then its
smallest document gives way to the two unpacked ones that fit the gap it leaves most tightly,
if these fill more.  A filling is used as often as the counts allow, so that the number of
steps depends on the capacity, not on the documents.

Every piece gets a gapless number among those of its length, in an order that depends on the
documents alone; the number tells its sequence and its place there.  Only keys, lengths and
numbers are sorted; the token ids meet them in one join.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stagetrace.llm.common import numbered, saved
from stagetrace.llm.token_order import PATTERN, Parts, text_ids

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k.json"
END_OF_TEXT = 0
#: Words whose ids a task keeps at most; a cache only.
CACHED_WORDS = 500_000


def as_bytes(ids: list[int]) -> bytes:
    """Little-endian 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def byte_letters() -> dict[int, int]:
    """How a byte-level vocabulary writes a byte: printable ones as they are, all others, in
    turn, as the letters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in shown)
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class OddCharacter(Exception):
    """A character that the tokenizer's splitter takes for another kind than our pattern does."""


class Words(dict):
    """The ids of a word as bytes; a word that is met again is looked up."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.find = regex.compile(PATTERN).findall
        self.model, self.letters = tokenizer.model, byte_letters()
        self.written = {i: as_bytes([i]) for i in tokenizer.get_vocab().values()}
        self.agreed: set[str] = set()
        self.odd: set[str] = set()

    def _agrees(self, char: str) -> bool:
        probes = (f"a{char}a", f"1{char}1", f".{char}.", f" {char} ", f"a {char}{char} a", f"'{char}")
        return all([p[i:j] for _, (i, j) in self.split(p)] == self.find(p) for p in probes)

    def __missing__(self, word: str) -> bytes:
        if not self.agreed.issuperset(word):
            new = set(word) - self.agreed - self.odd
            agreed = {char for char in new if self._agrees(char)}
            self.agreed |= agreed
            self.odd |= new - agreed
            if not self.odd.isdisjoint(word):
                raise OddCharacter
        if len(self) >= CACHED_WORDS:
            self.clear()
        if word.isascii() and word.isprintable():
            written = word.replace(" ", chr(self.letters[32]))
        else:
            written = word.encode().decode("latin-1").translate(self.letters)
        out = self[word] = b"".join([self.written[t.id] for t in self.model.tokenize(written)])
        return out


class Encoder:
    """The ids of whole texts, word by word, so that a repeated word is encoded once.

    A word's ids don't depend on its neighbours.  Words are found by a pattern of our own.
    Whether it takes a character for the same kind as the tokenizer's own splitter does is
    tried once; texts with a character for which it does not, or with the text of a special
    token, are left to the tokenizer whole.
    """

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        settings = json.loads(definition)
        splitter = settings["pre_tokenizer"] or {}
        if settings["normalizer"] or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space"):
            raise ValueError("not a plain byte-level tokenizer")
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: What a part of a text has if the text has a special token.
        self.marks = [max(s.split(" "), key=len) for s in special]
        self.words = Words(self.tokenizer)

    def whole(self, text: str) -> bytes:
        return as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def by_words(self, text: str) -> bytes | None:
        """None for a text that is left to the tokenizer."""
        if any(m in text for m in self.marks):
            return None
        try:
            return b"".join(map(self.words.__getitem__, self.words.find(text)))
        except OddCharacter:
            return None

    def __call__(self, text: str) -> bytes:
        ids = self.by_words(text)
        return self.whole(text) if ids is None else ids

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self(text), "<u4")

    def first_part(self, part: str) -> np.ndarray | None:
        ids = self.by_words(part)
        return None if ids is None else np.frombuffer(ids, "<u4")

    def after_blanks(self, parts: pa.Array) -> Parts:
        """Words of all parts as of one text; the characters of the words tell where a part ends."""
        texts = [" " + p for p in parts.to_numpy(zero_copy_only=False)]
        joined = "".join(texts)
        try:
            if any(m in joined for m in self.marks):
                raise OddCharacter
            words = self.words.find(joined)
            found = list(map(self.words.__getitem__, words))
        except OddCharacter:  # somewhere
            found = list(map(self.by_words, texts))
            words, odd = texts, np.fromiter((x is None for x in found), bool, len(found))
            found = [x or b"" for x in found]
        else:
            odd = np.zeros(len(texts), dtype=bool)
        size = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) // 4
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        until = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))
        return Parts(np.frombuffer(b"".join(found), "<u4"), np.diff(size[until], prepend=0), odd)


_ENCODERS: dict[int, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """One encoder a worker process."""
    at = zlib.crc32(definition.encode())
    if at not in _ENCODERS:
        _ENCODERS[at] = Encoder(definition)
    return _ENCODERS[at]


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first, which has the rest."""
    rest = length % capacity or min(length, capacity)
    starts = [0, *range(rest, length, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], length], strict=True)]


def token_pieces(docs: DataFrame, definition: str, key: str, text: str, capacity: int) -> DataFrame:
    """(key, piece, start, length, ids): ids as little-endian 32-bit numbers.  Every document
    ends with END_OF_TEXT; null texts are empty."""
    sent = docs.sparkSession.sparkContext.broadcast(definition)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(sent.value), as_bytes([END_OF_TEXT])
        for frame in frames:
            rows = []
            bodies = text_ids(pa.array(frame["text"], pa.string()), encode)
            for name, body in zip(frame["key"], bodies, strict=True):
                ids = body.tobytes() + end
                for i, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    rows.append((name, i, start, length, ids[4 * start : 4 * (start + length)]))
            yield pd.DataFrame(rows, columns=["key", "piece", "start", "length", "ids"])

    # as text, so that a null key stays null in pandas
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "key string, piece int, start long, length int, ids binary")


@dataclass(frozen=True)
class Filling:
    """Sequences filled alike: the lengths in their order, and how many such sequences."""

    lengths: tuple[int, ...]
    times: int


def _fill(gap: int, counts: np.ndarray, used: dict[int, int]) -> int:
    """Add the longest documents that fit, again and again; returns the gap left."""
    while gap > 0:
        left = counts[: gap + 1].copy()
        for size, n in used.items():
            if size <= gap:
                left[size] -= n
        sizes = np.flatnonzero(left > 0)
        if not len(sizes):
            return gap
        size = int(sizes[-1])
        n = min(gap // size, int(left[size]))
        used[size] = used.get(size, 0) + n
        gap -= n * size
    return gap


def _tighter(counts: np.ndarray, used: dict[int, int], gap: int) -> tuple[int, int] | None:
    """The two unpacked documents that together fill the gap left without the smallest packed
    one best, if they fill more than it does."""
    smallest = min(used)
    room = gap + smallest
    left = counts[:room].copy()  # each of two is shorter than the room
    for size, n in used.items():
        if size < room:
            left[size] -= n
    sizes = np.flatnonzero(left > 0)
    if not len(sizes):
        return None
    # for each length the longest partner that still fits, not longer than itself
    at = np.searchsorted(sizes, np.minimum(sizes, room - sizes), side="right") - 1
    partner = np.where(at >= 0, sizes[np.maximum(at, 0)], 0)
    alone = (partner == sizes) & (left[sizes] < 2)  # a length that is there once only
    partner = np.where(alone, np.where(at > 0, sizes[np.maximum(at - 1, 0)], 0), partner)
    both = np.where(partner > 0, sizes + partner, 0)
    best = int(np.argmax(both))
    return (int(sizes[best]), int(partner[best])) if both[best] > smallest else None


def best_two_fit(counts: Sequence[int], capacity: int) -> list[Filling]:
    """Fillings that use every document once; counts[n] documents have n tokens."""
    counts = np.array(counts, dtype=np.int64)
    out = []
    while counts.any():
        used: dict[int, int] = {}
        gap = _fill(capacity, counts, used)
        while gap > 0 and sum(used.values()) > 1 and (pair := _tighter(counts, used, gap)):
            smallest = min(used)
            used[smallest] -= 1
            if not used[smallest]:
                del used[smallest]
            for size in pair:
                used[size] = used.get(size, 0) + 1
            gap = _fill(gap + smallest - sum(pair), counts, used)
        times = min(int(counts[size]) // n for size, n in used.items())
        for size, n in used.items():
            counts[size] -= n * times
        out.append(Filling(tuple(size for size in sorted(used, reverse=True) for _ in range(used[size])), times))
    return out


class Places:
    """The sequence and the place in it of the n-th document of a length."""

    def __init__(self, fillings: Sequence[Filling], capacity: int):
        rows = []  # length, documents of it before, copies of it in a sequence, first sequence, place of the first copy
        before = np.zeros(capacity + 1, dtype=np.int64)
        sequence = 0
        for f in fillings:
            offset = 0
            sizes, copies = np.unique(np.array(f.lengths), return_counts=True)
            for size, n in zip(sizes[::-1].tolist(), copies[::-1].tolist(), strict=True):
                rows.append((size, before[size], n, sequence, offset))
                before[size] += n * f.times
                offset += n * size
            sequence += f.times
        self.sequences = sequence
        rows = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        self.length, self.before, self.copies, self.first, self.offset = rows.T
        #: Documents of all shorter lengths, then of this one: numbers over all lengths.
        self.lower = np.concatenate([[0], np.cumsum(before)])[:-1]
        self.start = self.lower[self.length] + self.before

    def __call__(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of documents numbered by length."""
        at = np.searchsorted(self.start, number, side="right") - 1
        nth = number - self.start[at]
        sequence = self.first[at] + nth // self.copies[at]
        return sequence, self.offset[at] + nth % self.copies[at] * self.length[at]


def length_counts(pieces: DataFrame, capacity: int) -> list[int]:
    """Documents by length: at most `capacity` numbers."""
    counts = [0] * (capacity + 1)
    for r in pieces.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    return counts


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str | None = None,
) -> DataFrame:
    """(key, piece, start, length, ids, sequence_id, offset): a row for each piece of a document.

    A document's ids, END_OF_TEXT included, are one piece, or several if they are more than
    `capacity`: then all pieces are full but the first.  Pieces of a sequence follow each other
    without a gap from offset 0.  Sequences are numbered from 0.  Numbers depend on keys, texts
    and capacity alone.

    Null and empty texts are one END_OF_TEXT.  Documents without a key, or with the same key,
    are packed each; rows alike in key and text may change places.  Very long texts are encoded
    whole.  Other columns are ignored, whatever their names.  No documents: no rows.
    `vocabulary` is the file of a byte-level tokenizer.
    """
    with open(vocabulary or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        definition = f.read()
    pieces = token_pieces(docs, definition, key, text, capacity)
    pieces = pieces.withColumn("_row", F.monotonically_increasing_id())
    pieces = saved(pieces, "token-pieces", "zstd")
    fillings = best_two_fit(length_counts(pieces, capacity), capacity)
    # no more rows than fillings times the different lengths of a sequence, whatever the input
    sent = docs.sparkSession.sparkContext.broadcast(Places(fillings, capacity))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence, offset = sent.value(frame["number"].to_numpy())
            yield pd.DataFrame({"_row": frame["_row"], "sequence_id": sequence, "offset": offset})

    narrow = pieces.select("_row", "length", F.xxhash64("key", "piece", "ids").alias("order"))
    by_length = numbered(narrow, ["length", "order"], "number", "piece-numbers")
    placed = by_length.select("_row", "number").mapInPandas(run, "_row long, sequence_id long, offset long")
    out = pieces.join(placed, "_row").drop("_row")
    name = F.col("key").cast(docs.schema[key].dataType)
    return out.select(name.alias(key), "piece", "start", F.col("length").cast("long").alias("length"), "ids", "sequence_id", "offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, starts): whole sequences, at most `capacity` ids each, with
    the place at which each piece begins."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    out = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return out.select("sequence_id", "n_tokens", joined.alias("ids"), F.col("parts")["offset"].alias("starts"))
