"""Token ids as fixed-stride shards in training order.

Documents become sequences of a fixed number of token ids.  A keyed Feistel network walks
every sequence's number to its global slot: a permutation that needs no table and no sort
of the corpus.  Ranges of slots are partitions, sorted and written as one shard each, so
that any slot's record lies at a known offset and reading resumes anywhere.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import accumulate, islice
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagetrace.llm.common import new_folder, saved

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's pattern of words, and its free id for the end of a text.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_TEXT = 50256
SEQUENCE = 256
SHARD_RECORDS = 1 << 15
#: A record: document, sequence of the document, ids that are not padding, then the ids; a
#: line feed closes it, as the writer of text files wants it.
HEADER = np.dtype([("doc", "<i8"), ("sequence", "<i4"), ("n_tokens", "<i4")])
NULL_DOC = -(1 << 63)
ROUNDS = 8
#: Bytes of text whose parts are told apart at once.
BLOCK_BYTES = 1 << 23
#: How often the rows are counted anew if they have moved to other tasks meanwhile.
COUNTS = 4
MOVED = "rows of documents have moved to other tasks"


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Parts(NamedTuple):
    """What an encoder gives for parts of texts: the ids of all, how many each has, and which
    parts it leaves to texts that are encoded whole."""

    ids: np.ndarray
    counts: np.ndarray
    odd: np.ndarray


class Tokenizer:
    """Ids of texts by a vocabulary of bytes."""

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values(), default=0) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)

    def __call__(self, text: str) -> np.ndarray:
        # faster than an array from the list
        return np.asarray(array("H", self.encoding.encode_ordinary(text)), dtype="<u2")

    ids = first_part = __call__

    def after_blanks(self, parts: pa.Array) -> Parts:
        """Encoded as one text; the bytes of its ids tell where a part ends."""
        ids = self(" ".join(["", *parts.to_numpy(zero_copy_only=False)]))
        ends = np.cumsum(pc.binary_length(parts).to_numpy() + 1, dtype=np.int64)
        until = np.searchsorted(np.cumsum(self.size[ids]), ends, side="right")
        return Parts(ids, np.diff(until, prepend=0), np.zeros(len(parts), dtype=bool))


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(vocabulary: bytes) -> Tokenizer:
    """One a worker process."""
    name = hashlib.sha256(vocabulary).hexdigest()
    if name not in _TOKENIZERS:
        _TOKENIZERS[name] = Tokenizer(vocabulary)
    return _TOKENIZERS[name]


class PartedTexts(NamedTuple):
    """The parts of texts between blanks: how many each text has, the place of the first, the
    number of each among the different ones, and these."""

    n: np.ndarray
    first: np.ndarray
    code: np.ndarray
    parts: pa.Array


def parted(texts: pa.Array) -> PartedTexts:
    lists = pc.split_pattern(texts, " ")
    n = lists.value_lengths().to_numpy().astype(np.int64)
    parts = lists.flatten().dictionary_encode()
    return PartedTexts(n, np.cumsum(n) - n, parts.indices.to_numpy().copy(), parts.dictionary)


def text_blocks(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts in blocks of some BLOCK_BYTES; null is empty."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, side="right")))
        yield texts[at:to]
        at = to


def _text_ids(texts: pa.Array, encoder) -> list[np.ndarray]:
    n, first, code, parts = parted(texts)
    names = parts.to_numpy(zero_copy_only=False)
    odd = np.fromiter((not p or p[0].isspace() for p in names), bool, len(names))
    plain = np.flatnonzero(~odd)
    found = encoder.after_blanks(parts.take(pa.array(plain)))
    odd[plain[found.odd]] = True
    counts = np.zeros(len(names), dtype=np.int64)
    counts[plain] = found.counts
    later = np.ones(len(code), dtype=bool)
    later[first] = False
    whole = np.logical_or.reduceat(odd[code] & later, first)
    # a text begins with its first part, which has no blank before it, or is one part
    heads = [None if w else encoder.first_part(names[c]) for w, c in zip(whole, code[first], strict=True)]
    whole = np.fromiter((h is None for h in heads), bool, len(heads))
    heads = [encoder.ids(texts[i].as_py()) if h is None else h for i, h in enumerate(heads)]
    code[first] = len(names) + np.arange(len(n))
    code = code[~(later & np.repeat(whole, n))]
    n = np.where(whole, 1, n)
    counts = np.append(counts, [len(h) for h in heads])
    starts = np.cumsum(counts) - counts
    ids = np.concatenate([found.ids, *heads])
    size = counts[code]
    at = np.repeat((starts[code] - np.cumsum(size) + size).astype(np.int32), size)
    at += np.arange(len(at), dtype=np.int32)
    return np.split(ids[at], np.cumsum(np.add.reduceat(size, np.cumsum(n) - n))[:-1])


def text_ids(texts: pa.Array, encoder) -> Iterator[np.ndarray]:
    """The ids of each text; null is empty.

    A blank before a character that is no blank begins a word of PATTERN, whatever precedes
    it, and what precedes it has the same words without it.  Texts are therefore parted at
    blanks, and each different part of a block of texts is encoded once.  Texts with blanks
    that aren't followed so, or with parts that the encoder finds odd, are encoded whole.
    """
    for block in text_blocks(texts):
        yield from _text_ids(block, encoder)


def token_counts(rows: DataFrame, vocabulary: bytes, sequence: int) -> DataFrame:
    """(part, n): the sequences of each task of rows (doc, text)."""
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, n = tokenizer(sent.value), 0
        for batch in batches:
            n += sum(len(ids) // sequence + 1 for ids in text_ids(batch["text"], encoder))
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": [n]})

    return rows.mapInArrow(run, "part int, n long")


class Feistel:
    """A permutation of 0 .. size - 1, by an unbalanced Feistel network on the least number
    of bits that holds it; numbers beyond size walk on until they are inside."""

    def __init__(self, size: int, key: int):
        self.size = size
        self.bits = max(2, (size - 1).bit_length())
        seeds = hashlib.sha256(key.to_bytes(8, "little", signed=True)).digest()
        self.keys = np.frombuffer(hashlib.shake_256(seeds).digest(8 * ROUNDS), dtype="<u8")

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        low = self.bits // 2
        sizes = [low, self.bits - low]
        steps = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
        for i in steps:
            a = np.uint64(sizes[i % 2])  # the bits that this round changes
            mask = (np.uint64(1) << a) - np.uint64(1)
            if i % 2:  # the upper part changes by the lower one
                x = x ^ ((self._round(x & ((np.uint64(1) << np.uint64(low)) - np.uint64(1)), self.keys[i]) & mask) << np.uint64(low))
            else:
                x = x ^ (self._round(x >> np.uint64(low), self.keys[i]) & mask)
        return x

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x).astype(np.uint64), back)
        while len(out := np.flatnonzero(x >= np.uint64(self.size))):
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, False)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, True)


def record_type(sequence: int) -> np.dtype:
    return np.dtype([*((n, HEADER[n]) for n in HEADER.names), ("ids", "<u2", (sequence,)), ("end", "S1")])


def records(
    rows: DataFrame, starts: dict[int, tuple[int, int]], vocabulary: bytes, seed: int, sequence: int, shard_records: int
) -> DataFrame:
    """(slot, shard, record) of every sequence, without the closing line feed.  `starts` has, by
    task, the number of its first sequence and how many it has."""
    context = rows.sparkSession.sparkContext
    sent, begins = context.broadcast(vocabulary), context.broadcast(starts)
    order = Feistel(sum(n for _, n in starts.values()), seed)
    full = record_type(sequence)
    kind = np.dtype([(name, full[name]) for name in full.names if name != "end"])

    def some(docs: np.ndarray, texts: list[np.ndarray], at: int) -> pa.RecordBatch:
        n_tokens = np.array([len(ids) + 1 for ids in texts])
        whole = -(-n_tokens // sequence)
        row = np.repeat(np.arange(len(texts)), whole)
        first = np.cumsum(whole) - whole
        nth = np.arange(len(row)) - first[row]
        out = np.zeros(len(row), dtype=kind)
        out["doc"], out["sequence"] = docs[row], nth
        out["n_tokens"] = np.minimum(sequence, n_tokens[row] - nth * sequence)
        flat = np.full(len(row) * sequence, END_OF_TEXT, dtype="<u2")
        for ids, a in zip(texts, (first * sequence).tolist(), strict=True):
            flat[a : a + len(ids)] = ids
        out["ids"] = flat.reshape(-1, sequence)
        slot = order.slots(at + np.arange(len(row)))
        ends = pa.py_buffer(np.arange(len(row) + 1, dtype=np.int32) * np.int32(kind.itemsize))
        record = pa.Array.from_buffers(pa.binary(), len(row), [None, ends, pa.py_buffer(out)])
        shard = pa.array((slot // shard_records).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(slot), shard, record], ["slot", "shard", "record"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(sent.value)
        at, n = begins.value.get(TaskContext.get().partitionId(), (0, 0))
        end = at + n
        for batch in batches:
            docs, found = batch["doc"].to_numpy(), text_ids(batch["text"], encoder)
            for a in range(0, len(docs), 512):
                texts = list(islice(found, 512))
                out_at, at = at, at + sum(len(ids) // sequence + 1 for ids in texts)
                if at > end:
                    break
                yield some(docs[a : a + 512], texts, out_at)
        if at != end:
            raise RuntimeError(MOVED)

    return rows.mapInArrow(run, "slot long, shard int, record binary")


def write_shards(
    docs: DataFrame,
    path: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 3,
    sequence: int = SEQUENCE,
    shard_records: int = SHARD_RECORDS,
    vocabulary: bytes | None = None,
    stored: bool = False,
) -> str:
    """Write all documents as shards of records in training order; returns the folder.

    Every document is one token at least, the end of text, also if null or empty; its last
    sequence is padded.  Sequences are numbered as the rows are read, and the permutation
    deals the numbers to slots 0 .. n - 1.  Shard s holds the slots from s * shard_records
    on, in order, one file in the folder shard=s.  Keys are integers; null keys are
    written as NULL_DOC; rows that share a key are documents of their own.  An empty table
    writes no shard.

    The documents are read twice, to count their sequences and to write them, so that ids are
    nowhere kept beside the shards.  `stored` documents are read from files; others are saved
    first, so that both times have the same rows.  A task that doesn't find as many sequences
    as were counted for it stops the job, and all is counted again.
    """
    spark = docs.sparkSession
    path = path or new_folder(spark, "shards")
    vocabulary = read_vocabulary() if vocabulary is None else vocabulary
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_DOC)).alias("doc"), F.col(text).alias("text"))
    rows = rows if stored else saved(rows, "documents", "zstd")
    for left in range(COUNTS - 1, -1, -1):
        # a row per task
        counts = sorted((r["part"], r["n"]) for r in token_counts(rows, vocabulary, sequence).collect())
        ends = list(accumulate(n for _, n in counts))
        starts = {part: (end - n, n) for (part, n), end in zip(counts, ends, strict=True)}
        shards = max(1, -(-(ends[-1] if ends else 0) // shard_records))
        placed = records(rows, starts, vocabulary, seed, sequence, shard_records)
        placed = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "slot")
        # the writer adds the line feed
        lines = placed.select("shard", F.col("record").cast("string").alias("value"))
        try:
            lines.write.partitionBy("shard").text(path)
            return path
        except PySparkException as e:
            if not left or MOVED not in str(e):
                raise
    return path


def read_shards(
    spark: SparkSession, path: str, sequence: int = SEQUENCE, shard_records: int = SHARD_RECORDS, start: int = 0
) -> DataFrame:
    """(slot, shard, doc, sequence, n_tokens, ids) from slot `start` on; each shard is read by one task."""
    kind = record_type(sequence)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, content in zip(frame["shard"], frame["content"], strict=True):
                got = np.frombuffer(content, dtype=kind)
                first = int(shard) * shard_records
                for at in range(max(0, start - first), len(got), 4096):
                    some = got[at : at + 4096]
                    docs = pd.array(some["doc"], dtype="Int64")
                    docs[some["doc"] == NULL_DOC] = pd.NA
                    yield pd.DataFrame({
                        "slot": np.arange(first + at, first + at + len(some)), "shard": int(shard), "doc": docs,
                        "sequence": some["sequence"], "n_tokens": some["n_tokens"], "ids": [r.tobytes() for r in some["ids"]],
                    })

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    if "shard" not in files.columns:  # no shard was written
        files = files.withColumn("shard", F.lit(0))
    files = files.where(F.col("shard") >= start // shard_records)
    return files.select(F.col("shard").cast("int").alias("shard"), "content").mapInPandas(
        run, "slot long, shard int, doc long, sequence int, n_tokens int, ids binary"
    )

