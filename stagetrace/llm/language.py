"""Language identification with string kernels.

Texts meet in a blended spectrum: the presence of hashed n-grams of several lengths, each
counted once, normalised to unit length.  Nyström features over a few landmark texts make
kernel ridge regression, one language against the rest, a product of small matrices: the
training texts, landmarks included, are a bounded stratified sample, and every document is
scored, in batches, by its kernel with the landmarks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagetrace.llm.common import bounded_sample

#: The bounds on the sample of labelled rows and on the landmarks among them.
MOST_EXAMPLES = 2048
LANDMARKS = 64
GRAMS = (1, 2, 3)
#: n-grams are hashed to 2 ** HASH_BITS places.
HASH_BITS = 14
RIDGE = 1e-2
UNKNOWN = "und"
SEED = 4
#: Documents and characters of a block of the presence matrix.
BLOCK_DOCS = 256
BLOCK_CHARS = 1_000_000

RESULT = "lang_pred string, score double"


def presence(texts: list[str]) -> np.ndarray:
    """A row per text: which hashed n-grams it has, over the whole text."""
    out = np.zeros((len(texts), 1 << HASH_BITS), dtype=bool)
    flat = out.ravel()
    lower = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = [len(t) for t in lower]
    row = np.repeat(np.arange(len(texts), dtype=np.int64) << HASH_BITS, lengths)
    mixed = np.zeros(len(codes), dtype=np.uint32)
    shift = np.uint32(32 - HASH_BITS)
    for n in range(1, max(GRAMS) + 1):
        if n > 1:
            mixed = mixed[:-1]
        if len(codes) < n:
            break
        # the hash of the n characters from here on
        mixed = (mixed ^ codes[n - 1 :]) * np.uint32(2654435761) + np.uint32(n)
        if n in GRAMS:
            spread = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(2246822519)
            whole = row[: len(mixed)] == row[n - 1 :]  # not across two texts
            flat[(row[: len(mixed)] + (spread >> shift))[whole]] = True
    return out


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common n-grams over the geometric mean of both texts' n-grams."""
    a, b = a.astype(np.float32), b.astype(np.float32)
    norm = np.sqrt(np.outer(np.maximum(a.sum(axis=1), 1), np.maximum(b.sum(axis=1), 1)))
    return (a @ b.T) / norm


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def outputs(self, texts: list[str]) -> np.ndarray:
        return kernel(presence(texts), self.landmarks) @ self.weights


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ridge(seen: np.ndarray, langs: list[str], landmarks: int) -> Model:
    """Weights of one-versus-rest kernel ridge regression on Nyström features."""
    names = sorted(set(langs))
    marks = seen[:landmarks]
    own = kernel(marks, marks).astype(np.float64)
    values, vectors = np.linalg.eigh(own)
    keep = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = kernel(seen, marks) @ root
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # the rows of a language weigh as much as those of any other
    share = 1.0 / np.array([langs.count(x) for x in names])
    w = share[[names.index(x) for x in langs]] * len(langs) / len(names)
    inner = z.T @ (z * w[:, None]) + RIDGE * len(langs) * np.eye(z.shape[1]) / 100
    return Model(names, marks, root @ np.linalg.solve(inner, z.T @ (y * w[:, None])))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = MOST_EXAMPLES, landmarks: int = LANDMARKS) -> Model | None:
    """A model of at most `most` rows with text and language; None if there are none.

    The driver gets a bit per n-gram place of each, not their texts.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sample = bounded_sample(rows, "lang", most, SEED, "key")
    # at most `most` rows
    met = rows.join(F.broadcast(sample.select("key").distinct()), "key", "left_semi")

    def bits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), BLOCK_DOCS):
                part = frame.iloc[at : at + BLOCK_DOCS]
                seen = np.packbits(presence(part["text"].tolist()), axis=1)
                yield pd.DataFrame({"key": part["key"], "lang": part["lang"], "bits": [r.tobytes() for r in seen]})

    kind = docs.schema[key].dataType.simpleString()
    got = met.mapInPandas(bits, f"key {kind}, lang string, bits binary").dropDuplicates(["key"])
    # landmarks are the first rows: one of each language in turn, in hash order
    got = got.withColumn("order", F.xxhash64(F.lit(SEED), F.col("key"))).toPandas()
    if got.empty:
        return None
    got = got.sort_values(["order", "key"])
    got["turn"] = got.groupby("lang").cumcount()
    got = got.sort_values(["turn", "order", "key"])
    seen = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in got["bits"]]), axis=1).astype(bool)
    return ridge(seen, got["lang"].tolist(), landmarks)


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, chars = 0, 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= BLOCK_DOCS or chars + len(t) > BLOCK_CHARS):
            yield start, i
            start, chars = i, 0
        chars += len(t)
    if start < len(texts):
        yield start, len(texts)


def predicted(docs: DataFrame, model: Model | None, text: str = "text") -> Column:
    """A column (lang_pred, score) for the texts of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # LANDMARKS rows of 2 ** HASH_BITS

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for batch in batches:
            langs, scores = [UNKNOWN] * len(batch), [0.0] * len(batch)
            spoken = [i for i, t in enumerate(batch) if own is not None and has_letter(t)]
            texts = [batch.iloc[i] for i in spoken]
            for start, end in _blocks(texts):
                out = own.outputs(texts[start:end])
                best = out.argmax(axis=1)
                for i, b, s in zip(spoken[start:end], best.tolist(), out.max(axis=1).tolist(), strict=True):
                    langs[i], scores[i] = own.languages[b], min(1.0, max(0.0, (s + 1.0) / 2.0))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return F.pandas_udf(run, RESULT)(F.col(text))


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of docs: key, lang_pred, score.

    Null texts and texts without a letter are `und` with score 0, and so is every text if
    there was nothing to learn from.  The score is the largest of the one-versus-rest
    outputs, moved from -1 .. 1 to 0 .. 1.  Further columns are not looked at.
    """
    out = docs.select(F.col(key).alias(key), predicted(docs, model, text).alias("_found"))
    return out.select(key, "_found.lang_pred", "_found.score")
