"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are a bounded, stratified sample of the labelled rows.  Terms are all words of the
examples; their document frequencies are counted over all documents.  A term's weight in a
text is its TF-IDF times the root of its chi-squared, that is, of how much the classes of the
examples differ in it: words that tell nothing of the label hardly move a text, and none is
left out.  The index keeps, for each term and block of examples, the largest weight, so that
most blocks are skipped once the nearest are known, and still none is lost.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagetrace.llm.common import bounded_sample, saved

#: The bound on the sample of labelled rows.
MOST_EXAMPLES = 8192
NEIGHBOURS = 16
BLOCK = 1024
#: So many of the commonest terms have full lists, a weight for each example, which are
#: multiplied for many texts at once; a plan parameter, as results never depend on it.
FULL_LISTS = 256
TEXTS = 256
#: Pseudo-votes for the share of label 1.
PRIOR_VOTES = 0.1
EVIDENCE = 5
SEED = 9
#: Tasks for the examples, a bounded number of rows.
EXAMPLE_TASKS = 8

_WORD = re.compile(r"\w+")
#: Of the first 256 characters those of no word become blanks.
_BLANKED = bytes(i if _WORD.match(chr(i)) else ord(" ") for i in range(256))
RESULT = "score double, neighbours array<long>, similarities array<double>"


def words_of(text: str | None) -> list[str]:
    """The runs of word characters, in lower case."""
    low = (text or "").lower()
    try:
        return low.encode("latin-1").translate(_BLANKED).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(low)


def training_rows(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", hold_out: int = 5
) -> DataFrame:
    """(key, toxic) of labelled documents, without those held out; a key labelled more than
    once is toxic if any of its labels is."""
    held = F.crc32(F.col(key).cast("string")) % hold_out == 0
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held)
    return rows.groupBy(key).agg(F.max((F.col(label) > 0).cast("int")).alias("toxic"))


@dataclass
class Terms:
    """The words of the examples, by number: a line each, those of most examples first, so that
    what nearly all texts look up lies close together."""

    lines: str

    def numbers(self) -> dict[str, int]:
        """Kept by a worker process for the tasks to come."""
        if _NUMBERS.get("of") != self.lines:
            _NUMBERS["of"] = self.lines
            _NUMBERS["number"] = {w: i for i, w in enumerate(self.lines.split("\n"))} if self.lines else {}
        return _NUMBERS["number"]


_NUMBERS: dict = {}


def counts_of(text: str | None, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The known terms of a text, ascending, and how often it has each."""
    words = words_of(text)
    found = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
    at, n = np.unique(found, return_counts=True)
    known = int(len(at) > 0 and at[0] < 0)
    return at[known:], n[known:]


def example_words(examples: DataFrame) -> tuple[Terms, np.ndarray, np.ndarray]:
    """The words of the examples, and how many of label 1 and of label 0 have each."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for frame in frames:
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                found[toxic].update(set(words_of(text)))
        for toxic, words in enumerate(found):
            if words:
                yield pd.DataFrame({"word": list(words), "toxic": toxic, "n": list(words.values())})

    rows = examples.select("text", "toxic").mapInPandas(count, "word string, toxic int, n long")
    a, b = (F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0)) for y in (1, 0))
    # no more than the examples' words
    found = rows.groupBy("word").agg(a.alias("a"), b.alias("b")).orderBy((F.col("a") + F.col("b")).desc(), "word").toArrow()
    return Terms("\n".join(found["word"].to_pylist())), found["a"].to_numpy(), found["b"].to_numpy()


def chi_squared(a: np.ndarray, b: np.ndarray, pos: float, neg: float) -> np.ndarray:
    """How much the presence of a term, in a examples of label 1 and b of label 0, tells of the label."""
    a, b = a.astype(float), b.astype(float)
    c, d = pos - a, neg - b
    across = (a + b) * (c + d) * pos * neg
    return np.where(across > 0, (pos + neg) * (a * d - b * c) ** 2 / np.maximum(across, 1.0), 0.0)


def document_frequencies(docs: DataFrame, terms: Terms, text: str) -> tuple[np.ndarray, int]:
    """In how many of all documents each term is, and how many documents there are.

    Counted inside each task; a task gives a row for each term it has met.
    """
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = sent.value.numbers()
        met, rows = np.zeros(len(number), dtype=np.int64), 0
        for frame in frames:
            rows += len(frame)
            for t in frame["text"]:
                met[counts_of(t, number)[0]] += 1
        at = np.flatnonzero(met)
        # the term -1 stands for the documents themselves
        yield pd.DataFrame({"term": np.append(at, -1), "n": np.append(met[at], rows)})

    rows = docs.select(F.col(text).alias("text")).mapInPandas(count, "term int, n long")
    found = rows.groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # no more than the examples' words
    at, n = found["term"].to_numpy(), found["n"].to_numpy()
    out = np.zeros(terms.lines.count("\n") + 1 if terms.lines else 0, dtype=np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return out, int(n[at < 0].sum())


def spans(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers from each start to its stop, one span after the other."""
    n = stop - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


@dataclass
class Index:
    """Postings of the examples by term, in cells by block, each with its largest weight.

    Term t has the cells cell[t] to cell[t + 1]; cell c lies in block[c], and its postings
    are post[c] to post[c + 1].  The commonest terms have full lists instead: term t is row
    full[t] of `lists`.  Examples number `toxic` labels, `ids` keys.  `weight` undoes the
    stratified sample.  A block is `width` examples.
    """

    width: int
    terms: Terms
    factor: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    weight: tuple[float, float]
    prior: float
    blank: float
    cell: np.ndarray
    block: np.ndarray
    largest: np.ndarray
    post: np.ndarray
    example: np.ndarray
    value: np.ndarray
    full: np.ndarray
    lists: np.ndarray

    def vector(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of unit length; terms of no weight are left out."""
        w = (1.0 + np.log(n)) * self.factor[at]
        at, w = at[w > 0], w[w > 0]
        return at, w / max(np.sqrt((w * w).sum()), 1e-300)

    def _add(self, score: np.ndarray, cells: np.ndarray, weights: np.ndarray) -> np.ndarray:
        a, z = self.post[cells], self.post[cells + 1]
        at = spans(a, z)
        shares = self.value.take(at)
        shares *= np.repeat(weights, z - a)
        return score + np.bincount(self.example.take(at), shares, len(score))

    def nearest(self, base: np.ndarray, at: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar examples, with all that tie with the last, and their cosines.

        `base` has the share of the full lists in all cosines.  The block with the largest
        bound is scored first; then, at once, all blocks whose bounds reach the k-th cosine.
        """
        first, last = self.cell[at], self.cell[at + 1]
        cells, weights = spans(first, last), np.repeat(w, last - first)
        block = self.block[cells]
        tops = base.reshape(-1, self.width).max(axis=1)
        bound = tops + np.bincount(block, weights * self.largest[cells], len(tops))
        best = int(bound.argmax())
        one = slice(best * self.width, (best + 1) * self.width)
        own = block == best
        score = self._add(base, cells[own], weights[own])
        floor = max(0.0, np.partition(score[one], -k)[-k]) if k <= self.width else 0.0
        more = bound >= floor - 1e-9
        more[best] = False
        own = more[block]
        score = self._add(score, cells[own], weights[own])
        more[best] = True
        score[~np.repeat(more, self.width)] = 0.0
        if k < len(score):
            floor = max(floor, np.partition(score, -k)[-k])
        near = np.flatnonzero((score > 1e-12) & (score >= floor - 1e-9))
        order = np.lexsort((self.ids[near], -score[near].round(9)))
        return near[order], score[near][order]

    def _score(self, base: np.ndarray, at: np.ndarray, w: np.ndarray, k: int) -> tuple[float, list[int], list[float]]:
        ids, sims = self.nearest(base, at, w, k)
        if not len(ids):
            return self.blank, [], []
        # a vote weighs its cosine, squared; those that tie beyond k share the last places
        votes = sims**2 * np.where(self.toxic[ids] > 0, self.weight[1], self.weight[0])
        votes *= min(1.0, k / len(ids))
        score = (votes[self.toxic[ids] > 0].sum() + PRIOR_VOTES * self.prior) / (votes.sum() + PRIOR_VOTES)
        return float(score), self.ids[ids[:EVIDENCE]].tolist(), sims[:EVIDENCE].tolist()

    def scores(self, texts: Sequence[str | None], k: int = NEIGHBOURS) -> Iterator[tuple[float, list[int], list[float]]]:
        number = self.terms.numbers()
        for start in range(0, len(texts), TEXTS):
            vectors = [self.vector(*counts_of(t, number)) for t in texts[start : start + TEXTS]]
            common = np.zeros((len(vectors), len(self.lists)))
            for i, (at, w) in enumerate(vectors):
                row = self.full[at]
                common[i, row[row >= 0]] = w[row >= 0]
            for base, (at, w) in zip(common @ self.lists, vectors, strict=True):
                if not len(at) or not len(self.ids):
                    yield self.blank, [], []
                    continue
                rare = self.full[at] < 0
                yield self._score(base, at[rare], w[rare], k)


def build_index(
    docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text", most_examples: int = MOST_EXAMPLES
) -> Index:
    """The index of a sample of at most most_examples training rows.

    Of documents that share a key the least text counts.
    """
    training = saved(training, "labelled")
    sample = bounded_sample(training, "toxic", most_examples, SEED, key)
    # at most most_examples rows
    own = F.broadcast(sample.select(F.col(key).alias("_key"), "toxic"))
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.join(own, F.col("id") == F.col("_key")).groupBy("id", "toxic").agg(F.min("text").alias("text"))
    # a few rows of long texts; all tasks take part
    examples = saved(rows, "examples").repartition(EXAMPLE_TASKS)
    terms, *counts = example_words(examples)
    found, n_docs = document_frequencies(docs, terms, text)
    idf = np.log((1.0 + n_docs) / (1.0 + found)) + 1.0
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = sent.value.numbers()
        for frame in frames:
            counts = [counts_of(t, number) for t in frame["text"]]
            yield pd.DataFrame({"id": frame["id"], "toxic": frame["toxic"], "at": [c[0] for c in counts], "n": [c[1] for c in counts]})

    # no more than the examples' words; a copy of plain arrays
    got = examples.mapInPandas(count, "id long, toxic int, at array<int>, n array<int>").toArrow().sort_by("id")
    full = training.groupBy("toxic").count().collect()
    return index_of(terms, idf, tuple(counts), got, {r["toxic"]: r["count"] for r in full})


def index_of(
    terms: Terms, idf: np.ndarray, counts: tuple[np.ndarray, np.ndarray], got: pa.Table, full: dict[int, int]
) -> Index:
    """The index of the examples `got` (id, toxic, at, n); `counts` are the terms' examples of
    label 1 and of label 0, `full` the training rows by label."""
    ids, toxic = got["id"].to_numpy(), got["toxic"].to_numpy()
    have = [int((toxic == y).sum()) for y in (0, 1)]
    weight = [full.get(y, 0) / have[y] if have[y] else 1.0 for y in (0, 1)]
    weight = (weight[0] / weight[1], 1.0)
    total = sum(full.values())
    prior = full.get(1, 0) / total if total else 0.0
    factor = idf * np.sqrt(chi_squared(*counts, float(have[1]), float(have[0])))
    # all terms of all examples, one example after the other
    at, n = (got[c].combine_chunks() for c in ("at", "n"))
    size = at.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    term, n = at.flatten().to_numpy().astype(np.int64), n.flatten().to_numpy()
    row = np.repeat(np.arange(len(ids)), size)
    value = (1.0 + np.log(n)) * factor[term]
    term, row, value = term[value > 0], row[value > 0], value[value > 0]
    value /= np.sqrt(np.bincount(row, value * value, len(ids)))[row]
    filled = np.bincount(row, minlength=len(ids)) > 0
    n0, n1 = (((toxic == y) & ~filled).sum() * weight[y] for y in (0, 1))
    blank = float((n1 + PRIOR_VOTES * prior) / (n0 + n1 + PRIOR_VOTES))
    # alike examples side by side, so that few blocks reach a query's bound
    heaviest = np.lexsort((term, -value, row))
    main = np.zeros(len(ids), dtype=np.int64)
    main[row[heaviest][::-1]] = term[heaviest][::-1]
    order = np.lexsort((ids, toxic, main))
    order = order[filled[order]]
    place = np.zeros(len(ids), dtype=np.int64)
    place[order] = np.arange(len(order))
    example = place[row]
    by = np.lexsort((example, term))
    term, example, value = term[by], example[by], value[by]
    # full lists of the commonest terms; blocks that aren't full are padded
    met = np.bincount(term, minlength=len(idf))
    common = np.argsort(-met, kind="stable")[:FULL_LISTS]
    full = np.full(len(idf), -1)
    full[common] = np.arange(len(common))
    lists = np.zeros((len(common), -(-len(order) // BLOCK) * BLOCK))
    often = full[term] >= 0
    lists[full[term[often]], example[often]] = value[often]
    term, example, value = term[~often], example[~often], value[~often]
    block = example // BLOCK
    starts = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))[: len(term)])
    return Index(
        width=BLOCK,
        terms=terms,
        factor=factor,
        ids=ids[order],
        toxic=toxic[order],
        weight=weight,
        prior=prior,
        blank=blank,
        cell=np.searchsorted(term[starts], np.arange(len(idf) + 1)),
        block=block[starts],
        largest=np.maximum.reduceat(value, starts) if len(starts) else value,
        post=np.append(starts, len(term)),
        example=example,
        value=value,
        full=full,
        lists=lists,
    )


def scored(docs: DataFrame, index: Index, text: str = "text") -> Column:
    """A column (score, neighbours, similarities) for the texts of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(index)  # no more than the examples

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for batch in texts:
            yield _results(own.scores(batch.tolist()))

    return F.pandas_udf(run, RESULT)(F.col(text))


def _results(rows: Iterable[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["score", "neighbours", "similarities"])


def score_documents(docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text", **bounds: int) -> DataFrame:
    """A row per row of docs: key, score, predicted, neighbours, similarities.

    training has (key, toxic), a row per labelled document.  Null, empty and other texts
    without a word of weight get the share of label 1 among such examples; with no examples
    at all every score is 0.  Of examples as near as the k-th, all vote.  Only the text
    enters a score.  Further columns are not looked at.
    """
    index = build_index(docs, training, key, text, **bounds)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = rows.select("key", scored(rows, index).alias("found")).select(F.col("key").alias(key), "found.*")
    return out.select(key, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours", "similarities")


def without_toxic(docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text", **bounds: int) -> DataFrame:
    """The rows of docs that score below 0.5, with their own columns; nothing is shuffled."""
    index = build_index(docs, training, key, text, **bounds)
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).alias("_text"))
    return whole.where(scored(whole, index, "_text")["score"] < 0.5).select("_doc.*")
