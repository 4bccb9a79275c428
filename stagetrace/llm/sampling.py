"""SentencePiece encoding by sampling without replacement, and decoding.

A text's pieces form a lattice; a path is a segmentation, as likely as the product of its
pieces' weights.  Gumbel top-k makes k distinct draws: perturb the log-probability of every
path with Gumbel noise, and take the k largest.  The search for them is A* from the start of
the text: a set of paths with a common beginning has the largest perturbed value of any of
its members as its exact bound, which can be drawn without looking at them.  The best set is
opened into its likeliest continuation, drawn in proportion to the pieces' conditional
probabilities, and, at every step along it, the set of all that turn off there, whose bound
is drawn below its parent's.  The bound of the best set left after k paths gives each path's
probability to be among the k, its inclusion score.

The lattice is built for each distinct word of a block of texts; noise is a hash of the
row's key, the draw and the place in the text, so that results don't depend on blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
SEED = 2
#: Exponent of the piece weights: 0 makes all segmentations equally likely.
SHARPNESS = 1.0
#: A word's rank in the vocabulary, and this, make its weight: 1 / (rank + OFFSET).
OFFSET = 10
BLANK = 0x2581
#: Stands for the sign of a blank where the text itself has it; beyond Unicode.
LITERAL_BLANK = 0x120000
#: Words of more characters are parted where no piece reaches across, which changes nothing.
LONG_WORD = 256
BLOCK_CHARS = 2_000_000
NONE = 0xFFFF
#: Uniform numbers of 53 bits give Gumbel noise below NOISE; a set whose log-probability is
#: under -DEPTH has a bound under NOISE - DEPTH.
NOISE, DEPTH = 37.5, 80.0
_BASE = np.uint64(0x100000001B3)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 20


@dataclass
class Vocabulary:
    """Pieces of a SentencePiece model as plain arrays; at most 65,535 of them."""

    pieces: list[str]
    raw: list[bytes]  # what a piece stands for in a text
    normal: np.ndarray  # pieces that match text
    byte_ids: np.ndarray

    @classmethod
    def read(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        byte_ids = np.full(256, NONE, dtype=np.int64)
        raw, normal = [], np.zeros(n, dtype=bool)
        for i, p in enumerate(pieces):
            if model.is_byte(i):
                value = int(p[3:5], 16)
                byte_ids[value] = i
                raw.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                raw.append(b"")
            else:
                # within a piece the sign of a blank only leads
                normal[i] = chr(BLANK) not in p.lstrip(chr(BLANK)) and "\n" not in p
                raw.append(p.replace(chr(BLANK), " ").encode())
        return cls(pieces, raw, normal, byte_ids)


@dataclass
class Edges:
    """Lattices of words: `node` has the first node of each word, `first` and `count` the
    edges of each node; an edge has its piece and the piece's length, the log of its
    conditional probability, and the sum of these probabilities up to it in its node."""

    node: np.ndarray
    first: np.ndarray
    count: np.ndarray
    piece: np.ndarray
    size: np.ndarray
    logp: np.ndarray
    upto: np.ndarray


class Lattices:
    """Looks up pieces by their hash; a hit is checked against the whole hash of 64 bits,
    which differs for all pieces."""

    def __init__(self, vocabulary: Vocabulary, sharpness: float):
        ids = np.flatnonzero(vocabulary.normal)
        self.vocabulary = vocabulary
        self.most = max(len(vocabulary.pieces[i]) for i in ids)
        hashes = np.zeros(len(vocabulary.pieces) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in ids.tolist():
                h = np.uint64(0)
                for c in vocabulary.pieces[i]:
                    h = h * _BASE + np.uint64(ord(c) + 1)
                hashes[i] = h
        order = np.argsort(hashes[ids])
        self.sorted, self.sorted_ids = hashes[ids][order], ids[order]
        if (self.sorted[1:] == self.sorted[:-1]).any():
            raise ValueError("two pieces have the same hash")
        self.hashes = hashes
        slots = self._slots(hashes[ids])
        self.table = np.full(1 << _SLOT_BITS, len(vocabulary.pieces), dtype=np.int32)
        self.table[slots] = ids
        self.crowded = np.bincount(slots, minlength=1 << _SLOT_BITS) > 1
        rank = np.arange(len(vocabulary.pieces))
        weight = -np.log(rank - (ids.min() if len(ids) else 0) + float(OFFSET), where=vocabulary.normal, out=np.zeros(len(rank)))
        self.weight = (sharpness * weight).astype(np.float32)
        self.byte_weight = np.float32(-sharpness * np.log(len(rank) + float(OFFSET)))

    @staticmethod
    def _slots(h: np.ndarray) -> np.ndarray:
        return ((h * _SPREAD) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, or the vocabulary's size."""
        slots = self._slots(h)
        got = self.table[slots]
        miss = self.hashes[got] != h
        again = miss & self.crowded[slots]
        got[miss] = len(self.weight)
        if again.any():
            at = np.minimum(np.searchsorted(self.sorted, h[again]), len(self.sorted) - 1)
            got[again] = np.where(self.sorted[at] == h[again], self.sorted_ids[at], len(self.weight))
        return got

    def reached(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether a piece may reach across the place before each character of the words that
        begin where `first` holds.  A segmentation that is parted elsewhere is a pair of
        segmentations, so that the lattice is that of its parts."""
        n = len(codes)
        word = np.cumsum(first)
        steps = np.zeros(n + 1, dtype=np.int64)
        at, h = np.arange(n), np.zeros(n, dtype=np.uint64)
        for k in range(self.most):
            h = h * _BASE + codes[at + k].astype(np.uint64) + np.uint64(1)
            if k:
                hit = at[self.find(h) < len(self.weight)]
                np.add.at(steps, hit + 1, 1)
                np.add.at(steps, hit + k + 1, -1)
            on = at + k + 1 < n
            on[on] = word[at[on] + k + 1] == word[at[on]]
            at, h = at[on], h[on]
        return np.cumsum(steps[:n]) > 0

    def build(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Edges:
        """Lattices of the words codes[start : start + length].

        Node n of a word stands before its n-th character, and one after its last.
        """
        first = np.cumsum(lengths + 1) - (lengths + 1)
        n = int((lengths + 1).sum())
        left = np.repeat(first + lengths, lengths + 1) - np.arange(n)  # characters from the node on
        at = np.repeat(starts - first, lengths + 1) + np.arange(n)
        # nodes by their distance from the word's end: those with k characters left are a tail
        narrow = np.uint16 if left.max(initial=0) < 1 << 16 else np.int64  # 16 bits are sorted faster
        nodes = np.argsort(left.astype(narrow), kind="stable")
        ends = np.cumsum(np.bincount(left, minlength=1))
        place = at[nodes]
        h = np.zeros(n, dtype=np.uint64)
        found = []
        for k in range(min(self.most, len(ends) - 1)):
            tail = int(ends[k])
            c = codes[place[tail:] + k]
            h[tail:] = h[tail:] * _BASE + c.astype(np.uint64) + np.uint64(1)
            got = self.find(h[tail:])
            hit = np.flatnonzero(got < len(self.weight))
            piece, weight = got[hit].astype(np.uint16), self.weight[got[hit]]
            if k == 0:  # characters without a piece fall back to bytes
                ids = self.vocabulary.byte_ids[np.minimum(c, 0x7F)].astype(np.uint16)
                ids[c > 0x7F] = NONE
                n_bytes = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
                piece, weight = np.where(got < len(self.weight), got, ids).astype(np.uint16), np.append(self.weight, np.float32(0))[got]
                weight = np.where(got < len(self.weight), weight, self.byte_weight * n_bytes.astype(np.float32))
                hit = np.arange(len(got))
            found.append((hit + tail, piece, weight))
        # edges by node, the longest piece first
        edge_count = np.bincount(np.concatenate([f[0] for f in found]), minlength=n) if found else np.zeros(n, np.int64)
        edge_first = np.cumsum(edge_count) - edge_count
        fill = edge_first.copy()
        total = int(edge_count.sum())
        piece, weight, size = np.zeros(total, np.uint16), np.zeros(total), np.zeros(total, np.uint8)
        for k in range(len(found) - 1, -1, -1):
            own, ids, w = found[k]
            to = fill[own]
            piece[to], weight[to], size[to] = ids, w, k + 1
            fill[own] += 1
        # log of the summed weight of all ways to the word's end
        beta = np.zeros(n)
        source = np.repeat(nodes, edge_count)
        target = source + size
        for d in range(1, len(ends)):
            lo, hi = int(ends[d - 1]), int(ends[d])
            if lo == hi:
                continue
            cut = edge_first[lo:hi]
            e = slice(int(cut[0]), int(cut[-1] + edge_count[hi - 1]))
            ways = weight[e] + beta[target[e]]
            top = np.maximum.reduceat(ways, cut - cut[0])
            ways -= np.repeat(top, edge_count[lo:hi])
            beta[nodes[lo:hi]] = top + np.log(np.add.reduceat(np.exp(ways, out=ways), cut - cut[0]))
        logs = weight
        logs += beta[target]
        logs -= beta[source]
        share = np.exp(logs)
        upto = np.cumsum(share)
        with_edges = np.flatnonzero(edge_count)
        base = np.r_[0.0, upto][edge_first[with_edges]]
        upto -= np.repeat(base, edge_count[with_edges])
        upto[(edge_first + edge_count)[with_edges] - 1] = 2.0  # a draw near 1 takes the last piece
        at_node = np.zeros(n, dtype=np.int32)
        at_node[nodes] = edge_first
        n_edges = np.zeros(n, dtype=np.int32)
        n_edges[nodes] = edge_count
        return Edges(first, at_node, n_edges, piece, size, np.minimum(logs, 0.0).astype(np.float32), upto.astype(np.float32))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x + _SPREAD
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _uniform(rows: np.ndarray, draw: int, place: np.ndarray) -> np.ndarray:
    """In (0, 1), by the row's hash, the number of the draw and the place in the text."""
    x = _mix(rows + _mix(place.astype(np.uint64) + (np.uint64(draw) << np.uint64(48))))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _below(location: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel noise around location, given that it is below top."""
    with np.errstate(divide="ignore", over="ignore"):
        return np.where(np.isfinite(location), location - np.log(np.exp(np.minimum(location - top, 700.0)) - np.log(u)), -np.inf)


class Block:
    """The texts of a block, their words and lattices, and the search over them."""

    def __init__(self, texts: list[str], seeds: np.ndarray, lattices: Lattices):
        self.lattices, self.seeds, self.n = lattices, seeds, len(texts)
        # a blank leads every text that is not empty
        lengths = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
        codes = np.frombuffer("".join(f" {t}" for t in texts if t).encode("utf-32-le", "surrogatepass"), dtype="<u4").copy()
        codes[codes == BLANK] = LITERAL_BLANK
        codes[codes == 32] = BLANK
        self.codes = codes
        self.start = np.cumsum(lengths) - lengths
        self.doc = np.repeat(np.arange(self.n, dtype=np.int32), lengths)
        self._words(lengths)

    def _words(self, lengths: np.ndarray) -> None:
        codes = self.codes
        blank, feed = codes == BLANK, codes == 10
        new = np.zeros(len(codes), dtype=bool)
        new[1:] = (blank[1:] & ~blank[:-1]) | feed[1:] | feed[:-1]
        new[self.start[lengths > 0]] = True
        starts = np.flatnonzero(new)
        size = np.diff(np.r_[starts, len(codes)])
        if len(size) and size.max() > LONG_WORD:
            long = size > LONG_WORD
            at = np.repeat(starts[long], size[long]) + np.concatenate([np.arange(n) for n in size[long].tolist()])
            new[at[~self.lattices.reached(codes[at], new[at])]] = True
            starts = np.flatnonzero(new)
            size = np.diff(np.r_[starts, len(codes)])
        self.word_start, self.word_size = starts, size
        # distinct words, by hash, then checked character by character
        place = np.arange(len(codes)) - np.repeat(starts, size)
        longest = int(size.max(initial=0))
        power = np.ones(longest + 1, dtype=np.uint64)
        np.multiply.accumulate(np.full(longest, _BASE), out=power[1:])
        h = np.add.reduceat((codes.astype(np.uint64) + np.uint64(1)) * _mix(power[place]), starts) if len(starts) else np.zeros(0, np.uint64)
        _, at, kind = np.unique(h, return_index=True, return_inverse=True)
        source = np.repeat(starts[at][kind] - starts, size) + np.arange(len(codes))
        same = (size[at][kind] == size) & (np.bitwise_and.reduceat(codes[np.minimum(source, len(codes) - 1)] == codes, starts) if len(starts) else True)
        odd = np.flatnonzero(~same)  # two words with one hash: a kind of their own
        kind[odd] = len(at) + np.arange(len(odd))
        at = np.r_[at, odd]
        self.edges = self.lattices.build(codes, starts[at], size[at])
        # the node of each character
        self.node = (np.repeat(self.edges.node[kind], size) + place).astype(np.int32)
        self.word_doc = self.doc[starts] if len(starts) else np.zeros(0, np.int32)

    def _complete(self, taken: np.ndarray, at: np.ndarray, end: np.ndarray, draw: int) -> None:
        """Draw edges from the characters `at` to the ends of their words."""
        first, upto, size = self.edges.first, self.edges.upto, self.edges.size
        while len(at):
            doc = self.doc[at]
            u = _uniform(self.seeds[doc], draw, at - self.start[doc]).astype(np.float32)
            edge = first[self.node[at]]
            more = np.flatnonzero(upto[edge] <= u)
            while len(more):
                edge[more] += 1
                more = more[upto[edge[more]] <= u[more]]
            taken[at] = edge
            at = at + size[edge]
            on = at < end
            at, end = at[on], end[on]

    def _path(self, taken: np.ndarray, top: np.ndarray, diverged: np.ndarray, draw: int) -> dict:
        """A path of every document, and the bounds of the sets that turn off after it diverged
        from an earlier path; `top` is its own perturbed value."""
        at = np.flatnonzero(taken >= 0)
        edge, doc = taken[at], self.doc[at]
        logs = self.edges.logp[edge].astype(np.float64)
        total = np.cumsum(logs)
        first = np.searchsorted(doc, np.arange(self.n))
        base = np.r_[0.0, total][first]
        before = total - logs
        before -= np.repeat(base, np.diff(np.r_[first, len(at)]))
        ends = np.r_[first[1:], len(at)]
        path = {"at": at, "edge": edge, "doc": doc, "first": first, "ends": ends, "top": top, "draw": draw}
        path |= {"logp": np.r_[0.0, total][ends] - base, "before": before, "logs": logs, "taken": taken}
        path["after"] = diverged
        path["barred"] = np.int64(1) << (edge - self.edges.first[self.node[at]]).astype(np.int64)
        path["bound"] = np.full(len(at), -np.inf)
        # as bounds exceed the log-probability of their set by less than NOISE, later ones
        # are only drawn where they might win
        self._bounds(path, np.flatnonzero((before > -DEPTH) & (at > diverged[doc])))
        return path

    def _bounds(self, path: dict, steps: np.ndarray) -> None:
        """Bounds of the sets that turn off at these steps."""
        rest = -np.expm1(path["logs"][steps])
        # a node with one edge has no other way, whatever rounding says
        rest[self.edges.count[self.node[path["at"][steps]]] == 1] = 0.0
        self._draw(path, steps, rest, path["top"][path["doc"][steps]], 1000 + path["draw"])

    def _draw(self, path: dict, steps: np.ndarray, rest: np.ndarray, top: np.ndarray, noise: int) -> None:
        at, doc = path["at"][steps], path["doc"][steps]
        with np.errstate(divide="ignore"):
            location = path["before"][steps] + np.log(rest)
        u = _uniform(self.seeds[doc], noise, at - self.start[doc])
        path["bound"][steps] = _below(location, top, u)

    def search(self, k: int) -> tuple[list[dict], np.ndarray]:
        """Up to k paths of each document by falling perturbed value, and the value after the last."""
        taken = np.full(len(self.codes), -1, dtype=np.int32)
        self._complete(taken, self.word_start, self.word_start + self.word_size, 0)
        u = _uniform(self.seeds, 2000, np.zeros(self.n, np.int64))
        top = -np.log(-np.log(u))
        paths = [self._path(taken, top, np.full(self.n, -1), 0) | {"has": np.ones(self.n, bool)}]
        deep = np.zeros(self.n, dtype=bool)
        while True:
            best, source, step = np.full(self.n, -np.inf), np.full(self.n, -1), np.full(self.n, -1)
            for i, path in enumerate(paths):
                if not len(path["at"]):
                    continue
                filled = np.flatnonzero(path["ends"] > path["first"])
                most = np.full(self.n, -np.inf)
                most[filled] = np.maximum.reduceat(path["bound"], path["first"][filled])
                hits = np.flatnonzero((path["bound"] == most[path["doc"]]) & np.isfinite(path["bound"]))[::-1]
                where = np.full(self.n, -1)
                where[path["doc"][hits]] = hits
                more = most > best
                best[more], source[more], step[more] = most[more], i, where[more]
            low = (best < NOISE - DEPTH) & ~deep
            if low.any():  # a set beyond DEPTH might win here
                for path in paths:
                    late = low[path["doc"]] & (path["before"] <= -DEPTH) & (path["at"] > path["after"][path["doc"]])
                    self._bounds(path, np.flatnonzero(late))
                deep |= low
                continue
            if len(paths) == k:
                return paths, best
            paths.append(self._open(paths, best, source, step, len(paths)))

    def _open(self, paths: list[dict], best: np.ndarray, source: np.ndarray, step: np.ndarray, draw: int) -> dict:
        """The path whose perturbed value is the best bound of each document."""
        edges = self.edges
        taken = np.full(len(self.codes), -1, dtype=np.int32)
        turn = np.full(self.n, -1)
        for i, path in enumerate(paths):
            docs = np.flatnonzero(source == i)
            if not len(docs):
                continue
            steps = step[docs]
            at = path["at"][steps]
            turn[docs] = at
            node = self.node[at]
            nth = np.arange(int(edges.count[node].max()))
            there = nth < edges.count[node][:, None]
            ways = np.minimum(edges.first[node][:, None] + nth, len(edges.logp) - 1)
            share = np.where(there, np.exp(edges.logp[ways].astype(np.float64)), 0.0)
            share[(path["barred"][steps, None] >> nth) & 1 == 1] = 0.0
            upto = np.cumsum(share, axis=1)
            u = _uniform(self.seeds[docs], 3000 + draw, at - self.start[docs]) * upto[:, -1]
            take = np.minimum((upto <= u[:, None]).sum(axis=1), len(nth) - 1)
            # rounding must not lead to an edge that is barred
            take = np.where(share[np.arange(len(docs)), take] > 0, take, share.argmax(axis=1))
            path["barred"][steps] |= np.int64(1) << take
            share[np.arange(len(docs)), take] = 0.0
            # what is left of the set needs noise of its own
            self._draw(path, steps, share.sum(axis=1), best[docs], 5000 + draw)
            limit = np.full(self.n, -1)
            limit[docs] = at
            head = np.flatnonzero(np.arange(len(taken)) < limit[self.doc])
            taken[head] = path["taken"][head]
            taken[at] = edges.first[node] + take
        has = source >= 0
        at = turn[has]
        after = at + edges.size[taken[at]]
        word = np.searchsorted(self.word_start, at, side="right") - 1
        end = self.word_start[word] + self.word_size[word]
        inside = after < end
        later = np.flatnonzero(has[self.word_doc] & (self.word_start > turn[self.word_doc]))
        self._complete(
            taken,
            np.r_[after[inside], self.word_start[later]],
            np.r_[end[inside], self.word_start[later] + self.word_size[later]],
            draw,
        )
        return self._path(taken, best, turn, draw) | {"has": has}

    def ids(self, path: dict) -> list[bytes]:
        """Ids of each document, two bytes an id."""
        at = path["at"]
        ids = self.edges.piece[path["edge"]]
        lone = np.flatnonzero(ids == NONE)
        if not len(lone):
            cut = np.r_[path["first"], len(ids)]
        else:  # characters of several bytes
            raw = [chr(c if c != LITERAL_BLANK else BLANK).encode("utf-8", "surrogatepass") for c in self.codes[at[lone]].tolist()]
            times = np.ones(len(ids), dtype=np.int64)
            times[lone] = [len(r) for r in raw]
            upto = np.cumsum(times)
            wide = np.repeat(ids, times)
            wide[wide == NONE] = self.lattices.vocabulary.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            cut, ids = np.r_[0, upto][np.r_[path["first"], len(ids)]], wide
        out = ids.astype("<u2").tobytes()
        return [out[2 * a : 2 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def row_seeds(keys: list, seed: int) -> np.ndarray:
    """A hash of each row's key."""
    return np.array([xxhash.xxh3_64_intdigest(repr(k), seed) for k in keys], dtype=np.uint64)


def segmentations(texts: list[str], seeds: np.ndarray, lattices: Lattices, k: int) -> pd.DataFrame:
    """A row per text and path: row, rank, ids, log_prob, perturbed, log_inclusion."""
    block = Block(texts, seeds, lattices)
    paths, after = block.search(k)
    out = []
    for rank, path in enumerate(paths):
        rows = np.flatnonzero(path["has"])
        ids = block.ids(path)
        x = path["logp"][rows] - after[rows]
        with np.errstate(over="ignore", divide="ignore"):
            log_inclusion = np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 700.0)))))
        out.append(pd.DataFrame({
            "row": rows, "rank": rank, "ids": [ids[i] for i in rows], "log_prob": path["logp"][rows],
            "perturbed": path["top"][rows], "log_inclusion": log_inclusion,
        }))
    return pd.concat(out, ignore_index=True)


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, chars = 0, 0
    for i, t in enumerate(texts):
        if i > start and chars + len(t) > BLOCK_CHARS:
            yield start, i
            start, chars = i, 0
        chars += len(t)
    if start < len(texts):
        yield start, len(texts)


_LATTICES: dict[tuple, Lattices] = {}


def lattices(vocabulary: Vocabulary, sharpness: float) -> Lattices:
    name = (xxhash.xxh3_64_intdigest("\0".join(vocabulary.pieces).encode()), sharpness)
    if name not in _LATTICES:
        _LATTICES[name] = Lattices(vocabulary, sharpness)
    return _LATTICES[name]


def sample_segmentations(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    k: int = SAMPLES,
    seed: int = SEED,
    sharpness: float = SHARPNESS,
    vocabulary: Vocabulary | None = None,
) -> DataFrame:
    """Up to k rows per row of docs: key, rank, ids, n_pieces, log_prob, perturbed, log_inclusion, round_trip.

    `ids` are distinct segmentations of the whole text, two bytes an id, by falling
    perturbed log-probability; a text with fewer segmentations has fewer rows, and null or
    empty ones have a single row without ids.  log_inclusion is the log of the probability
    that a path is among the k, given the bound of what comes after.  round_trip tells
    whether the decoded ids are the text.  Draws depend on the key, the seed and the text
    alone, so that rows with the same key and text are alike.  Further columns are not
    looked at.
    """
    vocabulary = Vocabulary.read() if vocabulary is None else vocabulary
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a public vocabulary of at most 65,535 pieces
    kind = docs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = lattices(sent.value, sharpness)
        for frame in frames:
            keys, texts = frame["key"].tolist(), [t or "" for t in frame["text"]]
            seeds = row_seeds([None if pd.isna(x) else x for x in frame["seed_key"]], seed)
            for start, end in blocks(texts):
                out = segmentations(texts[start:end], seeds[start:end], own, k)
                rows = out.pop("row") + start
                out.insert(0, "key", [keys[i] for i in rows])
                out["n_pieces"] = [len(x) // 2 for x in out["ids"]]
                whole = [f" {t}".encode("utf-8", "surrogatepass") if t else b"" for t in texts[start:end]]
                back = decode_all(out["ids"].tolist(), sent.value)
                out["round_trip"] = [b == whole[i - start] for b, i in zip(back, rows, strict=True)]
                yield out

    rows = docs.select(F.col(key).alias("key"), F.col(key).cast("string").alias("seed_key"), F.col(text).alias("text"))
    schema = f"key {kind}, rank int, ids binary, log_prob double, perturbed double, log_inclusion double, n_pieces int, round_trip boolean"
    return rows.mapInPandas(run, schema).withColumnRenamed("key", key)


def decode(ids: bytes, vocabulary: Vocabulary) -> str:
    """The text of ids, two bytes an id, without the blank that leads it."""
    raw = b"".join(map(vocabulary.raw.__getitem__, np.frombuffer(ids, dtype="<u2").tolist()))
    return raw[1:].decode("utf-8", "surrogatepass")


def decode_all(ids: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """The texts of many lists of ids, as UTF-8, with the blank that leads each."""
    size = np.array([len(r) for r in vocabulary.raw])
    start = np.cumsum(size) - size
    table = np.frombuffer(b"".join(vocabulary.raw), np.uint8)
    flat = np.frombuffer(b"".join(ids), dtype="<u2")
    own = size[flat]
    upto = np.cumsum(own)
    raw = table[np.repeat(start[flat] - (upto - own), own) + np.arange(int(own.sum()))].tobytes()
    cut = np.r_[0, upto][np.cumsum([0, *(len(i) // 2 for i in ids)])].tolist()
    return [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
