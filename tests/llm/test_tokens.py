from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from stagetrace.llm import sampling, token_order
from stagetrace.llm.sampling import Lattices, Vocabulary, decode, row_seeds, segmentations


def small_vocabulary():
    pieces = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), "▁", "a", "b", "▁a", "ab", "ba", "bab", "▁ab"]
    raw = [b"", *(bytes([b]) for b in range(256)), *(p.replace("▁", " ").encode() for p in pieces[257:])]
    normal = np.array([False] * 257 + [True] * 8)
    return Vocabulary(pieces, raw, normal, np.arange(1, 257))


def all_paths(text, vocabulary, lattices):
    """Every segmentation with its probability."""
    text = "▁" + text.replace(" ", "▁")
    ids = {p: i for i, p in enumerate(vocabulary.pieces) if vocabulary.normal[i]}
    paths = []

    def walk(at, path, weight):
        if at == len(text):
            paths.append((tuple(path), weight))
        for end in range(at + 1, min(len(text), at + lattices.most) + 1):
            if text[at:end] in ids:
                i = ids[text[at:end]]
                walk(end, [*path, i], weight + float(lattices.weight[i]))

    walk(0, [], 0.0)
    total = math.log(sum(math.exp(w) for _, w in paths))
    return {p: math.exp(w - total) for p, w in paths}


@pytest.mark.parametrize("text,k", [("abab", 2), ("ab abab", 3)])
def test_draws_follow_the_distribution_without_replacement(text, k):
    vocabulary = small_vocabulary()
    lattices = Lattices(vocabulary, 0.7)
    true = all_paths(text, vocabulary, lattices)
    n = 6000
    out = segmentations([text] * n, row_seeds(list(range(n)), 5), lattices, k)
    out["path"] = [tuple(np.frombuffer(x, "<u2").tolist()) for x in out["ids"]]
    assert (out.groupby("row")["path"].nunique() == k).all()
    assert np.allclose(out["log_prob"], [math.log(true[p]) for p in out["path"]], atol=1e-5)
    assert out.groupby("row")["perturbed"].apply(lambda x: x.is_monotonic_decreasing).all()
    first = Counter(out[out["rank"] == 0]["path"])
    second = Counter(out[out["rank"] == 1]["path"])
    then = defaultdict(float)
    for a, p in true.items():
        for b, q in true.items():
            if a != b:
                then[b] += p * q / (1 - p)
    for p in true:
        assert abs(first[p] / n - true[p]) < 5 * math.sqrt(true[p] / n) + 1e-3
        assert abs(second[p] / n - then[p]) < 5 * math.sqrt(then[p] / n) + 1e-3
    # each path's inverse inclusion probability weighs it right: the mean is 1, within five
    # standard errors, as inverses have a heavy tail
    weights = defaultdict(list)
    for p, x in zip(out["path"], out["log_inclusion"], strict=True):
        weights[p].append(math.exp(-x))
    for p in true:
        if true[p] > 0.05:
            mean, square = sum(weights[p]) / n, sum(x * x for x in weights[p]) / n
            assert abs(mean - 1) < 5 * math.sqrt((square - mean * mean) / n)


def test_all_segmentations_come_out_when_k_is_large():
    vocabulary = small_vocabulary()
    lattices = Lattices(vocabulary, 1.0)
    true = all_paths("aba", vocabulary, lattices)
    out = segmentations(["aba", "", "aba"], row_seeds([1, 2, 3], 5), lattices, 50)
    assert out["row"].value_counts().to_dict() == {0: len(true), 2: len(true), 1: 1}
    paths = {tuple(np.frombuffer(x, "<u2").tolist()) for x in out[out["row"] == 0]["ids"]}
    assert paths == set(true)
    assert (out["log_inclusion"] == 0).all()


@pytest.mark.parametrize("unit", ["ab", "abba", "aéb", "zz", "abé"])
def test_long_runs_without_a_blank_are_whole(unit):
    """A run of 900 characters has the probabilities of its whole lattice, wherever it is parted."""
    vocabulary = small_vocabulary()
    lattices = Lattices(vocabulary, 0.7)
    text = (unit * 900)[:900]
    blank = chr(sampling.BLANK)
    codes = blank + text
    # log of the summed weight of all ways from each place to the end
    match = {p: float(lattices.weight[i]) for i, p in enumerate(vocabulary.pieces) if vocabulary.normal[i]}
    ways = [0.0] * (len(codes) + 1)
    for at in range(len(codes) - 1, -1, -1):
        found = [w + ways[at + len(p)] for p, w in match.items() if codes.startswith(p, at)]
        if codes[at] not in match:
            found.append(float(lattices.byte_weight) * len(codes[at].encode()) + ways[at + 1])
        top = max(found)
        ways[at] = top + math.log(sum(math.exp(x - top) for x in found))
    out = segmentations([text] * 3, row_seeds([1, 2, 3], 5), lattices, 2)
    for ids, logp in zip(out["ids"], out["log_prob"], strict=True):
        assert decode(ids, vocabulary) == text
        pieces = np.frombuffer(ids, "<u2").tolist()
        total = sum(float(lattices.weight[i] if vocabulary.normal[i] else lattices.byte_weight) for i in pieces)
        assert logp == pytest.approx(total - ways[0], abs=0.02)


TEXTS = ["", "a", "▁ sign ▁▁", "two  spaces   three", "line\n\nfeeds\r\n\ttab", "é日本😀\u0000", "x" * 3000, " leading and trailing ", "word " * 3000]


def test_decoding_gives_the_text_back():
    vocabulary = Vocabulary.read()
    lattices = sampling.lattices(vocabulary, 1.0)
    out = segmentations(TEXTS, row_seeds(list(range(len(TEXTS))), 2), lattices, 3)
    for row, ids in zip(out["row"], out["ids"], strict=True):
        assert decode(ids, vocabulary) == TEXTS[row]
    back = sampling.decode_all(out["ids"].tolist(), vocabulary)
    assert [b[1:].decode() for b in back] == [TEXTS[r] for r in out["row"]]
    assert out.groupby("row")["ids"].nunique().to_dict() == out["row"].value_counts().to_dict()


def test_draws_do_not_depend_on_blocks():
    lattices = sampling.lattices(Vocabulary.read(), 1.0)
    seeds = row_seeds(list(range(len(TEXTS))), 2)
    whole = segmentations(TEXTS, seeds, lattices, 2)
    for i in range(len(TEXTS)):
        alone = segmentations(TEXTS[i : i + 1], seeds[i : i + 1], lattices, 2)
        assert alone["ids"].tolist() == whole[whole["row"] == i]["ids"].tolist()


def test_sampled_documents(make, odd_rows):
    docs = make(odd_rows)
    got = sampling.sample_segmentations(docs).collect()
    texts = [(d, t or "") for d, t, *_ in odd_rows]
    assert all(r.round_trip for r in got) and len(got) <= 2 * len(texts)
    empty = [r for r in got if r.doc_id in (1, 2, 3)]
    assert [(r.rank, bytes(r.ids), r.n_pieces) for r in empty] == [(0, b"", 0)] * 3
    assert sampling.sample_segmentations(docs.where("false")).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 65, 1000, 4097])
def test_feistel_walks_permute(size):
    order = token_order.Feistel(size, 11)
    slots = order.slots(np.arange(size))
    assert sorted(slots.tolist()) == list(range(size))
    assert (order.numbers(slots) == np.arange(size)).all()
    if size > 60:
        assert (slots != token_order.Feistel(size, 12).slots(np.arange(size))).any()


def test_words_are_encoded_as_in_the_text(odd_rows):
    import base64

    import tiktoken

    vocabulary = token_order.read_vocabulary()
    encode = token_order.tokenizer(vocabulary)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    whole = tiktoken.Encoding("whole", pat_str=token_order.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in TEXTS + [r[1] or "" for r in odd_rows] + ["it's we'll ''s  12ab!?  \n x"]:
        assert np.frombuffer(encode(text), "<u2").tolist() == whole.encode_ordinary(text)


def test_shards_hold_every_sequence_once(spark, make, odd_rows, tmp_path):
    import tiktoken

    docs = make(odd_rows)
    path = token_order.write_shards(docs, f"{tmp_path}/shards", sequence=32, shard_records=100)
    stride = token_order.record_type(32).itemsize
    for folder in (tmp_path / "shards").glob("shard=*"):
        (file,) = folder.glob("*.txt")
        assert file.stat().st_size % stride == 0 and file.stat().st_size <= 100 * stride
    rows = token_order.read_shards(spark, path, 32, 100).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(len(rows))) and all(r.shard == r.slot // 100 for r in rows)
    vocabulary = token_order.read_vocabulary()
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    whole = tiktoken.Encoding("whole", pat_str=token_order.PATTERN, mergeable_ranks=ranks, special_tokens={"<end>": 50256})
    parts = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert (ids[r.n_tokens :] == token_order.END_OF_TEXT).all()
        parts[r.doc].append((r.sequence, ids[: r.n_tokens].tolist()))
    for doc, text, *_ in odd_rows:
        if doc in (7, None):  # there twice
            continue
        got = [i for _, ids in sorted(parts[doc]) for i in ids]
        assert got[-1] == token_order.END_OF_TEXT and whole.decode(got[:-1]) == (text or "")
    later = token_order.read_shards(spark, path, 32, 100, start=250).collect()
    assert sorted(r.slot for r in later) == list(range(250, len(rows)))
    none = token_order.write_shards(docs.where("false"), f"{tmp_path}/none", sequence=32)
    assert none == f"{tmp_path}/none"


def test_texts_are_encoded_by_their_parts(odd_rows, monkeypatch):
    """The ids of the whole text, also across blanks of every kind and in small blocks."""
    import pyarrow as pa

    monkeypatch.setattr(token_order, "BLOCK_BYTES", 2000)
    rng = random.Random(3)
    odd = " \n\t\r\x0b\x1c\x85\xa0 　​'as1.é日😀"
    texts = [None, "", " ", "  ", " a", "a ", "a  b", "a \nb", "a\n b", "a \xa0b", "'s 's", "x\x1c \x1cy"]
    texts += TEXTS + [r[1] for r in odd_rows] + ["".join(rng.choices(odd, k=rng.randrange(1, 30))) for _ in range(2000)]
    encode = token_order.tokenizer(token_order.read_vocabulary())
    got = list(token_order.text_ids(pa.array(texts, pa.string()), encode))
    assert len(got) == len(texts)
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == encode.encoding.encode_ordinary(text or ""), repr(text)


def test_no_ids_are_kept_beside_the_shards(spark, tmp_path, monkeypatch):
    """Stored documents are read again; nothing but the shards is written, and the slots are a
    permutation even if the rows move to other tasks after they were counted."""
    rows = [(i, f"word {i} " * (i % 90)) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents")
    docs = spark.read.parquet(f"{tmp_path}/documents")
    monkeypatch.setattr(token_order, "saved", None)
    path = token_order.write_shards(docs, f"{tmp_path}/shards", sequence=32, shard_records=100, stored=True)
    got = token_order.read_shards(spark, path, 32, 100).collect()
    counted, calls = token_order.token_counts, []

    def moved(*args):
        calls.append(1)
        out = counted(*args)
        return out.selectExpr("part", "n + 1 AS n") if len(calls) == 1 else out

    monkeypatch.setattr(token_order, "token_counts", moved)
    path = token_order.write_shards(docs, f"{tmp_path}/again", sequence=32, shard_records=100, stored=True)
    again = token_order.read_shards(spark, path, 32, 100).collect()
    assert len(calls) == 2 and sorted(again) == sorted(got)
    assert sorted(r.slot for r in got) == list(range(len(got))) and {r.doc for r in got} == set(range(300))
