from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stagetrace.llm import packing
from stagetrace.llm.queries import op12_best_fit_packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def check_pieces(rows, texts, tokenizer, capacity):
    """Every document whole, in pieces as the contract cuts them; every sequence without a gap."""
    want, got = Counter(), Counter()
    for key, text in texts:
        ids = ids_of(tokenizer, text)
        rest = len(ids) % capacity or min(capacity, len(ids))
        bounds = [0, *range(rest, len(ids), capacity), len(ids)]
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want[key, i, a, b - a, np.array(ids[a:b], "<u4").tobytes()] += 1
    sequences = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, bytes(r.ids)] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def fewest(lengths, capacity):
    """First fit, longest first, as a yardstick."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        for i, gap in enumerate(gaps):
            if gap >= n:
                gaps[i] -= n
                break
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("capacity", [8, 40, 2048])
def test_pieces_and_sequences(make, odd_rows, tokenizer, capacity):
    docs = make(odd_rows)
    out = packing.pack(docs, capacity=capacity)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    rows = out.collect()
    n = check_pieces(rows, [(r[0], r[1]) for r in odd_rows], tokenizer, capacity)
    assert n <= fewest([r.length for r in rows], capacity)
    assert {r.sequence_id for r in rows} == set(range(n))
    if capacity == 40:
        place = ("doc_id", "piece", "sequence_id", "offset")
        again = packing.pack(make(odd_rows, parts=7), capacity=capacity).collect()
        unlike = [r for r in rows if r.doc_id not in (None, 7)]
        assert sorted(tuple(r[c] for c in place) for r in unlike) == sorted(
            tuple(r[c] for c in place) for r in again if r.doc_id not in (None, 7)
        )
        whole = {r.sequence_id: r for r in packing.sequences(out).collect()}
        for r in rows:
            s = whole[r.sequence_id]
            assert bytes(s.ids)[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids) and r.offset in s.starts
            assert s.n_tokens == len(s.ids) // 4


def test_nothing_to_pack(make):
    assert packing.pack(make([(1, "a")]).where("false")).collect() == []


def test_encoder_agrees_with_the_tokenizer(tokenizer):
    encode = packing.Encoder(tokenizer.to_str())
    rng = random.Random(4)
    odd = "\x1c\x1d\x85\xa0 　​﻿\U0001e900\U00010d40ⅷ½²٣ǅʰ'’ éß日本の\n\t 's 'LL aA1.-_"
    texts = ["", "<|endoftext|>", "a <|endoftext|>b", "it's we'll I'VE", "  two  spaces \n\n end  ", "x" * 3000, " " * 500]
    texts += ["".join(rng.choices(odd, k=rng.randrange(1, 40))) for _ in range(300)]
    texts += ["".join(chr(c) for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in range(0, 0x3400, 64)]
    for text in texts:
        assert encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_characters_are_tried_once(tokenizer, monkeypatch):
    """New words of known characters cost no look at each character."""
    words, tried = packing.Encoder(tokenizer.to_str()).words, Counter()
    agrees = words._agrees
    monkeypatch.setattr(words, "_agrees", lambda char: tried.update(char) or agrees(char))
    for word in ("abc", " cab", "aÉb", "ÉÉ1"):
        assert words[word]
    for _ in range(2):
        with pytest.raises(packing.OddCharacter):
            words["a\u0558b"]
    assert set(tried.values()) == {1} and words.odd == {"\u0558"} and words.agreed == set("abc É1")


def unpacked(fillings):
    return Counter(n for f in fillings for n in f.lengths for _ in range(f.times))


@pytest.mark.parametrize("seed", range(12))
def test_fillings_use_every_document_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 100, 2048])
    counts = [0] * (capacity + 1)
    for _ in range(rng.choice([0, 1, 30, 3000])):
        counts[min(capacity, 1 + int(rng.expovariate(4 / capacity)))] += rng.choice([1, 1, 1000])
    fillings = packing.best_two_fit(counts, capacity)
    lengths = {n: c for n, c in enumerate(counts) if c}
    assert unpacked(fillings) == lengths or max(counts) > 10_000
    assert all(sum(f.lengths) <= capacity and f.times > 0 for f in fillings)
    total = sum(n * c for n, c in lengths.items())
    used = sum(f.times for f in fillings)
    assert used >= -(-total // capacity)
    if sum(lengths.values()) < 4000:
        assert used <= fewest(list(Counter(lengths).elements()), capacity)
    places = packing.Places(fillings, capacity)
    assert places.sequences == used
    number = np.arange(min(sum(counts), 20_000))
    sequence, offset = places(number)
    length = np.repeat(np.arange(capacity + 1), counts)[: len(number)]
    if len(number) == sum(counts):
        ends = np.zeros(used, dtype=int)
        np.maximum.at(ends, sequence, offset + length)
        assert (np.bincount(sequence, weights=length, minlength=used) == ends).all() and (ends <= capacity).all()


def test_two_documents_replace_the_smallest():
    # greedy leaves 6 + 3 of 10; 2 + 2 fill the gap of 4 tightly
    counts = [0] * 11
    counts[6], counts[3], counts[2] = 1, 1, 2
    assert [f.lengths for f in packing.best_two_fit(counts, 10)] == [(6, 2, 2), (3,)]


def test_query_over_the_whole_table(spark, tokenizer):
    """Every document of the table, its ids by the tokenizer itself; close to the least number of sequences."""
    sf_dir = "/root/testdata/sf0.001"
    rows = op12_best_fit_packing(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = {k: ids_of(tokenizer, t) for k, t in texts.items()}
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(part) == r.ids_crc32 and len(part) == 4 * r.length
    least = -(-sum(map(len, ids.values())) // 2048)
    assert least <= len({r.sequence_id for r in rows}) <= least + 1


def test_parts_of_texts_are_encoded_once(tokenizer, monkeypatch):
    """The tokenizer's ids, block by block; a part that is there often is looked at once a block."""
    import pyarrow as pa

    from stagetrace.llm import token_order

    encode = packing.Encoder(tokenizer.to_str())
    rng = random.Random(6)
    odd = " \x1c\x85\xa0 \u2003\u200b's aé日\n1."
    texts = [None, "", " ", "a <|endoftext|> b", "<|endoftext|> a", "\x1c a b", "a \x85b", " a  b \n c ", "a\u0558 b", "b \u0558a a", "b a\u0558c d"]
    texts += ["".join(rng.choices(odd, k=rng.randrange(1, 30))) for _ in range(1500)]
    with monkeypatch.context() as m:
        m.setattr(token_order, "BLOCK_BYTES", 1000)
        got = [ids.tolist() for ids in token_order.text_ids(pa.array(texts, pa.string()), encode)]
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    seen, find = [], encode.words.find
    encode.words.find = lambda text: seen.extend(out := find(text)) or out
    list(token_order.text_ids(pa.array(["one two, two"] * 50), encode))
    assert seen.count(" two") == 2
