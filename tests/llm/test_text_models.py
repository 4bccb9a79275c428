from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from stagetrace.llm import iblt, language, toxicity

EN = "the and of with that this from have which their about would there".split()
DE = "der die und mit nicht ein über für schön können müssen straße weiß".split()


def speech(rng, words, n=30):
    return " ".join(rng.choices(words, k=n))


def test_presence_is_that_of_each_text_alone():
    texts = ["abc", "", "ab", "日本語 text", "ABC", "x" * 5000]
    together = language.presence(texts)
    assert all((together[i] == language.presence([t])[0]).all() for i, t in enumerate(texts))
    assert (together[0] == together[4]).all() and not together[1].any()
    k = language.kernel(together, together)
    assert np.allclose(np.diag(k)[[0, 2, 3, 5]], 1) and np.allclose(k, k.T)
    grams = {g for n in (1, 2, 3) for g in ("abc"[i : i + n] for i in range(4 - n))}
    assert k[0, 2] == pytest.approx(3 / np.sqrt(len(grams) * 3))


def test_languages_are_told_apart(make):
    rng = random.Random(4)
    rows = [(i, speech(rng, EN if i % 2 else DE), "s", "en" if i % 2 else "de") for i in range(120)]
    rows += [(200, None, "s", "en"), (201, "", "s", "de"), (202, "123 !? 456", "s", "en"), (203, "die und der " * 9000, "s", None)]
    rows += [(204, speech(rng, EN), "s", None), (204, speech(rng, EN), "s", None), (None, speech(rng, DE), "s", None)]
    docs = make(rows)
    model = language.fit(docs, most=40, landmarks=16)
    assert model.languages == ["de", "en"] and len(model.landmarks) == 16
    got = language.identify(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id in (200, 201, 202):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id in (None, 203):
            assert r.lang_pred == "de"
        elif r.doc_id == 204:
            assert r.lang_pred == "en"
        else:
            assert r.lang_pred == ("en" if r.doc_id % 2 else "de")
    again = language.fit(make(rows, parts=7), most=40, landmarks=16)
    assert np.allclose(again.weights, model.weights)
    nothing = language.fit(docs.where("false"))
    assert nothing is None and {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}


def brute_scores(texts, labels, queries, k=16):
    """Scores by all cosines over all words of the examples, from plain dictionaries.

    texts: {key: text} of all documents; labels: {key: label} of the examples."""
    words = {d: Counter(re.findall(r"\w+", (t or "").lower())) for d, t in texts.items()}
    known = {w for d in labels for w in words[d]}
    df = Counter(w for c in words.values() for w in c if w in known)
    pos, neg = sum(labels.values()), len(labels) - sum(labels.values())
    factor = {}
    for w in known:
        a, b = (sum(w in words[d] for d, y in labels.items() if y == z) for z in (1, 0))
        c, d = pos - a, neg - b
        across = (a + b) * (c + d) * pos * neg
        chi2 = (pos + neg) * (a * d - b * c) ** 2 / across if across else 0.0
        factor[w] = (math.log((1 + len(texts)) / (1 + df[w])) + 1) * math.sqrt(chi2)

    def vector(counts):
        v = {w: (1 + math.log(n)) * factor[w] for w, n in counts.items() if factor.get(w)}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    examples = [(y, vector(words[d])) for d, y in labels.items()]
    prior, extra = pos / len(labels), toxicity.PRIOR_VOTES
    none = [y for y, v in examples if not v]
    out = {}
    for key in queries:
        query = vector(words[key])
        sims = sorted(((sum(query.get(w, 0.0) * x for w, x in v.items()), y) for y, v in examples if v), reverse=True)
        near = [(s, y) for s, y in sims if s > 1e-12 and s >= sims[min(k, len(sims)) - 1][0] - 1e-9]
        if near:
            share = min(1.0, k / len(near))
            votes = sum(s * s * share for s, _ in near)
            out[key] = (sum(s * s * share for s, y in near if y) + extra * prior) / (votes + extra)
        else:
            out[key] = (sum(none) + extra * prior) / (len(none) + extra)
    return out


@pytest.mark.parametrize("block, full", [(7, 0), (20, 5), (512, 512)])
def test_scores_against_all_cosines(spark, make, monkeypatch, block, full):
    """From the texts on, over the whole vocabulary; every example with a word of weight is indexed."""
    monkeypatch.setattr(toxicity, "BLOCK", block)
    monkeypatch.setattr(toxicity, "FULL_LISTS", full)
    rng = random.Random(12)
    rare = [f"word{i}" for i in range(300)]
    texts = {i: " ".join(rng.choices(EN, k=8) + rng.choices(rare, k=rng.randrange(0, 12)) + ["vile"] * (i % 4 == 0 and rng.randrange(3))) for i in range(260)}
    texts |= {900: None, 901: "", 902: "!!", 903: "unheard of nonsense", 904: texts[8], 905: texts[9].upper()}
    labels = {i: int(i % 4 == 0) for i in range(150)} | {900: 0, 904: 1}
    docs = make(list(texts.items()))
    training = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, training).collect()}
    want = brute_scores(texts, labels, texts)
    assert got.keys() == want.keys()
    assert all(got[d] == pytest.approx(want[d], abs=1e-6) for d in want)
    index = toxicity.build_index(docs, training)
    assert len(index.ids) == len(labels) - 1  # but the empty one
    assert len(index.lists) == min(full, len(index.factor))
    if full < len(index.factor):
        assert len(set(index.block.tolist())) > 100 // block


def test_words_are_found_without_a_pattern_where_one_byte_does(monkeypatch):
    odd = "".join(map(chr, range(256)))
    texts = [None, "", odd, odd[::-1], "a" + "b".join(odd), "Straße_1 ça va\x85x\xa0y²", "é\u2019a 日本語 x", "İstanbul \u0130"]
    want = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    assert [toxicity.words_of(t) for t in texts] == want
    monkeypatch.setattr(toxicity, "_WORD", None)
    assert [toxicity.words_of(t) for t in texts[:6]] == want[:6]


def test_terms_of_most_examples_come_first(spark):
    rows = [("b c", 0), ("b c a", 1), ("d b", 0), ("B x", 1), (None, 0)]
    terms, a, b = toxicity.example_words(spark.createDataFrame(rows, "text string, toxic int"))
    assert terms.lines.split("\n") == ["b", "c", "a", "d", "x"]
    assert (a.tolist(), b.tolist()) == ([2, 1, 1, 0, 1], [2, 1, 0, 1, 0])


def test_no_example_is_left_out_at_any_size(spark):
    """Every sampled example with a word is indexed, and held-out toxic documents are found."""
    for sf, least in (("sf0.001", None), ("sf0.01", 0.8)):
        docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
        training = toxicity.training_rows(docs, labels)
        index = toxicity.build_index(docs, training)
        met = docs.join(training, "doc_id").where("text rlike '\\\\w'").count()
        assert 0.99 * met <= len(index.ids) <= met
        if least:
            truth = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
            scores = {r.doc_id: r.score for r in toxicity.score_documents(docs, training).collect()}
            pos, neg = ([scores[d] for d, y in truth.items() if d in scores and y == z] for z in (1, 0))
            auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
            assert auc >= least


def test_toxic_texts_are_found(spark, make):
    rng = random.Random(8)
    rows = [(i, speech(rng, EN) + (" vile slurword" if i % 5 == 0 else "")) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "so vile " * 20_000), (None, "plain words"), (403, "Slurword!"), (403, "Slurword!")]
    docs = make(rows)
    labels = spark.createDataFrame(
        [(i, int(i % 5 == 0)) for i in range(200)] + [(5, 0), (None, 1), (7, None), (999, 1)], "doc_id long, toxic int"
    )
    training = toxicity.training_rows(docs, labels)
    got = {(r.doc_id, r.score): r for r in toxicity.score_documents(docs, training, most_examples=80).collect()}
    assert {r.doc_id for r in got.values()} == {r[0] for r in rows}
    for r in got.values():
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        toxic = r.doc_id in (402, 403) or (r.doc_id is not None and r.doc_id < 300 and r.doc_id % 5 == 0)
        assert r.predicted == toxic and (r.neighbours or not toxic)
    kept = toxicity.without_toxic(docs, training, most_examples=80)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 60 - 3
    none = toxicity.score_documents(docs, training.where("false"))
    assert {r.score for r in none.collect()} == {0.0}
    assert toxicity.score_documents(docs.where("false"), training).count() == 0


def test_held_out_labels_are_not_learnt(spark):
    labels = spark.createDataFrame([(i, 1) for i in range(500)], "doc_id long, toxic int")
    learnt = {r.doc_id for r in toxicity.training_rows(labels, labels).collect()}
    assert learnt == {i for i in range(500) if zlib.crc32(str(i).encode()) % 5}


def paragraphs(text):
    return set(re.split(iblt.PARAGRAPH, text or ""))


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("load", [5, 60])
def test_fingerprints_against_sets(make, odd_rows, load, monkeypatch):
    monkeypatch.setattr(iblt, "LOAD", load)  # too few cells at first: peeling must be retried
    rng = random.Random(9)
    rows = [r for r in odd_rows if r[0] not in (7, None)]
    rows += [(300 + i, ". ".join(speech(rng, EN, 3) for _ in range(rng.randrange(1, 60)))) for i in range(30)]
    rows += [(500, rows[-1][1]), (501, rows[-1][1])]
    got = {r.doc_id: r for r in iblt.document_fingerprints(make(rows)).collect()}
    ordered = sorted(rows, key=lambda r: -r[0])
    for i, (doc, text, *_) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        r = got[doc]
        assert r.n_chars == len(text)
        assert r.near_edited == pytest.approx(jaccard(paragraphs(text), paragraphs(edited)))
        assert r.near_next == pytest.approx(jaccard(paragraphs(text), paragraphs(after)))
        assert (r.fingerprint == r.edited_fingerprint) == (paragraphs(text) == paragraphs(edited))
    by_text = {}
    for doc, text, *_ in rows:
        by_text.setdefault(text or "", set()).add(got[doc].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())


def test_repeated_keys_and_few_rows(make, odd_rows):
    assert iblt.document_fingerprints(make(odd_rows)).count() == len(odd_rows)
    alone = iblt.document_fingerprints(make([(1, "One. Two. Three.")])).first()
    assert alone.near_next == 1.0
    assert iblt.document_fingerprints(make(odd_rows).where("false")).count() == 0


def test_edited_digests_are_kept_from_where_they_part(make, odd_rows):
    rows = [r for r in odd_rows if r[0] not in (7, None)] + [(300, "One. Two. One. Three. Four. Five."), (299, "Six. One. Seven.")]
    got = {r.doc_id: r for r in iblt.edited_versions(make(rows)).collect()}
    ordered = sorted(rows, key=lambda r: -r[0])
    for i, (doc, text, *_) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        r = got[doc]
        digests = r.digests[: r.shared] + r.edited_rest
        assert len(r.digests) == len(paragraphs(text)) and len(set(digests)) == len(digests) == len(paragraphs(edited))
        assert len(set(digests) & set(r.digests)) == len(paragraphs(text) & paragraphs(edited))
        assert r.shared == len(r.digests) or r.edited_rest[:1] != [r.digests[r.shared]]
    assert (got[300].shared, len(got[300].edited_rest)) == (3, 2)  # Six. and S


def test_of_several_next_texts_the_least_counts(make):
    rows = [(3, "a. b. c. d. e. f."), (2, "q. r."), (2, "m. n."), (2, "z."), (None, "y. x. w."), (None, "k. b.")]
    want = [(3, "a. b. c. d. m. n."), (2, "q. rk"), (2, "m. nk"), (2, "z."), (None, "y. x. a."), (None, "k. ba")]
    got = Counter((r.doc_id, r.edited_sha256) for r in iblt.edited_versions(make(rows)).collect())
    assert got == Counter((doc, hashlib.sha256(text.encode()).hexdigest()) for doc, text in want)


def exchanges(df):
    """The columns of each exchange of the plan that ran."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    ran = text.split("== Final Plan ==")[1].split("== Initial Plan ==")[0]
    numbers = re.findall(r"[+:]- (?:\* )?Exchange \((\d+)\)", ran)
    return [re.search(rf"\n\({n}\) Exchange\nInput \[\d+\]: (.*)", text)[1] for n in numbers]


def test_heads_shuffle_once_and_next_digests_not_for_the_result(spark, make):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = make([(i, "One. Two. Three. Four." + " So." * i) for i in range(40)])
        versions = iblt.edited_versions(docs)
        versions.collect()
        assert sum(bool(re.search(r"\b(head|min)#", x)) for x in exchanges(versions)) == 1
        out = iblt.document_fingerprints(docs)
        out.collect()
        found = exchanges(out)
        assert any("digests#" in x for x in found) and not any("next_digests#" in x for x in found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
