from __future__ import annotations

import random

import corpus_pipeline

from stagetrace.llm import simhash

EN = "the and of with that this from have which their about would there".split()


def least_linked(texts):
    """The least key of each group, by all pairs of fingerprints."""
    fps = {k: simhash.fingerprint(t) for k, t in texts.items()}
    root = {k: k for k in fps}
    for a in fps:
        for b in fps:
            if root[a] != root[b] and ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() <= simhash.TAU:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return set(root.values())


def test_stages_in_turn(spark, tmp_path):
    rng = random.Random(3)
    texts = {i: " ".join(rng.choices(EN, k=60)) for i in range(120)}
    for i in range(0, 120, 6):
        texts[i] += " vile slurword"
    near = {200 + i: texts[1 + 6 * i] for i in range(5)}  # exact copies
    words = texts[2].split() * 40
    # long near copies
    texts[300], texts[301], texts[302] = " ".join(words), " ".join([*words[:-1], "changed"]), " ".join(["x", *words])
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in {**texts, **near}.items()] + [(500, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i % 6 == 0)) for i in range(90)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r.doc_id for r in docs.collect()}
    clean = {i for i in texts if i >= 300 or i % 6} | set(near) | {500}
    assert seen["toxicity"] == clean
    assert seen["exact_dedup"] == clean - {1 + 6 * i for i in range(5)}
    assert seen["simhash_near_dedup"] == least_linked({i: (texts | near).get(i) for i in seen["exact_dedup"]})
    assert not seen["simhash_near_dedup"] & {301, 302}
    assert seen["source_mix"] <= seen["simhash_near_dedup"]
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in final.collect()} == seen["source_mix"]
    assert all(r.round_trip for r in final.collect())
